"""Every operator run over the driver tables, with the SQL that checks it."""

from .registry import ORACLES, QUERIES, Tables  # noqa: F401
from . import (  # noqa: F401
    models_q,
    aggregates_q,
    events_q,
    places_q,
    geo_q,
    security_q,
    quality_q,
    audit_q,
    workload_q,
    metrics_q,
    ingest_q,
    streaming_q,
)
