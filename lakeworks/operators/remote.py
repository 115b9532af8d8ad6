"""Calling an outside function on JSON texts, and checking the texts first."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import col

STOPS_TYPE = "array<struct<lat:double,lng:double>>"
FEW_STOPS = "Need at least 2 stops to create a route"
BAD_JSON = "Invalid JSON format"


def input_error(stops_json: Column | str) -> Column:
    """Error JSON for a text that is no list of two or more stops, else NULL."""
    text = col(stops_json)
    parsed = F.from_json(text, STOPS_TYPE)
    as_any = F.try_parse_json(text)

    def error(message: str) -> Column:
        return F.to_json(F.struct(F.lit(message).alias("error")))

    return F.when(as_any.isNull(), error(BAD_JSON)).when(
        parsed.isNull() | (F.size(parsed) < 2), error(FEW_STOPS)
    )


def call_remote(
    df: DataFrame, text_column: str, call: Callable[[list[str]], list[str]], out: str = "response", batch: int = 1
) -> DataFrame:
    """Add the answer of ``call`` for every text, ``batch`` texts per call.

    Texts that fail the input check get their error JSON and are not sent.
    """
    checked = df.withColumn("_error", input_error(text_column))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            answers = frame["_error"].astype(object).to_numpy()
            send = [i for i, e in enumerate(answers) if not isinstance(e, str)]
            texts = frame[text_column].to_numpy()
            for at in range(0, len(send), batch):
                chosen = send[at : at + batch]
                for i, answer in zip(chosen, call([texts[j] for j in chosen]), strict=True):
                    answers[i] = answer
            yield frame.drop(columns="_error").assign(**{out: answers})

    schema = df.schema.add(out, "string")
    return checked.mapInPandas(run, schema)
