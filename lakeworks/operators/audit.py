"""Access audit: policies and dataset ACLs as one table of permission entries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.principals import acl_member, acl_member_type, classify_email, member_type, path_part
from ..functions.values import case_map
from ..session import settle
from .skew import BLOCK_PAIRS, blocked_join

# Asset types and the resource type each one stands for (fixed values).
ASSET_RESOURCE = {
    "cloudresourcemanager.googleapis.com/Folder": "FOLDER",
    "cloudresourcemanager.googleapis.com/Project": "PROJECT",
    "bigquery.googleapis.com/Dataset": "DATASET",
    "bigquery.googleapis.com/Table": "TABLE",
}
ENTRY = [
    "project_id",
    "dataset_id",
    "resource_id",
    "resource_type",
    "role",
    "member",
    "member_type",
    "source",
    "inherited_from_group",
]


def iam_flatten(
    policies: DataFrame, resource_types: Sequence[str] = tuple(ASSET_RESOURCE.values()), projects: Sequence[str] | None = None
) -> DataFrame:
    """One entry per resource, role and member.

    Tables and views share an asset type, so asking for views keeps tables too. Folders belong
    to no project and pass the project filter; unreadable folders and other assets are left out.
    """
    wanted = set(resource_types) | ({"TABLE"} if "VIEW" in resource_types else set())
    kind = F.col("resource_type")
    parsed = policies.select(
        case_map("asset_type", ASSET_RESOURCE).alias("resource_type"),
        path_part("resource", "projects").alias("_project"),
        path_part("resource", "datasets").alias("_dataset"),
        path_part("resource", "tables").alias("_table"),
        path_part("resource", "folders").alias("_folder"),
        "bindings",
    ).filter(kind.isin(sorted(wanted)))
    is_folder = kind == "FOLDER"
    parsed = parsed.filter(~is_folder | F.col("_folder").isNotNull())
    in_data = kind.isin("DATASET", "TABLE")
    parsed = parsed.select(
        F.when(is_folder, "").otherwise(F.coalesce("_project", F.lit(""))).alias("project_id"),
        F.when(in_data, F.coalesce("_dataset", F.lit(""))).otherwise("").alias("dataset_id"),
        F.when(is_folder, F.col("_folder")).when(in_data, F.col("_table")).alias("resource_id"),
        "resource_type",
        "bindings",
    )
    if projects:  # none named: no filter
        parsed = parsed.filter((kind == "FOLDER") | F.col("project_id").isin(list(projects)))
    return (
        parsed.select("*", F.explode("bindings").alias("_b"))
        .select("*", F.col("_b.role").alias("role"), F.explode("_b.members").alias("member"))
        .select(
            "project_id",
            "dataset_id",
            "resource_id",
            "resource_type",
            "role",
            "member",
            member_type("member").alias("member_type"),
            F.lit("IAM_POLICY").alias("source"),
            F.lit(None).cast("string").alias("inherited_from_group"),
        )
    )


def acl_flatten(acl: DataFrame) -> DataFrame:
    """Dataset ACL entries (project, dataset, role, entity_type, entity_id) in the same shape."""
    kind = F.coalesce("entity_type", F.lit("unknown"))
    return acl.select(
        F.col("project").alias("project_id"),
        F.col("dataset").alias("dataset_id"),
        F.lit(None).cast("string").alias("resource_id"),
        F.lit("DATASET").alias("resource_type"),
        F.coalesce(F.nullif("role", F.lit("")), F.lit("NONE")).alias("role"),
        acl_member(kind, "entity_id").alias("member"),
        acl_member_type(kind, "entity_id").alias("member_type"),
        F.lit("DATASET_ACL").alias("source"),
        F.lit(None).cast("string").alias("inherited_from_group"),
    )


def scan_union(*entries: DataFrame) -> DataFrame:
    out = entries[0]
    for more in entries[1:]:
        out = out.unionByName(more)
    return out


def scan_stats(entries: DataFrame) -> DataFrame:
    """Distinct projects, datasets and resources; an empty project or resource does not count."""

    place = ["project_id", "dataset_id", "resource_id"]
    # One row per place first: the distinct counts then run over far fewer rows.
    places = entries.groupBy(*place).agg(F.count("*").alias("_n"))

    def named(column: str, value: Column) -> Column:
        return F.when(F.col(column).isNotNull() & (F.col(column) != ""), value)

    return places.agg(
        F.count_distinct(named("project_id", F.col("project_id"))).alias("projects"),
        F.count_distinct(F.struct("project_id", "dataset_id")).alias("datasets"),
        F.count_if(F.col("resource_id").isNotNull() & (F.col("resource_id") != "")).alias("resources"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("entries"),
    )


def group_entries(entries: DataFrame, members: DataFrame, rows_per_task: int = BLOCK_PAIRS) -> DataFrame:
    """One more entry per member of every group entry, naming the group it came from.

    ``members`` holds (group_email, member_email); pass the closure for nested groups. The
    result holds the new entries; append it to the originals. A group with many members and many entries is cut
    on both sides, so that no task yields much more than ``rows_per_task``.
    """
    email = F.substring_index("member", ":", -1)
    groups = entries.filter(F.col("member_type") == "group").withColumn("group_email", email)
    kind = classify_email("member_email")
    # Read to be counted and to be joined, and a closure is costly to work out.
    named = settle(members.select("group_email", "member_email"), "members")
    joined = blocked_join(groups, named, ["group_email"], ["project_id", "dataset_id", "resource_id", "role"], ["member_email"], rows_per_task)
    return joined.select(
        "project_id",
        "dataset_id",
        "resource_id",
        "resource_type",
        "role",
        F.concat(kind, F.lit(":"), F.col("member_email")).alias("member"),
        kind.alias("member_type"),
        "source",
        F.col("group_email").alias("inherited_from_group"),
    )


def group_expand(entries: DataFrame, members: DataFrame) -> DataFrame:
    return entries.unionByName(group_entries(entries, members))


def with_scan(entries: DataFrame, **scan: str) -> DataFrame:
    """Entries with the scan's own facts repeated on every row, ready to export."""
    return entries.withColumns({f"scan_{k}": F.lit(v) for k, v in scan.items()})


def export(entries: DataFrame, path: str, kind: str = "json") -> None:
    """JSON lines or CSV with a header."""
    writer = entries.write.mode("overwrite")
    if kind == "json":
        writer.option("ignoreNullFields", "false").json(path)
    elif kind == "csv":
        writer.option("header", True).csv(path)
    else:
        raise ValueError(f"unknown export kind {kind!r}")
