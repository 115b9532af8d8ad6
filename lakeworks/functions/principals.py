"""Principals, resource paths and query-text scoring."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import case_map, col

SERVICE_ACCOUNT_SUFFIX = ".iam.gserviceaccount.com"
SPECIAL_PRINCIPALS = ["allUsers", "allAuthenticatedUsers"]
# Dataset ACL entity types and the member type each one means (fixed values).
ENTITY_MEMBER_TYPE = {
    "userByEmail": "user",
    "groupByEmail": "group",
    "specialGroup": "specialGroup",
    "domain": "domain",
    "view": "authorizedView",
    "dataset": "authorizedDataset",
    "routine": "authorizedRoutine",
    "iamMember": "iamMember",
}


def member_type(member: Column | str) -> Column:
    """Prefix before the colon; special principals and bare names have their own type."""
    m = col(member)
    return (
        F.when(m.isin(SPECIAL_PRINCIPALS), F.lit("specialGroup"))
        .when(m.contains(":"), F.substring_index(m, ":", 1))
        .otherwise(F.lit("unknown"))
    )


def classify_email(email: Column | str) -> Column:
    return F.when(col(email).endswith(SERVICE_ACCOUNT_SUFFIX), F.lit("serviceAccount")).otherwise(F.lit("user"))


def path_part(resource: Column | str, segment: str) -> Column:
    """The path element that follows ``segment``, NULL when absent."""
    return F.nullif(F.regexp_extract(col(resource), f"(?:^|/){segment}/([^/]+)", 1), F.lit(""))


def acl_member_type(entity_type: Column | str, entity_id: Column | str) -> Column:
    et, eid = col(entity_type), col(entity_id)
    return F.when((et == "iamMember") & eid.contains(":"), F.substring_index(eid, ":", 1)).otherwise(
        case_map(et, ENTITY_MEMBER_TYPE, et)
    )


def acl_member(entity_type: Column | str, entity_id: Column | str) -> Column:
    """Typed member text of an ACL entry; an IAM member is already typed."""
    et, eid = col(entity_type), col(entity_id)
    plain = {"userByEmail": "user", "groupByEmail": "group"}
    return F.when(et == "iamMember", eid).otherwise(F.concat(case_map(et, plain, et), F.lit(":"), eid))


# Pattern name, regular expression, weight (fixed values).
SQL_PATTERNS = [
    ("where", r"(?i)\bWHERE\b", 1),
    ("case", r"(?i)\bCASE\b", 2),
    ("row_number", r"(?i)\bROW_NUMBER\s*\(", 3),
    ("join", r"(?i)\bJOIN\b", 4),
    ("window", r"(?i)\bOVER\s*\(", 4),
    ("aggregate", r"(?i)\b(?:SUM|AVG|COUNT|MIN|MAX)\s*\(", 5),
    ("pivot", r"(?i)\b(?:UNPIVOT|PIVOT)\b", 8),
]


def pattern_score(text: Column | str, patterns=SQL_PATTERNS) -> Column:
    """Sum of match counts times weights."""
    score = F.lit(0).cast("long")
    for _, regex, weight in patterns:
        score = score + F.regexp_count(col(text), F.lit(regex)).cast("long") * F.lit(weight)
    return score


def complexity(score: Column) -> Column:
    return F.when(score <= 10, F.lit("LOW")).when(score <= 25, F.lit("MEDIUM")).otherwise(F.lit("HIGH"))
