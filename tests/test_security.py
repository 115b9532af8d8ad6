import hashlib

import pytest
from pyspark.sql import functions as F

from lakeworks.operators import ranges as RG
from lakeworks.operators import security as S

ANALYST, ADMIN = "analyst@example.com", "admin@example.com"
SALES = [
    (1, "A010"), (2, "A015"), (3, "A020"), (4, "A050"), (5, "4077"), (6, "4079"), (7, "4080"),
    (8, "4085"), (9, "4086"), (10, "4090"), (11, "Z014"), (12, "Z015"), (13, "B100"), (14, "S200"),
]
RANGES = [(ANALYST, "store_code", "A010", "A020"), (ANALYST, "store_code", "4077", "4085")]
THIRD = (ANALYST, "store_code", "Z014", "Z015")
MAP_SCHEMA = "email string, column_name string, low_value string, high_value string"


@pytest.fixture(scope="module")
def sales(spark):
    return spark.createDataFrame(SALES, "txn_id long, store_code string")


def ids(df):
    return sorted(r["txn_id"] for r in df.collect())


def test_visible_rows(spark, sales):
    two = spark.createDataFrame(RANGES, MAP_SCHEMA)
    three = spark.createDataFrame([*RANGES, THIRD], MAP_SCHEMA)
    for rule in (S.range_listed, S.first_two_ranges):
        assert rule(sales, two, ADMIN, "store_code", admins=[ADMIN.upper()]).count() == 14
        assert rule(sales, two, ANALYST.upper(), "store_code").count() == 7
        assert rule(sales, two, "nobody@example.com", "store_code").count() == 0
    assert S.range_listed(sales, three, ANALYST, "store_code").count() == 9
    assert S.range_listed(sales, three, ANALYST, "store_code", keys=sales).count() == 9
    assert S.first_two_ranges(sales, three, ANALYST, "store_code").count() == 7
    listed = spark.createDataFrame([(ANALYST, "A010"), (ANALYST, "4079"), (ANALYST, "4079")], "email string, store_code string")
    assert ids(S.allow_listed(sales, listed, ANALYST, "store_code")) == [1, 6]
    assert S.visible_rows(sales).first()[0] == 14


def test_overlapping_ranges_do_not_repeat_rows(spark, sales):
    grants = spark.createDataFrame([*RANGES, (ANALYST, "store_code", "A000", "A016")], MAP_SCHEMA)
    assert ids(S.range_listed(sales, grants, ANALYST, "store_code")) == [1, 2, 3, 5, 6, 7, 8]


def test_range_cover(spark):
    keys = spark.range(500).select((F.col("id") * 3 % 500).alias("k"))
    spans = [(i * 7919 % 500, i * 7919 % 500 + i % 11 - 2) for i in range(60)] + [(10, 10), (10, 14)]
    ranges = spark.createDataFrame(spans, "low_value long, high_value long")
    got = sorted(r["k"] for r in RG.range_expand(keys, ranges, "k").collect())
    assert got == [k for k in range(500) if any(a <= k <= b for a, b in spans)]


EMPLOYEES = [
    ("E001", "Alice", "alice@x", "Sales", 75000.0, "123-45-6789", "987"),
    ("E002", "Bob", "bob@x", "Sales", 80000.0, "223-45-6789", "988"),
    ("E003", "Carol", "carol@x", "HR", 65000.0, "323-45-6789", "989"),
    ("E004", "Dan", "dan@x", "HR", 70000.0, "423-45-6789", "990"),
    ("E005", "Eve", "eve@x", "Finance", 90000.0, "523-45-6789", "991"),
    ("E006", "Frank", "frank@x", "Finance", 95000.0, "623-45-6789", "992"),
]
OPEN = ["employee_id", "name", "department"]
COLUMNS = {
    "email": S.ColumnPolicy(frozenset({"admin"}), {"sales": "DEFAULT_MASKING_VALUE"}),
    "salary": S.ColumnPolicy(frozenset({"admin"}), {"sales": "ALWAYS_NULL"}),
    "ssn": S.ColumnPolicy(frozenset({"admin"}), {"sales": "SHA256"}),
    "bank_account": S.ColumnPolicy(frozenset({"admin"})),
}


@pytest.fixture(scope="module")
def employees(spark):
    return spark.createDataFrame(
        EMPLOYEES, "employee_id string, name string, email string, department string, salary double, ssn string, bank_account string"
    )


def policies():
    return [S.RowPolicy("admin", F.lit(True)), S.RowPolicy("sales", F.col("department") == "Sales")]


def test_admin_sees_everything(employees):
    view = S.secure_view(employees, policies(), COLUMNS, ["admin"])
    assert sorted(tuple(r) for r in view.collect()) == EMPLOYEES


def test_sales_sees_masked_rows(employees):
    columns = [*OPEN, "email", "salary", "ssn"]
    rows = S.secure_view(employees, policies(), COLUMNS, ["sales"], columns).orderBy("employee_id").collect()
    assert [r["employee_id"] for r in rows] == ["E001", "E002"]
    assert {r["email"] for r in rows} == {""} and {r["salary"] for r in rows} == {None}
    assert rows[0]["ssn"] == hashlib.sha256(b"123-45-6789").hexdigest()
    with pytest.raises(S.AccessDenied):
        S.secure_view(employees, policies(), COLUMNS, ["sales"], ["bank_account"])


def test_a_raw_grant_wins_and_grants_add_up(employees):
    assert S.secure_view(employees, policies(), COLUMNS, ["sales", "admin"], ["email"]).count() == 6


def test_no_grant(employees):
    assert S.secure_view(employees, policies(), COLUMNS, ["guests"], OPEN).count() == 0
    with pytest.raises(S.AccessDenied):
        S.secure_view(employees, policies(), COLUMNS, ["guests"], ["email"])
