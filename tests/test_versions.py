from datetime import datetime as D

from quillstream.operators.versions import current_rows, key_history

SCHEMA = "k long, v double, t string, loaded_at timestamp, deleted_at timestamp, __key string"
A, B, C = D(2024, 1, 1), D(2024, 2, 1), D(2024, 3, 1)
ROWS = [
    (1, 1.0, "old", A, None, "x"), (1, 2.0, "new", B, None, "x"), (1, 2.0, "new", B, None, "x"),
    (2, 1.0, "a", B, None, "x"), (2, 1.0, "a", C, C, "x"),
    (3, None, None, A, None, None), (4, 5.0, "early", None, None, "x"), (4, 6.0, "known", A, None, "x"), (5, 7.0, "only", None, None, "x"), (None, 9.0, "none", A, None, "x"),
    (6, 3.0, "gone", A, A, "x"), (6, 4.0, "back", B, None, "x"),
]


def test_current(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = {r.k: (r.v, r.t) for r in current_rows(df, "k", ["v", "t"]).collect()}
    assert got == {1: (2.0, "new"), 3: (None, None), 4: (6.0, "known"), 5: (7.0, "only"), 6: (4.0, "back")}
    kept = {r.k: r.is_deleted for r in current_rows(df, "k", ["v"], keep_deleted=True).collect()}
    assert kept == {1: False, 2: True, 3: False, 4: False, 5: False, 6: False}
    assert current_rows(df.limit(0), "k", ["v", "t"]).count() == 0


def test_fixed_columns_hash_aggregate(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    plan = current_rows(df, "k", ["v"])._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan and plan.count("Exchange") == 1


def test_history(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = {r.key: (r.first_at, r.is_deleted) for r in key_history(df, "k").collect()}
    assert got[1] == (A, False) and got[2] == (B, True) and got[6] == (A, False) and None not in got
