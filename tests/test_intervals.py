import random

import pytest
from pyspark.sql import functions as F

from quillstream.operators.intervals import SHARD, continuous_periods, spans, to_ms


def brute(rows):
    """{entity: [(kind, begin, end, shared)]} by marking units one by one on a coarse scale."""
    by = {}
    for k, b, e in rows:
        by.setdefault(k, []).append((b, e))
    out = []
    for k, ls in by.items():
        ls.sort()
        periods = []
        for b, e in ls:
            if periods and b <= periods[-1][1]:
                p = periods[-1]
                p[2] |= b < p[1]
                p[1] = max(p[1], e)
            else:
                periods.append([b, e, False])
        out += [(k, "period", b, e, s) for b, e, s in periods]
        out += [(k, "gap", p[1], q[0], False) for p, q in zip(periods, periods[1:])]
    return sorted(out, key=str)


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "k string, b long, e long, shard string, m int")
    got = continuous_periods(df, ["k"]).collect()
    return sorted([(r.k, r.stretch_kind, r.begin_ms, r.end_ms, r.shared) for r in got], key=str)


@pytest.mark.parametrize("batch", [3, 10_000])
def test_against_brute_force(spark, batch):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        rnd = random.Random(batch)
        rows = []
        for k in ["a", "b", "c", None, "hot"]:
            for _ in range(300 if k == "hot" else 25):
                at = rnd.choice([0, SHARD - 20, SHARD, 3 * SHARD - 50, -SHARD]) + rnd.randrange(60)
                rows.append((k, at, at + rnd.choice([1, 2, 7, 15, 2 * SHARD + 3 if rnd.random() < 0.1 else 4])))
        rows += rows[:20]
        assert run(spark, rows) == brute(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_borders(spark):
    rows = [("touch", 0, SHARD), ("touch", SHARD, SHARD + 5), ("long", 5, 5 * SHARD), ("far", 0, 1), ("far", 9 * SHARD + 1, 9 * SHARD + 2), ("twice", 1, 2), ("twice", 1, 2)]
    assert run(spark, rows) == brute(rows)


def test_spans_of_any_length(spark):
    """Ends of 1e9 s and 1e12 s, over, under and beside short spans, on all levels of shards."""
    far, further = 10**12, 10**15
    rnd = random.Random(4)
    rows = [("one", 0, far), ("two", 5, further), ("two", 10, 20), ("two", further - 3, further + 9), ("all", -(2**63), 2**63 - 1), ("all", 7, 8)]
    rows += [("apart", 0, 7), ("apart", far, far + 5), ("apart", far + 9, far + 5 * SHARD), ("apart", further, further + SHARD**2 * 3)]
    rows += [(None, 0, 9 * SHARD), (None, 9 * SHARD, far), (None, 3 * SHARD, 3 * SHARD + 1), (None, further, further + 1)]
    units = [1, SHARD, SHARD**2, SHARD**3]
    for k in range(40):
        for _ in range(rnd.randrange(2, 14)):
            b = sum(rnd.randrange(-2, 4) * u for u in units[: rnd.randrange(2, 5)])
            rows.append((f"r{k}", b, b + 1 + rnd.randrange(3) + rnd.randrange(3) * rnd.choice(units)))
    assert run(spark, rows) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == []


def test_times(spark):
    x = [None, float("nan"), float("inf"), -float("inf"), 1e300, 0.0005, 1.2344, -0.0015, 1e12]
    df = spark.createDataFrame([(v,) for v in x], "s double").select(to_ms(F.col("s")).alias("t"))
    assert [r.t for r in df.collect()] == [None, None, None, None, None, 1, 1234, -1, 10**15]
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 1.0), (1.0, None), (1.0001, 1.0002)], "b double, e double")
    assert spans(df, [F.lit(1).alias("k")], "b", "e").count() == 1
