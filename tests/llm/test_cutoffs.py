import random

import numpy as np
import pytest

from quillstream.llm import cutoffs as C


def brute(rows, shares):
    by = {}
    for t, d, s in rows:
        if s is not None and s == s and s > 0:
            by.setdefault((t, d), []).append(s)
    out = {}
    for k, xs in by.items():
        if shares.get(k) is None:
            continue
        xs.sort(reverse=True)
        n = min(max(-(-shares[k] * len(xs) // 1000), 1), len(xs))
        cut = xs[n - 1]
        out[k] = (len(xs), cut, sum(x >= cut for x in xs))
    return out


def run(spark, rows, shares, **sizes):
    s = spark.createDataFrame([(*r, 1, "x") for r in rows], "t string, d long, score double, sid int, permille string")
    p = spark.createDataFrame([(t, d, m, 1.0) for (t, d), m in shares.items()], "t string, d long, permille int, score double")
    out = C.fraction_cutoffs(s.repartition(5), p, ["t", "d"], **sizes).collect()
    return {(r.t, r.d): (r.n_counted, r.cutoff, r.n_kept) for r in out}


@pytest.mark.parametrize("sort_rows,run_values", [(7, 3), (50, 8), (C.SORT_ROWS, C.RUN_VALUES)])
def test_against_brute_force(spark, sort_rows, run_values):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", sort_rows)
    rnd = random.Random(4)
    rows, shares = [], {}
    for d in range(12):
        t = "ab"[d % 2]
        grid = rnd.choice([1, 2, 10, 100_000])
        rows += [(t, d, rnd.randrange(grid + 1) / grid) for _ in range(rnd.choice([1, 5, 200]))]
        shares[t, d] = rnd.choice([0, 1, 500, 950, 1000, 1200])
    rows += [("a", 0, x) for x in (None, float("nan"), -1.0, float("inf"))]
    rows += [("hot", 1, rnd.random()) for _ in range(1500)] + [("hot", 1, 0.5)] * 300
    rows += [(None, None, 0.25), (None, None, 0.75), ("none", 7, 0.5), ("null", 8, 0.5), ("zero", 9, 0.0)]
    shares |= {("hot", 1): 430, (None, None): 500, ("null", 8): None, ("zero", 9): 500, ("absent", 1): 500}
    try:
        assert run(spark, rows, shares, sort_rows=sort_rows, run_values=run_values, many=sort_rows) == brute(rows, shares)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_report_of_a_run():
    v, c = np.array([0.1, 0.2, 0.4, 0.8, 0.9]), np.cumsum([2, 1, 5, 1, 3])
    n, eq, med = C._report(v, c, 0.1, float("nan"), np.array([0.3, 0.4, 0.85]))
    assert n.tolist() == [1, 0, 1, 3] and eq.tolist() == [0, 5, 0]
    assert (med[0] == 0.2).all() and (med[2] == 0.8).all() and (med[3] == 0.9).all()
    assert C._report(v, c, 0.9, float("nan"), np.zeros(0)) is None
    whole = C._report(v, c, float("nan"), float("nan"), np.zeros(0))
    each = np.repeat(v, [2, 1, 5, 1, 3])
    assert whole[0].tolist() == [12] and whole[2][0].tolist() == [each[-(-12 * k // (C.PIVOTS + 1)) - 1] for k in range(1, C.PIVOTS + 1)]


def test_empty(spark):
    assert run(spark, [], {("a", 1): 5}) == {} and run(spark, [("a", 1, 0.5)], {}) == {}
