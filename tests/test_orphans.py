from datetime import datetime as D

from quillstream.operators import orphans as O
from quillstream.operators.versions import key_history

A, B, C = D(2024, 1, 5), D(2024, 2, 1), D(2024, 3, 1)
P = "id long, loaded_at timestamp, deleted_at timestamp, pointer string"
R = "c long, p long, loaded_at timestamp, deleted_at timestamp, salt int, parent_key string"


def find(spark, parents, children, hot_rows=None):
    df = spark.createDataFrame([(*c, None, 1, "x") for c in children], R)
    refs = O.references(df, "child", "c", "p")
    out = O.find_orphans(refs, key_history(spark.createDataFrame([(*p, "x") for p in parents], P), "id"))
    return {r.child_key: (r.pointer, r.load_month, r.orphan_kind) for r in out.collect()}, out


PARENTS = [(1, A, None), (2, A, None), (2, B, B), (3, C, None), (3, C, None), (4, A, A), (4, B, None), (None, A, None)]
CHILDREN = [(10, 1, B), (11, 2, C), (12, 3, B), (13, 3, C), (14, 4, B), (15, 9, A), (16, None, A), (17, 9, A), (17, 1, B), (18, 1, A), (18, 9, B), (19, 0, None), (19, 0, None), (None, 9, A), (20, 3, A), (20, 3, C)]
WANT = {11: (2, "2024-03", "deleted"), 12: (3, "2024-02", "late"), 15: (9, "2024-01", "missing"), 18: (9, "2024-01", "missing"), 19: (0, None, "missing"), 20: (3, "2024-01", "late")}


def test_kinds(spark):
    got, out = find(spark, PARENTS, CHILDREN)
    assert got == WANT
    report = {(r.load_month, r.orphan_kind): (r.n_orphans, r.n_targets) for r in O.orphan_report(out).collect()}
    assert report[("2024-01", "missing")] == (2, 1)


def test_hot_pointer_is_salted(spark, monkeypatch):
    monkeypatch.setattr(O, "HOT_ROWS", 3)
    many = CHILDREN + [(i, 9, A) for i in range(100, 140)] + [(i, 3, B) for i in range(200, 230)] + [(i, 1, B) for i in range(300, 330)]
    got, out = find(spark, PARENTS, many)
    assert got == WANT | {i: (9, "2024-01", "missing") for i in range(100, 140)} | {i: (3, "2024-02", "late") for i in range(200, 230)}
    assert "SortMergeJoin" in out._jdf.queryExecution().executedPlan().toString()


def test_every_hot_pointer_is_salted(spark, monkeypatch):
    """More hot keys than the share allows at once: the share grows with the references, none is left whole."""
    monkeypatch.setattr(O, "HOT_ROWS", 2)
    monkeypatch.setattr(O, "HOT_KEYS", 10)
    many = [(1000 * k + i, 500 + k, A) for k in range(30) for i in range(7 + 40 * (k < 3))]
    got, _ = find(spark, [(500, A, A), (501, C, None)], many)
    assert got == {c: (p, "2024-01", "deleted" if p == 500 else "late" if p == 501 else "missing") for c, p, _ in many}


def test_empty(spark):
    assert find(spark, [], [])[0] == {}
    assert find(spark, PARENTS, [])[0] == {}
    assert find(spark, [], [(1, 5, A)])[0] == {1: (5, "2024-01", "missing")}
