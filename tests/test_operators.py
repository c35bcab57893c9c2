import random

from pyspark.sql import functions as F

from quillstream.operators import diff as D
from quillstream.operators import graph as G
from quillstream.operators import joins as J
from quillstream.operators import mutations as M
from quillstream.operators import sequence as Q
from quillstream.operators import stats as S
from quillstream.plans import sequence_queries as P


def test_diff_rebuilds_both_texts():
    rnd = random.Random(2)
    for _ in range(500):
        a, b = ("".join(rnd.choice("ab c") for _ in range(rnd.randrange(15))) for _ in range(2))
        d = D.diff_texts(a, b)
        assert "".join(t for o, t in d if o <= 0) == a and "".join(t for o, t in d if o >= 0) == b
        assert all(x[0] != y[0] for x, y in zip(d, d[1:])) and all(t for _, t in d)
    assert D.diff_texts("", "") == [] and D.diff_texts("abc", "abc") == [(0, "abc")] and D.diff_texts("abxd", "abyd") == [(0, "ab"), (-1, "x"), (1, "y"), (0, "d")]


def test_diff_is_shortest_and_long_texts_are_whole(monkeypatch):
    rnd = random.Random(3)
    for _ in range(100):
        a, b = ("".join(rnd.choice("abc") for _ in range(rnd.randrange(9))) for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a) + 1):
            for j in range(len(b) + 1):
                best[i][j] = i + j if not i or not j else min(best[i - 1][j] + 1, best[i][j - 1] + 1, best[i - 1][j - 1] if a[i - 1] == b[j - 1] else 99)
        assert sum(len(t) for o, t in D.diff_texts(a, b) if o) == best[-1][-1]
    monkeypatch.setattr(D, "MAX_STEPS", 5)
    a, b = "x" * 50 + "abcdefghij" * 30, "y" * 40 + "bcdefghijk" * 30
    d = D.diff_texts(a, b)
    assert "".join(t for o, t in d if o <= 0) == a and "".join(t for o, t in d if o >= 0) == b


def test_diff_is_shortest_at_any_length(monkeypatch):
    rnd = random.Random(4)
    for _ in range(200):
        a, b = ("".join(rnd.choice("ab é🙂") for _ in range(rnd.randrange(60))) for _ in range(2))
        monkeypatch.setattr(D, "MAX_STEPS", 5)
        got = D.diff_texts(a, b)
        monkeypatch.setattr(D, "MAX_STEPS", 2_000)
        assert got == D.diff_texts(a, b)
    a, b = "abcd" * 600, "bdca" * 600
    row = list(range(len(b) + 1))  # edit distance without substitutions, a row at a time
    for i, x in enumerate(a, 1):
        old, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(old[j - 1] if x == y else min(old[j], row[-1]) + 1)
    want = D.diff_texts(a, b)
    assert sum(len(t) for o, t in want if o) == row[-1]
    monkeypatch.setattr(D, "MAX_STEPS", 5)
    assert D.diff_texts(a, b) == want


def test_scores_and_suppression(spark):
    rows = [(i, "the cat sat", "the kat sat") for i in range(4)] + [(9, "one two", "one three"), (10, "same", "same"), (11, None, "x"), (12, "abc", "abk")]
    p = spark.createDataFrame(rows, "k int, a string, b string").withColumn("d", D.diffs(F.col("a"), F.col("b")))
    got = {r.k: (r.i, r.r, r.s, r.h) for r in p.select("k", D.length_of(F.col("d"), 1).alias("i"), D.longest_run(F.col("d")).alias("r"), D.only_spaces(F.col("d")).alias("s"), D.rendered(F.col("d")).alias("h")).collect()}
    assert got[0] == (1, 2, False, "the <del>c</del><ins>k</ins>at sat") and got[10] == (0, 0, True, "same")
    words = spark.createDataFrame([("zz",)], "word string")
    kept = {r.k: [tuple(x) for x in r.kept] for r in D.suppress_systematic(p.filter("d is not null"), "k", "d", words, 4).collect()}
    assert kept[0] == [(0, "the "), (0, "c"), (0, "at sat")] and kept[12] == [(0, "ab"), (-1, "c"), (1, "k")][:1] + [(0, "c")]
    assert (-1, "wo") in kept[9] or any(o for o, _ in kept[9])
    assert [tuple(x) for x in D.suppress_systematic(p.filter("k = 0"), "k", "d", words, 4).first().kept] == [(0, "the "), (-1, "c"), (1, "k"), (0, "at sat")]


def test_tree(spark):
    rows = [("r", None, ""), ("a", "r", ""), ("b", "r", "B"), ("a1", "a", ""), ("a2", "a", "A2"), ("a11", "a1", ""), ("b1", "b", "B1"), ("lost", "nowhere", ""), ("q", None, "")]
    t = spark.createDataFrame(rows, "id string, parent_id string, tool string")
    got = {}
    for r in G.nearest_supported(t, "id", "parent_id", ["tool"]).collect():
        got.setdefault(r.node_id, []).append((r.found_id, r.distance))
    assert {k: sorted(v) for k, v in got.items()} == {"r": [("b", 1)], "a": [("a2", 1)], "b": [("b", 0)], "a1": [("a2", 2)], "a2": [("a2", 0)], "a11": [("a2", 3)], "b1": [("b1", 0)]}
    assert [r.id for r in G.orphans(t, "id", "parent_id").collect()] == ["lost"]


def test_gaps(spark):
    rows = [(1, 1, 1, 0.0, 1.0), (2, 1, 1, 1.5, 2.0), (3, 2, 1, 2.0, 3.0), (4, 3, 2, 5.0, 6.0)]
    u = spark.createDataFrame(rows, "c long, w long, l long, b double, e double").withColumns({"f": F.lit("x"), "total": F.lit(10.0)})
    g = Q.unit_gaps(u, ["f"], "c", "b", "e", "w", "l", "total")
    assert {r.c: (r.gap_class, r.silence) for r in g.collect()} == {1: (1, 0.5), 2: (2, 0.0), 3: (3, 2.0), 4: (4, 4.0)}
    assert Q.long_gaps(g, Q.gap_limits(g, {}, 4.0)).count() == 0  # classes of one have no limit


def test_long_silences_have_the_limits_of_the_reference(spark, monkeypatch):
    # One of n is 1, the others 0: it lies (n - 1) / sqrt(n) deviations above the mean.
    def found(sizes):
        rows = [(100 * c + i, c, float(i == 0)) for c, n in sizes.items() for i in range(n)]
        monkeypatch.setattr(P, "_char_gaps", lambda *_: spark.createDataFrame(rows, "char_id long, gap_class int, silence double"))
        return sorted(r.gap_class for r in P.long_silences(spark, "").collect())

    assert found({1: 18, 2: 17, 3: 41, 4: 11}) == [1, 3, 4]  # 4.01, 3.88, 6.2 and 3.02 deviations
    assert found({1: 17, 2: 18, 3: 13, 4: 10}) == [2]  # 3.88, 4.01, 3.33 and 2.85
    assert found({1: 1}) == []


def test_cascade(spark):
    # Lines 1: two words, 2 and 3: one word each, 4: two words.
    rows = [(1, 1, 5), (2, 1, 90), (3, 2, 10), (4, 3, 20), (5, 4, 7), (6, 4, 1)]
    w = spark.createDataFrame(rows, "word_id long, script_id long, s long").withColumn("k", F.lit(1))
    got = {r.word_id: r.raised for r in Q.cascade_gaps(w, ["k"], "word_id", "script_id", "s").collect()}
    assert got == {1: 5, 2: 90, 3: 90, 4: 90, 5: 90, 6: 1}
    assert {r.script_id: r.word_id for r in Q.widest_by_line(w, "script_id", "word_id", "s").collect()} == {1: 2, 2: 3, 3: 4, 4: 5}


def test_batches(spark):
    rnd = random.Random(1)
    rows = [("k" if rnd.random() < 0.7 else None, i, rnd.randrange(1, 60)) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, i long, s long")
    got = {(r.k, r.i): r.batch for r in Q.greedy_batches(df, ["k"], "s", ["i"], 5, 100).collect()}
    want = {}
    for k in ("k", None):
        batch, n = 1, 0
        for _, i, s in sorted((r for r in rows if r[0] == k), key=lambda r: (r[2], r[1])):
            if n and (n >= 5 or s * (n + 1) >= 100):
                batch, n = batch + 1, 0
            n += 1
            want[k, i] = batch
    assert got == want


def test_suffix_headings_slices(spark):
    df = spark.createDataFrame([(i, 1 + i // 3, "5") for i in range(6)] + [(100 + i, 9, "7") for i in range(28)], "i int, c int, v string").withColumn("b", F.lit("X"))
    names = [r.unique_name for r in Q.unique_suffix(df, ["b", "c"], "v", ["i"]).orderBy("i").collect()]
    assert names[:3] == ["5", "5a", "5b"] and names[-2:] == ["7z", None]
    h = [(r.kind, r.line_no) for r in Q.with_headings(df.filter("i < 6"), ["b"], "c", "i").orderBy("line_no").collect()]
    assert h == [("title", 1), ("line", 2), ("line", 3), ("line", 4), ("heading", 5), ("line", 6), ("line", 7), ("line", 8)]
    m = spark.createDataFrame([([[float(i)] for i in range(10)], 0.1, 0.35), ([[1.0]], 0.0, 0.0), ([[1.0]], 0.5, 0.2)], "m array<array<double>>, b double, e double")
    assert [len(r.x) for r in m.select(Q.frame_slice(F.col("m"), F.col("b"), F.col("e"), 20.0).alias("x")).collect()] == [5, 1, 0]


def test_stats(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (1, 2, 2, 3, 9, 14, 20)] + [("b", 1.0), ("c", None)], "k string, x double")
    m = {r.k: r for r in S.moments(df, ["k"], "x").collect()}
    assert round(m["a"].skew, 5) == 1.02621 and round(m["a"].kurt, 5) == -0.31978
    assert m["b"].stddev is None and m["b"].skew is None and m["c"].n == 0
    q = {(r.k, r.p): r.value for r in S.quantiles(df, ["k"], "x", [0.5, 0.99]).collect()}
    assert q == {("a", 0.5): 3.0, ("a", 0.99): 20.0, ("b", 0.5): 1.0, ("b", 0.99): 1.0}


def test_joins(spark):
    i = spark.createDataFrame([("k", x) for x in (1, 15, 16, 40, 99)], "k string, v int")
    g = spark.createDataFrame([("k", "g1", 1, 16), ("k", "g2", 16, 50), ("k", "bad", 9, 3), ("z", "g3", 0, 999)], "k string, g string, a int, b int")
    assert {(r.v, r.g) for r in J.members_in_range(i, g, ["k"], "v", "a", "b").collect()} == {(1, "g1"), (15, "g1"), (16, "g1"), (16, "g2"), (40, "g2")}


def test_mutations(spark):
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", None)], "k int, t string, x double")
    new = spark.createDataFrame([(2, "", 5.0), (3, "n", 6.0)], "k int, t string, x double")
    assert {tuple(r) for r in M.upsert(old, new, ["k"]).collect()} == {(1, "a", 1.0), (2, "", 5.0), (3, "n", 6.0)}
    assert {tuple(r) for r in M.keyed_update(old, new, ["k"], ["x"]).collect()} == {(1, "a", 1.0), (2, "b", 5.0)}
    assert {tuple(r) for r in M.overwrite_filled(old, new, ["k"], ["t"]).collect()} == {(1, "a", 1.0), (2, "b", None)}
    assert [r.k for r in M.unmatched(old, new, ["k"]).collect()] == [3]
    ids = [(r.k, r.t) for r in M.next_ids(spark.createDataFrame([("z",), ("y",), ("x",)], "t string"), old, "k", ["t"]).orderBy("k").collect()]
    assert ids == [(3, "x"), (4, "y"), (5, "z")]
    assert M.without(old, F.col("x") > 0).count() == 1


def test_lineage_of_any_depth_and_cycles(spark):
    chain = [(i, i - 1 if i else None) for i in range(75)]
    cycle = [(100, 101), (101, 102), (102, 100), (103, 102), (104, 104), (105, 999)]
    t = spark.createDataFrame(chain + cycle, "id int, parent_id int")
    got = {(r.node_id, r.ancestor_id): r.up for r in G.lineage(t, "id", "parent_id").collect()}
    want = {(i, j): i - j for i in range(75) for j in range(i + 1)}
    want |= {(a, b): (b - a) % 3 for a in (100, 101, 102) for b in (100, 101, 102)}
    want |= {(103, 103): 0, (103, 102): 1, (103, 100): 2, (103, 101): 3, (104, 104): 0, (105, 105): 0, (105, 999): 1}
    assert got == want
    assert G.lineage(t.limit(0), "id", "parent_id").count() == 0


def test_chosen_code(spark):
    tree = spark.createDataFrame([(1, None, "", "", ""), (2, 1, "aaa", "aa", ""), (3, 1, "bbb", "", "B"), (4, 2, "ccc", "", "C"), (5, None, "ddd", "", "")], "id int, parent_id int, iso639_3 string, iso639_1 string, whisper string")
    ask = spark.createDataFrame([("aa", None), ("aaa", " "), ("aaa", "Z"), ("bbb", ""), ("ddd", None), ("?", None), ("?", "Y"), (None, None)], "language_iso string, override string")
    got = {(r.language_iso, r.override): (r.code, r.found_by, r.status) for r in G.chosen_code(ask, tree, "id", "parent_id", "whisper").collect()}
    assert got == {("aa", None): ("C", "nearest", 200), ("aaa", " "): ("C", "nearest", 200), ("aaa", "Z"): ("Z", "override", 200), ("bbb", ""): ("B", "same", 200), ("ddd", None): (None, "none", 400), ("?", None): (None, "none", 400), ("?", "Y"): ("Y", "override", 200), (None, None): (None, "none", 400)}


def test_number_rows(spark):
    t = spark.range(1000).repartition(7).withColumn("k", F.col("id") % 13)
    got = M.number_rows(t, "n", ["k", "id"], after=5).orderBy("n").collect()
    assert [r.n for r in got] == list(range(6, 1006)) and [(r.k, r.id) for r in got] == sorted((r.k, r.id) for r in got)
    assert M.number_rows(t.limit(0), "n", ["k"]).count() == 0
