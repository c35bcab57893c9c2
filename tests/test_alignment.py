import math
from datetime import datetime as D

from pyspark.sql import functions as F

from quillstream.functions import normalise as N
from quillstream.operators import alignment as A
from quillstream.operators.embed import word_vectors


def test_spans():
    assert A.collapse([1, 1, 0, 2]) == [(1, 0, 2), (0, 2, 3), (2, 3, 4)] and A.collapse([]) == []
    assert A.padded([0, 0, 1, 0, 0, 0, 2, 2, 0]) == [(1, 0, 5), (2, 5, 9)]
    assert A.padded([1, 2, 2, 1]) == [(1, 0, 1), (2, 1, 3), (1, 3, 4)] and A.padded([0, 0]) == []


def test_letters():
    got = A.align_letters([("c", 0.1), ("a", 0.2), (" ", 0.3), ("x", 0.4)], [(5, "c"), (6, "a"), (7, "t")])
    assert got[:2] == [(5, "c", 0.1, "same"), (6, "a", 0.2, "same")]
    assert (7, "t", None, "text") in got and (7, "x", 0.4, "audio") in got and len(got) == 4
    assert A.align_letters([], []) == [] and A.align_letters([("a", 1.0)], []) == [(None, "a", 1.0, "audio")]


def frames(path, n=4, sure=0.9):
    low = math.log((1 - sure) / (n - 1))
    return [[math.log(sure) if t == x else low for t in range(n)] for x in path]


def test_search():
    assert A.guided_search(frames([0, 1, 1, 0, 2, 0, 2, 3]), [1, 2, 2, 3]) == [1, 2, 2, 3]
    assert A.guided_search(frames([1, 0, 3]), [1, 2, 3]) == [1, 3]
    assert A.guided_search(frames([1, 0, 2, 0, 3], sure=0.999), [1, 3]) == [1, 2, 3]
    assert A.guided_search([], [1]) == []


def test_columns(spark):
    df = spark.createDataFrame([([0, 1, 1], 65.0, ["ab", "c"], [0.1, 0.9, 0.5]), (None, 0.0, ["x"], [])], "p array<int>, d double, w array<string>, g array<double>")
    r = df.select(A.token_spans(F.col("p")).alias("s"), A.audio_windows(F.col("d")).alias("w"), A.with_word_spaces(F.col("w")).alias("l"), A.long_gap_places(F.col("g"), 0.4).alias("g")).collect()
    assert [tuple(x) for x in r[0].s] == [(1, 0, 3)] and r[1].s is None and r[1].w is None
    assert [tuple(x) for x in r[0].w] == [(0.0, 30.0), (27.0, 60.0), (57.0, 65.0)]
    assert r[0].l == ["a", "b", " ", "c"] and r[0].g == [1, 2] and r[1].g == []
    h = spark.createDataFrame([(frames([1, 0, 2]), [1, 2]), (None, [1])], "f array<array<double>>, t array<int>").select(A.heard_tokens(F.col("f"), F.col("t")).alias("h")).collect()
    assert [x.h for x in h] == [[1, 2], None]


def test_normalise_and_small(spark):
    df = spark.createDataFrame([("Ｈello, (v. 3) 12 Wörld— ё", "x", '{"status": 400, "message": "m", "trace": "t"}', [1.0, 2.0]), (None, "y", "plain", [])], "t string, l string, j string, v array<double>")
    r = df.select(
        N.normalised(F.col("t")).alias("a"), N.normalised_by(F.col("t"), F.col("l"), {"x": {"strip_marks": True, "drop_numbers": False, "delete": "h"}}).alias("b"), N.error_lines(F.col("j"))["status"].alias("s"),
        N.padded_vector(F.col("v"), 3).alias("p"), N.attention_mask(F.col("v"), 3).alias("m"), N.yaml_scalar(F.lit('a: 1\nname: "x y" # c'), "name").alias("y"), N.sample_bytes(F.lit(0.5)).alias("n"),
        N.joined_letters(F.array(F.struct(F.lit("q").alias("ch")))).alias("q"),
    ).collect()
    assert r[0].a == "hello wörld ё" and r[0].b == "ello 12 world е" and r[1].a is None
    assert (r[0].s, r[1].s) == (400, None) and r[0].p == [1.0, 2.0, 0.0] and r[0].m == [1, 1, 0] and r[1].m == [0, 0, 0]
    assert r[0].y == "x y" and r[0].n == 32000 and r[0].q == "q"
    assert N.runtime_budget(["timestamps"]) == 60 and N.runtime_budget([], queued=True) == 3
    e = spark.createDataFrame([(D(2024, 1, 1),), (D(2024, 1, 9),)], "m timestamp")
    assert N.expired(e, "m", F.lit("2024-01-10").cast("timestamp")).count() == 1
    f = N.folders(spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x")], "f string, c string"), "f", "c")
    assert {(x.f, x.n_files, x.mixed) for x in f.collect()} == {("a", 2, True), ("b", 1, False)}


def test_word_vectors(spark):
    rows = [(i, k, w) for i in range(20) for k, w in enumerate("the cat sat on the mat".split())] + [(99, 0, "once"), (None, 0, "x")]
    v = word_vectors(spark.createDataFrame(rows, "script_id long, word_seq int, word string"), size=4)
    got = {r.word: len(r.vector) for r in v.collect()}
    assert got == {w: 4 for w in "the cat sat on mat".split()}
