import io
import zipfile

import pytest
from pyspark.sql import functions as F

from quillstream.functions import normalise as N
from quillstream.functions import text as X
from quillstream.functions.unicode import spoken
from quillstream.operators import mutations as M
from quillstream.operators import sequence as Q
from quillstream.operators import stats as S
from quillstream.operators.diff import diff_texts
from quillstream.operators.splice import cleaned, splice, spliced
from quillstream.plans.pipeline import Store
from quillstream.sinks import writers as K
from quillstream.sinks.xlsx import workbook
from quillstream.sources import files as L
from quillstream.sources import readers as R


def test_small_equal_parts_are_taken_in():
    assert cleaned([(-1, "abc"), (0, "x"), (1, "def")]) == [(-1, "abcx"), (1, "xdef")]
    assert cleaned([(-1, "a"), (0, "xyz"), (1, "d")]) == [(-1, "a"), (0, "xyz"), (1, "d")]
    assert cleaned([(0, "x"), (1, "def")]) == [(0, "x"), (1, "def")] and cleaned([]) == []
    # Taking one in makes the next small enough.
    assert cleaned([(-1, "ab"), (0, "x"), (-1, "cd"), (0, "yyyy"), (1, "efgh")]) == [(-1, "abxcdyyyy"), (1, "xyyyyefgh")]
    for a, b in (("the cat sat", "a dog sits"), ("", "x"), ("same", "same"), ("ab", "")):
        d = cleaned(diff_texts(a, b))
        assert "".join(t for o, t in d if o <= 0) == a and "".join(t for o, t in d if o >= 0) == b


def test_splice(spark):
    assert splice("abcd", [1], "ab12cd") == [(0, "a", False), (1, "b", False), (1, "1", True), (1, "2", True), (2, "c", False), (3, "d", False)]
    assert splice("abcd", [0], "ab12cd") == [(i, c, False) for i, c in enumerate("abcd")]  # heard elsewhere
    assert [c for _, c, h in splice(" ab ", [2], "ab!") if h] == ["!"]
    assert splice("", [0], "x") == [] and splice("ab", [7], "axb") == [(0, "a", False), (1, "b", False)]
    df = spark.createDataFrame([(["a", "b"], [0], "a1b"), (["a"], [], "x"), (["a"], [0], None), (None, [0], "x")], "c array<string>, s array<int>, h string")
    got = df.select(spliced(F.col("c"), F.col("s"), F.col("h")).alias("x")).collect()
    assert ["".join(p.ch for p in r.x) if r.x is not None else None for r in got] == ["a1b", "a", "a", None]


def test_large_numbers():
    assert spoken(10**12) == "one trillion" and spoken(2**63 - 1).startswith("nine quintillion two hundred twenty-three quadrillion")


def test_listings(spark, tmp_path):
    for name in ("a/B01___03_XXXN1DA.mp3", "a/A01___01_XXXO1DA.mp3", "a/.hidden", "b/x.usx", "b/note.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(name)
    files = L.object_listing(spark, f"file://{tmp_path}")
    assert {r.file_name: (r.media_type, r.testament, r.chapter) for r in L.input_files(files, ["NT"]).collect()} == {"B01___03_XXXN1DA.mp3": ("audio", "NT", 3), "x.usx": ("text_usx", None, None), "note.txt": ("unknown", None, None)}
    assert L.object_listing(spark, f"file://{tmp_path}", "*.usx").first().length == len("b/x.usx")
    assert L.split_pattern("s3://bk/p/q/*1.mp3") == ("bk", "p/q/", r".1\.mp3$") and L.split_pattern("s3:/bk/p/q") == ("bk", "p/q", None)
    df = spark.createDataFrame([("s3://bk/p/q/x1.mp3", 1, 5), ("s3://bk/p/q/x1.mp3x", 2, 3), ("s3://bk/p/q/1.mp3", 3, 3), ("s3://other/p/q/x1.mp3", 4, 1)], "path string, length long, modified long")
    assert [r.length for r in L.matching(df, "s3://bk/p/q/*1.mp3").collect()] == [1]
    assert L.oldest(df).collect()[0].length == 4 and L.oldest(df.limit(0)).count() == 0
    assert df.select(L.owner_ids(F.col("path"))["media_id"].alias("m")).first().m == "q"


def test_workbook_round_trip(spark):
    made = workbook([["Book", "Chapter", "Verse", "Target Language"], ["KAR", "1", "2", "a & <b> \n c"], [None, None, None, None], ["KAR", "1", None, [("red", "FF0000"), (" plain", "")]]])
    df = spark.createDataFrame([("w", bytearray(made))], "path string, content binary")
    assert [(r.verse_str, r.script_text) for r in R.workbook_lines(df).collect()] == [("2", "a & <b> \n c"), ("", "red plain")]
    assert zipfile.ZipFile(io.BytesIO(made)).testzip() is None


def test_pairs_and_positions(spark):
    df = spark.createDataFrame([('[{"base":{"script_id":0},"comp":{"script_id":7,"book_id":"B","chapter_num":2,"text":"x"},"n":3},{"base":{"script_id":5,"book_id":"A","chapter_num":1}}]',), ("bad",), (None,)], "json string")
    rows = {(r.script_id, r.book_id, r.chapter_num, r.base_text, r.comp_text) for r in R.pair_list(df).collect()}
    assert rows == {(7, "B", 2, "", "x"), (5, "A", 1, "", "")} and R.pair_list(df, "B", 2).count() == 1 and R.pair_list(df, "B", 3).count() == 0
    t = spark.createDataFrame([(0, "h|x"), (1, "a|b|c"), (2, ""), (3, None)], "pos int, value string")
    assert [(r.x, r.z) for r in R.by_position(t, ["x", None, "z"], "|", header=True).orderBy("pos").collect()] == [("a", "c"), ("", ""), ("", "")]


def test_small_functions(spark):
    d = spark.createDataFrame([("{1} a {2-3} {4}_{5}",), ("{1 a",), ("}{x} {2}}",), (None,)], "t string")
    assert [r.w for r in d.select(X.marker_errors(F.col("t")).alias("w")).collect()] == ["", "{", "}{}}", None]
    v = spark.createDataFrame([([1.0],), ([float("inf")],), ([-float("inf"), float("nan")],), ([],), (None,), ([None],)], "v array<double>")
    assert [r.u for r in v.select(N.unfit(F.col("v")).alias("u")).collect()] == ["", "infinite", "nan", "empty", "empty", "nan"]
    m = spark.createDataFrame([([[1.5, 2.0], []],), (None,)], "m array<array<double>>").select(N.matrix_of(N.matrix_json(F.col("m"))).alias("m")).collect()
    assert [r.m for r in m] == [[[1.5, 2.0], []], None]
    h = spark.createDataFrame([([("a<", "critical"), ("b", ""), ("c", "heard")],), ([],)], "p array<struct<text:string, kind:string>>").select(K.highlighted(F.col("p")).alias("h")).collect()
    assert [r.h for r in h] == ["<span class=critical>a&lt;</span>b<span class=heard>c</span>", ""]
    s = spark.range(1).select(K.status_csv(F.lit(400), F.lit('a "b"'), F.lit(None).cast("string")).alias("s")).first().s
    assert s == '400,"a ""b""",""'


def test_batches_and_references(spark):
    df = spark.createDataFrame([(1, [1.0], [5]), (1, [1.0, 2.0, 3.0], []), (2, [], [7, 8])], "b int, v array<double>, l array<int>")
    rows = sorted((r.b, r.v, r["mask"], r.l) for r in Q.padded_batches(df, ["b"], "v", "l").collect())
    assert rows == [(1, [1.0, 0.0, 0.0], [1, 0, 0], [5]), (1, [1.0, 2.0, 3.0], [1, 1, 1], [-100]), (2, [], [], [7, 8])]
    s = spark.createDataFrame([(1, 10, "b", "K 1:2.2"), (1, 11, "a", "K 1:2.1"), (2, 12, "c", "K 1:10.1"), (3, 13, "d", "K 11:1.1"), (4, 14, "e", "bad")], "script_id long, word_id long, word string, reference string")
    assert {(r.verse_str, r.script_id, tuple(r.words)) for r in Q.referenced_verses(s, "reference", F.lit("K 1:"), []).collect()} == {("2", 1, ("a", "b")), ("10", 2, ("c",))}


def test_changes(spark):
    rows = spark.createDataFrame([("1-2", "3", ["a", "b."]), ("4", "00003", ["(", "x"]), ("5", "7r", [None, ""])], "verse_str string, script_num string, texts array<string>")
    got = [(r.verse_str, r.verse_end, r.verse_num, r.script_num, r.script_text, r.is_duplicate) for r in M.prepared_lines(rows, ["script_num"]).orderBy("verse_str").collect()]
    assert got == [("1", "2", 1, "00003", "a b.", True), ("4", "4", 4, "00003", "(x", True), ("5", "5", 5, "00007r", "", False)]
    out = M.erased({"scripts": spark.createDataFrame([(1, "x")], "script_id long, script_text string"), "words": spark.range(3)})
    assert out["scripts"].first().script_text == "" and out["words"].count() == 0


def test_quantiles_of_any_shape(spark):
    rows = [("a", float(i % 17)) for i in range(500)] + [(None, 2.0)] * 3 + [("b", 1.0), ("b", None)]
    df = spark.createDataFrame(rows, "k string, x double")
    got = {(r.k, r.p): r.value for r in S.quantiles(df, ["k"], "x", [0.1, 0.5, 1.0]).collect()}
    a = sorted(float(i % 17) for i in range(500))
    assert got == {("a", 0.1): a[49], ("a", 0.5): a[249], ("a", 1.0): 16.0} | {(k, p): v for k, v in ((None, 2.0), ("b", 1.0)) for p in (0.1, 0.5, 1.0)}
    assert S.quantiles(df.limit(0), ["k"], "x").count() == 0


def test_interrupted_replacement(spark, tmp_path):
    """Whatever step of a replacement was the last, a version is there afterwards."""
    s = Store(spark, f"file://{tmp_path}", "u", "d")
    s.write("books", spark.createDataFrame([(1, "A", "OT", 1)], "seq int, book_id string, testament string, chapters int"))
    (tmp_path / "u/d/books").rename(tmp_path / "u/d/_old_books")
    assert s.read("books").first().book_id == "A"
    s.write("books", spark.createDataFrame([(1, "B", "OT", 1)], "seq int, book_id string, testament string, chapters int"))
    assert s.read("books").first().book_id == "B" and not s.exists("_old_books")


def test_outputs(spark, tmp_path):
    o = K.Outputs()
    o.add_json(spark.range(2), f"{tmp_path}/x.json")
    o.add("y.csv")
    assert o.by_ending(".csv") == ["y.csv"] and sorted(r.value for r in spark.read.text(f"{tmp_path}/x.json").collect()) == ['{"id":0}', '{"id":1}']


def test_manifest_without_counterpart(spark):
    m = spark.createDataFrame([("a", '{"text": "x"}\n{"text": "y"}\n')], "manifest string, value string")
    rows = R.manifest_lines(m, spark.createDataFrame([(1, "a"), (2, "b")], "script_id long, manifest string"), "script_id").collect()
    assert sorted((r.manifest, r.pos, r.matched) for r in rows) == [("a", 1, True), ("a", 2, False), ("b", 1, False)]


@pytest.mark.parametrize("text,want", [("", []), ("no marks", [("", 1, "0", "no marks")]), ("\\v 1 x", [("", 1, "1", "x")])])
def test_usfm_without_a_book(text, want):
    assert [r[:3] + r[5:] for r in R.usfm_rows(text)] == want


@pytest.mark.parametrize("shard", [7, 16, 1 << 16])
def test_greedy_batches(spark, shard):
    """Batches one after the other, with keys and batches that reach over shards, one key with most rows, NULL keys and sizes."""
    import random

    rnd = random.Random(shard)
    rows = [("hot", rnd.choice([0, 3, 9, 40]), i) for i in range(150)] + [(k, rnd.randrange(60) if i % 9 else None, i) for k in (None, "b", "c", "d") for i in range(rnd.randrange(1, 22))]
    df = spark.createDataFrame(rows, "k string, ms long, id long")
    got = {(r.k, r.id): r.batch for r in Q.greedy_batches(df, ["k"], "ms", ["id"], 5, 120, shard).collect()}
    want = {}
    for k in {r[0] for r in rows}:
        batch, n = 1, 0
        for s, i in sorted((s or 0, i) for key, s, i in rows if key == k):
            if n and (n >= 5 or s * (n + 1) >= 120):
                batch, n = batch + 1, 0
            n += 1
            want[k, i] = batch
    assert got == want
    assert Q.greedy_batches(df.limit(0), ["k"], "ms", ["id"], 5, 120).count() == 0


def test_programs(spark):
    import sys

    from quillstream.operators.program import answered_batches, answered_lines

    df = spark.createDataFrame([(1, "a\nb"), (2, None), (3, "")], "id int, t string").coalesce(1)
    echo = [sys.executable, "-uc", "import sys\nfor x in sys.stdin: print('<' + x.rstrip() + '>', flush=True)"]
    for how in (answered_lines, answered_batches):
        assert [(r.id, r.answer) for r in how(df, "t", echo).orderBy("id").collect()] == [(1, "<a b>"), (2, None), (3, "<>")]
        assert how(df.limit(0), "t", echo).count() == 0
        with pytest.raises(Exception, match="no model here"):
            how(df, "t", [sys.executable, "-c", "import sys; sys.stderr.write('no model here'); sys.exit(3)"]).collect()


def test_word_patterns(spark):
    from quillstream.operators import diff as D

    df = spark.createDataFrame([(1, "the cat sat", "the cut  sat"), (2, "same", "same"), (3, None, "x")], "id int, a string, b string").withColumn("d", D.diffs(F.col("a"), F.col("b")))
    got = {(r.id, r.pattern) for r in D.word_patterns(df, "id", "d").collect()}
    assert len(got) == 1 and got.pop()[1].startswith("=c-a+u=t")


def test_refused_names(spark):
    df = spark.createDataFrame([(1, "v", i) for i in range(30)] + [(2, "v", i) for i in range(27)], "k int, n string, i int")
    named = Q.unique_suffix(df, ["k"], "n", ["i"])
    assert [tuple(r) for r in Q.refused_names(named, ["k"], "n").collect()] == [(1, "v", 3)]
    assert named.filter("k = 2 and i = 26").first().unique_name == "vz"


def test_language_search(spark, tmp_path, capsys):
    from quillstream.operators.graph import main

    spark.createDataFrame([("1", None, "", "", ""), ("2", "1", "aaa", "aa", ""), ("3", "1", "bbb", "", "B")], "id string, parent_id string, iso639_3 string, iso639_1 string, whisper string").write.parquet(f"{tmp_path}/t")
    assert main([f"{tmp_path}/t", "whisper", "bbb", "aa", "zz"]) == 4
    assert capsys.readouterr().out.split("\n")[:3] == ["bbb B same", "aa B nearest", "zz - none"]
