import io
import json
import zipfile
from html import escape

import pytest
from pyspark.sql import functions as F

from quillstream.model import SCHEMAS, duplicate_keys, empty
from quillstream.plans import source_queries as S
from quillstream.sinks import writers as K
from quillstream.sources import readers as R

USFM = "\\id KAR extra words\n\\h Head\n\\mt1 The Title\n\\c 1\n\\s part\n\\p\n\\v 1 One \\f + \\ft note\\f* two \\wj three\\wj*.\n\\v 2-3 Four {x}\n\\c 2\n\\p\n\\v 1 Seven"
USX = '<usx version="3.0"><book code="KAR" style="id">x</book><para style="h">Head</para><para style="mt1">The Title</para><chapter number="1" style="c"/><para style="s">part</para><para style="p"><verse number="1" style="v"/>One <note style="f" caller="+"><char style="ft">note</char></note>two <char style="wj">three</char>.<verse eid="KAR 1:1"/><verse number="2-3" style="v"/>Four {x}</para><chapter number="2" style="c"/><para style="p"><verse number="1" style="v"/>Seven</para></usx>'
WANT = [("KAR", 1, "0", "para.h", "Head"), ("KAR", 1, "0", "para.mt1", "The Title"), ("KAR", 1, "1", "para.p", "One two three."), ("KAR", 1, "2-3", "para.p", "Four (x)"), ("KAR", 2, "1", "para.p", "Seven")]


def xlsx(rows):
    cell = lambda r, c, v: f'<c r="{chr(65 + c)}{r}" t="inlineStr"><is><t>{escape(v)}</t></is></c>' if v is not None else ""
    body = "".join(f'<row r="{i}">{"".join(cell(i, c, v) for c, v in enumerate(row))}</row>' for i, row in enumerate(rows, 1))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


def rows(df):
    return [(r.book_id, r.chapter_num, r.verse_str, r.script_text) for r in df.collect()]


def test_markup_formats_agree(spark, tmp_path):
    (tmp_path / "a.usfm").write_text(USFM)
    (tmp_path / "a.usx").write_text(USX)
    with zipfile.ZipFile(tmp_path / "all.zip", "w") as z:
        z.writestr("in/a.usx", USX)
        z.writestr("in/.hidden", "x")
    pick = lambda df: [(r.book_id, r.chapter_num, r.verse_str, r.usfm_style, r.script_text) for r in df.orderBy("path", "pos").collect()]
    # In the first chapter titles come before the chapter mark in this source.
    usfm, usx = pick(R.read_usfm(spark, str(tmp_path), "*.usfm")), pick(R.read_usx(spark, str(tmp_path), "*.usx"))
    assert usfm == usx == WANT
    assert pick(R.read_usx(spark, str(tmp_path), "*.zip")) == WANT
    assert R.read_usx(spark, str(tmp_path), "*.none").count() == 0


def test_styles(spark):
    """Introductions, section headings, notes and unknown styles are left out; titles are rows of their own; chapters follow each other."""
    text = "\\id KAR\n\\h Head\n\\mt1 A\n\\mt2 B\n\\imt In\n\\ip Long \\bk intro\\bk* text\nmore\n\\c 1\n\\s1 Part\n\\r (x)\n\\q1\n\\v 1 One \\add two\\add* \\nd Three\\nd*\n\\d left out\n\\q2 four\n\\v 2 \\x - \\xo 1\\x*five \\zz no\\zz* six\n\\c 2\n\\sp Who\n\\p\n\\v 1 seven\\f + \\ft a \\+wj b\\+wj* c\\f*.\n\\tr \\th1 eight \\tcr2 nine"
    got = [(c, v, s, t) for _, c, v, _, s, t in R.usfm_rows(text)]
    assert got == [(1, "0", "para.h", "Head"), (1, "0", "para.mt1", "A"), (1, "0", "para.mt2", "B"), (1, "1", "para.q2", "One Three four"), (1, "2", "para.q2", "five six"), (2, "1", "para.tr", "seven. eight nine")]
    usx = '<usx><book code="KAR" style="id"/><para style="ip">Long <char style="bk">x</char></para><chapter number="1" style="c"/><para style="s1">Part</para><para style="q1"><verse number="1" style="v"/>One <char style="add">two</char> <char style="nd">Three</char></para><para style="d">no</para><para style="q2">four</para><chapter number="2" style="c"/><para style="ms">no</para><para style="p"><verse number="1" style="v"/>seven<note style="ef">x</note>.</para><table><row style="tr"><cell style="th1">eight</cell></row></table></usx>'
    assert [(c, v, t) for _, c, v, _, _, t in R.usx_rows(usx.encode())] == [(1, "1", "One Three four"), (2, "1", "seven. eight")]
    assert spark.createDataFrame([(text,), (None,)], "t string").select(R.unknown_styles(F.col("t")).alias("u")).collect()[0].u == ["ft", "xo", "zz"]


def test_names_and_codes(spark):
    names = spark.createDataFrame([("Song of Songs", "SNG"), ("San_Mateo", "MAT"), ("two", "B"), ("TWO", "A")], "book_name string, book_id string")
    rows = spark.createDataFrame([("SongofSongs",), ("san mateo",), ("Two",), ("?",), (None,)], "book_name string")
    assert {r.book_name: r.book_id for r in R.named_books(rows, names).collect()} == {"SongofSongs": "SNG", "san mateo": "MAT", "Two": "A", "?": None, None: None}
    codes = spark.createDataFrame([("mrc",), (" GEN ",), (None,)], "c string").select(R.book_code(F.col("c")).alias("c")).collect()
    assert [r.c for r in codes] == ["MRK", "GEN", None]


def test_other_headers(spark, tmp_path):
    (tmp_path / "b.xlsx").write_bytes(xlsx([["BK", "Chapter Number", "Start Verse Number", "Line Number", "Characters1", "Reader Name", "Verse_Content1"], ["JUA", "1", "1", "1", "N", "r", "One"]]))
    r = R.read_xlsx(spark, "file://" + str(tmp_path)).first()
    assert (r.book_id, r.chapter_num, r.verse_str, r.person, r.actor, r.script_text) == ("JHN", 1, "1", "N", "r", "One")


def test_tables_agree(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Book,Chapter,Verse,Line_Number,Text\nkar,1,1,1,"One, two"\nJMS,1,<<,2,Title\nkar,x,2,3,bad\n')
    (tmp_path / "a.xlsx").write_bytes(xlsx([["BOOK", "Chapter", "Verse", "Line #", "Character", "Reader", "Target Language"], ["kar", "1", "1", "1", "N", "r", "One, two"], ["JMS", "1", "<<", "2", None, None, "Title"], ["kar", "x", "2", "3", None, None, "bad"]]))
    want = [("KAR", 1, "1", "One, two"), ("JAS", 1, "0", "Title"), ("KAR", None, "2", "bad")]
    c, x = R.read_csv_lines(spark, str(tmp_path / "a.csv")), R.read_xlsx(spark, str(tmp_path))
    assert rows(c) == rows(x) == want
    assert [r.bad for r in c.collect()] == [False, False, True] and x.first().person == "N"
    (tmp_path / "b.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="columns missing"):
        R.read_csv_lines(spark, str(tmp_path / "b.csv"))


def test_json_formats(spark, tmp_path):
    books = spark.createDataFrame([(2, "LUM", "NT", 3), (1, "KAR", "NT", 3), (3, "OLD", "OT", 1)], "seq int, book_id string, testament string, chapters int")
    (tmp_path / "p.json").write_text(json.dumps({"data": [{"book_id": b, "chapter": 1, "verse_start": v, "verse_end": e, "verse_text": t} for b, v, e, t in (("LUM", 1, 1, "a &lt b"), ("KAR", 2, 3, "x"), ("KAR", 1, 1, "y"), ("OLD", 1, 1, "z"))]}))
    got = [(r.book_id, r.verse_str, r.script_num, r.script_text) for r in R.read_json_lines(spark, str(tmp_path / "p.json"), books, ["NT"]).orderBy("seq", "verse_num").collect()]
    assert got == [("KAR", "1", "1", "y"), ("KAR", "2-3", "2", "x"), ("LUM", "1", "1", "a < b")]
    (tmp_path / "asr.json").write_text(json.dumps({"language": "en", "segments": [{"id": 0, "start": 0.5, "end": 2, "text": " Hi ", "words": [{"word": "Hi", "start": 0.5, "end": 1, "probability": 0.9}]}, {"id": 1, "start": 2, "end": 3, "text": "you"}]}))
    assert [(r.script_text, r.script_begin_ts) for r in R.read_asr(spark, str(tmp_path / "asr.json")).orderBy("pos").collect()] == [("Hi", 0.5), ("you", 2.0)]
    (tmp_path / "frag.json").write_text(json.dumps({"fragments": [{"id": "f1", "begin": "0.000", "end": "1.250", "language": "x", "lines": ["a", "b"], "children": []}]}))
    assert [tuple(r) for r in R.read_fragments(spark, str(tmp_path / "frag.json")).collect()] == [(0, "f1", 0.0, 1.25, "a b")]
    (tmp_path / "ch.json").write_text(json.dumps([{"ch": 233, "ts": 0.5}]))
    assert [tuple(r) for r in R.read_letter_times(spark, str(tmp_path / "ch.json")).collect()] == [("é", 0.5)]
    text = json.dumps({"ratio": 0.02, "dictionary": {"a": 1, "b": 2}, "tokens": [[[1, 0, 5, 0.9], [2, 5, 9, 0.8]], [[2, 20, 25, 0.7]]]})
    a = spark.createDataFrame([(text,)], "j string").select(F.inline(R.aligned_letters(F.col("j")))).collect()
    assert [(r.word_pos, r.seq, r.letter, r.start_ts) for r in a] == [(0, 0, "a", 0.0), (0, 1, "b", 0.1), (1, 0, "b", 0.4)]


def test_timing_catalog_errors_manifest(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("0.5\t2.5\t001\n2.5\t4\t002\n")
    assert sorted((r.verse, r.begin_ts, r.end_ts) for r in R.read_timing(spark, str(tmp_path / "t.tsv")).collect()) == [("0", 0.0, 0.5), ("1", 0.5, 2.5), ("2", 2.5, 4.0)]
    sets = [{"id": f"F{i}", "type": t, "size": "NT", "codec": c, "container": "mp3", "bitrate": b} for i, (t, c, b) in enumerate((("audio_drama", "MP3", "64kbps"), ("audio", "opus", "16kbps"), ("audio", "mp3", "3kbps")))]
    (tmp_path / "c.json").write_text(json.dumps({"data": {"abbr": "ABC", "iso": "abc", "language_id": 1, "filesets": {"prod": sets}}}))
    cat = R.read_catalog(spark, str(tmp_path / "c.json"))
    assert R.choose_fileset(cat, ["audio", "audio_drama"], "NT", "MP3", "64kbps").first().id == "F2"
    assert R.choose_fileset(cat, ["audio_drama", "audio"], "NT").first().id == "F0"
    (tmp_path / "e.csv").write_text("KAR 1:1 , 3,word ,kind\n")
    assert tuple(R.read_known_errors(spark, str(tmp_path / "e.csv")).first())[0::2] == ("KAR 1:1", "word")
    (tmp_path / "m.json").write_text("\n".join(json.dumps({"audio_start_sec": i + 0.12345, "text": f"t{i}", "duration": 1.0}) for i in range(2)))
    (tmp_path / "n.json").write_text(json.dumps({"audio_start_sec": 9.0, "text": "u0", "duration": 1.0}) + "\n")
    ids = spark.createDataFrame([(7, "m.json"), (5, "m.json"), (6, "n.json")], "script_id long, manifest string")
    assert [(r.script_id, r.text, r.audio_start_sec) for r in R.read_manifest(spark, [str(tmp_path / "n.json"), str(tmp_path / "m.json")], ids, "script_id").orderBy("script_id").collect()] == [(5, "t0", 0.123), (6, "u0", 9.0), (7, "t1", 1.123)]
    for some in (ids.filter("script_id <> 5"), ids.filter("script_id <> 6"), ids.unionByName(ids)):
        with pytest.raises(ValueError):
            R.read_manifest(spark, [str(tmp_path / "n.json"), str(tmp_path / "m.json")], some, "script_id")


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "", 0.0, [1.0, 2.0], [[1.0], [2.0]]), (2, "", 0.0, [3.0], None)], "id long, t string, z double, v array<double>, m array<array<double>>")
    assert K.active_columns(df).columns == ["id", "v", "m"]
    assert [tuple(r) for r in K.wide_vector(df.select("id", "v"), "v", "v", 2).collect()] == [(1, 1.0, 2.0), (2, 3.0, None)]
    assert [tuple(r)[:3] for r in K.matrix_rows(df, "id", "m", ["z"]).orderBy("id", "line").collect()] == [(1, 0, 0.0), (1, 1, None), (2, 0, 0.0)]
    assert json.loads(K.as_json(df.select("id", "t")).first().value) == {"id": 1, "t": ""}
    assert {(r.user, r.run) for r in K.next_run(spark.createDataFrame([("u/d/00002/x",), ("u/d/00011/y",), ("w/d/none",)], "path string")).collect()} == {("u", 12), ("w", 1)}
    q = K.queue_messages(spark.createDataFrame([("g", "a"), ("g", "a"), ("g", "b")], "g string, x string"), "g")
    assert q.select("message_id").distinct().count() == 2
    assert K.merged_pairs([df.select("id"), df.select("id")], "id").count() == 4
    K.write_table(df.select("id", "t"), str(tmp_path / "o"), "csv")
    K.write_table(df.select("id", "t"), str(tmp_path / "o"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "o")).count() == 2
    page = open(K.html_report(spark.createDataFrame([("<a>", "<b>x</b>")], "t string, h string"), "T & U", ["t", "h"], str(tmp_path / "r.html"), raw=["h"])).read()
    assert "&lt;a&gt;" in page and "<b>x</b>" in page and "T &amp; U" in page
    assert zipfile.ZipFile(io.BytesIO(K.zip_files({"a": b"1"}))).read("a") == b"1"


def test_model(spark):
    for name in SCHEMAS:
        assert empty(spark, name).count() == 0
    assert duplicate_keys(spark.createDataFrame([(1, 2), (1, 2), (3, 4)], "a int, n_rows int"), ["a"]).collect() == [(1, 2)]


def test_exports_are_as_wide_as_their_vectors(spark, tmp_path):
    spark.createDataFrame([(1, [0.5, 1.5]), (2, [float(i) for i in range(9)]), (3, None), (4, [])], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = S.vector_columns(spark, str(tmp_path))
    assert got.columns == ["vec_id", *[f"v{i}" for i in range(9)]]
    assert [list(r)[1:] for r in got.orderBy("vec_id").collect()] == [[0.5, 1.5] + [None] * 7, [float(i) for i in range(9)], [None] * 9, [None] * 9]
    m = [(1, 2, 3, [[1.0, 2.0, 3.0], [4.0, 5.0, 6.0]]), (2, 1, 5, [[7.0, 8.0, 9.0, 10.0, 11.0]])]
    spark.createDataFrame(m, "word_id long, n_rows int, n_cols int, mfcc array<array<float>>").withColumn("loaded_at", F.current_timestamp()).write.parquet(str(tmp_path / "word_mfcc.parquet"))
    got = S.matrix_columns(spark, str(tmp_path))
    assert got.columns == ["word_id", "line", "n_rows", "n_cols", *[f"mfcc{i}" for i in range(5)]]
    assert [tuple(r) for r in got.orderBy("word_id", "line").collect()] == [(1, 0, 2, 3, 1.0, 2.0, 3.0, None, None), (1, 1, None, None, 4.0, 5.0, 6.0, None, None), (2, 0, 1, 5, 7.0, 8.0, 9.0, 10.0, 11.0)]
    assert K.vector_width(spark.createDataFrame([], "v array<double>"), "v") == 0
