"""Readers of the text, timing and metadata formats.

Every reader gives line rows: book_id, chapter_num, verse_str, verse_num and
the text, with further columns where the format has them. Formats Spark reads
itself stay with Spark's scans; the markup formats are parsed per file inside
mapInArrow, so files are read in parallel and a file is never on the driver.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterable, Iterator, Sequence
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstream.functions import text as X
from quillstream.runtime import small_side

# Names of columns in source files, in lower case.
COLUMN_NAMES = {
    "book_id": ("book_id", "book", "bk", "book name abbr"),
    "chapter_num": ("chapter", "chapter_num", "cp", "chapter number"),
    "verse_str": ("verse", "verse_number", "start verse number", "verse_start", "verse_str", "vs"),
    "script_num": ("line_number", "line id:", "line", "line #", "line number"),
    "script_text": ("text", "transcribed_text", "target language", "verse_content1", "verse_text", "script_text"),
    "person": ("character", "characters1", "character group", "person"),
    "actor": ("reader", "reader name", "actor"),
}
# Book codes found in file names and sources, and the codes meant.
BOOK_CODES = {
    "PSM": "PSA", "PRV": "PRO", "SOS": "SNG", "EZE": "EZK", "JOE": "JOL", "NAH": "NAM", "MRC": "MRK", "LUC": "LUK", "JUA": "JHN", "HEC": "ACT", "EFE": "EPH",
    "FHP": "PHP", "1TE": "1TH", "2TE": "2TH", "TTO": "TIT", "TTL": "TIT", "TTS": "TIT", "FHM": "PHM", "JMS": "JAS", "SNT": "JAS", "APO": "REV",
}
# Styles whose text is part of the script, by kind of element, without a trailing digit.
KEPT_STYLES = {
    "para": (
        "h", "mt",
        "p", "m", "po", "pr", "cls", "pmo", "pm", "pmc", "pmr", "pi", "mi", "pc", "ph", "lit", "nb", "pb",
        "q", "qr", "qc", "qm",
        "lh", "li", "lf", "lim", "litl",
    ),
    "row": ("tr",),
    "cell": ("th", "thr", "tc", "tcr"),
    "char": (
        "bk", "k", "litl", "nd", "ord", "pn", "png", "qac", "qs", "qt", "sig", "sls", "tl", "wj",
        "em", "bd", "bdit", "it", "no", "sc", "sup",
        "rb", "pro", "w", "wg", "wh", "wa",
        "lik", "liv", "jmp",
    ),
}
# Styles whose text isn't part of the script.
DROPPED_STYLES = {
    "para": (
        "ide", "toc", "toca", "rem", "usfm",
        "imt", "is", "ip", "ipi", "im", "imi", "ipq", "imq", "ipr", "iq", "ib", "ili", "iot", "io", "iex", "imte", "ie",
        "mte", "cl", "cd", "ms", "mr", "s", "sr", "r", "d", "sp", "sd",
        "cp", "restore", "qa", "qd", "b",
    ),
    "char": ("va", "vp", "ca", "add", "addnp", "dc", "ior", "iqt", "rq", "fig"),
    "note": ("f", "fe", "ef", "x", "xt", "ex"),
    "sidebar": ("esb",),
    "figure": ("fig",),
    "ms": ("qt", "ts"),
}
#: Paragraph styles of titles, each a row of its own.
TITLE_STYLES = frozenset({"h", "mt"})

LINES = T.StructType([T.StructField(n, t) for n, t in (
    ("path", T.StringType()), ("pos", T.IntegerType()), ("book_id", T.StringType()), ("chapter_num", T.IntegerType()), ("verse_str", T.StringType()),
    ("verse_end", T.StringType()), ("usfm_style", T.StringType()), ("script_text", T.StringType()),
)])


def book_code(book: Column) -> Column:
    """Upper-case code with known misspellings repaired (SET-04)."""
    code = F.upper(F.trim(book))
    known = F.create_map(*[F.lit(x) for kv in BOOK_CODES.items() for x in kv])
    return F.coalesce(F.try_element_at(known, code), code)


def named_books(rows: DataFrame, names: DataFrame, name: str = "book_name") -> DataFrame:
    """``rows`` with ``book_id`` for the book's name by a table of names (book_name, book_id); NULL for an unknown one (SET-03).

    Names compare without case, blanks and underscores; a name that stands for
    several books takes the smallest code.
    """
    plain = lambda c: F.regexp_replace(F.upper(c), r"[\s_]+", "")
    known = names.groupBy(plain(F.col("book_name")).alias("__plain")).agg(F.min("book_id").alias("book_id"))
    return rows.withColumn("__plain", plain(F.col(name))).join(known, "__plain", "left").drop("__plain")


def _renamed(df: DataFrame, required: Sequence[str]) -> DataFrame:
    have = {c.strip().lower(): c for c in df.columns}
    out = {}
    for name, options in COLUMN_NAMES.items():
        found = next((have[o] for o in options if o in have), None)
        if found:
            out[name] = F.col(f"`{found}`")
    missing = [n for n in required if n not in out]
    if missing:
        raise ValueError(f"columns missing: {', '.join(missing)}; found {', '.join(df.columns)}")
    return df.select(*[c.alias(n) for n, c in out.items()])


def read_csv_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """CSV scripts with any of the known headers; rows whose chapter isn't a number go to ``bad`` (SRC-05)."""
    rows = _renamed(spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path), ("book_id", "chapter_num", "script_text"))
    return line_rows(rows)


def line_rows(rows: DataFrame) -> DataFrame:
    """Line rows of renamed columns: codes repaired, numbers checked (``bad`` tells which rows aren't usable)."""
    if "verse_str" not in rows.columns:
        rows = rows.withColumn("verse_str", F.coalesce(F.col("script_num"), F.lit("0")) if "script_num" in rows.columns else F.lit("0"))
    chapter = F.trim(F.col("chapter_num").cast("string")).try_cast("int")
    verse = F.when(F.trim(F.col("verse_str").cast("string")) == "<<", "0").otherwise(F.trim(F.col("verse_str").cast("string")))
    return rows.withColumns({
        "book_id": book_code(F.col("book_id")), "bad": chapter.isNull(), "chapter_num": chapter, "verse_str": verse,
    }).withColumns({"verse_num": X.leading_int(F.col("verse_str")), "verse_end": X.verse_range(F.col("verse_str"))["end"]})


_DATA = "data array<struct<book_id:string, chapter:int, verse_start:int, verse_end:int, verse_text:string>>"


def read_json_lines(spark: SparkSession, path: str | list[str], books: DataFrame, testaments: Sequence[str] = ("OT", "NT")) -> DataFrame:
    """``{"data": [...]}`` documents in the order of books, with a running number by book (SRC-12)."""
    return json_lines(spark.read.schema(_DATA).option("multiLine", True).json(path), books, testaments)


def json_lines(documents: DataFrame, books: DataFrame, testaments: Sequence[str] = ("OT", "NT"), keys: Sequence[str] = ()) -> DataFrame:
    """The same of documents in a column: ``data`` parsed, or ``json`` as text; ``keys`` tell texts apart."""
    if "json" in documents.columns:
        documents = documents.withColumn("data", F.from_json("json", _DATA)["data"])
    d = documents.select(*keys, F.explode("data").alias("d")).select(*keys, "d.*")
    d = d.join(small_side(books.filter(F.col("testament").isin(*testaments)).select("book_id", "seq")), "book_id")
    same = F.col("verse_end").isNull() | (F.col("verse_end") == F.col("verse_start"))
    verse = F.when(same, F.col("verse_start").cast("string")).otherwise(F.concat_ws("-", "verse_start", "verse_end"))
    n = F.row_number().over(W.partitionBy(*keys, "book_id").orderBy("chapter", "verse_start"))
    text = F.replace(F.replace(F.col("verse_text"), F.lit("&lt"), F.lit("<")), F.lit("&gt"), F.lit(">"))
    return d.select(*keys, "seq", "book_id", F.col("chapter").alias("chapter_num"), verse.alias("verse_str"), F.col("verse_start").alias("verse_num"), n.cast("string").alias("script_num"), text.alias("script_text"))


def _base(style: str) -> str:
    """A style without one trailing digit (SRC-11)."""
    return style[:-1] if style[-1:].isdigit() else style


def _kinds() -> dict[str, tuple[str, bool]]:
    """Kind and use of each style code; where two kinds share a code, the inner one of running text (SRC-10)."""
    out: dict[str, tuple[str, bool]] = {}
    for table, keep in ((DROPPED_STYLES, False), (KEPT_STYLES, True)):
        for kind, codes in table.items():
            out |= {c: (kind, keep) for c in codes}
    return out


_KINDS = _kinds()


def kept_style(kind: str, style: str) -> bool:
    """Whether text of an element of this kind and style is part of the script; unknown styles aren't."""
    return _base(style) in KEPT_STYLES.get(kind, ())


def _body(parts: list[str]) -> str:
    # Braces would be taken for verse marks.
    return re.sub(r"\s+", " ", "".join(parts)).strip().replace("{", "(").replace("}", ")")


def usfm_rows(text: str) -> Iterator[tuple[str, int, str, str, str, str]]:
    """(book, chapter, verse, verse end, style, text) of backslash-marked text (SRC-08..11).

    A title is a row of its own. What follows a paragraph style that isn't part
    of the script is left out until the next paragraph, verse or chapter; what
    stands in such a character style or note, until its end mark.
    """
    book, chapter, verse, style = "", 1, "0", "para.p"
    parts: list[str] = []
    skip: list[str] = []
    para_skip, expect = False, ""
    closed = set(re.findall(r"\\\+?([A-Za-z]+[0-9]?)\*", text))  # of an unknown style: whether it has an end mark

    def flush():
        body = _body(parts)
        parts.clear()
        if body:
            yield book, chapter, verse, verse.split("-")[-1], style, body

    for m in re.finditer(r"\\(\+?[A-Za-z]+[0-9]?)(\*?)|([^\\]+)|\\", text):
        name, close, plain = m.group(1), m.group(2), m.group(3)
        if plain is not None:
            if expect and plain.strip():
                first = re.match(r"\s*(\S+)", plain)
                value, plain = first.group(1), plain[first.end() :]
                if expect == "id":
                    book, plain = value.upper()[:3], ""
                elif expect == "c":
                    chapter, verse = int(re.match(r"\d*", value).group() or 0), "0"
                else:
                    verse = value
                expect = ""
            if not skip and not para_skip:
                parts.append(plain)
            continue
        if name is None:
            continue
        name = name.lstrip("+")
        kind, keep = _KINDS.get(_base(name), ("char" if name in closed else "para", False))
        expect = ""
        if close:
            if name in skip:  # what was opened inside ends with it
                del skip[skip.index(name) :]
        elif name in ("id", "c", "v"):
            yield from flush()
            skip, para_skip, expect = [], name == "id", name
        elif skip:
            skip.append(name)
        elif kind in ("para", "row"):
            if verse == "0" or _base(name) in TITLE_STYLES or style[5:] in TITLE_STYLES:
                yield from flush()
            para_skip = not keep
            if keep:
                style = f"para.{name}"
                parts.append(" ")
        elif not keep:
            skip.append(name)
    yield from flush()


def usx_rows(content: bytes) -> Iterator[tuple[str, int, str, str, str, str]]:
    """The same of USX (SRC-07): markers set the place, subtrees of styles outside of the script are skipped, order of mixed content is kept."""
    book, chapter, verse, style = "", 1, "0", "para.p"
    parts: list[str] = []
    out: list[tuple[str, int, str, str, str, str]] = []

    def flush():
        body = _body(parts)
        parts.clear()
        if body:
            out.append((book, chapter, verse, verse.split("-")[-1], style, body))

    def walk(e):
        nonlocal book, chapter, verse, style
        kind, own = e.tag.rpartition("}")[2], e.get("style", "")
        if kind == "book":
            book = e.get("code", "").upper()
        elif kind in ("chapter", "verse"):
            if e.get("eid") is None:
                flush()
                number = e.get("number", "")
                if kind == "chapter":
                    chapter, verse = int(re.match(r"\d*", number).group() or 0), "0"
                else:
                    verse = number
        elif kind not in ("para", "char", "cell", "row", "ms", "note", "sidebar", "figure") or kind == "row" or kept_style(kind, own):
            if kind in ("para", "row"):
                if verse == "0" or _base(own) in TITLE_STYLES or style[5:] in TITLE_STYLES:
                    flush()
                style = f"para.{own}"
                parts.append(" ")
            parts.append(e.text or "")
            for child in e:
                walk(child)
                parts.append(child.tail or "")

    for child in ElementTree.fromstring(content):
        walk(child)
    flush()
    return iter(out)


def unknown_styles(text: Column) -> Column:
    """Distinct style codes of marked text that are in neither table, as the warning names them (SRC-11)."""
    codes = F.transform(F.regexp_extract_all(text, F.lit(r"\\([A-Za-z]+[0-9]?)"), F.lit(1)), lambda c: F.regexp_replace(c, "[0-9]$", ""))
    known = F.array(*[F.lit(c) for c in (*sorted(_KINDS), "id", "c", "v")])
    return F.array_sort(F.array_distinct(F.array_except(codes, known)))


def _cell_column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref).group():
        n = n * 26 + ord(c) - 64
    return n - 1


def xlsx_cells(content: bytes) -> Iterator[list[str]]:
    """Rows of the first sheet of a workbook as texts (SRC-06)."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", ns):
                shared.append("".join(t.text or "" for t in si.iter(f"{{{ns['m']}}}t")))
        sheet = min((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n).group()))
        for row in ElementTree.fromstring(z.read(sheet)).iter(f"{{{ns['m']}}}row"):
            cells: dict[int, str] = {}
            for c in row.findall("m:c", ns):
                v, kind = c.find("m:v", ns), c.get("t", "")
                if kind == "inlineStr":
                    text = "".join(t.text or "" for t in c.iter(f"{{{ns['m']}}}t"))
                else:
                    text = (v.text or "") if v is not None else ""
                    text = shared[int(text)] if kind == "s" and text else text
                cells[_cell_column(c.get("r", "A"))] = text
            yield [cells.get(i, "") for i in range(max(cells, default=-1) + 1)]


def _files(spark: SparkSession, path: str | Iterable[str], glob: str, parse: Callable[[bytes], Iterator[tuple]]) -> DataFrame:
    """Line rows of whole files, parsed where the files are read; zip archives are opened (SRC-34..36, SRC-39)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path if isinstance(path, str) else list(path)).select("path", "content")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                inner = [(name, content)]
                if name.lower().endswith(".zip"):
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        inner = [(f"{name}/{n}", z.read(n)) for n in sorted(z.namelist()) if not n.endswith("/") and not n.rpartition("/")[2].startswith(".")]
                for part, data in inner:
                    rows = [(part, i, *r) for i, r in enumerate(parse(data))]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string()))], names=LINES.names)

    return files.mapInArrow(work, LINES).withColumn("verse_num", X.leading_int(F.col("verse_str")))


def read_usfm(spark: SparkSession, path: str | list[str], glob: str = "*.{usfm,sfm,zip}") -> DataFrame:
    return _files(spark, path, glob, lambda data: usfm_rows(data.decode("utf-8", "replace")))


def read_usx(spark: SparkSession, path: str | list[str], glob: str = "*.{usx,zip}") -> DataFrame:
    return _files(spark, path, glob, usx_rows)


def read_xlsx(spark: SparkSession, path: str | list[str], glob: str = "*.{xlsx,xlsm}") -> DataFrame:
    """Script workbooks with any of the known headers; each is parsed where it is read, from any file system (SRC-06)."""
    return workbook_lines(spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path if isinstance(path, str) else list(path)).select("path", "content"))


def workbook_lines(files: DataFrame) -> DataFrame:
    """Lines of workbooks given as path and content."""
    names = list(COLUMN_NAMES)
    schema = T.StructType([T.StructField("path", T.StringType()), *[T.StructField(c, T.StringType()) for c in names]])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                cells = xlsx_cells(content)
                head = [c.strip().lower() for c in next(cells, [])]
                at = {c: next((head.index(o) for o in COLUMN_NAMES[c] if o in head), None) for c in names}
                for c in ("book_id", "chapter_num", "script_text"):
                    if at[c] is None:
                        raise ValueError(f"{file}: no column for {c} among {head}")
                rows = [r for r in cells if any(r)]
                column = lambda i: [None if i is None or i >= len(r) else r[i] for r in rows]
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(rows), pa.string()), *[pa.array(column(at[c]), pa.string()) for c in names]], names=["path", *names])

    return line_rows(files.mapInArrow(work, schema))


def parse_usfm(text: Column) -> Column:
    """array<struct<book_id, chapter_num, verse_str, verse_end, usfm_style, script_text>> of marked text in a column."""
    return _usfm(text)


def parse_usx(text: Column) -> Column:
    """The same of USX in a column."""
    return _usx(text)


_ROW = T.StructType([f for f in LINES.fields if f.name not in ("path", "pos")])


def _parsed(text: pa.Array, parse: Callable[[str], Iterator[tuple]]) -> pa.Array:
    kind = pa.list_(pa.struct([(f.name, pa.int32() if isinstance(f.dataType, T.IntegerType) else pa.string()) for f in _ROW.fields]))
    return pa.array([None if x is None else [dict(zip(_ROW.names, r)) for r in parse(x)] for x in text.to_pylist()], kind)


@F.arrow_udf(T.ArrayType(_ROW))
def _usfm(text: pa.Array) -> pa.Array:
    return _parsed(text, usfm_rows)


@F.arrow_udf(T.ArrayType(_ROW))
def _usx(text: pa.Array) -> pa.Array:
    return _parsed(text, lambda x: usx_rows(x.encode()))


_UNZIPPED = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("content", T.BinaryType())]))


@F.arrow_udf(_UNZIPPED)
def unzipped(archive: pa.Array) -> pa.Array:
    """array<struct<name, content>> of zip archives in a column, by name, hidden files left out (SRC-39)."""
    rows = []
    for data in archive.to_pylist():
        if data is None:
            rows.append(None)
            continue
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            rows.append([{"name": n, "content": z.read(n)} for n in sorted(z.namelist()) if not n.endswith("/") and not n.rpartition("/")[2].startswith(".")])
    return pa.array(rows, pa.list_(pa.struct([("name", pa.string()), ("content", pa.binary())])))


def read_timing(spark: SparkSession, path: str | list[str], with_zero: bool = True) -> DataFrame:
    """Tab-separated begin, end and verse; ``with_zero`` adds verse 0 before the first (SRC-20, SRC-31)."""
    return timing_rows(spark.read.schema("begin_ts double, end_ts double, verse string").option("sep", "\t").csv(path).withColumn("path", F.col("_metadata.file_path")), with_zero)


def timing_rows(t: DataFrame, with_zero: bool = True) -> DataFrame:
    """The same of rows of begin_ts, end_ts, verse and path."""
    t = t.withColumn("verse", F.coalesce(F.nullif(F.ltrim("verse", F.lit("0")), F.lit("")), F.lit("0")))
    if with_zero:
        t = t.unionByName(t.groupBy("path").agg(F.lit(0.0).alias("begin_ts"), F.min("begin_ts").alias("end_ts"), F.lit("0").alias("verse")))
    return t


_SEGMENTS = "language string, segments array<struct<id:int, start:double, end:double, text:string, words:array<struct<word:string, start:double, end:double, probability:double>>>>"


def read_asr(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Segments of speech-recognition JSON as lines (SRC-14)."""
    d = spark.read.schema(_SEGMENTS).option("multiLine", True).json(path).withColumn("path", F.col("_metadata.file_path"))
    return d.select("path", "language", F.posexplode("segments").alias("pos", "s")).select("path", "language", "pos", F.trim("s.text").alias("script_text"), F.col("s.start").alias("script_begin_ts"), F.col("s.end").alias("script_end_ts"), "s.words")


def aligned_letters(response: Column) -> Column:
    """array<struct<word_pos, seq, letter, start_ts, end_ts, score>> of a word aligner's JSON: letters by token number, frames to seconds (SRC-16)."""
    d = F.from_json(response, "ratio double, dictionary map<string,int>, tokens array<array<array<double>>>")
    letter_of = F.map_from_entries(F.transform(F.map_entries(d["dictionary"]), lambda e: F.struct(e["value"], e["key"])))
    word = lambda w, i: F.transform(w, lambda t, k: F.struct(
        i.alias("word_pos"), k.alias("seq"), F.try_element_at(letter_of, t[0].cast("int")).alias("letter"), F.round(t[1] * d["ratio"], 3).alias("start_ts"), F.round(t[2] * d["ratio"], 3).alias("end_ts"), t[3].alias("score")))
    return F.flatten(F.transform(d["tokens"], word))


def read_fragments(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Fragments of a line aligner's JSON; its numbers are texts (SRC-18)."""
    d = spark.read.schema("fragments array<struct<id:string, begin:string, end:string, language:string, lines:array<string>>>").option("multiLine", True).json(path)
    return d.select(F.posexplode("fragments").alias("pos", "f")).select("pos", "f.id", F.col("f.begin").try_cast("double").alias("begin_ts"), F.col("f.end").try_cast("double").alias("end_ts"), F.concat_ws(" ", "f.lines").alias("text"))


def read_letter_times(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Letters and times of character recognition JSON (SRC-17)."""
    d = spark.read.schema("ch int, ts double").option("multiLine", True).json(path)
    return d.select(F.chr(F.col("ch")).alias("letter"), "ts")


def letter_times(response: Column) -> Column:
    """array<struct<letter, ts>> of such JSON in a column."""
    return F.transform(F.from_json(response, "array<struct<ch:int, ts:double>>"), lambda x: F.struct(F.chr(x["ch"]).alias("letter"), x["ts"].alias("ts")))


def fragments(response: Column) -> Column:
    """array<struct<id, begin_ts, end_ts, text>> of a line aligner's JSON in a column (SRC-18)."""
    d = F.from_json(response, "fragments array<struct<id:string, begin:string, end:string, language:string, lines:array<string>>>")
    return F.transform(d["fragments"], lambda f: F.struct(f["id"].alias("id"), f["begin"].try_cast("double").alias("begin_ts"), f["end"].try_cast("double").alias("end_ts"), F.concat_ws(" ", f["lines"]).alias("text")))


def read_manifest(spark: SparkSession, path: str | list[str], ids: DataFrame, order: str, manifest: str = "manifest") -> DataFrame:
    """JSON-lines manifests, one a chapter, joined by position to the ids of their chapter (SRC-15); raises if lengths differ.

    ``ids`` names its file in ``manifest`` (no folders). Lines are numbered
    within their file, ids within their manifest, so no step sees all of either.
    """
    m = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias(manifest), "value")
    out = manifest_lines(m, ids, order, manifest)
    if not out.filter("not matched").isEmpty():
        raise ValueError("manifest and ids differ in length")
    return out.drop("matched")


def manifest_lines(manifests: DataFrame, ids: DataFrame, order: str, manifest: str = "manifest") -> DataFrame:
    """The same of whole manifests in a column ``value``; ``matched`` is false for what has no counterpart."""
    item = "audio_start_sec double, audio_filepath string, duration double, text string, normalized_text string, uroman_tokens string"
    m = manifests.select(manifest, F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "").alias("rows"))
    m = m.select(manifest, F.posexplode("rows").alias("pos", "row")).select(manifest, (F.col("pos") + 1).alias("pos"), F.from_json("row", item).alias("m"))
    i = ids.withColumn("pos", F.row_number().over(W.partitionBy(manifest).orderBy(order)))
    both = i.withColumn("__id", F.lit(True)).join(m, [manifest, "pos"], "full").withColumn("matched", F.col("__id").isNotNull() & F.col("m").isNotNull())
    return both.drop("__id").select("*", "m.*").drop("m").withColumns({"audio_start_sec": F.round("audio_start_sec", 3), "duration": F.round("duration", 3)})


def read_known_errors(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Headerless reference, word_seq, word, type (SRC-28)."""
    return known_errors(spark.read.text(path))


def known_errors(lines: DataFrame) -> DataFrame:
    """The same of lines in a column ``value``."""
    d = lines.withColumn("__r", F.from_csv("value", "reference string, word_seq string, word string, type string"))
    rest = [c for c in lines.columns if c != "value"]
    return d.select(*rest, F.trim("__r.reference").alias("reference"), F.trim("__r.word_seq").try_cast("int").alias("word_seq"), F.trim("__r.word").alias("word"), F.trim("__r.type").alias("type"))


_FILESET = "struct<id:string, type:string, size:string, codec:string, container:string, bitrate:string>"
_CATALOG = f"data struct<abbr:string, iso:string, language_id:int, books:array<struct<book_id:string, testament:string>>, filesets:map<string,array<{_FILESET}>>>"


def read_catalog(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """File sets of catalog JSON, one row each; a folder of pages is read as one (SRC-23, SRC-24, SRC-32)."""
    return catalog_filesets(spark.read.schema(_CATALOG).option("multiLine", True).json(path))


def catalog_filesets(documents: DataFrame) -> DataFrame:
    """The same of documents in a column: ``data`` parsed, or ``json`` as text."""
    d = documents.select(F.from_json("json", _CATALOG)["data"].alias("data")) if "json" in documents.columns else documents
    return d.select("data.abbr", "data.iso", F.explode("data.filesets").alias("site", "sets")).select("abbr", "iso", "site", F.posexplode("sets").alias("pos", "f")).select("abbr", "iso", "site", "pos", "f.*")


def choose_fileset(sets: DataFrame, types: Sequence[str], size: str, codec: str | None = None, bitrate: str | None = None) -> DataFrame:
    """The first file set of each catalog entry by preferred type, then place (PRJ-25, PRJ-26)."""
    same_codec = F.when(F.upper("codec") == "MP3", "MP").otherwise(F.upper("codec"))
    same_rate = F.when(F.col("bitrate") == "3kbps", "64kbps").otherwise(F.col("bitrate"))
    ok = F.col("type").isin(*types) & F.col("size").contains(size)
    if codec:
        ok &= same_codec == ("MP" if codec.upper() == "MP3" else codec.upper())
    if bitrate:
        ok &= same_rate == ("64kbps" if bitrate == "3kbps" else bitrate)
    rank = F.array_position(F.array(*[F.lit(t) for t in types]), F.col("type"))
    return sets.filter(ok).withColumn("n", F.row_number().over(W.partitionBy("abbr", "site").orderBy(rank, "pos"))).filter("n = 1").drop("n")


def available(sets: DataFrame, types: Sequence[str]) -> DataFrame:
    """Catalog entries that have a file set of every type (PRJ-31): abbr, iso."""
    seen = sets.groupBy("abbr", "iso").agg(F.collect_set(F.when(F.col("type").isin(*types), F.col("type"))).alias("t"))
    return seen.filter(F.size("t") == len(set(types))).select("abbr", "iso")


def pair_list(documents: DataFrame, book_id: str = "", chapter_num: int = 0, keys: Sequence[str] = ()) -> DataFrame:
    """Pairs of comparison JSON in a column ``json``, of one book and chapter if they are given (SRC-27).

    Gives ``script_id`` (the base's, else the other's), book, chapter, both
    texts and the number of differing characters.
    """
    side = "struct<script_id:long, book_id:string, chapter_num:int, text:string>"
    d = documents.select(*keys, F.explode(F.from_json("json", f"array<struct<base:{side}, comp:{side}, n:long>>")).alias("p")).select(*keys, "p.*")
    d = d.select(
        *keys, F.coalesce(F.nullif("base.script_id", F.lit(0)), F.col("comp.script_id")).alias("script_id"), F.coalesce("base.book_id", "comp.book_id").alias("book_id"),
        F.coalesce("base.chapter_num", "comp.chapter_num").alias("chapter_num"), F.coalesce("base.text", F.lit("")).alias("base_text"), F.coalesce("comp.text", F.lit("")).alias("comp_text"), "n",
    )
    d = d.filter(F.col("book_id") == book_id) if book_id else d
    return d.filter(F.col("chapter_num") == chapter_num) if chapter_num else d


def by_position(lines: DataFrame, columns: Sequence[str | None], sep: str = "\t", header: bool = False) -> DataFrame:
    """Columns of separated lines (column ``value``, ``pos`` numbering them in their file) by position; None leaves one out (SRC-29)."""
    parts = F.split("value", sep if len(sep) == 1 and sep not in "|.*+?^$()[]{}\\" else f"\\Q{sep}\\E", -1)
    rest = [c for c in lines.columns if c != "value"]
    rows = lines.filter("pos > 0") if header else lines
    return rows.select(*rest, *[F.coalesce(F.get(parts, F.lit(i)), F.lit("")).alias(c) for i, c in enumerate(columns) if c])


def language_nodes(lines: DataFrame) -> DataFrame:
    """The language tree of JSON lines (column ``value``) as an adjacency list; empty parents are none (SRC-30)."""
    d = lines.select(F.from_json("value", "id string, family_id string, parent_id string, lang_name string, node_kind string, iso639_3 string, iso639_1 string").alias("n")).select("n.*")
    return d.withColumns({c: F.nullif(c, F.lit("")) for c in ("family_id", "parent_id")})


def items_at(rows: DataFrame, index: str, wanted: Sequence[int]) -> DataFrame:
    """Rows by their index, as a reader of stored samples fetches them (SRC-42)."""
    return rows.filter(F.col(index).isin(*wanted))


def query(spark: SparkSession, tables: dict[str, DataFrame], statement: str) -> DataFrame:
    """A SQL statement over tables given by name (SRC-41)."""
    return spark.sql(statement, **tables) if tables else spark.sql(statement)
