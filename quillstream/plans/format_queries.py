"""Queries that write the tables in the sources' formats and read them back, and that list and choose files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstream.model import letters, lines, tokens
from quillstream.plans.current_sql import sql
from quillstream.runtime import table
from quillstream.sinks import writers as K
from quillstream.sinks.xlsx import workbook
from quillstream.sources import files as L
from quillstream.sources import readers as R

CHAPTER = ["dataset_id", "book_id", "chapter_num"]


def _long(*names: str) -> list[Column]:
    return [F.col(n).cast("long").alias(n) for n in names]


def _chapters(rows: DataFrame, item: Column, order: str = "script_id") -> DataFrame:
    """``items`` of each chapter in the order of lines."""
    got = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), item.alias("x"))))
    return rows.groupBy(*CHAPTER).agg(F.transform(got, lambda r: r["x"]).alias("items"))


def _escaped(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def usx_verses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters written as USX with a section heading and a note, and read (SRC-07, PRJ-28)."""
    t = lines(spark, sf_dir, *CHAPTER, "verse_str", "script_text").filter("verse_str <> '0'")
    item = F.concat(F.lit('<verse number="'), "verse_str", F.lit('" style="v"/>'), _escaped(F.coalesce("script_text", F.lit(""))), F.lit('<note style="f"><char style="ft">note</char></note>'))
    c = _chapters(t, item)
    head = F.concat(F.lit('<usx><book code="'), "book_id", F.lit('" style="id"/><chapter number="'), F.col("chapter_num").cast("string"), F.lit('" style="c"/><para style="s">part</para><para style="p">'))
    v = c.select(*CHAPTER, F.posexplode(R.parse_usx(F.concat(head, F.array_join("items", " "), F.lit("</para></usx>")))).alias("pos", "v"))
    return v.select("dataset_id", "book_id", *_long("chapter_num", "pos"), F.col("v.verse_str").alias("verse_str"), F.col("v.script_text").alias("script_text"))


def workbook_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A script workbook for each chapter, written and read (SRC-06, SNK-12)."""
    t = lines(spark, sf_dir, *CHAPTER, "verse_str", "script_num", "person", "actor", "script_text")
    head = ["Bk", "Chapter Number", "Start Verse Number", "Line Number", "Character Group", "Reader Name", "Verse_Content1"]
    cells = F.array("book_id", F.col("chapter_num").cast("string"), "verse_str", "script_num", "person", "actor", "script_text")
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("content", T.BinaryType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [workbook([head, *rows]) for rows in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], names=["path", "content"])

    c = _chapters(t, cells).select(F.concat_ws("/", *CHAPTER).alias("path"), "items")
    r = R.workbook_lines(c.mapInArrow(work, schema))
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return r.select("path", "book_id", *_long("chapter_num", "verse_num"), text("verse_str"), text("script_num"), text("person"), text("actor"), text("script_text"))


def _first_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lines(spark, sf_dir, *CHAPTER, "verse_num", "script_text").filter("verse_num is not null")
    return t.groupBy(*CHAPTER, "verse_num").agg(F.min_by(F.coalesce("script_text", F.lit("")), "script_id").alias("script_text"))


def json_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain-text documents of JSON, written and read in the order of books (SRC-12)."""
    t = _first_texts(spark, sf_dir)
    item = F.struct("book_id", F.col("chapter_num").alias("chapter"), F.col("verse_num").alias("verse_start"), F.col("verse_num").alias("verse_end"), F.replace(F.col("script_text"), F.lit("<"), F.lit("&lt")).alias("verse_text"))
    d = _chapters(t, item, "verse_num").select("dataset_id", F.to_json(F.struct(F.col("items").alias("data"))).alias("json"))
    r = R.json_lines(d, table(spark, sf_dir, "books"), keys=["dataset_id"])
    return r.select("dataset_id", "book_id", *_long("seq", "chapter_num", "verse_num"), "verse_str", "script_num", "script_text")


def timing_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timing files of chapters, written and read, with verse 0 before the first (SRC-20, SRC-31)."""
    t = lines(spark, sf_dir, *CHAPTER, "verse_str", "script_begin_ts", "script_end_ts").filter("script_end_ts > script_begin_ts and not isnan(script_end_ts) and verse_str is not null and verse_str <> ''")
    row = F.concat_ws("\t", F.col("script_begin_ts").cast("string"), F.col("script_end_ts").cast("string"), F.concat(F.lit("0"), "verse_str"))
    c = F.from_csv(row, "begin_ts double, end_ts double, verse string", {"sep": "\t"})
    r = R.timing_rows(t.select(F.concat_ws("/", *CHAPTER).alias("path"), c.alias("r")).select("path", "r.*"))
    return r.select("path", "begin_ts", "end_ts", "verse")


def aligner_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A word aligner's answers for words with letters, written and read (SRC-16)."""
    c = letters(spark, sf_dir, "word_id", "uroman", "start_ts", "end_ts", "fa_score").filter("length(uroman) = 1 and word_id is not null and start_ts is not null and end_ts is not null")
    frame = lambda t: F.floor(F.col(t) * 50 + 0.5).cast("double")
    row = F.struct("char_id", F.ascii("uroman").alias("token"), F.array(F.ascii("uroman").cast("double"), frame("start_ts"), frame("end_ts"), "fa_score").alias("t"))
    w = c.groupBy("word_id").agg(F.array_sort(F.collect_list(row)).alias("r"))
    codes = F.array_distinct(F.transform("r", lambda x: x["token"]))
    answer = F.to_json(F.struct(F.lit(0.02).alias("ratio"), F.map_from_arrays(F.transform(codes, lambda x: F.chr(x)), codes).alias("dictionary"), F.array(F.transform("r", lambda x: x["t"])).alias("tokens")))
    a = w.select("word_id", F.explode(R.aligned_letters(answer)).alias("a"))
    return a.select("word_id", *[F.col(f"a.{n}").cast("long").alias(n) for n in ("word_pos", "seq")], "a.letter", "a.start_ts", "a.end_ts", "a.score")


def heard_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character recognition answers of words, written and read (SRC-17)."""
    c = letters(spark, sf_dir, "word_id", "uroman", "start_ts").filter("length(uroman) = 1 and word_id is not null")
    w = c.groupBy("word_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("char_id", "uroman", "start_ts"))), lambda r: F.struct(F.ascii(r["uroman"]).alias("ch"), r["start_ts"].alias("ts"))).alias("r"))
    a = w.select("word_id", F.posexplode(R.letter_times(F.to_json("r"))).alias("pos", "a"))
    return a.select("word_id", *_long("pos"), "a.letter", "a.ts")


def line_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line aligner's answers for chapters, whose numbers are texts, written and read (SRC-18)."""
    t = lines(spark, sf_dir, *CHAPTER, "script_text", "script_begin_ts", "script_end_ts").filter("script_begin_ts is not null and script_end_ts is not null and not isnan(script_begin_ts) and not isnan(script_end_ts)")
    item = F.struct(F.col("script_id").cast("string").alias("id"), F.col("script_begin_ts").cast("string").alias("begin"), F.col("script_end_ts").cast("string").alias("end"), F.lit("eng").alias("language"), F.array(F.coalesce("script_text", F.lit(""))).alias("lines"))
    f = _chapters(t, item).select(*CHAPTER, F.posexplode(R.fragments(F.to_json(F.struct(F.col("items").alias("fragments"))))).alias("pos", "f"))
    return f.select("dataset_id", "book_id", *_long("chapter_num", "pos"), "f.id", "f.begin_ts", "f.end_ts", "f.text")


def manifest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests of chapters with every line's begin and text, joined to the lines by position (SRC-15)."""
    t = lines(spark, sf_dir, *CHAPTER, "script_text", "script_begin_ts").filter("script_begin_ts is not null and not isnan(script_begin_ts) and dataset_id is not null and book_id is not null and chapter_num is not null")
    item = F.to_json(F.struct(F.col("script_begin_ts").alias("audio_start_sec"), F.coalesce("script_text", F.lit("")).alias("text"), F.lit(1.0).alias("duration")))
    name = F.concat_ws("-", *CHAPTER).alias("manifest")
    m = _chapters(t, item).select(name, F.array_join("items", "\n").alias("value"))
    r = R.manifest_lines(m, t.select("script_id", name), "script_id")
    return r.select("manifest", *_long("pos"), "script_id", F.floor(F.col("audio_start_sec") * 1000 + 0.5).alias("start_ms"), "text", "matched")


def known_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of low score as lines of a known-error file, read (SRC-28)."""
    w = tokens(spark, sf_dir, "script_id", "word_seq", "ttype", "uroman", "fa_score").filter("ttype = 'W' and fa_score < 0.1 and regexp_like(uroman, '^[a-z]+$')")
    row = F.concat(F.lit("K "), F.coalesce(F.col("script_id").cast("string"), F.lit("")), F.lit(" , "), F.col("word_seq").cast("string"), F.lit(","), "uroman", F.lit(" , low"))
    r = R.known_errors(w.select("word_id", row.alias("value")))
    return r.select("word_id", "reference", *_long("word_seq"), "word", "type")


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = table(spark, sf_dir, "ident")
    fs = lambda c, kind, size: F.when(F.col(c) != "", F.struct(F.col(c).alias("id"), F.lit(kind).alias("type"), F.lit(size).alias("size"), F.lit("MP3").alias("codec"), F.lit("64kbps").alias("bitrate")))
    sets = F.array_compact(F.array(fs("audio_ot_id", "audio", "OT"), fs("audio_nt_id", "audio", "NT"), fs("text_ot_id", "text_plain", "OT"), fs("text_nt_id", "text_plain", "NT")))
    data = F.struct(F.col("dataset_id").cast("string").alias("abbr"), F.col("language_iso").alias("iso"), F.create_map(F.lit("prod"), sets).alias("filesets"))
    return R.catalog_filesets(i.select(F.to_json(F.struct(data.alias("data"))).alias("json")))


def catalog_filesets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File sets of catalog answers (SRC-23, SRC-24, SRC-32)."""
    return _catalog(spark, sf_dir).select(F.col("abbr").cast("long").alias("dataset_id"), F.coalesce("iso", F.lit("")).alias("iso"), "site", *_long("pos"), "id", "type", "size")


def chosen_filesets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The New Testament's recording of each dataset, in the first codec asked for (PRJ-25, PRJ-26)."""
    return R.choose_fileset(_catalog(spark, sf_dir), ["audio", "audio_drama"], "NT", "mp3", "3kbps").select(F.col("abbr").cast("long").alias("dataset_id"), "id", "type")


def available_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Datasets with a recording and a text in the catalog (PRJ-31)."""
    return R.available(_catalog(spark, sf_dir), ["audio", "text_plain"]).select(F.col("abbr").cast("long").alias("dataset_id"))


def _objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recordings of lines as objects of a store, with the lines' number as size and their first arrival."""
    t = table(spark, sf_dir, "scripts").filter("audio_file <> '' and dataset_id is not null")
    path = F.concat(F.lit("s3://store/set"), F.col("dataset_id").cast("string"), F.lit("/audio/"), "audio_file")
    return t.groupBy("dataset_id", path.alias("path")).agg(F.countDistinct("script_id").alias("length"), F.min("loaded_at").alias("modified"))


def matched_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects below a place whose name has a pattern's end (SRC-21, SRC-37)."""
    m = L.matching(_objects(spark, sf_dir), "s3://store/set1/audio/*.mp3")
    own = L.owner_ids(F.col("path"))
    return m.select("path", own["bible_id"].alias("bible_id"), own["media_id"].alias("media_id"), "length")


def input_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings of the New Testament as input files (PRJ-29, SRC-34..36)."""
    f = L.input_files(_objects(spark, sf_dir), ["NT"])
    return f.select("path", "file_name", "media_type", F.coalesce("testament", F.lit("")).alias("testament"), *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("book_number", "chapter")])


def url_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of downloads in the order of their files' names (SRT-05, SRC-44)."""
    o = _objects(spark, sf_dir).withColumn("url", F.concat(F.lit("https://host/a/"), "dataset_id", F.lit("/"), L.file_name(F.col("path")), F.lit("?key=1/2")))
    first = o.groupBy("dataset_id").agg(F.min(F.struct(L.url_file(F.col("url")).alias("name"), "path")).alias("a"), F.max(F.struct(L.url_file(F.col("url")).alias("name"), "path")).alias("z"))
    return first.select("dataset_id", F.col("a.name").alias("first_file"), F.col("z.name").alias("last_file"))


def oldest_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The object of each dataset that came first (SRT-07, SRC-40)."""
    return L.oldest(_objects(spark, sf_dir), ["dataset_id"]).select("dataset_id", "path", "length")


def object_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of the timing files of the New Testament's chapters (SRC-22)."""
    b = table(spark, sf_dir, "books").filter("testament = 'NT'").select("book_id", F.col("seq").cast("long").alias("seq"))
    first = b.agg(F.min("seq")).first()[0] or 1
    i = table(spark, sf_dir, "ident").filter("length(audio_nt_id) >= 8").select("dataset_id", "audio_nt_id")
    c = lines(spark, sf_dir, *CHAPTER).select(*CHAPTER).distinct().join(b, "book_id").join(i, "dataset_id")
    return c.select("dataset_id", "book_id", *_long("chapter_num"), L.aligner_key(F.col("book_id"), F.col("seq"), F.col("chapter_num"), first - 1).alias("aligner_key"), L.cue_key(F.col("audio_nt_id"), F.col("book_id"), F.col("chapter_num"), F.lit(0)).alias("cue_key"))


def fileset_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File sets with the number of their objects of each kind (SRC-33)."""
    i = table(spark, sf_dir, "ident").filter("audio_nt_id <> ''").select("dataset_id", F.col("audio_nt_id").alias("fileset"))
    t = lines(spark, sf_dir, "dataset_id", "audio_file", "script_end_ts").filter("audio_file <> ''").join(i, "dataset_id")
    kind = F.when(F.col("script_end_ts") > 0, "timings").otherwise("untimed")
    o = t.select(F.concat_ws("/", F.lit("s3://store"), kind, "fileset", "audio_file").alias("path")).distinct()
    return L.with_object_counts(i, o, "fileset", ["timings", "untimed", "scripts"]).select("dataset_id", "fileset", "n_timings", "n_untimed", "n_scripts")


def downloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects to be fetched, when those of odd size are there and others in another size (SRC-26, REQ-15)."""
    o = _objects(spark, sf_dir)
    name = F.concat(F.lit("r/"), F.col("dataset_id").cast("string"), F.lit("_"), L.file_name(F.col("path")))
    remote = o.select(name.alias("path"), "length")
    return L.to_download(remote, remote.withColumn("length", F.col("length") + F.when(F.col("length") % 2 == 1, 0).otherwise(1))).select("path", "length", *_long("place"))


def pair_list_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pair lists of chapters, one with lines that are missing on either side, read (SRC-27)."""
    t = lines(spark, sf_dir, *CHAPTER, "script_text")
    side = lambda known: F.struct(F.when(known, F.col("script_id")).otherwise(F.lit(0)).alias("script_id"), F.when(known, F.col("book_id")).alias("book_id"), F.when(known, F.col("chapter_num")).alias("chapter_num"), F.when(known, F.col("script_text")).alias("text"))
    item = F.struct(side(F.col("script_id") % 3 != 0).alias("base"), side(F.col("script_id") % 3 != 1).alias("comp"), F.length("script_text").cast("long").alias("n"))
    p = R.pair_list(_chapters(t, item).select("dataset_id", F.to_json("items").alias("json")), keys=["dataset_id"])
    return p.select("dataset_id", "script_id", "book_id", *_long("chapter_num"), "base_text", "comp_text", "n")


def positional_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool codes of languages as lines with tabs, read by position (SRC-29)."""
    t = table(spark, sf_dir, "languages")
    row = F.concat_ws("\t", *[F.coalesce(c, F.lit("")) for c in ("id", "lang_name", "iso639_3", "iso639_1", "espeak")])
    return R.by_position(t.select(F.lit(1).alias("pos"), row.alias("value")), ["id", None, "iso639_3", None, "espeak"], header=True).drop("pos")


def language_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language tree as JSON lines with all codes, read as an adjacency list (SRC-30, SET-06)."""
    t = table(spark, sf_dir, "languages")
    n = R.language_nodes(K.as_json(t.withColumns({c: F.coalesce(c, F.lit("")) for c in ("family_id", "parent_id")})))
    return n.select("id", "family_id", "parent_id", "lang_name", "node_kind", "iso639_3", "iso639_1")


def sql_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statement over named tables (SRC-41)."""
    return R.query(spark, {"lines": lines(spark, sf_dir, "dataset_id", "script_text")}, "SELECT dataset_id, count(*) AS n, count(script_text) AS n_texts FROM {lines} GROUP BY dataset_id")


def stored_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors fetched by index (SRC-42)."""
    return R.items_at(table(spark, sf_dir, "embeddings").select("vec_id", F.size("embedding").cast("long").alias("width")), "vec_id", [0, 1, 7, 100, 10**12])


def zipped_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive of texts for each chapter, with a hidden file, written and read (SNK-20, SRC-39)."""
    t = lines(spark, sf_dir, *CHAPTER, "script_text").filter("script_text is not null")
    item = F.struct(F.concat(F.lpad(F.col("script_id").cast("string"), 12, "0"), F.lit(".txt")).alias("name"), F.col("script_text").alias("text"))
    z = _chapters(t, item).select(*CHAPTER, F.posexplode(R.unzipped(K.zipped(F.concat("items", F.array(F.struct(F.lit("in/.hidden").alias("name"), F.lit("x").alias("text"))))))).alias("pos", "f"))
    return z.select("dataset_id", "book_id", *_long("chapter_num", "pos"), "f.name", F.decode("f.content", "UTF-8").alias("text"))


def short_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores in the shortest form of 32 bits (SNK-02)."""
    return tokens(spark, sf_dir, "fa_score").filter("fa_score is not null and not isnan(fa_score)").select("word_id", K.short_number(F.col("fa_score")).cast("double").alias("score"))


def run_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next run's number of each dataset's folder (SNK-14)."""
    r = table(spark, sf_dir, "run_settings")
    p = r.select(F.explode(F.array(*[F.format_string(f"u%d/d%d/%05d/{k}", F.col("dataset_id") % 3, F.col("dataset_id"), F.col("dataset_id") + n) for k, n in (("csv", 0), ("json", 9), ("csv", 4))])).alias("path"))
    return K.next_run(p.unionByName(p.select(F.lit("u9/new/readme").alias("path")).distinct())).select("user", "dataset", *_long("run"))


def merged_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of two kinds merged by their number (SNK-12)."""
    t = lines(spark, sf_dir, "verse_str").select("script_id", F.coalesce("verse_str", F.lit("")).alias("verse_str"))
    return K.merged_pairs([t, t.filter("verse_str <> '0'")], "script_id").select("script_id", "verse_str", *_long("list_no", "place"))


def proof_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with their letters marked by class, as the proofing report has them (SNK-11, SNK-19)."""
    c = letters(spark, sf_dir, "word_id", "uroman", "fa_score").filter("word_id is not null and uroman is not null")
    kind = F.when(F.col("fa_score") < 0.2, "critical").when(F.col("fa_score") < 0.6, "question").otherwise("")
    w = c.groupBy("word_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("char_id", F.col("uroman").alias("text"), kind.alias("kind")))), lambda r: F.struct(r["text"].alias("text"), r["kind"].alias("kind"))).alias("parts"))
    return w.select("word_id", K.highlighted(F.col("parts")).alias("html"))


def status_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses of datasets as JSON lines among other lines, read (SNK-09, JSN-01, REQ-14)."""
    from quillstream.functions.normalise import error_lines

    i = table(spark, sf_dir, "ident")
    code = F.when(F.coalesce("bible_id", F.lit("")) == "", 400).otherwise(200)
    line = F.when(F.col("dataset_id") % 4 == 0, F.lit("plain line")).otherwise(K.status_json(code, F.concat(F.lit('text "'), F.coalesce("bible_id", F.lit("")), F.lit('"')), F.lit("trace")))
    e = i.select("dataset_id", error_lines(line).alias("e"))
    return e.select("dataset_id", F.col("e.status").cast("long").alias("status"), F.col("e.message").alias("message"))


QUERIES = {
    f.__name__: f
    for f in (
        usx_verses, workbook_lines, json_documents, timing_files, aligner_letters, heard_letters, line_fragments, manifest_rows, known_errors, catalog_filesets, chosen_filesets, available_datasets,
        matched_objects, input_list, url_places, oldest_objects, object_keys, fileset_objects, downloads, pair_list_rows, positional_rows, language_nodes, sql_rows, stored_items, zipped_texts,
        short_scores, run_folders, merged_lists, proof_rows, status_rows,
    )
}

_BLANK = r"[\s\x{00A0}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]"
_BODY = f"trim(replace(replace(regexp_replace(coalesce(script_text, ''), '{_BLANK}+', ' ', 'g'), '{{', '('), '}}', ')'))"
_O = "o AS (SELECT dataset_id, 's3://store/set' || dataset_id || '/audio/' || audio_file AS path, audio_file, count(DISTINCT script_id) AS length, min(loaded_at) AS modified FROM scripts WHERE audio_file <> '' AND dataset_id IS NOT NULL GROUP BY ALL)"
_FS = "f AS (SELECT dataset_id, coalesce(language_iso, '') AS iso, 'prod' AS site, row_number() OVER (PARTITION BY dataset_id ORDER BY k) - 1 AS pos, id, type, size FROM (SELECT dataset_id, language_iso, 1 AS k, audio_ot_id AS id, 'audio' AS type, 'OT' AS size FROM ident UNION ALL SELECT dataset_id, language_iso, 2, audio_nt_id, 'audio', 'NT' FROM ident UNION ALL SELECT dataset_id, language_iso, 3, text_ot_id, 'text_plain', 'OT' FROM ident UNION ALL SELECT dataset_id, language_iso, 4, text_nt_id, 'text_plain', 'NT' FROM ident) WHERE id <> '')"
_TWO = "lpad(CAST({0} AS VARCHAR), CAST(greatest(length(CAST({0} AS VARCHAR)), {1}) AS INTEGER), '0')"
_NAME = r"^([AB])(\d{2})_+(\d+)_+.*?([A-Za-z0-9]+)\.\w+$"
ORACLE = {
    "usx_verses": sql(f"SELECT dataset_id, book_id, chapter_num, row_number() OVER (PARTITION BY dataset_id, book_id, chapter_num ORDER BY script_id) - 1 AS pos, verse_str, body AS script_text FROM (SELECT *, {_BODY} AS body FROM s WHERE verse_str <> '0') WHERE body <> ''"),
    "workbook_lines": sql("SELECT dataset_id || '/' || book_id || '/' || chapter_num AS path, upper(trim(book_id)) AS book_id, chapter_num, coalesce(try_cast(nullif(regexp_extract(verse_str, '^[0-9]+'), '') AS BIGINT), 0) AS verse_num, coalesce(trim(verse_str), '') AS verse_str, coalesce(script_num, '') AS script_num, coalesce(person, '') AS person, coalesce(actor, '') AS actor, coalesce(script_text, '') AS script_text FROM s"),
    "json_documents": sql("SELECT dataset_id, book_id, seq, chapter_num, verse_num, CAST(verse_num AS VARCHAR) AS verse_str, CAST(row_number() OVER (PARTITION BY dataset_id, book_id ORDER BY chapter_num, verse_num) AS VARCHAR) AS script_num, x AS script_text FROM (SELECT dataset_id, book_id, chapter_num, verse_num, arg_min(coalesce(script_text, ''), script_id) AS x FROM s WHERE verse_num IS NOT NULL GROUP BY ALL) JOIN (SELECT book_id, seq FROM books WHERE testament IN ('OT', 'NT')) USING (book_id)"),
    "timing_files": sql("SELECT dataset_id || '/' || book_id || '/' || chapter_num AS path, begin_ts, end_ts, verse FROM (SELECT dataset_id, book_id, chapter_num, script_begin_ts AS begin_ts, script_end_ts AS end_ts, coalesce(nullif(ltrim(verse_str, '0'), ''), '0') AS verse FROM t UNION ALL SELECT dataset_id, book_id, chapter_num, 0.0, min(script_begin_ts), '0' FROM t GROUP BY ALL)", "t AS (SELECT * FROM s WHERE script_end_ts > script_begin_ts AND NOT isnan(script_end_ts) AND verse_str <> '')"),
    "aligner_letters": sql("SELECT word_id, 0 AS word_pos, row_number() OVER (PARTITION BY word_id ORDER BY char_id) - 1 AS seq, uroman AS letter, round(floor(start_ts * 50 + 0.5) * 0.02, 3) AS start_ts, round(floor(end_ts * 50 + 0.5) * 0.02, 3) AS end_ts, fa_score AS score FROM c WHERE length(uroman) = 1 AND word_id IS NOT NULL AND start_ts IS NOT NULL AND end_ts IS NOT NULL"),
    "heard_letters": sql("SELECT word_id, row_number() OVER (PARTITION BY word_id ORDER BY char_id) - 1 AS pos, uroman AS letter, start_ts AS ts FROM c WHERE length(uroman) = 1 AND word_id IS NOT NULL"),
    "line_fragments": sql("SELECT dataset_id, book_id, chapter_num, row_number() OVER (PARTITION BY dataset_id, book_id, chapter_num ORDER BY script_id) - 1 AS pos, CAST(script_id AS VARCHAR) AS id, script_begin_ts AS begin_ts, script_end_ts AS end_ts, coalesce(script_text, '') AS text FROM s WHERE script_begin_ts IS NOT NULL AND script_end_ts IS NOT NULL AND NOT isnan(script_begin_ts) AND NOT isnan(script_end_ts)"),
    "manifest_rows": sql("SELECT dataset_id || '-' || book_id || '-' || chapter_num AS manifest, row_number() OVER (PARTITION BY dataset_id, book_id, chapter_num ORDER BY script_id) AS pos, script_id, CAST(floor(round(script_begin_ts, 3) * 1000 + 0.5) AS BIGINT) AS start_ms, coalesce(script_text, '') AS text, true AS matched FROM s WHERE NOT isnan(script_begin_ts) AND dataset_id IS NOT NULL AND book_id IS NOT NULL AND chapter_num IS NOT NULL"),
    "known_errors": sql("SELECT word_id, trim('K ' || coalesce(CAST(script_id AS VARCHAR), '')) AS reference, word_seq, uroman AS word, 'low' AS type FROM w WHERE ttype = 'W' AND fa_score < 0.1 AND regexp_full_match(uroman, '[a-z]+')"),
    "catalog_filesets": f"WITH {_FS} SELECT dataset_id, iso, site, pos, id, type, size FROM f",
    "chosen_filesets": f"WITH {_FS} SELECT dataset_id, id, type FROM f WHERE type = 'audio' AND size = 'NT'",
    "available_datasets": f"WITH {_FS} SELECT dataset_id FROM f GROUP BY dataset_id HAVING count(DISTINCT type) = 2",
    "matched_objects": rf"WITH {_O} SELECT path, 'set' || dataset_id AS bible_id, 'audio' AS media_id, length FROM o WHERE dataset_id = 1 AND regexp_matches(audio_file, '.\.mp3$')",
    "input_list": rf"WITH {_O} SELECT path, audio_file AS file_name, CASE WHEN regexp_matches(lower(audio_file), '\.(mp3|wav|opus|m4a)$') THEN 'audio' ELSE 'unknown' END AS media_type, CASE regexp_extract(audio_file, '{_NAME}', 1) WHEN 'A' THEN 'OT' WHEN 'B' THEN 'NT' ELSE '' END AS testament, coalesce(try_cast(nullif(regexp_extract(audio_file, '{_NAME}', 2), '') AS BIGINT), 0) AS book_number, coalesce(try_cast(nullif(regexp_extract(audio_file, '{_NAME}', 3), '') AS BIGINT), 0) AS chapter FROM o WHERE audio_file NOT LIKE '.%' AND regexp_extract(audio_file, '{_NAME}', 1) <> 'A'",
    "url_places": f"WITH {_O} SELECT dataset_id, min(audio_file) AS first_file, max(audio_file) AS last_file FROM o GROUP BY dataset_id",
    "oldest_objects": f"WITH {_O} SELECT dataset_id, path, length FROM o QUALIFY row_number() OVER (PARTITION BY dataset_id ORDER BY modified, path) = 1",
    "object_keys": sql(f"SELECT dataset_id, book_id, chapter_num, 'C01-' || {_TWO.format('n', 2)} || '-' || book_id || '-' || {_TWO.format('chapter_num', 2)} || '-timing.txt' AS aligner_key, substr(audio_nt_id, 7, 2) || '_' || substr(audio_nt_id, 1, 3) || '_' || substr(audio_nt_id, 4, 3) || '_' || {_TWO.format('chapter_num', 3)} || '_' || book_id || '_' || {_TWO.format('chapter_num', 2)} || '_cue_info.txt' AS cue_key FROM (SELECT DISTINCT dataset_id, book_id, chapter_num FROM s) JOIN (SELECT book_id, seq - (SELECT min(seq) FROM books WHERE testament = 'NT') + 1 AS n FROM books WHERE testament = 'NT') USING (book_id) JOIN (SELECT dataset_id, audio_nt_id FROM ident WHERE length(audio_nt_id) >= 8) USING (dataset_id)"),
    "fileset_objects": sql("SELECT dataset_id, fileset, count(DISTINCT CASE WHEN timed THEN audio_file END) AS n_timings, count(DISTINCT CASE WHEN NOT timed THEN audio_file END) AS n_untimed, 0::BIGINT AS n_scripts FROM (SELECT dataset_id, audio_nt_id AS fileset FROM ident WHERE audio_nt_id <> '') LEFT JOIN (SELECT dataset_id, audio_file, coalesce(script_end_ts > 0, false) AS timed FROM s WHERE audio_file <> '') USING (dataset_id) GROUP BY ALL"),
    "downloads": f"WITH {_O} SELECT 'r/' || dataset_id || '_' || audio_file AS path, length, 1::BIGINT AS place FROM o WHERE length % 2 = 0",
    "pair_list_rows": sql("SELECT dataset_id, script_id, book_id, chapter_num, CASE WHEN script_id % 3 <> 0 THEN coalesce(script_text, '') ELSE '' END AS base_text, CASE WHEN script_id % 3 <> 1 THEN coalesce(script_text, '') ELSE '' END AS comp_text, length(script_text) AS n FROM s"),
    "positional_rows": "SELECT id, coalesce(iso639_3, '') AS iso639_3, coalesce(espeak, '') AS espeak FROM languages",
    "language_nodes": "SELECT id, nullif(family_id, '') AS family_id, nullif(parent_id, '') AS parent_id, lang_name, node_kind, iso639_3, iso639_1 FROM languages",
    "sql_rows": sql("SELECT dataset_id, count(*) AS n, count(script_text) AS n_texts FROM s GROUP BY dataset_id"),
    "stored_items": "SELECT vec_id, len(embedding) AS width FROM embeddings WHERE vec_id IN (0, 1, 7, 100, 1000000000000)",
    "zipped_texts": sql("SELECT dataset_id, book_id, chapter_num, row_number() OVER (PARTITION BY dataset_id, book_id, chapter_num ORDER BY script_id) - 1 AS pos, lpad(CAST(script_id AS VARCHAR), 12, '0') || '.txt' AS name, script_text AS text FROM s WHERE script_text IS NOT NULL"),
    "short_scores": sql("SELECT word_id, CAST(CAST(CAST(fa_score AS FLOAT) AS VARCHAR) AS DOUBLE) AS score FROM w WHERE fa_score IS NOT NULL AND NOT isnan(fa_score)"),
    "run_folders": "SELECT 'u' || (dataset_id % 3) AS \"user\", 'd' || dataset_id AS dataset, dataset_id + 10 AS run FROM run_settings UNION ALL SELECT DISTINCT 'u9', 'new', 1 FROM run_settings",
    "merged_lists": sql("SELECT script_id, coalesce(verse_str, '') AS verse_str, 0 AS list_no, 1 AS place FROM s UNION ALL SELECT script_id, verse_str, 1, 2 FROM s WHERE coalesce(verse_str, '') <> '0'").replace("SELECT script_id, verse_str, 1, 2", "SELECT script_id, coalesce(verse_str, ''), 1, 2"),
    "proof_rows": sql("SELECT word_id, string_agg(CASE WHEN fa_score < 0.2 THEN '<span class=critical>' || t || '</span>' WHEN fa_score < 0.6 THEN '<span class=question>' || t || '</span>' ELSE t END, '' ORDER BY char_id) AS html FROM (SELECT *, replace(replace(replace(uroman, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS t FROM c WHERE word_id IS NOT NULL AND uroman IS NOT NULL) GROUP BY word_id"),
    "status_rows": "SELECT dataset_id, CASE WHEN dataset_id % 4 <> 0 THEN CASE WHEN coalesce(bible_id, '') = '' THEN 400 ELSE 200 END END AS status, CASE WHEN dataset_id % 4 <> 0 THEN 'text \"' || coalesce(bible_id, '') || '\"' END AS message FROM ident",
}
