"""Queries over the text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstream.functions import text as X
from quillstream.functions import unicode as U
from quillstream.model import lines, tokens
from quillstream.plans.current_sql import plain_width, sql
from quillstream.runtime import table


def word_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line, numbered from 1, with the verse number carried on from markers (STR-09, WIN-15, SRC-12)."""
    t = lines(spark, sf_dir, "script_text").filter("script_text is not null").select("script_id", F.posexplode(X.token_list(F.col("script_text"))).alias("pos", "token"))
    t = t.withColumn("ttype", X.token_type(F.col("token")))
    verse = F.when(F.col("ttype") == "V", F.regexp_extract("token", r"\d+", 0).cast("int"))
    w = W.partitionBy("script_id").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    return t.select("script_id", (F.col("pos") + 1).cast("long").alias("word_seq"), "ttype", "token", F.coalesce(F.last(verse, True).over(w), F.lit(0)).cast("long").alias("verse_num"))


def word_freq_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most frequent words of each language label (AGG-27, SRT-01)."""
    t = table(spark, sf_dir, "documents").select("lang", F.explode(X.token_list(F.col("text"))).alias("token"))
    n = t.filter(X.token_type(F.col("token")) == "W").groupBy("lang", F.lower("token").alias("word")).agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy("lang").orderBy(F.desc("n"), "word")
    return n.withColumn("place", F.row_number().over(w).cast("long")).filter("place <= 10")


def text_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comparable forms of every line (STR-01, STR-03)."""
    t, x = lines(spark, sf_dir, "script_text"), F.col("script_text")
    return t.select(
        "script_id", X.without_markers(X.cleanup(x)).alias("bare"),
        X.cleanup(x, prompts=False, punctuation=False, double_quotes="normalize", apostrophes="normalize", hyphens="normalize", lower=False).alias("evened"),
    )


def text_cleanup_nfc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comparable text in composed form (STR-02)."""
    return lines(spark, sf_dir, "script_text").select("script_id", U.normal_form(X.cleanup(F.col("script_text")), "NFC").alias("bare"))


def text_strip_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Romanised stand-in: without combining marks (STR-02, STR-24)."""
    return lines(spark, sf_dir, "script_text").select("script_id", U.romanised(F.col("script_text")).alias("plain"))


def plain_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters a-z only, and the same spaced out (STR-19, STR-23)."""
    t = lines(spark, sf_dir, "uroman").withColumn("plain", X.only_letters(F.col("uroman")))
    return t.select("script_id", "plain", F.regexp_replace(X.spaced(F.col("plain")), " +", " ").alias("spaced"))


def line_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference texts of lines and what they read as (STR-14..18)."""
    t = lines(spark, sf_dir, "book_id", "chapter_num", "chapter_end", "verse_str", "verse_end")
    t = t.withColumn("ref", X.reference(F.col("book_id"), F.col("chapter_num"), F.col("verse_str"), F.col("chapter_end"), F.col("verse_end")))
    p = X.parse_reference(F.col("ref"))
    return t.select("script_id", "ref", p["book_id"].alias("book_id"), p["chapter_num"].cast("long").alias("chapter_num"), p["verse_str"].alias("verse_str"), p["chapter_end"].cast("long").alias("chapter_end"), p["verse_end"].alias("verse_end"))


def number_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verse numbers and zero-filled script numbers (STR-12, STR-13, PRJ-08)."""
    return lines(spark, sf_dir, "verse_str", "script_num").select(
        "script_id", X.leading_int(F.col("verse_str")).cast("long").alias("verse"), X.zero_fill(F.col("script_num")).alias("filled"), F.ltrim("script_num", F.lit("0")).alias("bare")
    )


def spoken_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marker tokens as spoken numbers (STR-20)."""
    t = tokens(spark, sf_dir, "ttype", "word").filter("ttype = 'V'")
    return t.select("word_id", U.number_words(F.regexp_replace("word", r"[{}_]", "")).alias("spoken"))


def chapter_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each chapter's lines joined, spaces only where needed (STR-05, STR-11)."""
    t = lines(spark, sf_dir, "dataset_id", "book_id", "chapter_num", "script_text")
    g = t.groupBy("dataset_id", "book_id", F.col("chapter_num").cast("long").alias("chapter_num"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("script_id", "script_text"))), lambda r: r["script_text"])
    return g.agg(F.count(F.lit(1)).alias("n_lines"), X.smart_join(parts).alias("text"))


def versified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters with verse markers put in and split again (STR-06..08)."""
    t = lines(spark, sf_dir, "dataset_id", "book_id", "chapter_num", "verse_num", "script_text").filter("verse_num > 0 and script_text is not null")
    marked = F.concat(F.lit("{"), F.col("verse_num").cast("string"), F.lit("}"), F.regexp_replace("script_text", r"[{}]", ""))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("script_id", marked.alias("x")))), lambda r: r["x"])
    g = t.groupBy("dataset_id", "book_id", F.col("chapter_num").cast("long").alias("chapter_num")).agg(F.concat_ws(" ", parts).alias("text"))
    return g.select("dataset_id", "book_id", "chapter_num", F.posexplode(X.versify(F.col("text"))).alias("pos", "v")).select("dataset_id", "book_id", "chapter_num", F.col("pos").cast("long").alias("pos"), "v.verse", "v.text")


def clock_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Begin of each line as m:ss and in 20 ms frames (DTM-01, DTM-06)."""
    b = F.col("script_begin_ts")
    return lines(spark, sf_dir, "script_begin_ts").filter(b.isNotNull() & ~F.isnan(b)).select("script_id", X.clock(b).alias("clock"), F.floor(b * 50).cast("long").alias("frame"))


def media_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the file names of recordings say (STR-25..27)."""
    f = lines(spark, sf_dir, "audio_file").select("audio_file").filter("audio_file <> ''").distinct()
    n = X.audio_name(F.col("audio_file"))
    return f.select("audio_file", X.media_type(F.col("audio_file")).alias("kind"), n["testament"].alias("testament"), n["book_number"].cast("long").alias("book_number"), n["chapter"].cast("long").alias("chapter"), n["media_id"].alias("media_id"))


QUERIES = {f.__name__: f for f in (word_tokens, word_freq_topk, text_cleanup, text_cleanup_nfc, text_strip_marks, plain_words, line_references, number_forms, spoken_numbers, chapter_text, versified, clock_labels, media_names)}

_TOKEN = r"(?s)\{\d+\}(?:_\{\d+\})*|[\p{L}\p{N}]+(?:[^\p{L}\p{N}\s{][\p{L}\p{N}]+)*|\s+|."
_TYPE = r"CASE WHEN t LIKE '{%' AND length(t) > 1 THEN 'V' WHEN regexp_matches(t, '^\s') THEN 'S' WHEN regexp_matches(t, '^[\p{L}\p{N}]') THEN 'W' ELSE 'P' END"
_BARE = r"""lower(regexp_replace(script_text, '<<|>>|\(\(|[†\[\]<>]|[,;:.!?~]|["“”«»]|[''ꞌ‘’]|[-‐‑‒–—―﹘﹢﹣－]', '', 'g'))"""
_EVEN = '"' + "''" * 6 + "-" * 10
_UNITS = "['zero','one','two','three','four','five','six','seven','eight','nine','ten','eleven','twelve','thirteen','fourteen','fifteen','sixteen','seventeen','eighteen','nineteen']"
_TENS = "['','twenty','thirty','forty','fifty','sixty','seventy','eighty','ninety']"
_BELOW_100 = f"CASE WHEN {{0}} < 20 THEN {_UNITS}[{{0}} + 1] WHEN {{0}} % 10 = 0 THEN {_TENS}[{{0}} // 10] ELSE {_TENS}[{{0}} // 10] || '-' || {_UNITS}[{{0}} % 10 + 1] END"
_HUNDREDS = f"(CASE WHEN {{0}} < 100 THEN {_BELOW_100} WHEN {{0}} % 100 = 0 THEN {_UNITS}[{{0}} // 100 + 1] || ' hundred' ELSE {_UNITS}[{{0}} // 100 + 1] || ' hundred ' || {_BELOW_100.format('({0} % 100)')} END)"
ORACLE = {
    "word_tokens": sql(
        "SELECT script_id, k AS word_seq, ttype, t AS token, coalesce(last_value(CASE WHEN ttype = 'V' THEN regexp_extract(t, '\\d+')::BIGINT END IGNORE NULLS) OVER (PARTITION BY script_id ORDER BY k ROWS UNBOUNDED PRECEDING), 0) AS verse_num FROM u",
        f"l AS (SELECT script_id, regexp_extract_all(script_text, '{_TOKEN}') AS ts FROM s), x AS (SELECT script_id, unnest(ts) AS t, generate_subscripts(ts, 1)::BIGINT AS k FROM l), u AS (SELECT *, {_TYPE} AS ttype FROM x)",
    ),
    "word_freq_topk": f"WITH x AS (SELECT lang, unnest(regexp_extract_all(text, '{_TOKEN}')) AS t FROM documents), n AS (SELECT lang, lower(t) AS word, count(*) AS n FROM x WHERE {_TYPE} = 'W' GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS place FROM n QUALIFY place <= 10",
    "text_cleanup": sql(rf"SELECT script_id, regexp_replace({_BARE}, '\{{[0-9\-,]+\}}\s?', '', 'g') AS bare, translate(script_text, '«ꞌ‘’ʼ′´‐‑‒–—―﹘﹢﹣－', '{_EVEN}') AS evened FROM s"),
    "text_strip_marks": sql(f"SELECT script_id, lower(strip_accents({plain_width('script_text')})) AS plain FROM s"),
    "spoken_numbers": sql(f"SELECT word_id, CASE WHEN NOT regexp_full_match(x, '[0-9.,:-]+') THEN x WHEN n IS NULL THEN 'zero' WHEN n < 1000 THEN {_HUNDREDS.format('n')} WHEN n % 1000 = 0 THEN {_HUNDREDS.format('(n // 1000)')} || ' thousand' ELSE {_HUNDREDS.format('(n // 1000)')} || ' thousand ' || {_HUNDREDS.format('(n % 1000)')} END AS spoken FROM (SELECT word_id, x, try_cast(regexp_replace(x, '[.,:]', '', 'g') AS BIGINT) AS n FROM (SELECT word_id, regexp_replace(word, '[{{}}_]', '', 'g') AS x FROM w WHERE ttype = 'V'))"),
    "text_cleanup_nfc": sql(f"SELECT script_id, nfc_normalize({_BARE}) AS bare FROM s"),
    "plain_words": sql("SELECT script_id, plain, regexp_replace(regexp_replace(regexp_replace(plain, '(.)', '\\1 ', 'g'), ' +', ' ', 'g'), ' $', '') AS spaced FROM (SELECT script_id, trim(regexp_replace(regexp_replace(lower(replace(uroman, '’', '''')), '[^a-z'' ]', ' ', 'g'), ' +', ' ', 'g')) AS plain FROM s)"),
    "line_references": sql(
        "SELECT script_id, ref, regexp_extract(ref, p, 1) AS book_id, coalesce(try_cast(nullif(regexp_extract(ref, p, 2), '') AS BIGINT), 0) AS chapter_num, regexp_extract(ref, p, 3) AS verse_str, coalesce(try_cast(coalesce(nullif(regexp_extract(ref, p, 4), ''), regexp_extract(ref, p, 2)) AS BIGINT), 0) AS chapter_end, coalesce(nullif(regexp_extract(ref, p, 5), ''), regexp_extract(ref, p, 3)) AS verse_end FROM r",
        r"r AS (SELECT script_id, '^(\S+)(?: (\d+)(?::([^-\s]+)(?:-(?:(\d+):)?(\S+))?)?)?$' AS p, CASE WHEN coalesce(chapter_num, 0) = 0 THEN book_id WHEN coalesce(verse_str, '') = '' THEN book_id || ' ' || chapter_num ELSE book_id || ' ' || chapter_num || ':' || verse_str END || CASE WHEN coalesce(verse_end, '') = '' THEN '' WHEN coalesce(chapter_end, 0) <> 0 AND chapter_end <> chapter_num THEN '-' || chapter_end || ':' || verse_end WHEN verse_end <> verse_str THEN '-' || verse_end ELSE '' END AS ref FROM s)",
    ),
    "number_forms": sql("SELECT script_id, coalesce(try_cast(regexp_extract(verse_str, '^[0-9]+') AS BIGINT), 0) AS verse, repeat('0', greatest(5 - length(regexp_extract(script_num, '^[0-9]*')), 0)) || script_num AS filled, ltrim(script_num, '0') AS bare FROM s"),
    "chapter_text": sql(
        r"SELECT dataset_id, book_id, chapter_num, count(*) AS n_lines, list_reduce(list_prepend('', list(coalesce(script_text, '') ORDER BY script_id)), lambda a, x: CASE WHEN x = '' THEN a WHEN a = '' THEN x WHEN regexp_matches(a, '[\s(\[‘“‹«]$') OR regexp_matches(x, '^[\s?.,:;)\]’”„›»]') THEN a || x ELSE a || ' ' || x END) AS text FROM s GROUP BY dataset_id, book_id, chapter_num"
    ),
    "clock_labels": sql("SELECT script_id, floor(greatest(script_begin_ts - 0.5, 0) / 60)::BIGINT || ':' || floor(greatest(script_begin_ts - 0.5, 0) % 60)::BIGINT AS clock, floor(script_begin_ts * 50)::BIGINT AS frame FROM s WHERE script_begin_ts IS NOT NULL AND NOT isnan(script_begin_ts)"),
    "versified": sql(
        "SELECT dataset_id, book_id, chapter_num, row_number() OVER (PARTITION BY dataset_id, book_id, chapter_num ORDER BY script_id) - 1 AS pos, verse_num::VARCHAR AS verse, trim(regexp_replace(script_text, '[{}]', '', 'g'), ' ') AS text FROM s WHERE verse_num > 0 AND script_text IS NOT NULL"
    ),
    "media_names": sql(
        r"SELECT audio_file, CASE WHEN regexp_matches(lower(audio_file), '\.(mp3|wav|opus|m4a)$') THEN 'audio' ELSE 'unknown' END AS kind, CASE regexp_extract(audio_file, p, 1) WHEN 'A' THEN 'OT' WHEN 'B' THEN 'NT' END AS testament, try_cast(regexp_extract(audio_file, p, 2) AS BIGINT) AS book_number, try_cast(regexp_extract(audio_file, p, 3) AS BIGINT) AS chapter, regexp_extract(audio_file, p, 4) AS media_id FROM f",
        r"f AS (SELECT DISTINCT audio_file, '^([AB])(\d{2})_+(\d+)_+.*?([A-Za-z0-9]+)\.\w+$' AS p FROM s WHERE audio_file <> '')",
    ),
}
