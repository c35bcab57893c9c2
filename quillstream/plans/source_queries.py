"""Queries over the readers' formats, report shapes, streams and requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstream.model import features, lines
from quillstream.plans.current_sql import sql
from quillstream.plans.request import RequestError, parse
from quillstream.runtime import table
from quillstream.sinks import writers as K
from quillstream.sources.readers import line_rows, parse_usfm
from quillstream.streaming import monitor


def usfm_verses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verses of all documents in USFM (SRC-08..11)."""
    d = table(spark, sf_dir, "documents").filter("fmt = 'usfm' and text is not null")
    v = d.select("doc_id", F.posexplode(parse_usfm(F.col("text"))).alias("pos", "v"))
    return v.select("doc_id", F.col("pos").cast("long").alias("pos"), "v.book_id", F.col("v.chapter_num").cast("long").alias("chapter_num"), "v.verse_str", "v.script_text")


def csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of all documents in CSV, usable or not (SRC-05)."""
    # A record ends at a line break outside of quotes.
    record = F.regexp_extract_all("text", F.lit(r'(?:[^"\n]++|"[^"]*+")++'), F.lit(0))
    d = table(spark, sf_dir, "documents").filter("fmt = 'csv' and text <> ''").select("doc_id", F.posexplode(record).alias("pos", "line"))
    c = F.from_csv("line", "book_id string, chapter_num string, verse_str string, script_text string", {"sep": ";", "mode": "PERMISSIVE", "escape": '"'})
    r = line_rows(d.select("doc_id", "pos", c.alias("c")).select("doc_id", "pos", "c.*"))
    return r.select("doc_id", F.col("pos").cast("long").alias("pos"), "book_id", F.col("chapter_num").cast("long").alias("chapter_num"), "verse_str", F.col("verse_num").cast("long").alias("verse_num"), "script_text", "bad")


def asr_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all transcripts with their begin, and the next one's as end (SRC-14, WIN-08)."""
    d = table(spark, sf_dir, "documents").filter("fmt = 'asr' and text <> ''").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).filter("line <> ''")
    p = r"^\[([0-9]+\.[0-9]+)\] ?(.*)$"
    b = F.regexp_extract("line", p, 1).try_cast("double")
    d = d.withColumn("begin_ts", b).withColumn("script_text", F.when(b.isNull(), F.col("line")).otherwise(F.regexp_extract("line", p, 2)))
    end = F.lead("begin_ts").over(W.partitionBy("doc_id").orderBy("pos"))
    return d.select("doc_id", F.col("pos").cast("long").alias("pos"), "begin_ts", F.coalesce(end, F.lit(0.0)).alias("end_ts"), "script_text")


def active_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the columns of lines that hold anything (SNK-04, SNK-05, SNK-08)."""
    t = lines(spark, sf_dir).withColumn("unused", F.lit("")).withColumn("zero", F.lit(0.0))
    return spark.createDataFrame([(c,) for c in K.active_columns(t).columns], "column_name string")


def vector_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All coordinates of vectors as columns (SNK-01, SNK-06)."""
    t = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    return K.wide_vector(t, "embedding", "v", K.vector_width(t, "embedding"))


def matrix_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matrices one line a row with all cells as columns, the sizes on the first (SNK-01, SNK-03, SNK-06)."""
    m = K.matrix_rows(features(spark, sf_dir), "word_id", "mfcc", ["n_rows", "n_cols"])
    m = m.select("word_id", F.col("line").cast("long").alias("line"), F.col("n_rows").cast("long").alias("n_rows"), F.col("n_cols").cast("long").alias("n_cols"), F.col("cells").cast("array<double>").alias("cells"))
    return K.wide_vector(m, "cells", "mfcc", K.vector_width(m, "cells"))


def chapter_file_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each dataset's map from chapters to files, as JSON (SNK-17)."""
    t = lines(spark, sf_dir, "dataset_id", "book_id", "chapter_num", "audio_file").filter("audio_file <> ''").groupBy("dataset_id", "book_id", "chapter_num").agg(F.max("audio_file").alias("audio_file"))
    return K.file_map(t, "book_id", "chapter_num", "audio_file")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queue messages of documents' headers with content keys, repeats counted (SNK-16)."""
    d = table(spark, sf_dir, "documents").select("source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_key"))
    return K.queue_messages(d, "source").groupBy("group", "message_id").agg(F.count(F.lit(1)).alias("n"))


def stream_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Final hours of the event stream (STM-01, SURVEY 7.1 step 11)."""
    return monitor.run_once(spark, monitor.hourly_activity(monitor.event_stream(spark, f"{sf_dir}/events.parquet")), "hours").withColumn("hour", F.date_format("hour", "yyyy-MM-dd HH"))


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Final sessions of the event stream."""
    return monitor.run_once(spark, monitor.user_sessions(monitor.event_stream(spark, f"{sf_dir}/events.parquet")), "sessions").select("user_id", F.col("begin_at").cast("timestamp_ntz").alias("begin_at"), F.col("end_at").cast("timestamp_ntz").alias("end_at"), "n")


def request_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of every dataset's header, checked (REQ-01..05)."""
    rows = []
    for r in table(spark, sf_dir, "ident").orderBy("dataset_id").collect():  # never grows
        text = f"is_new: true\ndataset_name: d{r.dataset_id}\nusername: u\nbible_id: {r.bible_id or ''}\ntext_data:\n  file: x.csv\n"
        try:
            q = parse(text)
            rows.append((r.dataset_id, q["language_iso"], "OK"))
        except RequestError as e:
            rows.append((r.dataset_id, None, str(e)))
    return spark.createDataFrame(rows, "dataset_id long, language_iso string, status string")


QUERIES = {f.__name__: f for f in (usfm_verses, csv_rows, asr_lines, active_columns, vector_columns, matrix_columns, chapter_file_map, messages, stream_hours, stream_sessions, request_plan)}

_CSV = r"(?s)^([^;]*);([^;]*);([^;]*);\"(.*)\"$"
_SPACE = r"[\s\x{00A0}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]"
_TEXTS = ("book_id", "verse_str", "verse_end", "audio_file", "script_num", "usfm_style", "person", "actor", "script_text", "uroman")
_NUMBERS = ("script_id", "dataset_id", "chapter_num", "chapter_end", "verse_num", "script_begin_ts", "script_end_ts", "fa_score")
ORACLE = {
    "active_columns": sql(" UNION ALL ".join(f"SELECT '{c}' AS column_name WHERE EXISTS (SELECT 1 FROM s WHERE {c} <> {z})" for cs, z in ((_TEXTS, "''"), (_NUMBERS, "0")) for c in cs)),
    "csv_rows": f"SELECT doc_id, pos - 1 AS pos, CASE WHEN ok THEN upper(trim(regexp_extract(line, '{_CSV}', 1))) ELSE upper(trim(line)) END AS book_id, try_cast(nullif(regexp_extract(line, '{_CSV}', 2), '') AS BIGINT) AS chapter_num, CASE WHEN ok THEN regexp_extract(line, '{_CSV}', 3) END AS verse_str, coalesce(try_cast(nullif(regexp_extract(line, '{_CSV}', 3), '') AS BIGINT), 0) AS verse_num, CASE WHEN ok THEN regexp_extract(line, '{_CSV}', 4) END AS script_text, try_cast(nullif(regexp_extract(line, '{_CSV}', 2), '') AS BIGINT) IS NULL AS bad FROM (SELECT *, regexp_matches(line, '{_CSV}') AS ok FROM (SELECT doc_id, unnest(p) AS line, generate_subscripts(p, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(text, '(?:[^\"\n]|\"[^\"]*\")+') AS p FROM documents WHERE fmt = 'csv' AND text <> '')))",
    "stream_sessions": "SELECT user_id, min(ts) AS begin_at, max(ts) + INTERVAL 30 MINUTE AS end_at, count(*) AS n FROM (SELECT *, sum(CASE WHEN prev IS NULL OR ts - prev >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)) GROUP BY user_id, k HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR",
    # Chapters and verses in the order of their marks: the last chapter mark before a verse tells its chapter.
    "usfm_verses": rf"WITH m AS (SELECT doc_id, upper(regexp_extract(text, '\\id (\S{{1,3}})', 1)) AS book_id, unnest(ms) AS v, generate_subscripts(ms, 1) AS k FROM (SELECT doc_id, text, regexp_extract_all(text, '\\[cv] [^\\]*') AS ms FROM documents WHERE fmt = 'usfm')), c AS (SELECT *, coalesce(last_value(try_cast(nullif(regexp_extract(v, '^\\c (\d+)', 1), '') AS BIGINT) IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY k ROWS UNBOUNDED PRECEDING), 1) AS chapter_num FROM m), t AS (SELECT doc_id, book_id, chapter_num, k, regexp_extract(v, '^\\v (\S+)', 1) AS verse_str, trim(regexp_replace(regexp_replace(v, '^\\v \S+', ''), '{_SPACE}+', ' ', 'g')) AS script_text FROM c WHERE v LIKE '\v %') SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS pos, book_id, chapter_num, verse_str, script_text FROM t WHERE script_text <> '' UNION ALL SELECT doc_id, 0, '', 1, '0', x FROM (SELECT doc_id, trim(regexp_replace(text, '{_SPACE}+', ' ', 'g')) AS x FROM documents WHERE fmt = 'usfm' AND NOT contains(text, chr(92))) WHERE x <> ''",
    "asr_lines": r"SELECT doc_id, pos, begin_ts, coalesce(lead(begin_ts) OVER (PARTITION BY doc_id ORDER BY pos), 0) AS end_ts, CASE WHEN begin_ts IS NULL THEN line ELSE regexp_extract(line, '^\[([0-9]+\.[0-9]+)\] ?(.*)$', 2) END AS script_text FROM (SELECT doc_id, pos - 1 AS pos, line, try_cast(nullif(regexp_extract(line, '^\[([0-9]+\.[0-9]+)\] ?(.*)$', 1), '') AS DOUBLE) AS begin_ts FROM (SELECT doc_id, unnest(p) AS line, generate_subscripts(p, 1) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents WHERE fmt = 'asr' AND text <> '')) WHERE line <> '')",
    "vector_columns": "SELECT e.vec_id, p.* EXCLUDE (vec_id) FROM embeddings e LEFT JOIN (PIVOT (SELECT vec_id, 'v' || (i - 1) AS name, x::DOUBLE AS x FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)) ON name USING any_value(x) GROUP BY vec_id) p USING (vec_id)",
    "matrix_columns": sql("SELECT r.word_id, r.line, CASE WHEN r.line = 0 THEN n_rows END AS n_rows, CASE WHEN r.line = 0 THEN n_cols END AS n_cols, p.* EXCLUDE (word_id, line) FROM r LEFT JOIN (PIVOT (SELECT word_id, line, 'mfcc' || (i - 1) AS name, x::DOUBLE AS x FROM (SELECT word_id, line, unnest(cells) AS x, generate_subscripts(cells, 1) AS i FROM r)) ON name USING any_value(x) GROUP BY word_id, line) p USING (word_id, line)", "r AS (SELECT word_id, n_rows, n_cols, unnest(mfcc) AS cells, generate_subscripts(mfcc, 1) - 1 AS line FROM m)"),
    "chapter_file_map": sql("SELECT dataset_id, '{' || string_agg('\"' || k || '\":\"' || f || '\"', ',' ORDER BY k) || '}' AS files FROM (SELECT dataset_id, book_id || chapter_num AS k, max(audio_file) AS f FROM s WHERE audio_file <> '' GROUP BY dataset_id, book_id, chapter_num) GROUP BY dataset_id"),
    "messages": "SELECT source AS \"group\", sha256('{' || coalesce('\"source\":\"' || source || '\",', '') || '\"text_key\":\"' || sha256(coalesce(text, '')) || '\"}') AS message_id, count(*) AS n FROM documents GROUP BY ALL",
    "stream_hours": "SELECT strftime(h, '%Y-%m-%d %H') AS hour, event_type, count(*) AS n, sum(round(value * 100)::BIGINT)::BIGINT AS cents FROM (SELECT *, date_trunc('hour', ts) AS h FROM events) WHERE h + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR GROUP BY h, event_type",
    "request_plan": "SELECT dataset_id, CASE WHEN bible_id <> '' THEN lower(substr(bible_id, 1, 3)) END AS language_iso, CASE WHEN bible_id <> '' THEN 'OK' ELSE 'bible_id or language_iso: required' END AS status FROM ident",
}
