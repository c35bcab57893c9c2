"""Queries of problems 3 and 5 over the recording tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.operators.intervals import continuous_periods, spans
from quillstream.operators.orphans import find_orphans, orphan_report, references
from quillstream.operators.versions import current_rows, key_history
from quillstream.runtime import table


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    scripts, words, chars, mfcc = (table(spark, sf_dir, t) for t in ("scripts", "words", "chars", "word_mfcc"))
    lines = find_orphans(references(words, "words", "word_id", "script_id"), key_history(scripts, "script_id"), words.select(F.col("script_id").alias("pointer")))
    parts = references(chars, "chars", "char_id", "word_id").unionByName(references(mfcc.withColumn("ref", F.col("word_id")), "word_mfcc", "word_id", "ref"))
    raw = chars.select(F.col("word_id").alias("pointer")).unionByName(mfcc.select(F.col("word_id").alias("pointer")))
    return lines.unionByName(find_orphans(parts, key_history(words, "word_id"), raw))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir).select("child_table", "child_key", "load_month", "orphan_kind")


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_report(_orphans(spark, sf_dir))


def _stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    scripts = current_rows(table(spark, sf_dir, "scripts"), "script_id", ["dataset_id", "audio_file", "script_begin_ts", "script_end_ts"])
    words = current_rows(table(spark, sf_dir, "words"), "word_id", ["dataset_id", "script_id", "word_begin_ts", "word_end_ts"])
    lines = spans(
        scripts.filter(F.col("audio_file").isNotNull() & (F.col("audio_file") != "")),
        [F.lit("scripts").alias("interval_table"), F.col("dataset_id"), F.col("audio_file").alias("entity_key")],
        "script_begin_ts",
        "script_end_ts",
    )
    tokens = spans(
        words.filter(F.col("script_id") >= 1),
        [F.lit("words").alias("interval_table"), F.col("dataset_id"), F.col("script_id")],
        "word_begin_ts",
        "word_end_ts",
    )
    keys = ["interval_table", "dataset_id"]
    told = continuous_periods(tokens, [*keys, "script_id"]).withColumn("entity_key", F.col("script_id").cast("string")).drop("script_id")
    return continuous_periods(lines, [*keys, "entity_key"]).unionByName(told)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _stretches(spark, sf_dir)
    return s.filter((F.col("stretch_kind") == "gap") | F.col("shared")).select(
        "interval_table", "dataset_id", "entity_key", F.when(F.col("stretch_kind") == "gap", "gap").otherwise("merged").alias("stretch_kind"), "begin_ms", "end_ms"
    )


def p5_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All continuous periods, merged or not, and all gaps."""
    return _stretches(spark, sf_dir).select("interval_table", "dataset_id", "entity_key", "stretch_kind", "begin_ms", "end_ms", "shared")


QUERIES = {"p3_found": p3_found, "p3_report": p3_report, "p5_found": p5_found, "p5_periods": p5_periods}

_HISTORY = """
child AS (
  SELECT 'words' AS child_table, word_id AS child_key, arg_max(script_id, loaded_at) AS ptr, min(loaded_at) AS first_at, 'scripts' AS target FROM (SELECT word_id, coalesce(script_id, -9223372036854775807) AS script_id, loaded_at FROM words) GROUP BY word_id
  UNION ALL
  SELECT 'chars', char_id, arg_max(word_id, loaded_at), min(loaded_at), 'words' FROM (SELECT char_id, coalesce(word_id, -9223372036854775807) AS word_id, loaded_at FROM chars) GROUP BY char_id
  UNION ALL
  SELECT 'word_mfcc', word_id, word_id, min(loaded_at), 'words' FROM word_mfcc WHERE word_id IS NOT NULL GROUP BY word_id),
parent AS (
  SELECT 'scripts' AS target, script_id AS pkey, min(loaded_at) AS p_first, arg_max(deleted_at IS NOT NULL, loaded_at) AS gone FROM scripts GROUP BY script_id
  UNION ALL
  SELECT 'words', word_id, min(loaded_at), arg_max(deleted_at IS NOT NULL, loaded_at) FROM words GROUP BY word_id),
orphan AS (
  SELECT child_table, child_key, ptr, strftime(first_at, '%Y-%m') AS load_month,
    CASE WHEN pkey IS NULL THEN 'missing' WHEN gone THEN 'deleted' WHEN p_first > first_at THEN 'late' END AS orphan_kind
  FROM child LEFT JOIN parent ON child.target = parent.target AND child.ptr = parent.pkey
  WHERE child_key IS NOT NULL AND ptr <> -9223372036854775807)
"""
_PERIODS = """
WITH s AS (
  SELECT script_id, arg_max(struct_pack(d := dataset_id, f := audio_file, b := script_begin_ts, e := script_end_ts, x := deleted_at), loaded_at) AS r FROM scripts GROUP BY script_id),
w AS (
  SELECT word_id, arg_max(struct_pack(d := dataset_id, f := script_id, b := word_begin_ts, e := word_end_ts, x := deleted_at), loaded_at) AS r FROM words GROUP BY word_id),
raw AS (
  SELECT 'scripts' AS interval_table, r.d AS dataset_id, r.f AS entity_key, r.b AS b, r.e AS e FROM s WHERE r.x IS NULL AND r.f <> ''
  UNION ALL
  SELECT 'words', r.d, CAST(r.f AS VARCHAR), r.b, r.e FROM w WHERE r.x IS NULL AND r.f >= 1),
span AS (
  SELECT interval_table, dataset_id, entity_key, CAST(floor(b * 1000 + 0.5) AS BIGINT) AS b, CAST(floor(e * 1000 + 0.5) AS BIGINT) AS e
  FROM raw WHERE b IS NOT NULL AND e IS NOT NULL AND NOT isnan(b) AND NOT isnan(e)),
sweep AS (
  SELECT *, max(e) OVER (PARTITION BY interval_table, dataset_id, entity_key ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM span WHERE e > b),
island AS (
  SELECT *, sum(CASE WHEN reach IS NULL OR b > reach THEN 1 ELSE 0 END) OVER (PARTITION BY interval_table, dataset_id, entity_key ORDER BY b, e ROWS UNBOUNDED PRECEDING) AS k FROM sweep),
period AS (
  SELECT interval_table, dataset_id, entity_key, k, min(b) AS begin_ms, max(e) AS end_ms, bool_or(coalesce(b < reach, false)) AS shared FROM island GROUP BY ALL),
stretch AS (
  SELECT interval_table, dataset_id, entity_key, 'period' AS stretch_kind, begin_ms, end_ms, shared FROM period
  UNION ALL
  SELECT * FROM (SELECT interval_table, dataset_id, entity_key, 'gap', lag(end_ms) OVER (PARTITION BY interval_table, dataset_id, entity_key ORDER BY begin_ms) AS g, begin_ms, false FROM period) WHERE g IS NOT NULL)
"""
ORACLE = {
    "p3_found": f"WITH {_HISTORY} SELECT child_table, child_key, load_month, orphan_kind FROM orphan WHERE orphan_kind IS NOT NULL",
    "p3_report": f"WITH {_HISTORY} SELECT child_table, load_month, orphan_kind, count(*) AS n_orphans, count(DISTINCT ptr) AS n_targets FROM orphan WHERE orphan_kind IS NOT NULL GROUP BY ALL",
    "p5_found": f"{_PERIODS} SELECT interval_table, dataset_id, entity_key, CASE stretch_kind WHEN 'gap' THEN 'gap' ELSE 'merged' END AS stretch_kind, begin_ms, end_ms FROM stretch WHERE stretch_kind = 'gap' OR shared",
    "p5_periods": f"{_PERIODS} SELECT interval_table, dataset_id, entity_key, stretch_kind, begin_ms, end_ms, shared FROM stretch",
}
