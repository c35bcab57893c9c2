"""Queries of problem 2."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.llm.splitting import oversized, split_recordings
from quillstream.operators.intervals import spans, to_ms
from quillstream.operators.versions import current_rows
from quillstream.runtime import table

KEYS = ["dataset_id", "audio_file"]


def _timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = current_rows(table(spark, sf_dir, "scripts"), "script_id", [*KEYS, "script_begin_ts", "script_end_ts"])
    rows = rows.filter(F.col("audio_file").isNotNull() & (F.col("audio_file") != ""))
    return spans(rows, [F.col(c) for c in (*KEYS, "script_id")], "script_begin_ts", "script_end_ts")


def _limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "run_settings").select("dataset_id", to_ms(F.col("max_piece_sec")).alias("max_ms"), to_ms(F.col("overlap_sec")).alias("overlap_ms"))


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_recordings(_timed(spark, sf_dir), _limits(spark, sf_dir), KEYS, ["dataset_id"])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings that came out in pieces, and their lines that no piece could hold.

    Lines come from the pieces, as those with a hard cut inside; their lengths
    are compared then, as a line below the limit may be cut too.
    """
    limits = _limits(spark, sf_dir)
    cut, torn = oversized(_timed(spark, sf_dir), limits, KEYS, ["dataset_id"])
    files = cut.select(F.lit("file").alias("item_kind"), *KEYS, F.lit(0).cast("long").alias("script_id"))
    long = torn.join(limits, "dataset_id").filter(F.col("e") - F.col("b") > F.col("max_ms"))
    return files.unionByName(long.select(F.lit("line").alias("item_kind"), *KEYS, "script_id"))


QUERIES = {"p2_found": p2_found, "p2_pieces": p2_pieces}

_LINES = """
s AS (SELECT script_id, arg_max(struct_pack(d := dataset_id, f := audio_file, b := script_begin_ts, e := script_end_ts, x := deleted_at), loaded_at) AS r FROM scripts GROUP BY script_id),
t AS (
  SELECT script_id, r.d AS dataset_id, r.f AS audio_file, CAST(floor(r.b * 1000 + 0.5) AS BIGINT) AS b, CAST(floor(r.e * 1000 + 0.5) AS BIGINT) AS e
  FROM s WHERE r.x IS NULL AND r.f <> '' AND r.b IS NOT NULL AND r.e IS NOT NULL AND NOT isnan(r.b) AND NOT isnan(r.e)),
l AS (
  SELECT t.*, CAST(floor(max_piece_sec * 1000 + 0.5) AS BIGINT) AS max_ms, CAST(floor(overlap_sec * 1000 + 0.5) AS BIGINT) AS overlap_ms
  FROM t JOIN run_settings USING (dataset_id) WHERE e > b)
"""
ORACLE = {
    "p2_found": f"""
WITH {_LINES}
SELECT 'file' AS item_kind, dataset_id, audio_file, 0::BIGINT AS script_id FROM l GROUP BY dataset_id, audio_file HAVING max(e) - min(b) > any_value(max_ms)
UNION ALL
SELECT 'line', dataset_id, audio_file, script_id FROM l WHERE e - b > max_ms
""",
    # The greedy cuts one after the other: the farthest boundary within reach, else the full length.
    "p2_pieces": f"""
WITH RECURSIVE {_LINES},
rec AS (
  SELECT dataset_id, audio_file, min(b) AS lo, max(e) AS hi, any_value(max_ms) AS max_ms, least(any_value(overlap_ms), any_value(max_ms) - 1) AS ov
  FROM l GROUP BY dataset_id, audio_file HAVING max(e) - min(b) > any_value(max_ms)),
place AS (SELECT dataset_id, audio_file, b AS at FROM l UNION SELECT dataset_id, audio_file, e FROM l),
ends AS (
  SELECT p.dataset_id, p.audio_file, list(p.at ORDER BY p.at) AS ats FROM place p
  WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.dataset_id = p.dataset_id AND l.audio_file = p.audio_file AND l.b < p.at AND l.e > p.at) GROUP BY ALL),
piece AS (
  SELECT dataset_id, audio_file, 0::BIGINT AS piece_no, lo + ov AS upto, lo AS begin_ms, NULL::VARCHAR AS cut, hi, max_ms, ov, ats FROM rec JOIN ends USING (dataset_id, audio_file)
  UNION ALL
  SELECT dataset_id, audio_file, piece_no + 1, coalesce(best, upto + max_ms - ov), upto - ov, CASE WHEN best IS NULL THEN 'inside' WHEN best = hi THEN 'end' ELSE 'between' END, hi, max_ms, ov, ats
  FROM (SELECT *, list_max(list_filter(ats, lambda x: x > upto AND x <= upto + max_ms - ov)) AS best FROM piece WHERE upto < hi))
SELECT dataset_id, audio_file, piece_no, begin_ms, upto AS end_ms, cut FROM piece WHERE piece_no > 0
""",
}
