"""Queries of problem 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.llm.cutoffs import fraction_cutoffs
from quillstream.operators.versions import current_rows
from quillstream.runtime import table


def _cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = None
    for name, key in (("scripts", "script_id"), ("words", "word_id")):
        rows = current_rows(table(spark, sf_dir, name), key, ["dataset_id", "fa_score"]).select(F.lit(name).alias("score_table"), "dataset_id", "fa_score")
        scores = rows if scores is None else scores.unionByName(rows)
    shares = table(spark, sf_dir, "run_settings").select(
        "dataset_id",
        F.explode(F.create_map(F.lit("scripts"), F.col("script_keep_permille"), F.lit("words"), F.col("word_keep_permille"))).alias("score_table", "permille"),
    )
    return fraction_cutoffs(scores, shares, ["score_table", "dataset_id"], "fa_score")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("cutoff") * 1_000_000
    return _cutoffs(spark, sf_dir).select("score_table", "dataset_id", F.when(at < 9e18, F.round(at)).cast("long").alias("cutoff_e6"), "n_kept")


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cutoffs with the counted records and the share really kept (in millionths)."""
    return _cutoffs(spark, sf_dir).withColumn("kept_ppm", F.floor(F.col("n_kept") * 1_000_000 / F.col("n_counted"))).select("score_table", "dataset_id", "n_counted", "cutoff", "n_kept", "kept_ppm")


QUERIES = {"p1_found": p1_found, "p1_report": p1_report}

_BASE = """
WITH s AS (
  SELECT 'scripts' AS score_table, arg_max(struct_pack(d := dataset_id, f := fa_score, x := deleted_at), loaded_at) AS r FROM scripts GROUP BY script_id
  UNION ALL
  SELECT 'words', arg_max(struct_pack(d := dataset_id, f := fa_score, x := deleted_at), loaded_at) FROM words GROUP BY word_id),
v AS (SELECT score_table, r.d AS dataset_id, r.f AS x FROM s WHERE r.x IS NULL AND r.f > 0 AND NOT isnan(r.f)),
p AS (
  SELECT dataset_id, 'scripts' AS score_table, script_keep_permille AS permille FROM run_settings
  UNION ALL SELECT dataset_id, 'words', word_keep_permille FROM run_settings),
n AS (SELECT score_table, dataset_id, count(*) AS n_counted FROM v GROUP BY ALL),
c AS (SELECT score_table, dataset_id, x, sum(count(*)) OVER (PARTITION BY score_table, dataset_id ORDER BY x DESC) AS n_kept FROM v GROUP BY score_table, dataset_id, x),
f AS (
  SELECT score_table, dataset_id, max(x) AS cutoff, min(n_kept)::BIGINT AS n_kept, any_value(n_counted) AS n_counted
  FROM c JOIN n USING (score_table, dataset_id) JOIN p USING (score_table, dataset_id)
  WHERE n_kept * 1000 >= permille * n_counted GROUP BY ALL)
"""
ORACLE = {
    "p1_found": f"{_BASE} SELECT score_table, dataset_id, CAST(round(cutoff * 1000000) AS BIGINT) AS cutoff_e6, n_kept FROM f",
    "p1_report": f"{_BASE} SELECT score_table, dataset_id, n_counted, cutoff, n_kept, n_kept * 1000000 // n_counted AS kept_ppm FROM f",
}
