"""Queries of problem 6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.llm.packing import count_tokens, pack
from quillstream.runtime import table


def p6_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pack_targets").orderBy("capacity_tokens", "target_name").collect()  # never grows
    return pack(count_tokens(table(spark, sf_dir, "documents")), [(r.target_name, r.capacity_tokens) for r in rows])


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, tokens and unused room by target; least_containers is what no packing can go below."""
    bins = p6_packed(spark, sf_dir).groupBy("target_name", "container_id").agg(F.sum("n_tokens").alias("tokens"))
    caps = table(spark, sf_dir, "pack_targets")
    sums = bins.groupBy("target_name").agg(F.count(F.lit(1)).alias("n_containers"), F.sum("tokens").alias("n_tokens")).join(caps, "target_name")
    return sums.select("target_name", "n_containers", "n_tokens", F.ceil(F.col("n_tokens") / F.col("capacity_tokens")).alias("least_containers"), (1 - F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens"))).alias("unused_share"))


QUERIES = {"p6_packed": p6_packed, "p6_report": p6_report}
ORACLE: dict[str, str] = {}
