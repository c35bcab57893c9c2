"""Statistics and grouping operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstream.runtime import Workspace

# The probabilities of the score report.
QUANTILES = (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 0.995, 0.999, 0.9999)


def moments(df: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    """n, mean, stddev, min, max and the bias-corrected skewness and excess kurtosis; NULL where undefined (AGG-02, AGG-05)."""
    g = df.groupBy(*keys).agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("stddev"), F.min(x).alias("min"), F.max(x).alias("max"),
        F.skewness(x).alias("skew"), F.kurtosis(x).alias("kurt"),
    )
    n = F.col("n").cast("double")
    skew = F.when((F.col("n") > 2) & ~F.isnan("skew"), F.col("skew") * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when((F.col("n") > 3) & ~F.isnan("kurt"), (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("kurt") + 6))
    return g.withColumn("skew", skew).withColumn("kurt", kurt)


def quantiles(df: DataFrame, keys: Sequence[str], x: str, at: Sequence[float] = QUANTILES) -> DataFrame:
    """Exact empirical quantiles (an occurring value), one row for each probability (AGG-05, AGG-07, SRT-04).

    From counts of distinct values, ranked by ranges of the values: a group is
    never gathered in one task.
    """
    n = df.filter(F.col(x).isNotNull()).groupBy(*keys, F.col(x).alias("__x")).agg(F.count(F.lit(1)).alias("__n"))
    w = W.partitionBy(*keys)
    # Ranks by ranges: a window holds one range of one group, and what comes before it is one row a range.
    n = n.repartitionByRange(*keys, "__x").withColumn("__range", F.spark_partition_id())
    n = Workspace(df.sparkSession, "quantiles").put(n)
    ranges = n.groupBy(*keys, "__range").agg(F.sum("__n").alias("__own"))
    ranges = ranges.withColumn("__before", F.coalesce(F.sum("__own").over(w.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("__total", F.sum("__own").over(w)).drop("__own")
    named = [*keys, "__range"]
    ranges = ranges.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(named)], "__before", "__total")
    n = n.join(ranges, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(named)]).drop(*[f"__k{i}" for i in range(len(named))])
    n = n.withColumn("__upto", F.col("__before") + F.sum("__n").over(W.partitionBy(*named).orderBy("__x").rowsBetween(W.unboundedPreceding, 0)))
    n = n.withColumn("p", F.explode(F.array(*[F.lit(float(v)) for v in at])))
    return n.filter(F.col("__upto") >= F.ceil(F.col("p") * F.col("__total"))).groupBy(*keys, "p").agg(F.min("__x").alias("value"))


def histogram(df: DataFrame, keys: Sequence[str], bucket: Column) -> DataFrame:
    """Rows of each bucket and their share of the group in percent (AGG-05)."""
    h = df.groupBy(*keys, bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return h.withColumn("percent", F.col("n") * 100.0 / F.sum("n").over(W.partitionBy(*keys)))


def islands(df: DataFrame, keys: Sequence[str], order: Sequence[str], starts: Column) -> DataFrame:
    """``island``: number of the run a row belongs to; a run begins where ``starts`` holds (AGG-12, AGG-13, AGG-30, WIN-03, WIN-06)."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn("__start", starts).withColumn("island", F.sum(F.col("__start").cast("long")).over(w)).drop("__start")


def share_latin(text: str) -> Column:
    """Whether over 0.9 of all characters are at or below U+024F (AGG-16); NULL texts count for nothing, no characters give false."""
    kept = F.sum(F.length(F.regexp_replace(text, r"[^\x{0000}-\x{024F}]", "")))
    return F.coalesce(kept / F.nullif(F.sum(F.length(text)), F.lit(0)) > 0.9, F.lit(False))
