"""Changes of tables as new DataFrames: nothing is updated in place; the result is written as a new version."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstream.functions import text as X
from quillstream.runtime import Workspace


def upsert(existing: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``new``, and those of ``existing`` whose key isn't among them (DML-01..03)."""
    return existing.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def keyed_update(rows: DataFrame, changes: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``columns`` replaced where ``changes`` (one row a key) has a value (DML-04, DML-05, DML-11, DML-12)."""
    c = changes.select(*keys, *[F.col(x).alias(f"__new_{x}") for x in columns])
    out = rows.join(c, list(keys), "left")
    return out.withColumns({x: F.coalesce(f"__new_{x}", x) for x in columns}).select(*rows.columns)


def unmatched(rows: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Changes that hit no row; a strict update fails if there are any (DML-06)."""
    return changes.join(rows.select(*keys).distinct(), list(keys), "left_anti")


def without(rows: DataFrame, gone: Column) -> DataFrame:
    """Rows for which ``gone`` isn't true (DML-08)."""
    return rows.filter(~F.coalesce(gone, F.lit(False)))


def cascade(children: DataFrame, parents: DataFrame, pointer: str, key: str) -> DataFrame:
    """Children whose parent is still there (DML-07, DML-08)."""
    return children.join(parents.select(F.col(key).alias(pointer)).distinct(), pointer, "left_semi")


def number_rows(rows: DataFrame, key: str, order: Sequence[str], after: int = 0) -> DataFrame:
    """Rows with ``key`` = after + 1, after + 2 ... in a fixed order.

    A range sort and the number of rows in the partitions before, not one
    global window. The sorted rows are written, as a second run of the same
    sort may draw other borders; their partitions' counts (one number a
    partition) come to the driver.
    """
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id())
    space = Workspace(rows.sparkSession, "numbers")
    placed = space.put(placed)
    # One row a partition of the sort.
    w = W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)
    counts = space.put(placed.groupBy("__p").agg(F.count(F.lit(1)).alias("__n")))
    offsets = counts.select("__p", (F.coalesce(F.sum("__n").over(w), F.lit(0)) + after).alias("__before"))
    # Ids of a partition are consecutive from its first on.
    first = (F.col("__p").cast("long") * F.lit(1 << 33)).cast("long")
    return placed.join(offsets, "__p").withColumn(key, (F.col("__before") + F.col("__i") - first + 1).cast("long")).drop("__p", "__i", "__before")


def next_ids(rows: DataFrame, existing: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """New rows with ids after the largest existing one (DML-02)."""
    return number_rows(rows, key, order, existing.agg(F.coalesce(F.max(key), F.lit(0)).cast("long")).first()[0])


def overwrite_filled(old: DataFrame, new: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Headers with the new value of each column where it isn't empty (DML-14, DML-15)."""
    n = new.select(*keys, *[F.col(x).alias(f"__new_{x}") for x in columns])
    out = old.join(n, list(keys), "left")
    return out.withColumns({x: F.coalesce(F.nullif(f"__new_{x}", F.lit("")), x) for x in columns}).select(*old.columns)


def prepared_lines(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New lines as they are stored: the verse's range parsed, script numbers filled with zeros, texts joined, and whether the key is held twice (DML-01).

    ``rows`` has ``verse_str``, ``script_num``, an array ``texts`` and the keys.
    """
    r = X.verse_range(F.col("verse_str"))
    out = rows.withColumns({"verse_str": r["begin"], "verse_end": r["end"], "script_num": X.zero_fill(F.col("script_num")), "script_text": X.smart_join(F.col("texts"))}).drop("texts")
    out = out.withColumn("verse_num", X.leading_int(F.col("verse_str")))
    return out.withColumn("is_duplicate", F.count(F.lit(1)).over(W.partitionBy(*keys)) > 1)


def erased(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Tables with the lines' texts blanked and nothing left of what was made from them (DML-07)."""
    out = {n: t.limit(0) for n, t in tables.items() if n != "scripts"}
    return out | {"scripts": tables["scripts"].withColumn("script_text", F.lit(""))}
