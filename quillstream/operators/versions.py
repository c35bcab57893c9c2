"""Current rows of tables in which a key may have several versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FIXED = (T.LongType, T.IntegerType, T.ShortType, T.ByteType, T.DoubleType, T.FloatType, T.BooleanType, T.TimestampType, T.TimestampNTZType, T.DateType)


def version_order(loaded_at: str = "loaded_at") -> Column:
    """Sort key of versions; an unknown load time sorts first."""
    return F.coalesce(F.col(loaded_at).cast("timestamp"), F.lit("0001-01-02 00:00:00").cast("timestamp"))


def current_rows(
    df: DataFrame,
    key: str,
    values: Sequence[str],
    *,
    loaded_at: str = "loaded_at",
    deleted_at: str | None = "deleted_at",
    keep_deleted: bool = False,
) -> DataFrame:
    """The latest version of each key, with ``values``.

    Rows whose key is NULL have no identity and are left out. Among versions
    of the same load time the values are taken from one of them (the tables
    define such rows as equal). With ``deleted_at`` the withdrawn keys are
    dropped, or flagged by a column ``is_deleted`` if ``keep_deleted``.

    One shuffle on the key, after map-side combination. Fixed-width columns
    aggregate one by one, so the plan stays a hash aggregate; only wider
    columns are carried as one struct through a sort aggregate.
    """
    order = version_order(loaded_at)
    fixed = [c for c in values if isinstance(df.schema[c].dataType, _FIXED)]
    wide = [c for c in values if c not in fixed]
    src = df.select(
        F.col(key).alias("__key"),
        order.alias("__at"),
        *([F.col(deleted_at).isNotNull().alias("__gone")] if deleted_at else []),
        *[F.col(c).alias(f"__f{i}") for i, c in enumerate(fixed)],
        *([F.struct(*[F.col(c).alias(f"w{i}") for i, c in enumerate(wide)]).alias("__w")] if wide else []),
    ).filter(F.col("__key").isNotNull())
    aggs = [F.max_by(f"__f{i}", "__at").alias(f"__f{i}") for i in range(len(fixed))]
    if deleted_at:
        aggs.append(F.max_by("__gone", "__at").alias("__gone"))
    if wide:
        aggs.append(F.max_by("__w", "__at").alias("__w"))
    out = src.groupBy("__key").agg(*(aggs or [F.max("__at").alias("__at")]))
    if deleted_at and not keep_deleted:
        out = out.filter(~F.col("__gone"))
    place = {c: F.col(f"__f{i}") for i, c in enumerate(fixed)} | {c: F.col(f"__w.w{i}") for i, c in enumerate(wide)}
    return out.select(
        F.col("__key").alias(key),
        *[place[c].alias(c) for c in values if c != key],
        *([F.col("__gone").alias("is_deleted")] if deleted_at and keep_deleted else []),
    )


def key_history(df: DataFrame, key: str, *, loaded_at: str = "loaded_at", deleted_at: str | None = "deleted_at", pointer: str | None = None) -> DataFrame:
    """Per key: ``first_at``, ``is_deleted`` and, if asked, the current ``pointer``."""
    order = version_order(loaded_at)
    src = df.select(
        F.col(key).alias("key"),
        order.alias("at"),
        *([F.col(pointer).alias("ptr")] if pointer else []),
        *([F.col(deleted_at).isNotNull().alias("gone")] if deleted_at else []),
    ).filter(F.col("key").isNotNull())
    aggs = [F.min("at").alias("first_at")]
    if pointer:
        aggs.append(F.max_by("ptr", "at").alias("pointer"))
    if deleted_at:
        aggs.append(F.max_by("gone", "at").alias("is_deleted"))
    out = src.groupBy("key").agg(*aggs)
    return out if deleted_at else out.withColumn("is_deleted", F.lit(False))
