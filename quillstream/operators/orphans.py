"""Problem 3: references to records that do not exist.

References and parent keys are co-partitioned and sorted on the parent key and
merged linearly (a sort-merge join, asked for by hint). Each parent key carries
its validity: the time it first arrived and whether it is withdrawn now.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.operators.versions import key_history

#: A parent key is hot if more than HOT_ROWS references name it, and more than
#: one in HOT_KEYS of all; so fewer than HOT_KEYS keys are hot at any input
#: size, which bounds the list that is broadcast. A hot key is spread over as
#: many partitions as it has such shares.
HOT_KEYS, HOT_ROWS = 100_000, 5_000


def references(df: DataFrame, child_table: str, key: str, pointer: str, *, loaded_at: str = "loaded_at", deleted_at: str | None = None) -> DataFrame:
    """One row per child key with a non-NULL pointer: child_table, child_key, pointer, first_at.

    The pointer is that of the key's latest version; a child counts whether it
    is withdrawn or not.
    """
    h = key_history(df, key, loaded_at=loaded_at, deleted_at=None, pointer=pointer)
    return h.filter(F.col("pointer").isNotNull()).select(
        F.lit(child_table).alias("child_table"), F.col("key").cast("long").alias("child_key"), F.col("pointer").cast("long").alias("pointer"), "first_at"
    )


def find_orphans(refs: DataFrame, parents: DataFrame, pointers: DataFrame | None = None) -> DataFrame:
    """Orphan references: child_table, child_key, pointer, load_month, orphan_kind.

    ``refs`` as from :func:`references`; ``parents`` as from
    :func:`quillstream.operators.versions.key_history` (key, first_at,
    is_deleted; one row per key, keys not NULL). ``pointers`` may give the raw
    pointers (column ``pointer``) to count hot keys on, so that ``refs`` isn't
    computed twice. The kind is ``missing`` if no
    parent has the key, else ``deleted`` if the parent is withdrawn, else
    ``late`` if the parent first arrived after the child did. A reference whose
    load time is unknown sorts as the earliest time, and its month is NULL.
    Empty tables give no rows; with no parents every reference is missing.

    Hot parent keys: a count of references by key (combined before its shuffle)
    gives the keys above the threshold; their references are salted by that
    count and their parent rows repeated once a salt, so no partition gets more
    of a key than the threshold. All rows are counted first (of a written table
    from its footers).
    """
    raw = refs if pointers is None else pointers
    share = max(HOT_ROWS, -(-raw.count() // HOT_KEYS))
    counts = raw.filter(F.col("pointer").isNotNull()).groupBy("pointer").agg(F.count(F.lit(1)).alias("n"))
    hot = F.broadcast(counts.filter(F.col("n") > share).select(F.col("pointer").alias("hot_key"), F.ceil(F.col("n") / share).cast("int").alias("salts")))
    salted = refs.join(hot, refs["pointer"] == hot["hot_key"], "left").withColumn(
        "salt", F.when(F.col("salts").isNotNull(), F.pmod(F.xxhash64("child_key"), F.col("salts"))).otherwise(F.lit(0)).cast("int")
    )
    held = (
        parents.select(F.col("key").alias("parent_key"), F.col("first_at").alias("parent_first_at"), "is_deleted")
        .join(hot, F.col("parent_key") == F.col("hot_key"), "left")
        .withColumn("parent_salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
        .drop("hot_key", "salts")
    )
    merged = salted.drop("hot_key", "salts").join(held.hint("merge"), (F.col("pointer") == F.col("parent_key")) & (F.col("salt") == F.col("parent_salt")), "left")
    kind = (
        F.when(F.col("parent_key").isNull(), "missing").when(F.col("is_deleted"), "deleted").when(F.col("parent_first_at") > F.col("first_at"), "late")
    )
    known = F.col("first_at") > F.lit("0001-01-02 00:00:00").cast("timestamp")
    return merged.withColumn("orphan_kind", kind).filter(F.col("orphan_kind").isNotNull()).select(
        "child_table", "child_key", "pointer", F.when(known, F.date_format("first_at", "yyyy-MM")).alias("load_month"), "orphan_kind"
    )


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans counted by table, month and kind."""
    return orphans.groupBy("child_table", "load_month", "orphan_kind").agg(
        F.count(F.lit(1)).alias("n_orphans"), F.countDistinct("pointer").alias("n_targets")
    )
