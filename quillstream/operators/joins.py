"""Join operators of the domain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def line_word_char(lines: DataFrame, words: DataFrame, chars: DataFrame) -> DataFrame:
    """Letters with their word and line, W tokens only (JOI-01)."""
    w = words.filter("ttype = 'W'").select("word_id", "script_id", "word_seq", "word")
    s = lines.select("script_id", "dataset_id", "book_id", "chapter_num", "verse_str", "audio_file")
    return chars.join(w, "word_id").join(s, "script_id")


def paired(base: DataFrame, comp: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Full outer join of two versions: keys, base_* and comp_* (JOI-10, SET-05)."""
    keys = list(keys)
    side = lambda d, p: d.select(*keys, F.lit(True).alias(f"in_{p}"), *[F.col(v).alias(f"{p}_{v}") for v in values])
    out = side(base, "base").join(side(comp, "comp"), keys, "full_outer")
    return out.withColumns({f"in_{p}": F.coalesce(f"in_{p}", F.lit(False)) for p in ("base", "comp")})


def first_known(*options: Column) -> Column:
    """The first option that is neither NULL nor 0 nor NaN; else 0 (JOI-11)."""
    return F.coalesce(*[F.when((o != 0) & ~F.isnan(o), o) for o in options], F.lit(0.0))


def missing_from(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of left whose keys aren't in right (JOI-19, JOI-29, SRC-26)."""
    return left.join(right.select(*keys).distinct(), list(keys), "left_anti")


def two_key_fallback(codes: DataFrame, tree: DataFrame, code: str, first: str, second: str, value: str) -> DataFrame:
    """Value by the first key, else by the second (JOI-20)."""
    a = tree.filter(F.col(first) != "").groupBy(F.col(first).alias("k1")).agg(F.min(value).alias("v1"))
    b = tree.filter(F.col(second) != "").groupBy(F.col(second).alias("k2")).agg(F.min(value).alias("v2"))
    out = codes.join(a, codes[code] == a["k1"], "left").join(b, codes[code] == b["k2"], "left")
    return out.withColumn(value, F.coalesce("v1", "v2")).withColumn("found_by", F.when(F.col("v1").isNotNull(), first).when(F.col("v2").isNotNull(), second)).drop("k1", "k2", "v1", "v2")


def members_in_range(items: DataFrame, groups: DataFrame, keys: Sequence[str], at: str, begin: str, end: str, bucket: int = 16) -> DataFrame:
    """Items whose ``at`` lies in [begin, end] of a group of the same keys (JOI-23).

    Ranges are cut into buckets, so that the join stays an equi join and a key
    with many groups isn't compared pair by pair.
    """
    g = groups.filter(F.col(begin) <= F.col(end)).withColumn("__b", F.explode(F.sequence(F.floor(F.col(begin) / bucket), F.floor(F.col(end) / bucket))))
    i = items.withColumn("__b", F.floor(F.col(at) / bucket))
    return i.join(g, [*keys, "__b"]).filter(F.col(at).between(F.col(begin), F.col(end))).drop("__b")


def running_offset(base: DataFrame, comp: DataFrame, keys: Sequence[str], at: str, length: str) -> DataFrame:
    """Full outer merge on ``at`` with the running difference of lengths before it (JOI-24)."""
    b = base.select(*keys, at, F.col(length).alias("base_len"))
    c = comp.select(*keys, at, F.col(length).alias("comp_len"))
    both = b.join(c, [*keys, at], "full_outer")
    w = W.partitionBy(*keys).orderBy(at).rowsBetween(W.unboundedPreceding, -1)
    return both.withColumn("offset", F.coalesce(F.sum(F.coalesce("comp_len", F.lit(0)) - F.coalesce("base_len", F.lit(0))).over(w), F.lit(0)))
