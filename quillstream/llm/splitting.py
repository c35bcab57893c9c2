"""Problem 2: oversized recordings cut into overlapping pieces at natural boundaries.

Pointer doubling. Every place where a cut is legal is a boundary: the ends and
begins of lines that no other line spans. Each boundary is joined to its
farthest legal successor (the overlap included). Where none is within reach the
cuts follow each other at full length, so their number and the last of them are
arithmetic, and the successor is the farthest boundary within reach of that.
Squaring the successor table again and again and following it from the first
boundary gives the greedy cuts of all recordings after a number of rounds that
is the logarithm of the longest chain.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstream.runtime import Workspace

#: Milliseconds of a time shard. Look-ups along time run within (recording,
#: shard); a shard has at most this many distinct times, whatever the rows.
SHARD_MS = 1 << 20


def _farthest(points: DataFrame, probes: DataFrame, strict: bool) -> DataFrame:
    """``probes`` with ``best``: the largest v of the recording's points at t or before (``strict``: before).

    points: rid, t, v. probes: rid, t and any other columns. Points are reduced
    to one a time before they are shuffled, and a window holds one shard of one
    recording; what earlier shards have is carried over by a window on one row
    a shard.
    """
    points = points.groupBy("rid", "t").agg(F.max("v").alias("v"))
    rows = probes.withColumn("v", F.lit(None).cast("long")).withColumn("late", F.lit(0 if strict else 1))
    rows = rows.unionByName(points.withColumn("late", F.lit(1 if strict else 0)), allowMissingColumns=True)
    rows = rows.withColumn("is_probe", F.col("late") == (0 if strict else 1)).withColumn("shard", F.floor(F.col("t") / SHARD_MS))
    summary = rows.groupBy("rid", "shard").agg(F.max("v").alias("top"))
    summary = summary.withColumn("carry", F.max("top").over(W.partitionBy("rid").orderBy("shard").rowsBetween(W.unboundedPreceding, -1))).drop("top")
    within = W.partitionBy("rid", "shard").orderBy("t", "late").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.join(summary, ["rid", "shard"]).withColumn("best", F.greatest(F.col("carry"), F.max("v").over(within)))
    return rows.filter("is_probe").select(*probes.columns, "best")


#: Pieces of one run that are spelled out by one row.
BLOCK = 1 << 12


def _chains(lines: DataFrame, limits: DataFrame, keys: list[str], limit_keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Recordings that are too long (rid, keys, ov, step), and their runs of pieces.

    A run (rid, t, n, hard, step, to, ends) begins at cut t, after n pieces: ``hard``
    pieces of full length, each step beyond the one before, and one that ends at
    ``to``, the boundary reached from the last of them; ``ends`` tells whether
    that is the recording's end.
    """
    space = Workspace(lines.sparkSession, "splitting")
    lines = lines.select(*keys, "b", "e").filter("b < e")
    limits = limits.select(*limit_keys, F.col("max_ms").cast("long").alias("max_ms"), F.greatest(F.coalesce(F.col("overlap_ms").cast("long"), F.lit(0)), F.lit(0)).alias("ov"))
    limits = limits.filter("max_ms >= 1").dropDuplicates(list(limit_keys)).withColumn("ov", F.least("ov", F.col("max_ms") - 1))
    recs = lines.groupBy(*keys).agg(F.min("b").alias("lo"), F.max("e").alias("hi")).join(limits, list(limit_keys))
    recs = recs.filter(F.col("hi") - F.col("lo") > F.col("max_ms")).withColumn("rid", F.monotonically_increasing_id())
    recs = space.put(recs.select("rid", *keys, (F.col("lo") + F.col("ov")).alias("origin"), "hi", "ov", (F.col("max_ms") - F.col("ov")).alias("step")))
    about = ["origin", "hi", "ov", "step"]
    own = space.put(lines.join(recs, keys).select("rid", "b", "e", *about))

    # Boundaries between lines: no line that begins before t ends after it.
    both = own.select("rid", F.explode(F.array("b", "e")).alias("t"), *about).filter((F.col("t") > F.col("origin")) & (F.col("t") <= F.col("hi")))
    spanned = _farthest(own.select("rid", F.col("b").alias("t"), F.col("e").alias("v")), both.groupBy("rid", "t").agg(*[F.first(c).alias(c) for c in about]), strict=True)
    between = space.put(spanned.filter(F.col("best").isNull() | (F.col("best") <= F.col("t"))).select("rid", "t", *about))
    space.drop(own)
    # The first piece has nothing to overlap: its chain starts one overlap after the begin.
    starts = between.unionByName(recs.select("rid", F.col("origin").alias("t"), *about))

    # From each boundary: how many cuts of full length before the next one is within reach.
    later = _farthest(starts.select("rid", (-F.col("t")).alias("t"), (-F.col("t")).alias("v")), starts.withColumn("t", -F.col("t")), strict=True)
    hard = F.greatest(F.expr("(-best + t - 1) div step"), F.lit(0))  # t is negated here
    later = later.filter(F.col("best").isNotNull()).withColumn("hard", hard)
    probes = later.select("rid", (-F.col("t") + (F.col("hard") + 1) * F.col("step")).alias("t"), (-F.col("t")).alias("from"), "hard", "step", "hi")
    reach = _farthest(between.select("rid", "t", F.col("t").alias("v")), probes, strict=False)
    succ = space.put(reach.select("rid", F.col("from").alias("t"), "hard", "step", F.col("best").alias("to"), (F.col("best") == F.col("hi")).alias("ends")))
    space.drop(between)

    found = [space.put(recs.select("rid", F.col("origin").alias("t"), F.lit(0).cast("long").alias("n")))]
    table = space.put(succ.filter("not ends").select("rid", "t", "to", (F.col("hard") + 1).alias("n_more")))
    while True:
        new = space.put(space.all_of(found).join(table, ["rid", "t"]).select("rid", F.col("to").alias("t"), (F.col("n") + F.col("n_more")).alias("n")))
        if new.isEmpty():
            break
        found.append(new)
        then = table.select("rid", F.col("t").alias("to"), F.col("to").alias("beyond"), F.col("n_more").alias("n_then"))
        squared = space.put(table.join(then, ["rid", "to"]).select("rid", "t", F.col("beyond").alias("to"), (F.col("n_more") + F.col("n_then")).alias("n_more")))
        space.drop(table)
        table = squared
    return recs, space.put(space.all_of(found).join(succ, ["rid", "t"]))


def _spelled(recs: DataFrame, runs: DataFrame, keys: list[str]) -> DataFrame:
    """Every piece of the runs, BLOCK pieces a row at a time."""
    blocks = runs.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"hard div {BLOCK}"))))
    each = blocks.withColumn("k", F.explode(F.sequence(F.col("block") * BLOCK, F.least(F.col("block") * BLOCK + (BLOCK - 1), F.col("hard")))))
    c = F.col("t") + F.col("k") * F.col("step")
    cut = F.when(F.col("k") < F.col("hard"), "inside").when(F.col("ends"), "end").otherwise("between")
    end = F.when(F.col("k") < F.col("hard"), c + F.col("step")).otherwise(F.col("to"))
    named = recs.select("rid", *keys, "ov")
    return each.select("rid", (F.col("n") + F.col("k") + 1).alias("piece_no"), c.alias("c"), end.alias("end_ms"), cut.alias("cut")).join(named, "rid").select(*keys, "piece_no", (F.col("c") - F.col("ov")).alias("begin_ms"), "end_ms", "cut")


def split_recordings(lines: DataFrame, limits: DataFrame, keys: Sequence[str], limit_keys: Sequence[str]) -> DataFrame:
    """Pieces of recordings that are too long: keys, piece_no, begin_ms, end_ms, cut.

    ``lines``: the recording's ``keys`` and ``b`` < ``e`` in ms. ``limits``:
    ``limit_keys`` (some of the keys), ``max_ms`` and ``overlap_ms``; one row for
    each value of the limit keys. Recordings from the earliest b to the latest
    e of at most max_ms, without a limit, or with a NULL key give no pieces. No
    piece is longer than max_ms; each begins overlap_ms before the end of the
    one before it. A NULL or negative overlap counts as 0, one of max_ms or
    more as max_ms - 1, a NULL max_ms or one below 1 as no limit.

    ``cut`` tells where a piece ends: ``between`` lines (no line spans the
    place), ``inside`` (a hard cut, only where no place between lines is within
    reach) or ``end`` (of the recording). The cuts are greedy: the farthest
    place between lines that is within reach, else the full length. Repeated
    lines and ties change nothing. Lines whose e is NULL or not after b are left
    out. Other columns are ignored; keys may not be named like columns made here.
    """
    recs, runs = _chains(lines, limits, list(keys), limit_keys)
    return _spelled(recs, runs, list(keys))


def oversized(lines: DataFrame, limits: DataFrame, keys: Sequence[str], limit_keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """What :func:`split_recordings` has to cut: recordings (keys, n_pieces), and the lines that no piece holds whole.

    Lines come with all their columns and ``first_cut``, the first hard cut
    inside of them: a line with one inside may fit another piece by the overlap
    or by its own length, one longer than max_ms always has one. Hard cuts are
    not spelled out, so a gap or line of any length costs one row.
    """
    keys = list(keys)
    recs, runs = _chains(lines, limits, keys, limit_keys)
    files = runs.filter("ends").join(recs, "rid").select(*keys, (F.col("n") + F.col("hard") + 1).alias("n_pieces"))
    torn = runs.filter("hard > 0").select("rid", "t", "hard", "step")
    held = lines.filter("b < e").join(recs.select("rid", "origin", *keys), keys).withColumnsRenamed({"b": "__b", "e": "__e"}).withColumn("t", F.greatest("__b", "origin"))
    held = _farthest(torn.select("rid", "t", F.col("t").alias("v")), held.join(torn.select("rid").distinct(), "rid", "left_semi"), strict=False)
    held = held.drop("t").join(torn.withColumnRenamed("t", "best"), ["rid", "best"])
    k = F.greatest(F.expr("(__b - best) div step") + 1, F.lit(1))
    cut = F.col("best") + k * F.col("step")
    found = held.withColumn("first_cut", cut).filter((k <= F.col("hard")) & (F.col("first_cut") < F.col("__e")))
    return files, found.withColumnsRenamed({"__b": "b", "__e": "e"}).select(*lines.columns, "first_cut")
