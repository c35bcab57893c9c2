"""Problem 5: overlapping and gapped time intervals.

Time is cut into units of one millisecond. Per entity and time shard of SHARD
units a run bitmap (the sorted runs of set units) is built; bitmaps are united
within a task, then within the shard, and the set and clear runs are read off.
Runs that reach a shard's border are joined across shards at the end.

Shards form levels: a unit of a level is a shard of the level below. What a span
covers of whole shards goes to the next level, so a span of any length is at
most two runs a level, and four levels hold every time a long can.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstream.runtime import Workspace

#: Units of a shard. A shard's bitmap has at most SHARD / 2 runs, so what one
#: (entity, level, shard) group holds doesn't depend on the number of rows.
BITS = 18
SHARD = 1 << BITS
#: A unit of level k is SHARD ** k milliseconds. Level 3 has one shard for all times on either side of 0.
LEVELS = 4


def to_ms(seconds: Column) -> Column:
    """Whole milliseconds, halves up; NULL for NULL, NaN, infinite times and those a long can't hold in ms."""
    x = F.floor(seconds * F.lit(1000.0) + F.lit(0.5))
    return F.when(F.abs(seconds) < F.lit(9.2e15), x)


def spans(df: DataFrame, entity: Sequence[Column], begin: str, end: str) -> DataFrame:
    """Timed rows as (entity columns, b, e) in ms: both times known and the end after the begin."""
    return df.select(*entity, to_ms(F.col(begin)).alias("b"), to_ms(F.col(end)).alias("e")).filter(F.col("b") < F.col("e"))


def _unite(group: np.ndarray, b: np.ndarray, e: np.ndarray, m: np.ndarray):
    """Union of the runs (b, e) of each group, rows sorted by (group, b): first row, b, e, m of each united run."""
    base = group * np.int64(SHARD * 4)
    top = np.maximum.accumulate(base + e)
    before = np.empty_like(top)
    before[0] = -1
    before[1:] = top[:-1]
    start = base + b > before  # runs that touch are one run
    start[0] = True
    start[1:] |= group[1:] != group[:-1]
    shared = ~start & (base + b < before)
    at = np.flatnonzero(start)
    return at, b[at], np.maximum.reduceat(e, at), np.logical_or.reduceat(m | shared, at)


def _new_group(batch: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """True at each row whose keys differ from the row before."""
    n = batch.num_rows
    out = np.zeros(n, bool)
    out[0] = True
    for k in keys:
        col = batch.column(k).combine_chunks()
        if n > 1:
            x, y = col.slice(0, n - 1), col.slice(1)
            differ = pc.fill_null(pc.not_equal(x, y), False)
            differ = pc.or_(differ, pc.xor(pc.is_null(x), pc.is_null(y)))
            out[1:] |= differ.to_numpy(zero_copy_only=False)
    return out


def _table(batch: pa.RecordBatch) -> pa.Table:
    """As a table whose columns are all nullable, so that batches of any origin concatenate."""
    return pa.Table.from_arrays(batch.columns, names=batch.schema.names)


def _bitmaps(keys: Sequence[str], sort: bool):
    """mapInArrow function: unite the run bitmaps of (keys, level, shard).

    With ``sort`` each batch is sorted and united by itself (rows of hot groups
    collapse before the shuffle). Without, the rows come sorted by (keys,
    level, shard, b), and the last group of a batch is carried on as its united runs.
    """
    by = [*keys, "level", "shard"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = _table(batch)
            if sort:
                t = t.take(pc.sort_indices(t, sort_keys=[(k, "ascending") for k in [*by, "b"]]))
            elif carry is not None:
                t = pa.concat_tables([carry, t]).combine_chunks()
            new = _new_group(t, by)
            group = np.cumsum(new).astype(np.int64) - 1
            b, e = (t.column(c).to_numpy().astype(np.int64) for c in "be")
            at, b, e, m = _unite(group, b, e, t.column("m").to_numpy(zero_copy_only=False).astype(bool))
            out = t.select(by).take(pa.array(at))
            out = out.append_column("b", pa.array(b.astype(np.int32))).append_column("e", pa.array(e.astype(np.int32))).append_column("m", pa.array(m))
            if not sort:
                last = int(np.searchsorted(group[at], group[-1]))
                carry, out = out.slice(last).combine_chunks(), out.slice(0, last)
            yield from out.combine_chunks().to_batches()
        if carry is not None:
            yield from carry.to_batches()

    return work


def _stretches(keys: Sequence[str]):
    """mapInArrow function: set and clear runs in ms from united bitmaps sorted by (keys, level, shard, b).

    Kinds: ``period`` and ``gap`` are complete; ``first``, ``last`` and ``only``
    are a shard's outermost runs, which may go on in another shard. Runs of
    higher levels are ``only``, as anything may lie between them.
    """
    by = [*keys, "level", "shard"]

    def emit(t: pa.Table) -> Iterator[pa.RecordBatch]:
        n = t.num_rows
        if not n:
            return
        head = _new_group(t, by)
        tail = np.append(head[1:], True)
        level = t.column("level").to_numpy().astype(np.int64)
        at, unit = t.column("shard").to_numpy().astype(np.int64) << BITS, BITS * level
        b, e = (t.column("b").to_numpy() + at) << unit, (t.column("e").to_numpy() + at) << unit
        kind = np.select([(head & tail) | (level > 0), head, tail], ["only", "first", "last"], "period")
        inner = np.flatnonzero(~tail & (level == 0))  # a clear run follows within the shard
        own = t.select([*keys, "level"])
        for rows, k, x, y, m in (
            (np.arange(n), kind, b, e, t.column("m").to_numpy(zero_copy_only=False)),
            (inner, np.full(len(inner), "gap"), e[inner], b[np.minimum(inner + 1, n - 1)], np.zeros(len(inner), bool)),
        ):
            if len(rows):
                o = own.take(pa.array(rows)).append_column("kind", pa.array(k.tolist(), pa.string()))
                o = o.append_column("b", pa.array(x)).append_column("e", pa.array(y)).append_column("m", pa.array(m))
                yield from o.combine_chunks().to_batches()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # `_bitmaps` hands on whole groups, except that a large one may span batches.
        held: pa.Table | None = None
        for batch in _bitmaps(keys, False)(batches):
            if not batch.num_rows:
                continue
            t = _table(batch) if held is None else pa.concat_tables([held, _table(batch)]).combine_chunks()
            last = int(np.flatnonzero(_new_group(t, by))[-1])
            yield from emit(t.slice(0, last).combine_chunks())
            held = t.slice(last).combine_chunks()
        if held is not None:
            yield from emit(held)

    return work


def _pieces() -> Column:
    """The span (b, e) as runs (level, shard, b, e): at each level what lies in its first and last shard."""
    out, lo, hi = [], F.col("b"), F.col("e")
    for level in range(LEVELS):
        s, t = F.shiftright(lo, BITS), F.shiftright(hi - 1, BITS)
        some = lo < hi

        def run(shard, b, e, level=level):
            at = F.shiftleft(shard, BITS)
            return F.struct(F.lit(level).cast("byte").alias("level"), shard.alias("shard"), (b - at).cast("int").alias("b"), (e - at).cast("int").alias("e"), F.lit(False).alias("m"))

        out.append(F.when(some, run(s, lo, F.least(hi, F.shiftleft(s + 1, BITS)))))
        out.append(F.when(some & (s < t), run(t, F.shiftleft(t, BITS), hi)))
        lo, hi = s + 1, F.when(some, t).otherwise(s + 1)
    near = F.array(*out[:2])
    return F.array_compact(F.when(F.shiftright(F.col("e") - 1, BITS) - F.shiftright(F.col("b"), BITS) < 2, near).otherwise(F.array(*out)))


def continuous_periods(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Periods and gaps of each entity: keys, stretch_kind (``period``/``gap``), begin_ms, end_ms, shared.

    ``rows`` has the entity's ``keys`` and ``b`` < ``e`` in ms (see
    :func:`spans`). Spans that overlap or touch are one period; ``shared`` says
    whether two of its spans share at least 1 ms (equal spans of two rows do).
    A gap is the stretch between two consecutive periods of an entity. NULL
    keys are an entity of their own; no rows give no stretches; other columns
    are left out, and keys may not be named like the columns made here. Negative
    times are allowed, and spans may be as long as a long can say.

    A span is at most two runs of each of four levels, whatever its length. The
    joins across shards hold only the outermost runs of the SHARD shards within
    one shard of the next level, however many rows an entity has.
    """
    keys = list(keys)
    space = Workspace(rows.sparkSession, "periods")
    cut = rows.select(*keys, F.explode(_pieces()).alias("p")).select(*keys, "p.*")
    runs = cut.mapInArrow(_bitmaps(keys, True), cut.schema)
    by = [*keys, "level", "shard"]
    shards = runs.repartition(*by).sortWithinPartitions(*by, "b")
    own = [cut.schema[k] for k in (*keys, "level")]
    schema = T.StructType([*own, *[T.StructField(n, t) for n, t in (("kind", T.StringType()), ("b", T.LongType()), ("e", T.LongType()), ("m", T.BooleanType()))]])
    found = space.put(shards.mapInArrow(_stretches(keys), schema))
    low, high, top = found.agg(F.min("b"), F.max(F.col("e") - 1), F.max("level")).first()
    if low is None:
        low, high, top = 0, 0, 0
    if top:
        found = space.put(_uncovered(found, keys))
    inner = found.filter(~F.col("kind").isin(*_EDGES)).select(*keys, F.col("kind").alias("stretch_kind"), F.col("b").alias("begin_ms"), F.col("e").alias("end_ms"), F.col("m").alias("shared"))
    edges = found.filter(F.col("kind").isin(*_EDGES)).select(*keys, "level", "kind", "b", "e", "m")
    for level in range(1, LEVELS):
        bits = BITS * (level + 1)
        if (high >> bits) - (low >> bits) <= 1 or level == LEVELS - 1:
            return inner.unionByName(_join_shards(edges, keys, None))
        # Runs of higher levels wait until their own level is joined.
        joined = space.put(_join_shards(edges.filter(F.col("level") <= level), keys, bits))
        inner = inner.unionByName(joined.filter("stretch_kind is not null").select(*keys, "stretch_kind", "begin_ms", "end_ms", "shared"))
        edges = edges.filter(F.col("level") > level).unionByName(
            joined.filter("kind is not null").select(*keys, F.lit(level).cast("byte").alias("level"), "kind", F.col("begin_ms").alias("b"), F.col("end_ms").alias("e"), F.col("shared").alias("m"))
        )
    raise AssertionError("the last level holds all times")


_EDGES = ("only", "first", "last")


def _uncovered(found: DataFrame, keys: list[str]) -> DataFrame:
    """Stretches without those of shards that lie within a run of a higher level; such runs are marked as shared.

    Every shard with stretches asks the levels above it, once for each of their
    units; a look-up holds the runs and the asked units of one shard, at most
    1.5 x SHARD rows.
    """
    above = lambda level, c: F.coalesce(*[F.when(F.col(level) == k, F.shiftright(c, min(BITS * (k + 1), 63))) for k in range(LEVELS)])
    unit = F.coalesce(*[F.when(F.col("up") == k, F.shiftright("b", BITS * k)) for k in range(1, LEVELS)])
    marked = found.withColumn("id", F.struct(*keys)).withColumn("own", above("level", F.col("b")))
    wide = marked.filter("level > 0")
    asking = marked.join(wide.select("id").distinct(), "id", "left_semi").groupBy("id", "level", "own").agg(F.min("b").alias("b"))
    higher = F.explode(F.array_compact(F.array(*[F.when(F.col("level") < k, F.lit(k)) for k in range(1, LEVELS)])))
    asking = asking.withColumn("up", higher).withColumn("unit", unit)
    asked = asking.groupBy("id", "up", "unit").agg(F.min("b").alias("b")).withColumn("e", F.lit(None).cast("long"))
    runs = wide.select("id", F.col("level").cast("int").alias("up"), F.lit(None).cast("long").alias("unit"), "b", "e")
    w = W.partitionBy("id", "up", "shard").orderBy("b", F.col("e").isNull()).rowsBetween(W.unboundedPreceding, 0)
    seen = runs.unionByName(asked).withColumn("shard", above("up", F.col("b")))
    seen = seen.withColumn("to", F.last("e", True).over(w)).withColumn("at", F.last(F.when(F.col("e").isNotNull(), F.col("b")), True).over(w))
    hits = seen.filter(F.col("e").isNull() & (F.col("to") > F.col("b"))).select("id", "up", "unit", "at")
    dead = asking.join(hits, ["id", "up", "unit"], "left_semi").select("id", "level", "own").distinct()
    over = hits.select("id", F.col("up").cast("byte").alias("level"), F.col("at").alias("b")).distinct().withColumn("hit", F.lit(True))
    left = marked.join(dead, ["id", "level", "own"], "left_anti").join(over, ["id", "level", "b"], "left")
    return left.select(*found.columns[:-1], (F.col("m") | F.coalesce("hit", F.lit(False))).alias("m"))


def _join_shards(edges: DataFrame, keys: list[str], bits: int | None) -> DataFrame:
    """Periods that reach shard borders put together, and the gaps between them.

    ``bits`` gives the shards of the level joined (None: all of an entity).
    Within such a shard the outermost periods come with their ``kind`` and no
    ``stretch_kind``, as they may go on in another one.
    """
    part = [*keys] if bits is None else [*keys, "__up"]
    edges = edges.withColumn("__up", F.shiftright("b", bits)) if bits is not None else edges
    w = W.partitionBy(*part).orderBy("b")
    edges = edges.withColumn("before", F.lag("e").over(w))
    edges = edges.withColumn("open", F.col("before").isNull() | (F.col("b") > F.col("before"))).withColumn("period", F.sum(F.col("open").cast("int")).over(w))
    # What lies between the first and the last run of one shard is there already.
    gap = F.when(F.col("open") & F.col("before").isNotNull() & (F.col("kind") != "last"), F.col("before"))
    edges = edges.withColumn("gap_from", gap)
    joined = edges.groupBy(*part, "period").agg(
        F.min("b").alias("begin_ms"), F.max("e").alias("end_ms"), F.max("m").alias("shared"), F.max("gap_from").alias("gap_from")
    )
    period, gap, none = F.lit("period"), F.lit("gap"), F.lit(None).cast("string")
    kind = none
    if bits is not None:
        joined = joined.withColumn("n", F.max("period").over(W.partitionBy(*part)))
        first, last = F.col("period") == 1, F.col("period") == F.col("n")
        kind = F.when(first & last, "only").when(first, "first").when(last, "last")
        period = F.when(kind.isNull(), period)
    out = F.explode(
        F.array_compact(
            F.array(
                F.struct(period.alias("stretch_kind"), kind.alias("kind"), F.col("begin_ms"), F.col("end_ms"), F.col("shared")),
                F.when(F.col("gap_from").isNotNull(), F.struct(gap.alias("stretch_kind"), none.alias("kind"), F.col("gap_from").alias("begin_ms"), F.col("begin_ms").alias("end_ms"), F.lit(False).alias("shared"))),
            )
        )
    )
    out = joined.select(*keys, out.alias("s")).select(*keys, "s.*")
    return out if bits is not None else out.drop("kind")
