"""Operators on ordered rows."""

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


def unit_gaps(units: DataFrame, keys: Sequence[str], order: str, begin: str, end: str, word: str, line: str, total: str) -> DataFrame:
    """``silence`` after each unit and its class (WIN-01).

    Within the keys (a recording): 1 before a unit of the same word, 2 of the
    same line, 3 of another line, 4 at the end of the recording, where the
    silence lasts until ``total``.
    """
    w = W.partitionBy(*keys).orderBy(order)
    nxt = F.lead(begin).over(w)
    same = lambda c: F.lead(c).over(w).eqNullSafe(F.col(c))
    kind = F.when(F.lead(order).over(w).isNull(), 4).when(same(word), 1).when(same(line), 2).otherwise(3)
    return units.withColumn("gap_class", kind).withColumn("silence", F.when(F.col("gap_class") == 4, F.col(total)).otherwise(nxt) - F.col(end))


def gap_limits(gaps: DataFrame, times: dict[int, float], default: float) -> DataFrame:
    """Limit of each gap class: mean + times x sample standard deviation; NULL for a class of one (AGG-02, AGG-03)."""
    s = gaps.groupBy("gap_class").agg(F.avg("silence").alias("mean"), F.stddev_samp("silence").alias("dev"))
    m = F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in times.items() for v in kv]), F.col("gap_class")), F.lit(default)) if times else F.lit(default)
    return s.select("gap_class", (F.col("mean") + m * F.col("dev")).alias("gap_limit"))


def long_gaps(gaps: DataFrame, limits: DataFrame) -> DataFrame:
    """Gaps at or above their class's limit (WIN-02). There are four classes, so the limits are broadcast."""
    return gaps.join(F.broadcast(limits), "gap_class").filter(F.col("silence") >= F.col("gap_limit"))


def cascade_gaps(words: DataFrame, keys: Sequence[str], order: str, line: str, silence: str) -> DataFrame:
    """Each line's first word takes the silence before it if that is longer, through chains of single-word lines (WIN-05).

    In a chain of lines of one word each, the running maximum from the line
    before the chain on is what passes through.
    """
    w = W.partitionBy(*keys).orderBy(order)
    first = F.coalesce(F.lag(line).over(w) != F.col(line), F.lit(True))
    rows = words.withColumn("__first", first)
    # A run: a word that doesn't begin a line, or the first of all, and the line-beginning words that follow.
    run = F.sum((~F.col("__first")).cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("__run", run)
    upto = W.partitionBy(*keys, "__run").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("raised", F.max(silence).over(upto)).drop("__first", "__run")


def widest_by_line(words: DataFrame, line: str, order: str, silence: str) -> DataFrame:
    """The word with the longest silence of each line, the first on ties (AGG-14)."""
    return words.groupBy(line).agg(F.max_by(F.struct(order, silence), F.struct(F.col(silence), -F.col(order))).alias("w")).select(line, f"w.{order}", f"w.{silence}")


def midpoints(rows: DataFrame, keys: Sequence[str], order: Sequence[str], begin: str, end: str, total: str) -> DataFrame:
    """Gaps closed in the middle; the first begins at 0, the last ends with the recording (WIN-07)."""
    w = W.partitionBy(*keys).orderBy(*order)
    before, after = F.lag(end).over(w), F.lead(begin).over(w)
    new_begin = F.when(before.isNull(), F.lit(0.0)).otherwise((F.col(begin) + before) / 2)
    new_end = F.when(after.isNull(), F.col(total)).otherwise((after + F.col(end)) / 2)
    return rows.withColumns({"mid_begin": new_begin, "mid_end": new_end})


def next_begin(rows: DataFrame, keys: Sequence[str], order: Sequence[str], begin: str) -> Column:
    """End of a row as the begin of the next; 0 for the last (WIN-08)."""
    return F.coalesce(F.lead(begin).over(W.partitionBy(*keys).orderBy(*order)), F.lit(0.0))


def unique_suffix(rows: DataFrame, keys: Sequence[str], name: str, order: Sequence[str]) -> DataFrame:
    """``unique_name``: the name, with a, b ... z for repeats; NULL beyond (WIN-13, WIN-14).

    Repeats are numbered per key and name. A strict caller refuses rows without
    a name, see :func:`refused_names`. A name that was suffixed before and
    collides with a new one is counted again by :func:`quillstream.model.duplicate_keys`.
    """
    n = F.row_number().over(W.partitionBy(*keys, name).orderBy(*order))
    suffix = F.when(n == 1, "").when(n <= 27, F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), n - 1, F.lit(1)))
    return rows.withColumn("unique_name", F.concat(F.col(name), suffix))


def refused_names(named: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Keys and names with more repeats than letters, which a strict insert refuses (WIN-13): keys, name, n_refused."""
    return named.filter(F.col("unique_name").isNull() & F.col(name).isNotNull()).groupBy(*keys, name).agg(F.count(F.lit(1)).alias("n_refused"))


def with_headings(rows: DataFrame, book_keys: Sequence[str], chapter: str, order: str) -> DataFrame:
    """A title row before each book's first row and a heading before each new chapter but 1, renumbered (WIN-10..12, SRC-13).

    Gives book keys, chapter, kind (``title``, ``heading``, ``line``), the row's
    ``order`` and ``line_no``, restarting in each book.
    """
    w = W.partitionBy(*book_keys).orderBy(order)
    before = F.lag(chapter).over(w)
    marked = rows.select(*book_keys, chapter, order, before.isNull().alias("opens"), (F.coalesce(before, F.lit(1)) != F.col(chapter)).alias("turns"))
    kinds = F.filter(F.array(F.when(F.col("opens"), F.struct(F.lit(0).alias("rank"), F.lit("title").alias("kind"))), F.when(F.col("turns"), F.struct(F.lit(1).alias("rank"), F.lit("heading").alias("kind"))), F.struct(F.lit(2).alias("rank"), F.lit("line").alias("kind"))), lambda x: x.isNotNull())
    out = marked.select(*book_keys, chapter, order, F.explode(kinds).alias("k")).select(*book_keys, chapter, order, "k.rank", "k.kind")
    return out.withColumn("line_no", F.row_number().over(W.partitionBy(*book_keys).orderBy(order, "rank"))).drop("rank")


#: Samples of a shard of :func:`greedy_batches`.
BATCH_SHARD = 1 << 16


def _successors(new: np.ndarray, size: np.ndarray, own: int, max_batch: int, target: int) -> np.ndarray:
    """Where the batch ends that begins at each of a shard's own rows; ``new`` marks the first rows of keys, rows after the own ones look ahead."""
    succ = np.full(own, len(size), np.int64)
    live = np.arange(own)
    for j in range(1, max_batch + 1):
        live = live[live + j < len(size)]
        at = live + j
        stop = new[at] | (size[at] * (j + 1) >= target) if j < max_batch else np.ones(len(at), bool)
        succ[live[stop]] = at[stop]
        live = live[~stop]
    return succ


def _shard_rows(t: pa.Table, keys: Sequence[str], size: str):
    """A shard's rows in order: the table, which begin a key, sizes, and the number of own rows."""
    t = t.take(pc.sort_indices(t, [("__n", "ascending")])).combine_chunks()
    own = int(pc.sum(t.column("__own")).as_py() or 0)
    new = np.zeros(t.num_rows, bool)
    for k in keys:
        c = t.column(k).combine_chunks()
        x, y = c.slice(0, len(c) - 1), c.slice(1)
        differ = pc.or_(pc.fill_null(pc.not_equal(x, y), False), pc.xor(pc.is_null(x), pc.is_null(y)))
        new[1:] |= differ.to_numpy(zero_copy_only=False)
    if t.num_rows:
        new[0] = t.column("__first")[0].as_py()
    return t, new, t.column(size).to_numpy().astype(np.int64), own


def greedy_batches(samples: DataFrame, keys: Sequence[str], size: str, order: Sequence[str], max_batch: int, target: int, shard: int = BATCH_SHARD) -> DataFrame:
    """``batch``: number of the batch of each sample, taken by size (WIN-17).

    A batch is closed before a sample that would be number max_batch + 1 or
    bring (size x count) to the target; an unknown size counts as 0.

    Each step depends on the one before, but a batch begun in one shard of the
    sorted samples ends within max_batch rows of the next. So a shard gives, for
    each of its first max_batch rows, where the chain of batches that enters
    there leaves it and after how many batches; one pass over those small
    tables tells where each shard is entered really, and the shards are then
    numbered at once. No task holds more than a shard, whatever the keys.
    """
    from quillstream.operators.mutations import number_rows

    keys = list(keys)
    space = Workspace(samples.sparkSession, "batches")
    src = samples.select(*keys, *[c for c in order if c not in keys and c != size], F.coalesce(F.col(size).cast("long"), F.lit(0)).alias(size))
    numbered = number_rows(src, "__n", [*keys, size, *order])
    at = F.expr(f"(__n - 1) div {shard}")
    place = F.col("__n") - 1 - at * shard
    # Rows at the head of a shard are looked at from the shard before, too.
    both = F.when((place < max_batch) & (at > 0), F.array(at, at - 1)).otherwise(F.array(at))
    rows = numbered.withColumn("__home", at).withColumn("__s", F.explode(both)).withColumn("__own", F.col("__home") == F.col("__s")).drop("__home")
    # Whether a shard's first row begins a key is known from the last row of the shard before.
    edges = numbered.filter((place == 0) | (place == shard - 1)).select((F.expr(f"__n div {shard}")).alias("__s"), (place == 0).alias("__head"), F.struct(*keys).alias("k"))
    heads = edges.groupBy("__s").agg(F.max(F.when(F.col("__head"), F.col("k"))).alias("own"), F.max(F.when(~F.col("__head"), F.col("k"))).alias("last"))
    heads = heads.select("__s", F.coalesce(F.col("own") != F.col("last"), F.lit(True)).alias("__first"))
    rows = space.put(rows.join(heads, "__s"))

    def ways(t: pa.Table) -> pa.Table:
        t, new, sizes, own = _shard_rows(t, keys, size)
        succ = _successors(new, sizes, own, max_batch, target)
        entry = np.arange(min(max_batch, own) + 1)
        now, count, reset = entry.copy(), np.zeros(len(entry), np.int64), np.zeros(len(entry), bool)
        while (inside := np.flatnonzero(now < own)).size:
            begins = new[now[inside]]
            count[inside] = np.where(begins, 1, count[inside] + 1)
            reset[inside] |= begins
            now[inside] = succ[now[inside]]
        return pa.table({"__s": pa.array([t.column("__s")[0].as_py()] * len(entry), pa.int64()), "entry": entry, "leaves": now - own, "n": count, "reset": reset})

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entry, before, found = 0, 0, []
        for b in batches:
            for s, e, leaves, n, reset in zip(*(b.column(c).to_pylist() for c in ("__s", "entry", "leaves", "n", "reset"))):
                if e == entry and (not found or found[-1][0] != s):
                    found.append((s, entry, before))
                    before = n if reset else before + n
                    entry = leaves
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(3)], names=["__s", "entry", "before"])

    names = src.columns
    schema = T.StructType([*src.schema.fields, T.StructField("batch", T.LongType())])

    def assign(t: pa.Table) -> pa.Table:
        t, new, sizes, own = _shard_rows(t, keys, size)
        succ = _successors(new, sizes, own, max_batch, target)
        starts = np.zeros(own, bool)
        i = t.column("entry")[0].as_py()
        while i < own:
            starts[i] = True
            i = int(succ[i])
        # Batches since the shard's begin, less those before the last begin of a key.
        n = np.cumsum(starts)
        head = new[:own] & starts
        base = np.maximum.accumulate(np.where(head, n - 1, -1)) if own else n
        batch = np.where(base >= 0, n - base, n + t.column("before")[0].as_py())
        out = t.slice(0, own).select(names)
        return out.append_column("batch", pa.array(batch.astype(np.int64)))

    way = space.put(rows.groupBy("__s").applyInArrow(ways, "__s long, entry long, leaves long, n long, reset boolean"))
    entered = way.repartition(1).sortWithinPartitions("__s", "entry").mapInArrow(entries, "__s long, entry long, before long")
    return rows.join(space.put(entered), "__s").groupBy("__s").applyInArrow(assign, schema)


def frame_slice(matrix: Column, begin: Column, end: Column, rate: float) -> Column:
    """Frames of [begin, end) seconds; an end of 0 means to the last (WIN-09)."""
    start = F.floor(begin * rate + 0.5).cast("int")
    stop = F.when(end == 0, F.size(matrix)).otherwise(F.floor(end * rate + 0.5)).cast("int")
    return F.slice(matrix, start + 1, F.greatest(stop - start, F.lit(0)))


def referenced_verses(samples: DataFrame, reference: str, prefix: Column, keys: Sequence[str], word: str = "word", word_id: str = "word_id", line: str = "script_id") -> DataFrame:
    """Samples whose ``BOOK chapter:verse.word`` reference begins with ``prefix``, grouped to verses: keys, verse_str, line, words in order (PRJ-20).

    References of another form are left out; the line is the smallest of the
    verse's, and words of one number follow by id.
    """
    place = F.regexp_extract(reference, r"^[^:]*:([^:.]+)\.([0-9]+)$", 1)
    number = F.regexp_extract(reference, r"^[^:]*:([^:.]+)\.([0-9]+)$", 2).try_cast("long")
    own = samples.filter(F.startswith(F.col(reference), prefix)).withColumns({"verse_str": place, "__n": number}).filter("verse_str <> '' and __n is not null")
    got = own.groupBy(*keys, "verse_str").agg(F.min(line).alias(line), F.array_sort(F.collect_list(F.struct("__n", word_id, word))).alias("w"))
    return got.select(*keys, "verse_str", line, F.transform("w", lambda r: r[word]).alias("words"))


def padded_batches(samples: DataFrame, keys: Sequence[str], values: str, labels: str) -> DataFrame:
    """Samples with values padded with 0 and labels padded with -100 to the longest of their batch, and the values' mask (MTH-05, UDF-19)."""
    longest = samples.groupBy(*keys).agg(F.max(F.size(values)).alias("__v"), F.max(F.size(labels)).alias("__l"))
    rest = lambda c, n: F.greatest(F.col(n) - F.size(c), F.lit(0))
    out = samples.join(longest, list(keys))
    out = out.withColumn("mask", F.concat(F.array_repeat(F.lit(1), F.size(values)), F.array_repeat(F.lit(0), rest(values, "__v"))))
    out = out.withColumns({values: F.concat(values, F.array_repeat(F.lit(0.0), rest(values, "__v"))), labels: F.concat(labels, F.array_repeat(F.lit(-100), rest(labels, "__l")))})
    return out.drop("__v", "__l")
