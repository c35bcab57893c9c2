"""Problem 1: per source, the score cutoff that keeps a target share of its records.

Distributed quickselect. Scores are written once as sorted runs (distinct
values with cumulative counts, many runs a source, so a source with a third of
all rows is spread like any other). In each round every task reports, per
source and per interval between the pivots, how many candidate scores lie in it
and at its ends, and the weighted medians of its runs' medians - their median,
the medians of either half, and so on down to sixteenths. The weighted medians of
the tasks' medians become the next pivots, and the counts discard all intervals
but the one that holds the target rank. A source ends when its target rank falls
on a pivot.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstream.runtime import Workspace

#: Scores of one task that are sorted together, and values of one written run.
SORT_ROWS, RUN_VALUES = 1 << 17, 1 << 12
#: Pivots a round and source: the median, and the medians of halves, quarters and eighths.
PIVOTS = 15
#: The runs are written anew, without discarded scores, when the candidates
#: have shrunk by this factor since they were written last, if so many were
#: left then that reading them again costs more than a job.
SHRINK, MANY = 4, 1 << 20

_RUNS = T.StructType([T.StructField("sid", T.LongType()), T.StructField("vals", T.ArrayType(T.DoubleType())), T.StructField("cum", T.ArrayType(T.LongType()))])
#: Of each source: scores between the pivots, at the pivots, and PIVOTS medians of each interval.
_REPORT = T.StructType([T.StructField("sid", T.LongType()), T.StructField("n", T.ArrayType(T.LongType())), T.StructField("eq", T.ArrayType(T.LongType())), T.StructField("med", T.ArrayType(T.DoubleType()))])
_STATE = T.StructType([
    T.StructField("sid", T.LongType()), T.StructField("lo", T.DoubleType()), T.StructField("hi", T.DoubleType()), T.StructField("pivots", T.ArrayType(T.DoubleType())),
    T.StructField("k", T.LongType()), T.StructField("above", T.LongType()), T.StructField("cutoff", T.DoubleType()), T.StructField("left", T.LongType()),
])


def _medians(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The lower weighted median of x, and those of the halves, quarters and eighths on either side: PIVOTS values."""
    order = np.argsort(x, kind="stable")
    c = np.cumsum(w[order])
    return x[order][np.searchsorted(c, c[-1] * np.arange(1, PIVOTS + 1) / (PIVOTS + 1))]


def _sorted_runs(batches: Iterator[pa.RecordBatch], sort_rows: int, run_values: int) -> Iterator[pa.RecordBatch]:
    """(sid, score) rows to sorted runs of each source, from ``sort_rows`` rows at a time."""
    schema = pa.schema([("sid", pa.int64()), ("vals", pa.list_(pa.float64())), ("cum", pa.list_(pa.int64()))])

    def flush(sids: list, scores: list) -> Iterator[pa.RecordBatch]:
        sid, x = np.concatenate(sids), np.concatenate(scores)
        order = np.lexsort((x, sid))
        sid, x = sid[order], x[order]
        head = np.append(True, (sid[1:] != sid[:-1]) | (x[1:] != x[:-1]))
        at = np.flatnonzero(head)
        n = np.diff(np.append(at, len(x)))
        sid, x = sid[at], x[at]
        # A run ends with its source or after run_values values.
        source = np.flatnonzero(np.append(True, sid[1:] != sid[:-1]))
        place = np.arange(len(sid)) - np.repeat(source, np.diff(np.append(source, len(sid))))
        first = np.flatnonzero(place % run_values == 0)
        total = np.cumsum(n)
        cum = total - np.repeat(np.append(0, total)[first], np.diff(np.append(first, len(sid))))
        offsets = pa.array(np.append(first, len(sid)).astype(np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(sid[first]), pa.ListArray.from_arrays(offsets, pa.array(x)), pa.ListArray.from_arrays(offsets, pa.array(cum))], schema=schema)

    sids, scores, rows = [], [], 0
    for b in batches:
        sids.append(b.column(0).to_numpy(zero_copy_only=False))
        scores.append(b.column(1).to_numpy(zero_copy_only=False))
        rows += b.num_rows
        if rows >= sort_rows:
            yield from flush(sids, scores)
            sids, scores, rows = [], [], 0
    if rows:
        yield from flush(sids, scores)


def _lists(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return col.offsets.to_numpy(), col.values.to_numpy(zero_copy_only=False)


def _number(col: pa.Array) -> np.ndarray:
    """Doubles with NULL as NaN (scores are never NaN)."""
    return col.to_numpy(zero_copy_only=False).astype(float)


def _bounds(v: np.ndarray, lo: float, hi: float) -> tuple[int, int]:
    """Slice of the candidates lo < v < hi; NaN is no bound."""
    return (0 if lo != lo else int(np.searchsorted(v, lo, "right"))), (len(v) if hi != hi else int(np.searchsorted(v, hi, "left")))


def _joined(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Reports of one source (counts between pivots, at pivots, medians of each interval) as one."""
    if len(parts) == 1:
        return parts[0]
    n, eq, med = (np.stack(x) for x in zip(*parts))
    out = np.zeros(med.shape[1:])
    for i in np.flatnonzero(n.sum(0)):
        some = n[:, i] > 0
        out[i] = _medians(med[some, i].ravel(), np.repeat(n[some, i], PIVOTS))
    return n.sum(0), eq.sum(0), out


def _report(v: np.ndarray, c: np.ndarray, lo: float, hi: float, pivots: np.ndarray):
    """What a run has between lo and hi: counts between the pivots, at the pivots, and the intervals' medians."""
    i, j = _bounds(v, lo, hi)
    if i >= j:
        return None
    left, right = (np.clip(np.searchsorted(v, pivots, side), i, j) for side in ("left", "right"))
    upto = np.append(0, c)
    start, stop = np.append(i, right), np.append(left, j)
    n = upto[stop] - upto[start]
    rank = upto[start][:, None] + -(-n[:, None] * np.arange(1, PIVOTS + 1) // (PIVOTS + 1))
    med = v[np.minimum(np.searchsorted(c, rank), len(v) - 1)]
    return n, upto[right] - upto[left], np.where(n[:, None] > 0, med, 0.0)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs with lo, hi and pivots of their source to one report for each source of this task."""
    seen: dict[int, list] = {}
    for b in batches:
        if not b.num_rows:
            continue
        (o, values), (_, cums), (po, pivots) = (_lists(b.column(c)) for c in ("vals", "cum", "pivots"))
        sid = b.column("sid").to_numpy()
        lo, hi = (_number(b.column(c)) for c in ("lo", "hi"))
        for r in range(b.num_rows):
            part = _report(values[o[r] : o[r + 1]], cums[o[r] : o[r + 1]], lo[r], hi[r], pivots[po[r] : po[r + 1]])
            if part is not None:
                own = seen.setdefault(int(sid[r]), [])
                own.append(part)
                if len(own) == 64:  # reports of many runs don't pile up
                    own[:] = [_joined(own)]
    rows = [(s, *_joined(parts)) for s, parts in seen.items()]
    yield pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int64()), *[pa.array([r[i].ravel() for r in rows], pa.list_(t)) for i, t in ((1, pa.int64()), (2, pa.int64()), (3, pa.float64()))]], names=_REPORT.names
    )


def _decided(parts: list, lo: float, hi: float, pivots: np.ndarray, k: int, above: int, permille: int | None) -> tuple:
    """The state of a source after a round, from its tasks' reports: lo, hi, pivots, k, above, cutoff, left."""
    n, eq, med = _joined([(a, b, c.reshape(-1, PIVOTS)) for a, b, c in parts])
    if permille is not None:  # the first round counts, and has no pivots yet
        k = min(max(-(-permille * int(n[0]) // 1000), 1), int(n[0]))
    side = len(n) - 1
    while k > n[side]:  # from the top interval down
        k, above = k - int(n[side]), above + int(n[side])
        side -= 1
        if k <= eq[side]:
            return None, None, np.zeros(0), 0, above + int(eq[side]), float(pivots[side]), 0
        k, above = k - int(eq[side]), above + int(eq[side])
    lo = pivots[side - 1] if side else lo
    hi = pivots[side] if side < len(pivots) else hi
    nan = lambda x: None if x != x else float(x)
    return nan(lo), nan(hi), np.unique(med[side]), k, above, None, int(n[side])


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reports with the state of their source, sorted by source, to the new state of each."""
    parts: list = []
    now: tuple | None = None
    rows: list[tuple] = []
    for b in batches:
        (no, n), (eo, eq), (mo, med), (po, pivots) = (_lists(b.column(c)) for c in ("n", "eq", "med", "pivots"))
        lo, hi = (_number(b.column(c)) for c in ("lo", "hi"))
        sid, k, above, permille = (b.column(c).to_pylist() for c in ("sid", "k", "above", "permille"))
        for r in range(b.num_rows):
            if now is not None and now[0] != sid[r]:
                rows.append((now[0], *_decided(parts, *now[1:])))
                parts = []
            if not parts:
                now = (sid[r], lo[r], hi[r], pivots[po[r] : po[r + 1]], k[r], above[r], permille[r])
            parts.append((n[no[r] : no[r + 1]], eq[eo[r] : eo[r + 1]], med[mo[r] : mo[r + 1]]))
            if len(parts) == 64:
                parts = [tuple(x.ravel() for x in _joined([(a, e, m.reshape(-1, PIVOTS)) for a, e, m in parts]))]
    if parts:
        rows.append((now[0], *_decided(parts, *now[1:])))
    types = [pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.float64()), pa.int64(), pa.int64(), pa.float64(), pa.int64()]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=_STATE.names)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs without the scores outside lo and hi of their source."""
    for b in batches:
        (o, values), (_, cums) = _lists(b.column("vals")), _lists(b.column("cum"))
        sid, lo, hi = b.column("sid").to_numpy(), _number(b.column("lo")), _number(b.column("hi"))
        keep, vs, cs = [], [], []
        for r in range(b.num_rows):
            v, c = values[o[r] : o[r + 1]], cums[o[r] : o[r + 1]]
            i, j = _bounds(v, lo[r], hi[r])
            if i < j:
                keep.append(sid[r])
                vs.append(v[i:j])
                cs.append(c[i:j] - (c[i - 1] if i else 0))
        if keep:
            off = pa.array(np.append(0, np.cumsum([len(v) for v in vs])).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(keep, pa.int64()), pa.ListArray.from_arrays(off, pa.array(np.concatenate(vs))), pa.ListArray.from_arrays(off, pa.array(np.concatenate(cs)))], names=["sid", "vals", "cum"])


def _round(runs: DataFrame, state: DataFrame) -> DataFrame:
    """The state of each open source after one round.

    Candidates lie between lo and hi (both excluded), the wanted score is the
    k-th largest of them, and ``above`` scores are hi or more. ``permille`` is
    not NULL in the first round, which only counts and finds pivots.
    """
    seen = runs.join(state, "sid").select("sid", "vals", "cum", "lo", "hi", "pivots").mapInArrow(_count, _REPORT)
    return seen.repartition("sid").join(state, "sid").select("sid", "n", "eq", "med", "lo", "hi", "pivots", "k", "above", "permille").sortWithinPartitions("sid").mapInArrow(_decide, _STATE)


def fraction_cutoffs(scores: DataFrame, shares: DataFrame, keys: Sequence[str], score: str = "score", permille: str = "permille", sort_rows: int = SORT_ROWS, run_values: int = RUN_VALUES, many: int = MANY) -> DataFrame:
    """Per source, the cutoff that keeps its share: keys, n_counted, cutoff, n_kept.

    ``scores`` has the source's ``keys`` and a ``score``; a record counts if its
    score is not NULL, not NaN and above 0. ``shares`` has one row a source:
    ``keys`` and ``permille``. The cutoff is the largest occurring score at
    which the records scoring it or more are at least permille / 1000 of the
    counted ones; ``n_kept`` counts them, ties included.

    Sources without counted records, without a row in ``shares`` or with a NULL
    share give no row; a share of 0 or less keeps the best score only, one of
    1000 or more keeps all. Keys compare null-safe. Repeated rows count as
    often as they occur. Other columns are ignored, whatever their names.

    Whether the sources are broadcast is left to Spark's own check of their
    written size.
    """
    space = Workspace(scores.sparkSession, "cutoffs")
    keys = list(keys)
    own = [f"__key{i}" for i in range(len(keys))]
    named = shares.select(*[F.col(k).alias(o) for k, o in zip(keys, own)], F.col(permille).cast("long").alias("permille"))
    sources = space.put(named.filter(F.col("permille").isNotNull()).dropDuplicates(own).withColumn("sid", F.monotonically_increasing_id()))
    x = F.col(score).cast("double")
    valid = scores.filter((x > 0) & ~F.isnan(x)).select(*[F.col(k).alias(f"{o}v") for k, o in zip(keys, own)], x.alias("x"))
    same = [valid[f"{o}v"].eqNullSafe(sources[o]) for o in own]
    runs = space.put(valid.join(sources, same).select("sid", "x").mapInArrow(partial(_sorted_runs, sort_rows=sort_rows, run_values=run_values), _RUNS))

    none, zero = F.lit(None).cast("double"), F.lit(0).cast("long")
    state = sources.select("sid", none.alias("lo"), none.alias("hi"), F.array().cast("array<double>").alias("pivots"), zero.alias("k"), zero.alias("above"), "permille")
    rounds: list[DataFrame] = []
    stored = None
    while True:
        now = space.put(_round(runs, state))
        rounds.append(now)
        left = now.agg(F.coalesce(F.sum("left"), F.lit(0))).first()[0]
        if not left:
            break
        state = now.filter(F.col("cutoff").isNull()).select("sid", "lo", "hi", "pivots", "k", "above", F.lit(None).cast("long").alias("permille"))
        if stored is None:
            stored = left
        elif stored > many and left * SHRINK <= stored:
            fewer = space.put(runs.join(state, "sid").select("sid", "vals", "cum", "lo", "hi").mapInArrow(_cut, _RUNS))
            space.drop(runs)
            runs, stored = fewer, left
    hits = space.all_of(rounds).filter(F.col("cutoff").isNotNull()).select("sid", "cutoff", F.col("above").alias("n_kept"))
    space.drop(runs)
    counted = rounds[0].select("sid", F.col("left").alias("n_counted"))
    return hits.join(counted, "sid").join(sources, "sid").select(*[F.col(o).alias(k) for k, o in zip(keys, own)], "n_counted", "cutoff", "n_kept")
