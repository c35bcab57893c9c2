"""Problem 6: texts packed into containers of fixed capacity.

Swap-based local search. Items are dealt to shards of bounded size; in a shard
a quick best-fit packing is improved by moving an item, exchanging one for one
or two for one between underfull containers, always so that the sum of squared
fills grows, which drives the emptiest containers empty. What is still in
underfull containers is dealt anew to fewer shards, until that no longer helps.
"""

from __future__ import annotations

import base64
import os
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstream.runtime import Workspace

#: Vocabulary file of a public tokenizer (never part of this repository): byte-level BPE of 50,256 ranks.
TOKENIZER = os.environ.get("QUILLSTREAM_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: The pattern that splits text before the merges of a rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Items packed together in one task.
SHARD_ITEMS = 4_000
#: A container this full is closed; the items of others are dealt anew.
CLOSED = 0.99


@lru_cache(2)
def _counter(kind: str, data: bytes):
    """Function from a list of texts to their numbers of tokens, from the content of a vocabulary file."""
    if kind == "tiktoken":
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
        e = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(e.encode_ordinary(x)) for x in texts]
    if kind == "json":
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_str(data.decode())
        t.encode_special_tokens = True
        return lambda texts: [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_proto=data)
    return lambda texts: [len(x) for x in p.encode(texts, num_threads=1)]


def count_tokens(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id and n_tokens of each row; a NULL text has 0 tokens. Texts are measured whole.

    ``tokenizer`` is a rank file (.tiktoken), a tokenizers (.json) or a
    sentencepiece (.model) file. The driver reads it (a megabyte or two) and its
    content goes with the tasks, so executors need no copy of the file.
    """
    kind = tokenizer.rpartition(".")[2]
    if kind not in ("tiktoken", "json", "model"):
        raise ValueError(f"{tokenizer}: no known kind of vocabulary file")
    with open(tokenizer, "rb") as f:
        data = f.read()
    schema = T.StructType([T.StructField(doc_id, documents.schema[doc_id].dataType), T.StructField("n_tokens", T.LongType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(kind, data)
        for b in batches:
            sizes, part, room = [], [], 0
            for x in b.column(1).to_pylist():
                part.append(x or "")
                room += len(part[-1])
                if room > 1 << 19:
                    sizes += count(part)
                    part, room = [], 0
            sizes += count(part) if part else []
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64())], names=[doc_id, "n_tokens"])

    return documents.select(F.col(doc_id), F.col(text)).mapInArrow(work, schema)


def best_fit(sizes: np.ndarray, cap: int) -> np.ndarray:
    """Container of each item: largest first, each into the fullest container it fits in."""
    out = np.zeros(len(sizes), np.int64)
    room: list[tuple[int, int]] = []
    n = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        at = bisect_left(room, (s, -1))
        if at < len(room):
            left, b = room.pop(at)
        else:
            left, b, n = cap, n, n + 1
        out[i] = b
        insort(room, (left - s, b))
    return out


def _pairs(sizes: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of two of a container's items (sorted by size), ascending, each with one pair of items.

    Pairs are of distinct sizes, or of two items of one size. A container has
    fewer than sqrt(2 x capacity) distinct sizes, whatever its items, so there
    are no more sums than the capacity.
    """
    first = np.flatnonzero(np.append(True, sizes[own][1:] != sizes[own][:-1]))
    twice = first[np.append(np.diff(first), len(own) - first[-1]) > 1]
    i, j = np.triu_indices(len(first), 1)
    i, j = np.append(first[i], twice), np.append(first[j], twice + 1)
    both = sizes[own[i]] + sizes[own[j]]
    both, at = np.unique(both, return_index=True)
    return both, np.column_stack([own[i[at]], own[j[at]]])


def local_search(sizes: np.ndarray, bins: np.ndarray, cap: int) -> np.ndarray:
    """Containers after moves and one-for-one and two-for-one exchanges that raise the sum of squared fills.

    The emptiest underfull container gives: each step takes the best exchange
    that brings one or two of its items into a container at least as full,
    against nothing or one smaller item. It is left when nothing helps, and
    tried again after others have changed. Every step raises a sum of whole
    numbers that can't pass the containers' number times the squared capacity,
    so the search ends by itself, when nothing helps any more.
    """
    bins = bins.copy()
    n = int(bins.max()) + 1 if len(bins) else 0
    fill = np.bincount(bins, weights=sizes, minlength=n).astype(np.int64)
    stuck, changed = np.zeros(n, bool), False
    while n:
        giver = np.where((fill > 0) & (fill < cap) & ~stuck, fill, cap + 1)
        b = int(giver.argmin())
        if giver[b] > cap:
            if not changed:
                break
            stuck[:], changed = False, False  # what was stuck may help now
            continue
        own = np.flatnonzero((bins == b) & (sizes > 0))
        own = own[np.argsort(sizes[own], kind="stable")]
        takers = (fill < cap) & (fill >= fill[b])
        takers[b] = False
        items = np.flatnonzero(takers[bins])
        free = np.flatnonzero(takers)
        if not len(free):
            stuck[b] = True
            continue
        into = np.concatenate([bins[items], free])
        out = np.concatenate([sizes[items], np.zeros(len(free), np.int64)])
        room = cap - fill[into] + out
        best, what = 0, None
        gives = [(sizes[own], own[:, None])]
        if len(own) > 1:
            gives.append(_pairs(sizes, own))
        for total, which in gives:
            k = np.searchsorted(total, room, "right") - 1
            d = np.where(k >= 0, total[np.maximum(k, 0)] - out, 0)
            gain = np.where(d > 0, d * (fill[into] - fill[b] + d), 0)
            g = int(gain.argmax())
            if gain[g] > best:
                best, what = int(gain[g]), (g, which[k[g]], int(d[g]))
        if what is None:
            stuck[b] = True
            continue
        changed = True
        g, moved, d = what
        a = int(into[g])
        if g < len(items):
            bins[items[g]] = b
        bins[moved] = a
        fill[a] += d
        fill[b] -= d
    # Empty texts take no room: they follow the fullest container.
    if n and fill.any():
        bins[(sizes == 0) & (fill[bins] == 0)] = int(fill.argmax())
    return bins


def _of_target(values: dict[int, object], kind: str) -> Column:
    """What a target number stands for."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.col("target")).cast(kind)


def _pack(table: pa.Table) -> pa.Table:
    sizes = table.column("size").to_numpy()
    cap = int(table.column("cap")[0].as_py())
    order = np.lexsort((table.column("uid").to_numpy(), -sizes))
    bins = np.empty(len(sizes), np.int64)
    bins[order] = local_search(sizes[order], best_fit(sizes[order], cap), cap)
    _, bins = np.unique(bins, return_inverse=True)
    fill = np.bincount(bins, weights=sizes).astype(np.int64)[bins]
    return table.drop_columns(["cap"]).append_column("bin", pa.array(bins)).append_column("fill", pa.array(fill))


def pack(sizes: DataFrame, targets: list[tuple[str, int]], item: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """Every item in containers of each target: target_name, container_id, item, piece_no, n_tokens, fill.

    An item larger than the capacity is cut into pieces of the capacity, each a
    full container, and a rest that is packed like an item; piece_no numbers
    them from 1. No other item is cut. ``fill`` is the container's. Items of
    size 0 or NULL take no room and are placed as well; a negative size counts
    as 0. Repeated items are items of their own. Targets whose capacity is NULL
    or below 1 hold nothing and are left out. No items give no rows. The targets
    are a parameter of the plan, so a few.

    The search ends when a round over several shards saves no container.
    """
    spark = sizes.sparkSession
    targets = [(n, int(c)) for n, c in targets if c is not None and c >= 1]
    space = Workspace(spark, "packing")
    kind = sizes.schema[item].dataType
    named = "target_name string, container_id string, piece_no long, n_tokens long, fill long"
    if not targets:
        return spark.createDataFrame([], T.StructType([T.StructField(item, kind)])).select(item, *[F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in named.split(", ")])
    items = space.put(sizes.select(F.col(item).alias("item"), F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)).alias("total")).withColumn("uid", F.monotonically_increasing_id()))
    caps = F.array(*[F.struct(F.lit(i).alias("target"), F.lit(c).cast("long").alias("cap")) for i, (_, c) in enumerate(targets)])
    each = items.select("uid", "item", "total", F.explode(caps).alias("t")).select("uid", "item", "total", "t.target", "t.cap")
    whole = F.expr("total div cap")
    left = each.withColumn("size", F.col("total") - whole * F.col("cap")).filter((F.col("size") > 0) | (F.col("total") == 0)).select("uid", "item", "target", (whole + 1).alias("piece_no"), "cap", "size")

    cap = _of_target({i: c for i, (_, c) in enumerate(targets)}, "long")
    is_open = F.col("fill") < _of_target({i: int(c * CLOSED) for i, (_, c) in enumerate(targets)}, "long")
    placed_as = T.StructType([
        T.StructField("uid", T.LongType()), T.StructField("item", kind), T.StructField("target", T.IntegerType()), T.StructField("piece_no", T.LongType()),
        T.StructField("size", T.LongType()), T.StructField("shard", T.LongType()), T.StructField("bin", T.LongType()), T.StructField("fill", T.LongType()),
    ])
    cores = spark.sparkContext.defaultParallelism

    placed, n_round, opened = [], 0, {}
    counts = {r.target: r.n for r in left.groupBy("target").agg(F.count(F.lit(1)).alias("n")).collect()}
    while counts:
        shards = {t: -(-n // SHARD_ITEMS) for t, n in counts.items()}
        n_shards = sum(shards.values())
        dealt = left.withColumn("shard", F.pmod(F.xxhash64("uid", F.lit(n_round)), _of_target(shards, "long")))
        # Many shards a task once there are many more of them than cores.
        dealt = dealt.repartition(min(n_shards, max(4 * cores, -(-n_shards // 16))), "target", "shard")
        done = space.put(dealt.groupBy("target", "shard").applyInArrow(_pack, placed_as).withColumn("round", F.lit(n_round)))
        bins = done.groupBy("target", "shard", "bin").agg(F.count(F.lit(1)).alias("n"), F.first("fill").alias("fill"))
        one = lambda c: F.sum(F.when(is_open, c).otherwise(0))
        seen = {r.target: r for r in bins.groupBy("target").agg(F.count(F.lit(1)).alias("bins"), one(F.lit(1)).alias("open_bins"), one(F.col("n")).alias("open_items")).collect()}
        # A target goes on while several shards were packed apart and the last round saved a container.
        again = {t: r for t, r in seen.items() if shards[t] > 1 and r.open_items and (t not in opened or r.bins < opened[t])}
        more = is_open & F.col("target").isin(list(again))
        placed.append(done.filter(~more))
        left = done.filter(more).select("uid", "item", "target", "piece_no", cap.alias("cap"), "size")
        opened = {t: r.open_bins for t, r in again.items()}
        counts, n_round = {t: r.open_items for t, r in again.items()}, n_round + 1

    full = each.filter(whole > 0).select("uid", "item", "target", "cap", F.explode(F.sequence(F.lit(1).cast("long"), whole)).alias("piece_no"))
    out = full.select("item", "target", F.concat_ws("-", F.lit("full"), "uid", "piece_no").alias("container_id"), "piece_no", F.col("cap").alias("n_tokens"), F.col("cap").alias("fill"))
    for p in placed:
        label = F.concat_ws("-", "round", "shard", "bin").alias("container_id")
        out = out.unionByName(p.select("item", "target", label, "piece_no", F.col("size").alias("n_tokens"), "fill"))
    return out.select(_of_target({i: n for i, (n, _) in enumerate(targets)}, "string").alias("target_name"), "container_id", F.col("item").alias(item), "piece_no", "n_tokens", "fill")
