import collections
import os

import numpy as np
import pytest

from quillstream.llm import packing
from quillstream.llm.packing import TOKENIZER, best_fit, count_tokens, local_search, pack


@pytest.mark.parametrize("cap,seed", [(50, 1), (512, 2), (1000, 3)])
def test_local_search(cap, seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(0, cap, 400)
    start = np.arange(400) // 2 if cap == 1000 else best_fit(sizes, cap)
    if cap == 1000:
        sizes //= 2
    before = np.bincount(start, weights=sizes)
    bins = local_search(sizes, start, cap)
    fill = np.bincount(bins, weights=sizes)
    assert fill.max() <= cap and fill.sum() == sizes.sum()
    assert (fill**2).sum() >= (before**2).sum()
    assert (fill > 0).sum() <= (before > 0).sum()
    if cap == 1000:
        assert (fill > 0).sum() <= 1.08 * -(-sizes.sum() // cap)


def test_search_finds_what_best_fit_misses():
    sizes = np.array([6, 5, 5, 4, 4, 3, 3])  # 30 in three tens; largest-first needs a fourth
    start = np.array([0, 1, 2, 1, 2, 0, 3])
    assert len(set(local_search(sizes, start, 10))) == 3


def test_pairs_of_a_container_with_many_items():
    """Two-for-one exchanges whatever the number of items: all sums are found, by pairs of the container's own items."""
    rng = np.random.default_rng(3)
    sizes = np.sort(rng.integers(1, 40, 700))
    own = np.arange(700)
    both, pairs = packing._pairs(sizes, own)
    assert both.tolist() == sorted({int(a + b) for i, a in enumerate(sizes) for b in sizes[i + 1 :]})
    assert (sizes[pairs].sum(1) == both).all() and (pairs[:, 0] < pairs[:, 1]).all()
    # Only two of the giver's 300 items together against one larger item empty a container.
    sizes = np.array([1] * 300 + [400, 398])
    assert len(set(local_search(sizes, np.array([0] * 300 + [1, 1]), 800))) == 2


def check(rows, items, targets):
    """Everything placed once, whole or in pieces of the capacity; no container too full."""
    for name, cap in targets:
        own = [r for r in rows if r.target_name == name]
        fill = collections.Counter()
        by = collections.defaultdict(list)
        for r in own:
            fill[r.container_id] += r.n_tokens
            by[r.doc_id].append((r.piece_no, r.n_tokens))
        assert max(fill.values(), default=0) <= cap
        assert all(fill[r.container_id] == r.fill for r in own)
        want = collections.defaultdict(list)
        for d, n in items:
            n = max(n or 0, 0)
            want[d] += [(k + 1, cap) for k in range(n // cap)] + ([(n // cap + 1, n % cap)] if n % cap or not n else [])
        assert {k: sorted(v) for k, v in by.items()} == {k: sorted(v) for k, v in want.items()}
    assert {r.target_name for r in rows} <= {n for n, _ in targets}
    return collections.Counter(r.target_name for r in {(r.target_name, r.container_id): r for r in rows}.values())


def test_pack(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ITEMS", 60)
    rng = np.random.default_rng(7)
    items = [(int(i), int(rng.choice([3, 20, 45, 90, 130, 450]))) for i in range(500)] + [(1, 20), (None, 7), (900, None), (901, 0), (902, -5), (903, 100), (904, 1000)]
    df = spark.createDataFrame([(*x, "c", 1) for x in items], "doc_id long, n_tokens long, size string, target int")
    targets = [("a", 100), ("b", 300)]
    n = check(pack(df, [*targets, ("none", None), ("zero", 0)]).collect(), items, targets)
    total = sum(max(x or 0, 0) for _, x in items)
    assert n["a"] <= 1.06 * total / 100 and n["b"] <= 1.03 * total / 300


def test_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, n_tokens long")
    assert pack(df, [("a", 10)]).count() == 0
    one = spark.createDataFrame([(1, 5)], df.schema)
    assert pack(one, []).count() == 0
    rows = pack(spark.createDataFrame([(i, 0) for i in range(9)], df.schema), [("a", 10)]).collect()
    assert len(rows) == 9


@pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no tokenizer file")
def test_tokens(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "one two"), (4, "x" * 200_000), (5, "<|endoftext|>")], "doc_id long, text string")
    n = {r.doc_id: r.n_tokens for r in count_tokens(df).collect()}
    assert n[1] == n[2] == 0 and n[3] == 2 and n[4] > 1000 and n[5] > 1


def test_vocabulary_files_agree():
    """The rank file and the tokenizers file of one vocabulary give the same sizes."""
    folder = os.path.dirname(TOKENIZER)
    if not os.path.exists(f"{folder}/byte_bpe_50k.json"):
        pytest.skip("no tokenizer files")
    texts = ["", "Hello, world's  end\n\n 12 345", "Эта река…", "naïve \u200b x", "a" * 5000, " \t "]
    n = [packing._counter(f.rpartition(".")[2], open(f"{folder}/{f}", "rb").read())(texts) for f in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")]
    assert n[0] == n[1]
