import random

from quillstream.llm.splitting import oversized, split_recordings


def brute(lines, max_ms, ov):
    """Greedy cuts of one recording: [(begin, end, cut)]."""
    ov = min(max(ov or 0, 0), max_ms - 1)
    lo, hi = min(b for b, _ in lines), max(e for _, e in lines)
    if hi - lo <= max_ms:
        return []
    free = sorted({t for x in lines for t in x if not any(b < t < e for b, e in lines)})
    out, c = [], lo + ov
    while True:
        best = [t for t in free if c < t <= c + max_ms - ov]
        end, cut = (best[-1], "end" if best[-1] == hi else "between") if best else (c + max_ms - ov, "inside")
        out.append((c - ov, end, cut))
        if end == hi:
            return out
        c = end


def run(spark, recs, limits):
    rows = [(d, f, b, e, "x") for (d, f), ls in recs.items() for b, e in ls]
    lines = spark.createDataFrame(rows, "dataset_id long, audio_file string, b long, e long, rid string")
    lim = spark.createDataFrame(limits, "dataset_id long, max_ms long, overlap_ms long")
    got = split_recordings(lines, lim, ["dataset_id", "audio_file"], ["dataset_id"]).collect()
    out = {}
    for r in sorted(got, key=lambda r: r.piece_no):
        out.setdefault((r.dataset_id, r.audio_file), []).append((r.begin_ms, r.end_ms, r.cut))
    return out


def test_against_brute_force(spark):
    rnd = random.Random(5)
    limits = [(1, 100, 10), (2, 60, 0), (3, 50, None), (4, 20, 25), (5, None, 1)]
    recs = {}
    for d, _, _ in limits:
        for k in range(12):
            t, ls = rnd.randrange(3), []
            for _ in range(rnd.randrange(1, 40)):
                b = max(0, t + rnd.choice([0, 0, 3, -4, 30]))
                e = b + rnd.choice([5, 9, 14, 33, 1, 150 if rnd.random() < 0.2 else 8])
                ls.append((b, e))
                t = e
            recs[d, f"a{k}"] = ls + ls[:2]
    by = {d: (m, o) for d, m, o in limits}
    want = {k: w for k, ls in recs.items() if by[k[0]][0] and (w := brute(ls, *by[k[0]]))}
    got = run(spark, recs, limits)
    assert got == want
    for (d, _), pieces in got.items():
        assert all(e - b <= by[d][0] for b, e, _ in pieces)


def test_shard_borders_and_long_chain(spark):
    n = 1 << 20
    recs = {(1, "long"): [(i * 1000, i * 1000 + 900) for i in range(3 * n // 1000)], (1, "hole"): [(0, 10), (3 * n, 3 * n + 10)]}
    got = run(spark, recs, [(1, 30_000, 500)])
    assert got == {k: brute(v, 30_000, 500) for k, v in recs.items()}


def test_lines_no_piece_holds(spark):
    """Lines with a hard cut inside, on random recordings, and lines that end after 1e9 s and 1e12 s."""
    rnd = random.Random(9)
    rows, want = [], set()
    for k in range(30):
        t, ls = 0, []
        for _ in range(rnd.randrange(1, 25)):
            b = max(0, t + rnd.choice([0, 2, -6, 70]))
            ls.append((b, b + rnd.choice([4, 20, 49, 51, 130])))
            t = ls[-1][1]
        cuts = [end for _, end, cut in brute(ls, 50, 8) if cut == "inside"]
        for i, (b, e) in enumerate(ls):
            rows.append((1, f"r{k}", b, e, f"{k}.{i}"))
            inside = [c for c in cuts if b < c < e]
            if inside:
                want.add((f"{k}.{i}", min(inside)))
    far = [(1, "far", 0, 10**12, "f1"), (1, "far", 10**12 + 7, 10**12 + 9, "f2"), (1, "further", 3, 10**15, "g1"), (1, "further", 5, 10, "g2"), (1, "further", 40, 60, "g3")]
    lines = spark.createDataFrame(rows + far, "dataset_id long, audio_file string, b long, e long, rid string")
    files, torn = oversized(lines.withColumnRenamed("rid", "line"), spark.createDataFrame([(1, 50, 8)], "dataset_id long, max_ms long, overlap_ms long"), ["dataset_id", "audio_file"], ["dataset_id"])
    assert {(r.line, r.first_cut) for r in torn.collect()} == want | {("f1", 50), ("g1", 53), ("g3", 53)}
    n = {r.audio_file: r.n_pieces for r in files.collect()}
    assert n["far"] == 1 + -(-(10**12 + 9 - 50) // 42) and n["further"] == 1 + -(-(10**15 - 53) // 42)
    assert all(v == len(brute([r[2:4] for r in rows if r[1] == k], 50, 8)) for k, v in n.items() if k[0] == "r")


def test_long_hole(spark):
    """A hole of 3,000 s at pieces of 100 ms is more than one block of pieces."""
    recs = {(1, "hole"): [(0, 10), (3_000_000, 3_000_010)]}
    assert run(spark, recs, [(1, 100, 9)]) == {k: brute(v, 100, 9) for k, v in recs.items()}


def test_empty(spark):
    assert run(spark, {}, []) == {}
    assert run(spark, {(1, "a"): [(0, 10)], (None, "b"): [(0, 99)], (1, None): [(0, 99)]}, [(1, 10, 0)]) == {}
