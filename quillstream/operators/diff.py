"""Comparison of two texts and suppression of systematic differences.

Only the diff itself is Python (an Arrow function); scoring, pattern counts and
suppression are DataFrame operations. An op is -1 (only in base), 0 (equal) or
1 (only in comp).
"""

from __future__ import annotations

from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Steps beyond so many are taken for all diagonals at once, with the same result.
MAX_STEPS = 2_000

DIFFS = T.ArrayType(T.StructType([T.StructField("op", T.IntegerType()), T.StructField("text", T.StringType())]))


def _step(a: str, b: str, ca: np.ndarray, cb: np.ndarray, reach, d: int):
    """Furthest x on the diagonals -d, -d + 2 ... d after d steps, from those after d - 1 steps."""
    n, m = len(a), len(b)
    if d <= MAX_STEPS:
        out = []
        for i in range(d + 1):
            x = reach[i] if i == 0 or (i != d and reach[i - 1] < reach[i]) else reach[i - 1] + 1
            k = 2 * i - d
            while x < n and x - k < m and a[x] == b[x - k]:
                x += 1
            out.append(x)
        return out
    reach = np.asarray(reach)
    low, high = np.append(-1, reach), np.append(reach, -1)  # from diagonal k - 1, one deleted, and k + 1, one inserted
    x = np.where(low < high, high, low + 1)
    k = np.arange(-d, d + 1, 2)
    live = np.arange(d + 1)
    while len(live):
        p, q = x[live], x[live] - k[live]
        live = live[(p < n) & (q < m)]
        live = live[ca[x[live]] == cb[x[live] - k[live]]]
        x[live] += 1
    return x


def _script(a: str, b: str) -> list[tuple[int, str]]:
    """Shortest edit script of two texts without common ends: greedy furthest-reaching paths, then traced back.

    Of the steps' ends only every so many are kept; those between are found
    again on the way back. They are kept at growing distances, so that texts of
    any length take memory of the number of steps to the power 1.5 at most.
    """
    n, m = len(a), len(b)
    ca, cb = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in (a, b))
    first = 0
    while first < min(n, m) and a[first] == b[first]:
        first += 1
    reach, d, kept, next_kept = [first], 0, {0: [first]}, 1
    while not ((n - m + d) % 2 == 0 and abs(n - m) <= d and reach[(n - m + d) // 2] >= n):
        d += 1
        reach = _step(a, b, ca, cb, reach, d)
        if d == next_kept:
            kept[d] = reach
            next_kept = d + 1 + isqrt(d)
    out: list[tuple[int, str]] = []
    x, y, top = n, m, d
    for base in sorted(kept, reverse=True):
        if base >= top and top:
            continue
        seen = [kept[base]]
        for step in range(base + 1, top):
            seen.append(_step(a, b, ca, cb, seen[-1], step))
        for step in range(top, base, -1):
            v, k = seen[step - 1 - base], x - y
            i = (k + step) // 2  # v[i - 1] is diagonal k - 1, v[i] is k + 1
            down = i == 0 or (i != step and v[i - 1] < v[i])
            x0 = int(v[i] if down else v[i - 1])
            y0 = x0 - (k + 1 if down else k - 1)
            start = x0 if down else x0 + 1
            if x > start:
                out.append((0, a[start:x]))
            out.append((1, b[y0 : y0 + 1]) if down else (-1, a[x0 : x0 + 1]))
            x, y = x0, y0
        top = base
    if x:
        out.append((0, a[:x]))
    return out[::-1]


def diff_texts(base: str, comp: str) -> list[tuple[int, str]]:
    """Merged diff: neighbouring equal ops joined, and what is deleted comes before what is inserted."""
    n = 0
    while n < min(len(base), len(comp)) and base[n] == comp[n]:
        n += 1
    e = 0
    while e < min(len(base), len(comp)) - n and base[-1 - e] == comp[-1 - e]:
        e += 1
    a, b = base[n : len(base) - e], comp[n : len(comp) - e]
    if not a or not b:
        steps = [(-1, a), (1, b)]
    else:
        steps = _script(a, b)
    out: list[tuple[int, str]] = []
    gone = came = ""
    for op, text in [(0, base[:n]), *steps, (0, base[len(base) - e :]), (0, "")]:
        if op == -1:
            gone += text
        elif op == 1:
            came += text
        elif text or not out or out[-1][0] == 0:
            if gone:
                out.append((-1, gone))
            if came:
                out.append((1, came))
            gone = came = ""
            if text and out and out[-1][0] == 0:
                out[-1] = (0, out[-1][1] + text)
            elif text:
                out.append((0, text))
    return out + [(o, t) for o, t in ((-1, gone), (1, came)) if t]


@F.arrow_udf(DIFFS)
def _diff(base: pa.Array, comp: pa.Array) -> pa.Array:
    rows = [None if a is None or b is None else [{"op": o, "text": t} for o, t in diff_texts(a, b)] for a, b in zip(base.to_pylist(), comp.to_pylist())]
    return pa.array(rows, pa.list_(pa.struct([("op", pa.int32()), ("text", pa.string())])))


def diffs(base: Column, comp: Column) -> Column:
    """Diff of two trimmed texts; NULL if either is NULL (DIF-01)."""
    return _diff(F.trim(base), F.trim(comp))


def only_spaces(d: Column) -> Column:
    """Whether nothing but white space differs (STR-31)."""
    return F.forall(d, lambda x: (x["op"] == 0) | (F.trim(x["text"]) == ""))


def length_of(d: Column, *ops: int) -> Column:
    """Characters of the given ops (AGG-15)."""
    return F.aggregate(d, F.lit(0), lambda a, x: a + F.when(x["op"].isin(*ops), F.length(x["text"])).otherwise(0))


def longest_run(d: Column) -> Column:
    """Most characters between two equal parts (AGG-15)."""
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("top"))
    step = lambda a, x: F.struct(
        F.when(x["op"] == 0, 0).otherwise(a["now"] + F.length(x["text"])).alias("now"),
        F.greatest(a["top"], F.when(x["op"] == 0, 0).otherwise(a["now"] + F.length(x["text"]))).alias("top"),
    )
    return F.aggregate(d, start, step, lambda a: a["top"])


def error_percent(d: Column, base: Column, comp: Column) -> Column:
    """Differing characters per mean length in bytes, in percent (AGG-15)."""
    return length_of(d, -1, 1) * 100.0 / F.nullif((F.octet_length(base) + F.octet_length(comp)) / 2, F.lit(0.0))


def rendered(d: Column, tags: tuple[str, str] = ("del", "ins")) -> Column:
    """HTML of a diff, texts escaped (SNK-10)."""
    safe = lambda t: F.replace(F.replace(F.replace(t, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    tag = lambda n, t: F.concat(F.lit(f"<{n}>"), t, F.lit(f"</{n}>"))
    return F.array_join(F.transform(d, lambda x: F.when(x["op"] == -1, tag(tags[0], safe(x["text"]))).when(x["op"] == 1, tag(tags[1], safe(x["text"]))).otherwise(safe(x["text"]))), "")


def difference_runs(pairs: DataFrame, key: str, d: str) -> DataFrame:
    """Runs of differing characters: key, run, pattern such as ``-a+b``, n (DIF-06, DIF-09, AGG-20)."""
    ops = pairs.select(key, F.posexplode(d).alias("pos", "x")).select(key, "pos", "x.op", "x.text")
    # A run lies between two equal parts, so the number of equal parts before it numbers it.
    w = W.partitionBy(key).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    ops = ops.withColumn("run", F.sum((F.col("op") == 0).cast("int")).over(w)).filter("op <> 0")
    sign = F.when(F.col("op") == 1, "+").otherwise("-")
    part = F.array_join(F.transform(F.split("text", ""), lambda c: F.concat(sign, c)), "")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("pos", part.alias("p")))), lambda r: r["p"])
    return ops.groupBy(key, "run").agg(F.array_join(parts, "").alias("pattern"), F.sum(F.length("text")).alias("n"))


def suppress_systematic(pairs: DataFrame, key: str, d: str, words: DataFrame, threshold: int) -> DataFrame:
    """``pairs`` with ``kept``: diffs without the differences that recur (DIF-05..08, AGG-20, AGG-22).

    A run's pattern is systematic if it occurs more than ``threshold`` times in
    all pairs, unless it spells one of ``words`` (column ``word``, lower case)
    inserted or deleted. In systematic runs what was deleted becomes equal and
    what was inserted goes; a pair may be left without differences.
    """
    runs = difference_runs(pairs, key, d)
    spelled = words.select(F.explode(F.array(*[F.concat(F.lit(s), F.array_join(F.split("word", ""), s)) for s in "+-"])).alias("pattern")).distinct()
    often = runs.groupBy("pattern").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > threshold).join(spelled, "pattern", "left_anti")
    drop = runs.join(often.select("pattern"), "pattern", "left_semi").groupBy(key).agg(F.collect_set("run").alias("gone"))
    out = pairs.join(drop, key, "left")
    # Number of equal parts up to each op, as in difference_runs.
    numbered = F.transform(d, lambda x, i: F.struct(x["op"].alias("op"), x["text"].alias("text"), F.size(F.filter(F.slice(d, 1, i + 1), lambda y: y["op"] == 0)).alias("run")))
    hit = lambda x: F.coalesce(F.array_contains("gone", x["run"].cast("bigint")), F.lit(False))
    kept = F.filter(numbered, lambda x: ~((x["op"] == 1) & hit(x)))
    kept = F.transform(kept, lambda x: F.struct(F.when((x["op"] == -1) & hit(x), 0).otherwise(x["op"]).alias("op"), x["text"].alias("text")))
    return out.withColumn("kept", kept).drop("gone")


def word_patterns(pairs: DataFrame, key: str, d: str) -> DataFrame:
    """Patterns of the words that differ: key, word_no, pattern such as ``=c-a+u=t`` (AGG-21).

    A word ends at a blank that both texts have; words without a difference
    aren't given. Blanks that were only inserted or deleted are part of a word.
    """
    ops = pairs.select(key, F.posexplode(d).alias("pos", "x")).select(key, "pos", "x.op", F.posexplode(F.split("x.text", "")).alias("at", "c")).filter("c <> ''")
    w = W.partitionBy(key).orderBy("pos", "at").rowsBetween(W.unboundedPreceding, 0)
    blank = (F.col("op") == 0) & F.col("c").rlike(r"^\s$")
    ops = ops.withColumn("blank", blank).withColumn("word_no", F.sum(blank.cast("int")).over(w)).filter(~F.col("blank"))
    sign = F.when(F.col("op") == 0, "=").when(F.col("op") == 1, "+").otherwise("-")
    got = ops.groupBy(key, "word_no").agg(F.max((F.col("op") != 0).cast("int")).alias("differs"), F.array_sort(F.collect_list(F.struct("pos", "at", F.concat(sign, "c").alias("p")))).alias("ps"))
    return got.filter("differs = 1").select(key, F.col("word_no").cast("long").alias("word_no"), F.array_join(F.transform("ps", lambda r: r["p"]), "").alias("pattern"))
