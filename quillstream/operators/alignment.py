"""Letters, tokens and frames brought together."""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstream.operators.diff import diff_texts

_SPANS = T.ArrayType(T.StructType([T.StructField("token", T.IntegerType()), T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())]))
_LETTERS = T.ArrayType(T.StructType([T.StructField("id", T.LongType()), T.StructField("ch", T.StringType()), T.StructField("ts", T.DoubleType()), T.StructField("kind", T.StringType())]))


def collapse(path: Sequence[int]) -> list[tuple[int, int, int]]:
    """Runs of a frame path: (token, first frame, frame after the last) (DIF-16)."""
    out: list[list[int]] = []
    for i, t in enumerate(path):
        if out and out[-1][0] == t:
            out[-1][2] = i + 1
        else:
            out.append([t, i, i + 1])
    return [tuple(r) for r in out]


def padded(path: Sequence[int], blank: int = 0) -> list[tuple[int, int, int]]:
    """Token spans without blanks; a blank between two tokens is shared by halves, one at an end goes to its neighbour (DIF-17)."""
    runs = collapse(path)
    out = []
    for k, (t, a, b) in enumerate(runs):
        if t == blank:
            continue
        if k and runs[k - 1][0] == blank:
            _, x, y = runs[k - 1]
            a = x if k == 1 else y - (y - x) // 2
        if k + 1 < len(runs) and runs[k + 1][0] == blank:
            _, x, y = runs[k + 1]
            b = y if k + 2 == len(runs) else x + (y - x + 1) // 2
        out.append((t, a, b))
    return out


def align_letters(audio: Sequence[tuple[str, float]], text: Sequence[tuple[int, str]]) -> list[tuple[int | None, str, float | None, str]]:
    """Recognised letters with times laid against the text's letters with ids (DIF-13..15).

    ``same``: id and time; ``audio``: only heard, with the id of the text letter
    that follows (the last one's at the end), spaces left out; ``text``: only written, without a time.
    """
    out, i, j = [], 0, 0
    for op, part in diff_texts("".join(c for c, _ in audio), "".join(c for _, c in text)):
        for c in part:
            if op == 0:
                out.append((text[j][0], c, audio[i][1], "same"))
                i, j = i + 1, j + 1
            elif op == -1:
                if not c.isspace():
                    out.append((text[min(j, len(text) - 1)][0] if text else None, c, audio[i][1], "audio"))
                i += 1
            else:
                out.append((text[j][0], c, None, "text"))
                j += 1
    return out


def guided_search(frames: Sequence[list[float]], target: Sequence[int], blank: int = 0, width: int = 16, match: float = 1.0, skip: float = 2.0, insert: float = 1.5, look: int = 2) -> list[int]:
    """Tokens heard in frames of log scores, guided by the expected ones (DIF-19, SRT-06).

    A hypothesis may stay (blank or the same token), take the next expected
    token (with a bonus), leave out up to ``look`` expected ones (a penalty
    each) or take the frame's best other token (a penalty). Between two equal
    tokens a blank is needed. The best ``width`` hypotheses go on; ties go to
    the earlier place in the target.
    """
    # What a hypothesis has said is a node: the node before and one token more; node 0 is nothing.
    before, tokens, nodes = [0], [blank], {}

    def said(node: int, token: int) -> int:
        new = nodes.setdefault((node, token), len(before))
        if new == len(before):
            before.append(node)
            tokens.append(token)
        return new

    beam: dict[tuple[int, int, int], float] = {(0, blank, 0): 0.0}
    for f in frames:
        best_other = f.index(max(f)) if f else blank
        new: dict[tuple[int, int, int], float] = {}

        def put(key, score):
            if score > new.get(key, float("-inf")):
                new[key] = score

        for (at, last, node), score in beam.items():
            put((at, blank, node), score + f[blank])
            if last != blank:
                put((at, last, node), score + f[last])
            for left_out in range(look + 1):
                k = at + left_out
                if k < len(target) and target[k] != last:
                    put((k + 1, target[k], said(node, target[k])), score + f[target[k]] + match - skip * left_out)
            if best_other not in (blank, last):
                put((at, best_other, said(node, best_other)), score + f[best_other] - insert)
        beam = dict(heapq.nlargest(width, new.items(), key=lambda kv: (kv[1], -kv[0][0])))
    if not beam:
        return []
    end = lambda kv: kv[1] - skip * (len(target) - kv[0][0])
    node, out = max(beam.items(), key=lambda kv: (end(kv), -kv[0][0]))[0][2], []
    while node:
        out.append(tokens[node])
        node = before[node]
    return out[::-1]


@F.arrow_udf(_SPANS)
def _padded(path: pa.Array, blank: pa.Array) -> pa.Array:
    rows = [None if p is None else [dict(zip(("token", "first", "last"), s)) for s in padded(p, b)] for p, b in zip(path.to_pylist(), blank.to_pylist())]
    return pa.array(rows, pa.list_(pa.struct([("token", pa.int32()), ("first", pa.int32()), ("last", pa.int32())])))


@F.arrow_udf(_LETTERS)
def _aligned(audio: pa.Array, text: pa.Array) -> pa.Array:
    rows = []
    for a, t in zip(audio.to_pylist(), text.to_pylist()):
        done = None if a is None or t is None else align_letters([(x["ch"], x["ts"]) for x in a], [(x["id"], x["ch"]) for x in t])
        rows.append(None if done is None else [dict(zip(("id", "ch", "ts", "kind"), r)) for r in done])
    return pa.array(rows, pa.list_(pa.struct([("id", pa.int64()), ("ch", pa.string()), ("ts", pa.float64()), ("kind", pa.string())])))


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _searched(frames: pa.Array, target: pa.Array) -> pa.Array:
    rows = [None if f is None or t is None else guided_search(f, t) for f, t in zip(frames.to_pylist(), target.to_pylist())]
    return pa.array(rows, pa.list_(pa.int32()))


def token_spans(path: Column, blank: int = 0) -> Column:
    """array<struct<token, first, last>> of a path of frames."""
    return _padded(path, F.lit(blank))


def aligned_letters(audio: Column, text: Column) -> Column:
    """array<struct<id, ch, ts, kind>> of array<struct<ch, ts>> and array<struct<id, ch>>."""
    return _aligned(audio, text)


def heard_tokens(frames: Column, target: Column) -> Column:
    return _searched(frames, target)


def audio_windows(duration: Column, length: float = 30.0, overlap: float = 0.1) -> Column:
    """array<struct<begin, end>> of windows over a recording, each with context of the one before (DIF-18)."""
    n = F.greatest(F.ceil(duration / length), F.lit(1)).cast("int")
    return F.when(duration > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.greatest(i * length - length * overlap, F.lit(0.0)).alias("begin"), F.least((i + 1) * F.lit(length), duration).alias("end"))))


def long_gap_places(gaps: Column, limit: float) -> Column:
    """Places of gaps over a limit (DIF-12)."""
    return F.filter(F.transform(gaps, lambda g, i: F.when(g > limit, i)), lambda x: x.isNotNull())


def with_word_spaces(words: Column) -> Column:
    """Letters of words, with a space before each word but the first (DIF-11)."""
    return F.flatten(F.transform(words, lambda w, i: F.when(i > 0, F.concat(F.array(F.lit(" ")), F.split(w, ""))).otherwise(F.split(w, ""))))


@F.arrow_udf(_SPANS)
def _runs(path: pa.Array) -> pa.Array:
    rows = [None if p is None else [dict(zip(("token", "first", "last"), s)) for s in collapse(p)] for p in path.to_pylist()]
    return pa.array(rows, pa.list_(pa.struct([("token", pa.int32()), ("first", pa.int32()), ("last", pa.int32())])))


def frame_runs(path: Column) -> Column:
    """array<struct<token, first, last>> of the runs of a path of frames, blanks too (DIF-16)."""
    return _runs(path)
