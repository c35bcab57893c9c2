"""Recognised letters laid into long silences of aligned text (JOI-28, DIF-10 to DIF-13)."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstream.operators.diff import diff_texts

_PLACED = T.ArrayType(T.StructType([T.StructField("at", T.IntegerType()), T.StructField("ch", T.StringType()), T.StructField("heard", T.BooleanType())]))


def cleaned(ops: Sequence[tuple[int, str]]) -> list[tuple[int, str]]:
    """A diff without equal parts that mean little (DIF-10).

    An equal part goes into the differences around it if it is no longer than
    the longer of what is deleted and inserted on its left, and on its right.
    Taking one in may make the next one such a part, so it is repeated until
    none is left.
    """
    # Runs between equal parts: (deleted, inserted), with the equal part that follows each.
    runs: list[list[str]] = [["", ""]]
    same: list[str] = []
    for op, text in ops:
        if op == 0:
            same.append(text)
            runs.append(["", ""])
        else:
            runs[-1][op == 1] += text
    size = lambda r: max(len(r[0]), len(r[1]))
    k = 0
    while k < len(same):
        if same[k] and size(runs[k]) and size(runs[k + 1]) and len(same[k]) <= size(runs[k]) and len(same[k]) <= size(runs[k + 1]):
            runs[k : k + 2] = [[runs[k][i] + same[k] + runs[k + 1][i] for i in (0, 1)]]
            del same[k]
            k = max(k - 1, 0)
        else:
            k += 1
    out: list[tuple[int, str]] = []
    for i, (gone, came) in enumerate(runs):
        out += [(op, text) for op, text in ((-1, gone), (1, came)) if text]
        if i < len(same) and same[i]:
            out.append((0, same[i]))
    return out


def splice(chars: Sequence[str], silences: Sequence[int], heard: str) -> list[tuple[int, str, bool]]:
    """Letters with those heard in silences laid in: (place of the letter, letter, whether only heard).

    ``silences`` are places after which a long silence lies. The text of the
    letters is compared with what was heard; where the comparison, right after
    such a letter, has letters that were only heard, they follow it with its
    place. The text's and the heard text's outer blanks don't count.
    """
    text = "".join(chars)
    lead = len(text) - len(text.lstrip())
    ops = [(op, c) for op, part in cleaned(diff_texts(text.strip(), heard.strip())) for c in part]
    at = [i for i, (op, _) in enumerate(ops) if op != 1]  # where each letter of the text stands
    long = set(silences)
    out: list[tuple[int, str, bool]] = []
    for k, c in enumerate(chars):
        out.append((k, c, False))
        if k in long and 0 <= k - lead < len(at):
            i = at[k - lead] + 1
            while i < len(ops) and ops[i][0] == 1:
                out.append((k, ops[i][1], True))
                i += 1
    return out


@F.arrow_udf(_PLACED)
def _spliced(chars: pa.Array, silences: pa.Array, heard: pa.Array) -> pa.Array:
    rows = []
    for c, s, h in zip(chars.to_pylist(), silences.to_pylist(), heard.to_pylist()):
        if c is None:
            rows.append(None)
            continue
        done = [(i, x, False) for i, x in enumerate(c)] if not s or h is None else splice(c, s, h)
        rows.append([{"at": i, "ch": x, "heard": y} for i, x, y in done])
    return pa.array(rows, pa.list_(pa.struct([("at", pa.int32()), ("ch", pa.string()), ("heard", pa.bool_())])))


def spliced(chars: Column, silences: Column, heard: Column) -> Column:
    """array<struct<at, ch, heard>> of a line's letters (an array), the places of its long silences and the heard text.

    Without silences or heard text the letters stay as they are; NULL letters
    give NULL.
    """
    return _spliced(chars, silences, heard)


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("op", T.IntegerType()), T.StructField("text", T.StringType())])))
def _clean_diff(base: pa.Array, comp: pa.Array) -> pa.Array:
    rows = [None if a is None or b is None else [{"op": o, "text": t} for o, t in cleaned(diff_texts(a, b))] for a, b in zip(base.to_pylist(), comp.to_pylist())]
    return pa.array(rows, pa.list_(pa.struct([("op", pa.int32()), ("text", pa.string())])))


def clean_diffs(base: Column, comp: Column) -> Column:
    """Diff of two trimmed texts without small equal parts; NULL if either is NULL (DIF-10)."""
    return _clean_diff(F.trim(base), F.trim(comp))
