"""Problem 4: texts that look alike brought to one form.

Arrow text buffers are read as one numpy array of code points for a whole
batch; tables give each code point its expansion, its look-alike in the wanted
alphabet and its combining class, and marks are ordered and composed for all
texts at once. No string function is called for a single text.
"""

from __future__ import annotations

import unicodedata as U
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ALPHABETS = ("", "Latn", "Cyrl")
#: Code points processed at once (a longer text is still processed whole).
CHUNK = 1 << 21
_TOP = 0x110000

# Letters that look the same, one line a script, column by column.
_LATIN = "ABCEHIJKMOPSTXYaceopxyshijdqw"
_CYRIL = "АВСЕНІЈКМОРЅТХУасеорхуѕһіјԁԛԝ"
_GREEK_UPPER, _GREEK_UPPER_AS = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϿ", "ABEZHIKMNOPTYXCϽ"
_GREEK_LOWER, _GREEK_LOWER_AS = "αικνορυχγϲϳ", "aikvopuxycj"
_MORE_CYRIL, _MORE_CYRIL_AS = "ӀӏкԚԜҮү", "IlkQWYy"

#: Belong to the form though they have a plainer spelling.
_KEEP = frozenset("…“”„‟‘’‚‛«»‹›‒–—―µ")
_PLAIN = {0x2010: "-", 0x2011: "-", 0x2212: "-"}
_KINDS = ("<wide>", "<narrow>", "<small>", "<noBreak>", "<font>", "<isolated>", "<initial>", "<medial>", "<final>")
_IGNORED = (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180E, 0x180F, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0))


def _ranges():
    """Code points that may expand, combine or be dropped."""
    for a, b in ((0, 0x3400), (0xA000, 0xAC00), (0xD7B0, 0xD800), (0xF900, 0x20000), (0x2F800, 0x2FA20), (0xE0000, 0xE0200)):
        yield from range(a, b)


def _expand(cp: int) -> list[int]:
    """Fully decomposed plain form of a code point, before any look-alike."""
    c = chr(cp)
    if c in _KEEP:
        return [cp]
    if cp in _PLAIN:
        return [ord(_PLAIN[cp])]
    kind = U.category(c)
    if c in "\t\n\r" or kind in ("Zs", "Zl", "Zp"):
        return [32]
    if kind in ("Cf", "Cc") or cp in _IGNORED:
        return []
    if kind == "Nd":
        return [48 + U.digit(c)]
    how = U.decomposition(c).split()
    if not how:
        return [cp]
    if how[0][0] == "<":
        if how[0] not in _KINDS and not (how[0] == "<compat>" and kind in ("Lu", "Ll", "Lt", "Lo", "Lm", "Nl", "Po")) or how[1] == "0020":
            return [cp]
        how = how[1:]
    return [y for x in how for y in _expand(int(x, 16))]


class Tables:
    """Lookup tables; built once a process from the interpreter's Unicode data."""

    def __init__(self) -> None:
        self.ccc = np.zeros(_TOP, np.uint8)
        self.script = np.zeros(_TOP, np.uint8)  # of letters: 1 Latin, 2 Cyrillic, 3 another
        for a, b in ((0x3400, 0xA000), (0xAC00, 0xD7A4), (0x20000, 0x2F800), (0x30000, 0x33480)):
            self.script[a:b] = 3
        data, self.off, self.len = [], np.zeros(_TOP, np.int64), np.ones(_TOP, np.int64)
        extra: list[int] = []
        pairs: dict[int, int] = {}
        self.second = np.zeros(_TOP, bool)  # starters that compose with what precedes them
        for cp in _ranges():
            c = chr(cp)
            self.ccc[cp] = U.combining(c)
            kind = U.category(c)
            if kind[0] == "L":
                name = U.name(c, "")
                self.script[cp] = 1 if name.startswith("LATIN") else 2 if name.startswith("CYRILLIC") else 0 if kind == "Lm" or name.startswith(("FEMININE", "MASCULINE", "MICRO")) else 3
            to = _expand(cp)
            if to != [cp]:
                self.off[cp], self.len[cp] = _TOP + len(extra), len(to)
                extra += to
            how = U.decomposition(c).split()
            if len(how) == 2 and how[0][0] != "<" and U.normalize("NFC", c) == c:
                a, b = (int(x, 16) for x in how)
                pairs[a << 21 | b] = cp
                if not U.combining(chr(b)):
                    self.second[b] = True
        for lv in range(0xAC00, 0xD7A4, 28):  # the composition rule of Hangul
            i = (lv - 0xAC00) // 28
            pairs[(0x1100 + i // 21) << 21 | (0x1161 + i % 21)] = lv
            for t in range(1, 28):
                pairs[lv << 21 | (0x11A7 + t)] = lv + t
        self.second[0x1161:0x1176] = True
        self.second[0x11A8:0x11C3] = True
        plain = self.off == 0
        self.off[plain] = np.flatnonzero(plain)
        self.data = np.concatenate([np.arange(_TOP, dtype=np.uint32), np.array(extra, np.uint32)])
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_to = np.array([pairs[k] for k in sorted(pairs)], np.uint32)
        self.look = np.tile(np.arange(_TOP, dtype=np.uint32), (3, 1))
        for fr, to in ((_CYRIL, _LATIN), (_MORE_CYRIL, _MORE_CYRIL_AS), (_GREEK_UPPER, _GREEK_UPPER_AS), (_GREEK_LOWER, _GREEK_LOWER_AS)):
            for a, b in zip(fr, to, strict=True):
                self.look[1, ord(a)] = ord(b)
        to_cyrillic = dict(zip(_LATIN, _CYRIL, strict=True)) | {"k": "к"}
        for a, b in to_cyrillic.items():
            self.look[2, ord(a)] = ord(b)
        for fr, to in ((_GREEK_UPPER, _GREEK_UPPER_AS), (_GREEK_LOWER, _GREEK_LOWER_AS)):
            for a, b in zip(fr, to, strict=True):
                if b in to_cyrillic:
                    self.look[2, ord(a)] = ord(to_cyrillic[b])
        self.own = np.array([[True, True, True, True], [True, True, False, False], [True, False, True, False]])
        # Inert: stays as it is, wherever it stands, unless a mark or a second starter follows.
        self.inert = np.zeros((3, _TOP), bool)
        every = np.array([cp for cp in _ranges() if not 0xD800 <= cp <= 0xDFFF], np.uint32)
        self.inert[:] = ~self.second
        for a in range(3):
            out, n = self.compose(*self.flatten(every, np.arange(len(every)), np.full(len(every), a)), len(every))
            first = np.minimum(np.append(0, np.cumsum(n))[:-1], len(out) - 1)
            self.inert[a, every] = (n == 1) & (out[first] == every) & (self.ccc[every] == 0) & ~self.second[every]

    def flatten(self, cps: np.ndarray, row: np.ndarray, alpha: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expansions, then look-alikes: code points and their rows. alpha: by code point."""
        n = self.len[cps]
        start = np.cumsum(n) - n
        out = self.data[np.repeat(self.off[cps] - start, n) + np.arange(int(n.sum()))]
        return self.look[np.repeat(alpha, n), out], np.repeat(row, n)

    def compose(self, cps: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """Marks in the standard order and composed: code points, and their number by row."""
        if not len(cps):
            return cps, np.zeros(rows, np.int64)
        ccc = self.ccc[cps]
        if ccc.any():
            head = ccc == 0
            head[0] = True
            head[1:] |= row[1:] != row[:-1]
            cluster = np.cumsum(head) - 1
            size = np.bincount(cluster)
            many = size > 2
            if many.any():
                order = np.lexsort((ccc, cluster))  # stable, and starters have class 0
                cps, ccc = cps[order], ccc[order]
            first = np.flatnonzero(head)
            starter, last = cps[first].copy(), np.zeros(len(first), np.int64)
            last[ccc[first] != 0] = 256  # no starter: nothing composes
            gone = np.zeros(len(cps), bool)
            place = np.arange(len(cps)) - first[cluster]
            marks = np.flatnonzero(place > 0)
            marks = marks[np.argsort(place[marks], kind="stable")]
            for at in np.split(marks, np.flatnonzero(np.diff(place[marks])) + 1):
                own = cluster[at]
                done, found = self.pair(starter[own], cps[at])
                done &= (last[own] < ccc[at]) | (last[own] == 0)
                starter[own[done]] = found[done]
                gone[at[done]] = True
                kept = ~done & (last[own] != 256)
                last[own[kept]] = ccc[at[kept]]
            cps = cps.copy()
            cps[first] = starter
            cps, row = cps[~gone], row[~gone]
        while self.second[cps].any():
            done, found = self.pair(cps[:-1], cps[1:])
            done &= (row[1:] == row[:-1]) & self.second[cps[1:]]
            done[1:] &= ~done[:-1]
            if not done.any():
                break
            cps = cps.copy()
            cps[:-1][done] = found[done]
            keep = np.append(True, ~done)
            cps, row = cps[keep], row[keep]
        return cps, np.bincount(row, minlength=rows)

    def pair(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = a.astype(np.int64) << 21 | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return self.pair_keys[at] == key, self.pair_to[at]


@lru_cache(1)
def tables() -> Tables:
    return Tables()


def code_points(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts together, and the offsets of each text among them (NULL: none)."""
    if text.null_count:
        text = pc.fill_null(text, "")
    wide = pa.types.is_large_string(text.type)
    off = np.frombuffer(text.buffers()[1], np.int64 if wide else np.int32, len(text) + 1, text.offset * (8 if wide else 4)).astype(np.int64)
    raw = text.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None else np.zeros(0, np.uint8)
    cps = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    chars = np.append(0, np.cumsum((data & 0xC0) != 0x80))
    return cps, chars[off - off[0]]


def to_text(cps: np.ndarray, off: np.ndarray, valid: pa.Array | None = None) -> pa.Array:
    """The reverse of :func:`code_points`."""
    data = cps.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    width = np.append(0, np.cumsum(1 + (cps >= 0x80) + (cps >= 0x800) + (cps >= 0x10000)))
    out = pa.LargeStringArray.from_buffers(len(off) - 1, pa.py_buffer(width[off].astype(np.int64)), pa.py_buffer(data))
    if valid is not None:
        out = pc.if_else(valid, out, None)
    return out


def _unify(cps: np.ndarray, off: np.ndarray, alpha: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One form of the texts: code points, offsets, and by text whether it changed and has foreign letters left."""
    t = tables()
    n = len(off) - 1
    size = np.diff(off)
    row = np.repeat(np.arange(n), size)
    dirty = np.zeros(n, bool)
    dirty[row[~t.inert[alpha[row], cps]]] = True
    changed = np.zeros(n, bool)
    if dirty.any():
        pick = dirty[row]
        old, own = cps[pick], row[pick]
        new, count = t.compose(*t.flatten(old, own, alpha[own]), n)
        less = np.cumsum(np.where(dirty, size, 0)) - np.where(dirty, size, 0)
        changed = dirty & (count != size)
        same = np.flatnonzero(dirty & ~changed & (size > 0))
        if len(same):
            start = np.cumsum(count) - count
            spans = size[same]
            step = np.arange(int(spans.sum())) - np.repeat(np.cumsum(spans) - spans, spans)
            differ = new[np.repeat(start[same], spans) + step] != old[np.repeat(less[same], spans) + step]
            changed[same] = np.logical_or.reduceat(differ, np.cumsum(spans) - spans)
        total = np.where(dirty, count, size)
        to = np.append(0, np.cumsum(total))
        out = np.empty(int(to[-1]), np.uint32)
        kept = np.flatnonzero(~pick)
        out[to[row[kept]] + kept - off[row[kept]]] = cps[kept]
        own = np.repeat(np.arange(n), count)
        out[to[own] + np.arange(len(new)) - np.repeat(np.cumsum(count) - count, count)] = new
        cps, off = out, to
        row = np.repeat(np.arange(n), total)
    foreign = np.zeros(n, bool)
    foreign[row[~t.own[alpha[row], t.script[cps]]]] = True
    return cps, off, changed, foreign


def unify_array(text: pa.Array, alphabet: pa.Array, with_text: bool = True) -> pa.StructArray:
    """Arrow form of :func:`unify`."""
    code = np.zeros(len(text), np.int64)
    for i, name in enumerate(ALPHABETS):
        if i:
            code[pc.fill_null(pc.equal(alphabet, name), False).to_numpy(zero_copy_only=False)] = i
    cps, off = code_points(text)
    texts, changed, foreign = [], [], []
    a = 0
    while a < len(text):
        b = max(a + 1, int(np.searchsorted(off, off[a] + CHUNK, "right")) - 1)
        c, o, ch, fo = _unify(cps[off[a] : off[b]], off[a : b + 1] - off[a], code[a:b])
        if with_text:
            texts.append(to_text(c, o))
        changed.append(ch)
        foreign.append(fo)
        a = b
    flags = [pa.array(np.concatenate(x) if x else np.zeros(0, bool)) for x in (changed, foreign)]
    if not with_text:
        return pa.StructArray.from_arrays(flags, ["changed", "foreign"])
    out = pa.concat_arrays(texts) if texts else pa.array([], pa.large_string())
    if text.null_count:
        out = pc.if_else(text.is_valid(), out, pa.scalar(None, pa.large_string()))
    return pa.StructArray.from_arrays([out.cast(pa.string()), *flags], ["text", "changed", "foreign"])


_FLAGS = [T.StructField("changed", T.BooleanType()), T.StructField("foreign", T.BooleanType())]


@F.arrow_udf(T.StructType([T.StructField("text", T.StringType()), *_FLAGS]))
def _with_text(text: pa.Array, alphabet: pa.Array) -> pa.Array:
    return unify_array(text, alphabet)


@F.arrow_udf(T.StructType(_FLAGS))
def _flags(text: pa.Array, alphabet: pa.Array) -> pa.Array:
    return unify_array(text, alphabet, with_text=False)


def unify(text: Column, alphabet: Column, *, with_text: bool = True) -> Column:
    """A struct of the text's one form, whether that differs (``changed``), and whether letters of another alphabet remain (``foreign``).

    The form: letters of the alphabet (``Latn`` or ``Cyrl``; look-alikes of the
    other, of Greek and in any width become its letters), every letter and mark
    composed where a composed character exists and else in canonical order,
    ligatures as single letters, ASCII digits, ordinary spaces and hyphens,
    nothing invisible. Typographic quotes, guillemets, dashes and the ellipsis
    stay. Another or NULL alphabet leaves look-alikes alone. A letter without a
    look-alike is never dropped: it stays and is reported as foreign.

    A NULL text stays NULL and is neither changed nor foreign; an empty text
    stays empty; a text of invisible characters becomes empty. Texts are taken
    whole, whatever their length. With ``with_text=False`` only the two flags
    are made.
    """
    return (_with_text if with_text else _flags)(text, alphabet)
