"""Problem 7: documents that hold passages of evaluation items.

Wu-Manber search for many strings. Texts and passages are folded to words of
plain letters first. The passages' strings (all runs of ten words of an item,
or the whole of a shorter item) go into shift tables by block, buckets by the
hash of the window's last block, and prefix hashes; a batch of documents is
scanned as one array by many cursors at once, each jumping as far as its
block's shift allows; what the tables let through is compared directly.
"""

from __future__ import annotations

import unicodedata as U
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstream.llm import unify
from quillstream.llm.unify import _IGNORED, _expand, _ranges, code_points
from quillstream.runtime import Workspace

#: Words of a passage that count as a leak.
WORDS = 10
#: Code points of items searched in one pass over the documents; more take more passes.
PASS_CHARS = 1 << 21
#: Code points scanned at once (a longer text is still scanned whole).
CHUNK_CHARS = 1 << 17
#: Block length, and code points scanned by one cursor.
BLOCK, LANE = 8, 2048
#: Strings are searched in classes of similar length, as a short one would
#: shorten the shifts of all.
CLASSES = (1, 8, 16, 28, 48)

_SPACE, _BACKSLASH = 32, 92


def _look_alikes() -> tuple[dict[str, str], dict[str, str], dict[str, str]]:
    """Small letters that look like Latin ones, in either size: of Cyrillic, and of Greek by its capitals and by its small letters."""
    cyril = {c.casefold(): x.casefold() for c, x in zip(unify._CYRIL, unify._LATIN, strict=True)}
    cyril |= {c: x.casefold() for c, x in zip(unify._MORE_CYRIL, unify._MORE_CYRIL_AS, strict=True) if c.islower() or c.casefold() not in unify._MORE_CYRIL}
    upper = {c.casefold(): x.casefold() for c, x in zip(unify._GREEK_UPPER, unify._GREEK_UPPER_AS, strict=True)}
    lower = dict(zip(unify._GREEK_LOWER, unify._GREEK_LOWER_AS, strict=True))
    return cyril, lower | upper, upper | lower


class Folding:
    """Tables from code points to decomposed, case-folded letters; anything else is a space or nothing.

    A Greek letter becomes the Latin one that its capital resembles
    (``by_capital``) or that its small letter does; where only one of them
    resembles any, that one. Either way case makes no difference.
    """

    def __init__(self, by_capital: bool = True) -> None:
        top = 0x110000
        cyril, upper, lower = _look_alikes()
        alike = cyril | (upper if by_capital else lower)
        # What isn't named below is a space; letters that `_ranges` leaves out are themselves.
        self.len, self.off = np.ones(top, np.int64), np.full(top, _SPACE, np.int64)
        for a, b in ((0x3400, 0xA000), (0xAC00, 0xD7A4), (0x20000, 0x2F800), (0x2FA20, 0x33480)):
            self.off[a:b] = np.arange(a, b)
        extra: list[int] = []
        own: list[int] = []
        for cp in _ranges():
            c = chr(cp)
            kind, how = U.category(c), U.decomposition(c)
            if kind[0] in "LM" and not how and cp not in _IGNORED and c not in alike and c.casefold() == c:
                own.append(cp)
                continue
            if kind == "Cn" or (not how and kind[0] in "PSZN" and kind != "Nd"):
                continue
            out: list[int] = []
            for x in _expand(cp):
                for y in chr(x).casefold():
                    out += [ord(d) if U.category(d)[0] in "LM" else _SPACE for d in U.normalize("NFD", alike.get(y, y))]
            if out != [_SPACE]:
                self.off[cp], self.len[cp] = top + len(extra), len(out)
                extra += out
        self.off[own] = own
        self.data = np.concatenate([np.arange(top, dtype=np.uint32), np.array(extra, np.uint32)])
        self.marker = np.zeros(top, bool)
        for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+":
            self.marker[ord(c)] = True
        self.letter = (self.len > 0) & (self.data[np.minimum(self.off, len(self.data) - 1)] != _SPACE) & (combining() == 0)


@lru_cache(1)
def combining() -> np.ndarray:
    """Canonical combining class of every code point."""
    out = np.zeros(0x110000, np.uint8)
    for cp in _ranges():
        if k := U.combining(chr(cp)):
            out[cp] = k
    return out


@lru_cache(2)
def folding(by_capital: bool = True) -> Folding:
    return Folding(by_capital)


@lru_cache(1)
def _classes() -> np.ndarray:
    """From Latin letters to classes: letters that one Greek letter may stand for, by its capital or small form, are in one."""
    out = np.arange(0x110000, dtype=np.uint32)
    _, upper, lower = _look_alikes()
    for c in upper:
        a, b = sorted({int(out[ord(upper[c])]), int(out[ord(lower[c])])} | {0x110000})[:2]
        if b < 0x110000:
            out[out == b] = a
    return out


def fold(cps: np.ndarray, off: np.ndarray, by_capital: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Texts as words: `` w1 w2 ... wn `` with one space around each word; a text without letters is empty.

    Gone are case, digits, punctuation, line breaks, backslash markers (such as
    those of USFM) and invisible characters; look-alike letters are one letter;
    accents stay, as decomposed marks in canonical order.
    """
    t = folding(by_capital)
    n = len(off) - 1
    row = np.repeat(np.arange(n), np.diff(off))
    own = t.marker[cps]
    at = np.arange(len(cps))
    before = np.maximum.accumulate(np.where(own, -1, at)) if len(cps) else at
    marker = own & (before >= 0) & (before >= off[row])
    marker &= cps[before] == _BACKSLASH
    cps = np.where(marker, np.uint32(_SPACE), cps)
    size = t.len[cps]
    start = np.cumsum(size) - size
    out = t.data[np.repeat(t.off[cps] - start, size) + np.arange(int(size.sum()))]
    row = np.repeat(row, size)
    # Marks in canonical order.
    ccc = combining()[out]
    if ((ccc[1:] > 0) & (ccc[:-1] > 0)).any():
        head = ccc == 0
        head[1:] |= row[1:] != row[:-1]
        order = np.lexsort((ccc, np.cumsum(head)))
        out = out[order]
    # One space between words and at either end of the text.
    letter = out != _SPACE
    begins = letter.copy()
    begins[1:] &= ~letter[:-1] | (row[1:] != row[:-1])
    ends = letter.copy()
    ends[:-1] &= ~letter[1:] | (row[1:] != row[:-1])
    first = begins.copy()  # a text's first word gets a space in front as well
    w = np.flatnonzero(begins)
    first[w[1:]] = row[w[1:]] != row[w[:-1]]
    size = letter.astype(np.int64) + ends + first
    to = np.cumsum(size) - size
    words = np.full(int(size.sum()), _SPACE, np.uint32)
    at = np.flatnonzero(letter)
    words[to[at] + first[at]] = out[at]
    return words, np.append(0, np.cumsum(np.bincount(row, weights=size, minlength=n).astype(np.int64))) if n else np.zeros(1, np.int64)


def _hashes(a: np.ndarray, block: int, bits: int) -> np.ndarray:
    """Hash of the block that ends at each position (positions before block - 1 are unused)."""
    h = np.zeros(len(a), np.uint32)
    for j in range(block):
        h[block - 1 :] = h[block - 1 :] * np.uint32(0x01000193) ^ (a[j : len(a) - block + 1 + j] * np.uint32(0x9E3779B1))
    return (h ^ (h >> np.uint32(15))) & np.uint32((1 << bits) - 1)


class WuManber:
    """Search tables for strings of one length class, given as places in one text: start, length and id."""

    def __init__(self, text: np.ndarray, start: np.ndarray, length: np.ndarray, ids: np.ndarray):
        self.m = m = int(length.min())
        self.block = min(BLOCK, max(1, m // 2))
        # The table has room for the strings' blocks, within 2 and 32 MB.
        self.bits = min(max(int(len(start) * m).bit_length(), 20), 24)
        h = _hashes(text, self.block, self.bits)
        most = np.iinfo(np.uint16).max  # a smaller shift is always right
        self.shift = np.full(1 << self.bits, min(m - self.block + 1, most), np.uint16)
        for j in range(self.block - 1, m):
            at = h[start + j]
            self.shift[at] = np.minimum(self.shift[at], min(m - 1 - j, most))
        suffix = h[start + m - 1]
        order = np.argsort(suffix, kind="stable")
        self.suffix, self.prefix = suffix[order], h[start + self.block - 1][order]
        self.start, self.length, self.ids = start[order], length[order], ids[order]
        self.raw = text.astype("<u4").tobytes()

    def search(self, text: np.ndarray, hashes: dict[tuple[int, int], np.ndarray] | None = None) -> Iterator[tuple[int, int, int, int]]:
        """(place, start of the string, its length, its id) of every occurrence; ``hashes`` of the text are shared by tables of one block length and size."""
        if len(text) < self.m:
            return
        hashes = {} if hashes is None else hashes
        if (self.block, self.bits) not in hashes:
            hashes[self.block, self.bits] = _hashes(text, self.block, self.bits)
        h = hashes[self.block, self.bits]
        at = np.arange(0, len(text), LANE)
        stop = np.minimum(at + LANE, len(text))
        at[0] = self.m - 1
        at = np.maximum(at, self.m - 1)
        live = at < stop
        at, stop = at[live], stop[live]
        found = []
        while len(at):
            s = self.shift[h[at]].astype(np.int64)
            if (zero := s == 0).any():
                found.append(at[zero])
            at = at + np.maximum(s, 1)
            live = at < stop
            at, stop = at[live], stop[live]
        if not found:
            return
        end = np.concatenate(found)
        lo, hi = (np.searchsorted(self.suffix, h[end], side) for side in ("left", "right"))
        many = hi - lo
        pos = np.repeat(end, many)
        which = np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        keep = h[pos - self.m + self.block] == self.prefix[which]
        raw = text.astype("<u4").tobytes()
        which = which[keep]
        for p, s, n, i in zip((pos[keep] - self.m + 1).tolist(), self.start[which].tolist(), self.length[which].tolist(), self.ids[which].tolist()):
            if raw[4 * p : 4 * (p + n)] == self.raw[4 * s : 4 * (s + n)]:
                yield p, s, n, i


def passages(words: np.ndarray, n_words: int = WORDS) -> list[tuple[int, int]]:
    """Begin and end of the strings searched for an item folded to words: its runs of n_words words, or all of it if it has fewer."""
    gaps = np.flatnonzero(words == _SPACE)
    n = len(gaps) - 1
    if n < 1:
        return []
    if n <= n_words:
        return [(0, len(words))]
    return [(int(gaps[i]), int(gaps[i + n_words]) + 1) for i in range(n - n_words + 1)]


class Searches:
    """The strings of a block of items, by length, and the items' words in both foldings."""

    def __init__(self, words: list[bytes], other: list[bytes], n_words: int):
        self.own, self.other = (np.frombuffer(b"".join(x), "<u4") for x in (words, other))
        text = _classes()[self.own]
        start, length, ids, at = [], [], [], 0
        for i, w in enumerate(words):
            for a, b in passages(np.frombuffer(w, "<u4"), n_words):
                start.append(at + a)
                length.append(b - a)
                ids.append(i)
            at += len(w) // 4
        start, length, ids = (np.array(x, np.int64) for x in (start, length, ids))
        self.classes = []
        for low, high in zip(CLASSES, (*CLASSES[1:], 1 << 62)):
            own = (low <= length) & (length < high)
            if own.any():
                self.classes.append(WuManber(text, start[own], length[own], ids[own]))

    def found(self, cps: np.ndarray, off: np.ndarray) -> dict[tuple[int, int], int]:
        """Number of places of (text, item).

        The search compares classes of letters. Where a Greek letter may stand
        for two Latin ones, each letter must agree in one of the foldings.
        """
        words, at = fold(cps, off)
        text = _classes()[words]
        others: dict[int, np.ndarray] = {}
        hashes: dict[tuple[int, int], np.ndarray] = {}
        hits: dict[tuple[int, int], int] = {}
        for c in self.classes:
            for p, s, n, item in c.search(text, hashes):
                d = int(np.searchsorted(at, p, "right")) - 1
                x, y = words[p : p + n], self.own[s : s + n]
                if not (x == y).all():
                    if d not in others:
                        others[d] = fold(cps[off[d] : off[d + 1]], np.array([0, off[d + 1] - off[d]]), by_capital=False)[0]
                    z = others[d][p - at[d] : p - at[d] + n]
                    if not ((x == y) | (z == self.other[s : s + n])).all():
                        continue
                hits[d, item] = hits.get((d, item), 0) + 1
        return hits


#: Searches of the last block used by this Python worker.
_LAST: dict[str, Searches] = {}


def _scan(key: str, block: Broadcast, n_words: int):
    """mapInArrow function over (doc, text): a row for each document and item index, with the number of places found."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _LAST:
            _LAST.clear()
            _LAST[key] = Searches(*block.value, n_words)
        searches = _LAST[key]
        for batch in batches:
            cps, off = code_points(batch.column(1))
            a = 0
            while a < batch.num_rows:
                b = max(a + 1, int(np.searchsorted(off, off[a] + CHUNK_CHARS, "right")) - 1)
                hits = searches.found(cps[off[a] : off[b]], off[a : b + 1] - off[a])
                if hits:
                    docs = batch.column(0).take(pa.array([a + d for d, _ in hits]))
                    yield pa.RecordBatch.from_arrays([docs, pa.array([i for _, i in hits], pa.int64()), pa.array(list(hits.values()), pa.int64())], names=["doc", "item", "n"])
                a = b

    return work


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) of items to (id, words by capitals, words by small letters), without items that have no letters."""
    for batch in batches:
        cps, off = code_points(batch.column(1))
        (own, at), (other, _) = fold(cps, off), fold(cps, off, by_capital=False)
        some = np.flatnonzero(np.diff(at) > 0)
        cut = lambda x: pa.array([x[at[i] : at[i + 1]].astype("<u4").tobytes() for i in some], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some)), cut(own), cut(other)], names=["id", "words", "other"])


def find_leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "item_text", n_words: int = WORDS, pass_chars: int = PASS_CHARS) -> DataFrame:
    """Documents that hold passages of items: doc_id, item_id, n_places.

    A document holds an item if ``n_words`` consecutive words of the item occur
    in it in order, or all words of an item of fewer. ``n_places`` counts the
    item's runs of words found, place by place. Words are runs of letters; see
    :func:`fold` for what makes no difference.

    NULL and empty texts and items without letters take part in nothing; NULL
    ids stay NULL ids. Rows of one doc_id (or item_id) count together. Other
    columns are ignored. Documents are scanned whole. Items are folded on the
    executors and searched in blocks of about ``pass_chars`` code points, each
    in one pass over the documents; the driver holds one block at a time.
    """
    spark = documents.sparkSession
    id_type = items.schema[item_id].dataType
    out = T.StructType([T.StructField("doc", documents.schema[doc_id].dataType), T.StructField("item", T.LongType()), T.StructField("n", T.LongType())])
    docs = documents.select(F.col(doc_id).alias("doc"), F.col(text).alias("text")).filter(F.col("text").isNotNull())
    made = T.StructType([T.StructField("id", id_type), T.StructField("words", T.BinaryType()), T.StructField("other", T.BinaryType())])
    space = Workspace(spark, "leaks")
    asked = items.select(F.col(item_id).alias("id"), F.col(item_text).alias("text")).filter(F.col("text").isNotNull())
    folded = space.put(asked.mapInArrow(_folded, made))
    chars = folded.agg(F.coalesce(F.sum(F.octet_length("words")), F.lit(0))).first()[0] // 4
    n_blocks = -(-chars // pass_chars)
    found = None
    for k in range(n_blocks):
        rows = folded.filter(F.pmod(F.xxhash64("words"), F.lit(n_blocks)) == k).select("id", "words", "other").collect()
        if not rows:
            continue
        block = spark.sparkContext.broadcast(([bytes(r.words) for r in rows], [bytes(r.other) for r in rows]))
        names = spark.createDataFrame([(i, r.id) for i, r in enumerate(rows)], T.StructType([T.StructField("item", T.LongType()), T.StructField("id", id_type)]))
        hits = docs.mapInArrow(_scan(f"{space.root}/{k}", block, n_words), out)
        hits = hits.join(F.broadcast(names), "item").select(F.col("doc").alias(doc_id), F.col("id").alias(item_id), "n")
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        return spark.createDataFrame([], T.StructType([T.StructField(doc_id, out["doc"].dataType), T.StructField(item_id, id_type), T.StructField("n_places", T.LongType())]))
    return found.groupBy(doc_id, item_id).agg(F.sum("n").alias("n_places"))
