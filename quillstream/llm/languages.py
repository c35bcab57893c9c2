"""Problem 8: the language of documents and of each stretch in one language.

String-kernel classification. A sentence is the set of its n-grams (1 to
MAX_N letters, word ends included: the blended spectrum, by presence). Its
kernel values against landmark texts, normalised, go through the Nystroem map
into one-versus-rest kernel ridge regression. As the presence kernel is a
product of presence vectors, landmarks, map and regression multiply out to one
weight row an n-gram, and a batch of sentences is scored by one sparse matrix
product. A Viterbi pass over a document's sentences, all documents of a batch
side by side, finds the stretches; what a change of language costs there is
chosen on held-out samples.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstream.llm.leaks import fold, folding
from quillstream.llm.unify import code_points

MAX_N = 5
#: Code points processed at once (a longer text is still processed whole).
CHUNK = 1 << 18
#: Letters of sentences scored at once (a longer sentence is still scored whole).
BLOCK_CHARS = 1 << 14
#: Bits of an n-gram's hash; the rest of a key is the sentence's number in its block.
HASH_BITS = 46
#: The fit takes at most so many samples and landmarks of a language.
MAX_SAMPLES, MAX_LANDMARKS = 500, 24
RIDGE = 1e-3
#: Folds of the samples, and what a change of language may cost (in words of
#: full score), from which the fit chooses on held-out samples.
FOLDS, SWITCHES = 3, (0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0, 1.2, 1.4, 1.7, 2.0, 2.5, 3.0, 4.0, 5.0, 6.0, 8.0)
#: So many words in quotes within a sentence are a few, if fewer than the sentence's others; they aren't scored.
FEW_WORDS = 5
#: Ends of sentences.
ENDS = ".!?…;\n。！？；．｡"

# Pairs of quotation marks, and marks that open and close alike.
_QUOTES, _ALIKE = ("“”", "„“", "«»", "»«", "‹›", "「」", "『』"), '"'

# Codes of ISO 639-2 for use in bibliographies, and withdrawn codes.
_OTHER_CODES = {
    "alb": "sq", "arm": "hy", "baq": "eu", "bur": "my", "chi": "zh", "cze": "cs", "dut": "nl", "fre": "fr", "geo": "ka", "ger": "de", "gre": "el", "ice": "is",
    "mac": "mk", "mao": "mi", "may": "ms", "per": "fa", "rum": "ro", "slo": "sk", "tib": "bo", "wel": "cy", "in": "id", "iw": "he", "ji": "yi", "scr": "hr", "scc": "sr",
}


def label_codes(spark: SparkSession, names: DataFrame | None = None) -> dict[str, str]:
    """Two-letter code of every language by its codes and names, in lower case.

    Codes and names of ISO 639 are those the JVM's locale data knows, names in
    English and in the language itself. ``names`` may add rows of iso639_1,
    iso639_3 and lang_name (a table of languages, small by nature); a name that
    is known stays as it is.
    """
    locale = spark._jvm.java.util.Locale
    out: dict[str, str] = dict(_OTHER_CODES)
    for code in locale.getISOLanguages():
        own = locale.forLanguageTag(code)
        two = _OTHER_CODES.get(code, code)
        for name in (code, own.getISO3Language(), own.getDisplayLanguage(locale.ENGLISH), own.getDisplayLanguage(own)):
            if name:
                out.setdefault(name.lower(), two)
    if names is not None:
        for r in names.filter("iso639_1 <> ''").select("iso639_1", "iso639_3", "lang_name").orderBy("iso639_1", "iso639_3", "lang_name").collect():
            for name in (r.iso639_3, r.lang_name):
                if name:
                    out.setdefault(name.strip().lower(), r.iso639_1)
    return out


def label_code(label: str | None, codes: dict[str, str]) -> str | None:
    """Two-letter code that a label names in any spelling (case, blanks, a region or script after the code); None if it names no language."""
    plain = (label or "").strip().lower().replace("_", "-")
    return codes.get(plain) or codes.get(plain.split("-")[0].strip())


def _ngrams(words: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, n-gram) pairs, sorted: row numbers and hashes of n-grams. There are fewer than 2 ** (63 - HASH_BITS) texts."""
    row = np.repeat(np.arange(len(off) - 1, dtype=np.int64) << HASH_BITS, np.diff(off))
    c = words.astype(np.uint64) + np.uint64(1)
    parts, h = [], np.zeros(len(c), np.uint64)
    for k in range(1, MAX_N + 1):
        m = len(c) - k + 1
        if m <= 0:
            break
        h = h[:m] * np.uint64(0x9E3779B97F4A7C15) + c[k - 1 :]
        x = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        parts.append((row[:m] | (x >> np.uint64(64 - HASH_BITS)).astype(np.int64))[(row[:m] == row[k - 1 :])])
    every = np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.int64)
    every = every[np.append(True, every[1:] != every[:-1])] if len(every) else every
    return every >> HASH_BITS, every & ((1 << HASH_BITS) - 1)


@dataclass
class Model:
    """A fitted classifier: hashes of n-grams (sorted), their weights by language, and the cost of a change of language."""

    langs: list[str]
    keys: np.ndarray
    weights: np.ndarray
    switch: float = 1.0
    report: dict | None = None

    def __post_init__(self) -> None:
        self._slots = self._next = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_slots": None, "_next": None}

    def _find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are known, and their places: a table of slots by the keys' low bits, with chains."""
        if self._slots is None:
            bits = max(int(8 * len(self.keys)).bit_length(), 4)
            self._mask = (1 << bits) - 1
            self._slots, self._next = np.zeros(1 << bits, np.int32), np.zeros(len(self.keys) + 1, np.int32)
            slot = self.keys & self._mask
            for i in np.argsort(slot, kind="stable").tolist():  # places from 1, 0 is none
                self._next[i + 1] = self._slots[slot[i]]
                self._slots[slot[i]] = i + 1
        known = np.append(np.int64(-1), self.keys)
        at = self._slots[key & self._mask]
        at = np.where(known[at] == key, at, self._next[at])
        open_ = np.flatnonzero((at > 0) & (known[at] != key))
        while len(open_):
            at[open_] = self._next[at[open_]]
            open_ = open_[(at[open_] > 0) & (known[at[open_]] != key[open_])]
        hit = np.flatnonzero(at)
        return hit, at[hit] - 1

    def scores(self, words: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Scores by language of texts folded to words (rows without letters: 0)."""
        n = len(off) - 1
        out = np.zeros((n, len(self.langs)), np.float32)
        step, b = 1 << (62 - HASH_BITS), 0
        while b < n:
            a, b = b, min(b + step, max(b + 1, int(np.searchsorted(off, off[b] + BLOCK_CHARS, "right")) - 1))
            row, key = _ngrams(words[off[a] : off[b]], off[a : b + 1] - off[a])
            if not len(row):
                continue
            size = np.bincount(row, minlength=b - a)
            hit, at = self._find(key)
            row = row[hit]
            part = np.zeros((b - a, len(self.langs)), np.float32)
            if len(row):
                first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
                part[row[first]] = np.add.reduceat(self.weights[at], first, axis=0)
            out[a:b] = part / np.sqrt(np.maximum(size, 1))[:, None]
        return out


def fit(texts: list[str], langs: list[str]) -> Model:
    """Nystroem kernel ridge regression on labelled texts (at most MAX_LANDMARKS of a language, evenly spread, are landmarks)."""
    words, off = fold(*code_points(pa.array(texts, pa.string())), by_capital=False)
    names = sorted(set(langs))
    row, key = _ngrams(words, off)
    vocab, col = np.unique(key, return_inverse=True)
    n = len(texts)
    norm = 1 / np.sqrt(np.maximum(np.bincount(row, minlength=n), 1))
    y = np.array([names.index(x) for x in langs])
    marks = np.concatenate([(own := np.flatnonzero(y == k))[np.unique(np.linspace(0, len(own) - 1, min(len(own), MAX_LANDMARKS)).astype(int))] for k in range(len(names))])
    presence = np.zeros((len(marks), len(vocab)), np.float32)
    place = np.full(n, -1)
    place[marks] = np.arange(len(marks))
    own = place[row] >= 0
    presence[place[row[own]], col[own]] = norm[row[own]]
    kernel = np.zeros((n, len(marks)))
    for a in range(0, n, 512):  # presence rows of all samples against the landmarks
        x = np.zeros((min(512, n - a), len(vocab)), np.float32)
        part = (row >= a) & (row < a + len(x))
        x[row[part] - a, col[part]] = norm[row[part]]
        kernel[a : a + len(x)] = x @ presence.T
    value, vector = np.linalg.eigh(kernel[marks])
    good = value > 1e-8 * value.max()
    root = vector[:, good] / np.sqrt(value[good])
    phi = kernel @ root
    target = (y[:, None] == np.arange(len(names))).astype(float)
    w = np.linalg.solve(phi.T @ phi + RIDGE * n * np.eye(phi.shape[1]), phi.T @ target)
    used = presence.any(0)
    return Model(names, vocab[used], (presence[:, used].T @ (root @ w)).astype(np.float32))


def _viterbi(gain: np.ndarray, first: np.ndarray, count: np.ndarray, switch: float) -> np.ndarray:
    """Best language of each unit: rows first[d] .. first[d] + count[d] of gain are document d's. Documents run side by side."""
    order = np.argsort(-count, kind="stable")
    first, count = first[order], count[order]
    k = gain.shape[1]
    back = np.zeros(gain.shape, np.int32)
    best = gain[first].astype(float)
    ends = np.zeros((len(first), k))
    for j in range(1, int(count[0]) if len(count) else 0):
        live = int(np.searchsorted(-count, -j, "left"))  # documents with more than j units come first
        top = best[:live].argmax(1)
        change = best[np.arange(live), top] - switch
        stay = best[:live] >= change[:, None]
        back[first[:live] + j] = np.where(stay, np.arange(k), top[:, None])
        ends[live : len(best)] = best[live:]
        best = np.where(stay, best[:live], change[:, None]) + gain[first[:live] + j]
    ends[: len(best)] = best
    out = np.zeros(len(gain), np.int64)
    now = ends.argmax(1)
    for j in range(int(count[0]) - 1 if len(count) else -1, -1, -1):
        live = int(np.searchsorted(-count, -j, "left"))
        at = first[:live] + j
        out[at] = now[:live]
        now[:live] = back[at, now[:live]]
    return out


def _unquoted(cps: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Code points with a few quoted words within a sentence blanked out, as they make no stretch.

    A quotation counts if it begins and ends in its sentence, has FEW_WORDS
    words at most, and all such quotations have fewer words than the rest.
    """
    marks = np.isin(cps, [ord(c) for c in {*"".join(_QUOTES), *_ALIKE}])
    at = np.flatnonzero(marks)
    if len(at) < 2:
        return cps
    unit = np.searchsorted(bounds, at, "right")
    pair = np.zeros(len(at) - 1, bool)
    a, b = cps[at[:-1]], cps[at[1:]]
    for x, y in (*_QUOTES, *(c + c for c in _ALIKE)):
        pair |= (a == ord(x)) & (b == ord(y))
    pair &= unit[:-1] == unit[1:]
    # Straight marks open and close alike: every second one of those that follow each other opens.
    first = np.flatnonzero(pair)
    run = np.flatnonzero(np.append(True, first[1:] != first[:-1] + 1)) if len(first) else first
    place = np.arange(len(first)) - np.repeat(run, np.diff(np.append(run, len(first)))) if len(first) else first
    first = first[place % 2 == 0]
    if not len(first):
        return cps
    letter = folding(False).letter[cps]
    word = letter.copy()
    word[1:] &= ~letter[:-1]
    count = np.append(0, np.cumsum(word))
    few = count[at[first + 1]] - count[at[first]]
    ok = few <= FEW_WORDS
    first, few, own = first[ok], few[ok], unit[first[ok]] - 1
    quoted = np.bincount(own, weights=few, minlength=len(bounds) - 1)
    whole = count[bounds[1:]] - count[bounds[:-1]]
    first = first[2 * quoted[own] < whole[own]]
    edge = np.zeros(len(cps) + 1, np.int8)
    edge[at[first]] += 1
    edge[at[first + 1]] -= 1
    return np.where(np.cumsum(edge[:-1]) > 0, np.uint32(32), cps)


@dataclass
class _Units:
    """Sentences or lines with letters: text, places in all code points, gain by language."""

    doc: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    n_words: np.ndarray
    gain: np.ndarray


def _units(cps: np.ndarray, off: np.ndarray, model: Model, is_end: np.ndarray) -> _Units:
    starts = np.unique(np.concatenate([off[:-1][np.diff(off) > 0], np.flatnonzero(is_end[cps]) + 1]))
    starts = starts[starts < len(cps)]
    bounds = np.append(starts, len(cps))
    words, woff = fold(_unquoted(cps, bounds), bounds, by_capital=False) if len(starts) else (cps, np.zeros(1, np.int64))
    n_words = np.add.reduceat(np.append(words == 32, False), woff[:-1]) - 1 if len(starts) else np.zeros(0, int)
    has = np.diff(woff) > 0
    scores = model.scores(words, woff)[has]
    begin, n_words = starts[has], n_words[has]
    return _Units(np.searchsorted(off, begin, "right") - 1, begin, bounds[1:][has], n_words, scores * n_words[:, None])


def _languages(u: _Units, switch: float) -> np.ndarray:
    """Language index of each unit."""
    first = np.flatnonzero(np.append(True, u.doc[1:] != u.doc[:-1])) if len(u.doc) else np.zeros(0, int)
    return _viterbi(u.gain, first, np.diff(np.append(first, len(u.doc))), switch)


def segment(cps: np.ndarray, off: np.ndarray, model: Model, is_end: np.ndarray):
    """Stretches of the texts: text, number, language index, confidence, begin and end (code points of the text)."""
    u = _units(cps, off, model, is_end)
    doc = u.doc
    if not len(doc):
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0), z, z
    lang = _languages(u, model.switch)
    at = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (lang[1:] != lang[:-1])))
    total = np.add.reduceat(u.gain, at, axis=0) / np.add.reduceat(u.n_words, at)[:, None]
    e = np.exp(8 * (total - total.max(1, keepdims=True)))
    sure = e[np.arange(len(at)), lang[at]] / e.sum(1)
    number = np.arange(len(at)) - np.maximum.accumulate(np.where(np.append(True, doc[at][1:] != doc[at][:-1]), np.arange(len(at)), 0)) + 1
    last = np.append(at[1:], len(doc)) - 1
    return doc[at], number, lang[at], sure, u.begin[at] - off[doc[at]], u.end[last] - off[doc[at]]


def sentence_ends() -> np.ndarray:
    out = np.zeros(0x110000, bool)
    out[[ord(c) for c in ENDS]] = True
    return out


def _composed(sentences: dict[str, list[str]], rnd: np.random.Generator, n: int) -> list[list[tuple[str, str]]]:
    """Texts put together from sentences, as (language, sentence): n a language, half of them in one language.

    Those have up to forty sentences; others change their language once or
    twice, after one to four. Every other sentence is cut short, to three words
    at least. In every third some words of another language stand in the middle,
    at most a quarter of its own.
    """
    names, out = sorted(sentences), []
    for lang in names:
        for i in range(n):
            text, here, single = [], lang, i % 2 == 0 or len(names) == 1
            for _ in range(1 if single else int(rnd.integers(2, 4))):
                for _ in range(int(rnd.integers(1, 41 if single else 5))):
                    whole = sentences[here][int(rnd.integers(len(sentences[here])))]
                    words = whole.strip(ENDS).split()
                    if rnd.integers(2) and len(words) > 3:
                        words = words[: int(rnd.integers(3, len(words)))]
                    other = names[int(rnd.integers(len(names)))]
                    if len(words) >= 4 and other != here and rnd.integers(3) == 0:
                        loan = sentences[other][int(rnd.integers(len(sentences[other])))].strip(ENDS).split()
                        words[len(words) // 2 : len(words) // 2] = loan[: min(len(words) // 4, 3)]
                    text.append((here, " ".join(words) + "."))
                here = names[(names.index(here) + int(rnd.integers(1, len(names)))) % len(names)] if len(names) > 1 else here
            out.append(text)
    return out


def choose_switch(texts: list[str], langs: list[str]) -> tuple[float, dict]:
    """The cost of a change of language by the wrong texts on held-out samples, and a report.

    For each of FOLDS parts of the samples a model is fitted on the others, and
    texts composed from the part's sentences are told apart at every cost. A
    text is right if its stretches have the right languages and borders. Of the
    costs within one standard error of the best the largest is taken, as every
    sentence of a long text is a chance for a false change.
    """
    is_end, names = sentence_ends(), sorted(set(langs))
    place = {x: 0 for x in names}
    parts = []
    for x in langs:
        parts.append(place[x] % FOLDS)
        place[x] += 1
    if min(place.values()) < FOLDS or len(names) < 2:
        return 1.0, {}
    wrong, n, sure, told = np.zeros(len(SWITCHES), int), 0, 0, 0
    rnd = np.random.default_rng(0)
    for f in range(FOLDS):
        kept = [i for i, p in enumerate(parts) if p != f]
        model = fit([texts[i] for i in kept], [langs[i] for i in kept])
        sentences: dict[str, list[str]] = {x: [] for x in names}
        for i, p in enumerate(parts):
            if p == f:
                sentences[langs[i]] += [x.strip() for x in re.split(f"[{re.escape(ENDS)}]", texts[i]) if len(x.split()) > 1]
        if not all(sentences.values()):
            continue
        composed = _composed(sentences, rnd, 60)
        u = _units(*code_points(pa.array([" ".join(s for _, s in t) for t in composed])), model, is_end)
        if np.bincount(u.doc, minlength=len(composed)).tolist() != [len(t) for t in composed]:
            continue
        want = np.array([model.langs.index(x) for t in composed for x, _ in t])
        alone = u.gain.argmax(1)
        sure, told, n = sure + int((alone == want).sum()), told + len(want), n + len(composed)
        for k, switch in enumerate(SWITCHES):
            bad = _languages(u, switch) != want
            wrong[k] += len(np.unique(u.doc[bad]))
    if not n:
        return 1.0, {}
    k = int(np.flatnonzero(wrong <= wrong.min() + np.sqrt(wrong.min()))[-1])
    return SWITCHES[k], {"texts": n, "wrong_texts": int(wrong[k]), "sentences": told, "right_sentences_alone": sure, "wrong_by_switch": dict(zip(SWITCHES, wrong.tolist()))}


def _segments(model: Model, codes: dict[str, str]):
    """mapInArrow function over (doc, label, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_end = sentence_ends()
        names, own = pa.array(model.langs, pa.string()), pa.array([label_code(x, codes) or x for x in model.langs], pa.string())
        for batch in batches:
            cps, off = code_points(batch.column("text"))
            label = batch.column("label").dictionary_encode()
            meant = pa.array([label_code(x, codes) for x in label.dictionary.to_pylist()], pa.string()).take(label.indices)
            a = 0
            while a < batch.num_rows:
                b = max(a + 1, int(np.searchsorted(off, off[a] + CHUNK, "right")) - 1)
                doc, number, lang, sure, begin, end = segment(cps[off[a] : off[b]], off[a : b + 1] - off[a], model, is_end)
                at, lang = pa.array(doc + a), pa.array(lang)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc").take(at), batch.column("label").take(at), meant.take(at), own.take(lang), pa.array(number.astype(np.int32)), names.take(lang), pa.array(sure.astype(float)), pa.array(begin), pa.array(end), pa.array(np.bincount(doc, minlength=b - a)[doc].astype(np.int32))],
                    names=["doc", "label", "label_code", "code", "seg_no", "found", "confidence", "begin_char", "end_char", "n_segments"],
                )
                a = b

    return work


def fit_on(samples: DataFrame, lang: str = "lang", text: str = "sample_text", order: str = "sample_id") -> Model:
    """The model of at most MAX_SAMPLES samples of each language (the first by ``order``), fitted by the driver.

    The cost of a change of language is chosen on held-out samples (see
    :func:`choose_switch`); ``report`` of the model has the figures.

    Samples whose language or text is NULL are left out. Without any the model
    knows no language, and no text has stretches.
    """
    known = samples.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("l"), F.col(text).alias("t"), F.col(order).alias("o"))
    rows = known.withColumn("n", F.row_number().over(W.partitionBy("l").orderBy("o", "t"))).filter(F.col("n") <= MAX_SAMPLES).orderBy("l", "o", "t").collect()
    if not rows:
        return Model([], np.zeros(0, np.int64), np.zeros((0, 0), np.float32))
    texts, langs = [r.t for r in rows], [r.l for r in rows]
    model = fit(texts, langs)
    model.switch, model.report = choose_switch(texts, langs)
    return model


def identify_languages(documents: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", label: str = "lang", codes: dict[str, str] | None = None) -> DataFrame:
    """Language of every stretch: doc_id, seg_no, lang, confidence, begin_char, end_char, n_segments, label, label_code, label_state.

    Sentences (or lines) follow each other in one stretch as long as they are in
    one language; stretches are numbered from 1 and given as code points
    [begin_char, end_char) of the text. The confidence, between 0 and 1, is the
    share of the stretch's language among all languages after a softmax of the
    mean scores. ``label_state`` says of a document's label: ``missing`` (NULL,
    blank or no language by ``codes``, see :func:`label_codes`), ``wrong`` (another language than the text),
    ``mixed`` (the text is in several languages) or ``right``.

    NULL and empty texts, texts without letters, and all texts if the model
    knows no language, have no stretches and give no rows. Texts are read whole. A repeated doc_id gives rows for each of its
    rows; NULL ids stay NULL. Other columns are ignored.
    """
    codes = label_codes(documents.sparkSession) if codes is None else codes
    src = documents.select(F.col(doc_id).alias("doc"), F.col(label).alias("label"), F.col(text).alias("text")).filter(F.col("text").isNotNull())
    src = src if model.langs else src.limit(0)
    out = T.StructType([
        T.StructField("doc", src.schema["doc"].dataType), T.StructField("label", T.StringType()), T.StructField("label_code", T.StringType()), T.StructField("code", T.StringType()),
        T.StructField("seg_no", T.IntegerType()), T.StructField("found", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("begin_char", T.LongType()),
        T.StructField("end_char", T.LongType()), T.StructField("n_segments", T.IntegerType()),
    ])
    rows = src.mapInArrow(_segments(model, codes), out)
    state = F.when(F.col("label_code").isNull(), "missing").when(F.col("n_segments") > 1, "mixed").when(F.col("label_code") != F.col("code"), "wrong").otherwise("right")
    return rows.select(F.col("doc").alias(doc_id), "seg_no", F.col("found").alias("lang"), "confidence", "begin_char", "end_char", "n_segments", "label", "label_code", state.alias("label_state"))
