import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillstream.llm import languages as L
from quillstream.llm.leaks import fold
from quillstream.llm.unify import code_points

VOCAB = {
    "en": "the river every window with another she carried under quiet because they opened slowly",
    "de": "der fluss jede fenster mit eine sie trug unter ruhig weil wir öffnete langsam",
    "es": "el río cada ventana con otra ella llevó bajo tranquilo porque ellos abrió despacio",
    "ru": "эта река каждый окно с другой она нёс под тихий потому они открыл медленно",
}


def say(rnd, lang, k=None):
    return " ".join(rnd.choice(VOCAB[lang].split()) for _ in range(k or rnd.randrange(5, 12)))


@pytest.fixture(scope="module")
def model():
    rnd = random.Random(1)
    langs = [lang for lang in VOCAB for _ in range(20)]
    return L.fit([f"{say(rnd, x).capitalize()}. {say(rnd, x)}!" for x in langs], langs)


def test_weights_are_the_kernel_scores():
    """The collapsed weights give what kernel, Nystroem map and ridge regression give step by step."""
    rnd = random.Random(2)
    langs = [lang for lang in VOCAB for _ in range(6)]
    texts = [say(rnd, x) for x in langs]
    m = L.fit(texts, langs)
    grams = lambda t: {t[i : i + k] for k in range(1, L.MAX_N + 1) for i in range(len(t) - k + 1)}
    words, off = fold(*code_points(pa.array(texts)))
    sets = [grams("".join(map(chr, words[off[i] : off[i + 1]]))) for i in range(len(texts))]
    k = np.array([[len(a & b) / np.sqrt(len(a) * len(b)) for b in sets] for a in sets])
    val, vec = np.linalg.eigh(k)
    phi = k @ (vec / np.sqrt(val))
    y = (np.array(langs)[:, None] == np.array(m.langs)).astype(float)
    want = phi @ np.linalg.solve(phi.T @ phi + L.RIDGE * len(texts) * np.eye(len(texts)), phi.T @ y)
    assert np.allclose(m.scores(words, off), want, atol=2e-3)


def test_held_out(model):
    rnd = random.Random(9)
    langs = [rnd.choice(list(VOCAB)) for _ in range(200)]
    words, off = fold(*code_points(pa.array([say(rnd, x) for x in langs])))
    got = [model.langs[i] for i in model.scores(words, off).argmax(1)]
    assert sum(a == b for a, b in zip(got, langs)) >= 196


def test_viterbi_against_one_document_at_a_time():
    rnd = np.random.default_rng(4)
    count = rnd.integers(1, 9, 40)
    gain = rnd.random((count.sum(), 3)) * 2
    first = np.cumsum(count) - count
    switch = 0.7
    got = L._viterbi(gain, first, count, switch)
    for f, c in zip(first, count):
        best, path = -1.0, None
        for code in range(3**c):
            p = [code // 3**i % 3 for i in range(c)]
            v = sum(gain[f + i, k] for i, k in enumerate(p)) - switch * sum(a != b for a, b in zip(p, p[1:]))
            if v > best + 1e-12:
                best, path = v, p
        assert list(got[f : f + c]) == path or np.isclose(sum(gain[f + i, k] for i, k in enumerate(got[f : f + c])) - switch * sum(a != b for a, b in zip(got[f : f + c], got[f + 1 : f + c])), best)


def test_documents(spark, model):
    rnd = random.Random(5)
    s = lambda x: say(rnd, x, 8).capitalize() + ". "
    docs = [
        (1, s("en") * 3, "en"), (2, s("en") + s("de"), "en"), (3, s("ru"), None), (4, s("es"), " ES_mx "), (5, s("de"), "English"), (6, s("es"), "zz"),
        (7, None, "en"), (8, "", None), (9, " 12 — ", "und"), (10, "\\id ABC\n\\c 1\n\\v 1 " + s("ru") + "\n\\v 2 " + s("en") + s("es"), "ru"),
        (11, "\n".join(say(rnd, "de", 7) for _ in range(4)) + "\n" + "\n".join(say(rnd, "en", 7) for _ in range(3)), "de"),
        (12, "She opened the quiet window “der fluss” with another river. " + s("en"), "en"), (13, s("de") * 8000, "de"), (13, s("de"), "de"), (None, s("es"), "pt"),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("doc", F.lit(0)).withColumn("label", F.lit(""))
    rows = L.identify_languages(df, model).collect()
    got = {}
    for r in sorted(rows, key=lambda r: r.seg_no):
        got.setdefault(r.doc_id, []).append(r.lang)
        assert 0 < r.confidence <= 1 and r.begin_char < r.end_char
    assert got == {1: ["en"], 2: ["en", "de"], 3: ["ru"], 4: ["es"], 5: ["de"], 6: ["es"], 10: ["ru", "en", "es"], 11: ["de", "en"], 12: ["en"], 13: ["de", "de"], None: ["es"]}
    state = {r.doc_id: r.label_state for r in rows}
    assert state == {1: "right", 2: "mixed", 3: "missing", 4: "right", 5: "wrong", 6: "missing", 10: "mixed", 11: "mixed", 12: "right", 13: "right", None: "wrong"}
    assert L.identify_languages(df.limit(0), model).count() == 0


def test_fit_on(spark):
    rows = [(i, "en" if i % 2 else "de", say(random.Random(i), "en" if i % 2 else "de")) for i in range(30)] + [(99, None, "x"), (98, "en", None)]
    m = L.fit_on(spark.createDataFrame(rows, "sample_id long, lang string, sample_text string"))
    assert m.langs == ["de", "en"]
    none = L.fit_on(spark.createDataFrame([], "sample_id long, lang string, sample_text string"))
    assert none.langs == []
    assert L.identify_languages(spark.createDataFrame([(1, "a b", "en")], "doc_id long, text string, lang string"), none).count() == 0


def test_few_words_of_another_language(spark, model):
    """Some words of another language within a sentence make no stretch, in quotes or not; a long quotation is scored with its sentence."""
    rnd = random.Random(7)
    docs = [(1, f"She carried slowly “{say(rnd, 'de', 40)}”."), (2, f"She carried slowly \"{say(rnd, 'en', 40)}\"."), (3, f"{say(rnd, 'en', 9)} “{say(rnd, 'de', 2)}”."), (4, f"{say(rnd, 'en', 9)}. {say(rnd, 'en', 5)} {say(rnd, 'es', 2)} {say(rnd, 'en', 5)}.")]
    rows = L.identify_languages(spark.createDataFrame(docs, "doc_id long, text string").withColumn("lang", F.lit("en")), model).orderBy("doc_id", "seg_no").collect()
    assert [(r.doc_id, r.lang) for r in rows] == [(1, "de"), (2, "en"), (3, "en"), (4, "en")]


@pytest.mark.parametrize("marks", ["“”", '""', "«»", "„“"])
def test_quoted_words(marks):
    a, b = marks
    q = lambda k: f"{a}{' '.join('abcdefghij'[:k])}{b}"
    texts = {f"one {q(2)} two three.": True, f"one {q(2)} two.": False, f"one two three four five six {q(5)}.": True, f"one two three four five six seven {q(6)}.": False, f"one two {q(1)} three four {q(2)} five!": True, f"one {q(2)} two three {q(2)} four.": False, f"{a}one two. three{b} four": False, f"one two three {a}four": False, "no mark": False, "": False}
    for text, left_out in texts.items():
        cps, off = code_points(pa.array([text]))
        ends = np.flatnonzero(L.sentence_ends()[cps]) + 1
        got = L._unquoted(cps, np.unique([0, *ends, len(cps)]))
        assert (got != cps).any() == left_out, text
        if left_out:
            assert not set("abcdefghij") & set("".join(map(chr, got)).split())


def test_wide_alphabets_and_many_languages():
    """3,000 different letters, and more languages than a byte can number."""
    rnd = random.Random(3)
    han = [chr(0x4E00 + i) for i in range(3000)]
    ko = [chr(0xAC00 + i) for i in range(2000)]
    text = lambda letters: " ".join("".join(rnd.choice(letters) for _ in range(4)) for _ in range(200))
    m = L.fit([text(han) for _ in range(12)] + [text(ko) for _ in range(12)] + [say(rnd, "en") for _ in range(12)], ["zh"] * 12 + ["ko"] * 12 + ["en"] * 12)
    words, off = fold(*code_points(pa.array([text(han), text(ko), say(rnd, "en")])))
    assert [m.langs[i] for i in m.scores(words, off).argmax(1)] == ["zh", "ko", "en"]
    gain = np.eye(300)[[299, 299, 5, 5, 5]] * 3
    assert L._viterbi(gain, np.array([0]), np.array([5]), 0.5).tolist() == [299, 299, 5, 5, 5]


def test_lookup_is_exact():
    rnd = np.random.default_rng(1)
    keys = np.unique(rnd.integers(0, 1 << L.HASH_BITS, 500))
    keys = np.unique(np.append(keys, (keys[:50] & 0xFFFF) | (7 << 40)))  # shared low bits
    m = L.Model(["a"], keys, np.zeros((len(keys), 1), np.float32))
    asked = np.append(keys[::3], rnd.integers(0, 1 << L.HASH_BITS, 1000))
    hit, at = m._find(asked)
    assert hit.tolist() == np.flatnonzero(np.isin(asked, keys)).tolist() and (keys[at] == asked[hit]).all()


def test_switch_is_chosen_on_held_out_samples():
    rnd = random.Random(2)
    langs = [lang for lang in VOCAB for _ in range(12)]
    texts = [f"{say(rnd, x).capitalize()}. {say(rnd, x)}!" for x in langs]
    switch, report = L.choose_switch(texts, langs)
    assert switch in L.SWITCHES and report["wrong_texts"] < report["texts"] / 10 and report["wrong_texts"] <= min(report["wrong_by_switch"].values()) * 2 + 1
    assert L.choose_switch(texts, langs) == (switch, report)
    assert L.choose_switch(texts[:5], langs[:5]) == (1.0, {})


def test_labels(spark):
    names = spark.createDataFrame([("sw", "swh", "Swahili"), ("xq", "xqq", "Ownish"), ("", "zzz", "Nothing")], "iso639_1 string, iso639_3 string, lang_name string")
    codes = L.label_codes(spark, names)
    told = {"en": "en", " EN_us": "en", "eng": "en", "English": "en", "Español": "es", "es-419": "es", "ger": "de", "deu": "de", "in": "id", "swh": "sw", "it": "it", "русский": "ru", "Ownish": "xq", "zz": None, "und": None, "": None, None: None, "?": None, "unk": None, "zzz": None}
    assert {k: L.label_code(k, codes) for k in told} == told


def test_full_width_full_stops_end_sentences(spark, model):
    rnd = random.Random(11)
    docs = [(i, f"{say(rnd, 'en', 8)}{end}{say(rnd, 'de', 8)}{end}") for i, end in enumerate("．｡。.")]
    rows = L.identify_languages(spark.createDataFrame(docs, "doc_id long, text string").withColumn("lang", F.lit("en")), model).orderBy("doc_id", "seg_no").collect()
    assert [(r.doc_id, r.lang, r.begin_char) for r in rows] == [x for i, text in docs for x in ((i, "en", 0), (i, "de", text.index(text[-1]) + 1))]
