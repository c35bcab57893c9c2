import random
import re
import unicodedata as U

import numpy as np
import pyarrow as pa

from quillstream.llm import leaks
from quillstream.llm.leaks import find_leaks, fold, passages
from quillstream.llm.unify import code_points, to_text


def words_of(texts):
    return to_text(*fold(*code_points(pa.array(texts, pa.string())))).to_pylist()


def test_fold():
    cases = {
        "": "", "12 — …": "", None: "", "Ab, cd!": " ab cd ", "\\v 12 Text\\wj word\\wj* \\p\n\\c 3": " text word ", "a​b­c": " abc ",
        "Ｄay": " day ", "сеnus": " cenus ", "Ваr": " bar ", "x1y": " x y ", "É": " é ", "Νο": " no ", "it's": " it s ", "ǖ": " ǖ ", "ạ́": " ạ́ ",
    }
    for (x, want), got in zip(cases.items(), words_of(list(cases))):
        assert got == U.normalize("NFD", want), x


def plain(t):
    return re.findall(r"[a-zé]+", t.lower())


def brute(docs, items, n=10):
    out = set()
    for i, it in items:
        w = plain(it or "")
        runs = [w] if 0 < len(w) <= n else [w[k : k + n] for k in range(len(w) - n + 1)] if w else []
        for d, t in docs:
            text = " " + " ".join(plain(t or "")) + " "
            if any(" " + " ".join(r) + " " in text for r in runs):
                out.add((d, i))
    return out


def test_against_brute_force(spark):
    rnd = random.Random(3)
    vocab = ["a", "be", "cat", "door", "every", "flower", "gé", "x"]
    say = lambda k: " ".join(rnd.choice(vocab) for _ in range(k))
    items = [(i, say(rnd.choice([1, 3, 9, 10, 11, 25]))) for i in range(60)] + [(90, None), (91, ""), (92, "12 —"), (93, "a-Door: be!")]
    docs = []
    for d in range(300):
        t = say(rnd.choice([0, 4, 30, 200]))
        if d % 3 == 0:
            w = plain(rnd.choice(items[:60])[1])
            a = rnd.randrange(len(w))
            t += ", " + " ".join(w[a : a + rnd.choice([9, 10, 30])]).upper() + "\n\\v 3 " + say(5)
        docs.append((d, t))
    docs += [(1000, None), (1001, ""), (1002, "xx" * 5000), (1003, docs[0][1]), (1003, docs[1][1])]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item int")
    it = spark.createDataFrame(items, "item_id long, item_text string")
    strip = [(d, re.sub(r"\\\w+", " ", t) if t else t) for d, t in docs]
    for chars in (leaks.PASS_CHARS, 900):
        assert {(r.doc_id, r.item_id) for r in find_leaks(df, it, pass_chars=chars).collect()} == brute(strip, items)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    it = spark.createDataFrame([(1, "a b")], "item_id long, item_text string")
    assert find_leaks(df, it).count() == 0
    assert find_leaks(spark.createDataFrame([(1, "a b")], df.schema), it.limit(0)).count() == 0


def test_search_finds_every_place():
    rnd = np.random.default_rng(1)
    text = rnd.integers(97, 99, 20_000).astype(np.uint32)
    strings = [text[i : i + k].copy() for i in range(0, 19_000, 900) for k in (12, 13, 20)]
    raw = text.tobytes()
    want = {(i, s) for s, x in enumerate(strings) for i in range(len(text) - len(x) + 1) if raw[4 * i : 4 * (i + len(x))] == x.tobytes()}
    assert {(p, i) for p, _, _, i in tables_of(strings).search(text)} == want


def tables_of(strings):
    n = np.array([len(x) for x in strings])
    return leaks.WuManber(np.concatenate(strings), np.cumsum(n) - n, n, np.arange(len(n)))


def test_very_long_string():
    """A class whose shortest string has 70,000 code points: shifts beyond two bytes."""
    rnd = np.random.default_rng(2)
    string = rnd.integers(97, 123, 70_000).astype(np.uint32)
    text = np.concatenate([rnd.integers(97, 123, 90_000).astype(np.uint32), string, string[:500]])
    assert [(p, i) for p, _, _, i in tables_of([string]).search(text)] == [(90_000, 0)]


def test_greek(spark):
    """Greek text in either case, and Greek letters in Latin text by the look of either case, but not one Latin letter for another."""
    docs = [(1, "ΝΑΙ ΥΠΑΡΧΕΙ ΝΕΡΟ"), (2, "ναι υπάρχει νερό".replace("ά", "α").replace("ό", "ο")), (3, "ηaνe Νone uνula"), (4, "have none uvula"), (5, "hane vone yvyla"), (6, "HAVE NONE UVULA"), (7, "haνe νone Υνula")]
    items = [(1, "ναι υπαρχει νερο"), (2, "have none uvula"), (3, "Ναι Υπαρχει Νερο")]
    got = find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, item_text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, 1), (1, 3), (2, 1), (2, 3), (3, 2), (4, 2), (6, 2), (7, 2)}


def test_passages():
    assert passages(np.zeros(0, np.uint32)) == []
    w = np.array([ord(c) for c in " a b c "], np.uint32)
    assert len(passages(w, 3)) == 1 and len(passages(w, 2)) == 2
