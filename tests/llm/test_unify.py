import random
import unicodedata as U

import pyarrow as pa
from pyspark.sql import functions as F

from quillstream.llm.unify import code_points, to_text, unify, unify_array


def made(texts, alphabet="Latn"):
    return unify_array(pa.array(texts, pa.string()), pa.array([alphabet] * len(texts), pa.string())).to_pylist()


def test_round_trip():
    x = [None, "", "abc", "Ж́🙂", "  ", "\u0000"]
    a = pa.array(x, pa.string())
    assert to_text(*code_points(a), a.is_valid()).to_pylist() == x
    assert to_text(*code_points(a.slice(2, 3))).to_pylist() == x[2:5]


def test_composition_matches_nfc():
    rnd = random.Random(1)
    base = "aeiouAEnNcsyœøđɔɛqxиеуЕжaạ"
    marks = "̧̨̛̣̀́̂̃̈̊̆"
    texts = ["".join(rnd.choice(base) + "".join(rnd.choice(marks) for _ in range(rnd.choice([0, 0, 1, 2, 4]))) for _ in range(rnd.randrange(9))) for _ in range(3000)]
    texts += ["́á", "̣́", "각", "한", "한", "ো"]
    for t, r in zip(texts, made(texts, None)):
        want = U.normalize("NFC", t)
        assert r["text"] == want
        assert r["changed"] == (want != t)


def test_form():
    cases = {
        "Ｄａｙ": "Day", "ﬁve": "five", "a​b­c﻿": "abc", "a b　c": "a b c", "sеnуs": "seny" + "s",
        "Νova": "Nova", "１２": "12", "٣": "3", "“a” «b» — c… ‘d’": "“a” «b» — c… ‘d’", "x‑y": "x-y", "a;": "a;", "！": "!",
        "ẹ́": "ẹ́", "е́": "é", "": "", "​": "",
    }
    for r, (x, want) in zip(made(list(cases)), cases.items()):
        assert (r["text"], r["changed"], r["foreign"]) == (want, x != want, False), x
    cases = {"море": "море", "мoрe": "море", "Тeмa": "Тема", "й": "й", "ё": "ё", "ｐека": "река", "οкно": "окно"}
    for r, (x, want) in zip(made(list(cases), "Cyrl"), cases.items()):
        assert (r["text"], r["changed"], r["foreign"]) == (want, x != want, False), x
    assert made(["ж", "本", None, "a1"]) == [
        {"text": "ж", "changed": False, "foreign": True},
        {"text": "本", "changed": False, "foreign": True},
        {"text": None, "changed": False, "foreign": False},
        {"text": "a1", "changed": False, "foreign": False},
    ]
    assert made(["мoре"], None)[0]["text"] == "мoре"


def test_idempotent_over_all_code_points():
    texts = [chr(c) for c in range(0x30000) if not 0xD800 <= c <= 0xDFFF]
    for alphabet in (None, "Latn", "Cyrl"):
        once = [r["text"] for r in made(texts, alphabet)]
        assert not any(r["changed"] for r in made(once, alphabet))


def test_spark(spark):
    long = "é" * 300_000
    df = spark.createDataFrame([(1, "Ａ", "Latn"), (2, None, "Latn"), (3, "б", None), (4, long, "Latn")], "text int, t string, alphabet string")
    rows = {r.text: r.u for r in df.select("text", unify(F.col("t"), F.col("alphabet")).alias("u")).collect()}
    assert [rows[k].text for k in (1, 2, 3)] == ["A", None, "б"] and rows[4].text == "é" * 300_000
    flags = df.select(unify(F.col("t"), F.col("alphabet"), with_text=False).alias("u")).filter("u.changed").count()
    assert flags == 2
    assert df.limit(0).select(unify(F.col("t"), F.col("alphabet"))).count() == 0
