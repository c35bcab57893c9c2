import pytest
from pyspark.sql import functions as F

from quillstream.functions import text as X
from quillstream.functions import unicode as N


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(fn(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("text,tokens", [
    ("He said, {3}to-day!", ["He", " ", "said", ",", " ", "{3}", "to-day", "!"]), ("a--b", ["a", "-", "-", "b"]), ("it's.", ["it's", "."]),
    ("{4}_{5}x", ["{4}_{5}", "x"]), ("", []), ("  ", ["  "]), ("é́x", ["é́x"]),
])
def test_tokens(spark, text, tokens):
    assert one(spark, text, X.token_list) == tokens
    assert "".join(tokens) == text


def test_types(spark):
    df = spark.createDataFrame([("{3}",), (" ",), ("a",), ("1",), (",",), ("{",)], "t string").select(X.token_type(F.col("t")).alias("k"))
    assert [r.k for r in df.collect()] == ["V", "S", "W", "W", "P", "P"]


def test_numbers_and_references(spark):
    assert [one(spark, x, X.leading_int) for x in ("12r", "r", "", None)] == [12, 0, 0, 0]
    assert [one(spark, x, X.zero_fill) for x in ("12r", "123456", "")] == ["00012r", "123456", "00000"]
    ref = spark.createDataFrame([("KAR", 3, "4", 3, "6"), ("KAR", 3, "4", 5, "6"), ("KAR", 3, "4", 3, "4"), ("KAR", 3, "", 0, ""), ("KAR", 0, "", 0, ""), ("KAR", 3, "4a", 3, "4a")], "b string, c int, v string, ce int, ve string")
    texts = [r.t for r in ref.select(X.reference(*[F.col(c) for c in ("b", "c", "v", "ce", "ve")]).alias("t")).collect()]
    assert texts == ["KAR 3:4-6", "KAR 3:4-5:6", "KAR 3:4", "KAR 3", "KAR", "KAR 3:4a"]
    back = [tuple(one(spark, t, X.parse_reference)) for t in texts]
    assert back == [("KAR", 3, "4", 3, "6"), ("KAR", 3, "4", 5, "6"), ("KAR", 3, "4", 3, "4"), ("KAR", 3, "", 3, ""), ("KAR", 0, "", 0, ""), ("KAR", 3, "4a", 3, "4a")]


def test_joining_and_versifying(spark):
    assert one(spark, ["He said", ", “", "yes", "”", "", None, "and (", "so", ")"], X.smart_join, "array<string>") == "He said, “yes” and (so)"
    assert one(spark, [], X.smart_join, "array<string>") == ""
    got = [tuple(v) for v in one(spark, "intro {1}one {2}_{3}two {4}", X.versify)]
    assert got == [("0", "intro"), ("1", "one"), ("2-3", "two"), ("4", "")]


def test_cleanup(spark):
    x = "<<He>> said: “to-day’s” {3}«all»!"
    assert one(spark, x, lambda c: X.without_markers(X.cleanup(c))) == "he said todays all"
    assert one(spark, x, lambda c: X.cleanup(c, prompts=False, punctuation=False, double_quotes="normalize", apostrophes="normalize", hyphens="normalize", lower=False)) == '<<He>> said: “to-day\'s” {3}"all»!'


def test_unicode_and_numbers(spark):
    assert one(spark, "é", N.normal_form) == "é" and one(spark, None, N.normal_form) is None
    assert one(spark, "Ŷé ﬁ", N.strip_marks) == "Ye fi"
    said = {"0": "zero", "17": "seventeen", "342": "three hundred forty-two", "1,000,005": "one million five", "-8": "minus eight", "word": "word", "..": "zero", "21": "twenty-one"}
    assert {k: one(spark, k, N.number_words) for k in said} == said


def test_time_labels(spark):
    assert [one(spark, x, X.clock, "double") for x in (0.0, 65.6, 600.5)] == ["0:0", "1:5", "10:0"]
    assert one(spark, "x time=00:01:02.50 y time=01:00:00.25", X.log_seconds) == 3600.25 and one(spark, "no", X.log_seconds) is None


def test_names(spark):
    assert [one(spark, x, X.media_type) for x in ("a.MP3", "b.usx", "c.sfm", "d.xlsm", "e.csv", "f.json", "g")] == ["audio", "text_usx", "text_usfm", "text_script", "text_csv", "text_plain", "unknown"]
    assert tuple(one(spark, "B01___03_Kar_________QKAN1DA.mp3", X.audio_name)) == ("NT", 1, 3, "QKAN1DA")
