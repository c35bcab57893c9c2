"""Queries of problem 4."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.llm.unify import unify
from quillstream.operators.versions import current_rows
from quillstream.runtime import small_side, table

_TEXTS = (("scripts", "script_id", "script_text"), ("words", "word_id", "word"))


def _with_alphabet(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ident = table(spark, sf_dir, "ident").groupBy("dataset_id").agg(F.max("alphabet").alias("alphabet"))
    return table(spark, sf_dir, name).join(small_side(ident), "dataset_id", "left")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose text isn't in the one form.

    The form is made before versions of a key are compared, so that only a flag
    is shuffled, not the text.
    """
    out = None
    for name, key, text in _TEXTS:
        made = _with_alphabet(spark, sf_dir, name).select(key, "loaded_at", "deleted_at", unify(F.col(text), F.col("alphabet"), with_text=False).alias("u"))
        flagged = made.select(key, "loaded_at", "deleted_at", (F.col("u.changed") | F.col("u.foreign")).alias("odd"))
        rows = current_rows(flagged, key, ["odd"]).filter("odd").select(F.lit(name).alias("text_table"), F.col(key).alias("record_id"))
        out = rows if out is None else out.unionByName(rows)
    return out


def p4_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every current record with its text in the one form."""
    out = None
    for name, key, text in _TEXTS:
        made = _with_alphabet(spark, sf_dir, name).select(key, "loaded_at", "deleted_at", unify(F.col(text), F.col("alphabet"))["text"].alias("unified"))
        rows = current_rows(made, key, ["unified"]).select(F.lit(name).alias("text_table"), F.col(key).alias("record_id"), "unified")
        out = rows if out is None else out.unionByName(rows)
    return out


QUERIES = {"p4_found": p4_found, "p4_texts": p4_texts}
_CURRENT = """
WITH a AS (SELECT dataset_id, max(alphabet) AS alphabet FROM ident GROUP BY dataset_id),
r AS (
  SELECT 'scripts' AS text_table, script_id AS record_id, arg_max(struct_pack(t := script_text, d := dataset_id, x := deleted_at), loaded_at) AS v FROM scripts GROUP BY script_id
  UNION ALL
  SELECT 'words', word_id, arg_max(struct_pack(t := word, d := dataset_id, x := deleted_at), loaded_at) FROM words GROUP BY word_id),
t AS (SELECT text_table, record_id, v.t AS t, coalesce(alphabet, '') AS alphabet FROM r LEFT JOIN a ON a.dataset_id = v.d WHERE v.x IS NULL AND record_id IS NOT NULL)
"""
# What is replaced by a space, by nothing, and by plainer characters, one by one.
_SPACES = r"[\t\n\r\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_NOTHING = r"[\p{Cf}\x{034F}\x{180B}-\x{180F}\x{FE00}-\x{FE0F}\x{0000}-\x{0008}\x{000B}\x{000C}\x{000E}-\x{001F}\x{007F}-\x{009F}]"
_WIDE, _PLAIN = ("".join(chr(i + k) for i in range(0x21, 0x7F)).replace("'", "''") for k in (0xFEE0, 0))
_HYPHENS = "‐‑−"
_LIGATURES = (("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"))
# Look-alike letters by alphabet, with the accented ones that have a single character.
_TO_LATIN = ("АВСЕНІЈКМОРЅТХУасеорхуѕһіјԁԛԝӀӏкԚԜҮүΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹαικνορυχγϲϳёЁїЇѐЀ", "ABCEHIJKMOPSTXYaceopxyshijdqwIlkQWYyABEZHIKMNOPTYXCaikvopuxycjëËïÏèÈ")
_TO_CYRILLIC = ("ABCEHIJKMOPSTXYaceopxyshijdqwkΑΒΕΗΙΚΜΟΡΤΥΧϹαικορχγϲϳëËïÏèÈ", "АВСЕНІЈКМОРЅТХУасеорхуѕһіјԁԛԝкАВЕНІКМОРТУХСаікорхусјёЁїЇѐЀ")


def _unified() -> str:
    sql = f"regexp_replace(regexp_replace(t, '{_SPACES}', ' ', 'g'), '{_NOTHING}', '', 'g')"
    sql = f"nfc_normalize(translate({sql}, '{_WIDE}{_HYPHENS}', '{_PLAIN}---'))"
    for a, b in _LIGATURES:
        sql = f"replace({sql}, '{a}', '{b}')"
    latin, cyrillic = (f"translate({sql}, '{a}', '{b}')" for a, b in (_TO_LATIN, _TO_CYRILLIC))
    # Accented Latin letters whose look-alike has no such single character.
    for letter, plain in (("a", "а"), ("e", "е"), ("o", "о"), ("c", "с"), ("i", "і"), ("y", "у"), ("A", "А"), ("E", "Е"), ("O", "О"), ("C", "С"), ("I", "І")):
        for mark in "\u0300\u0301\u0302\u0303\u0304\u0306\u0307\u0308\u030a\u030c\u0327\u0328":
            one = unicodedata.normalize("NFC", letter + mark)
            if len(one) == 1:
                cyrillic = f"replace({cyrillic}, '{one}', '{plain}{mark}')"
    return f"nfc_normalize(CASE alphabet WHEN 'Latn' THEN {latin} WHEN 'Cyrl' THEN {cyrillic} ELSE {sql} END)"


ORACLE: dict[str, str] = {
    "p4_found": rf"""{_CURRENT}
SELECT text_table, record_id FROM t
WHERE t <> nfc_normalize(t) OR regexp_matches(t, '{_SPACES}|{_NOTHING}|[{_HYPHENS}\x{{FB00}}-\x{{FB06}}\x{{FF01}}-\x{{FFEE}}]') OR regexp_matches(regexp_replace(t, '[0-9]', '', 'g'), '\p{{Nd}}')
  OR (alphabet = 'Latn' AND regexp_matches(regexp_replace(t, '\p{{Latin}}', '', 'g'), '\p{{L}}')) OR (alphabet = 'Cyrl' AND regexp_matches(regexp_replace(t, '\p{{Cyrillic}}', '', 'g'), '\p{{L}}'))
""",
    "p4_texts": f"{_CURRENT} SELECT text_table, record_id, {_unified()} AS unified FROM t",
}
