"""Queries of problem 7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.llm.leaks import find_leaks
from quillstream.runtime import table


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).select("doc_id", "item_id")


def p7_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test items that leaked: into how many documents, at how many places."""
    return _leaks(spark, sf_dir).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("n_places").alias("n_places"))


QUERIES = {"p7_found": p7_found, "p7_items": p7_items}


# Look-alike letters of the SQL, in the order of their Latin ones; capitals are told from small letters before lower().
_FROM = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαικνορυχγавеѕіјкмнортсухһԁԛԝӏүАВЕЅІЈКМНОРТСУХ"
_TO = "ABEZHIKMNOPTYXaikvopuxyabesijkmhoptcyxhdqwlyABESIJKMHOPTCYX"
_WIDE, _PLAIN = ("".join(chr(i + k) for i in range(0x21, 0x7F)) for k in (0xFEE0, 0))


def _words(text: str) -> str:
    """SQL of the list of words of a text: markers, invisible characters, width, case, look-alikes and the form of accents make no difference."""
    sql = f"regexp_replace(regexp_replace({text}, '\\\\[A-Za-z0-9+]+', ' ', 'g'), '\\p{{Cf}}', '', 'g')"
    sql = f"translate(nfc_normalize(translate({sql}, '{_WIDE.replace(chr(39), chr(39) * 2)}', '{_PLAIN.replace(chr(39), chr(39) * 2)}')), '{_FROM}ёЁїЇ', '{_TO}ëËïÏ')"
    for a, b in (("ß", "ss"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl")):
        sql = f"replace({sql}, '{a}', '{b}')"
    return f"regexp_extract_all(nfc_normalize(lower({sql})), '[\\p{{L}}\\p{{M}}]+')"


_HITS = f"""
WITH d AS (SELECT doc_id, ws, len(ws) AS n FROM (SELECT doc_id, {_words("text")} AS ws FROM documents WHERE text IS NOT NULL)),
i AS (SELECT item_id, ws, len(ws) AS n FROM (SELECT item_id, {_words("item_text")} AS ws FROM eval_items WHERE item_text IS NOT NULL)),
dg AS (SELECT doc_id, array_to_string(ws[k:k + 9], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, n - 8)) AS k FROM d WHERE n >= 10)),
ig AS (SELECT item_id, array_to_string(ws[k:k + 9], ' ') AS g FROM (SELECT item_id, ws, unnest(range(1, n - 8)) AS k FROM i WHERE n >= 10)),
few AS (
  SELECT doc_id, item_id, d.ws AS dw, i.ws AS iw FROM d JOIN i ON i.n BETWEEN 1 AND 9 AND contains(' ' || array_to_string(d.ws, ' ') || ' ', ' ' || array_to_string(i.ws, ' ') || ' ')),
hit AS (
  SELECT doc_id, item_id FROM dg JOIN ig USING (g)
  UNION ALL
  SELECT doc_id, item_id FROM (SELECT doc_id, item_id, unnest(list_filter(range(1, len(dw) - len(iw) + 2), lambda p: dw[p:p + len(iw) - 1] = iw)) FROM few))
"""
ORACLE: dict[str, str] = {
    "p7_found": f"{_HITS} SELECT DISTINCT doc_id, item_id FROM hit",
    "p7_items": f"{_HITS} SELECT item_id, count(DISTINCT doc_id) AS n_documents, count(*) AS n_places FROM hit GROUP BY item_id",
}
