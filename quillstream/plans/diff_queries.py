"""Queries of comparison, tree search and table changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.functions import text as X
from quillstream.functions.unicode import romanised
from quillstream.model import lines, tokens
from quillstream.operators import diff as D
from quillstream.operators import graph as G
from quillstream.operators import mutations as M
from quillstream.operators.versions import current_rows
from quillstream.plans.current_sql import plain_width, sql
from quillstream.runtime import small_side, table

TOOLS = ("espeak", "mms_asr", "mms_lid", "mms_tts", "whisper")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line's text and the text its tokens make, both comparable, and their diff."""
    s = lines(spark, sf_dir, "dataset_id", "script_text").filter("script_text is not null")
    w = tokens(spark, sf_dir, "script_id", "word_seq", "word").join(s, "script_id", "left_semi")  # ids of no line may be hot
    made = w.groupBy("script_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_seq", "word_id", "word"))), lambda r: F.coalesce(r["word"], F.lit(""))), "").alias("comp"))
    p = s.join(made, "script_id")
    p = p.select("script_id", "dataset_id", F.trim(X.cleanup(F.col("script_text"))).alias("base"), F.trim(X.cleanup(F.col("comp"))).alias("comp"))
    return p.withColumn("d", D.diffs(F.col("base"), F.col("comp")))


def pair_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of both texts as the diff has them (DIF-01, DIF-03)."""
    return _pairs(spark, sf_dir).select("script_id", D.length_of(F.col("d"), 0, -1).cast("long").alias("base_len"), D.length_of(F.col("d"), 0, 1).cast("long").alias("comp_len"))


def pair_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose words differ from their text, with scores and HTML (DIF-01, DIF-04, AGG-15, SNK-10)."""
    p = _pairs(spark, sf_dir).filter(~D.only_spaces(F.col("d")))
    return p.select(
        "script_id", D.length_of(F.col("d"), 1).alias("inserted"), D.length_of(F.col("d"), -1).alias("deleted"), D.longest_run(F.col("d")).alias("longest"),
        F.round(D.error_percent(F.col("d"), F.col("base"), F.col("comp")), 6).alias("error_percent"), D.rendered(F.col("d")).alias("html"),
    )


def common_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences left after those seen more than five times are suppressed (DIF-05..09, AGG-20..22)."""
    words = tokens(spark, sf_dir, "ttype", "word").filter("ttype = 'W'").select(F.lower("word").alias("word")).distinct()
    p = D.suppress_systematic(_pairs(spark, sf_dir).filter(~D.only_spaces(F.col("d"))), "script_id", "d", words, 5)
    return p.select("script_id", D.longest_run(F.col("d")).alias("before"), D.longest_run(F.col("kept")).alias("after"))


def roman_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comparable text of lines: native for Latin datasets, else romanised (STR-32, DIF-02)."""
    i = table(spark, sf_dir, "ident").select("dataset_id", "alphabet")
    t = lines(spark, sf_dir, "dataset_id", "script_text", "uroman").join(small_side(i), "dataset_id", "left")
    text = F.when(F.col("alphabet") == "Latn", F.col("script_text")).otherwise(F.coalesce(F.nullif("uroman", F.lit("")), romanised(F.col("script_text"))))
    return t.select("script_id", text.alias("text"))


def nearest_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest language each tool knows, for every node (GRF-01..05)."""
    n = G.nearest_supported(table(spark, sf_dir, "languages"), "id", "parent_id", TOOLS)
    return n.select("node_id", "tool", "found_id", F.col("distance").cast("long").alias("distance"))



def upsert_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All current lines, those that aren't headings replaced by their new version (DML-01..03)."""
    t = lines(spark, sf_dir, "dataset_id", "chapter_num", "verse_str")
    old = t.select("script_id", "dataset_id", F.lit("old").alias("state"), "verse_str")
    new = t.filter("verse_str <> '0'").select("script_id", "dataset_id", F.lit("new").alias("state"), "verse_str")
    return M.upsert(old, new, ["script_id"])


def keyed_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with begin and end taken from their words where these have them (DML-04..06, DML-11, DML-12)."""
    w = tokens(spark, sf_dir, "script_id", "ttype", "word_begin_ts", "word_end_ts").filter("ttype = 'W' and word_end_ts > 0 and not isnan(word_end_ts) and script_id is not null")
    c = w.groupBy("script_id").agg(F.min("word_begin_ts").alias("script_begin_ts"), F.max("word_end_ts").alias("script_end_ts"))
    out = M.keyed_update(lines(spark, sf_dir, "script_begin_ts", "script_end_ts"), c, ["script_id"], ["script_begin_ts", "script_end_ts"])
    return out.select("script_id", "script_begin_ts", "script_end_ts")


def update_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word groups whose line isn't there, which a strict update refuses (DML-06)."""
    w = tokens(spark, sf_dir, "script_id").filter("script_id is not null").groupBy("script_id").agg(F.count(F.lit(1)).alias("n_words"))
    return M.unmatched(lines(spark, sf_dir, "dataset_id"), w, ["script_id"])


def cascaded_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left by dataset when withdrawn lines take theirs along (DML-07, DML-08)."""
    w = M.cascade(tokens(spark, sf_dir, "dataset_id", "script_id"), lines(spark, sf_dir, "dataset_id"), "script_id", "script_id")
    return w.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n_words"))


def merged_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers with the text source of the tree's name where one is found (DML-14, DML-15)."""
    new = table(spark, sf_dir, "ident").select("dataset_id", F.col("asr_language_iso").alias("language_iso"), F.lit("").alias("version_code"))
    cols = ["language_iso", "version_code"]
    return M.overwrite_filled(table(spark, sf_dir, "ident").select("dataset_id", *cols), new, ["dataset_id"], cols)


def line_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of versions and the current state of every line (DML-09, DML-10)."""
    n = table(spark, sf_dir, "scripts").groupBy("script_id").agg(F.countDistinct("loaded_at").alias("n_versions"))
    c = current_rows(table(spark, sf_dir, "scripts"), "script_id", ["dataset_id"], keep_deleted=True)
    return n.join(c, "script_id").select("script_id", "dataset_id", "n_versions", "is_deleted")


QUERIES = {f.__name__: f for f in (pair_lengths, pair_diffs, common_patterns, roman_choice, nearest_node, upsert_lines, keyed_update, update_misses, cascaded_words, merged_headers, line_history)}

_CLEAN = r"""trim(lower(regexp_replace({0}, '<<|>>|\(\(|[†\[\]<>]|[,;:.!?~]|["“”«»]|[''ꞌ‘’]|[-‐‑‒–—―﹘﹢﹣－]', '', 'g')), ' ')"""
ORACLE = {
    "pair_lengths": sql(f"SELECT script_id, length({_CLEAN.format('script_text')}) AS base_len, length({_CLEAN.format('heard')}) AS comp_len FROM s JOIN (SELECT script_id, string_agg(coalesce(word, ''), '' ORDER BY word_seq, word_id) AS heard FROM w WHERE script_id IS NOT NULL GROUP BY script_id) USING (script_id) WHERE script_text IS NOT NULL"),
    "roman_choice": sql(f"SELECT script_id, CASE WHEN alphabet = 'Latn' THEN script_text ELSE coalesce(nullif(uroman, ''), lower(strip_accents({plain_width('script_text')}))) END AS text FROM s LEFT JOIN (SELECT dataset_id, alphabet FROM ident) USING (dataset_id)"),
    "nearest_node": "WITH RECURSIVE up AS (SELECT id AS node_id, id AS anc, parent_id, 0 AS d FROM languages UNION ALL SELECT node_id, l.id, l.parent_id, d + 1 FROM up JOIN languages l ON l.id = up.parent_id), has AS (UNPIVOT (SELECT id AS found_id, espeak, mms_asr, mms_lid, mms_tts, whisper FROM languages) ON espeak, mms_asr, mms_lid, mms_tts, whisper INTO NAME tool VALUE code), p AS (SELECT a.node_id, tool, found_id, min(a.d + b.d) AS distance FROM up a JOIN up b USING (anc) JOIN has ON has.found_id = b.node_id WHERE code <> '' GROUP BY ALL) SELECT node_id, tool, found_id, distance FROM p QUALIFY distance = min(distance) OVER (PARTITION BY node_id, tool)",
    "upsert_lines": sql("SELECT script_id, dataset_id, CASE WHEN verse_str <> '0' THEN 'new' ELSE 'old' END AS state, verse_str FROM s"),
    "keyed_update": sql("SELECT script_id, coalesce(b, script_begin_ts) AS script_begin_ts, coalesce(e, script_end_ts) AS script_end_ts FROM s LEFT JOIN (SELECT script_id, min(word_begin_ts) AS b, max(word_end_ts) AS e FROM w WHERE ttype = 'W' AND word_end_ts > 0 AND NOT isnan(word_end_ts) AND script_id IS NOT NULL GROUP BY script_id) USING (script_id)"),
    "update_misses": sql("SELECT script_id, count(*) AS n_words FROM w WHERE script_id IS NOT NULL AND script_id NOT IN (SELECT script_id FROM s) GROUP BY script_id"),
    "cascaded_words": sql("SELECT dataset_id, count(*) AS n_words FROM w WHERE script_id IN (SELECT script_id FROM s) GROUP BY dataset_id"),
    "merged_headers": "SELECT dataset_id, coalesce(nullif(asr_language_iso, ''), language_iso) AS language_iso, version_code FROM ident",
    "line_history": "SELECT script_id, arg_max(dataset_id, loaded_at) AS dataset_id, count(DISTINCT loaded_at) AS n_versions, arg_max(deleted_at IS NOT NULL, loaded_at) AS is_deleted FROM scripts GROUP BY script_id",
}
