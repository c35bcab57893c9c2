"""Queries of alignment, normalisation and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.functions import normalise as N
from quillstream.functions import text as X
from quillstream.model import letters, lines, tokens
from quillstream.operators import alignment as A
from quillstream.plans.current_sql import plain_width, sql
from quillstream.runtime import table


def audio_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 30 s over every recording (DIF-18)."""
    r = lines(spark, sf_dir, "dataset_id", "audio_file", "script_end_ts").filter(F.col("audio_file").isNotNull() & (F.col("audio_file") != "") & ~F.isnan("script_end_ts")).groupBy("dataset_id", "audio_file").agg(F.max("script_end_ts").alias("total"))
    w = r.select("dataset_id", "audio_file", F.posexplode(A.audio_windows(F.col("total"))).alias("pos", "w"))
    return w.select("dataset_id", "audio_file", F.col("pos").cast("long").alias("pos"), F.round("w.begin", 6).alias("begin_ts"), F.round("w.end", 6).alias("end_ts"))


def letter_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aligned letters of each word laid against its own: how many agree (DIF-13..15)."""
    c = letters(spark, sf_dir, "word_id", "uroman", "start_ts").filter("uroman is not null")
    w = tokens(spark, sf_dir, "ttype", "uroman").filter("ttype = 'W' and uroman is not null")
    heard = c.join(w.select("word_id"), "word_id", "left_semi").groupBy("word_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("char_id", "uroman", "start_ts"))), lambda r: F.struct(r["uroman"].alias("ch"), r["start_ts"].alias("ts"))).alias("audio"))
    own = w.select("word_id", F.transform(F.filter(F.split(F.lower("uroman"), ""), lambda x: x != ""), lambda x, i: F.struct(i.cast("long").alias("id"), x.alias("ch"))).alias("text"))
    a = heard.join(own, "word_id").select("word_id", A.aligned_letters(F.col("audio"), F.col("text")).alias("a"))
    count = lambda k: F.size(F.filter("a", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return a.select("word_id", count("same"), count("audio"), count("text"))


def normalised_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by the normaliser of their dataset's alphabet (STR-22)."""
    i = table(spark, sf_dir, "ident").select("dataset_id", "alphabet")
    t = lines(spark, sf_dir, "dataset_id", "script_text").join(i, "dataset_id", "left")
    return t.select("script_id", N.normalised_by(F.col("script_text"), F.col("alphabet"), {"Cyrl": {"mappings": (("ё", "е"),)}}).alias("text"))


def padded_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors padded to 80 values, and their masks (MTH-01, MTH-02)."""
    e = table(spark, sf_dir, "embeddings").withColumn("v", F.transform("embedding", lambda x: x.cast("double")))
    total = lambda c, z: F.aggregate(c, z, lambda a, x: a + x)
    return e.select("vec_id", F.size(N.padded_vector(F.col("v"), 80)).cast("long").alias("width"), total(N.attention_mask(F.col("v"), 80), F.lit(0)).cast("long").alias("n_true"), F.round(total(N.padded_vector(F.col("v"), 80), F.lit(0.0)), 4).alias("total"))


def recording_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings by dataset and kind of file (AGG-34)."""
    f = lines(spark, sf_dir, "dataset_id", "audio_file").filter("audio_file <> ''").select("dataset_id", "audio_file").distinct().withColumn("kind", X.media_type(F.col("audio_file")))
    return N.folders(f, "dataset_id", "kind")


QUERIES = {f.__name__: f for f in (audio_windows, letter_alignment, normalised_lines, padded_vectors, recording_folders)}
_WHITE = r"[\t\n\x{000B}\x{000C}\r \x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_LOWER = rf"regexp_replace(lower(nfc_normalize({plain_width('script_text')})), '\([^()]*\d[^()]*\)', ' ', 'g')"
ORACLE = {
    "normalised_lines": sql(rf"SELECT script_id, array_to_string(list_filter(regexp_split_to_array(regexp_replace(CASE WHEN alphabet = 'Cyrl' THEN replace({_LOWER}, 'ё', 'е') ELSE {_LOWER} END, '[\p{{P}}\p{{S}}]', ' ', 'g'), '{_WHITE}+'), lambda x: x <> '' AND NOT regexp_full_match(x, '\d+')), ' ') AS text FROM s LEFT JOIN (SELECT dataset_id, alphabet FROM ident) USING (dataset_id) WHERE script_text IS NOT NULL UNION ALL SELECT script_id, NULL FROM s WHERE script_text IS NULL"),
    "audio_windows": sql("SELECT dataset_id, audio_file, pos, round(greatest(pos * 30 - 3.0, 0), 6) AS begin_ts, round(least((pos + 1) * 30.0, total), 6) AS end_ts FROM (SELECT dataset_id, audio_file, total, unnest(range(0, greatest(ceil(total / 30), 1)::BIGINT)) AS pos FROM (SELECT dataset_id, audio_file, max(script_end_ts) AS total FROM s WHERE audio_file <> '' AND NOT isnan(script_end_ts) GROUP BY ALL) WHERE total > 0)"),
    "padded_vectors": "SELECT vec_id, greatest(80, len(embedding)) AS width, len(embedding) AS n_true, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total FROM embeddings",
    "recording_folders": sql("SELECT dataset_id, count(*) AS n_files, min(kind) AS category, min(kind) <> max(kind) AS mixed FROM (SELECT DISTINCT dataset_id, audio_file, CASE WHEN regexp_matches(lower(audio_file), '\\.(mp3|wav|opus|m4a)$') THEN 'audio' ELSE 'unknown' END AS kind FROM s WHERE audio_file <> '') GROUP BY dataset_id"),
}
