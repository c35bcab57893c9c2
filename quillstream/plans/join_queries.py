"""Queries of projections, filters and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstream.functions import text as X
from quillstream.model import features, known, letters, lines, tokens
from quillstream.operators import joins as J
from quillstream.operators.intervals import to_ms
from quillstream.plans.current_sql import sql
from quillstream.runtime import small_side, table

HEADINGS = ("para.h", "para.mt", "para.mt1", "para.mt2", "para.mt3")


def _long(name: str):
    return F.col(name).cast("long").alias(name)


def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each table (PRJ-01, PRJ-02)."""
    out = None
    for name in ("ident", "books", "languages", "scripts", "words", "chars", "word_mfcc"):
        n = table(spark, sf_dir, name).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        out = n if out is None else out.unionByName(n)
    return out


def chapters_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters in the order of their first line (PRJ-03)."""
    c = lines(spark, sf_dir, "dataset_id", "book_id", "chapter_num").groupBy("dataset_id", "book_id", "chapter_num").agg(F.min("script_id").alias("first_line"))
    w = W.partitionBy("dataset_id").orderBy("first_line")
    return c.select("dataset_id", "book_id", _long("chapter_num"), "first_line", F.row_number().over(w).cast("long").alias("place"))


def chapter_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of each chapter (PRJ-04)."""
    return lines(spark, sf_dir, "dataset_id", "book_id", "chapter_num", "audio_file").filter("audio_file <> ''").select("dataset_id", "book_id", _long("chapter_num"), "audio_file").distinct()


def dataset_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One header a dataset, with empty ids as defaults (PRJ-05)."""
    i = table(spark, sf_dir, "ident")
    return i.select("dataset_id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("bible_id", "audio_ot_id", "audio_nt_id", "text_ot_id", "text_nt_id", "language_iso", "alphabet")], F.coalesce("language_id", F.lit(0)).cast("long").alias("language_id"))


def heading_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of books and chapters: the last heading line of each (PRJ-09, PRJ-27)."""
    h = lines(spark, sf_dir, "dataset_id", "book_id", "chapter_num", "usfm_style", "script_text").filter(F.col("usfm_style").isin(*HEADINGS))
    kind = F.when(F.col("usfm_style") == "para.h", "chapter").otherwise("book")
    place = F.when(kind == "chapter", F.col("chapter_num")).otherwise(F.lit(0)).cast("long")
    g = h.groupBy("dataset_id", "book_id", kind.alias("kind"), place.alias("chapter_num"))
    return g.agg(F.count(F.lit(1)).alias("n_lines"), F.max_by("script_text", "script_id").alias("title"))


def spelled_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct words, spelled as inserted and as deleted runs (PRJ-14)."""
    w = tokens(spark, sf_dir, "ttype", "word").filter("ttype = 'W' and word is not null").select(F.lower("word").alias("word")).distinct()
    return w.select("word", X.spelled(F.col("word"), "-").alias("deleted"), X.spelled(F.col("word"), "+").alias("inserted"))


def last_line_by_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last line of each script number (PRJ-15, PRJ-16)."""
    t = lines(spark, sf_dir, "dataset_id", "script_num", "verse_str")
    return t.groupBy("dataset_id", "script_num").agg(F.max("script_id").alias("script_id"), F.max_by("verse_str", "script_id").alias("verse_str"))


def word_log_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """-log10 of scored words (PRJ-17, PRJ-19)."""
    w = tokens(spark, sf_dir, "ttype", "fa_score").filter((F.col("ttype") == "W") & known(F.col("fa_score")) & (F.col("fa_score") > 0))
    return w.select("word_id", F.round(-F.log10("fa_score"), 6).alias("log_score"))


def testament_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of books of a testament with recordings; lines of unknown books are kept (PRJ-07, PRJ-18, PRJ-21, PRJ-22, JOI-13)."""
    b = small_side(table(spark, sf_dir, "books").select("book_id", "testament", F.col("seq").cast("long").alias("seq")))
    t = lines(spark, sf_dir, "dataset_id", "book_id", "chapter_num", "verse_str").join(b, "book_id", "left")
    return t.filter(F.col("testament").isNull() | (F.col("testament") == "NT")).select("script_id", "dataset_id", "book_id", _long("chapter_num"), "verse_str", "seq")


def pruned_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines fit for training: no heading, scored over 0.2, without a word under 0.01 (PRJ-23)."""
    bad = tokens(spark, sf_dir, "script_id", "ttype", "fa_score").filter("ttype = 'W' and fa_score < 0.01").select("script_id").distinct()
    t = lines(spark, sf_dir, "dataset_id", "verse_str", "fa_score").filter((F.col("verse_str") != "0") & (F.col("fa_score") > 0.2) & ~F.isnan("fa_score"))
    return t.join(bad, "script_id", "left_anti").select("script_id", "dataset_id")


def line_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by whether verse and times are known (PRJ-30)."""
    t = lines(spark, sf_dir, "dataset_id", "verse_num", "script_end_ts").withColumn("verse", F.col("verse_num") > 0).withColumn("times", known(F.col("script_end_ts")))
    state = F.when(F.col("verse") & F.col("times"), "both").when(F.col("verse"), "verse only").when(F.col("times"), "times only").otherwise("neither")
    return t.groupBy("dataset_id", state.alias("state")).agg(F.count(F.lit(1)).alias("n_lines"))


def line_word_char(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters with their word and line (JOI-01)."""
    s = lines(spark, sf_dir, "dataset_id", "book_id", "chapter_num", "verse_str", "audio_file")
    w = tokens(spark, sf_dir, "script_id", "word_seq", "ttype", "word")
    out = J.line_word_char(s, w, letters(spark, sf_dir))
    return out.select("char_id", "word_id", "script_id", "dataset_id", "book_id", _long("chapter_num"), "verse_str", _long("word_seq"), "word", _long("seq"), "start_ts", "end_ts")


def word_with_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with times and scores of word and line (JOI-02..04, JOI-06)."""
    s = lines(spark, sf_dir, "script_num", "script_begin_ts", "script_end_ts", "fa_score").withColumnRenamed("fa_score", "line_score")
    w = tokens(spark, sf_dir, "script_id", "ttype", "word", "word_begin_ts", "word_end_ts", "fa_score").filter("ttype = 'W'")
    return w.join(s, "script_id").select("word_id", "script_id", "script_num", "word", "word_begin_ts", "word_end_ts", "fa_score", "script_begin_ts", "script_end_ts", "line_score")


def word_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters of words and spaces of each line, counted (JOI-05)."""
    w = tokens(spark, sf_dir, "script_id", "ttype", "word").filter("ttype in ('W', 'S') and word <> ''").join(lines(spark, sf_dir, "dataset_id"), "script_id")
    c = w.select("dataset_id", F.explode(F.split(F.lower("word"), "")).alias("letter"))
    return c.groupBy("dataset_id", "letter").agg(F.count(F.lit(1)).alias("n"))


def words_with_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with the size of their feature matrix, 0 if they have none (JOI-07, JOI-08)."""
    w = tokens(spark, sf_dir, "script_id", "ttype").filter("ttype = 'W'").join(lines(spark, sf_dir, "dataset_id").select("script_id"), "script_id")
    m = features(spark, sf_dir).select("word_id", "n_rows", "n_cols", F.size("mfcc").alias("frames"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return w.join(m, "word_id", "left").select("word_id", "script_id", zero("n_rows"), zero("n_cols"), zero("frames"))


def line_text_from_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with the text their tokens make, '' without tokens (JOI-09, AGG-10)."""
    s = lines(spark, sf_dir, "script_text")
    w = tokens(spark, sf_dir, "script_id", "word_seq", "word").join(s, "script_id", "left_semi")  # ids of no line may be hot
    made = w.groupBy("script_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_seq", "word_id", "word"))), lambda r: F.coalesce(r["word"], F.lit(""))), "").alias("heard"))
    return s.join(made, "script_id", "left").select("script_id", "script_text", F.coalesce("heard", F.lit("")).alias("heard"))


def _versions(spark: SparkSession, sf_dir: str, *columns: str) -> tuple[DataFrame, DataFrame]:
    """Datasets 1 and 2, 3 and 4 ... as two versions: rows with ``pair_id``."""
    t = lines(spark, sf_dir, "dataset_id", *columns).withColumn("pair_id", F.ceil(F.col("dataset_id") / 2))
    return t.filter("dataset_id % 2 = 1"), t.filter("dataset_id % 2 = 0")


def version_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of two versions side by side; times of the base, else of the other (JOI-10, JOI-11, SET-05)."""
    cols = ["book_id", "chapter_num", "verse_str", "script_begin_ts", "script_text"]
    keys = ["pair_id", "book_id", "chapter_num", "verse_str"]
    base, comp = (d.groupBy(*keys).agg(F.min_by("script_begin_ts", "script_id").alias("ts"), F.min_by("script_text", "script_id").alias("text")) for d in _versions(spark, sf_dir, *cols))
    p = J.paired(base, comp, keys, ["ts", "text"])
    return p.select("pair_id", "book_id", _long("chapter_num"), "verse_str", "in_base", "in_comp", J.first_known(F.col("base_ts"), F.col("comp_ts")).alias("begin_ts"), F.coalesce("base_text", F.lit("")).alias("base_text"), F.coalesce("comp_text", F.lit("")).alias("comp_text"))


def number_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded lines of one version with the line of the other's script number (JOI-12, SRT-02)."""
    base, comp = _versions(spark, sf_dir, "script_num", "audio_file")
    b = base.groupBy("pair_id", "script_num").agg(F.max("script_id").alias("base_id"))
    return comp.filter("audio_file <> ''").join(b, ["pair_id", "script_num"], "left").select("pair_id", "script_num", "script_id", F.coalesce("base_id", F.lit(0).cast("long")).alias("base_id"))


def timestamp_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates of times that find no line in the other version (JOI-14)."""
    base, comp = _versions(spark, sf_dir, "book_id", "chapter_num", "verse_str")
    return J.missing_from(comp, base, ["pair_id", "book_id", "chapter_num", "verse_str"]).select("pair_id", "book_id", _long("chapter_num"), "verse_str", "script_id")


def _differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["pair_id", "book_id", "chapter_num", "verse_num"]
    base, comp = (d.groupBy(*keys).agg(F.max_by(to_ms(F.col("script_begin_ts")), "script_id").alias("ms")) for d in _versions(spark, sf_dir, "book_id", "chapter_num", "verse_num", "script_begin_ts"))
    return base.join(comp.withColumnRenamed("ms", "other"), keys).filter("ms is not null and other is not null").withColumn("diff_ms", F.col("ms") - F.col("other"))


def begin_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far apart two versions' begins of a verse are (JOI-16)."""
    return _differences(spark, sf_dir).select("pair_id", "book_id", _long("chapter_num"), _long("verse_num"), "diff_ms")


def difference_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by chapter, book and in all (JOI-17)."""
    d = _differences(spark, sf_dir)
    out = d.rollup("pair_id", "book_id", "chapter_num").agg(F.grouping_id().cast("long").alias("depth"), F.count(F.lit(1)).alias("n"), F.round(F.avg("diff_ms"), 6).alias("mean_ms"), F.round(F.stddev_samp("diff_ms"), 6).alias("stddev_ms"))
    return out.select("pair_id", "book_id", _long("chapter_num"), "depth", "n", "mean_ms", "stddev_ms")


def nth_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third word of each line of a dataset with settings, if any (JOI-18)."""
    s = lines(spark, sf_dir, "dataset_id").join(small_side(table(spark, sf_dir, "run_settings").select("dataset_id")), "dataset_id", "left_semi")
    w = tokens(spark, sf_dir, "script_id", "word_seq", "ttype", "word").filter("ttype = 'W'").join(s, "script_id", "left_semi")
    n = F.row_number().over(W.partitionBy("script_id").orderBy("word_seq", "word_id"))
    return w.withColumn("n", n).filter("n = 3").select("script_id", "word_id", "word")


def language_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Datasets' languages in the tree, by the three-letter code, else by the two-letter one (JOI-19..21)."""
    codes = table(spark, sf_dir, "ident").select("dataset_id", F.col("language_iso").alias("code"))
    out = J.two_key_fallback(codes, table(spark, sf_dir, "languages"), "code", "iso639_3", "iso639_1", "id")
    return out.select("dataset_id", "code", F.col("id").alias("node_id"), "found_by")


def line_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with the begin of their first word, -1 if unknown, gaps filled from neighbours (JOI-22)."""
    cue = tokens(spark, sf_dir, "script_id", "ttype", "word_begin_ts").filter(F.col("ttype") == "W").filter(known(F.col("word_begin_ts"))).groupBy("script_id").agg(F.min("word_begin_ts").alias("cue"))
    t = lines(spark, sf_dir, "dataset_id", "audio_file").filter("audio_file <> ''").join(cue, "script_id", "left")
    w = W.partitionBy("dataset_id", "audio_file").orderBy("script_id")
    around = F.coalesce(F.col("cue"), F.last("cue", True).over(w.rowsBetween(W.unboundedPreceding, -1)), F.first("cue", True).over(w.rowsBetween(1, W.unboundedFollowing)), F.lit(-1.0))
    return t.select("script_id", F.coalesce("cue", F.lit(-1.0)).alias("cue"), around.alias("filled"))


def range_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines within runs of ten verses (JOI-23)."""
    t = lines(spark, sf_dir, "dataset_id", "book_id", "chapter_num", "verse_num").filter("verse_num > 0")
    keys = ["dataset_id", "book_id", "chapter_num"]
    g = t.groupBy(*keys, F.floor((F.col("verse_num") - 1) / 10).alias("run")).agg(F.min("verse_num").alias("from_verse"), F.max("verse_num").alias("to_verse"))
    m = J.members_in_range(t, g, keys, "verse_num", "from_verse", "to_verse")
    return m.select("script_id", "run", _long("from_verse"), _long("to_verse"))


def merge_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions merged by verse, with how many characters one is ahead (JOI-24)."""
    keys = ["pair_id", "book_id", "chapter_num"]
    base, comp = (d.groupBy(*keys, "verse_num").agg(F.sum(F.length("script_text")).alias("len")) for d in _versions(spark, sf_dir, "book_id", "chapter_num", "verse_num", "script_text"))
    m = J.running_offset(base, comp, keys, "verse_num", "len")
    return m.select("pair_id", "book_id", _long("chapter_num"), _long("verse_num"), "base_len", "comp_len", "offset")


def train_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines kept by pruning and without a long silence, with their words, shortest first (JOI-25, AGG-25)."""
    keep = pruned_lines(spark, sf_dir)
    w = tokens(spark, sf_dir, "script_id", "word_seq", "ttype", "word", "word_begin_ts").filter("ttype = 'W' and word is not null")
    t = lines(spark, sf_dir, "script_begin_ts", "script_end_ts").filter(known(F.col("script_end_ts")) & (F.col("script_end_ts") > F.col("script_begin_ts")) & ~F.isnan("script_begin_ts"))
    silent = w.join(t, "script_id").filter(F.col("word_begin_ts") - F.col("script_begin_ts") > 60).select("script_id").distinct()
    t = t.join(keep, "script_id", "left_semi").join(silent, "script_id", "left_anti")
    w = w.join(t, "script_id", "left_semi")
    text = w.groupBy("script_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_seq", "word_id", "word"))), lambda r: r["word"]), " ").alias("text"), F.count(F.lit(1)).alias("n_words"))
    return t.join(text, "script_id").select("script_id", to_ms(F.col("script_end_ts") - F.col("script_begin_ts")).alias("duration_ms"), "n_words", "text")


def word_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sample a timed word, with its reference (JOI-26)."""
    w = tokens(spark, sf_dir, "script_id", "word_seq", "ttype", "word", "word_begin_ts", "word_end_ts").filter(F.col("ttype") == "W").filter(known(F.col("word_end_ts")) & (F.col("word_end_ts") > F.col("word_begin_ts")))
    s = lines(spark, sf_dir, "book_id", "chapter_num", "verse_str")
    ref = F.concat(X.reference(F.col("book_id"), F.col("chapter_num"), F.col("verse_str")), F.lit("."), F.col("word_seq").cast("string"))
    return w.join(s, "script_id").select("word_id", ref.alias("reference"), "word", to_ms(F.col("word_end_ts") - F.col("word_begin_ts")).alias("duration_ms"))


def book_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books with lines but not in the list, and the reverse (JOI-29, SRC-26, AGG-33)."""
    have, want = lines(spark, sf_dir, "book_id").select("book_id").distinct(), table(spark, sf_dir, "books").select("book_id")
    return J.missing_from(have, want, ["book_id"]).withColumn("side", F.lit("not listed")).unionByName(J.missing_from(want, have, ["book_id"]).withColumn("side", F.lit("no lines")))


QUERIES = {
    f.__name__: f
    for f in (
        table_counts, chapters_first_seen, chapter_files, dataset_headers, heading_lines, spelled_words, last_line_by_number, word_log_scores, testament_lines, pruned_lines, line_states,
        line_word_char, word_with_line, word_letters, words_with_features, line_text_from_words, version_pairs, number_left_join, timestamp_misses, begin_differences, difference_rollup,
        nth_word, language_lookup, line_cues, range_members, merge_offsets, train_samples, word_samples, book_differences,
    )
}

_KNOWN = "{0} IS NOT NULL AND NOT isnan({0}) AND {0} <> 0"
_V = "v AS (SELECT *, ceil(dataset_id / 2)::BIGINT AS pair_id, dataset_id % 2 = 1 AS is_base FROM s)"
_KEEP = "keep AS (SELECT script_id, dataset_id FROM s WHERE verse_str <> '0' AND fa_score > 0.2 AND NOT isnan(fa_score) AND script_id NOT IN (SELECT script_id FROM w WHERE ttype = 'W' AND fa_score < 0.01 AND script_id IS NOT NULL))"
_MS = "CAST(floor(({0}) * 1000 + 0.5) AS BIGINT)"
_DIFF = f"""{_V}, a AS (SELECT pair_id, book_id, chapter_num, verse_num, arg_max({_MS.format('script_begin_ts')}, script_id) AS ms FROM v WHERE is_base AND script_begin_ts IS NOT NULL AND NOT isnan(script_begin_ts) GROUP BY ALL),
b AS (SELECT pair_id, book_id, chapter_num, verse_num, arg_max({_MS.format('script_begin_ts')}, script_id) AS ms FROM v WHERE NOT is_base AND script_begin_ts IS NOT NULL AND NOT isnan(script_begin_ts) GROUP BY ALL),
d AS (SELECT pair_id, book_id, chapter_num, verse_num, a.ms - b.ms AS diff_ms FROM a JOIN b USING (pair_id, book_id, chapter_num, verse_num))"""
ORACLE = {
    "table_counts": " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in ("ident", "books", "languages", "scripts", "words", "chars", "word_mfcc")),
    "chapters_first_seen": sql("SELECT dataset_id, book_id, chapter_num, min(script_id) AS first_line, row_number() OVER (PARTITION BY dataset_id ORDER BY min(script_id)) AS place FROM s GROUP BY dataset_id, book_id, chapter_num"),
    "chapter_files": sql("SELECT DISTINCT dataset_id, book_id, chapter_num, audio_file FROM s WHERE audio_file <> ''"),
    "dataset_headers": "SELECT dataset_id, " + ", ".join(f"coalesce({c}, '') AS {c}" for c in ("bible_id", "audio_ot_id", "audio_nt_id", "text_ot_id", "text_nt_id", "language_iso", "alphabet")) + ", coalesce(language_id, 0) AS language_id FROM ident",
    "heading_lines": sql("SELECT dataset_id, book_id, CASE usfm_style WHEN 'para.h' THEN 'chapter' ELSE 'book' END AS kind, CASE usfm_style WHEN 'para.h' THEN chapter_num ELSE 0 END AS chapter_num, count(*) AS n_lines, arg_max(script_text, script_id) AS title FROM s WHERE usfm_style IN ('para.h', 'para.mt', 'para.mt1', 'para.mt2', 'para.mt3') GROUP BY 1, 2, 3, 4"),
    "spelled_words": sql("SELECT DISTINCT lower(word) AS word, regexp_replace(lower(word), '(?s)(.)', '-\\1', 'g') AS deleted, regexp_replace(lower(word), '(?s)(.)', '+\\1', 'g') AS inserted FROM w WHERE ttype = 'W' AND word IS NOT NULL"),
    "last_line_by_number": sql("SELECT dataset_id, script_num, max(script_id) AS script_id, arg_max(verse_str, script_id) AS verse_str FROM s GROUP BY ALL"),
    "word_log_scores": sql("SELECT word_id, round(-log10(fa_score), 6) AS log_score FROM w WHERE ttype = 'W' AND fa_score > 0 AND NOT isnan(fa_score)"),
    "testament_lines": sql("SELECT script_id, dataset_id, book_id, chapter_num, verse_str, seq FROM s LEFT JOIN books USING (book_id) WHERE testament IS NULL OR testament = 'NT'"),
    "pruned_lines": sql("SELECT * FROM keep", _KEEP),
    "line_states": sql(f"SELECT dataset_id, CASE WHEN coalesce(verse_num > 0, false) THEN CASE WHEN {_KNOWN.format('script_end_ts')} THEN 'both' ELSE 'verse only' END WHEN {_KNOWN.format('script_end_ts')} THEN 'times only' ELSE 'neither' END AS state, count(*) AS n_lines FROM s GROUP BY ALL"),
    "line_word_char": sql("SELECT char_id, word_id, script_id, s.dataset_id, book_id, chapter_num, verse_str, word_seq, word, seq, start_ts, end_ts FROM c JOIN w USING (word_id) JOIN s USING (script_id) WHERE ttype = 'W'"),
    "word_with_line": sql("SELECT word_id, script_id, script_num, word, word_begin_ts, word_end_ts, w.fa_score, script_begin_ts, script_end_ts, s.fa_score AS line_score FROM w JOIN s USING (script_id) WHERE ttype = 'W'"),
    "word_letters": sql("SELECT dataset_id, letter, count(*) AS n FROM (SELECT s.dataset_id, unnest(string_split(lower(word), '')) AS letter FROM w JOIN s USING (script_id) WHERE ttype IN ('W', 'S') AND word <> '') GROUP BY ALL").replace("string_split(lower(word), '')", "regexp_extract_all(lower(word), '(?s).')"),
    "words_with_features": sql("SELECT word_id, script_id, coalesce(n_rows, 0) AS n_rows, coalesce(n_cols, 0) AS n_cols, coalesce(len(mfcc), 0) AS frames FROM w JOIN (SELECT script_id FROM s) USING (script_id) LEFT JOIN (SELECT word_id, n_rows, n_cols, mfcc FROM m) USING (word_id) WHERE ttype = 'W'"),
    "line_text_from_words": sql("SELECT script_id, script_text, coalesce(heard, '') AS heard FROM s LEFT JOIN (SELECT script_id, string_agg(coalesce(word, ''), '' ORDER BY word_seq, word_id) AS heard FROM w WHERE script_id IS NOT NULL GROUP BY script_id) USING (script_id)"),
    "version_pairs": sql(
        "SELECT pair_id, book_id, chapter_num, verse_str, a.script_id IS NOT NULL AS in_base, b.script_id IS NOT NULL AS in_comp, (CASE WHEN a.script_begin_ts <> 0 AND NOT isnan(a.script_begin_ts) THEN a.script_begin_ts WHEN b.script_begin_ts <> 0 AND NOT isnan(b.script_begin_ts) THEN b.script_begin_ts ELSE 0 END) AS begin_ts, coalesce(a.script_text, '') AS base_text, coalesce(b.script_text, '') AS comp_text FROM a FULL JOIN b USING (pair_id, book_id, chapter_num, verse_str)",
        _V + ", f AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY dataset_id, book_id, chapter_num, verse_str ORDER BY script_id) = 1), a AS (SELECT * FROM f WHERE is_base), b AS (SELECT * FROM f WHERE NOT is_base)",
    ),
    "number_left_join": sql("SELECT pair_id, script_num, script_id, coalesce(base_id, 0) AS base_id FROM (SELECT * FROM v WHERE NOT is_base AND audio_file <> '') LEFT JOIN (SELECT pair_id, script_num, max(script_id) AS base_id FROM v WHERE is_base GROUP BY ALL) USING (pair_id, script_num)", _V),
    "timestamp_misses": sql("SELECT pair_id, book_id, chapter_num, verse_str, script_id FROM v ANTI JOIN (SELECT pair_id, book_id, chapter_num, verse_str FROM v WHERE is_base) USING (pair_id, book_id, chapter_num, verse_str) WHERE NOT is_base", _V),
    "begin_differences": sql("SELECT * FROM d", _DIFF),
    "difference_rollup": sql("SELECT pair_id, book_id, chapter_num, grouping(pair_id, book_id, chapter_num) AS depth, count(*) AS n, round(avg(diff_ms), 6) AS mean_ms, round(stddev_samp(diff_ms), 6) AS stddev_ms FROM d GROUP BY ROLLUP (pair_id, book_id, chapter_num)", _DIFF),
    "nth_word": sql("SELECT script_id, word_id, word FROM w WHERE ttype = 'W' AND script_id IN (SELECT script_id FROM s WHERE dataset_id IN (SELECT dataset_id FROM run_settings)) QUALIFY row_number() OVER (PARTITION BY script_id ORDER BY word_seq, word_id) = 3"),
    "language_lookup": "SELECT dataset_id, language_iso AS code, coalesce(a.id, b.id) AS node_id, CASE WHEN a.id IS NOT NULL THEN 'iso639_3' WHEN b.id IS NOT NULL THEN 'iso639_1' END AS found_by FROM ident LEFT JOIN (SELECT iso639_3, min(id) AS id FROM languages WHERE iso639_3 <> '' GROUP BY ALL) a ON a.iso639_3 = language_iso LEFT JOIN (SELECT iso639_1, min(id) AS id FROM languages WHERE iso639_1 <> '' GROUP BY ALL) b ON b.iso639_1 = language_iso",
    "line_cues": sql(
        "SELECT script_id, coalesce(cue, -1) AS cue, coalesce(cue, last_value(cue IGNORE NULLS) OVER (PARTITION BY dataset_id, audio_file ORDER BY script_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), first_value(cue IGNORE NULLS) OVER (PARTITION BY dataset_id, audio_file ORDER BY script_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), -1) AS filled FROM t",
        f"q AS (SELECT script_id, min(word_begin_ts) AS cue FROM w WHERE ttype = 'W' AND {_KNOWN.format('word_begin_ts')} GROUP BY script_id), t AS (SELECT script_id, dataset_id, audio_file, cue FROM s LEFT JOIN q USING (script_id) WHERE audio_file <> '')",
    ),
    "range_members": sql("SELECT script_id, (verse_num - 1) // 10 AS run, min(verse_num) OVER g AS from_verse, max(verse_num) OVER g AS to_verse FROM s WHERE verse_num > 0 WINDOW g AS (PARTITION BY dataset_id, book_id, chapter_num, (verse_num - 1) // 10)"),
    "merge_offsets": sql(
        "SELECT pair_id, book_id, chapter_num, verse_num, base_len, comp_len, coalesce(sum(coalesce(comp_len, 0) - coalesce(base_len, 0)) OVER (PARTITION BY pair_id, book_id, chapter_num ORDER BY verse_num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS offset FROM a FULL JOIN b USING (pair_id, book_id, chapter_num, verse_num)",
        _V + ", a AS (SELECT pair_id, book_id, chapter_num, verse_num, sum(length(script_text))::BIGINT AS base_len FROM v WHERE is_base GROUP BY ALL), b AS (SELECT pair_id, book_id, chapter_num, verse_num, sum(length(script_text))::BIGINT AS comp_len FROM v WHERE NOT is_base GROUP BY ALL)",
    ).replace("AS offset", 'AS "offset"'),
    "train_samples": sql(
        f"SELECT script_id, {_MS.format('script_end_ts - script_begin_ts')} AS duration_ms, n_words, text FROM t JOIN (SELECT script_id, string_agg(word, ' ' ORDER BY word_seq, word_id) AS text, count(*) AS n_words FROM w WHERE ttype = 'W' AND word IS NOT NULL GROUP BY script_id) USING (script_id) WHERE script_id IN (SELECT script_id FROM keep) AND script_id NOT IN (SELECT script_id FROM w JOIN t USING (script_id) WHERE ttype = 'W' AND word IS NOT NULL AND word_begin_ts - script_begin_ts > 60)",
        _KEEP + f", t AS (SELECT script_id, script_begin_ts, script_end_ts FROM s WHERE {_KNOWN.format('script_end_ts')} AND script_end_ts > script_begin_ts AND NOT isnan(script_begin_ts))",
    ),
    "word_samples": sql(f"SELECT word_id, CASE WHEN coalesce(chapter_num, 0) = 0 THEN book_id WHEN coalesce(verse_str, '') = '' THEN book_id || ' ' || chapter_num ELSE book_id || ' ' || chapter_num || ':' || verse_str END || '.' || word_seq AS reference, word, {_MS.format('word_end_ts - word_begin_ts')} AS duration_ms FROM w JOIN s USING (script_id) WHERE ttype = 'W' AND {_KNOWN.format('word_end_ts')} AND word_end_ts > word_begin_ts"),
    "book_differences": sql("SELECT DISTINCT book_id, 'not listed' AS side FROM s ANTI JOIN books USING (book_id) UNION ALL SELECT book_id, 'no lines' FROM books ANTI JOIN s USING (book_id)"),
}
