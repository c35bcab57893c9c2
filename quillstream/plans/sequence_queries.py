"""Queries of aggregations, windows and sorts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstream.functions import text as X
from quillstream.functions.unicode import normal_form
from quillstream.model import duplicate_keys, features, known, letters, lines, tokens
from quillstream.operators import sequence as Q
from quillstream.operators import stats as S
from quillstream.operators.intervals import to_ms
from quillstream.operators.joins import line_word_char
from quillstream.operators.mutations import number_rows
from quillstream.plans.current_sql import sql
from quillstream.runtime import small_side, table

# Scores below these are critical or questionable.
CRITICAL, QUESTION = 0.0001, 0.001


def _long(name: str):
    return F.col(name).cast("long").alias(name)


def _six(c, name: str):
    return F.round(c, 6).alias(name)


def _char_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = letters(spark, sf_dir, "word_id", "fa_score").filter(F.col("fa_score").isNotNull() & ~F.isnan("fa_score"))
    return c.withColumn("log_score", F.when(F.col("fa_score") > 0, -F.log10("fa_score")))


def romanised_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a dataset's romanised text is complete enough (AGG-01)."""
    g = lines(spark, sf_dir, "dataset_id", "script_text", "uroman").groupBy("dataset_id").agg(F.sum(F.length("script_text")).alias("chars"), F.sum(F.length("uroman")).alias("roman"))
    return g.select("dataset_id", "chars", "roman", (F.col("roman") * 1.2 >= F.col("chars")).alias("complete"))


def score_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters by class of score (AGG-04)."""
    c = letters(spark, sf_dir, "fa_score").filter(F.col("fa_score").isNotNull() & ~F.isnan("fa_score"))
    kind = F.when(F.col("fa_score") <= CRITICAL, "critical").when(F.col("fa_score") <= QUESTION, "question").otherwise("good")
    return c.groupBy(kind.alias("score_class")).agg(F.count(F.lit(1)).alias("n"))


def score_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments of the letters' log scores (AGG-05, AGG-06)."""
    m = S.moments(_char_scores(spark, sf_dir).filter("log_score is not null"), [], "log_score")
    return m.select("n", *[_six(F.col(c), c) for c in ("mean", "stddev", "min", "max", "skew", "kurt")])


def score_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Empirical quantiles of words' scores by dataset (AGG-05, AGG-07)."""
    w = tokens(spark, sf_dir, "dataset_id", "fa_score").filter(F.col("fa_score").isNotNull() & ~F.isnan("fa_score") & (F.col("fa_score") > 0))
    q = S.quantiles(w, ["dataset_id"], "fa_score")
    return q.select("dataset_id", "p", "value")


def score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words by tenths of their log score (AGG-05)."""
    w = tokens(spark, sf_dir, "dataset_id", "fa_score").filter(F.col("fa_score").isNotNull() & ~F.isnan("fa_score") & (F.col("fa_score") > 0))
    h = S.histogram(w, ["dataset_id"], F.floor(F.round(-F.log10("fa_score"), 6) * 10))
    return h.select("dataset_id", "bucket", "n", _six(F.col("percent"), "percent"))


def feature_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature values as z-scores by coefficient over all frames (AGG-08)."""
    f = features(spark, sf_dir).select("word_id", F.posexplode("mfcc").alias("frame", "row")).select("word_id", "frame", F.posexplode("row").alias("coeff", "v"))
    f = f.withColumn("v", F.col("v").cast("double")).filter("v is not null")
    g = f.groupBy("coeff").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("dev"))
    z = f.join(F.broadcast(g), "coeff")  # a row a coefficient, no more than one matrix row has values
    return z.select("word_id", _long("frame"), _long("coeff"), _six((F.col("v") - F.col("mean")) / F.nullif("dev", F.lit(0.0)), "z"))


def padded_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matrices padded with zero rows to the longest: the sum must stay, the size be one (AGG-09, MTH-01, MTH-05)."""
    f = features(spark, sf_dir)
    longest = f.agg(F.coalesce(F.max("n_rows"), F.lit(0))).first()[0]
    zero = F.array_repeat(F.lit(0.0).cast("float"), F.col("n_cols"))
    p = f.withColumn("padded", F.concat("mfcc", F.array_repeat(zero, F.greatest(F.lit(longest) - F.col("n_rows"), F.lit(0)))))
    flat = F.aggregate(F.flatten("padded"), F.lit(0.0), lambda a, x: a + x)
    return p.select("word_id", F.size("padded").cast("long").alias("n_rows"), F.round(flat, 3).alias("total"))


def verse_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines put together from their words: begin, end, text, mean score (AGG-10, AGG-11)."""
    w = tokens(spark, sf_dir, "script_id", "word_seq", "ttype", "word", "word_begin_ts", "word_end_ts", "fa_score").filter("ttype = 'W' and word is not null")
    w = w.join(lines(spark, sf_dir, "dataset_id").select("script_id"), "script_id", "left_semi")  # ids of no line may be hot
    order = F.struct("word_seq", "word_id")
    score = F.when(~F.isnan("fa_score"), F.col("fa_score"))
    g = w.groupBy("script_id").agg(
        F.min_by("word_begin_ts", order).alias("b"), F.max_by("word_end_ts", order).alias("e"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_seq", "word_id", "word"))), lambda r: r["word"]), " ").alias("text"),
        F.avg(score).alias("score"),
    )
    return g.select("script_id", F.col("b").alias("begin_ts"), F.col("e").alias("end_ts"), "text", F.round("score", 9).alias("score"))


def word_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of aligned letters of one word within a word id's file order (AGG-12, AGG-13, WIN-03)."""
    c = letters(spark, sf_dir, "word_id", "uroman", "start_ts", "end_ts").join(tokens(spark, sf_dir, "ttype").select("word_id"), "word_id", "left_semi")
    before = F.lag("end_ts").over(W.partitionBy("word_id").orderBy("char_id"))
    i = S.islands(c, ["word_id"], ["char_id"], before.isNull() | (before < F.col("start_ts") - 0.0005))
    g = i.groupBy("word_id", "island").agg(F.min("char_id").alias("first_char"), F.count(F.lit(1)).alias("n"), F.min_by("start_ts", "char_id").alias("b"), F.max_by("end_ts", "char_id").alias("e"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("char_id", "uroman"))), lambda r: F.coalesce(r["uroman"], F.lit(""))), "").alias("text"))
    return g.select("word_id", "island", "first_char", "n", F.col("b").alias("begin_ts"), F.col("e").alias("end_ts"), "text")


def latin_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a dataset is written in Latin letters (AGG-16)."""
    return lines(spark, sf_dir, "dataset_id", "script_text").groupBy("dataset_id").agg(S.share_latin("script_text").alias("is_latin"))


def line_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of each line: that of its word with the most questionable letters (AGG-18, AGG-19)."""
    c = letters(spark, sf_dir, "word_id", "fa_score").filter(F.col("fa_score").isNotNull() & ~F.isnan("fa_score"))
    w = tokens(spark, sf_dir, "script_id", "ttype").filter("ttype = 'W' and script_id is not null")
    bad = (F.col("fa_score") <= 0.3) & (F.col("fa_score") > 0)
    g = c.join(w, "word_id").groupBy("script_id", "word_id").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(bad, 1)).alias("n_bad"), F.sum(F.when(bad, -F.log10("fa_score")).otherwise(0.0)).alias("s"))
    best = g.groupBy("script_id").agg(F.max_by(F.struct("word_id", "n_bad", (F.col("s") * F.when(F.col("n_bad") >= F.col("n"), 2).otherwise(1)).alias("score")), F.struct(F.col("n_bad"), -F.col("word_id"))).alias("b"))
    return best.select("script_id", "b.word_id", "b.n_bad", _six(F.col("b.score"), "score")).filter("score > 0")


def vocabulary_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct composed lower-case letters of words, numbered (AGG-23, AGG-26)."""
    w = tokens(spark, sf_dir, "dataset_id", "ttype", "word").filter("ttype = 'W' and word <> ''").select("dataset_id", F.explode(F.split(normal_form(F.lower("word")), "")).alias("letter")).distinct()
    return w.select("dataset_id", "letter", F.row_number().over(W.partitionBy("dataset_id").orderBy("letter")).cast("long").alias("id"))


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct words with their letters spelled out and counts (AGG-24, AGG-27)."""
    w = tokens(spark, sf_dir, "dataset_id", "ttype", "word").filter("ttype = 'W' and word <> ''").groupBy("dataset_id", F.lower("word").alias("word")).agg(F.count(F.lit(1)).alias("n"))
    return w.select("dataset_id", "word", "n", F.concat(X.spaced(F.regexp_replace("word", "-", "")), F.lit(" |")).alias("spelling"))


def letter_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters beyond ASCII in all documents (AGG-28)."""
    c = table(spark, sf_dir, "documents").filter("text <> ''").select(F.explode(F.split(F.regexp_replace("text", r"[\x00-\x7F]", ""), "")).alias("letter")).filter("letter <> ''")
    return c.groupBy("letter").agg(F.count(F.lit(1)).alias("n"))


def tool_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages each tool knows, with percent (AGG-29, GRF-05)."""
    tools = ("espeak", "mms_asr", "mms_lid", "mms_tts", "whisper")
    t = table(spark, sf_dir, "languages").filter("iso639_3 <> ''").select("id", F.explode(F.create_map(*[x for n in tools for x in (F.lit(n), F.col(n))])).alias("tool", "code"))
    g = t.groupBy("tool").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("code") != "", 1)).alias("n_known"))
    return g.select("tool", "n", "n_known", _six(F.col("n_known") * 100.0 / F.col("n"), "percent"))


def marker_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines grouped from one heading to the next: last verse, last end, characters (AGG-30, AGG-31)."""
    t = lines(spark, sf_dir, "dataset_id", "book_id", "verse_str", "verse_num", "script_text")
    i = S.islands(t, ["dataset_id", "book_id"], ["script_id"], F.col("verse_str").eqNullSafe("0"))
    g = i.groupBy("dataset_id", "book_id", "island").agg(F.min("script_id").alias("first_line"), F.count(F.lit(1)).alias("n_lines"), F.max_by("verse_num", "script_id").cast("long").alias("last_verse"), F.sum(F.octet_length("script_text")).alias("n_bytes"))
    return g


def code_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At which place of recordings' names a known book code occurs, by how often (AGG-32)."""
    names = lines(spark, sf_dir, "audio_file").select("audio_file").filter("audio_file <> ''").distinct()
    at = names.select("audio_file", F.explode(F.sequence(F.lit(1), F.greatest(F.length("audio_file") - 2, F.lit(1)))).alias("pos"))
    cut = at.select(_long("pos"), F.substring("audio_file", F.col("pos"), F.lit(3)).alias("book_id")).join(small_side(table(spark, sf_dir, "books").select("book_id")), "book_id", "left_semi")
    return cut.groupBy("pos").agg(F.count(F.lit(1)).alias("n"))


def _char_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = lines(spark, sf_dir, "dataset_id", "book_id", "chapter_num", "verse_str", "audio_file", "script_end_ts")
    total = s.filter(~F.isnan("script_end_ts")).groupBy("dataset_id", "audio_file").agg(F.max("script_end_ts").alias("total"))
    u = line_word_char(s, tokens(spark, sf_dir, "script_id", "word_seq", "ttype", "word"), letters(spark, sf_dir)).filter("audio_file <> ''").join(total, ["dataset_id", "audio_file"])
    g = Q.unit_gaps(u, ["dataset_id", "audio_file"], "char_id", "start_ts", "end_ts", "word_id", "script_id", "total")
    return g.withColumn("silence", F.round("silence", 6))


def char_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silence after each aligned letter and its class (WIN-01)."""
    return _char_gaps(spark, sf_dir).select("char_id", _long("gap_class"), "silence")


def gap_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silences at or above mean + 2 deviations of their class (1 at the end of a file) (WIN-02, AGG-02, AGG-03)."""
    g = _char_gaps(spark, sf_dir)
    return Q.long_gaps(g, Q.gap_limits(g, {4: 1.0}, 2.0)).select("char_id", _long("gap_class"), "silence")


def long_silences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silences at or above mean + 4 deviations of their class (3 at the end of a file), the reference's limits (WIN-02, AGG-02, AGG-03)."""
    g = _char_gaps(spark, sf_dir)
    return Q.long_gaps(g, Q.gap_limits(g, {4: 3.0}, 4.0)).select("char_id", _long("gap_class"), "silence")


def _word_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = lines(spark, sf_dir, "dataset_id", "book_id", "chapter_num", "script_end_ts").filter(known(F.col("script_end_ts")))
    w = tokens(spark, sf_dir, "script_id", "ttype", "word_begin_ts", "word_end_ts").filter((F.col("ttype") == "W") & (F.col("word_end_ts") >= 0) & (F.col("word_begin_ts") >= 0) & ~F.isnan("word_end_ts") & ~F.isnan("word_begin_ts")).join(s, "script_id")
    keys = ["dataset_id", "book_id", "chapter_num"]
    nxt = F.lead("word_begin_ts").over(W.partitionBy(*keys).orderBy("word_id"))
    ms = to_ms(F.coalesce(nxt, F.col("script_end_ts"))) - to_ms(F.col("word_end_ts"))
    return Q.cascade_gaps(w.withColumn("silence_ms", ms), keys, "word_id", "script_id", "silence_ms")


def word_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silence after each word, and with what is passed on at line ends (WIN-04, WIN-05)."""
    return _word_gaps(spark, sf_dir).select("word_id", "script_id", "silence_ms", "raised")


def widest_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 400 lines with the widest silence (AGG-14, SRT-01, DML-13)."""
    g = Q.widest_by_line(_word_gaps(spark, sf_dir), "script_id", "word_id", "raised")
    return g.orderBy(F.desc("raised"), "script_id").limit(400)


def midpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines' times with gaps closed in the middle (WIN-07)."""
    t = lines(spark, sf_dir, "dataset_id", "audio_file", "script_begin_ts", "script_end_ts").filter("audio_file <> ''").filter(known(F.col("script_end_ts")) & F.col("script_begin_ts").isNotNull() & ~F.isnan("script_begin_ts"))
    total = F.max("script_end_ts").over(W.partitionBy("dataset_id", "audio_file"))
    m = Q.midpoints(t.withColumn("total", total), ["dataset_id", "audio_file"], ["script_begin_ts", "script_id"], "script_begin_ts", "script_end_ts", "total")
    return m.select("script_id", _six(F.col("mid_begin"), "mid_begin"), _six(F.col("mid_end"), "mid_end"))


def next_begins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines' ends as the begin of the next line of the chapter (WIN-08, JOI-15)."""
    t = lines(spark, sf_dir, "dataset_id", "book_id", "chapter_num", "script_begin_ts").filter(F.col("script_begin_ts").isNotNull() & ~F.isnan("script_begin_ts"))
    return t.select("script_id", Q.next_begin(t, ["dataset_id", "book_id", "chapter_num"], ["script_id"], "script_begin_ts").alias("end_ts"))


def feature_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of the first half of each word's matrix at its own frame rate (WIN-09, SRC-19)."""
    w = tokens(spark, sf_dir, "word_begin_ts", "word_end_ts").filter(known(F.col("word_end_ts")) & (F.col("word_end_ts") > F.col("word_begin_ts")))
    half = F.round((F.col("word_end_ts") - F.col("word_begin_ts")) / 2, 3)
    f = features(spark, sf_dir).join(w, "word_id").withColumn("part", Q.frame_slice(F.col("mfcc"), F.lit(0.0), half, 20.0))
    total = F.aggregate(F.flatten("part"), F.lit(0).cast("long"), lambda a, x: a + F.floor(x.cast("double") * 1000))
    return f.select("word_id", F.size("part").cast("long").alias("n_frames"), total.alias("total"))


def headed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with title and heading rows put in, numbered anew (WIN-10..12)."""
    t = lines(spark, sf_dir, "dataset_id", "book_id", "chapter_num")
    h = Q.with_headings(t, ["dataset_id", "book_id"], "chapter_num", "script_id")
    return h.select("dataset_id", "book_id", _long("chapter_num"), "script_id", "kind", _long("line_no"))


def unique_verses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verse names with a suffix for repeats within a chapter (WIN-13, WIN-14)."""
    t = lines(spark, sf_dir, "dataset_id", "book_id", "chapter_num", "verse_num").withColumn("name", F.floor((F.col("verse_num") + 2) / 3).cast("string"))
    return Q.unique_suffix(t, ["dataset_id", "book_id", "chapter_num"], "name", ["script_id"]).select("script_id", "name", "unique_name")


def duplicate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that aren't unique in all versions of lines (WIN-16)."""
    d = duplicate_keys(table(spark, sf_dir, "scripts"), ["dataset_id", "book_id", "chapter_num", "verse_str"])
    return d.select("dataset_id", "book_id", _long("chapter_num"), "verse_str", "n_rows")


def greedy_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training samples in batches by size (WIN-17, JOI-27, UDF-19)."""
    t = lines(spark, sf_dir, "dataset_id", "script_begin_ts", "script_end_ts").withColumn("ms", to_ms(F.col("script_end_ts")) - to_ms(F.col("script_begin_ts"))).filter("ms > 0")
    return Q.greedy_batches(t, ["dataset_id"], "ms", ["script_id"], 8, 60_000).select("dataset_id", "script_id", "ms", "batch")


def batch_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of each batch when its members are padded to the longest (JOI-27, MTH-04, MTH-05)."""
    return greedy_batches(spark, sf_dir).groupBy("dataset_id", "batch").agg(F.count(F.lit(1)).alias("n"), (F.max("ms") * F.count(F.lit(1))).alias("padded_ms"), F.sum("ms").alias("total_ms"))


def word_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word samples over their dataset's cutoff in batches by duration, for the model of words (UDF-20, PRJ-24)."""
    w = tokens(spark, sf_dir, "dataset_id", "ttype", "fa_score", "word_begin_ts", "word_end_ts").filter((F.col("ttype") == "W") & F.col("fa_score").isNotNull() & ~F.isnan("fa_score"))
    cut = S.quantiles(w, ["dataset_id"], "fa_score", [0.1]).select("dataset_id", F.col("value").alias("cutoff"))
    t = w.join(cut, "dataset_id").filter(F.col("fa_score") > F.col("cutoff")).withColumn("ms", to_ms(F.col("word_end_ts")) - to_ms(F.col("word_begin_ts"))).filter("ms > 0")
    return Q.greedy_batches(t, ["dataset_id"], "ms", ["word_id"], 32, 8_000).select("dataset_id", "word_id", "ms", "batch")


def canonical_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in the order of books, chapters and verses (SRT-03, SET-01, SET-02)."""
    b = small_side(table(spark, sf_dir, "books").select("book_id", "seq", "testament"))
    t = lines(spark, sf_dir, "dataset_id", "book_id", "chapter_num", "verse_num").join(b, "book_id", "left")
    # One range sort over all datasets, as a dataset may have a third of the lines.
    n = number_rows(t, "n", ["dataset_id", "seq", "chapter_num", "verse_num", "script_id"])
    first = n.groupBy("dataset_id").agg(F.min("n").alias("first"))
    n = n.join(first, "dataset_id")
    return n.select("script_id", "dataset_id", F.coalesce("testament", F.lit("AP")).alias("testament"), (F.col("n") - F.col("first") + 1).alias("place"))


def chapter_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters before each book of its testament (SRC-22)."""
    w = W.partitionBy("testament").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    return table(spark, sf_dir, "books").select("book_id", "testament", _long("seq"), F.coalesce(F.sum("chapters").over(w), F.lit(0)).alias("chapters_before"))


def invalid_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with their length, norm and whether they are fit for use (MTH-01, MTH-06, SNK-06)."""
    e = table(spark, sf_dir, "embeddings")
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x)) | (F.size("embedding") == 0)
    norm = F.aggregate(F.transform("embedding", lambda x: x.cast("double")), F.lit(0.0), lambda a, x: a + x * x)
    return e.select("vec_id", F.size("embedding").cast("long").alias("width"), bad.alias("bad"), F.round(norm, 4).alias("square"))


def cutoff_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words over the score at a tenth of their dataset's sorted scores (SRT-04, PRJ-24)."""
    w = tokens(spark, sf_dir, "dataset_id", "ttype", "fa_score").filter((F.col("ttype") == "W") & F.col("fa_score").isNotNull() & ~F.isnan("fa_score"))
    cut = S.quantiles(w, ["dataset_id"], "fa_score", [0.1]).select("dataset_id", F.col("value").alias("cutoff"))
    return w.join(cut, "dataset_id").filter(F.col("fa_score") > F.col("cutoff")).groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n"), F.first("cutoff").alias("cutoff"))


QUERIES = {
    f.__name__: f
    for f in (
        romanised_share, score_classes, score_stats, score_quantiles, score_histogram, feature_frames, padded_features, verse_assembly, word_islands, latin_datasets, line_scores,
        vocabulary_letters, lexicon, letter_histogram, tool_coverage, marker_groups, code_positions, char_gaps, gap_outliers, long_silences, word_gaps, widest_gaps, midpoints, next_begins,
        feature_slices, headed_lines, unique_verses, duplicate_lines, greedy_batches, batch_sizes, word_batches, canonical_order, chapter_sequence, invalid_vectors, cutoff_samples,
    )
}

_MS = "CAST(floor(({0}) * 1000 + 0.5) AS BIGINT)"
_OK = "{0} IS NOT NULL AND NOT isnan({0})"
_BATCHES = f"""r AS (SELECT dataset_id, script_id, ms, row_number() OVER (PARTITION BY dataset_id ORDER BY ms, script_id) AS i FROM (SELECT dataset_id, script_id, {_MS.format('script_end_ts')} - {_MS.format('script_begin_ts')} AS ms FROM s WHERE {_OK.format('script_end_ts')} AND {_OK.format('script_begin_ts')}) WHERE ms > 0),
b AS (SELECT dataset_id, script_id, ms, i, 1::BIGINT AS batch, 1::BIGINT AS n FROM r WHERE i = 1
  UNION ALL
  SELECT r.dataset_id, r.script_id, r.ms, r.i, CASE WHEN b.n >= 8 OR r.ms * (b.n + 1) >= 60000 THEN b.batch + 1 ELSE b.batch END, CASE WHEN b.n >= 8 OR r.ms * (b.n + 1) >= 60000 THEN 1 ELSE b.n + 1 END FROM b JOIN r ON r.dataset_id = b.dataset_id AND r.i = b.i + 1)"""
_WORD_BATCHES = f"""d AS (SELECT dataset_id, word_id, word_begin_ts, word_end_ts, fa_score, row_number() OVER (PARTITION BY dataset_id ORDER BY fa_score) AS upto, count(*) OVER (PARTITION BY dataset_id) AS total FROM w WHERE ttype = 'W' AND fa_score IS NOT NULL AND NOT isnan(fa_score)),
k AS (SELECT dataset_id, min(fa_score) AS cutoff FROM d WHERE upto >= ceil(0.1::DOUBLE * total) GROUP BY dataset_id),
r AS (SELECT dataset_id, word_id, ms, row_number() OVER (PARTITION BY dataset_id ORDER BY ms, word_id) AS i FROM (SELECT dataset_id, word_id, {_MS.format('word_end_ts')} - {_MS.format('word_begin_ts')} AS ms FROM d JOIN k USING (dataset_id) WHERE fa_score > cutoff AND {_OK.format('word_end_ts')} AND {_OK.format('word_begin_ts')}) WHERE ms > 0),
b AS (SELECT dataset_id, word_id, ms, i, 1::BIGINT AS batch, 1::BIGINT AS n FROM r WHERE i = 1
  UNION ALL
  SELECT r.dataset_id, r.word_id, r.ms, r.i, CASE WHEN b.n >= 32 OR r.ms * (b.n + 1) >= 8000 THEN b.batch + 1 ELSE b.batch END, CASE WHEN b.n >= 32 OR r.ms * (b.n + 1) >= 8000 THEN 1 ELSE b.n + 1 END FROM b JOIN r ON r.dataset_id = b.dataset_id AND r.i = b.i + 1)"""
_QL = "(" + ", ".join(f"({float(p)}::DOUBLE)" for p in S.QUANTILES) + ")"
_GAPS = f"""u AS (SELECT char_id, word_id, script_id, s.dataset_id, audio_file, start_ts, end_ts FROM c JOIN w USING (word_id) JOIN s USING (script_id) WHERE ttype = 'W' AND audio_file <> ''),
t AS (SELECT dataset_id, audio_file, max(script_end_ts) AS total FROM s WHERE {_OK.format('script_end_ts')} GROUP BY ALL),
g AS (SELECT char_id, CASE WHEN lead(char_id) OVER o IS NULL THEN 4 WHEN lead(word_id) OVER o = word_id THEN 1 WHEN lead(script_id) OVER o = script_id THEN 2 ELSE 3 END AS gap_class, lead(start_ts) OVER o AS nxt, end_ts, total FROM u JOIN t USING (dataset_id, audio_file) WINDOW o AS (PARTITION BY dataset_id, audio_file ORDER BY char_id)),
h AS (SELECT char_id, gap_class, round(CASE gap_class WHEN 4 THEN total ELSE nxt END - end_ts, 6) AS silence FROM g)"""
_WGAPS = f"""u AS (SELECT word_id, script_id, s.dataset_id, book_id, chapter_num, word_begin_ts, word_end_ts, script_end_ts FROM w JOIN s USING (script_id) WHERE ttype = 'W' AND {_OK.format('word_begin_ts')} AND {_OK.format('word_end_ts')} AND {_OK.format('script_end_ts')} AND script_end_ts <> 0),
g AS (SELECT *, {_MS.format('coalesce(lead(word_begin_ts) OVER o, script_end_ts)')} - {_MS.format('word_end_ts')} AS silence_ms, coalesce(lag(script_id) OVER o <> script_id, true) AS starts FROM u WINDOW o AS (PARTITION BY dataset_id, book_id, chapter_num ORDER BY word_id)),
r AS (SELECT *, sum(CASE WHEN starts THEN 0 ELSE 1 END) OVER (PARTITION BY dataset_id, book_id, chapter_num ORDER BY word_id ROWS UNBOUNDED PRECEDING) AS run FROM g),
q AS (SELECT word_id, script_id, silence_ms, max(silence_ms) OVER (PARTITION BY dataset_id, book_id, chapter_num, run ORDER BY word_id ROWS UNBOUNDED PRECEDING) AS raised FROM r)"""
ORACLE = {
    "romanised_share": sql("SELECT dataset_id, sum(length(script_text))::BIGINT AS chars, sum(length(uroman))::BIGINT AS roman, sum(length(uroman)) * 1.2 >= sum(length(script_text)) AS complete FROM s GROUP BY dataset_id"),
    "score_classes": sql(f"SELECT CASE WHEN fa_score <= 0.0001 THEN 'critical' WHEN fa_score <= 0.001 THEN 'question' ELSE 'good' END AS score_class, count(*) AS n FROM c WHERE {_OK.format('fa_score')} GROUP BY ALL"),
    "score_stats": sql("SELECT count(*) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS stddev, round(min(x), 6) AS min, round(max(x), 6) AS max, round(skewness(x), 6) AS skew, round(kurtosis(x), 6) AS kurt FROM (SELECT -log10(fa_score) AS x FROM c WHERE fa_score > 0 AND NOT isnan(fa_score))"),
    "score_quantiles": sql(f"SELECT dataset_id, p, min(x) AS value FROM d, (VALUES {_QL[1:-1]}) AS v(p) WHERE upto >= ceil(p * total) GROUP BY dataset_id, p", "d AS (SELECT dataset_id, fa_score AS x, row_number() OVER (PARTITION BY dataset_id ORDER BY fa_score) AS upto, count(*) OVER (PARTITION BY dataset_id) AS total FROM w WHERE fa_score > 0 AND NOT isnan(fa_score))"),
    "score_histogram": sql("SELECT dataset_id, floor(round(-log10(fa_score), 6) * 10)::BIGINT AS bucket, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY dataset_id), 6) AS percent FROM w WHERE fa_score > 0 AND NOT isnan(fa_score) GROUP BY 1, 2"),
    "feature_frames": sql("SELECT word_id, frame - 1 AS frame, coeff - 1 AS coeff, round((v - avg(v) OVER (PARTITION BY coeff)) / nullif(stddev_pop(v) OVER (PARTITION BY coeff), 0), 6) AS z FROM (SELECT word_id, frame, unnest(r)::DOUBLE AS v, generate_subscripts(r, 1) AS coeff FROM (SELECT word_id, unnest(mfcc) AS r, generate_subscripts(mfcc, 1) AS frame FROM m)) WHERE v IS NOT NULL"),
    "padded_features": sql("SELECT word_id, greatest((SELECT max(n_rows) FROM m), len(mfcc))::BIGINT AS n_rows, round(coalesce(list_sum(list_transform(flatten(mfcc), lambda x: x::DOUBLE)), 0), 3) AS total FROM m"),
    "verse_assembly": sql("SELECT script_id, nullif(arg_min(coalesce(word_begin_ts, -1), struct_pack(a := word_seq, b := word_id)), -1) AS begin_ts, nullif(arg_max(coalesce(word_end_ts, -1), struct_pack(a := word_seq, b := word_id)), -1) AS end_ts, string_agg(word, ' ' ORDER BY word_seq, word_id) AS text, round(avg(CASE WHEN NOT isnan(fa_score) THEN fa_score END), 9) AS score FROM w WHERE ttype = 'W' AND script_id IN (SELECT script_id FROM s) AND word IS NOT NULL GROUP BY script_id"),
    "word_islands": sql("SELECT word_id, island, min(char_id) AS first_char, count(*) AS n, arg_min(start_ts, char_id) AS begin_ts, arg_max(end_ts, char_id) AS end_ts, string_agg(coalesce(uroman, ''), '' ORDER BY char_id) AS text FROM (SELECT *, sum(CASE WHEN prev IS NULL OR prev < start_ts - 0.0005 THEN 1 ELSE 0 END) OVER (PARTITION BY word_id ORDER BY char_id ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM (SELECT *, lag(end_ts) OVER (PARTITION BY word_id ORDER BY char_id) AS prev FROM c WHERE word_id IN (SELECT word_id FROM w))) GROUP BY word_id, island"),
    "latin_datasets": sql(r"SELECT dataset_id, coalesce(sum(length(regexp_replace(script_text, '[^\x{0000}-\x{024F}]', '', 'g'))) / nullif(sum(length(script_text)), 0) > 0.9, false) AS is_latin FROM s GROUP BY dataset_id"),
    "line_scores": sql("SELECT * FROM (SELECT script_id, arg_max(word_id, o) AS word_id, arg_max(n_bad, o) AS n_bad, round(arg_max(x * CASE WHEN n_bad >= n THEN 2 ELSE 1 END, o), 6) AS score FROM (SELECT *, struct_pack(a := n_bad, b := -word_id) AS o FROM (SELECT script_id, word_id, count(*) AS n, count(*) FILTER (c.fa_score <= 0.3 AND c.fa_score > 0) AS n_bad, sum(CASE WHEN c.fa_score <= 0.3 AND c.fa_score > 0 THEN -log10(c.fa_score) ELSE 0 END) AS x FROM c JOIN w USING (word_id) WHERE ttype = 'W' AND script_id IS NOT NULL AND c.fa_score IS NOT NULL AND NOT isnan(c.fa_score) GROUP BY script_id, word_id)) GROUP BY script_id) WHERE score > 0"),
    "vocabulary_letters": sql("SELECT dataset_id, letter, row_number() OVER (PARTITION BY dataset_id ORDER BY letter) AS id FROM (SELECT DISTINCT dataset_id, unnest(regexp_extract_all(nfc_normalize(lower(word)), '(?s).')) AS letter FROM w WHERE ttype = 'W' AND word <> '')"),
    "lexicon": sql("SELECT dataset_id, lower(word) AS word, count(*) AS n, array_to_string(regexp_extract_all(replace(lower(word), '-', ''), '(?s).'), ' ') || ' |' AS spelling FROM w WHERE ttype = 'W' AND word <> '' GROUP BY 1, 2"),
    "letter_histogram": r"SELECT letter, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[^\x00-\x7F]')) AS letter FROM documents) GROUP BY letter",
    "tool_coverage": "SELECT tool, count(*) AS n, count(*) FILTER (code <> '') AS n_known, round(count(*) FILTER (code <> '') * 100.0::DOUBLE / count(*), 6) AS percent FROM (UNPIVOT (SELECT id, espeak, mms_asr, mms_lid, mms_tts, whisper FROM languages WHERE iso639_3 <> '') ON espeak, mms_asr, mms_lid, mms_tts, whisper INTO NAME tool VALUE code) GROUP BY tool",
    "marker_groups": sql("SELECT dataset_id, book_id, island, min(script_id) AS first_line, count(*) AS n_lines, arg_max(verse_num, script_id)::BIGINT AS last_verse, sum(strlen(script_text))::BIGINT AS n_bytes FROM (SELECT *, sum(CASE WHEN verse_str IS NOT DISTINCT FROM '0' THEN 1 ELSE 0 END) OVER (PARTITION BY dataset_id, book_id ORDER BY script_id ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM s) GROUP BY dataset_id, book_id, island"),
    "code_positions": sql("SELECT pos, count(*) AS n FROM (SELECT substr(audio_file, pos, 3) AS book_id, pos FROM (SELECT audio_file, unnest(range(1, greatest(length(audio_file) - 1, 2))) AS pos FROM (SELECT DISTINCT audio_file FROM s WHERE audio_file <> ''))) SEMI JOIN books USING (book_id) GROUP BY pos"),
    "char_gaps": sql("SELECT char_id, gap_class, silence FROM h", _GAPS),
    "gap_outliers": sql("SELECT char_id, gap_class, silence FROM h JOIN l USING (gap_class) WHERE silence >= gap_limit", _GAPS + ", l AS (SELECT gap_class, avg(silence) + CASE gap_class WHEN 4 THEN 1 ELSE 2 END * stddev_samp(silence) AS gap_limit FROM h GROUP BY gap_class)"),
    "long_silences": sql("SELECT char_id, gap_class, silence FROM h JOIN l USING (gap_class) WHERE silence >= gap_limit", _GAPS + ", l AS (SELECT gap_class, avg(silence) + CASE gap_class WHEN 4 THEN 3 ELSE 4 END * stddev_samp(silence) AS gap_limit FROM h GROUP BY gap_class)"),
    "word_gaps": sql("SELECT * FROM q", _WGAPS),
    "widest_gaps": sql("SELECT script_id, arg_max(word_id, struct_pack(a := raised, b := -word_id)) AS word_id, max(raised) AS raised FROM q GROUP BY script_id ORDER BY raised DESC, script_id LIMIT 400", _WGAPS),
    "midpoints": sql(f"SELECT script_id, round(coalesce((script_begin_ts + lag(script_end_ts) OVER o) / 2, 0), 6) AS mid_begin, round(coalesce((lead(script_begin_ts) OVER o + script_end_ts) / 2, max(script_end_ts) OVER (PARTITION BY dataset_id, audio_file)), 6) AS mid_end FROM s WHERE audio_file <> '' AND {_OK.format('script_end_ts')} AND script_end_ts <> 0 AND {_OK.format('script_begin_ts')} WINDOW o AS (PARTITION BY dataset_id, audio_file ORDER BY script_begin_ts, script_id)"),
    "next_begins": sql(f"SELECT script_id, coalesce(lead(script_begin_ts) OVER (PARTITION BY dataset_id, book_id, chapter_num ORDER BY script_id), 0) AS end_ts FROM s WHERE {_OK.format('script_begin_ts')}"),
    "feature_slices": sql(f"SELECT word_id, n_frames, coalesce(list_sum(list_transform(flatten(mfcc[1:n_frames]), lambda x: floor(x::DOUBLE * 1000))), 0)::BIGINT AS total FROM (SELECT word_id, mfcc, least(len(mfcc), greatest(floor(round((word_end_ts - word_begin_ts) / 2, 3) * 20 + 0.5), 0))::BIGINT AS n_frames FROM m JOIN w USING (word_id) WHERE {_OK.format('word_end_ts')} AND word_end_ts > word_begin_ts AND round((word_end_ts - word_begin_ts) / 2, 3) <> 0)"),
    "headed_lines": sql(
        "SELECT dataset_id, book_id, chapter_num, script_id, kind, row_number() OVER (PARTITION BY dataset_id, book_id ORDER BY script_id, rank) AS line_no FROM (SELECT dataset_id, book_id, chapter_num, script_id, 2 AS rank, 'line' AS kind FROM p UNION ALL SELECT dataset_id, book_id, chapter_num, script_id, 0, 'title' FROM p WHERE prev IS NULL UNION ALL SELECT dataset_id, book_id, chapter_num, script_id, 1, 'heading' FROM p WHERE coalesce(prev, 1) <> chapter_num)",
        "p AS (SELECT *, lag(chapter_num) OVER (PARTITION BY dataset_id, book_id ORDER BY script_id) AS prev FROM s)",
    ),
    "unique_verses": sql("SELECT script_id, name, CASE WHEN n = 1 THEN name WHEN n <= 27 THEN name || chr((95 + n)::INT) END AS unique_name FROM (SELECT script_id, name, row_number() OVER (PARTITION BY dataset_id, book_id, chapter_num, name ORDER BY script_id) AS n FROM (SELECT *, floor((verse_num + 2) / 3)::BIGINT::VARCHAR AS name FROM s))"),
    "duplicate_lines": "SELECT dataset_id, book_id, chapter_num, verse_str, count(*) AS n_rows FROM scripts GROUP BY ALL HAVING count(*) > 1",
    "word_batches": sql("SELECT dataset_id, word_id, ms, batch FROM b", _WORD_BATCHES).replace("WITH", "WITH RECURSIVE", 1),
    "greedy_batches": sql("SELECT dataset_id, script_id, ms, batch FROM b", _BATCHES).replace("WITH", "WITH RECURSIVE", 1),
    "batch_sizes": sql("SELECT dataset_id, batch, count(*) AS n, max(ms) * count(*) AS padded_ms, sum(ms)::BIGINT AS total_ms FROM b GROUP BY dataset_id, batch", _BATCHES).replace("WITH", "WITH RECURSIVE", 1),
    "canonical_order": sql("SELECT script_id, dataset_id, coalesce(testament, 'AP') AS testament, row_number() OVER (PARTITION BY dataset_id ORDER BY seq NULLS FIRST, chapter_num NULLS FIRST, verse_num NULLS FIRST, script_id) AS place FROM s LEFT JOIN books USING (book_id)"),
    "chapter_sequence": "SELECT book_id, testament, seq, coalesce(sum(chapters) OVER (PARTITION BY testament ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS chapters_before FROM books",
    "invalid_vectors": "SELECT vec_id, len(embedding) AS width, len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) > 0 OR len(embedding) = 0 AS bad, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 4) AS square FROM embeddings",
    "cutoff_samples": sql("SELECT dataset_id, count(*) AS n, any_value(cutoff) AS cutoff FROM d JOIN k USING (dataset_id) WHERE fa_score > cutoff GROUP BY dataset_id", "d AS (SELECT dataset_id, fa_score, row_number() OVER (PARTITION BY dataset_id ORDER BY fa_score) AS upto, count(*) OVER (PARTITION BY dataset_id) AS total FROM w WHERE ttype = 'W' AND fa_score IS NOT NULL AND NOT isnan(fa_score)), k AS (SELECT dataset_id, min(fa_score) AS cutoff FROM d WHERE upto >= ceil(0.1::DOUBLE * total) GROUP BY dataset_id)"),
}
