"""Queries of projections, small functions, splicing, decoding, table changes, requests and runs."""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.functions import normalise as N
from quillstream.functions import text as X
from quillstream.model import features, letters, lines, tokens
from quillstream.operators import alignment as A
from quillstream.operators import graph as G
from quillstream.operators import mutations as M
from quillstream.operators import sequence as Q
from quillstream.operators.embed import word_vectors
from quillstream.operators.program import answered_batches, answered_lines
from quillstream.operators.splice import clean_diffs, spliced
from quillstream.plans import pipeline as P
from quillstream.plans import request as R
from quillstream.plans.current_sql import sql
from quillstream.runtime import Workspace, table
from quillstream.sinks.writers import write_table
from quillstream.sources.readers import named_books
from quillstream.streaming.queue import serve

CHAPTER = ["dataset_id", "book_id", "chapter_num"]


def _long(*names: str) -> list[Column]:
    return [F.col(n).cast("long").alias(n) for n in names]


def program_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every romanised line asked of a running program, and in batches, both of which answer in capitals (UDF-01..03, STR-24)."""
    t = lines(spark, sf_dir, "uroman").filter("regexp_like(uroman, '^[a-z ]+$')")
    command = [sys.executable, "-uc", "import sys\nfor x in sys.stdin: print(x.rstrip(chr(10)).upper(), flush=True)"]
    return answered_batches(answered_lines(t, "uroman", command), "uroman", command, "in_batch").select("script_id", "answer", "in_batch")


def refused_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verse names that occur more often in a book of a version than letters can tell apart (WIN-13)."""
    t = lines(spark, sf_dir, "dataset_id", "verse_str")
    return Q.refused_names(Q.unique_suffix(t, ["dataset_id"], "verse_str", ["script_id"]), ["dataset_id"], "verse_str")


def line_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text column by key (PRJ-06)."""
    return lines(spark, sf_dir, "uroman").select("script_id", "uroman")


def line_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of lines (PRJ-10)."""
    return lines(spark, sf_dir, *CHAPTER, "verse_str").select("script_id", "dataset_id", "book_id", *_long("chapter_num"), "verse_str")


def alignment_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an aligner needs of each chapter's lines (PRJ-11)."""
    return lines(spark, sf_dir, *CHAPTER, "verse_str", "audio_file", "script_text").filter("audio_file <> ''").select("script_id", "book_id", *_long("chapter_num"), "verse_str", "audio_file", "script_text")


def chapter_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of each chapter's verses (PRJ-12)."""
    return lines(spark, sf_dir, *CHAPTER, "verse_str", "script_begin_ts", "script_end_ts").filter("verse_str <> '0'").select("script_id", "verse_str", "script_begin_ts", "script_end_ts")


def all_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tokens, words or not (PRJ-13)."""
    return tokens(spark, sf_dir, "script_id", "word_seq", "ttype", "word").select("word_id", "script_id", *_long("word_seq"), "ttype", "word")


def reference_verses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples whose reference is of a book's first chapter, grouped to verses again (PRJ-20)."""
    s = lines(spark, sf_dir, *CHAPTER, "verse_str").filter("verse_str is not null")
    w = tokens(spark, sf_dir, "script_id", "word_seq", "ttype", "word").filter("ttype = 'W' and word is not null and word_seq is not null").join(s, "script_id")
    ref = F.concat("book_id", F.lit(" "), F.col("chapter_num").cast("string"), F.lit(":"), "verse_str", F.lit("."), F.col("word_seq").cast("string"))
    v = Q.referenced_verses(w.select("dataset_id", "script_id", "word_id", "word", "book_id", ref.alias("reference")), "reference", F.concat("book_id", F.lit(" 1:")), ["dataset_id", "book_id"])
    return v.select("dataset_id", "book_id", "verse_str", "script_id", F.array_join("words", " ").alias("text"))


def chapter_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by control break of book and chapter (WIN-18)."""
    return lines(spark, sf_dir, *CHAPTER, "script_text").groupBy(*CHAPTER).agg(F.min("script_id").alias("first_line"), F.max("script_id").alias("last_line"), F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("script_text")).alias("n_chars")).select("dataset_id", "book_id", *_long("chapter_num"), "first_line", "last_line", "n_lines", "n_chars")


def pair_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with verse markers made comparable: markers go from the base only (STR-04, AGG-17)."""
    t = F.concat(F.lit("{1} "), F.coalesce("script_text", F.lit("")), F.lit(" {2-3}"))
    c = lambda x: X.cleanup(x)
    return lines(spark, sf_dir, "script_text").select("script_id", c(X.without_markers(t)).alias("base"), c(t).alias("comp"), F.lit(True).alias("is_latin"))


def marker_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts whose verse markers are malformed, with what is wrong (STR-10)."""
    t = F.concat(F.lit("{"), F.col("script_id").cast("string"), F.when(F.col("script_id") % 5 == 0, F.lit("")).when(F.col("script_id") % 7 == 0, F.lit("}}")).otherwise(F.lit("}")), F.lit(" text"))
    return lines(spark, sf_dir, "verse_num").select("script_id", X.marker_errors(t).alias("wrong")).filter("wrong <> ''")


def spoken_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of lines composed, romanised, numbers spoken and reduced to letters (STR-21)."""
    from quillstream.functions.unicode import normal_form, number_words, romanised

    w = lines(spark, sf_dir, "script_text").select("script_id", F.posexplode(F.split(normal_form(F.col("script_text"), "NFC"), r"\s+")).alias("pos", "word")).filter("word <> ''")
    return w.select("script_id", *_long("pos"), X.only_letters(number_words(romanised(F.col("word")))).alias("word"))


def yaml_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalars of raw YAML (STR-28)."""
    y = F.concat(F.lit("is_new: true\nbible_id: "), F.coalesce("bible_id", F.lit("")), F.lit("  # id\nversion_name: '"), F.coalesce("version_code", F.lit("")), F.lit("'\n  bible_id: inner\n"))
    return table(spark, sf_dir, "ident").select("dataset_id", *[N.yaml_scalar(y, n).alias(n) for n in ("bible_id", "version_name", "absent")])


def letters_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of words' aligned letters (STR-29, STR-30)."""
    c = letters(spark, sf_dir, "word_id", "uroman").filter("word_id is not null and uroman is not null")
    w = c.groupBy("word_id").agg(F.array_sort(F.collect_list(F.struct("char_id", F.col("uroman").alias("ch")))).alias("r"))
    return w.select("word_id", N.joined_letters(F.col("r")).alias("text"))


def space_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines against themselves with a blank or a letter more: only the first differ in blanks alone (STR-31, DIF-10)."""
    t = lines(spark, sf_dir, "script_text").filter("length(trim(script_text)) > 1").select("script_id", F.trim("script_text").alias("t"))
    other = F.concat(F.substring("t", 1, 1), F.when(F.col("script_id") % 2 == 0, F.lit("  ")).otherwise(F.lit("#")), F.expr("substring(t, 2)"))
    from quillstream.operators.diff import only_spaces

    return t.select("script_id", only_spaces(clean_diffs(F.col("t"), other)).alias("same"))


def log_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Durations in logs of a converter, written for each line's end (DTM-02)."""
    t = lines(spark, sf_dir, "script_end_ts").filter("script_end_ts >= 0 and not isnan(script_end_ts) and script_end_ts < 360000").withColumn("c", F.floor(F.col("script_end_ts") * 100).cast("long"))
    h = F.format_string("size=1 time=00:00:00.50 x\nsize=2 time=%02d:%02d:%02d.%02d bitrate", F.expr("c div 360000"), F.expr("c div 6000 % 60"), F.expr("c div 100 % 60"), F.expr("c % 100"))
    return t.select("script_id", F.round(X.log_seconds(h) * 100).cast("long").alias("centis"))


def run_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minutes a run of each set of steps may take (DTM-04)."""
    steps = (["timestamps"], ["training"], ["timestamps", "training", "speech_to_text"], [])
    return spark.createDataFrame([(",".join(s), q, N.runtime_budget(s, q)) for s in steps for q in (False, True)], "steps string, queued boolean, minutes double")


def expired_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of lines that came more than three days before the last one (DTM-05)."""
    t = table(spark, sf_dir, "scripts").select("script_id", "loaded_at")
    return N.expired(t, "loaded_at", F.lit(t.agg(F.max("loaded_at")).first()[0])).groupBy("script_id").agg(F.count(F.lit(1)).alias("n"))


def sample_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each line's samples (MTH-04)."""
    t = lines(spark, sf_dir, "script_begin_ts", "script_end_ts").filter("script_end_ts > script_begin_ts and not isnan(script_end_ts)")
    seconds = F.floor((F.col("script_end_ts") - F.col("script_begin_ts")) * 100) / 100
    return t.select("script_id", N.sample_bytes(seconds, 16_000, 4).cast("long").alias("bytes"))


def unfit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with a NaN, an infinity or nothing in them, some made so (MTH-06)."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    odd = F.when(F.col("vec_id") % 10 == 1, F.array(F.lit(float("inf")))).when(F.col("vec_id") % 10 == 2, F.array(F.lit(float("nan")), F.lit(1.0))).when(F.col("vec_id") % 10 == 3, F.array().cast("array<double>")).when(F.col("vec_id") % 10 == 4, F.lit(None).cast("array<double>")).otherwise(F.col("v"))
    return e.select("vec_id", N.unfit(odd).alias("why")).filter("why <> ''")


def matrix_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matrices as JSON text and back (MTH-08)."""
    m = features(spark, sf_dir).select("word_id", N.matrix_of(N.matrix_json(F.col("mfcc"))).alias("m"))
    cells = F.flatten("m")
    return m.select("word_id", F.size("m").cast("long").alias("n_rows"), F.coalesce(F.aggregate(cells, F.lit(0.0), lambda a, x: a + F.floor(x * 1000)), F.lit(0.0)).cast("long").alias("total"))


def stored_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matrices written compressed and read again (MTH-03, DML-13)."""
    space = Workspace(spark, "matrices")
    path = write_table(features(spark, sf_dir).select("word_id", "mfcc"), f"{space.root}/m", compression="zstd")
    return spark.read.parquet(path).select("word_id", F.size("mfcc").cast("long").alias("n_rows"), F.get(F.get("mfcc", F.lit(0)), F.lit(0)).cast("double").alias("first_cell"))


def padded_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tensors of batches of vectors: values padded with 0, masks, labels padded with -100 to the longest of the batch (MTH-05, UDF-19)."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.expr("vec_id div 7").alias("batch"), F.slice(F.transform("embedding", lambda x: x.cast("double")), 1, (F.col("vec_id") % 5 + 1).cast("int")).alias("v"))
    b = Q.padded_batches(e.withColumn("labels", F.array_repeat(F.lit(1), (F.col("vec_id") % 3 + 1).cast("int"))), ["batch"], "v", "labels")
    add = lambda c, z: F.aggregate(c, z, lambda a, x: a + x)
    return b.select("vec_id", F.size("v").cast("long").alias("width"), add("mask", F.lit(0)).cast("long").alias("n_true"), F.size("labels").cast("long").alias("n_labels"), add("labels", F.lit(0)).cast("long").alias("label_sum"))


def silence_splices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words' letters with what was heard after the first long one laid in (JOI-28, DIF-10..13)."""
    c = letters(spark, sf_dir, "word_id", "uroman", "start_ts", "end_ts").filter("word_id is not null and length(trim(uroman)) = 1")
    w = c.groupBy("word_id").agg(F.array_sort(F.collect_list(F.struct("char_id", "uroman", F.coalesce(F.col("end_ts") - F.col("start_ts"), F.lit(0.0)).alias("gap")))).alias("r"))
    w = w.select("word_id", F.transform("r", lambda x: x["uroman"]).alias("ch"), F.slice(A.long_gap_places(F.transform("r", lambda x: x["gap"]), 0.15), 1, 1).alias("at"))
    heard = F.concat(F.array_join(F.slice("ch", 1, F.get("at", F.lit(0)) + 1), ""), F.lit("123"), F.array_join(F.slice("ch", F.get("at", F.lit(0)) + 2, F.size("ch")), ""))
    s = w.select("word_id", "at", spliced(F.col("ch"), F.col("at"), F.when(F.size("at") > 0, heard)).alias("s"))
    text = lambda keep: F.array_join(F.transform(F.filter("s", keep), lambda x: x["ch"]), "")
    place = F.coalesce(F.get(F.filter("s", lambda x: x["heard"]), F.lit(0))["at"], F.lit(-1))
    return s.select("word_id", text(lambda x: ~x["heard"]).alias("text"), text(lambda x: x["heard"]).alias("heard"), place.cast("long").alias("place"))


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame paths of words: two frames a letter, one blank between letters."""
    c = letters(spark, sf_dir, "word_id", "uroman").filter("word_id is not null and regexp_like(uroman, '^[a-z]$')")
    w = c.groupBy("word_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("char_id", (F.ascii("uroman") - 96).alias("t")))), lambda r: r["t"]).alias("target"))
    return w.withColumn("path", F.flatten(F.transform("target", lambda t, i: F.when(i > 0, F.array(F.lit(0), t, t)).otherwise(F.array(t, t)))))


def frame_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of frame paths (DIF-16)."""
    p = _paths(spark, sf_dir).select("word_id", F.posexplode(A.frame_runs(F.col("path"))).alias("pos", "r"))
    return p.select("word_id", *_long("pos"), *[F.col(f"r.{n}").cast("long").alias(n) for n in ("token", "first", "last")])


def token_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of tokens with their share of the blanks beside them (DIF-17)."""
    p = _paths(spark, sf_dir).select("word_id", F.posexplode(A.token_spans(F.col("path"))).alias("pos", "r"))
    return p.select("word_id", *_long("pos"), *[F.col(f"r.{n}").cast("long").alias(n) for n in ("token", "first", "last")])


def guided_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens found in frames of scores by the search that knows the text (DIF-19, SRT-06)."""
    p = _paths(spark, sf_dir).repartition(4 * spark.sparkContext.defaultParallelism, "word_id")  # the search costs far more than its bytes
    frames = F.transform("path", lambda t: F.array(*[F.when(t == k, 0.0).otherwise(-9.0) for k in range(27)]))
    h = p.select("word_id", F.posexplode(A.heard_tokens(frames, F.col("target"))).alias("pos", "token"))
    return h.select("word_id", *_long("pos", "token"))


def inserted_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New lines as the bulk insert prepares them (DML-01)."""
    t = lines(spark, sf_dir, *CHAPTER, "verse_str", "script_num", "script_text")
    raw = t.select("script_id", *CHAPTER, F.concat(F.col("verse_str"), F.when(F.col("script_id") % 2 == 0, F.lit("-99")).otherwise(F.lit(""))).alias("verse_str"), "script_num", F.array("script_text", F.lit(""), F.lit("end"), F.lit(".")).alias("texts"))
    p = M.prepared_lines(raw, [*CHAPTER, "script_num"])
    return p.select("script_id", "verse_str", "verse_end", *_long("verse_num"), "script_num", "script_text", "is_duplicate")


def erased_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines without text, and what is left of the tables below them (DML-07)."""
    out = M.erased({"scripts": lines(spark, sf_dir, "dataset_id", "script_text"), "words": tokens(spark, sf_dir, "script_id"), "chars": letters(spark, sf_dir, "word_id")})
    return out["scripts"].groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("script_text")).alias("n_chars")).select("dataset_id", "n", "n_chars", F.lit(out["words"].count() + out["chars"].count()).alias("n_below"))


def _store(spark: SparkSession, name: str) -> P.Store:
    return P.Store(spark, Workspace(spark, name).root, "u", "d")


def cloned_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers in a dataset's store, replaced once, cloned with a suffix, the first one dropped (SRC-01..04, DML-09, DML-10)."""
    s = _store(spark, "clone")
    i = table(spark, sf_dir, "ident")
    s.write("ident", i.limit(0))
    s.write("ident", i)
    c = s.clone("_copy")
    s.drop()
    gone = s.exists()
    return c.read("ident").select("dataset_id", "bible_id", F.lit(gone).alias("first_is_there"))


def language_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The code to ask a tool for, for each dataset's language: an override, else the nearest the tool knows (GRF-06, GRF-07)."""
    i = table(spark, sf_dir, "ident").select("dataset_id", "language_iso", F.when(F.col("dataset_id") % 5 == 0, F.lit("xx")).otherwise(F.lit("")).alias("override"))
    c = G.chosen_code(i, table(spark, sf_dir, "languages"), "id", "parent_id", "whisper")
    return c.select("dataset_id", F.coalesce("code", F.lit("")).alias("code"), "found_by", *_long("status"))


def book_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books of lines found by variants of their names (SET-03)."""
    names = table(spark, sf_dir, "books").select(F.concat(F.lit("The Book of_"), "book_id").alias("book_name"), "book_id")
    t = lines(spark, sf_dir, "book_id").select("script_id", F.concat(F.lit("the_book OF "), F.lower("book_id")).alias("book_name"))
    return named_books(t, names).select("script_id", "book_id")


def embedded_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector of the skip-gram model for every word, also those seen once (UDF-12)."""
    w = tokens(spark, sf_dir, "script_id", "word_seq", "ttype", "word").filter("ttype = 'W' and word <> '' and script_id is not null")
    v = word_vectors(w, min_count=1, size=16)
    return w.withColumn("low", F.lower("word")).join(v, F.col("low") == v["word"], "left").select("word_id", F.size("vector").cast("long").alias("width"))


#: Sections of a request, one for each rule across sections and of others, with the message expected.
REQUESTS = {
    "remote": ("is_new: true\ndatabase: {remote: x}", "a remote database can't be new"),
    "no audio": ("text_data: {file: a.csv}\ntimestamps: {line_aligner: true}", "timestamps need audio"),
    "no text": ("audio_data: {file: a.mp3}\ntimestamps: {ts_bucket: true}", "timestamps need text"),
    "catalog times": ("audio_data: {file: a.mp3}\ntimestamps: {catalog: true}", "OK"),
    "encoding": ("text_encoding: {fast_text: true}", "text encoding needs text"),
    "heard": ("speech_to_text: {base_asr: true}", "speech to text needs audio"),
    "features": ("audio_data: {file: a.mp3}\naudio_encoding: {mfcc: true}", "audio encoding needs timestamps"),
    "proof": ("is_new: true\naudio_data: {file: a.mp3}\ntext_data: {file: a.csv}\ntimestamps: {fa_align: true}\naudio_proof: {html_report: true}", "an audio proof of a new dataset needs base_asr"),
    "proof base": ("audio_proof: {html_report: true}", "an audio proof of an existing dataset needs base_dataset"),
    "two": ("text_data: {file: a.csv, no_text: true}", "text_data: only one option can be set, not file, no_text"),
    "unknown": ("output: {cvs: true}", "output.cvs: unknown field"),
    "kind": ("is_new: 3", "is_new: expected bool"),
    "list": ("testament: {nt_books: KAR}", "testament.nt_books: expected list"),
    "hyphen": ("compare: {compare_settings: {hyphen: {remove: true, normalize: true}}}", "compare.compare_settings.hyphen: only one option can be set"),
    "all": ("is_new: true\naudio_data: {file: a.mp3}\ntext_data: {file: a.csv}\ntimestamps: {fa_align: true}\nspeech_to_text: {base_asr: true}\naudio_proof: {html_report: true}", "OK"),
}


def request_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is said of requests that break a rule (REQ-01..05, JSN-02); accepted ones are encoded and read again."""
    rows = []
    for name, (text, _) in REQUESTS.items():
        try:
            q = R.parse(f"dataset_name: d\nusername: u\nlanguage_iso: eng\n{text}\n")
            rows.append((name, "OK" if R.parse(R.encode(q)) == q else "changed", bool(q["detail"]["words"])))
        except R.RequestError as e:
            rows.append((name, str(e), False))
    return spark.createDataFrame(rows, "name string, message string, words boolean")


def queue_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests in a folder taken one by one, with a status each (SRC-40, STM-01, REQ-06, REQ-14)."""
    space = Workspace(spark, "queue")
    fs, path = space._fs, space._path
    for name, text in (("a", "dataset_name: d\nusername: u\nlanguage_iso: eng\n"), ("b", "dataset_name: d\n"), ("c", "- 1\n"), ("fails", "dataset_name: f\nusername: u\nlanguage_iso: eng\n")):
        out = fs.create(path(f"{space.root}/in/{name}.yaml"), True)
        out.write(bytearray(text, "utf-8"))
        out.close()

    def run(request) -> None:
        if request["dataset_name"] == "f":
            raise OSError("no room")

    serve(spark, f"{space.root}/in", f"{space.root}/log", run, f"{space.root}/out").awaitTermination()
    r = spark.read.schema("path string, code int, message string").parquet(f"{space.root}/out/batch=*")
    return r.select(F.element_at(F.split("path", "/"), -1).alias("file"), *_long("code"), F.replace("message", F.lit("\n"), F.lit("; ")).alias("message"))


def run_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run on all lines as CSV: lines read, stored and tokenised, then a second dataset compared with them (REQ-06..11, SRC-08, SNK-08)."""
    space = Workspace(spark, "run")
    t = lines(spark, sf_dir, *CHAPTER, "verse_num", "script_text").filter("script_text is not null and verse_num is not null")
    t = t.groupBy(*CHAPTER, "verse_num").agg(F.min_by(F.regexp_replace("script_text", r"\s+", " "), "script_id").alias("text"))
    rows = t.select(F.concat_ws("_", "dataset_id", "book_id").alias("book"), F.col("chapter_num").alias("chapter"), F.col("verse_num").alias("verse"), F.col("text"))
    path = write_table(rows, f"{space.root}/in.csv", "csv", escape='"')
    q = R.check({"is_new": True, "dataset_name": "a", "username": "u", "language_iso": "eng", "text_data": {"file": path}, "detail": {"words": True}})
    one = P.run_request(spark, q, space.root)
    n = one["words"].groupBy("script_id").agg(F.count(F.lit(1)).alias("n_tokens"), F.count(F.when(F.col("ttype") == "W", 1)).alias("n_words"))
    return one["scripts"].join(n, "script_id", "left").groupBy("book_id", "chapter_num").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("script_text")).alias("n_chars"), F.coalesce(F.sum("n_words"), F.lit(0)).alias("n_words")).select("book_id", *_long("chapter_num"), "n_lines", "n_chars", "n_words")


QUERIES = {
    f.__name__: f
    for f in (
        program_answers, refused_names, line_text, line_keys, alignment_columns, chapter_times, all_tokens, reference_verses, chapter_runs, pair_cleanup, marker_errors, spoken_words, yaml_scalars, letters_joined, space_only, log_durations,
        run_budgets, expired_rows, sample_sizes, unfit_vectors, matrix_texts, stored_matrices, padded_batches, silence_splices, frame_runs, token_spans, guided_tokens, inserted_lines, erased_lines, cloned_rows,
        language_choices, book_names, embedded_words, request_checks, queue_results, run_lines,
    )
}

_CLEAN = r"""lower(regexp_replace({0}, '<<|>>|\(\(|[†\[\]<>]|[,;:.!?~]|["“”«»]|[''ꞌ‘’]|[-‐‑‒–—―﹘﹢﹣－]', '', 'g'))"""
_T = "'{1} ' || coalesce(script_text, '') || ' {2-3}'"
_BARE = rf"regexp_replace({_T}, '\{{[0-9\-,]+\}}\s?', '', 'g')"
_LETTERS = "k AS (SELECT word_id, ascii(uroman) - 96 AS t, row_number() OVER (PARTITION BY word_id ORDER BY char_id) - 1 AS i, count(*) OVER (PARTITION BY word_id) AS n FROM c WHERE word_id IS NOT NULL AND regexp_full_match(uroman, '[a-z]'))"
_OK = "script_end_ts > script_begin_ts AND NOT isnan(script_end_ts)"
_SPACE = r"[ \t\n\r\x{000B}\x{000C}]"
ORACLE = {
    "program_answers": sql("SELECT script_id, upper(uroman) AS answer, upper(uroman) AS in_batch FROM s WHERE regexp_full_match(uroman, '[a-z ]+')"),
    "refused_names": sql("SELECT dataset_id, verse_str, count(*) - 27 AS n_refused FROM s WHERE verse_str IS NOT NULL GROUP BY ALL HAVING count(*) > 27"),
    "line_text": sql("SELECT script_id, uroman FROM s"),
    "line_keys": sql("SELECT script_id, dataset_id, book_id, chapter_num, verse_str FROM s"),
    "alignment_columns": sql("SELECT script_id, book_id, chapter_num, verse_str, audio_file, script_text FROM s WHERE audio_file <> ''"),
    "chapter_times": sql("SELECT script_id, verse_str, script_begin_ts, script_end_ts FROM s WHERE verse_str <> '0'"),
    "all_tokens": sql("SELECT word_id, script_id, word_seq, ttype, word FROM w"),
    "reference_verses": sql("SELECT s.dataset_id, book_id, verse_str, min(script_id) AS script_id, string_agg(word, ' ' ORDER BY word_seq, word_id) AS text FROM w JOIN s USING (script_id) WHERE ttype = 'W' AND word IS NOT NULL AND word_seq IS NOT NULL AND verse_str IS NOT NULL AND chapter_num = 1 AND verse_str NOT LIKE '%.%' AND verse_str NOT LIKE '%:%' GROUP BY ALL"),
    "chapter_runs": sql("SELECT dataset_id, book_id, chapter_num, min(script_id) AS first_line, max(script_id) AS last_line, count(*) AS n_lines, sum(length(script_text))::BIGINT AS n_chars FROM s GROUP BY dataset_id, book_id, chapter_num"),
    "pair_cleanup": sql(f"SELECT script_id, {_CLEAN.format(_BARE)} AS base, {_CLEAN.format(_T)} AS comp, true AS is_latin FROM s"),
    "marker_errors": sql("SELECT script_id, CASE WHEN script_id % 5 = 0 THEN '{' ELSE '}' END AS wrong FROM s WHERE script_id % 5 = 0 OR script_id % 7 = 0"),
    "yaml_scalars": "SELECT dataset_id, trim(coalesce(bible_id, '')) AS bible_id, coalesce(version_code, '') AS version_name, '' AS absent FROM ident",
    "letters_joined": sql("SELECT word_id, string_agg(uroman, '' ORDER BY char_id) AS text FROM c WHERE word_id IS NOT NULL AND uroman IS NOT NULL GROUP BY word_id"),
    "space_only": sql("SELECT script_id, script_id % 2 = 0 AS same FROM s WHERE length(trim(script_text)) > 1"),
    "log_durations": sql("SELECT script_id, CAST(floor(script_end_ts * 100) AS BIGINT) AS centis FROM s WHERE script_end_ts >= 0 AND NOT isnan(script_end_ts) AND script_end_ts < 360000"),
    "run_budgets": "SELECT steps, queued, (10 + m) * CASE WHEN queued THEN 0.3 ELSE 2.0 END::DOUBLE AS minutes FROM (VALUES ('timestamps', 20), ('training', 240), ('timestamps,training,speech_to_text', 280), ('', 0)) AS v(steps, m), (VALUES (false), (true)) AS q(queued)",
    "expired_rows": "SELECT script_id, count(*) AS n FROM scripts WHERE loaded_at < (SELECT max(loaded_at) FROM scripts) - INTERVAL 3 DAY GROUP BY script_id",
    "sample_sizes": sql(f"SELECT script_id, CAST(ceil(floor((script_end_ts - script_begin_ts) * 100) / 100 * 16000) AS BIGINT) * 4 AS bytes FROM s WHERE {_OK}"),
    "unfit_vectors": "SELECT vec_id, CASE vec_id % 10 WHEN 1 THEN 'infinite' WHEN 2 THEN 'nan' ELSE 'empty' END AS why FROM embeddings WHERE vec_id % 10 IN (1, 2, 3, 4)",
    "matrix_texts": sql("SELECT word_id, len(mfcc) AS n_rows, coalesce(list_sum(list_transform(flatten(mfcc), lambda x: floor(CAST(x AS VARCHAR)::DOUBLE * 1000))), 0)::BIGINT AS total FROM m"),
    "stored_matrices": sql("SELECT word_id, len(mfcc) AS n_rows, mfcc[1][1]::DOUBLE AS first_cell FROM m"),
    "padded_batches": "SELECT vec_id, max(least(len(embedding), vec_id % 5 + 1)) OVER (PARTITION BY vec_id // 7) AS width, least(len(embedding), vec_id % 5 + 1) AS n_true, max(vec_id % 3 + 1) OVER (PARTITION BY vec_id // 7) AS n_labels, (vec_id % 3 + 1) - 100 * (max(vec_id % 3 + 1) OVER (PARTITION BY vec_id // 7) - (vec_id % 3 + 1)) AS label_sum FROM embeddings",
    "silence_splices": sql("SELECT word_id, string_agg(uroman, '' ORDER BY char_id) AS text, CASE WHEN min(CASE WHEN gap > 0.15 THEN i END) IS NULL THEN '' ELSE '123' END AS heard, coalesce(min(CASE WHEN gap > 0.15 THEN i END), -1) AS place FROM (SELECT word_id, char_id, uroman, coalesce(end_ts - start_ts, 0) AS gap, row_number() OVER (PARTITION BY word_id ORDER BY char_id) - 1 AS i FROM c WHERE word_id IS NOT NULL AND length(trim(uroman)) = 1) GROUP BY word_id"),
    "frame_runs": sql("SELECT word_id, 2 * i AS pos, t::BIGINT AS token, 3 * i AS first, 3 * i + 2 AS last FROM k UNION ALL SELECT word_id, 2 * i + 1, 0, 3 * i + 2, 3 * i + 3 FROM k WHERE i < n - 1", _LETTERS),
    "token_spans": sql("SELECT word_id, i AS pos, t::BIGINT AS token, 3 * i AS first, CASE WHEN i = n - 1 THEN 3 * i + 2 ELSE 3 * i + 3 END AS last FROM k", _LETTERS),
    "guided_tokens": sql("SELECT word_id, i AS pos, t::BIGINT AS token FROM k", _LETTERS),
    "inserted_lines": sql(r"SELECT script_id, split_part(verse_str, '-', 1) AS verse_str, CASE WHEN contains(v, '-') THEN substr(v, instr(v, '-') + 1) ELSE v END AS verse_end, coalesce(try_cast(nullif(regexp_extract(verse_str, '^[0-9]+'), '') AS BIGINT), 0) AS verse_num, repeat('0', greatest(5 - length(regexp_extract(script_num, '^[0-9]*')), 0)) || script_num AS script_num, script_num AS raw, script_text AS t, count(*) OVER (PARTITION BY dataset_id, book_id, chapter_num, repeat('0', greatest(5 - length(regexp_extract(script_num, '^[0-9]*')), 0)) || script_num) > 1 AS is_duplicate FROM (SELECT *, verse_str || CASE WHEN script_id % 2 = 0 THEN '-99' ELSE '' END AS v FROM s)").replace(", script_num AS raw, script_text AS t", r", CASE WHEN coalesce(script_text, '') = '' THEN 'end.' WHEN regexp_matches(script_text, '[\s([‘“‹«]$') THEN script_text || 'end.' ELSE script_text || ' end.' END AS script_text"),
    "erased_lines": sql("SELECT dataset_id, count(*) AS n, 0::BIGINT AS n_chars, 0::BIGINT AS n_below FROM s GROUP BY dataset_id"),
    "cloned_rows": "SELECT dataset_id, bible_id, false AS first_is_there FROM ident",
    "language_choices": "WITH RECURSIVE up AS (SELECT id AS node_id, id AS anc, parent_id, 0 AS d FROM languages UNION ALL SELECT node_id, l.id, l.parent_id, d + 1 FROM up JOIN languages l ON l.id = up.parent_id), p AS (SELECT a.node_id, b.node_id AS found_id, min(a.d + b.d) AS distance FROM up a JOIN up b USING (anc) JOIN languages l ON l.id = b.node_id AND l.whisper <> '' GROUP BY ALL), q AS (SELECT * FROM p QUALIFY distance = min(distance) OVER (PARTITION BY node_id)), near AS (SELECT node_id, min(whisper) AS code, min(distance) AS distance FROM q JOIN languages l ON l.id = q.found_id GROUP BY node_id), n AS (SELECT iso, arg_min(id, struct_pack(a := rank, b := id)) AS node_id FROM (SELECT iso639_3 AS iso, id, 0 AS rank FROM languages WHERE iso639_3 <> '' UNION ALL SELECT iso639_1, id, 1 FROM languages WHERE iso639_1 <> '') GROUP BY iso) SELECT dataset_id, CASE WHEN dataset_id % 5 = 0 THEN 'xx' ELSE coalesce(code, '') END AS code, CASE WHEN dataset_id % 5 = 0 THEN 'override' WHEN distance = 0 THEN 'same' WHEN code IS NOT NULL THEN 'nearest' ELSE 'none' END AS found_by, CASE WHEN dataset_id % 5 = 0 OR code IS NOT NULL THEN 200 ELSE 400 END AS status FROM ident LEFT JOIN n ON n.iso = language_iso LEFT JOIN near USING (node_id)",
    "book_names": sql("SELECT script_id, b.book_id FROM s LEFT JOIN books b ON upper(b.book_id) = upper(s.book_id)"),
    "embedded_words": sql("SELECT word_id, 16 AS width FROM w WHERE ttype = 'W' AND word <> '' AND script_id IS NOT NULL"),
    "request_checks": "SELECT * FROM (VALUES " + ", ".join("('{}', '{}', {})".format(k, m.replace("'", "''"), "true" if k == "all" else "false") for k, (_, m) in REQUESTS.items()) + ") AS v(name, message, words)",
    "queue_results": "SELECT * FROM (VALUES ('a.yaml', 200, 'OK'), ('b.yaml', 400, 'username: required; bible_id or language_iso: required'), ('c.yaml', 400, 'a request is a mapping'), ('fails.yaml', 500, 'no room')) AS v(file, code, message)",
    "run_lines": sql(rf"SELECT upper(dataset_id || '_' || book_id) AS book_id, chapter_num, count(*) AS n_lines, sum(length(x))::BIGINT AS n_chars, sum(n_words)::BIGINT AS n_words FROM (SELECT *, len(regexp_extract_all(x, '[\p{{L}}\p{{N}}]+(?:[^\p{{L}}\p{{N}}\s{{][\p{{L}}\p{{N}}]+)*')) AS n_words FROM (SELECT dataset_id, book_id, chapter_num, verse_num, arg_min(regexp_replace(script_text, '{_SPACE}+', ' ', 'g'), script_id) AS x FROM s WHERE script_text IS NOT NULL AND verse_num IS NOT NULL GROUP BY ALL)) GROUP BY ALL"),
}
