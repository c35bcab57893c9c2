"""A request as a chain of DataFrames: read, tokenise, align, recognise, compare, export.

Each dataset is a folder of Parquet tables, ``root/user/dataset/table``; a step
is materialised only where the next must not run it again. Acoustic models and
other programs plug in as functions from DataFrames to DataFrames.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.functions import text as X
from quillstream.functions.unicode import normal_form, strip_marks
from quillstream.model import SCHEMAS, empty
from quillstream.operators import diff as D
from quillstream.operators.joins import paired
from quillstream.operators.mutations import number_rows
from quillstream.plans.request import Request, RequestError, cleanup_options, unicode_form
from quillstream.sinks import writers
from quillstream.sources import readers

log = logging.getLogger(__name__)

READERS = {".csv": readers.read_csv_lines, ".usfm": readers.read_usfm, ".sfm": readers.read_usfm, ".usx": readers.read_usx, ".zip": readers.read_usx, ".xlsx": readers.read_xlsx}


@dataclass
class Plugins:
    """External programs, each a function of lines or words that returns them with what it found; None leaves the step out (places for UDF-04 to UDF-18, which need models).

    ``align``: words to words with times and scores; ``transcribe``: lines to
    lines with recognised text; ``encode``: words to (word_id, matrix).
    """

    align: Callable[[DataFrame], DataFrame] | None = None
    transcribe: Callable[[DataFrame], DataFrame] | None = None
    encode: Callable[[DataFrame], DataFrame] | None = None
    done: list[str] = field(default_factory=list)


class Store:
    """The tables of one dataset (SRC-01..04, DML-09)."""

    def __init__(self, spark: SparkSession, root: str, user: str, dataset: str):
        self.spark, self.path = spark, f"{root}/{user}/{dataset}"

    def _where(self, name: str = ""):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str = "") -> bool:
        p = self._where(name)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def read(self, name: str) -> DataFrame:
        self._settle(name)
        return self.spark.read.parquet(f"{self.path}/{name}") if self.exists(name) else empty(self.spark, name)

    def write(self, name: str, df: DataFrame) -> DataFrame:
        """The new version is written beside the old one and takes its place when it is complete.

        The old version is moved aside first and deleted last; if the job ends
        in between, it is found there (see :meth:`_settle`).
        """
        self._settle(name)
        writers.write_table(df, f"{self.path}/_next_{name}")
        fs = self._where().getFileSystem(self.spark._jsc.hadoopConfiguration())
        if self.exists(name):
            fs.rename(self._where(name), self._where(f"_old_{name}"))
        fs.rename(self._where(f"_next_{name}"), self._where(name))
        fs.delete(self._where(f"_old_{name}"), True)
        return self.read(name)

    def _settle(self, name: str) -> None:
        """Ends a replacement that was interrupted: without a current version the old one comes back."""
        fs = self._where().getFileSystem(self.spark._jsc.hadoopConfiguration())
        if self.exists(f"_old_{name}"):
            if self.exists(name):
                fs.delete(self._where(f"_old_{name}"), True)
            else:
                fs.rename(self._where(f"_old_{name}"), self._where(name))

    def drop(self) -> None:
        self._where().getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(self._where(), True)

    def clone(self, suffix: str) -> Store:
        root, user, dataset = self.path.rsplit("/", 2)
        other = Store(self.spark, root, user, dataset + suffix)
        for name in SCHEMAS:
            if self.exists(name):
                other.write(name, self.read(name))
        return other


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Line rows by the reader of the path's format (REQ-08, REQ-09)."""
    kind = next((k for k in READERS if path.lower().rstrip("}*").endswith(k)), None)
    if not kind:
        raise RequestError([f"text_data.file: no reader for {path}"])
    rows = READERS[kind](spark, path)
    have = set(rows.columns)
    pick = lambda n, other: F.col(n) if n in have else F.lit(other)
    return rows.select(
        "book_id", "chapter_num", "verse_str", "verse_num", pick("script_num", "").cast("string").alias("script_num"), pick("usfm_style", "").alias("usfm_style"),
        pick("person", "").alias("person"), pick("actor", "").alias("actor"), "script_text", F.coalesce(pick("path", ""), F.lit("")).alias("path"), F.coalesce(pick("pos", 0), F.lit(0)).alias("pos"),
    )


def to_scripts(rows: DataFrame, dataset_id: int = 1) -> DataFrame:
    """Lines of the model with ids in the order of the source."""
    rows = number_rows(rows, "script_id", ["path", "pos", "chapter_num", "verse_num", "verse_str"])
    have = {"dataset_id": F.lit(dataset_id).cast("long"), "chapter_end": F.col("chapter_num"), "verse_end": X.verse_range(F.col("verse_str"))["end"], "script_num": X.zero_fill(F.col("script_num"))}
    columns = []
    for part in SCHEMAS["scripts"].split(", "):
        name, kind = part.split(" ")
        columns.append(have.get(name, F.col(name) if name in rows.columns else F.lit(0.0 if kind == "double" else "")).cast(kind).alias(name))
    return rows.select(*columns)


def to_words(scripts: DataFrame) -> DataFrame:
    """Tokens of the model (STR-09, WIN-15)."""
    t = scripts.select("script_id", "verse_num", F.posexplode(X.token_list(F.col("script_text"))).alias("pos", "word"))
    t = number_rows(t, "word_id", ["script_id", "pos"])
    zero = F.lit(0.0)
    return t.select("word_id", "script_id", (F.col("pos") + 1).alias("word_seq"), "verse_num", X.token_type(F.col("word")).alias("ttype"), "word", F.lit("").alias("uroman"), zero.alias("word_begin_ts"), zero.alias("word_end_ts"), zero.alias("fa_score"), F.lit(None).cast("array<double>").alias("word_enc"))


def comparable(text, request: Request):
    out = X.without_markers(X.cleanup(text, **cleanup_options(request)))
    form = unicode_form(request)
    return strip_marks(out) if form == "strip" else normal_form(out, form) if form else out


def compare_datasets(base: DataFrame, comp: DataFrame, words: DataFrame, request: Request) -> DataFrame:
    """Differing lines of two datasets: keys, both texts, kept diffs, scores and HTML."""
    keys = ["book_id", "chapter_num", "verse_str"]
    side = lambda d: d.groupBy(*keys).agg(F.min_by("script_text", "script_id").alias("text"))
    p = paired(side(base), side(comp), keys, ["text"])
    p = p.withColumns({s: comparable(F.coalesce(f"{s}_text", F.lit("")), request) for s in ("base", "comp")})
    p = p.withColumn("d", D.diffs(F.col("base"), F.col("comp"))).filter(~D.only_spaces(F.col("d")))
    p = p.withColumn("ref", X.reference(F.col("book_id"), F.col("chapter_num"), F.col("verse_str")))
    if request["compare"]["pattern_filter"] > 0:
        known = words.filter("ttype = 'W'").select(F.lower("word").alias("word")).distinct()
        p = D.suppress_systematic(p, "ref", "d", known, request["compare"]["pattern_filter"]).withColumn("d", F.col("kept")).drop("kept")
    p = p.withColumns({"inserted": D.length_of(F.col("d"), 1), "deleted": D.length_of(F.col("d"), -1), "longest": D.longest_run(F.col("d")), "html": D.rendered(F.col("d"))})
    return p.filter("longest > 2").orderBy(F.desc("longest"), "ref")


def run_request(spark: SparkSession, request: Request, root: str, plugins: Plugins | None = None) -> dict[str, DataFrame]:
    """Runs the steps a request asks for and gives the resulting tables (REQ-06, REQ-07, REQ-10, REQ-11)."""
    plugins = plugins or Plugins()
    store = Store(spark, root, request["username"], request["dataset_name"])
    if request["is_new"]:
        store.drop()
    elif not store.exists():
        raise RequestError([f"no dataset {request['dataset_name']} of {request['username']}"])
    out: dict[str, DataFrame] = {}
    if path := request["text_data"]["file"]:
        rows = read_lines(spark, path)
        t = request["testament"]
        wanted = [b for k in ("nt", "ot") for b in t[f"{k}_books"]]
        if wanted and not (t["nt"] or t["ot"]):
            rows = rows.filter(F.col("book_id").isin(wanted))
        out["scripts"] = store.write("scripts", to_scripts(rows))
    else:
        out["scripts"] = store.read("scripts")
    if request["detail"]["words"] or not request["timestamps"]["no_timestamps"]:
        out["words"] = store.write("words", to_words(out["scripts"]))
    words = out.get("words", store.read("words"))
    if not request["timestamps"]["no_timestamps"] and plugins.align:
        words = out["words"] = store.write("words", plugins.align(words))
    if not request["speech_to_text"]["no_speech_to_text"] and plugins.transcribe:
        heard = store.clone("_audio")
        out["heard"] = heard.write("scripts", plugins.transcribe(out["scripts"]))
    if request["audio_encoding"]["mfcc"] and plugins.encode:
        out["word_mfcc"] = store.write("word_mfcc", plugins.encode(words))
    if base := request["compare"]["base_dataset"]:
        other = Store(spark, root, request["username"], base)
        if not other.exists():
            raise RequestError([f"compare.base_dataset: no dataset {base}"])
        out["pairs"] = compare_datasets(other.read("scripts"), out["scripts"], words, request)
    export(out, request)
    return out


def export(tables: dict[str, DataFrame], request: Request) -> list[str]:
    """Writes what the output section asks for (SNK-01, SNK-03, SNK-08)."""
    where, done = request["output"]["directory"], []
    if where:
        for name, df in tables.items():
            plain = df.select(*[F.to_json(F.col(f.name)).alias(f.name) if f.dataType.typeName() in ("array", "struct", "map") else F.col(f.name) for f in df.schema.fields])
            for kind in ("csv", "json", "parquet"):
                if request["output"][kind]:
                    done.append(writers.write_table(writers.active_columns(plain) if kind == "csv" else df, f"{where}/{name}.{kind}", kind))
        if "pairs" in tables and request["compare"]["html_report"]:
            done.append(writers.html_report(tables["pairs"], request["dataset_name"], ["ref", "html", "longest", "inserted", "deleted"], f"{where}/compare.html", raw=["html"]))
    log.info("exported %s", done)
    return done


def main(argv: list[str] | None = None) -> int:
    """``python -m quillstream.plans.pipeline REQUEST.yaml ROOT`` (REQ-12)."""
    import sys

    from quillstream.plans.request import parse

    args = argv if argv is not None else sys.argv[1:]
    with open(args[0], encoding="utf-8") as f:
        text = f.read()
    try:
        request = parse(text)
        run_request(SparkSession.builder.getOrCreate(), request, args[1])
    except RequestError as e:
        print(e)
        return e.code // 100
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
