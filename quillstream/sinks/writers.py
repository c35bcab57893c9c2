"""Writers and report shapes."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PLAIN = (T.StringType, T.LongType, T.IntegerType, T.DoubleType, T.FloatType, T.BooleanType)


def short_number(x: Column) -> Column:
    """A double in the shortest form of 32 bits (SNK-02)."""
    return x.cast("float").cast("string")


def active_columns(df: DataFrame) -> DataFrame:
    """Without the columns that are NULL, zero or empty in every row (SNK-05, SNK-08)."""

    def filled(f: T.StructField) -> Column:
        c = F.col(f.name)
        if isinstance(f.dataType, T.StringType):
            return c != ""
        if isinstance(f.dataType, T.ArrayType):
            return F.size(c) > 0
        if isinstance(f.dataType, T.BooleanType):
            return c
        return c != 0 if isinstance(f.dataType, _PLAIN) else c.isNotNull()

    seen = df.agg(*[F.coalesce(F.bool_or(filled(f)), F.lit(False)).alias(f.name) for f in df.schema.fields]).first()
    return df.select(*[c for c in df.columns if seen[c]])


def wide_vector(df: DataFrame, vector: str, tag: str, width: int) -> DataFrame:
    """A vector column as ``tag0 ... tagN`` (SNK-01, SNK-06)."""
    return df.select(*[c for c in df.columns if c != vector], *[F.get(vector, F.lit(i)).alias(f"{tag}{i}") for i in range(width)])


def vector_width(df: DataFrame, vector: str) -> int:
    """The longest vector of the whole table; 0 if there is none (SNK-06)."""
    return max(0, df.agg(F.coalesce(F.max(F.size(vector)), F.lit(0))).first()[0])


def matrix_rows(df: DataFrame, key: str, matrix: str, scalars: Sequence[str]) -> DataFrame:
    """A row for each line of a matrix; scalars only on the first (SNK-01, SNK-03)."""
    out = df.select(key, *scalars, F.posexplode_outer(matrix).alias("line", "cells"))
    first = F.coalesce(F.col("line"), F.lit(0)) == 0
    return out.select(key, F.coalesce("line", F.lit(0)).alias("line"), *[F.when(first, F.col(s)).alias(s) for s in scalars], "cells")


def as_json(df: DataFrame) -> DataFrame:
    """One JSON text a row (SNK-03)."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def file_map(df: DataFrame, book: str, chapter: str, file: str) -> DataFrame:
    """JSON map from book and chapter to file, one a dataset (SNK-17)."""
    entry = F.struct(F.concat(F.col(book), F.col(chapter).cast("string")).alias("key"), F.col(file).alias("value"))
    return df.groupBy("dataset_id").agg(F.to_json(F.map_from_entries(F.array_sort(F.array_distinct(F.collect_list(entry))))).alias("files"))


def next_run(paths: DataFrame, path: str = "path") -> DataFrame:
    """Next run number by user and dataset of paths ``user/dataset/00012/...`` (SNK-14)."""
    p = F.split(F.col(path), "/")
    return paths.groupBy(p[0].alias("user"), p[1].alias("dataset")).agg((F.coalesce(F.max(F.get(p, F.lit(2)).try_cast("int")), F.lit(0)) + 1).alias("run"))


def queue_messages(df: DataFrame, group: str) -> DataFrame:
    """Messages with a key that repeats for repeated content (SNK-16)."""
    body = F.to_json(F.struct(*df.columns))
    return df.select(F.col(group).cast("string").alias("group"), body.alias("body"), F.sha2(body, 256).alias("message_id"))


def merged_pairs(frames: Sequence[DataFrame], key: str) -> DataFrame:
    """Pair lists one under the other, ordered by key and list (SNK-12)."""
    out = None
    for i, d in enumerate(frames):
        d = d.withColumn("list_no", F.lit(i))
        out = d if out is None else out.unionByName(d)
    return out.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy("list_no")))


def write_table(df: DataFrame, path: str, kind: str = "parquet", **options) -> str:
    """A dataset in one of the formats; existing data is replaced only when the new data is complete (DML-10, SNK-01..04)."""
    w = df.write.mode("overwrite").options(**options)
    if kind == "csv":
        w.option("header", True).csv(path)
    elif kind == "json":
        w.json(path)
    elif kind == "text":
        w.text(path)
    else:
        w.format(kind).save(path)
    return path


def html_report(df: DataFrame, title: str, columns: Sequence[str], path: str, raw: Sequence[str] = ()) -> str:
    """A report page on any file system, written row by row so that the driver holds one partition at most (SNK-10, SNK-11, SNK-19)."""
    spark = df.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    safe = lambda x: "" if x is None else str(x).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    put = lambda text: out.write(bytearray(text, "utf-8"))
    try:
        put(f"<!doctype html><meta charset=utf-8><title>{safe(title)}</title><h1>{safe(title)}</h1><table><tr>{''.join(f'<th>{safe(c)}</th>' for c in columns)}</tr>\n")
        lines: list[str] = []
        for r in df.select(*columns).toLocalIterator():
            lines.append("<tr>" + "".join(f"<td>{(r[c] or '') if c in raw else safe(r[c])}</td>" for c in columns) + "</tr>\n")
            if len(lines) == 1_000:
                put("".join(lines))
                lines.clear()
        put("".join(lines) + "</table>\n")
    finally:
        out.close()
    return path


def zip_files(files: dict[str, bytes]) -> bytes:
    """An archive of small result files (SNK-20)."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in sorted(files.items()):
            z.writestr(name, data)
    return out.getvalue()


@F.arrow_udf(T.BinaryType())
def zipped(files: pa.Array) -> pa.Array:
    """Archives of array<struct<name, text>> in a column (SNK-20)."""
    rows = [None if x is None else zip_files({f["name"]: (f["text"] or "").encode() for f in x}) for x in files.to_pylist()]
    return pa.array(rows, pa.binary())


def highlighted(parts: Column) -> Column:
    """HTML of array<struct<text, kind>>: a span with the kind as class around what has one (SNK-11).

    Kinds of the proofing report are ``critical``, ``question``, ``gap`` and ``heard``.
    """
    safe = lambda t: F.replace(F.replace(F.replace(t, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.array_join(F.transform(parts, lambda p: F.when(p["kind"] != "", F.concat(F.lit("<span class="), p["kind"], F.lit(">"), safe(p["text"]), F.lit("</span>"))).otherwise(safe(p["text"]))), "")


def status_json(status: Column, message: Column, trace: Column) -> Column:
    """A status as a JSON line (SNK-09, REQ-14)."""
    return F.to_json(F.struct(status.alias("status"), message.alias("message"), trace.alias("trace")))


def status_csv(status: Column, message: Column, trace: Column) -> Column:
    """A status as a CSV line, texts in quotes (SNK-09)."""
    quoted = lambda x: F.concat(F.lit('"'), F.replace(F.coalesce(x, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    return F.concat_ws(",", status.cast("string"), quoted(message), quoted(trace))


class Outputs:
    """The files a run made, by kind (SNK-13)."""

    def __init__(self) -> None:
        self.paths: list[str] = []

    def add(self, path: str) -> str:
        self.paths.append(path)
        return path

    def add_json(self, df: DataFrame, path: str) -> str:
        """Records as JSON, one array a line of the written text."""
        write_table(as_json(df), path, "text")
        return self.add(path)

    def by_ending(self, ending: str) -> list[str]:
        return [p for p in self.paths if p.endswith(ending)]
