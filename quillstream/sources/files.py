"""Listings of files and objects, and the choice among them.

A listing is a DataFrame of path, length and modified; every operator works on
any such table, so object stores are read through Spark's file systems only.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.functions import text as X


def object_listing(spark: SparkSession, path: str | list[str], glob: str = "*") -> DataFrame:
    """Files below a path of any file system: path, length, modified; contents aren't read (SRC-21, SRC-34, SRC-35)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", F.col("modificationTime").alias("modified"))


def file_name(path: Column) -> Column:
    """What follows the last slash."""
    return F.element_at(F.split(path, "/"), -1)


def folder_name(path: Column) -> Column:
    """What precedes the last slash; '' without one."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def split_pattern(where: str) -> tuple[str, str, str | None]:
    """Bucket, prefix and regular expression of ``s3://bucket/folder/name``, where a ``*`` in the name is one character and the name an end (SRC-37)."""
    plain = re.sub(r"^s3:/{1,2}", "", where)
    bucket, _, key = plain.partition("/")
    folder, slash, name = key.rpartition("/")
    if "*" not in name:
        return bucket, key, None
    return bucket, folder + slash, name.replace(".", r"\.").replace("*", ".") + "$"


def matching(listing: DataFrame, where: str) -> DataFrame:
    """Entries of a listing below a place given as for :func:`split_pattern`."""
    bucket, prefix, pattern = split_pattern(where)
    out = listing.filter(F.startswith(F.col("path"), F.lit(f"s3://{bucket}/{prefix}")))
    return out.filter(F.regexp_like(file_name(F.col("path")), F.lit(pattern))) if pattern else out


def owner_ids(path: Column) -> Column:
    """struct<bible_id, media_id>: the last two folders of a path that aren't empty (SRC-37)."""
    parts = F.filter(F.split(folder_name(path), "/"), lambda x: x != "")
    return F.struct(F.get(parts, F.size(parts) - 2).alias("bible_id"), F.get(parts, F.size(parts) - 1).alias("media_id"))


def input_files(listing: DataFrame, testaments: Sequence[str] = ("OT", "NT"), media_type: Column | None = None) -> DataFrame:
    """Source files with kind, testament, book number, chapter and media id, those of other testaments left out (PRJ-29, SRC-36).

    The kind is that of the name unless one is given. Files whose name tells no
    testament are kept; hidden files aren't.
    """
    name = file_name(F.col("path"))
    told = X.audio_name(name)
    out = listing.filter(~F.startswith(name, F.lit("."))).withColumn("file_name", name)
    out = out.withColumn("media_type", X.media_type(name) if media_type is None else F.coalesce(media_type, X.media_type(name)))
    out = out.select("*", told["testament"].alias("testament"), told["book_number"].alias("book_number"), told["chapter"].alias("chapter"), told["media_id"].alias("media_id"))
    return out.filter(F.col("testament").isNull() | F.col("testament").isin(*testaments))


def url_file(url: Column) -> Column:
    """File name of a URL, without its query: what downloads are ordered by (SRT-05)."""
    return file_name(F.parse_url(url, F.lit("PATH")))


def oldest(listing: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The entry modified first, of each key; the smallest path on ties (SRT-07, SRC-40)."""
    rest = [c for c in listing.columns if c not in keys]
    return listing.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct("modified", "path")).alias("r")).filter(F.col("r").isNotNull()).select(*keys, "r.*")


def aligner_key(book: Column, seq: Column, chapter: Column, before: int = 0) -> Column:
    """``C01-07-BOOK-03-timing.txt``; ``before`` books come before the first one counted (SRC-22)."""
    two = lambda n: F.lpad(n.cast("string"), F.greatest(F.length(n.cast("string")), F.lit(2)), F.lit("0"))
    return F.concat_ws("-", F.lit("C01"), two(seq - before), book, two(chapter), F.lit("timing.txt"))


def cue_key(media_id: Column, book: Column, chapter: Column, chapters_before: Column) -> Column:
    """``N2_ABC_DEF_012_BOOK_03_cue_info.txt``: the chapter's running number in its testament in three places (SRC-22)."""
    filled = lambda n, w: F.lpad(n.cast("string"), F.greatest(F.length(n.cast("string")), F.lit(w)), F.lit("0"))
    part = lambda a, n: F.substring(media_id, a, n)
    return F.concat_ws("_", part(7, 2), part(1, 3), part(4, 3), filled(chapters_before + chapter, 3), book, filled(chapter, 2), F.lit("cue_info.txt"))


def with_object_counts(sets: DataFrame, listing: DataFrame, fileset: str, kinds: Sequence[str]) -> DataFrame:
    """File sets with the number of objects of each kind, paths being ``.../kind/fileset/name`` (SRC-33)."""
    parts = F.split(folder_name(F.col("path")), "/")
    seen = listing.select(F.element_at(parts, -1).alias(fileset), F.get(parts, F.size(parts) - 2).alias("kind"))
    # Combined before the shuffle, by the few kinds asked for.
    n = seen.groupBy(fileset).agg(*[F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in kinds])
    return sets.join(n, fileset, "left").fillna(0, [f"n_{k}" for k in kinds])


def to_download(remote: DataFrame, local: DataFrame) -> DataFrame:
    """Remote files that aren't here in the same size, texts before recordings (SRC-26, REQ-15): path, length, place."""
    have = local.select(file_name(F.col("path")).alias("name"), F.col("length").alias("length"))
    missing = remote.withColumn("name", file_name(F.col("path"))).join(have, ["name", "length"], "left_anti")
    return missing.withColumn("place", F.when(X.media_type(F.col("name")).startswith("text"), 0).otherwise(1)).select("path", "length", "place")
