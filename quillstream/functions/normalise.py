"""Normalisers by language, vectors, and small bookkeeping functions (STR-22, STR-28..30, MTH, DTM, JSN)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.functions.unicode import normal_form, strip_marks

#: A normaliser: Unicode form, lower case, regular-expression mappings, characters
#: deleted, punctuation to spaces, digit-only words dropped, marks stripped.
DEFAULT: dict[str, Any] = {"form": "NFKC", "lower": True, "mappings": (), "delete": "", "punctuation": r"[\p{P}\p{S}]", "drop_numbers": True, "strip_marks": False}


def normalised(text: Column, config: Mapping[str, Any] | None = None) -> Column:
    """Text by one normaliser; unset options are those of DEFAULT."""
    c = DEFAULT | dict(config or {})
    out = normal_form(text, c["form"]) if c["form"] else text
    out = F.lower(out) if c["lower"] else out
    out = F.regexp_replace(out, r"\([^()]*\d[^()]*\)", " ")
    for pattern, to in c["mappings"]:
        out = F.regexp_replace(out, pattern, to)
    if c["delete"]:
        out = F.translate(out, c["delete"], "")
    out = F.regexp_replace(out, c["punctuation"], " ") if c["punctuation"] else out
    if c["drop_numbers"]:
        out = F.regexp_replace(out, r"(?<!\S)\d+(?!\S)", " ")
    if c["strip_marks"]:
        out = strip_marks(out)
    return F.trim(F.regexp_replace(out, r"\p{IsWhite_Space}+", " "))


def normalised_by(text: Column, language: Column, configs: Mapping[str, Mapping[str, Any]]) -> Column:
    """Text by the normaliser of its language."""
    out = normalised(text)
    for name, config in configs.items():
        out = F.when(language == name, normalised(text, config)).otherwise(out)
    return out


def yaml_scalar(text: Column, name: str) -> Column:
    """A top-level scalar of raw YAML text, '' if it isn't there (STR-28)."""
    return F.trim(F.regexp_replace(F.regexp_extract(text, rf"(?m)^{name}:[ \t]*([^#\n]*)", 1), "[\"']", ""))


def joined_letters(chars: Column, field: str = "ch") -> Column:
    """Text of an array of letters (STR-29, STR-30)."""
    return F.array_join(F.transform(chars, lambda c: c[field]), "")


def padded_vector(vector: Column, length: int) -> Column:
    """At least ``length`` long, zeros at the right (MTH-01)."""
    return F.concat(vector, F.array_repeat(F.lit(0.0), F.greatest(F.lit(length) - F.size(vector), F.lit(0))))


def attention_mask(vector: Column, length: int) -> Column:
    """1 for each value, 0 for the padding (MTH-02)."""
    return F.concat(F.array_repeat(F.lit(1), F.size(vector)), F.array_repeat(F.lit(0), F.greatest(F.lit(length) - F.size(vector), F.lit(0))))


def sample_bytes(seconds: Column, rate: int = 16_000, width: int = 4) -> Column:
    """Bytes of a recording's samples (MTH-04)."""
    return F.ceil(seconds * rate) * width


# Minutes a run may take, by step.
MINUTES = {"base": 10, "timestamps": 20, "training": 240, "speech_to_text": 20}


def runtime_budget(steps: Sequence[str], queued: bool = False) -> float:
    """Minutes after which a run counts as long (DTM-04)."""
    return (MINUTES["base"] + sum(MINUTES[s] for s in steps)) * (0.3 if queued else 2.0)


def expired(entries: DataFrame, modified: str, now: Column, days: int = 3) -> DataFrame:
    """Entries not touched for some days (DTM-05)."""
    return entries.filter(F.col(modified) < now - F.expr(f"interval {int(days)} days"))


def error_lines(lines: Column) -> Column:
    """struct<status, message, trace> of a JSON error line; NULL for other lines (JSN-01)."""
    return F.when(lines.startswith('{"status"'), F.from_json(lines, "status int, message string, trace string"))


def folders(files: DataFrame, folder: str, category: str) -> DataFrame:
    """Files counted by folder; ``mixed`` if a folder holds several categories (AGG-34)."""
    g = files.groupBy(folder).agg(F.count(F.lit(1)).alias("n_files"), F.min(category).alias("category"), F.max(category).alias("__other"))
    return g.withColumn("mixed", F.col("category") != F.col("__other")).drop("__other")


def unfit(vector: Column) -> Column:
    """Why a vector can't be used: ``empty``, ``nan`` or ``infinite``; '' if it can (MTH-06)."""
    has = lambda test: F.exists(vector, test)
    return (
        F.when(vector.isNull() | (F.size(vector) == 0), "empty").when(has(lambda x: x.isNull() | F.isnan(x)), "nan").when(has(lambda x: F.abs(x) == float("inf")), "infinite").otherwise("")
    )


def matrix_json(matrix: Column) -> Column:
    """A matrix as JSON text (MTH-08)."""
    return F.to_json(matrix)


def matrix_of(text: Column) -> Column:
    """A matrix of JSON text (MTH-08)."""
    return F.from_json(text, "array<array<double>>")
