"""Queries of problem 8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.llm.languages import fit_on, identify_languages, label_codes
from quillstream.runtime import table


def _stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = label_codes(spark, table(spark, sf_dir, "languages"))
    return identify_languages(table(spark, sf_dir, "documents"), fit_on(table(spark, sf_dir, "lang_samples")), codes=codes)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stretches(spark, sf_dir).filter((F.col("label_state") != "right") | (F.col("n_segments") > 1)).select("doc_id", "seg_no", "lang")


def p8_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's stretches with their confidence."""
    return _stretches(spark, sf_dir)


QUERIES = {"p8_found": p8_found, "p8_stretches": p8_stretches}
ORACLE: dict[str, str] = {}
