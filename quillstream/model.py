"""The fixed data model: schemas, book order and key checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.operators.versions import current_rows
from quillstream.runtime import table

SCHEMAS = {
    "ident": "dataset_id long, bible_id string, audio_ot_id string, audio_nt_id string, text_ot_id string, text_nt_id string, text_source string, language_iso string, asr_language_iso string, version_code string, language_id int, rolv_id int, alphabet string, language_name string, version_name string",
    "scripts": "script_id long, dataset_id long, book_id string, chapter_num int, chapter_end int, verse_str string, verse_end string, verse_num int, audio_file string, script_num string, usfm_style string, person string, actor string, script_text string, uroman string, script_begin_ts double, script_end_ts double, fa_score double",
    "words": "word_id long, script_id long, word_seq int, verse_num int, ttype string, word string, uroman string, word_begin_ts double, word_end_ts double, fa_score double, word_enc array<double>",
    "chars": "char_id long, word_id long, seq int, uroman string, start_ts double, end_ts double, fa_score double",
    "script_mfcc": "script_id long, n_rows int, n_cols int, mfcc array<array<float>>",
    "word_mfcc": "word_id long, n_rows int, n_cols int, mfcc array<array<float>>",
    "languages": "id string, family_id string, parent_id string, lang_name string, bookkeeping boolean, node_kind string, iso639_3 string, country_ids string, iso639_1 string, espeak string, mms_asr string, mms_lid string, mms_tts string, whisper string",
    "books": "seq int, book_id string, testament string, chapters int",
}
KEYS = {
    "ident": [["dataset_id"], ["bible_id"]],
    "scripts": [["script_id"], ["dataset_id", "book_id", "chapter_num", "verse_str"]],
    "words": [["word_id"], ["script_id", "word_seq"]],
    "chars": [["char_id"]],
}

_LINE_COLUMNS = ["dataset_id", "book_id", "chapter_num", "chapter_end", "verse_str", "verse_end", "verse_num", "audio_file", "script_num", "usfm_style", "person", "actor", "script_text", "uroman", "script_begin_ts", "script_end_ts", "fa_score"]
_WORD_COLUMNS = ["dataset_id", "script_id", "word_seq", "verse_num", "ttype", "word", "uroman", "word_begin_ts", "word_end_ts", "fa_score"]
_CHAR_COLUMNS = ["word_id", "seq", "uroman", "start_ts", "end_ts", "fa_score"]


def empty(spark: SparkSession, name: str) -> DataFrame:
    """An empty table of the model."""
    return spark.createDataFrame([], SCHEMAS[name])


def lines(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Current lines with script_id and the columns asked for."""
    return current_rows(table(spark, sf_dir, "scripts"), "script_id", list(columns or _LINE_COLUMNS))


def tokens(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Current tokens with word_id and the columns asked for."""
    return current_rows(table(spark, sf_dir, "words"), "word_id", list(columns or _WORD_COLUMNS))


def letters(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Current aligned letters with char_id and the columns asked for."""
    return current_rows(table(spark, sf_dir, "chars"), "char_id", list(columns or _CHAR_COLUMNS), deleted_at=None)


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current feature matrices of words."""
    return current_rows(table(spark, sf_dir, "word_mfcc"), "word_id", ["n_rows", "n_cols", "mfcc"], deleted_at=None)


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values held by more than one row, with n_rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")


def known(ts: Column) -> Column:
    """A time or score that is known: not NULL, not NaN and not 0."""
    return ts.isNotNull() & ~F.isnan(ts) & (ts != 0)
