"""Text functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns of tokens and of cleanup.
TOKEN = r"(?s)\{\d+\}(?:_\{\d+\})*|[\p{L}\p{N}]+(?:[^\p{L}\p{N}\s{][\p{L}\p{N}]+)*|\s+|."
PROMPTS = r"<<|>>|\(\(|[†\[\]<>]"
PUNCTUATION = r"[,;:.!?~]"
DOUBLE_QUOTES = r"[\"“”«»]"
APOSTROPHES = r"['ꞌ‘’]"
HYPHENS = r"[-‐‑‒–—―﹘﹢﹣－]"
MARKER = r"\{[0-9\-,]+\}\s?"
SAME_APOSTROPHE = "ꞌ‘’ʼ′´"
SAME_HYPHEN = "‐‑‒–—―﹘﹢﹣－"
OPENING = "([‘“‹«"
CLOSING = "?.,:;)]’”„›»"


def cleanup(text: Column, *, prompts: bool = True, punctuation: bool = True, double_quotes: str = "remove", apostrophes: str = "remove", hyphens: str = "remove", lower: bool = True) -> Column:
    """Comparable text: marks removed in one pass, quotes, apostrophes and hyphens removed, kept or made one (``normalize``), lower case (STR-01, STR-02)."""
    drop = [p for p, on in ((PROMPTS, prompts), (PUNCTUATION, punctuation), (DOUBLE_QUOTES, double_quotes == "remove"), (APOSTROPHES, apostrophes == "remove"), (HYPHENS, hyphens == "remove")) if on]
    out = F.regexp_replace(text, "|".join(drop), "") if drop else text
    old, new = "", ""
    if double_quotes == "normalize":
        old, new = old + "«", new + '"'
    if apostrophes == "normalize":
        old, new = old + SAME_APOSTROPHE, new + "'" * len(SAME_APOSTROPHE)
    if hyphens == "normalize":
        old, new = old + SAME_HYPHEN, new + "-" * len(SAME_HYPHEN)
    if old:
        out = F.translate(out, old, new)
    return F.lower(out) if lower else out


def without_markers(text: Column) -> Column:
    """Text without ``{n}`` verse markers (STR-03)."""
    return F.regexp_replace(text, MARKER, "")


def token_list(text: Column) -> Column:
    """Words, spaces, punctuation and verse markers in order; together they are the text (STR-09)."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def token_type(token: Column) -> Column:
    """V verse marker, S space, W word or P punctuation."""
    return (
        F.when(token.startswith("{") & (F.length(token) > 1), "V")
        .when(F.regexp_like(token, F.lit(r"^\s")), "S")
        .when(F.regexp_like(token, F.lit(r"^[\p{L}\p{N}]")), "W")
        .otherwise("P")
    )


def leading_int(text: Column) -> Column:
    """The digits a text begins with as a number; 0 if there are none (STR-12, PRJ-32)."""
    return F.coalesce(F.regexp_extract(text, r"^[0-9]+", 0).try_cast("int"), F.lit(0))


def zero_fill(text: Column, width: int = 5) -> Column:
    """Left-padded so that the leading digits have ``width`` places; a suffix isn't counted (STR-13)."""
    digits = F.length(F.regexp_extract(text, r"^[0-9]*", 0))
    return F.concat(F.repeat(F.lit("0"), F.greatest(F.lit(width) - digits, F.lit(0))), text)


def verse_range(text: Column) -> Column:
    """``a-b`` as struct<begin, end>; without a hyphen both are the text (STR-14)."""
    parts = F.split(text, "-", 2)
    return F.struct(parts[0].alias("begin"), F.element_at(parts, -1).alias("end"))


def reference(book: Column, chapter: Column, verse: Column, chapter_end: Column | None = None, verse_end: Column | None = None) -> Column:
    """``BOOK``, ``BOOK c``, ``BOOK c:v``, ``BOOK c:v-w`` or ``BOOK c:v-d:w`` (STR-15, STR-16, STR-18)."""
    none = F.lit(None).cast("string")
    start = F.when(F.coalesce(chapter, F.lit(0)) == 0, book).when(F.coalesce(verse, F.lit("")) == "", F.concat_ws(" ", book, chapter)).otherwise(F.concat(book, F.lit(" "), chapter.cast("string"), F.lit(":"), verse))
    if verse_end is None or chapter_end is None:
        return start
    far = (F.coalesce(chapter_end, F.lit(0)) != 0) & (chapter_end != chapter)
    tail = F.when(F.coalesce(verse_end, F.lit("")) == "", none).when(far, F.concat(F.lit("-"), chapter_end.cast("string"), F.lit(":"), verse_end)).when(verse_end != verse, F.concat(F.lit("-"), verse_end))
    return F.concat(start, F.coalesce(tail, F.lit("")))


def parse_reference(text: Column) -> Column:
    """struct<book_id, chapter_num, verse_str, chapter_end, verse_end> of a reference text (STR-17); ends default to the begin."""
    pattern = r"^(\S+)(?: (\d+)(?::([^-\s]+)(?:-(?:(\d+):)?(\S+))?)?)?$"
    part = lambda i: F.regexp_extract(text, pattern, i)
    filled = lambda x, other: F.when(x == "", other).otherwise(x)
    number = lambda x: F.coalesce(x.try_cast("int"), F.lit(0))
    return F.struct(
        part(1).alias("book_id"), number(part(2)).alias("chapter_num"), part(3).alias("verse_str"),
        number(filled(part(4), part(2))).alias("chapter_end"), filled(part(5), part(3)).alias("verse_end"),
    )


def smart_join(parts: Column) -> Column:
    """An array of texts joined, with a space between two unless one is there or punctuation forbids it; empty parts count for nothing (STR-05, STR-11)."""
    last = lambda a: F.substring(a, -1, 1)
    tight_left = lambda a: F.regexp_like(last(a), F.lit(r"\s")) | F.lit(OPENING).contains(last(a))
    first = lambda x: F.substring(x, 1, 1)
    tight_right = lambda x: F.regexp_like(first(x), F.lit(r"\s")) | F.lit(CLOSING).contains(first(x))
    step = lambda a, x: F.when(F.coalesce(x, F.lit("")) == "", a).when(a == "", x).when(tight_left(a) | tight_right(x), F.concat(a, x)).otherwise(F.concat(a, F.lit(" "), x))
    return F.aggregate(parts, F.lit(""), step)


def versify(text: Column) -> Column:
    """array<struct<verse, text>> of a text with ``{n}`` or ``{n}_{m}`` markers; what precedes the first marker is verse 0 (STR-06, STR-07)."""
    marks = F.regexp_extract_all(text, F.lit(r"\{\d+\}(?:[_-]\{\d+\})*"), F.lit(0))
    parts = F.split(text, r"\{\d+\}(?:[_-]\{\d+\})*")
    name = lambda m: F.regexp_replace(F.regexp_replace(m, r"\}[_-]\{", "-"), r"[{}]", "")
    verses = F.zip_with(F.concat(F.array(F.lit("{0}")), marks), parts, lambda m, p: F.struct(name(m).alias("verse"), F.trim(p).alias("text")))
    return F.filter(verses, lambda v: (v["text"] != "") | (v["verse"] != "0"))


def only_letters(text: Column) -> Column:
    """Lower case a-z and apostrophes, other characters to one space (STR-19, STR-23)."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.translate(text, "’", "'")), "[^a-z' ]", " "), " +", " "))


def spaced(text: Column) -> Column:
    """Characters with a space between them (STR-23)."""
    return F.array_join(F.split(text, ""), " ")


def spelled(word: Column, sign: str) -> Column:
    """``+w+o+r+d``: each character after a sign (PRJ-14, DIF-09)."""
    return F.when(F.length(word) > 0, F.concat(F.lit(sign), F.array_join(F.split(word, ""), sign))).otherwise("")


def clock(seconds: Column, lead_in: float = 0.5) -> Column:
    """``m:ss`` of a place in a recording, a little before it; seconds aren't padded (DTM-01)."""
    x = F.greatest(seconds - F.lit(lead_in), F.lit(0.0))
    return F.concat(F.floor(x / 60).cast("string"), F.lit(":"), F.floor(x % 60).cast("string"))


def log_seconds(text: Column) -> Column:
    """Seconds of the last ``time=HH:MM:SS.ff`` in a log; NULL if there is none (DTM-02)."""
    found = F.regexp_extract_all(text, F.lit(r"time=(\d+:\d\d:\d\d(?:\.\d+)?)"), F.lit(1))
    parts = F.split(F.try_element_at(found, F.lit(-1)), ":")
    return F.when(F.size(found) > 0, parts[0].cast("double") * 3600 + parts[1].cast("double") * 60 + parts[2].cast("double"))


def media_type(name: Column) -> Column:
    """Kind of a source file by name, first rule that fits (STR-25)."""
    low = F.lower(name)
    return (
        F.when(low.endswith(".mp3") | low.endswith(".wav") | low.endswith(".opus") | low.endswith(".m4a"), "audio")
        .when(low.endswith(".usx"), "text_usx").when(low.endswith(".usfm") | low.endswith(".sfm"), "text_usfm")
        .when(low.endswith(".xlsx") | low.endswith(".xlsm"), "text_script").when(low.endswith(".csv"), "text_csv")
        .when(low.endswith(".json"), "text_plain").otherwise("unknown")
    )


def audio_name(name: Column) -> Column:
    """struct<testament, book_number, chapter, media_id> of a file name such as ``B01___03_XXXN1DA.mp3`` (STR-26, STR-27)."""
    p = r"^([AB])(\d{2})_+(\d+)_+.*?([A-Za-z0-9]+)\.\w+$"
    return F.struct(
        F.when(F.regexp_extract(name, p, 1) == "A", "OT").when(F.regexp_extract(name, p, 1) == "B", "NT").alias("testament"),
        F.regexp_extract(name, p, 2).try_cast("int").alias("book_number"),
        F.regexp_extract(name, p, 3).try_cast("int").alias("chapter"),
        F.regexp_extract(name, p, 4).alias("media_id"),
    )


def marker_errors(text: Column) -> Column:
    """The braces of a text that belong to no verse marker, as a text; '' if all do (STR-10)."""
    return F.regexp_replace(F.regexp_replace(text, r"\{\d+(?:-\d+)?\}(?:_\{\d+\})*", ""), r"[^{}]+", "")
