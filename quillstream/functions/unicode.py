"""Unicode normal forms and spoken numbers, as Arrow functions (STR-02, STR-20..22, STR-24)."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_UNITS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
_SCALES = ((10**18, "quintillion"), (10**15, "quadrillion"), (10**12, "trillion"), (10**9, "billion"), (10**6, "million"), (10**3, "thousand"), (100, "hundred"))


def _mapped(name: str, fn):
    """Arrow function that applies fn to each distinct text of a batch once; NULL stays NULL."""

    @F.arrow_udf(T.StringType())
    def run(text: pa.Array) -> pa.Array:
        coded = text.dictionary_encode()
        out = pa.array([None if x is None else fn(x) for x in coded.dictionary.to_pylist()], pa.string())
        return out.take(coded.indices)

    run.__name__ = name
    return run


_FORMS = {f: _mapped(f.lower(), lambda x, f=f: unicodedata.normalize(f, x)) for f in ("NFC", "NFD", "NFKC", "NFKD")}


def normal_form(text: Column, form: str = "NFC") -> Column:
    return _FORMS[form](text)


def strip_marks(text: Column) -> Column:
    """Without combining marks U+0300 to U+036F, by compatibility decomposition."""
    return F.regexp_replace(normal_form(text, "NFKD"), r"[\x{0300}-\x{036F}]", "")


def spoken(n: int) -> str:
    """A whole number in English words."""
    if n < 0:
        return "minus " + spoken(-n)
    if n < 20:
        return _UNITS[n]
    if n < 100:
        return _TENS[n // 10 - 2] + ("-" + _UNITS[n % 10] if n % 10 else "")
    for size, name in _SCALES:
        if n >= size:
            rest = n % size
            return f"{spoken(n // size)} {name}" + (f" {spoken(rest)}" if rest else "")
    raise ValueError(n)


def _number_words(word: str) -> str:
    if not re.fullmatch(r"[0-9.,:\-]+", word):
        return word
    digits = re.sub(r"[.,:]", "", word)
    n = int(digits) if re.fullmatch(r"-?[0-9]{1,19}", digits) else 0
    return spoken(n if -(2**63) <= n < 2**63 else 0)


_NUMBERS = _mapped("number_words", _number_words)


def number_words(word: Column) -> Column:
    """Words made of digits and . , : - as spoken numbers; others as they are. What isn't a whole number of 64 bits after all is zero."""
    return _NUMBERS(word)


def romanised(text: Column) -> Column:
    """Stand-in for a romanisation program: decomposed, marks stripped, lower case."""
    return F.lower(strip_marks(text))
