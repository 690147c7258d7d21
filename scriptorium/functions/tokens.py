"""Terms of texts and queries."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import MAX_QUERY_TERMS, MAX_QUERY_UNITS, MAX_TERM_UNITS, InputError
from .text import utf16_length

TERM = r"[\p{L}\p{N}_]+"
_CONTROL = re.compile(r"[\x00-\x1f\x7f]")

#: Text of these characters alone is its own NFKC form: ASCII and the Latin
#: letters without compatibility mappings, Greek and Cyrillic letters.
NFKC_STABLE = r"^[\x00-\x7F\xC0-\x{131}\x{134}-\x{13E}\x{141}-\x{148}\x{14A}-\x{17E}\x{391}-\x{3A1}\x{3A3}-\x{3C9}\x{400}-\x{45F}]*$"


@F.arrow_udf(T.StringType())
def nfkc(values: pa.Array) -> pa.Array:
    return pa.array([None if v is None else unicodedata.normalize("NFKC", v) for v in values.to_pylist()], pa.string())


def with_nfkc(df: DataFrame, column: str, out: str) -> DataFrame:
    """``df`` with the NFKC form of a column, in one pass.

    Spark has no such function.  Texts of characters that are their own form,
    most of all text, stay in the JVM and are nulls on the way through Arrow.
    """
    c = F.col(column)
    other = F.when(~F.coalesce(c.rlike(NFKC_STABLE), F.lit(True)), c)
    return df.withColumn(out, F.coalesce(nfkc(other), c))


def terms_of(normal: Column) -> Column:
    """Distinct terms of NFKC text in the order of first sight, without over-long ones."""
    short = lambda t: (F.char_length(t) <= MAX_TERM_UNITS // 2) | (utf16_length(t) <= MAX_TERM_UNITS)
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(normal), F.lit(TERM), F.lit(0)), short))


def _utf16(s: str) -> int:
    return len(s.encode("utf-16-be", "surrogatepass")) // 2


def query_terms(query: str) -> list[str]:
    """The terms of a query, checked before anything is planned."""
    if not isinstance(query, str) or not 1 <= _utf16(query) <= MAX_QUERY_UNITS or _CONTROL.search(query):
        raise InputError(f"a query has 1 to {MAX_QUERY_UNITS} characters and no control characters")
    text = unicodedata.normalize("NFKC", query).lower()
    # letters, numbers and the underscore; \w would add marks of some scripts
    found, at = [], ""
    for c in [*text, " "]:
        if c == "_" or unicodedata.category(c)[0] in "LN":
            at += c
        elif at:
            found.append(at)
            at = ""
    terms = list(dict.fromkeys(t for t in found if _utf16(t) <= MAX_TERM_UNITS))
    if not 1 <= len(terms) <= MAX_QUERY_TERMS:
        raise InputError(f"a query has 1 to {MAX_QUERY_TERMS} terms")
    return terms


def scan_query(query: str) -> str:
    """The lower-cased query of a substring search."""
    if not isinstance(query, str) or not query.strip() or _utf16(query) > MAX_QUERY_UNITS or _CONTROL.search(query):
        raise InputError(f"a query has 1 to {MAX_QUERY_UNITS} characters and no control characters")
    return query.lower()
