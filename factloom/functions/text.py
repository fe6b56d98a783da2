"""Text cleaning as Column builders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.vocab import NULL_TOKENS, RESCUED_SYMBOLS

#: White space for a class: Unicode's, and the separators \\x1c to \\x1f.
SPACES = "\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
SPACE = f"[{SPACES}]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def collapse(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), SPACE, " "))


def is_null(value: Column) -> Column:
    return F.lower(collapse(value)).isin(*NULL_TOKENS)


def clean(value: Column) -> Column:
    """White space collapsed; every null spelling is an empty string."""
    return let(collapse(value), lambda v: F.when(F.lower(v).isin(*NULL_TOKENS), "").otherwise(v))


def clean_symbol(value: Column) -> Column:
    """As clean, but the bare symbols NA and ND stay."""
    gone = [t for t in NULL_TOKENS if t not in RESCUED_SYMBOLS]
    return let(collapse(value), lambda v: F.when(F.lower(v).isin(*gone), "").otherwise(v))


def normalize_text(value: Column) -> Column:
    """Key that ignores case and punctuation."""
    words = F.translate(F.lower(clean(value)), "_-", "  ")
    return collapse(F.regexp_replace(words, "(?U)[^\\w\\s]", ""))


def clean_title(value: Column) -> Column:
    """Tags stripped, white space collapsed."""
    return collapse(F.regexp_replace(F.coalesce(value, F.lit("")), "<[^>]+>", ""))


def escape_html(value: Column) -> Column:
    out = F.coalesce(value, F.lit(""))
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(sign), F.lit(entity))
    return out
