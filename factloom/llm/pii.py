"""Personal data in whole texts, plain and disguised, with offsets into the source.

Plain identifiers are found leftmost and non-overlapping for each kind; a match that fails
its check is dropped and not tried again. Then transducers rewrite disguises: homoglyphs
and wide or invisible characters to ASCII, "[at]" and "dot" spellings to their signs, and
runs of spelled digits to digits. Each rewriting step keeps its segments, so spans found
in the rewritten text are mapped back to the source; those that meet no plain span are
added.

Offsets are code points, ends exclusive. Null counts as empty; empty and very long texts
are handled by scans whose time is linear in the text; repeated rows are searched one by
one; empty tables give empty results; other columns pass through.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.session import ship_package

KINDS = ("email", "ip", "card", "phone")
SPANS = "array<struct<kind:string,start:int,end:int,disguised:boolean>>"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[0-9]+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        n = int(digit) * (1 + place % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each "@" leftwards: the pattern can only match with its local part's run."""
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            floor = found.end()
            yield start, floor
        at = text.find("@", found.end() if found else at + 1)


def _numbers(text: str, pattern: re.Pattern) -> Iterator[re.Match]:
    """Leftmost matches of a pattern that starts with a run of digits."""
    floor = 0
    for run in _DIGITS.finditer(text):
        if run.start() >= floor and (found := pattern.match(text, run.start())):
            floor = found.end()
            yield found


def plain_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) by start, then kind."""
    out = [(a, 0, b) for a, b in _emails(text)]
    if _DIGITS.search(text):
        for m in _numbers(text, _IP):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _numbers(text, _CARD):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    out.sort()
    return out


#: Letters of other scripts that look like ASCII ones, and what they stand for.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s",
    "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X",
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "τ": "t", "ι": "i", "κ": "k", "υ": "u", "χ": "x",
    "Α": "A", "Β": "B", "Ε": "E", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Χ": "X",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "․": ".", "。": ".", "·": ".",
}
#: Characters without width.
INVISIBLE = "­​‌‍⁠﻿"

#: Digits in words.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}

_EXOTIC = re.compile("[­Ͱ-\U0010ffff]")
_BRACKETED = re.compile(
    r"(?:(?<![ \t])[ \t]*|(?<=[ \t]))[\[({<][ \t]*(?:(?P<at>at|@|arroba)|(?P<dot>dot|\.|punkt|point|punto))[ \t]*[\])}>][ \t]*", re.I
)
_BARE = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+(?:[ \t]+(?:dot|punkt|punto)[ \t]+[A-Za-z0-9_%+-]+){0,3}(?P<at>[ \t]+(?:at|arroba)[ \t]+)"
    r"[A-Za-z0-9-]+(?:[ \t]+(?:dot|punkt|punto)[ \t]+[A-Za-z0-9-]+|\.[A-Za-z0-9-]+)+", re.I
)
_BARE_DOT = re.compile(r"(?<![ \t])[ \t]+(?:dot|punkt|punto)[ \t]+", re.I)
#: Top-level labels that a bare "at" leads to: common ones, chosen here, not the registry's list.
TOP_LEVEL = frozenset(
    "com net org edu gov mil int info biz io co uk de fr es it nl eu us ca au nz jp cn kr in ru ua br mx ar cl ch at be se no dk fi pl cz pt gr ie tr me tv dev app ai example test".split()
)
#: A local part that prose doesn't have: letters around a dot or an underscore, with two at least on one side.
_USER_NAME = re.compile(r"[A-Za-z]{2}[0-9]*[._][A-Za-z]|[A-Za-z][._][A-Za-z]{2}|[A-Za-z0-9]_[A-Za-z0-9]")
#: What stands before "at" in prose, even where the dot is spelled; chosen here.
_NO_NAME = frozenset(
    "us me you it him her them this that these those is are was were be been am available accessible open live online here there home found find visit see look located hosted published "
    "posted listed based shop store work works working worked founder office more and or but only just still down up starts start started ends end sold buy meet stay ask call order register".split()
)
#: A domain after a sign that is there already.
_DOTTED = re.compile(r"(?<=@)[A-Za-z0-9-]+(?:[ \t]+(?:dot|punkt|punto)[ \t]+[A-Za-z0-9-]+|\.[A-Za-z0-9-]+)+", re.I)
_WORD = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_DIGIT = rf"(?:{_WORD}|[0-9]+)"
_DOT = r"(?:dot|punkt|punto)"
#: Digits, digit words and dots between them, of which one at least is a word.
_SPELLED = re.compile(
    rf"(?<![^\W_])(?:(?P<plus>plus)[ \t,-]{{1,3}}|(?<=\+))?{_DIGIT}(?:[ \t,-]{{1,3}}(?:{_DOT}[ \t,-]{{1,3}})?{_DIGIT}(?![^\W_]))+", re.I
)
_HAS_WORD = re.compile(rf"(?<![^\W_])(?:{_WORD}|{_DOT}|plus)(?![^\W_])", re.I)
_SPELLED_PART = re.compile(rf"plus|{_WORD}|[0-9]+|dot|punkt|punto", re.I)


class Rewritten:
    """A rewritten text; each segment knows the source's span it came from."""

    def __init__(self, text: str, edits: list[tuple[int, int, str]]):
        self.at: list[int] = []
        self.source: list[tuple[int, int, bool]] = []
        out, here, length = [], 0, 0
        for start, end, new in [*edits, (len(text), len(text), "")]:
            for a, b, piece, kept in ((here, start, text[here:start], True), (start, end, new, False)):
                if b > a:
                    self.at.append(length)
                    self.source.append((a, b, kept))
                    out.append(piece)
                    length += len(piece)
            here = end
        self.text = "".join(out)

    def span(self, start: int, end: int) -> tuple[int, int]:
        """The source's span; a rewritten segment counts as a whole."""
        i = bisect_right(self.at, start) - 1
        a, _, plain = self.source[i]
        first = a + start - self.at[i] if plain else a
        j = bisect_right(self.at, end - 1) - 1
        a, b, plain = self.source[j]
        last = a + end - self.at[j] if plain else b
        return first, last


def _fold(text: str) -> list[tuple[int, int, str]]:
    edits = []
    for m in _EXOTIC.finditer(text):
        c = m[0]
        new = "" if c in INVISIBLE else HOMOGLYPHS.get(c)
        if new is None:
            wide = unicodedata.normalize("NFKC", c)
            new = wide if len(wide) == 1 and wide.isascii() else str(unicodedata.digit(c, "")) or None
        if new is not None:
            edits.append((m.start(), m.end(), new))
    return edits


def _signs(text: str) -> list[tuple[int, int, str]]:
    edits = [(m.start(), m.end(), "@" if m["at"] else ".") for m in _BRACKETED.finditer(text)]
    return edits


def _bare(text: str) -> list[tuple[int, int, str]]:
    edits = []
    for m in _BARE.finditer(text):
        local, domain = text[m.start() : m.start("at")], text[m.end("at") : m.end()]
        labels = re.split(r"[.\s]", domain.lower())
        if labels[-1] not in TOP_LEVEL or _prose(local.strip(" \t."), bool(_BARE_DOT.search(domain))):
            continue
        edits.append((m.start("at"), m.end("at"), "@"))
        edits += [(d.start(), d.end(), ".") for d in _BARE_DOT.finditer(text, m.start(), m.end())]
    for m in _DOTTED.finditer(text):
        edits += [(d.start(), d.end(), ".") for d in _BARE_DOT.finditer(text, m.start(), m.end())]
    return sorted(set(edits))


def _prose(local: str, spelled: bool) -> bool:
    """Whether what stands before a bare "at" is a word, a number or a site's name, not a mailbox.

    spelled: whether the domain's dot is a word; then a plain name will do.
    """
    if _USER_NAME.search(local):
        return local.lower().rsplit(".", 1)[-1] in TOP_LEVEL
    if not spelled and not _BARE_DOT.search(local):
        return True
    return not re.search("[A-Za-z]", local) or "-" in local or local.lower() in _NO_NAME


def _spelled(text: str) -> list[tuple[int, int, str]]:
    edits = []
    for m in _SPELLED.finditer(text):
        if not _HAS_WORD.search(m[0]):
            continue
        before = None
        for part in _SPELLED_PART.finditer(text, m.start(), m.end()):
            said = part[0].lower()
            # Groups of plain digits stay apart; what meets a word is joined.
            if before and not (before[0].isdigit() and said.isdigit()):
                edits.append((before.end(), part.start(), ""))
            if not said.isdigit():
                edits.append((*part.span(), "+" if said == "plus" else "." if said in ("dot", "punkt", "punto") else DIGIT_WORDS[said]))
            before = part
    return edits


_BRACKET = re.compile(r"[\[({<][ \t]*(?:at|@|arroba|dot|\.|punkt|point|punto)[ \t]*[\])}>]", re.I)
_DOT_WORD = re.compile(r"[ \t](?:dot|punkt|punto|at|arroba)[ \t]", re.I)


def disguised_spans(text: str, plain: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of disguised identifiers in the source that meet no plain span."""
    steps: list[Rewritten] = []
    current = text
    for rewrite, trigger in ((_fold, _EXOTIC), (_signs, _BRACKET), (_bare, _DOT_WORD), (_spelled, _HAS_WORD)):
        if trigger.search(current) and (edits := rewrite(current)):
            steps.append(Rewritten(current, edits))
            current = steps[-1].text
    if not steps:
        return []
    starts, ends = [a for a, _, _ in plain], list(accumulate((b for _, _, b in plain), max))
    out = []
    for start, kind, end in plain_spans(current):
        for step in reversed(steps):
            start, end = step.span(start, end)
        before = bisect_left(starts, end)  # plain spans that start before this one ends
        if not before or ends[before - 1] <= start:
            out.append((start, kind, end))
    return out


def all_spans(text: str | None) -> list[tuple[str, int, int, bool]]:
    """kind, start, end, disguised; by start, then kind as listed."""
    text = text or ""
    plain = plain_spans(text)
    found = [(a, k, b, False) for a, k, b in plain] + [(a, k, b, True) for a, k, b in disguised_spans(text, plain)]
    return [(KINDS[k], a, b, d) for a, k, b, d in sorted(found)]


def find_pii(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the array `pii` of the spans of every whole text."""
    ship_package(df.sparkSession)

    @F.pandas_udf(SPANS)
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[{"kind": k, "start": a, "end": b, "disguised": d} for k, a, b, d in all_spans(x)] for x in texts])

    return df.withColumn("pii", spans(F.col(text_col)))


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Replaces each span by its kind in brackets."""
    ship_package(df.sparkSession)

    @F.pandas_udf("string")
    def masked(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([None if x is None else _masked(x) for x in texts])

    return df.withColumn(text_col, masked(F.col(text_col)))


def _masked(text: str) -> str:
    out, here = [], 0
    for kind, start, end, _ in all_spans(text):
        if start >= here:
            out += [text[here:start], f"[{kind}]"]
        here = max(here, end)
    return "".join([*out, text[here:]])


def digest_columns(found: DataFrame) -> DataFrame:
    """doc_id, base counts, the digest of the base spans and all spans as text."""
    base = F.filter("pii", lambda s: ~s["disguised"])
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of_kind = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("bigint")
    counts = [of_kind(kind).alias(f"n_{kind}") for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(said(base), 256).alias("base_sha256"), said(F.col("pii")).alias("spans"))


def digest(text: str) -> str:
    """The same digest in Python, for tests."""
    return hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in plain_spans(text)).encode()).hexdigest()
