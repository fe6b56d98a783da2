"""Benchmark decontamination by one Aho-Corasick automaton over normalised items.

Texts and items are normalised alike: A-Z lower-cased, words taken, joined by one space.
Every window of WINDOW consecutive words of an item is a pattern; an item with fewer
words, but not none, is one pattern. The automaton holds each pattern once with the items
it belongs to, bounded by spaces, and a document's normalised text is scanned once. Hits
are mapped to words and, for the spans, to offsets in the original text.

The benchmark's patterns are broadcast in blocks of at most BLOCK_CHARS characters, and a
worker builds a block's automaton once, for all of its tasks. A larger benchmark is cut by items into several such blocks, each scanned in a pass of its
own, and the passes' hit words are united; results don't depend on the cut.

Edge cases: null and empty texts and items have no words and no hits; texts of any length
are scanned whole; equal items and repeated documents are judged one by one; null item
ids print as an empty string; empty tables give no rows or no hits; a column `found` is
replaced, all others pass through.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.session import ship_package

WINDOW = 10
#: Characters of patterns in one automaton (about 50 bytes of memory each).
BLOCK_CHARS = 4_000_000
#: Result of one scan: word count, hit word ranges, the ranges in the original, item ids.
SCAN = "n_words bigint, words array<struct<first:bigint,past:bigint>>, spans array<struct<start:bigint,end:bigint>>, items array<string>"

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_UPPER = re.compile("[A-Z]+")
#: Bytes to lower-cased word bytes or a space; bytes of other than ASCII characters stay.
_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """Normalised words, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def item_patterns(items: list[tuple[str, str | None]], window: int = WINDOW) -> dict[str, set[str]]:
    """Pattern (bytes as Latin-1, between spaces) to the ids of its items."""
    patterns: dict[str, set[str]] = {}
    for item, text in items:
        words = words_of(text)
        for i in range(max(1, len(words) - window + 1) if words else 0):
            key = b" %s " % b" ".join(words[i : i + window])
            patterns.setdefault(key.decode("latin-1"), set()).add(item)
    return patterns


def build(patterns: dict[str, set[str]]) -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for key, items in patterns.items():
        automaton.add_word(key, (len(key), sorted(items)))
    automaton.make_automaton()
    return automaton


def _merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for first, past in sorted(ranges):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], past)
        else:
            out.append([first, past])
    return [(a, b) for a, b in out]


def scan(text: str | None, automaton: ahocorasick.Automaton) -> tuple[int, list, list, list[str]]:
    """Word count, hit word ranges, the same in code points of the original, items."""
    words = words_of(text)
    if not words or not len(automaton):
        return len(words), [], [], []
    joined = b" %s " % b" ".join(words)
    hits = list(automaton.iter(joined.decode("latin-1")))
    if not hits:
        return len(words), [], [], []
    starts = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    ends = np.array([end for end, _ in hits])
    past = np.searchsorted(starts, ends)
    first = np.searchsorted(starts, ends - np.array([n for _, (n, _) in hits]) + 1)
    ranges = _merge(list(zip(first.tolist(), past.tolist(), strict=True)))
    at = [m.span() for m in _WORD.finditer(_UPPER.sub(lambda m: m[0].lower(), text))]
    spans = [(at[a][0], at[b - 1][1]) for a, b in ranges]
    return len(words), ranges, spans, sorted({i for _, (_, items) in hits for i in items})


def _blocks(items: list[tuple[str, str | None]], window: int, limit: int) -> Iterator[dict[str, set[str]]]:
    block: list[tuple[str, str | None]] = []
    size = 0
    for item in items:
        own = len(item[1] or "") * window
        if block and size + own > limit:
            yield item_patterns(block, window)
            block, size = [], 0
        block.append(item)
        size += own
    if block:
        yield item_patterns(block, window)


#: The automaton that this worker has built last, by its broadcast.
_built: dict[tuple, ahocorasick.Automaton] = {}


def _automaton(key: tuple, patterns: dict[str, set[str]]) -> ahocorasick.Automaton:
    if key not in _built:
        _built.clear()
        _built[key] = build(patterns)
    return _built[key]


def _scanned(df: DataFrame, text_col: str, patterns: dict[str, set[str]], column: str) -> DataFrame:
    ship_package(df.sparkSession)
    context = df.sparkSession.sparkContext
    shared = context.broadcast(patterns)  # at most BLOCK_CHARS
    key = (context.applicationId, uuid.uuid4().hex)

    @F.pandas_udf(SCAN)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = _automaton(key, shared.value)
        for texts in batches:
            rows = []
            for text in texts:
                n, words, spans, items = scan(text, automaton)
                rows.append((n, [{"first": a, "past": b} for a, b in words], [{"start": a, "end": b} for a, b in spans], items))
            yield pd.DataFrame(rows, columns=["n_words", "words", "spans", "items"])

    return df.withColumn(column, run(F.col(text_col)))


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", *, item_col: str = "item_id", item_text: str = "text",
    window: int = WINDOW, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """Adds `found`: n_words, n_hit, the hit spans in the original text and the items.

    The benchmark's items stream to the driver, which holds one block of them at a time.
    """
    rows = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("i"), F.col(item_text).alias("t"))
    out, columns = docs, []
    for k, patterns in enumerate(_blocks(((r.i, r.t) for r in rows.toLocalIterator()), window, block_chars)):
        columns.append("_".join([f"scan{k}", *docs.columns]))  # a name that no column has
        out = _scanned(out, text_col, patterns, columns[-1])
    if not columns:
        columns.append("_".join(["scan", *docs.columns]))
        out = _scanned(out, text_col, {}, columns[-1])
    if len(columns) == 1:
        scans = F.col(f"`{columns[0]}`")
        hits = F.aggregate(scans["words"], F.lit(0).cast("bigint"), lambda n, r: n + r["past"] - r["first"])
        found = F.struct(scans["n_words"].alias("n_words"), hits.alias("n_hit"), scans["spans"].alias("spans"), scans["items"].alias("items"))
    else:
        every = lambda name: F.flatten(F.array(*[F.col(f"`{c}`")[name] for c in columns]))
        covered = F.array_distinct(F.flatten(F.transform(every("words"), lambda r: F.sequence(r["first"], r["past"] - 1))))
        found = F.struct(
            F.col(f"`{columns[0]}`")["n_words"].alias("n_words"),
            F.size(covered).cast("bigint").alias("n_hit"),
            F.array_sort(F.array_distinct(every("spans"))).alias("spans"),
            F.array_sort(F.array_distinct(every("items"))).alias("items"),
        )
    return out.withColumn("found", found).drop(*columns)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents without any hit, with their own columns, whatever their names."""
    own = [f"own{i}" for i in range(len(docs.columns))]
    found = find_contamination(docs.toDF(*own), benchmark, own[docs.columns.index(text_col)], **options)
    return found.filter("found.n_hit = 0").select(*own).toDF(*docs.columns)


def digest_columns(found: DataFrame) -> DataFrame:
    items = F.col("found.items")
    return found.select(
        "doc_id",
        F.col("found.n_words").alias("n_words"),
        F.col("found.n_hit").alias("n_hit"),
        F.size(items).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (F.col("found.n_hit") > 0).alias("contaminated"),
    )


def items_digest(items: list[str]) -> str:
    """The same digest in Python, for tests."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
