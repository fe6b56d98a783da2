"""Columns that operators might use themselves come out as they went in."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.llm.decontamination import decontaminate
from factloom.llm.exact_dedup import deduplicate
from factloom.llm.sharding import shard_rows
from factloom.llm.simhash import drop_near_duplicates

NAMES = ("_row", "_part", "_order", "_range", "_unique", "_pair", "_text", "found", "_scan0", "toxic", "own0", "n", "key")


def test_input_columns_pass_through(spark):
    # A null id, a repeated row, a null and an empty text.
    rows = [(1, "one two three four five six"), (1, "one two three four five six"), (None, "another text of some words here"), (4, None), (5, ""), (6, "the quick brown fox jumps")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.concat(F.lit(c), F.coalesce("doc_id", F.lit(0))) for c in NAMES})
    bench = spark.createDataFrame([(1, "the quick brown fox")], "item_id long, text string")
    given = {tuple(r) for r in docs.collect()}
    ids = lambda df: sorted((r.doc_id or 0) for r in df.collect())
    for made, kept in ((decontaminate(docs, bench), [0, 1, 1, 4, 5]), (deduplicate(docs), [0, 1, 4, 6]), (drop_near_duplicates(docs), [0, 1, 4, 6])):
        assert made.columns == docs.columns
        assert {tuple(r) for r in made.collect()} <= given
        assert ids(made) == kept
    dealt = shard_rows(docs.withColumn("shard", F.lit("own")), 2)
    assert dealt.columns == [*docs.columns, "shard", "slot"]
    assert ids(dealt) == [0, 1, 1, 4, 5, 6] and {tuple(r)[:-2] for r in dealt.collect()} == given
