"""Null ids, repeated rows, null and empty texts and extra columns through every operator."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from factloom.llm import packing, pii, simhash, tokens, toxicity, url_filter, warc

TEXTS = ["one two three four five", "one two three four five", None, "", "write to jane@example.com", "one two three four six"]
IDS = [1, 1, None, None, 5, 6]


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame(list(zip(IDS, TEXTS, strict=True)), "doc_id long, text string")
    return rows.withColumns({c: F.concat(F.lit(c), F.coalesce("doc_id", F.lit(0))) for c in ("_row", "piece", "fp", "_spans", "n", "key", "lang", "source")}).withColumn("n_chars", F.lit(1))


def kept(df, *columns):
    return sorted(tuple(str(r[c]) for c in columns) for r in df.collect())


def test_urls(spark):
    urls = ["https://a.com/x", "https://a.com/x", None, "", "http://xxx.com/"]
    pages = spark.createDataFrame(list(zip([1, 1, None, None, 5], urls, strict=True)), "page_id long, url string").withColumn("_own", F.lit("own"))
    got = url_filter.filter_urls(pages, rules=())
    assert kept(got, "page_id", "verdict", "_own") == sorted([("1", "allow", "own")] * 2 + [("None", "allow", "own")] * 2 + [("5", "block", "own")])


def test_packing(docs):
    packed = packing.pack(packing.pieces_of(docs, tokens.vocabulary())).collect()
    assert sorted(str(r.doc_id) for r in packed) == sorted(map(str, IDS)) and all(r.piece == 0 for r in packed)
    assert sorted(r.offset for r in packed)[0] == 0 and len({(r.sequence_id, r.offset) for r in packed}) == len(packed)


def test_groups(docs):
    got = simhash.group_documents(docs)
    assert kept(got, "doc_id") == sorted((str(i),) for i in IDS)
    by_id = {}
    for r in got.collect():
        by_id.setdefault(r.doc_id, set()).add((r.fp, r.component_id))
    assert len(by_id[1]) == 1  # the repeated row is judged as its twin


def test_counts_and_spans(docs):
    counted = tokens.count_tokens(docs, tokens.vocabulary())
    assert kept(counted, "doc_id", "n_bytes", "_row") == sorted((str(i), str(len((t or "").encode())), f"_row{i or 0}") for i, t in zip(IDS, TEXTS, strict=True))
    assert sorted(len(r.pii) for r in pii.find_pii(docs).collect()) == [0, 0, 0, 0, 0, 1]
    assert sorted(str(r.text) for r in pii.redact(docs).collect())[-1] == "write to [email]"


def test_toxicity(spark, docs):
    labels = spark.createDataFrame([(1, 1), (1, 1), (6, 0), (None, 1), (5, None), (99, 0)], "doc_id long, toxic int")
    for own in (toxicity.fit(docs, labels), toxicity.Model()):
        assert kept(toxicity.score_documents(docs, own), "doc_id", "_row") == sorted((str(i), f"_row{i or 0}") for i in IDS)
    stays = toxicity.drop_toxic(docs, labels.limit(0))
    assert stays.columns == docs.columns and stays.count() == len(IDS)


def test_archives(spark):
    pages = spark.createDataFrame(list(zip([1, 1, None, None, 5], ["a", "a", None, "", "b"], strict=True)), "page_id long, html string").withColumns({"url": F.lit(None).cast("string"), "payload": F.lit("own")})
    got = warc.round_trip(pages).collect()
    assert sorted((str(r.page_id), r.payload_bytes) for r in got) == sorted([("1", 1), ("1", 1), ("None", 0), ("None", 0), ("5", 1)])
    assert sorted(r.record_type for r in got) == ["response"] * 3 + ["revisit"] * 2
