"""Whole runs with a stand-in for the generator."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from factloom.operators import batch, export, retrieve
from factloom.operators.run import Curation
from factloom.schema import SOURCE, Template

TABLE = Template("mutation", "resistance mutations", columns=("Organism", "Gene Name", "Mutation", "Phenotype", "Assertion", "Reference"))
PROSE = Template("summary", "summary", output="text")


@pytest.fixture(scope="module")
def passages(spark):
    meta = spark.createDataFrame([], SOURCE).schema["metadata"].dataType
    texts = {1: "alpha beta katG", 2: "alpha gamma katG " + "filler " * 3000, 3: "beta katG inhA", 4: "delta", 5: None}
    named = {"title": F.concat(F.lit("T"), "id"), "pmid": F.concat(F.lit("9"), "id"), "year": F.col("id") + 2000}
    metadata = F.struct(*[named.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in meta.fields])
    rows = spark.createDataFrame(list(texts.items()), "id int, content string")
    return rows.select(F.col("id").cast("string").alias("doc_id"), F.concat(F.lit("c"), "id").alias("chunk_id"), "content", F.lit("own").alias("collection"), metadata.alias("metadata"))


@pytest.fixture(scope="module")
def specs(spark):
    rows = [("a", 1, "alpha", "katG", "", 3, "own"), ("b", 2, "beta", "", "inhA", 2, "own"), ("c", 3, "nothing", "", "", 5, "own"), ("d", 4, "delta", "", "", 1, "own")]
    return spark.createDataFrame(rows, "query_id string, spec_ord bigint, organism string, genes string, other_terms string, top_k int, collection string")


def reads(prompt, most):
    if "delta" in prompt:
        raise batch.CallFailed("refused", 400)
    found = re.findall(r"^Source (\d+) \(T(\d+)\)", prompt, re.M)
    body = ["\t".join(("Org", "katG", f"S{d}T" if d != "1" else "Ser3Thr", "resistant", "measured", f"[{k}]")) for k, d in found]
    return {"text": "\n".join(["\t".join(TABLE.columns), *body]), "model": "m", "finish_reason": "stop"}


def test_table_run(specs, passages):
    run = Curation(TABLE, reads, window=9_000)
    sources = run.sources(specs, passages).collect()
    kept = {(r.query_id, r.source_rank): r.doc_id for r in sources}
    # The long passage doesn't fit behind the first one; what comes after it is cut as well.
    assert {q for q, _ in kept} == {"a", "b", "d"} and max(k for q, k in kept if q == "b") == 2
    assert all(len(r.block) <= 14_000 or r.source_rank == 1 for r in sources)
    rows, answers = run.rows(specs, passages)
    told = {r.query_id: r for r in answers.collect()}
    assert set(told) == {"a", "b", "d"} and told["d"].error == "CallFailed: refused" and told["d"].attempts == 1 and told["a"].error is None
    got = rows.collect()
    assert len(got) == sum(q != "d" for q, _ in kept)
    for r in got:
        place = int(re.findall(r"\d+", r["values"]["Reference"])[0])
        assert r.citations[0].pmid == "9" + kept[r.query_id, place] and r.citations[0].resolved
        assert (r["_model"], r["_template"], r["_top_k"], r["_generator"]) == ("m", "mutation", {"a": "3", "b": "2"}[r.query_id], "local") and len(r["_prompt_hash"]) == 16 and r["_retrieved_at"].endswith("Z")
    facts = {tuple(r.identity[2:]): r for r in run.facts(specs, passages).collect()}
    assert facts["katg", "S3T"].n_support == sum(r["values"]["Mutation"] in ("S3T", "Ser3Thr") for r in got)
    assert set(facts["katg", "S3T"].query_ids) == {r.query_id for r in got if r["values"]["Mutation"] in ("S3T", "Ser3Thr")}


def test_prose_run_with_filters(specs, passages):
    run = Curation(PROSE, lambda prompt, most: {"text": "Seen [1]." if "inhA" in prompt else "x", "model": "m"}, filters={"metadata.year": {"lte": 2003}}, known=retrieve.statistics(passages))
    rows, answers = run.rows(specs, passages)
    got = {r.query_id: r for r in rows.collect()}
    assert set(got) == {"a", "b"} and got["b"]["values"]["Answer"] == "Seen [1]." and [c.pmid for c in got["b"].citations] == ["93"]
    assert answers.count() == 2
    records = export.prose_records(rows).collect()
    assert len(records) == 2 and '"provenance"' in records[0].value


def test_no_specs_and_no_passages(specs, passages):
    run = Curation(TABLE, reads)
    assert run.facts(specs.limit(0), passages).count() == 0
    assert run.facts(specs, passages.limit(0)).count() == 0
