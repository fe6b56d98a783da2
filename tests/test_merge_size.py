"""Merging and exporting where facts have very many rows and queries."""

from __future__ import annotations

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from factloom.functions.normalize import expand_mutation, normalize_mutation, own_gene
from factloom.operators import export, merge, run, score
from factloom.schema import METADATA, Template
from tests.test_streams import COLUMNS, SCHEMA, claims


def test_pages_hold_all_query_ids_in_order(spark, monkeypatch):
    monkeypatch.setattr(export, "PAGE", 3)
    rows = spark.createDataFrame(claims(60), SCHEMA)
    told = [json.loads(r.value) for r in export.json_pages(merge.fact_parts(rows, "mutation", COLUMNS), "mutation", COLUMNS).collect()]
    whole = {tuple(r.identity): r for r in merge.merge_facts(rows, "mutation", COLUMNS).collect()}
    assert max(len(r["query_ids"]) for r in told) <= 3 < max(len(r.query_ids) for r in whole.values())
    for key, fact in whole.items():
        own = sorted((r for r in told if tuple(r["identity"]) == key), key=lambda r: r["page"])
        assert [q for r in own for q in r["query_ids"]] == fact.query_ids
        (first,) = [r for r in own if "n_support" in r]
        assert first is own[0] and first["n_support"] == fact.n_support and first["flags"] == fact.flags and first["Mutation"] == fact["values"]["Mutation"]
        assert [c.get("pmid") for c in first["citations"]] == [c.pmid for c in fact.citations]


def test_rows_of_one_wording_are_counted_in_a_hash_table(spark):
    rows = spark.createDataFrame(claims(12), SCHEMA)
    plan = merge.fact_parts(rows, "mutation", COLUMNS, queries=False)._jdf.queryExecution().executedPlan().toString()
    counted = [line for line in plan.splitlines() if "_place" in line and "Aggregate" in line]
    assert counted and not any("SortAggregate" in line for line in counted)


def test_any_place_is_kept(spark):
    places = [(None, 1, None), (-(2**63), -5, 2**31 - 1), (2**63 - 1, 2**31 - 1, 2**31 - 1), (0, None, 0), (0, merge.LOWEST, 7), (3, 0, 0)]
    own = spark.createDataFrame(places, "spec_ord bigint, row_ord int, split_ord int").select("*", merge._packed().alias("p"))
    back = own.select("p", merge._unpacked(F.col("p")).alias("o")).collect()
    assert [tuple(r.o) for r in back] == places
    ranked = [tuple(r.o) for r in sorted(back, key=lambda r: r.p)]
    assert ranked == [tuple(r) for r in own.drop("p").orderBy(F.struct(*merge.ORDER)).collect()]
    with pytest.raises(PySparkException, match="row_ord is below"):
        spark.createDataFrame([(0, merge.LOWEST - 1, 0)], "spec_ord bigint, row_ord int, split_ord int").select(merge._packed()).collect()


def test_a_gene_that_a_cell_does_not_name_is_left_out(spark):
    cells = ["S315T", "katG-S315T", "katGS315T", "KatG: Ser315Thr", "kat->G S315T", "p.Ser315Thr (S315T)", "S315T (katG S315T)", "katG S315T/N", "serine 315 to threonine", "c.-15C>T", "se-S1T", "N/A", "", None]
    genes = ["katG", "katG gene", "gyrA", "Se", "s", "-", " ", "", None]
    pairs = spark.createDataFrame([(v, g) for v in cells for g in genes], "v string, g string").withColumn("own", own_gene(F.col("v"), F.col("g")))
    told = pairs.select("v", "g", "own", *[f(F.col("v"), F.col(g)).alias(f"{f.__name__}_{g}") for f in (normalize_mutation, expand_mutation) for g in ("g", "own")]).collect()
    for r in told:
        assert r.normalize_mutation_g == r.normalize_mutation_own and r.expand_mutation_g == r.expand_mutation_own, r
    assert {(r.v, r.g): r.own for r in told}["S315T", "katG"] is None and {(r.v, r.g): r.own for r in told}["kat->G S315T", "katG gene"] == "katG gene"


def test_a_notation_is_normalised_once_for_all_genes(spark, monkeypatch):
    staged = []
    keep = merge.stage
    monkeypatch.setattr(merge, "stage", lambda df, name, **said: staged.append((name, keep(df, name, **said))) or staged[-1][1])
    values = [(o, f"gene{g}", m, "", "", "") for o in ("M. x", "M. y") for g in range(6) for m in ("Ser3Thr", "S3T (seen)", "gene3-S3T")]
    rows = spark.createDataFrame([(v,) for v in values], f"values struct<{', '.join(f'`{c}`: string' for c in COLUMNS)}>")
    told = {tuple(r.identity[1:]): r.n_support for r in merge.support(rows, "mutation", COLUMNS).collect()}
    assert told == {(o, f"gene{g}", "S3T"): 3 for o in ("m x", "m y") for g in range(6)}
    assert sorted(df.count() for name, df in staged if name == "merge-cells") == [2, 4, 6]


def test_equal_rows_are_expanded_once(spark):
    rows = spark.createDataFrame([("E. coli", "gyrA", "Ser83Leu", "")] * 50 + [("E. coli", "gyrA", "loss", "")] * 3, "Organism string, `Gene Name` string, Mutation string, _standard_notation string")
    marks = [tuple(r) for r in score.prediction_marks(rows).select("what", "mutation", "_n").collect()]
    assert sorted(marks, key=str) == sorted([("row", None, 50), ("key", "S83L", 50), ("row", None, 3), ("lost", None, 3)], key=str)


def test_a_run_ranks_without_pairs_and_joins_few_passages(spark):
    text = [("d1", "alpha beta"), ("d2", "alpha gamma"), ("d3", "alpha"), ("d4", "delta")]
    meta = F.from_json(F.lit("{}"), METADATA).alias("metadata")
    passages = spark.createDataFrame(text, "chunk_id string, content string").select("chunk_id", F.col("chunk_id").alias("doc_id"), "content", F.lit("c").alias("collection"), meta)
    specs = spark.createDataFrame([("q1", "alpha", 2), ("q2", "alpha beta", 1), ("q3", "delta", 0)], "query_id string, organism string, top_k int").withColumns({"genes": F.lit(""), "other_terms": F.lit("")})
    found = run.Curation(Template("mutation", columns=COLUMNS), lambda prompt, most: {"text": ""}).sources(specs, passages)
    assert sorted((r.query_id, r.chunk_id, r.source_rank) for r in found.collect()) == [("q1", "d1", 2), ("q1", "d3", 1), ("q2", "d1", 1)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [chunk_id" in plan and "SortMergeJoin [chunk_id" not in plan
