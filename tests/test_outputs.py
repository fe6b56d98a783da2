"""Sinks, specs, templates, corpora, filters, generation and the glossary."""

from __future__ import annotations

import csv
import glob
import json
import threading
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from factloom.functions.text import escape_html
from factloom.operators import batch, context, export, glossary, merge, retrieve
from factloom.operators.merge import merge_facts
from factloom.schema import SOURCE, Template
from factloom.sources import corpus, specs, templates
from tests.test_streams import COLUMNS, SCHEMA, claims


@pytest.fixture(scope="module")
def facts(spark):
    runs = spark.createDataFrame([(f"q{i}", "mutation", "m1") for i in range(20)], "query_id string, _template string, _model string")
    merged = merge_facts(spark.createDataFrame(claims(60), SCHEMA), "mutation", COLUMNS)
    return export.stamped(merged, runs, export.now()).cache()


def lines(path):
    return [x for name in sorted(glob.glob(f"{path}/part-*")) for x in open(name, encoding="utf-8").read().splitlines()]


def test_every_form_is_written(facts, tmp_path):
    n = facts.count()
    for form in export.FORMS:
        path = str(tmp_path / form)
        assert export.write(facts, COLUMNS, path, form) == n
        if form in ("tsv", "csv"):
            rows = [r for name in glob.glob(f"{path}/part-*") for r in csv.DictReader(open(name, encoding="utf-8"), delimiter="\t" if form == "tsv" else ",")]
            assert len(rows) == n and {*COLUMNS, *export.ANNOTATIONS, *export.PROVENANCE} <= rows[0].keys()
            assert sum(int(r["_n_support"]) for r in rows) == 60 and all(r["_retrieved_at"].endswith("Z") and len(r["_retrieved_at"]) == 20 for r in rows)
        else:
            rows = [json.loads(x) for x in lines(path)]
            assert len(rows) == n and all(("variants" in r) == (form == "json") for r in rows)
            assert all(r["provenance"]["_model"] == "m1" for r in rows)
        with pytest.raises(Exception, match="(?i)already.exists"):
            export.write(facts, COLUMNS, path, form)
    with pytest.raises(ValueError, match="known are tsv"):
        export.write(facts, COLUMNS, str(tmp_path / "x"), "xlsx")


def test_replacing_is_all_or_nothing(spark, facts, tmp_path):
    path = str(tmp_path / "out")
    export.write(facts, COLUMNS, path, "jsonl", replace=True)
    before = lines(path)
    with pytest.raises(ValueError, match="has rows"):
        export.write(facts.limit(0), COLUMNS, path, "jsonl", replace=True)
    with pytest.raises(Exception, match="(?i)broken"):
        export.write(facts.withColumn("n_support", F.raise_error(F.lit("broken")).cast("bigint")), COLUMNS, path, "jsonl", replace=True)
    assert lines(path) == before and len(glob.glob(f"{path}.*")) == 0
    assert export.write(facts.limit(1), COLUMNS, path, "jsonl", replace=True) == 1 and len(lines(path)) == 1
    empty = str(tmp_path / "empty")
    assert export.write(facts.limit(0), COLUMNS, empty, "tsv", replace=True) == 0
    assert export.write(facts.limit(0), COLUMNS, empty, "tsv", replace=True) == 0  # nothing is lost


def test_texts_for_readers(facts):
    n = facts.count()
    said = json.loads(export.as_document(facts, COLUMNS, most=n, meta={"run": 1}))
    assert said["columns"] == list(COLUMNS) and said["n_rows"] == n == len(said["rows"]) and said["meta"] == {"run": 1}
    with pytest.raises(ValueError, match="more than"):
        export.as_document(facts, COLUMNS, most=n - 1)
    cell = facts.limit(1).withColumn("values", F.struct(*[F.lit("a|b\n" + "c" * 40).alias(c) for c in COLUMNS]))
    head, rule, body = export.as_markdown(cell, COLUMNS, most=1).splitlines()
    assert head == "| " + " | ".join([*COLUMNS, "_n_support", "_citations"]) + " |" and rule.count("---") == len(COLUMNS) + 2 and body.count("a\\|b c") == len(COLUMNS)
    wide = export.as_table(cell, COLUMNS, most=1).splitlines()
    assert len(wide) == 3 and wide[0].split()[:3] == ["Organism", "Gene", "Name"] and "a|b " + "c" * 29 + "…" in wide[2]


def test_prose_and_sources(spark):
    answers = spark.createDataFrame([("b", 2, "E. coli", "gyrA", "second"), ("a", 1, "M. tb", "", None)], "query_id string, spec_ord int, organism string, genes string, answer string")
    assert [r.value for r in export.prose(answers).collect()] == ["### M. tb\n\n", "### E. coli gyrA\n\nsecond"]
    sources = spark.createDataFrame([], SOURCE)
    meta = sources.schema["metadata"].dataType
    row = spark.createDataFrame([("q", 1, "d", "c", None, 0.5, "x", tuple([None] * len(meta.fields)))], sources.schema)
    told = export.source_summary(row).collect()[0]
    assert told.content == "" and told.chunk_id == "c" and told.title is None and set(export.source_summary(row).columns) >= {"pmid", "doi", "authors", "end_char"}


FILES = {
    "a.tsv": "Species\tGene Name\tType\ttopk\nM. x\tgyrA\tmutation\t5\n\"M. y\"\t\t\t\n",
    "b.csv": "pathogen,genes,keywords\nM. x,\"gyrA, gyrB\",drug\n",
    "c.txt": "organism,genes\nM. x,gyrA\n",
    "d.json": json.dumps({"queries": [{"organism": "M. x", "k": 7}, {"species": "M. y", "id": "own"}]}),
    "e.json": json.dumps([{"Organism": " M. x "}]),
}


def test_specs_of_all_forms(spark, tmp_path):
    for name, text in FILES.items():
        (tmp_path / name).write_text(text)
    read = lambda name, **k: specs.load_specs(spark, str(tmp_path / name), **k).orderBy("spec_ord").collect()
    one, two = read("a.tsv", defaults={"top_k": 12})
    assert (one.organism, one.genes, one.data_type, one.top_k) == ("M. x", "gyrA", "mutation", 5)
    assert (two.organism, two.genes, two.data_type, two.top_k) == ("M. y", "", "literature-summary", 12) and one.query_id != two.query_id and len(two.query_id) == 12
    assert (read("b.csv")[0].genes, read("b.csv")[0].other_terms, read("c.txt")[0].genes) == ("gyrA, gyrB", "drug", "gyrA")
    assert [(r.organism, r.top_k, r.query_id == "own") for r in read("d.json")] == [("M. x", 7, False), ("M. y", 10, True)] and read("e.json")[0].organism == "M. x"
    for name, text, told in (("x.tsv", "genes\ngyrA\n", "no organism"), ("y.tsv", "organism\tk\nM. x\t500\n", "top_k"), ("z.json", '{"queries": 3}', "list of query rows")):
        (tmp_path / name).write_text(text)
        with pytest.raises(specs.SpecError, match=told):
            read(name)


def test_specs_of_a_folder_with_bad_rows(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"organism": "M. x"}\n\nbroken\n[1]\n{"species": "", "pathogen": "M. y", "k": "x"}\n')
    (tmp_path / "b.yaml").write_text("queries:\n- organism: M. z\n")
    (tmp_path / "c.json").write_text("{")
    (tmp_path / "d.tsv").write_text("organism\tquery id\n\tq1\nM. w\tq2\n")
    rows = specs.read_specs(spark, str(tmp_path)).orderBy("spec_ord").collect()
    told = [(r.file[-7:], r.row, r.organism, r.error and r.error.split(":")[0]) for r in rows]
    assert told[:4] == [("a.jsonl", 1, "M. x", None), ("a.jsonl", 2, "", "not a mapping"), ("a.jsonl", 3, "", "not a mapping"), ("a.jsonl", 4, "M. y", None)]
    assert told[5:] == [("/c.json", 0, "", "unreadable"), (told[6][0], 1, "", "no organism"), (told[7][0], 2, "M. w", None)]
    assert told[4][2:] in (("M. z", None), ("", "unreadable"))  # by whether the library is there
    assert [r.spec_ord for r in rows] == list(range(8)) and [r.query_id for r in rows][-2:] == ["q1", "q2"]


def test_templates(spark, tmp_path):
    path = tmp_path / "own.toml"
    path.write_text('[[templates]]\nid = "own"\ncolumns = ["A", "B"]\nrequired = ["A"]\n[[templates]]\nlabel = "no id"\n')
    assert [(t.id, t.columns, t.required) for t in templates.user_templates(path)] == [("own", ("A", "B"), ("A",))]
    path.write_text("[[templates")
    assert templates.user_templates(path) == templates.user_templates(None) == templates.user_templates(tmp_path / "none") == []
    registry = templates.Registry()
    named = [registry.ids[0], f" {registry.ids[0].upper()} ", "no such", None, next(iter(templates.ALIASES)).upper()]
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(named)], "i int, data_type string")
    got = {r.i: r.template_id for r in templates.resolve_names(rows, registry.frame(spark)).collect()}
    for i, name in enumerate(named):
        try:
            wanted = registry.resolve(name).id
        except templates.TemplateError:
            wanted = None
        assert got[i] == wanted
    bad = spark.createDataFrame([("a", "", "g", ""), ("b", "x" * 121, "g", ""), ("c", "M. x", "g", "t" * 201), ("d", "M. x", None, None)], "query_id string, organism string, genes string, other_terms string")
    assert {r.query_id: r.error for r in templates.slot_errors(bad).collect()} == {"a": "'organism' is required", "b": "'organism' is longer than 120 characters", "c": "'other_terms' is longer than 200 characters"}
    with pytest.raises(templates.TemplateError):
        templates.validate_slots(registry.resolve(registry.ids[0]), {"nonsense": "x"})


def test_collections():
    ids = ["a", "b", "open-access", "d", "e", "f"]
    assert corpus.resolve_collections(ids, None) == corpus.resolve_collections(ids, " ") == ["open-access"]
    assert corpus.resolve_collections(["a", "b"], None, "b") == ["b"] and corpus.resolve_collections(["a"], None) == ["a"] and corpus.resolve_collections([], "") == []
    assert corpus.resolve_collections(ids, "b; a,b") == ["b", "a"] and corpus.resolve_collections(ids[:5], "ALL") == ids[:5]
    for value, told in (("all", "choose at most"), ("a,x", "unknown"), ("a,b,open-access,d,e,f", "at most")):
        with pytest.raises(ValueError, match=told):
            corpus.resolve_collections(ids, value)
    assert corpus.size_note(2_500_000) == "2.5M chunks" and corpus.size_note(1234) == "1,234 chunks"


def test_filters_reach_the_scan(spark, tmp_path):
    rows = [(i, f"word{i % 7} text", 2000 + i % 20, "ab"[i % 2]) for i in range(400)]
    passages = spark.createDataFrame(rows, "chunk_id int, content string, year int, collection string")
    laid = retrieve.lay_out(passages, str(tmp_path / "laid"))
    chosen = laid.filter(retrieve.wanted({"collection": ["a"], "year": {"gte": 2004, "lt": 2010}, "chunk_id": {"ne": 4}}))
    assert sorted(r.chunk_id for r in chosen.collect()) == [i for i, _, y, c in rows if c == "a" and 2004 <= y < 2010 and i != 4]
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(collection" in plan or "PartitionFilters: [(collection" in plan
    assert "GreaterThanOrEqual(year,2004)" in plan and "LessThan(year,2010)" in plan
    known = retrieve.statistics(laid)
    asked = spark.createDataFrame([("q", "word3 text")], "query_id string, search_text string")
    part = {r.chunk_id: r.score for r in retrieve.bm25(chosen, asked, known=known).collect()}
    whole = {r.chunk_id: r.score for r in retrieve.bm25(laid, asked).collect()}
    assert part and all(whole[k] == v for k, v in part.items())
    with pytest.raises(ValueError, match="no such comparison"):
        retrieve.wanted({"year": {"like": 1}})
    meta = spark.range(1).select(F.struct(F.lit(2001).alias("year")).alias("metadata"))
    assert meta.filter(retrieve.wanted({"metadata.year": 2001})).count() == 1 and meta.filter(retrieve.wanted({})).count() == 1


def test_best_of_blocks_are_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(retrieve, "BLOCK_PASSAGES", 7)
    monkeypatch.setattr(retrieve, "BLOCK_QUERIES", 3)
    words = "alpha beta Gamma delta alpha eta theta".split()
    texts = [(f"p{i}", " ".join(words[(i * j) % 7] for j in range(i % 9))) for i in range(60)] + [("none", None)]
    own = spark.createDataFrame(texts, "chunk_id string, content string")
    asked = spark.createDataFrame([(f"q{i}", f"{words[i]}, {words[(i + 2) % 7]} missing") for i in range(7)] + [("q9", None)], "query_id string, search_text string")
    rows = lambda df: sorted(map(tuple, df.select("query_id", "chunk_id", "score", "source_rank").collect()))
    best = retrieve.bm25_top(own, asked, 5)
    assert rows(best) == rows(retrieve.rank(retrieve.bm25(own, asked), 5)) != []
    assert "FlatMapCoGroups" in best._jdf.queryExecution().toString()
    assert rows(retrieve.bm25_top(own.limit(0), asked, 5)) == []


def test_parts_are_spread_and_made_without_queries(spark):
    rows = spark.createDataFrame(claims(12), SCHEMA).coalesce(1)
    parts = merge.fact_parts(rows, "mutation", COLUMNS, queries=False)
    assert "query" not in {r.kind for r in parts.select("kind").collect()}
    assert "REPARTITION_BY_NUM" in parts._jdf.queryExecution().executedPlan().toString()
    told = lambda facts: sorted((r.identity, r.n_support, r.values, r.flags) for r in facts.collect())
    bare = merge.merge_facts(rows, "mutation", COLUMNS, listed=False, queries=False)
    assert "n_queries" not in bare.columns and told(bare) == told(merge.merge_facts(rows, "mutation", COLUMNS, listed=False))


def test_calls_overlap_are_bounded_and_retried(spark):
    prompts = spark.createDataFrame([(str(i), str(i)) for i in range(24)], "query_id string, prompt string").coalesce(1)

    def complete(prompt, most):
        with lock:
            state["now"] += 1
            state["peak"] = max(state["peak"], state["now"])
        time.sleep(0.05)
        with lock:
            state["now"] -= 1
            state[prompt] = state.get(prompt, 0) + 1
        if prompt == "3":
            raise KeyError("own fault")
        if prompt == "4":
            raise batch.CallFailed("gone", 404)
        if prompt == "5" or (prompt == "6" and state[prompt] < 3):
            raise batch.CallFailed("busy", 429)
        return {"text": f"{state['peak']}", "finish_reason": "length" if prompt == "7" else "stop"}

    class Lock:  # made where it is used, since locks can't travel
        def __enter__(self):
            self.own().acquire()

        def __exit__(self, *_):
            self.own().release()

        def own(self):
            return state.setdefault("lock", threading.Lock())

    state, lock = {"now": 0, "peak": 0}, Lock()
    got = {r.query_id: r for r in batch.generate(prompts, complete, at_once=5, pause=0.0).collect()}
    assert len(got) == 24 and 1 < max(int(r.answer) for r in got.values() if r.answer) <= 5
    assert (got["3"].attempts, got["4"].attempts, got["5"].attempts, got["6"].attempts, got["8"].attempts) == (1, 1, 4, 3, 1)
    assert got["5"].error == "CallFailed: busy" and got["4"].answer is None and got["6"].error is None and got["7"].truncated and not got["8"].truncated
    with pytest.raises(ValueError, match="1 to 16"):
        batch.generate(prompts, complete, at_once=17)


def test_quick_answers_leave_a_task_in_few_tables(spark, monkeypatch):
    made = []
    monkeypatch.setattr(batch, "ship_package", lambda spark: None)

    class Prompts:  # runs the task's function here, to see the tables it makes
        sparkSession = spark

        def select(self, *names):
            return self

        def mapInPandas(self, function, schema):
            made.extend(function(iter([pd.DataFrame({"query_id": [str(i) for i in range(2500)], "prompt": "p"})])))

    batch.generate(Prompts(), lambda prompt, most: {"text": prompt})
    assert sorted(int(q) for x in made for q in x["query_id"]) == list(range(2500)) and len(made) <= 4


def test_progress_is_shuffled_as_texts(spark):
    lines = spark.createDataFrame([('{"query_id":"a","batch":1,"template_id":"old"}', 2), ('{"query_id":"a","batch":2,"template_id":"new"}', 1), ('{"query_id":"a","batch":9,"rows":[', 3)], "value string, at int")
    parsed = batch.parse_progress(lines, "at")
    assert [(r.query_id, r.batch, r.template_id) for r in parsed.collect()] == [("a", 2, "new")]
    plan = parsed._jdf.queryExecution().executedPlan().toString()
    dealt = next(line for line in plan.splitlines() if "max_by" in line and "partial" in line)
    assert "struct<query_id" not in dealt and "r#" not in dealt, dealt


def test_progress_keeps_whole_rows(spark, tmp_path):
    rows = spark.createDataFrame(claims(12), SCHEMA).withColumns({"variants": F.create_map(F.lit("Assertion"), F.array(F.lit("x"))), "_model": F.lit("m")})
    runs = rows.select("query_id").distinct().withColumns({"template_id": F.lit("mutation"), "is_table": F.lit(True), "answer": F.lit("text")})
    path = str(tmp_path / "progress")
    batch.append_progress(batch.progress_records(rows.limit(0), runs, COLUMNS, 1), path, 1)
    batch.append_progress(batch.progress_records(rows, runs, COLUMNS, 2), path, 2)
    batch.append_progress(batch.progress_records(rows, runs, COLUMNS, 2), path, 2)  # the same once more
    with open(f"{path}/append=2/part-broken.txt", "w") as file:
        file.write('{"query_id": "q0", "batch": 9, "rows": [')
    records = batch.read_progress(spark, path)
    assert records.count() == 3 and batch.restored_template(records).first().template_id == "mutation" and {r.answer for r in records.collect()} == {""}
    back = batch.restored_rows(records)
    kept = lambda df: sorted((r.query_id, r.row_ord, r["values"]["Mutation"], r.flags, [c.asDict(True) for c in r.citations], r.standard, r.variants, r["_model"]) for r in df.collect())
    assert kept(back) == kept(rows)
    # Restored and fresh rows merge as all rows at once do.
    asked = rows.select("query_id", "spec_ord").distinct()
    old, new = back.filter("query_id = 'q0'"), rows.filter("query_id <> 'q0'")
    shown = lambda df: sorted((tuple(r.identity), r["values"]["Phenotype"], r.n_support, tuple(r.flags), tuple(r.query_ids)) for r in merge_facts(df, "mutation", COLUMNS).collect())
    assert shown(batch.resumed(old, new, asked, COLUMNS)) == shown(rows)


def test_glossary(spark):
    own = spark.createDataFrame([("column", "Gene  name", "The gene."), ("derived", "gene name", "hidden"), ("derived", "Score", "A score."), ("flag", "missing:MIC", "No MIC.")], "kind string, term string, text string")
    book = glossary.entries(spark, own)
    flags = spark.createDataFrame([("missing:MIC",), ("missing:Phenotype",), ("new",), (None,)], "flag string")
    missing = next(x for _, t, x in glossary.TERMS if t == "missing")
    assert {r.flag: r.text for r in glossary.describe_flags(flags, book).collect()} == {"missing:MIC": "No MIC.", "missing:Phenotype": missing, "new": "", None: ""}
    columns = spark.createDataFrame([("GENE NAME",), (" score ",), ("other",)], "column string")
    assert {r.column: r.text for r in glossary.describe_columns(columns, book).collect()} == {"GENE NAME": "The gene.", " score ": "A score.", "other": ""}


def test_small_renderings(spark):
    row = spark.range(1).select(escape_html(F.lit('<a href="x">&</a>')).alias("html"), F.lit("x").alias("x"))
    assert row.first().html == "&lt;a href=&quot;x&quot;&gt;&amp;&lt;/a&gt;"
    short = Template("t", output="text")
    told = spark.range(1).select(context.prompt(short, F.lit(" for x"), F.lit("CONTEXT"), F.lit(3), F.lit("mind y")).alias("p")).first().p
    assert "1 to 3" in told and told.endswith("--- SOURCES ---\n\nCONTEXT") and "mind y" in told
