"""Streams of rows and of specs: any split, restarts and crashes give the results of one run."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import batch
from factloom.operators.merge import combine, fact_parts, facts_of, members, merge_facts
from factloom.schema import CITATION
from factloom.streaming import batches, facts

COLUMNS = ("Organism", "Gene Name", "Mutation", "Phenotype", "Assertion", "Reference")
SCHEMA = f"spec_ord bigint, row_ord int, split_ord int, query_id string, values struct<{', '.join(f'`{c}`: string' for c in COLUMNS)}>, citations array<{CITATION}>, flags array<string>, standard map<string,string>"


def claims(n, seed=1):
    """Rows of which a third state one fact, in several spellings."""
    dice, out = random.Random(seed), []
    for i in range(n):
        hot = i % 3 == 0
        change = dice.choice(["S10T", "Ser10Thr", "gyr-S10T", "p.Ser10Thr"]) if hot else f"{dice.choice('ACDE')}{dice.randint(1, 5)}G"
        cells = ("M. x", dice.choice(["geneA", "GeneA gene"]) if hot else dice.choice(["geneB", "genec"]), change, dice.choice(["", "low", "low level", "high"]), dice.choice(["seen", "Seen", "told"]), f"[{i % 4}]")
        chunk = {"marker": i % 4, "chunk_id": f"c{i % 7}", "doc_id": "d", "start_char": 0, "end_char": 1, "score": 0.5}
        cited = [] if i % 5 == 0 else [{"marker": i % 4, "pmid": str(i % 6) if i % 4 else None, "pmcid": None, "doi": None, "journal": None, "year": None, "title": None, "first_author": None, "resolved": True, "matched_by": "marker", "chunks": [chunk]}]
        out.append((i // 4, i % 4, 0, f"q{i // 4}", cells, cited, ["no_citation"] if i % 5 == 0 else [f"f{i % 3}"], {"Mutation": "S10T"} if hot else {}))
    dice.shuffle(out)
    return out


def plain(df):
    return sorted(json.dumps(r.asDict(True), sort_keys=True, default=str) for r in df.collect())


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(claims(240), SCHEMA).cache()


@pytest.fixture(scope="module")
def whole(rows):
    return plain(merge_facts(rows, "mutation", COLUMNS))


def test_any_split_gives_the_facts_of_all_rows(rows, whole):
    parts = [fact_parts(rows.filter(F.abs(F.xxhash64("query_id", "row_ord")) % 4 == k), "mutation", COLUMNS) for k in range(4)]
    nested = combine(combine(parts[3], parts[1]), combine(parts[0], parts[2]))
    assert plain(facts_of(nested, "mutation", COLUMNS)) == whole


def test_hot_fact_and_its_members(rows):
    parts = fact_parts(rows, "mutation", COLUMNS)
    short = {tuple(r.identity): r for r in facts_of(parts, "mutation", COLUMNS, listed=False).collect()}
    long = {tuple(r.identity): r for r in merge_facts(rows, "mutation", COLUMNS).collect()}
    hot = ("mutation", "m x", "genea", "S10T")
    assert short[hot].n_support == 80 and short[hot].n_queries == len(long[hot].query_ids)
    for key, row in short.items():
        assert all(row[c] == long[key][c] for c in ("values", "flags", "n_support", "standard", "variants", "first"))
    queries = members(parts, "query").filter(F.col("identity") == F.array(*map(F.lit, hot))).orderBy("first").collect()
    assert [r.query_id for r in queries] == long[hot].query_ids
    cited = members(parts, "citation").filter(F.col("identity") == F.array(*map(F.lit, hot))).collect()
    assert {r.citation.pmid for r in cited} == {c.pmid for c in long[hot].citations}


def test_stream_with_restarts_and_a_crash(spark, rows, whole, tmp_path):
    source, parts, check = (str(tmp_path / x) for x in ("rows", "parts", "check"))
    dealt = rows.withColumn("_k", F.abs(F.xxhash64("query_id", "row_ord")) % 5)
    for k in range(2):
        dealt.filter(F.col("_k") == k).drop("_k").coalesce(1).write.mode("append").parquet(source)
    stream = lambda: spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    facts.start(stream(), parts, check, "mutation", COLUMNS).awaitTermination()
    for k in range(2, 5):
        dealt.filter(F.col("_k") == k).drop("_k").coalesce(1).write.mode("append").parquet(source)

    # Two batches are written, then the run dies before the stream notes the second.
    def dies(batch_rows, number):
        facts.write_batch(batch_rows, number, parts, "mutation", COLUMNS)
        if number == 3:
            raise RuntimeError("power cut")

    with pytest.raises(Exception, match="power cut"):
        stream().writeStream.option("checkpointLocation", check).trigger(availableNow=True).foreachBatch(dies).start().awaitTermination()
    facts.start(stream(), parts, check, "mutation", COLUMNS).awaitTermination()
    assert plain(facts.read_facts(spark, parts, "mutation", COLUMNS)) == whole
    facts.compact(spark, parts)
    assert len(facts._spans(spark.read.parquet(parts))) == 1
    assert plain(facts.read_facts(spark, parts, "mutation", COLUMNS)) == whole
    # Batches after the compaction count beside it.
    facts.write_batch(rows.limit(0), 5, parts, "mutation", COLUMNS)
    assert plain(facts.read_facts(spark, parts, "mutation", COLUMNS)) == whole


def test_specs_are_asked_once(spark, tmp_path):
    source, path, check, asked = (tmp_path / x for x in ("specs", "progress", "check", "asked"))
    source.mkdir()
    asked.mkdir()
    header = "species\tgene\ttype"

    def add(name, *names):
        (source / f"{name}.tsv").write_text("\n".join([header, *[f"{n}\tg\tmutation" for n in names]]) + "\n")

    def answered(specs):
        def complete(prompt, most):
            with open(f"{folder}/calls", "a") as file:  # the tests' machine is the only one
                file.write(prompt + "\n")
            return {"text": f"answer to {prompt}"}

        folder = str(asked)
        made = batch.generate(specs.select("query_id", F.col("organism").alias("prompt")), complete)
        runs = made.withColumns({"template_id": F.lit("mutation"), "is_table": F.lit(False)})
        empty = specs.limit(0).select("query_id").withColumn("values", F.struct(F.lit("").alias("Answer")))
        return batch.progress_records(empty, runs, ("Answer",), 1)

    def run(start=batches.start):
        start(batches.spec_stream(spark, str(source), header=header), str(path), str(check), answered).awaitTermination()

    add("a", "one", "two")
    add("b", "two", "three")
    run()
    add("c", "three", "four", "")
    add("d", "five")

    def dying(specs, path, check, answered):
        def take(rows, number):
            batches.run_batch(rows, number, path, answered)
            if number == 2:
                raise RuntimeError("power cut")  # records are there, the stream doesn't know

        return specs.writeStream.option("checkpointLocation", check).trigger(availableNow=True).foreachBatch(take).start()

    with pytest.raises(Exception, match="power cut"):
        run(dying)
    run()
    calls = (asked / "calls").read_text().split()
    assert sorted(calls) == ["five", "four", "one", "three", "two"]
    kept = batch.read_progress(spark, str(path)).collect()
    assert sorted(r.answer for r in kept) == sorted(f"answer to {c}" for c in calls)
