"""Answer parsing, citations, flags and merging on small hand-made answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import answers as A
from factloom.operators import citations as C
from factloom.operators import extract as E
from factloom.operators import merge as M
from factloom.schema import SOURCE, Template

MUTATION = Template("mutation", "resistance mutations", columns=("Organism", "Gene Name", "Mutation", "Phenotype", "Assertion", "Reference"))
PPI = Template("ppi-extraction", columns=("Pathogen", "Protein A", "Protein B", "Interaction Type", "Method", "Assertion", "Reference"))
GLYCO = Template("glycosylation", columns=("Organism", "Protein", "Strain", "Site", "Glycosylation Type", "Glycan", "Method", "Effect", "Assertion", "Reference"))
HOST = Template(
    "host-virus", required=("Viral Protein", "Interaction Type", "Host Protein"),
    columns=("Organism", "Viral Protein", "Interaction Type", "Host Protein", "Host Organism", "Biological Consequence", "Method", "Assertion", "Reference"),
)
AST = Template("ast", columns=("Organism", "Strain", "Antibiotic", "MIC", "SIR", "Reference"))
PAPERS = [("100", "Ada Stone"), ("200", "Bo Li"), ("300", "Cy Marsh"), ("400", "Di Field"), ("300", "Cy Marsh"), ("300", "Cy Marsh")]


def sources(spark, query="q"):
    rows = []
    for i, (pmid, author) in enumerate(PAPERS, 1):
        meta = (f"Title {i}", "J", 2000 + int(pmid) // 100, [author, "X Other"], pmid, None, None, i * 10, i * 10 + 5, *[None] * 11)
        rows.append((query, i, f"d{pmid}", f"c{i}", f"text {i}", 1.0 / i, "c", meta))
    return spark.createDataFrame(rows, SOURCE)


def table(*lines, sep="\t"):
    return "\n".join(sep.join(x) for x in lines)


def facts(spark, template, answer, genes="", **options):
    answers = spark.createDataFrame([("q", answer, genes)], "query_id string, answer string, genes string")
    return E.extract_table(C.with_sources(answers, sources(spark)), template, **options)


def rows(df):
    return sorted(df.collect(), key=lambda r: (r.row_ord, r.split_ord))


ORG = "M. tuberculosis"
NINE = table(
    MUTATION.columns,
    (ORG, "katG", "S315T", "isoniazid resistance", "measured", "[1]"),
    (ORG, "katG", "Ser315Thr", "moderate-level isoniazid resistance", "measured", "[2]"),
    (ORG, "katG", "katG-S315T", "isoniazid resistance", "reported", "[3]"),
    (ORG, "katG gene", "p.Ser315Thr", "isoniazid resistance", "reported", "[4]"),
    (ORG, "katG", "Ser315Thr (S315T)", "Isoniazid resistance", "reported", "[3]"),
    (ORG, "katG", "deletion", "resistance", "measured", "[2]"),
    (ORG, "KatG", "Deletion", "resistance", "measured", "[3]"),
    (ORG, "inhA", "c-15t", "resistance", "measured", "[2]"),
    (ORG, "inhA", "Ser94Ala", "resistance", "measured", "[2]"),
)


def test_nine_rows_merge_to_four(spark):
    merged = {tuple(r.identity[2:]): r for r in M.merge_facts(E.kept(facts(spark, MUTATION, NINE, "katG")), "mutation", MUTATION.columns).collect()}
    assert set(merged) == {("katg", "S315T"), ("katg", "deletion"), ("inha", "n-15T"), ("inha", "S94A")}
    main = merged["katg", "S315T"]
    assert main.n_support == 5
    assert main["values"]["Phenotype"] == "moderate-level isoniazid resistance"
    assert main["values"]["Mutation"] == "S315T"
    assert main.variants["Phenotype"] == ["isoniazid resistance", "moderate-level isoniazid resistance", "Isoniazid resistance"]
    assert main.variants["Assertion"] == ["measured", "reported"]
    assert main.flags == ["merged_variants:Phenotype", "merged_variants:Assertion"]
    assert sorted(k.marker for c in main.citations for k in c.chunks) == [1, 2, 3, 4]
    assert main.standard == {"Mutation": "S315T"}
    assert merged["katg", "deletion"].n_support == 2 and merged["katg", "deletion"].standard == {}
    assert "off_target_gene" in merged["inha", "n-15T"].flags and merged["inha", "n-15T"].standard == {"Mutation": "n-15T"}


def test_shapes_give_the_same_rows(spark):
    record = (ORG, "katG", "S315T", "isoniazid resistance", "measured", "[1]")
    other = (ORG, "inhA", "S94A", "resistance", "measured", "[2]")
    tabbed = table(MUTATION.columns, record, other)
    piped = "| " + " |\n| ".join(" | ".join(x) for x in (MUTATION.columns, ["---"] * 6, record, other)) + " |"
    fenced = f"```tsv\n{tabbed}\n```"
    headless = table(record, other)
    turned = table(*[(c, a, b) for c, a, b in zip(MUTATION.columns, record, other, strict=True)])
    wanted = [record, other]
    for text in (tabbed, piped, fenced, headless, turned):
        got = rows(facts(spark, MUTATION, text))
        assert [tuple(r["values"]) for r in got] == wanted, text
        assert got[0].transposed == (text is turned)
    ragged = table(*[(c, a) if c == "Phenotype" else (c, a, b) for c, a, b in zip(MUTATION.columns, record, other, strict=True)])
    assert rows(facts(spark, MUTATION, ragged))[1]["values"]["Phenotype"] == ""


def test_fates_of_lines(spark):
    text = table(
        PPI.columns,
        ("SARS-CoV-2", "NSP13", "Spike", "N/A", "N/A", "N/A", "N/A"),
        ("lonely",),
        ("SARS-CoV-2", "NA", "ACE2", "binds", "reported", "measured", "[1]"),
    )
    got = rows(facts(spark, PPI, text))
    assert [r.status for r in got] == ["empty", "malformed", "kept"]
    assert got[2]["values"]["Protein A"] == "NA" and got[2]["values"]["Method"] == "" and got[2].flags == ["method_not_a_technique"]
    kept = rows(facts(spark, PPI, text, keep_empty=True))
    assert kept[0].status == "kept" and "evidence_free" in kept[0].flags and "missing:Interaction Type" in kept[0].flags
    host = table(HOST.columns, ("SARS-CoV-2", "nsp13", "binds", "", "human", "x", "y", "reported", "[1]"))
    assert rows(facts(spark, HOST, host))[0].status == "incomplete"
    turned = table(HOST.columns, ("SARS-CoV-2", "nsp1", "binds", "regions of SARS CoV 2 RNA", "human", "x", "y", "reported", "[1]"))
    assert "reversed_pair" in rows(facts(spark, HOST, turned))[0].flags


def test_short_and_wide_rows_are_realigned(spark):
    full = ("Virus", "HA", "s1", "N42", "N-linked", "complex", "mass spectrometry", "stability", "measured", "[2]")
    short = full[:5] + full[6:]
    got = rows(facts(spark, GLYCO, table(GLYCO.columns, short)))[0]
    assert tuple(got["values"]) == (*full[:5], "", *full[6:]) and got.flags == ["column_count_mismatch"]
    wide = rows(facts(spark, GLYCO, table(GLYCO.columns, (*full[:9], "x", "[2]"))))[0]
    assert wide["values"]["Reference"] == "x [2]" and [c.marker for c in wide.citations] == [2]
    bare = rows(facts(spark, GLYCO, table(GLYCO.columns, ("Virus", "HA", "s1", "42", *full[4:]))))[0]
    assert bare.standard == {"Site": "N42"}


def test_compound_rows(spark):
    text = table(
        MUTATION.columns,
        (ORG, "katG, inhA", "Ser315Thr, c-15t", "r", "measured", "[1]"),
        (ORG, "katG, inhA", "S315T", "r", "measured", "[1]"),
        (ORG, "katG, inhA and rpoB", "S315T, S94A", "r", "measured", "[1]"),
        (ORG, "katG", "Multiple mutations (codons 315, 316, 309)", "r", "measured", "[1]"),
        (ORG, "katG", "42, 44", "r", "measured", "[1]"),
    )
    got = rows(facts(spark, MUTATION, text))
    assert [(r["values"]["Gene Name"], r["values"]["Mutation"]) for r in got] == [
        ("katG", "Ser315Thr"), ("inhA", "c-15t"), ("katG", "S315T"), ("inhA", "S315T"), ("katG, inhA and rpoB", "S315T, S94A"),
        ("katG", "Multiple mutations (codons 315, 316, 309)"), ("katG", "42, 44"),
    ]
    assert got[4].flags == ["compound_row"]


def test_citations(spark):
    cases = {
        "[1]": [1], "[1-3]": [1, 2, 3], "[1, 2]": [1, 2], "[3–1]": [1, 2, 3], "1-3": [1, 2, 3], "3, 5": [3], "[1, 2, 4]": [1, 2, 4], "99": [],
        "10.1128/x": [], "Ada Stone et al. 2001": [1], "Stone 1999": [], "Marsh 2003": [3], "Li 2002": [], "[9]": [9], "[2][2]": [2],
    }
    text = table(MUTATION.columns, *[(ORG, "katG", "S315T", "r", "measured", c) for c in cases])
    got = rows(facts(spark, MUTATION, text))
    assert [[c.marker for c in r.citations] for r in got] == [[1], [1, 2, 3], [1, 2], [1, 2, 3], [1, 2, 3], [3], [1, 2, 4], [], [], [1], [], [3], [], [9], [2]]
    by_text = dict(zip(cases, got, strict=True))
    assert by_text["[9]"].flags == ["unresolved_citation"] and by_text["99"].flags == ["no_citation"]
    assert by_text["Stone 1999"].flags == ["citation_not_in_sources"] and by_text["Ada Stone et al. 2001"].citations[0].matched_by == "author"
    assert [k.marker for k in by_text["3, 5"].citations[0].chunks] == [3, 5]
    assert rows(facts(spark, MUTATION, table(MUTATION.columns, (ORG, "katG", "S315T", "r", "x", "[1, 2, 4]")), strict_markers=True))[0].citations == []


def test_symmetric_pair_and_either_or(spark):
    text = table(PPI.columns, ("V", "A1", "B1", "binds", "Y2H", "measured", "[1]"), ("V", "B1", "A1", "interacts with", "Y2H", "measured", "[2]"))
    merged = M.merge_facts(E.kept(facts(spark, PPI, text)), "ppi-extraction", PPI.columns).collect()
    assert len(merged) == 1 and merged[0].n_support == 2 and not merged[0].variants
    got = rows(facts(spark, AST, table(AST.columns, ("E. coli", "k1", "Amp", "", "", "[1]"), ("E. coli", "k1", "Amp", "8 mg/L", "", "[1]")), keep_empty=True))
    assert "missing:MIC/SIR" in got[0].flags and got[1].flags == []


def test_second_level_merge_keeps_variants_and_support(spark):
    once = M.merge_facts(E.kept(facts(spark, MUTATION, NINE)), "mutation", MUTATION.columns)
    again = once.withColumns({"spec_ord": F.col("first.spec_ord"), "row_ord": F.col("first.row_ord"), "split_ord": F.col("first.split_ord")})
    twice = {tuple(r.identity): r for r in M.merge_facts(again, "mutation", MUTATION.columns).collect()}
    for r in once.collect():
        assert twice[tuple(r.identity)].n_support == r.n_support and set(twice[tuple(r.identity)].variants) == set(r.variants)


def test_summary_and_prose(spark):
    answers = spark.createDataFrame([("q", NINE), ("none", ""), ("nil", None)], "query_id string, answer string")
    read = C.with_sources(answers, sources(spark))
    got = {r.query_id: r for r in E.run_summary(E.extract_table(read, MUTATION), answers).collect()}
    assert got["q"].n_rows == 9 and got["none"].n_rows == 0 and got["nil"].dropped_malformed == 0
    prose = E.extract_text(read.filter("query_id = 'q'").withColumn("answer", F.lit("see [1] and [7]"))).first()
    assert [c.resolved for c in prose.citations] == [True, False]


def test_order_does_not_depend_on_partitions(spark):
    base = E.kept(facts(spark, MUTATION, NINE, "katG"))
    pick = lambda df: sorted((r.identity, r.flags, r.variants, r["values"]) for r in M.merge_facts(df, "mutation", MUTATION.columns).collect())
    assert pick(base) == pick(base.repartition(7, F.rand(3)))
