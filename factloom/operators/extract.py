"""Extraction of one template's answers: rows with citations, flags and standard notation.

Input answers have query_id, answer, `sources` (an array, from citations.with_sources) and
may have `genes` (the requested ones, comma-separated). The order of steps per row is
fixed: realign, clean, evidence filter, required filter, compound split, citations, flags,
method vocabulary, either-or, reversed pair, off-target, standard notation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import vocab
from factloom.functions.normalize import normalize_gene, site_with_residue, standard_notation
from factloom.functions.text import let
from factloom.operators import answers as A
from factloom.operators import citations as C
from factloom.schema import Template


def _of_class(columns: Sequence[str], names: Sequence[str]) -> list[str]:
    return [c for c in columns if c.strip().lower() in names]


def split_genes(genes: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(genes, F.lit("")), "[,;]"), lambda g: F.trim(g)), lambda g: g != "")  # trim itself would take the index as characters


def gene_keys(entries: Column) -> Column:
    """Normalised entries and each of their words of over one character."""
    words = lambda g: F.filter(F.split(g, " "), lambda w: F.length(w) > 1)
    whole = F.filter(F.transform(entries, lambda g: normalize_gene(g)), lambda g: g != "")
    return let(whole, lambda w: F.array_distinct(F.concat(w, F.flatten(F.transform(w, words)))))


def _off_target(genes: Sequence[Column], requested: Column) -> Column:
    """Whether a row names genes, and no key of theirs is requested; genes are `normalize_gene`d."""
    named, known = F.lit(False), F.lit(False)
    for g in genes:
        words = F.when(F.contains(g, F.lit(" ")), F.arrays_overlap(F.filter(F.split(g, " "), lambda w: F.length(w) > 1), requested))
        named = named | (g != "")
        known = known | ((g != "") & (F.array_contains(requested, g) | F.coalesce(words, F.lit(False))))
    return named & (F.size(requested) > 0) & ~known


def _first_value(columns: Sequence[str]) -> Column:
    """First non-empty value of some columns, or an empty string."""
    return F.coalesce(*[F.when(A.value(c) != "", A.value(c)) for c in columns], F.lit(""))


def reference_text(columns: Sequence[str]) -> tuple[Column, Column]:
    """Text in which citations are looked for, and whether it is a reference column's."""
    cells = [F.get("cells", F.lit(i)) for i, c in enumerate(columns) if c.strip().lower() in vocab.REFERENCE]
    own = F.concat_ws(" ", *cells) if cells else F.lit("")
    line = F.when(F.col("delimiter") == "|", F.array_join("cells", "|")).otherwise(F.array_join("cells", "\t"))
    return F.when(own != "", own).otherwise(line), F.trim(own) != ""


def _squash(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]", "")


def _flags(template: Template, requested: Column) -> Column:
    """Array of all flags, null where a row hasn't got one."""
    columns = template.columns
    named = lambda test, text: F.when(test, F.lit(text))
    wanted = set(vocab.KEY_VALUE) | {r.strip().lower() for r in template.required}
    found = [
        named(F.col("misaligned"), "column_count_mismatch"),
        named(F.col("ambiguous"), "compound_row"),
        named(A.evidence_free(columns), "evidence_free"),
        named(F.array_contains(F.col("citations")["resolved"], F.lit(False)), "unresolved_citation"),
        F.when(F.size("citations") == 0, F.when(C.has_reference_text(F.col("_cited")), "citation_not_in_sources").otherwise("no_citation")),
    ]
    found += [named(A.value(c) == "", f"missing:{c}") for c in columns if c.strip().lower() in wanted]
    found += [named(F.lower(F.trim(A.value(c))).isin(*vocab.NOT_A_METHOD), "method_not_a_technique") for c in _of_class(columns, vocab.METHOD)]
    either = _of_class(columns, vocab.EITHER_OR)
    if either:
        test = F.lit(True)
        for c in either:
            test = test & A.is_empty(A.value(c))
        found.append(named(test, "missing:" + "/".join(sorted(vocab.EITHER_OR)).upper()))
    organism, hosts = _squash(_first_value(_of_class(columns, vocab.ORGANISM))), _of_class(columns, vocab.HOST)
    if hosts:
        test = F.lit(False)
        for c in hosts:
            test = test | F.contains(_squash(A.value(c)), organism)
        found.append(named((F.length(organism) >= 6) & test, "reversed_pair"))
    genes = [F.col(g) for g in _genes(columns)]
    if genes:
        found.append(named(_off_target(genes, requested), "off_target_gene"))
    return F.array(*found)


def _genes(columns: Sequence[str]) -> dict[str, Column]:
    """Columns for the normalised target genes of a row."""
    return {f"_gene{i}": normalize_gene(A.value(c), collapsed=True) for i, c in enumerate(_of_class(columns, vocab.TARGET_GENE))}


def _standard(facts: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Adds `standard`: standard forms that differ from what is written, by column."""
    linkage, gene = _first_value(_of_class(columns, vocab.LINKAGE)), _first_value(_of_class(columns, vocab.TARGET_GENE))
    entry = lambda c, v: F.struct(F.lit(c).alias("key"), v.alias("value"))
    sites, notations = _of_class(columns, vocab.SITE), _of_class(columns, vocab.NOTATION)
    made = {f"_site{i}": site_with_residue(A.value(c), linkage) for i, c in enumerate(sites)} | {f"_notation{i}": standard_notation(A.value(c), gene) for i, c in enumerate(notations)}
    found = [entry(c, F.col(f"_site{i}")) for i, c in enumerate(sites)]
    for i, c in enumerate(notations):
        v = F.col(f"_notation{i}")
        found.append(entry(c, F.when(F.lower(v) != F.lower(F.trim(A.value(c))), v).otherwise("")))
    none = F.create_map().cast("map<string,string>")
    if not found:
        return facts.withColumn("standard", none)
    filled = F.lit(False)
    for e in found:
        filled = filled | (e["value"] != "")
    standard = F.when(filled, F.map_from_entries(F.filter(F.array(*found), lambda e: e["value"] != ""))).otherwise(none)
    return facts.withColumns(made).withColumn("standard", standard).drop(*made)


def extract_table(answers: DataFrame, template: Template, *, keep_empty: bool = False, strict_markers: bool = False) -> DataFrame:
    """Facts of table answers, and the dropped lines with their `status`.

    Result: the answers' other columns, row_ord, split_ord, status, misaligned, transposed,
    n_split, values, citations, flags, standard.
    """
    columns = template.columns
    genes = F.col("genes") if "genes" in answers.columns else F.lit("")
    asked = answers.withColumns({"_requested": gene_keys(split_genes(genes)), "_known": C.citations_of(F.col("sources")), "_ranks": F.col("sources")["source_rank"]})
    rows = A.parse_rows(asked.drop("sources"), template, keep_empty=keep_empty)
    rows = rows.withColumn("values", F.when(F.col("status") == "kept", F.col("values")))
    facts = A.split_compound(rows, columns)
    text, bare = reference_text(columns)
    facts = C.with_citations(facts, text, bare, strict=strict_markers)
    facts = facts.withColumns(_genes(columns)).withColumn("flags", _flags(template, F.col("_requested")))
    # Most rows have no flag, or are told so by the array's maximum without a lambda.
    facts = facts.withColumn("flags", F.when(F.array_max("flags").isNull(), F.array().cast("array<string>")).otherwise(F.array_compact("flags")))
    for c in _of_class(columns, vocab.METHOD):
        cleared = F.when(F.lower(F.trim(A.value(c))).isin(*vocab.NOT_A_METHOD), "").otherwise(A.value(c))
        facts = facts.withColumn("values", F.col("values").withField(f"`{c}`", cleared))
    facts = _standard(facts, columns)
    return facts.drop("_cited", "_requested", "_known", "_ranks", *_genes(columns), "cells", "delimiter", "ambiguous")


def kept(facts: DataFrame) -> DataFrame:
    return facts.filter("status = 'kept'")


def extract_text(answers: DataFrame) -> DataFrame:
    """Prose answers: one row with the text and its citations."""
    known = answers.withColumns({"_known": C.citations_of(F.col("sources")), "_ranks": F.col("sources")["source_rank"]})
    return C.with_citations(known, F.col("answer")).select(
        *[c for c in answers.columns if c not in ("answer", "sources")],
        F.struct(F.coalesce("answer", F.lit("")).alias("Answer")).alias("values"),
        "citations",
    )


def run_summary(facts: DataFrame, answers: DataFrame) -> DataFrame:
    """Counters per query; lines are counted once, facts once each."""
    first = F.col("split_ord") == 0
    count = lambda test: F.sum(F.when(test, 1).otherwise(0)).cast("bigint")
    counted = facts.groupBy("query_id").agg(
        count(F.col("status") == "kept").alias("n_rows"),
        count((F.col("status") == "empty") & first).alias("dropped_empty"),
        count((F.col("status") == "malformed") & first).alias("dropped_malformed"),
        count((F.col("status") == "incomplete") & first).alias("dropped_incomplete"),
        count((F.col("status") == "kept") & (F.col("split_ord") > 0)).alias("split_compound"),
        count(F.col("misaligned") & first).alias("realigned"),
        F.sum(F.when(F.col("status") == "kept", F.size(F.filter("citations", lambda c: ~c["resolved"]))).otherwise(0)).cast("bigint").alias("unresolved_citations"),
        F.coalesce(F.bool_or("transposed"), F.lit(False)).alias("transposed"),
    )
    zeros = {c: 0 for c in counted.columns if c not in ("query_id", "transposed")} | {"transposed": False}
    return answers.select("query_id").join(counted, "query_id", "left").fillna(zeros)
