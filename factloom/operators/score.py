"""Scoring predicted facts against a reference set."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.normalize import expand_mutation, genus
from factloom.session import spread, unnested


def outcomes(found: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The distinct non-null keys of both sides, each with in_found and in_wanted.

    Both sides are reduced by one partly aggregated shuffle; no join is needed.
    """
    marked = found.select(*keys, F.lit(True).alias("f"), F.lit(False).alias("w")).unionByName(wanted.select(*keys, F.lit(False).alias("f"), F.lit(True).alias("w")))
    return marked.dropna(subset=list(keys)).groupBy(*keys).agg(F.bool_or("f").alias("in_found"), F.bool_or("w").alias("in_wanted"))


def precision_recall(found: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: tp, fp, fn, precision, recall and f1, to four places; 0 for an empty side."""
    f, w = F.col("in_found"), F.col("in_wanted")
    counts = outcomes(found, wanted, keys).agg(F.count_if(f & w).alias("tp"), F.count_if(f & ~w).alias("fp"), F.count_if(w & ~f).alias("fn"))
    tp = F.col("tp").cast("double")
    share = lambda of: F.round(F.when(of > 0, tp / of).otherwise(0.0), 4)
    return counts.select(
        "tp", "fp", "fn", share(F.col("tp") + F.col("fp")).alias("precision"), share(F.col("tp") + F.col("fn")).alias("recall"),
        share(F.col("tp") + (F.col("fp") + F.col("fn")) / 2).alias("f1"),
    )


def per_key_recall(found: DataFrame, wanted: DataFrame, keys: Sequence[str], by: str, limit: int = 15) -> DataFrame:
    """Recall of each value of `by`, for the `limit` values with most wanted keys (ties by value)."""
    counts = outcomes(found, wanted, keys).filter("in_wanted").groupBy(by).agg(F.count("*").alias("reference"), F.count_if("in_found").alias("found"))
    return counts.withColumn("recall", F.round(F.col("found") / F.col("reference"), 4)).orderBy(F.desc("reference"), by).limit(limit)


def _marks(rows: DataFrame, side: str, organism: Column, gene: Column, counts: Column) -> DataFrame:
    """One pass over a side: a mark for each row that counts, for each that names nothing
    scorable, and for each key that it names. Marks are then counted like keys, so the
    counters come from the pass that makes the keys, however often a task is tried.
    rows: with the changes they name as `_found`."""
    none, found = F.lit(None).cast("string"), F.col("_found")
    mark = lambda what, o, g, m: F.struct(F.lit(what).alias("what"), o.alias("organism"), g.alias("gene"), m.alias("mutation"))

    keys = F.transform(found, lambda m: mark("key", organism, F.lower(F.trim(gene)), m))
    named = F.when(F.size(found) == 0, F.array(mark("lost", none, none, none))).otherwise(keys)
    marks = F.when(counts, F.concat(F.array(mark("row", none, none, none)), named))
    return unnested(rows.withColumn("_marks", marks), "_marks", "m", "_n").select(F.lit(side).alias("side"), "m.*", "_n")


def _counted(rows: DataFrame, *columns: str) -> DataFrame:
    """Distinct rows with their number `_n`: expanding a cell is what costs, so equal ones are expanded once, and spread."""
    return spread(rows.groupBy(*columns).agg(F.count("*").alias("_n")))


def catalog_marks(catalog: DataFrame) -> DataFrame:
    """Marks of a catalog (subtype, allele, gene_family, whitelisted_taxa), `_n` of each: point
    alleles that name a gene; what follows an allele's last underscore is its change."""
    catalog = _counted(catalog, "subtype", "allele", "gene_family", "whitelisted_taxa")
    allele, gene = F.trim("allele"), F.trim("gene_family")
    counts = (F.trim("subtype") == "POINT") & (allele != "") & (gene != "")
    named = catalog.withColumn("_found", F.when(counts, expand_mutation(F.substring_index(allele, "_", -1), gene)))
    return _marks(named, "catalog", genus(F.col("whitelisted_taxa")), gene, F.col("_found").isNotNull())


def prediction_marks(rows: DataFrame) -> DataFrame:
    """Marks of exported rows (Organism, `Gene Name`, Mutation, _standard_notation), `_n` of each: the cell, or else its standard form, names the changes."""
    rows = _counted(rows, "Organism", "`Gene Name`", "Mutation", "_standard_notation")
    gene = F.trim(F.coalesce("`Gene Name`", F.lit("")))
    none = F.array().cast("array<string>")
    # Columns one after the other: nested in one expression they would be too deep to analyse.
    named = rows.withColumn("_found", F.when(gene == "", none).otherwise(expand_mutation(F.col("Mutation"), gene)))
    other = F.when((gene != "") & (F.size("_found") == 0), expand_mutation(F.col("_standard_notation"), gene)).otherwise(F.col("_found"))
    return _marks(named.withColumn("_found", other), "found", genus(F.col("Organism")), gene, F.lit(True))


def _rates(prefix: str, keys: DataFrame) -> DataFrame:
    """One row: outcomes of keys with in_found and in_wanted."""
    f, w = F.col("in_found"), F.col("in_wanted")
    counts = keys.agg(F.count_if(f & w).alias("tp"), F.count_if(f & ~w).alias("fp"), F.count_if(w & ~f).alias("fn"))
    share = lambda of: F.when(of > 0, F.col("tp") / of).otherwise(0.0)
    p, r = share(F.col("tp") + F.col("fp")), share(F.col("tp") + F.col("fn"))
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    named = {"tp": F.col("tp"), "fp": F.col("fp"), "fn": F.col("fn"), "precision": F.round(p, 4), "recall": F.round(r, 4), "f1": F.round(f1, 4)}
    return counts.select(*[v.alias(f"{prefix}_{k}") for k, v in named.items()])


def report(predictions: DataFrame, catalog: DataFrame, asked: DataFrame) -> DataFrame:
    """One row of all measures of predictions against a catalog.

    asked: `genes` that were asked for; recall counts only their keys, since a gene that
    nobody asked for isn't missed. Keys are gene and mutation, and with the organism's genus.
    """
    marks = prediction_marks(predictions).unionByName(catalog_marks(catalog))
    counted = marks.groupBy("side", "what", "organism", "gene", "mutation").agg(F.sum("_n").alias("n"))
    on = lambda side: F.col("side") == side
    total = lambda side, what: F.coalesce(F.sum(F.when(on(side) & (F.col("what") == what), F.col("n"))), F.lit(0))
    sizes = counted.agg(
        total("found", "row").alias("result_rows"), total("found", "lost").alias("unscorable_rows"),
        total("catalog", "row").alias("catalog_rows"), total("catalog", "lost").alias("catalog_skipped"),
    )
    genes = asked.select(F.lower(F.trim("genes")).alias("gene")).filter("gene <> ''").distinct().withColumn("asked", F.lit(True))
    keys = counted.filter("what = 'key'").join(genes, "gene", "left")
    wanted = on("catalog") & F.coalesce("asked", F.lit(False))
    by_organism = keys.groupBy("organism", "gene", "mutation").agg(F.bool_or(on("found")).alias("in_found"), F.bool_or(on("catalog")).alias("in_catalog"), F.bool_or(wanted).alias("in_wanted"))
    by_gene = by_organism.groupBy("gene", "mutation").agg(*[F.bool_or(c).alias(c) for c in ("in_found", "in_catalog", "in_wanted")])
    told = by_gene.agg(
        F.count_if("in_found").alias("scorable_predictions"), F.count_distinct(F.when(F.col("in_found"), F.col("gene"))).alias("genes_in_predictions"),
        F.count_if("in_catalog").alias("catalog_mutations"), F.count_if("in_wanted").alias("catalog_in_asked_genes"),
    )
    return sizes.crossJoin(told).crossJoin(_rates("gene", by_gene)).crossJoin(_rates("organism", by_organism))  # one row each
