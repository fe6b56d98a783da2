"""Definitions of columns and flags, from tables of (kind, term, text).

A flag may be qualified by what it concerns ("missing:Phenotype"); its definition is that
of the whole, or else of what stands before the colon. A column's name is looked up without
case and repeated white space, first among the columns, then among the derived ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("column", "derived", "flag")
#: The engine's own terms.
TERMS = (
    ("flag", "no_citation", "The row names no source."),
    ("flag", "unresolved_citation", "A marker of the row is none of its query's sources."),
    ("flag", "citation_not_in_sources", "The row cites something that isn't among its query's sources."),
    ("flag", "missing", "A cell that facts of this kind need is empty."),
    ("flag", "merged_variants", "The rows of this fact differ in a column; all spellings are kept."),
    ("flag", "off_target_gene", "The row is about a gene that the query didn't ask for."),
    ("flag", "compound_row", "The row lists several subjects whose parts don't fit each other."),
    ("flag", "column_count_mismatch", "The row had more or fewer cells than the header."),
    ("flag", "evidence_free", "The row says nothing about its subject."),
    ("flag", "reversed_pair", "The host's side names the organism."),
    ("flag", "method_not_a_technique", "The method cell held no method and was cleared."),
    ("derived", "_n_support", "How many rows state the fact."),
    ("derived", "_flags", "What to mind about the fact."),
    ("derived", "_citations", "The papers behind the fact."),
    ("derived", "_pmids", "The papers' numbers."),
    ("derived", "_chunk_ids", "The passages behind the fact."),
    ("derived", "_standard_notation", "The change in standard notation."),
)


def entries(spark: SparkSession, own: DataFrame | None = None) -> DataFrame:
    """The whole glossary (kind, term, text); terms of `own` come before the engine's."""
    built = spark.createDataFrame(TERMS, "kind string, term string, text string")
    if own is None:
        return built
    return own.select("kind", "term", "text").unionByName(built.join(own.select("kind", "term"), ["kind", "term"], "left_anti"))


def _plain(name: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(name, "\\s+", " ")))


def _found(rows: DataFrame, glossary: DataFrame, kinds: tuple[str, ...], keys: list[Column]) -> DataFrame:
    """The definition under the first key, and then the first kind, that has one; empty where none has."""
    terms = glossary.filter(F.col("kind").isin(*kinds)).groupBy("kind", _plain(F.col("term")).alias("_term")).agg(F.min("text").alias("_text"))
    tried = F.array(*[F.struct(F.lit(i * len(kinds) + j).alias("at"), F.lit(kind).alias("kind"), key.alias("_term")) for i, key in enumerate(keys) for j, kind in enumerate(kinds)])
    asked = rows.select("_asked").distinct().select("_asked", F.inline(tried))
    first = asked.join(terms, ["kind", "_term"]).groupBy("_asked").agg(F.min_by("_text", "at").alias("text"))
    return rows.join(first, "_asked", "left").withColumn("text", F.coalesce("text", F.lit("")))


def describe_flags(rows: DataFrame, glossary: DataFrame, flag: str = "flag") -> DataFrame:
    """Rows with the definition of their flag as `text`, which replaces a column of that name."""
    asked = rows.drop("text").withColumn("_asked", F.coalesce(F.col(flag), F.lit("")))
    keys = [_plain(F.col("_asked")), _plain(F.substring_index("_asked", ":", 1))]
    return _found(asked, glossary, ("flag",), keys).drop("_asked")


def describe_columns(rows: DataFrame, glossary: DataFrame, column: str = "column") -> DataFrame:
    """Rows with the definition of the column they name as `text`."""
    asked = rows.drop("text").withColumn("_asked", F.coalesce(F.col(column), F.lit("")))
    return _found(asked, glossary, ("column", "derived"), [_plain(F.col("_asked"))]).drop("_asked")
