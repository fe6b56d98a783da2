"""Search text, budgets, context blocks and prompts as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import vocab
from factloom.schema import Template

CHARS_PER_TOKEN = 3.5
RESERVED_TOKENS = 4000
MARGIN_TOKENS = 1024
MIN_CONTEXT_TOKENS = 4000
TOKENS_PER_SOURCE = 170
MAX_OUTPUT_TOKENS = 20000
DEFAULT_OUTPUT_TOKENS = 2500
SEPARATOR = "\n\n---\n\n"
#: What each block costs besides its text.
SEPARATOR_CHARS = 7

RULES = {
    "method": "Method names a technique, never a kind of evidence; N/A where the source names none.",
    "mutation": "Mutation is written as reference, position, variant (S315T); one mutation per row.",
    "assertion": "Assertion is exactly one of: " + ", ".join(vocab.ASSERTIONS) + ".",
}


def _part(value: Column) -> Column:
    trimmed = F.trim(F.coalesce(value, F.lit("")))
    return F.when(trimmed != "", trimmed)


def search_text(organism: Column, genes: Column, other_terms: Column, template: Template | None = None) -> Column:
    label = F.lit(template.label) if template is not None and template.is_table else F.lit(None)
    return F.concat_ws(" ", _part(organism), _part(genes), _part(label.cast("string")), _part(other_terms))


def request_body(query: Column, top_k: Column, mode: Column, *, template: Column | None = None, slots: Column | None = None, collections: Column | None = None, filters: Column | None = None) -> Column:
    """The JSON request of a query for a search service, without what is empty.

    slots: a map; collections: an array, of which one name is sent as `collection` and
    several, without repeats, as `collections`; filters: a map or struct.
    """
    none = F.lit(None).cast("string")
    names = F.array_distinct(F.filter(F.coalesce(collections, F.array().cast("array<string>")), lambda c: c != "")) if collections is not None else F.array().cast("array<string>")
    parts = {
        "query": query, "top_k": top_k, "use_graph": F.lit(False), "retrieval_mode": mode, "template": none if template is None else _part(template),
        "template_vars": none if slots is None else F.when(F.size(slots) > 0, slots), "collection": F.when(F.size(names) == 1, F.get(names, F.lit(0))),
        "collections": F.when(F.size(names) > 1, names), "filters": none if filters is None else filters,
    }
    return F.to_json(F.struct(*[v.alias(k) for k, v in parts.items()]))


def output_tokens(template: Template, n_sources: Column) -> Column:
    declared = template.max_output_tokens or DEFAULT_OUTPUT_TOKENS
    if not template.is_table:
        return F.lit(declared)
    return F.greatest(F.lit(declared), F.least(F.lit(MAX_OUTPUT_TOKENS), TOKENS_PER_SOURCE * F.greatest(F.lit(1), n_sources)))


def context_tokens(window: int | Column, output: Column, override: Column | None = None) -> Column:
    left = F.greatest(F.lit(MIN_CONTEXT_TOKENS), (F.lit(window) if isinstance(window, int) else window) - output - MARGIN_TOKENS)
    return left if override is None else F.coalesce(override, left)


def context_chars(tokens: Column) -> Column:
    return F.floor(F.greatest(F.lit(1), tokens - RESERVED_TOKENS) * CHARS_PER_TOKEN).cast("bigint")


def source_block(marker: Column, title: Column, pmid: Column, doi: Column, content: Column) -> Column:
    ident = F.coalesce(F.concat(F.lit("[PMID: "), _part(pmid), F.lit("]")), F.concat(F.lit("[DOI: "), _part(doi), F.lit("]")))
    head = F.concat_ws(" ", F.concat(F.lit("Source "), marker.cast("string")), F.concat(F.lit("("), _part(title), F.lit(")")), ident)
    return F.concat(head, F.lit(":\n"), F.coalesce(content, F.lit("")))


def within_budget(ranked: DataFrame, size: str, max_chars: str | Column, *, order: str = "source_rank") -> DataFrame:
    """The prefix of each query's passages that fits; the first one always stays.

    The running sum grows strictly, so a filter on it is a prefix.
    """
    upto = Window.partitionBy("query_id").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    limit = F.col(max_chars) if isinstance(max_chars, str) else max_chars
    used = F.sum(F.col(size) + SEPARATOR_CHARS).over(upto) - SEPARATOR_CHARS
    return ranked.withColumn("_used", used).filter((F.col("_used") <= limit) | (F.col(order) == 1)).drop("_used")


def contexts(included: DataFrame, block: str = "block") -> DataFrame:
    """query_id, context and n_included; at most 100 blocks per query."""
    parts = F.array_sort(F.collect_list(F.struct("source_rank", block)))
    return included.groupBy("query_id").agg(parts.alias("_p"), F.count("*").cast("int").alias("n_included")).select(
        "query_id", F.array_join(F.transform("_p", lambda p: p[block]), SEPARATOR).alias("context"), "n_included"
    )


def subject(organism: Column, genes: Column, other_terms: Column) -> Column:
    optional = lambda text, value: F.coalesce(F.concat(F.lit(text), _part(value)), F.lit(""))
    return F.concat(F.lit(' for organism "'), organism, F.lit('"'), optional(" involving genes/proteins: ", genes), optional(", related to: ", other_terms))


def column_rules(columns) -> list[str]:
    return list(dict.fromkeys(RULES[k] for k in (" ".join(c.split()).lower() for c in columns) if k in RULES))


def prompt(template: Template, about: Column, context: Column, n_included: Column, instructions: Column | None = None) -> Column:
    """The whole prompt; user instructions are added after the rules."""
    valid = F.concat(F.lit("Cite sources as [n]; valid numbers are 1 to "), n_included.cast("string"), F.lit("."))
    if template.is_table:
        rules = ["Write the header, then one row per finding, columns separated by one tab.", "Write N/A for what isn't stated.",
                 "Report only what the numbered sources state, and go through all of them.", "Write nothing besides the table."]
        rules += ["Every row needs a real value in: " + ", ".join(template.required) + "."] * bool(template.required)
        rules += [*column_rules(template.columns), *template.guidance]
        body = F.concat(
            F.lit(f"Extract {template.label}"), about, F.lit(".\n\nColumns:\n" + "\t".join(template.columns) + "\n\nRules:\n- "), valid,
            F.lit("\n- " + "\n- ".join(rules)),
        )
    else:
        body = F.concat(F.lit("Summarise the literature below"), about, F.lit(".\n\n"), valid)
    extra = F.lit("") if instructions is None else F.coalesce(F.concat(F.lit("\n\nFurther instructions:\n"), _part(instructions)), F.lit(""))
    return F.concat(body, extra, F.lit("\n\n--- SOURCES ---\n\n"), context)


def prompt_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)
