"""Facts as flat tables, JSON, Markdown and text, with their annotations and provenance.

Records are made by expressions and written by Spark's writers, so an export of any size
stays distributed; only `as_document`, `as_markdown` and `as_table` gather their rows, for
a person to read, and need the caller's word on how many rows they may take.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from factloom.operators import citations as C
from factloom.operators.merge import display, facts_of, members
from factloom.session import moved, removed

# The names of the exported columns.
ANNOTATIONS = ("_n_support", "_flags", "_citations", "_pmids", "_chunk_ids", "_markers", "_standard_notation", "_as_written")
PROVENANCE = (
    "_query_id", "_template", "_template_version", "_template_hash", "_model", "_collection", "_top_k", "_retrieval_mode",
    "_retrieved_at", "_request_id", "_generator", "_llm_endpoint", "_prompt_hash",
)
WIDEST = 34
#: Specs whose queries share a record of `json_pages`.
PAGE = 100_000
FORMS = ("tsv", "csv", "json", "jsonl")


def pmids(citations: Column) -> Column:
    """Numbers of the cited papers that have one, repeats included."""
    return F.filter(citations["pmid"], lambda x: x.isNotNull() & (x != ""))


def _chunks(citations: Column) -> Column:
    return F.flatten(citations["chunks"])


def chunk_ids(citations: Column) -> Column:
    """Distinct passages in order."""
    return F.array_distinct(_chunks(citations)["chunk_id"])


def markers(citations: Column) -> Column:
    """Distinct markers of the cited passages, or of an unresolved citation, sorted."""
    own = F.transform(citations, lambda c: F.when(F.size(c["chunks"]) > 0, F.transform(c["chunks"], lambda k: k["marker"])).otherwise(F.array(c["marker"])))
    return F.sort_array(F.array_distinct(F.filter(F.flatten(own), lambda m: m.isNotNull())))


def citation_text(citations: Column) -> Column:
    return F.array_join(F.transform(citations, C.short), "; ")


def _converted(columns: Sequence[str], value) -> Column:
    """Converted columns by name: the value alone where there is only one."""
    several = F.size("standard") > 1
    shown = [
        F.when(F.try_element_at("standard", F.lit(c)).isNotNull(), F.concat(F.when(several, F.lit(f"{c}=")).otherwise(""), F.coalesce(value(c), F.lit(""))))
        for c in sorted(columns)
    ]
    return F.concat_ws(";", *shown) if shown else F.lit("")


def annotated(facts: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The displayed cells and the eight annotations of each fact."""
    joined = lambda array: F.array_join(array, ";")
    cells = [display(c).alias(c) for c in columns]
    notes = [
        F.col("n_support"), joined(F.col("flags")), citation_text(F.col("citations")), joined(pmids(F.col("citations"))),
        joined(chunk_ids(F.col("citations"))), joined(F.transform(markers(F.col("citations")), lambda m: m.cast("string"))),
        _converted(columns, lambda c: F.try_element_at("standard", F.lit(c))), _converted(columns, lambda c: F.col("values")[c]),
    ]
    rest = [c for c in facts.columns if c in PROVENANCE]
    return facts.select(*cells, *[n.alias(a) for n, a in zip(notes, ANNOTATIONS, strict=True)], *rest)


def now() -> Column:
    """The time of the run in UTC, to the second, as provenance tells it."""
    utc = F.convert_timezone(None, F.lit("UTC"), F.current_timestamp().cast("timestamp_ntz"))
    return F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def stamped(facts: DataFrame, runs: DataFrame, at: Column | None = None) -> DataFrame:
    """Facts with their run's provenance columns; runs has one row for each query_id.

    A fact of several queries takes the first one's. Missing entries are empty, but for
    `_retrieved_at`, which is `at` where given, as for answers that were just made (`now`).
    """
    record = runs.select(F.col("query_id").alias("_query_id"), *[F.col(c).cast("string").alias(c) for c in PROVENANCE[1:] if c in runs.columns])
    named = facts.withColumn("_query_id", F.coalesce(F.get("query_ids", F.lit(0)), F.lit("")))
    joined = named.join(record, "_query_id", "left")
    defaults = {"_collection": F.lit("default")} | ({} if at is None else {"_retrieved_at": at})
    return joined.withColumns({c: F.coalesce(F.col(c) if c in joined.columns else F.lit(None).cast("string"), defaults.get(c, F.lit(""))) for c in PROVENANCE})


def json_records(facts: DataFrame, columns: Sequence[str], *, structured: bool = True) -> DataFrame:
    """One JSON text for each fact with its raw cells; structured: with variants and query ids."""
    parts = [F.col("values")[c].alias(c) for c in columns]
    parts += [F.col("citations"), chunk_ids(F.col("citations")).alias("chunk_ids"), F.col("standard"), F.col("flags"), F.col("n_support")]
    parts += [F.col("variants"), F.col("query_ids")] if structured else []
    own = [c for c in PROVENANCE if c in facts.columns]
    parts += [F.struct(*own).alias("provenance")] if own else []
    return facts.select(F.to_json(F.struct(*parts)).alias("value"))


def json_pages(parts: DataFrame, template_id: str, columns: Sequence[str]) -> DataFrame:
    """JSON texts of facts from their `merge` parts, whose query ids may be too many for one text.

    A fact's record is that of `json_records`, with its `identity` and the `page` of its first
    arrival, and holds that page's query ids; each other page is a record of identity, page
    and query_ids. Page k is of the queries that came in places k * PAGE to (k + 1) * PAGE - 1
    of the specs, so a fact's pages, one after the other, list its query ids by arrival.
    """
    page = lambda ord: F.floor(F.coalesce(F.col(ord)["spec_ord"], F.lit(0)) / PAGE).alias("page")
    facts = facts_of(parts.filter("kind <> 'query'"), template_id, columns, listed=True).drop("query_ids", "n_queries").withColumn("page", page("first"))
    asked = members(parts, "query").select("identity", page("first"), F.struct("first", "query_id").alias("q"))
    pages = asked.groupBy("identity", "page").agg(F.sort_array(F.collect_list("q"))["query_id"].alias("query_ids"))
    both = facts.withColumn("_fact", F.lit(True)).join(pages, ["identity", "page"], "full")
    both = both.withColumn("query_ids", F.coalesce("query_ids", F.array().cast("array<string>")))
    named = [F.col("values")[c].alias(c) for c in columns]
    named += [F.when(F.col("_fact"), v).alias(n) for n, v in (("citations", F.col("citations")), ("chunk_ids", chunk_ids(F.col("citations"))), ("standard", F.col("standard")), ("flags", F.col("flags")), ("n_support", F.col("n_support")), ("variants", F.col("variants")))]
    return both.select(F.to_json(F.struct(*named, "query_ids", "identity", "page")).alias("value"))


def source_summary(sources: DataFrame) -> DataFrame:
    """What an answer's reader is told about each source."""
    meta = [F.col("metadata")[c].alias(c) for c in ("start_char", "end_char")]
    told = [F.col("metadata")[c].alias(c) for c in ("title", "journal", "year", "pmid", "pmcid", "doi", "authors")]
    return sources.select("query_id", "source_rank", "doc_id", "chunk_id", *meta, "score", *told, F.coalesce("content", F.lit("")).alias("content"))


def write(facts: DataFrame, columns: Sequence[str], path: str, form: str, *, replace: bool = False) -> int:
    """Writes a folder of tsv, csv, json or jsonl files, and gives its number of rows.

    replace: the new files are written beside the old ones, counted on the way, and take
    their place only when they are whole; a run that fails, or finds nothing where there
    were rows, leaves the old ones as they were.
    """
    if form not in FORMS:
        raise ValueError(f"no such form: {form}; known are {', '.join(FORMS)}")
    spark, counted = facts.sparkSession, Observation()
    target = f"{path.rstrip('/')}.new-{uuid.uuid4().hex}" if replace else path
    rows = facts.observe(counted, F.count("*").alias("n"))
    try:
        if form in ("tsv", "csv"):
            annotated(rows, columns).write.csv(target, sep="\t" if form == "tsv" else ",", header=True, emptyValue="", escape='"')
        else:
            json_records(rows, columns, structured=form == "json").write.text(target)
        n = counted.get["n"]
        if replace:
            if not n and _holds_rows(spark, path, form):
                raise ValueError(f"{path} has rows, and the new table has none")
            old = f"{path.rstrip('/')}.old-{uuid.uuid4().hex}"
            moved(spark, path, old)
            if not moved(spark, target, path):
                moved(spark, old, path)
                raise OSError(f"{target} could not take the place of {path}")
            removed(spark, old)
        return n
    finally:
        if replace:
            removed(spark, target)


def _holds_rows(spark: SparkSession, path: str, form: str) -> bool:
    try:
        held = spark.read.csv(path, header=True) if form in ("tsv", "csv") else spark.read.text(path)
        return not held.isEmpty()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return False


def as_document(facts: DataFrame, columns: Sequence[str], *, most: int, meta: dict | None = None) -> str:
    """One JSON document; refuses more than `most` rows."""
    rows = [json.loads(r.value) for r in _few(json_records(facts, columns), most)]
    return json.dumps({"columns": list(columns), "n_rows": len(rows), "rows": rows} | ({"meta": meta} if meta else {}), indent=2, ensure_ascii=False)


def as_markdown(facts: DataFrame, columns: Sequence[str], *, most: int) -> str:
    shown = [*columns, "_n_support", "_citations"]
    line = lambda cells: "| " + " | ".join(str(x).replace("|", "\\|").replace("\n", " ") for x in cells) + " |\n"
    body = "".join(line([r[c] for c in shown]) for r in _few(annotated(facts, columns), most))
    return line(shown) + line(["---"] * len(shown)) + body


def as_table(facts: DataFrame, columns: Sequence[str], *, most: int) -> str:
    """Aligned text; cells of over WIDEST characters are cut."""
    cut = lambda x: x if len(x := str(x).replace("\n", " ")) <= WIDEST else x[: WIDEST - 1] + "…"
    flags = lambda told: ",".join(f.split(":")[0] for f in told.split(";") if f)
    rows = [[*[cut(r[c]) for c in columns], str(r["_n_support"]), cut(flags(r["_flags"]))] for r in _few(annotated(facts, columns), most)]
    head = [*map(cut, columns), "n", "flags"]
    widths = [max(map(len, x)) for x in zip(head, *rows, strict=True)]
    line = lambda cells: "  ".join(c.ljust(w) for c, w in zip(cells, widths, strict=True)).rstrip() + "\n"
    return line(head) + "  ".join("-" * w for w in widths) + "\n" + "".join(map(line, rows))


def _few(df: DataFrame, most: int) -> list:
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows; write them to files instead")
    return rows


def prose(answers: DataFrame) -> DataFrame:
    """Prose answers under headings, one text for each query, in the order of the specs."""
    head = F.concat(F.lit("### "), F.concat_ws(" ", *[F.when(F.col(c) != "", F.col(c)) for c in ("organism", "genes")]))
    return answers.orderBy("spec_ord").select("query_id", F.concat(head, F.lit("\n\n"), F.coalesce("answer", F.lit(""))).alias("value"))


def prose_records(answers: DataFrame) -> DataFrame:
    """One JSON text for each prose answer (`extract_text`), with its resolved citations and their passages."""
    named = [c for c in ("query_id", "organism", "genes", "data_type") if c in answers.columns]
    parts = [*named, F.col("values.Answer").alias("answer"), "citations", chunk_ids(F.col("citations")).alias("chunk_ids")]
    own = [c for c in PROVENANCE if c in answers.columns]
    parts += [F.struct(*own).alias("provenance")] if own else []
    return answers.select(F.to_json(F.struct(*parts)).alias("value"))
