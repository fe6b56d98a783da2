"""Citation markers to passages and papers.

A query has at most 100 sources, so they travel as one array per query: the only shuffle
is the join on query_id before the answers are exploded. Each source's citation is made once
per answer (`citations_of`), and resolving a row's markers takes it from there by place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import clean, let
from factloom.schema import CITATION, METADATA
from factloom.session import spread

_NUMBERS = "array<int>"
_NO_SOURCE = f"struct<source_rank:int,doc_id:string,chunk_id:string,score:double,metadata:{METADATA}>"
_SPAN = "^\\[(\\d{1,9})\\s*[-–]\\s*(\\d{1,9})\\]$"


def sources_by_query(sources: DataFrame) -> DataFrame:
    """query_id and its sources in marker order."""
    fields = ["source_rank", "doc_id", "chunk_id", "score", "metadata"]
    return sources.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("sources"))


def with_sources(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """Answers with their sources, spread by query for the parsing that follows."""
    listed = sources_by_query(spread(sources, "query_id"))
    none = F.array().cast(listed.schema["sources"].dataType)
    joined = spread(answers, "query_id").join(listed, "query_id", "left")
    return joined.withColumn("sources", F.coalesce("sources", none))


def _ints(text: Column) -> Column:
    numbers = F.transform(F.regexp_extract_all(text, F.lit("\\d+"), F.lit(0)), lambda x: x.try_cast("int"))
    return F.filter(numbers, lambda x: x.isNotNull())


def _expanded(part: Column, limit: Column) -> Column:
    """ "1-3" is a span, anything else a list; a span reaches one marker past the sources."""
    def of(numbers: Column) -> Column:
        low, high = F.array_min(numbers), F.array_max(numbers)
        span = F.sequence(low, F.greatest(low, F.least(high, limit + 1)))
        return F.when((F.size(numbers) == 2) & part.rlike("[-–]"), span).otherwise(numbers)

    return let(_ints(part), of)


def parse_markers(text: Column, n_sources: Column, bare: Column | bool = False, *, strict: bool = False) -> Column:
    """Distinct markers in order. strict: brackets hold one number, a pair or a span only."""
    text = F.coalesce(text, F.lit(""))
    limit = F.coalesce(n_sources, F.lit(0))
    more = "?" if strict else "*"
    bodies = F.regexp_extract_all(text, F.lit(f"\\[(\\d+(?:\\s*[-,–]\\s*\\d+){more})\\]"), F.lit(1))
    spans = lambda body: F.flatten(F.transform(F.split(body, ","), lambda p: _expanded(p, limit)))
    marked = F.flatten(F.transform(bodies, spans))
    trimmed = F.trim(text)
    # The usual texts, one marker or one span, need no lists.
    one = F.array(F.substring(text, F.lit(2), F.length(text) - 2).try_cast("int"))
    ends = [F.regexp_extract(text, _SPAN, k).try_cast("int") for k in (1, 2)]
    low = F.least(*ends)
    span = F.sequence(low, F.greatest(low, F.least(F.greatest(*ends), limit + 1)))
    lone = F.when(
        F.lit(bare) if isinstance(bare, bool) else bare,
        F.when(trimmed.rlike("^[\\d\\s,;–-]+$"), F.filter(_expanded(trimmed, limit), lambda m: (m >= 1) & (m <= limit))),
    )
    none = F.array().cast(_NUMBERS)
    listed = let(marked, lambda m: F.array_distinct(F.when(F.size(m) > 0, m).otherwise(F.coalesce(lone, none))))
    return F.when(text.rlike("^\\[\\d{1,9}\\]$"), one).when(text.rlike(_SPAN), span).otherwise(listed)


def _text(value: Column) -> Column:
    trimmed = F.trim(value.cast("string"))
    return F.when(trimmed != "", trimmed)


def citation(marker: Column, sources: Column, matched_by: str = "marker") -> Column:
    """The citation of one marker; unresolved where there is no such source."""
    def of(source: Column) -> Column:
        meta, found = source["metadata"], source.isNotNull()
        chunk = F.struct(
            marker.cast("int").alias("marker"),
            F.coalesce(source["chunk_id"], F.lit("")).alias("chunk_id"),
            F.coalesce(source["doc_id"], F.lit("")).alias("doc_id"),
            meta["start_char"].alias("start_char"),
            meta["end_char"].alias("end_char"),
            source["score"].cast("double").alias("score"),
        )
        return F.struct(
            marker.cast("int").alias("marker"),
            *[_text(meta[c]).alias(c) for c in ("pmid", "pmcid", "doi", "journal", "year", "title")],
            F.get(meta["authors"], F.lit(0)).alias("first_author"),
            found.alias("resolved"),
            F.lit(matched_by).alias("matched_by"),
            F.when(found, F.array(chunk)).otherwise(F.array().cast("array<struct<marker:int,chunk_id:string,doc_id:string,start_char:int,end_char:int,score:double>>")).alias("chunks"),
        ).cast(CITATION)

    return let(F.when(marker >= 1, F.get(sources, marker - 1)), of)


def citations_of(sources: Column) -> Column:
    """The citation of each place in an answer's sources, and its marker among them, as `matched_by` tells it for numbers."""
    return F.transform(sources, lambda s, i: citation(i + 1, sources))


def _at(marker: Column, known: Column) -> Column:
    """The citation of one marker among those of all sources."""
    return F.coalesce(F.when(marker >= 1, F.get(known, marker - 1)), citation(marker, F.array().cast(f"array<{_NO_SOURCE}>")))


def surname(author: Column) -> Column:
    """Last word of a name, lower-cased; null for fewer than three letters."""
    last = F.lower(F.btrim(F.regexp_extract(author, "([^\\s,]++)[\\s,]*+\\z", 1), F.lit(".")))
    return F.when(F.length(last) >= 3, last)


def match_by_author(text: Column, known: Column, ranks: Column) -> Column:
    """Citations of the sources whose first author the text names, and whose year it allows."""
    def of(told: Column) -> Column:
        lowered, year = told["text"], told["year"]

        def fits(source: Column) -> Column:
            def named(name: Column) -> Column:
                # A pattern is made only where the name is in the text at all.
                return F.contains(lowered, name) & F.regexp_like(lowered, F.concat(F.lit("(?U)\\b\\Q"), name, F.lit("\\E\\b")))

            own = source["year"]
            return F.coalesce(((year == "") | own.isNull() | (year == own)) & let(surname(source["first_author"]), named), F.lit(False))

        found = F.filter(F.transform(known, lambda c, i: F.when(fits(c), F.get(ranks, i))), lambda m: m.isNotNull())
        return F.transform(found, lambda m: _at(m, known).withField("matched_by", F.lit("author")))

    lowered = F.lower(F.coalesce(text, F.lit("")))
    return let(F.struct(lowered.alias("text"), F.regexp_extract(lowered, "\\b((?:19|20)\\d{2})\\b", 1).alias("year")), of)


def document_key(c: Column) -> Column:
    return F.coalesce(c["pmid"], c["doi"], c["pmcid"], F.concat(F.lit("marker:"), c["marker"].cast("string")))


def distinct_by(array: Column, key) -> Column:
    """First element of each key, in order."""
    return let(F.transform(array, key), lambda keys: F.filter(array, lambda x, i: F.array_position(keys, F.get(keys, i)) == i + 1))


def chunk_key(chunk: Column) -> Column:
    return F.coalesce(F.when(chunk["chunk_id"] != "", chunk["chunk_id"]), chunk["marker"].cast("string"))


def collapse_by_document(citations: Column) -> Column:
    """One citation per document that keeps every passage, passages by marker."""
    def merged(own: Column) -> Column:
        chunks = F.sort_array(distinct_by(F.flatten(F.transform(own, lambda c: c["chunks"])), chunk_key))
        return own[0].withField("chunks", chunks)

    def of(keys: Column) -> Column:
        return F.transform(F.array_distinct(keys), lambda key: let(F.filter(citations, lambda c, i: F.get(keys, i) == key), merged))

    return let(F.transform(citations, document_key), of)


def with_citations(rows: DataFrame, text: Column, bare: Column | bool = False, *, strict: bool = False) -> DataFrame:
    """Adds the citations of a reference text: by marker, otherwise by first author.

    rows: with `_known`, their answer's `citations_of`, and `_ranks`, its sources' ranks. Steps
    that are read twice are columns, and most rows have one citation, which needs no merging.
    """
    known, cited, markers = F.col("_known"), F.col("_cited"), F.col("_markers")
    marked = rows.withColumn("_cited", text).withColumn("_markers", parse_markers(cited, F.size(known), bare, strict=strict))
    found = marked.withColumn("citations", F.when(F.size(markers) > 0, F.transform(markers, lambda m: _at(m, known))).otherwise(match_by_author(cited, known, F.col("_ranks"))))
    several = F.size("citations") > 1
    keys = F.when(several, F.transform("citations", document_key))
    keyed = found.withColumn("_keys", keys)
    # Each citation has one passage at the most before this.
    apart = F.size(F.array_distinct("_keys")) == F.size("_keys")
    return keyed.withColumn("citations", F.when(~several | apart, F.col("citations")).otherwise(collapse_by_document(F.col("citations")))).drop("_markers", "_keys")


def has_reference_text(text: Column) -> Column:
    return clean(text).rlike("[A-Za-z]{3,}")


def short(c: Column) -> Column:
    """Compact citation; null fields are left out."""
    marker = F.concat(F.lit("["), c["marker"].cast("string"), F.lit("]"))
    parts = F.concat_ws(
        " ",
        F.concat(F.when(c["first_author"] != "", c["first_author"]), F.lit(" et al.")),
        c["journal"],
        F.concat(F.lit("("), c["year"], F.lit(")")),
        F.coalesce(F.concat(F.lit("PMID:"), c["pmid"]), F.concat(F.lit("DOI:"), c["doi"])),
    )
    return F.when(~c["resolved"], F.concat(marker, F.lit(" unresolved"))).when(parts != "", parts).otherwise(marker)


def url(c: Column) -> Column:
    return F.coalesce(
        F.concat(F.lit("https://doi.org/"), c["doi"]),
        F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), c["pmid"], F.lit("/")),
        F.concat(F.lit("https://www.ncbi.nlm.nih.gov/pmc/articles/"), c["pmcid"], F.lit("/")),
    )
