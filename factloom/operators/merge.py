"""Merging rows that state the same fact.

Rows are grouped by a normalised identity. What a merged row needs is turned into parts, one
for each distinct value, flag, citation, query id and so on of a fact, with its first and
last arrival and its number of rows. Parts are mergeable: minima, maxima and sums over any
split of the rows, in any order, give the parts of the whole, so that facts may be merged at
once (`merge_facts`) or batch by batch (`streaming.facts`).

Each spelling of an identity is normalised once, and rows get theirs by a join. Rows that
say the same, whatever their place, query and citations, become one before they are taken
apart, with partial aggregation in hash tables, so a fact that a third of all rows state is
one record for each distinct wording before it is gathered; queries and citations, which
grow with the rows, go their own way. `facts_of` gathers what its spellings and flags bound;
queries and citations are counted, and listed as arrays only where asked for; `members`
gives them as keyed tables.

Variants compare each arrival with the running representative, so distinct spellings are
replayed in order, at their first and at their last arrival.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import vocab
from factloom.functions.normalize import normalize_cell, own_gene
from factloom.operators.citations import chunk_key, distinct_by, document_key
from factloom.session import spread, stage

ORDER = ("spec_ord", "row_ord", "split_ord")
_PLACE = "struct<spec_ord:bigint,row_ord:int,split_ord:int>"
#: Row and split places below this are refused, so that any place fits a decimal; fixed values.
LOWEST = -500_000_000
_INTS = 2**31 - LOWEST + 1


def identity_columns(template_id: str, columns: Sequence[str]) -> list[str]:
    own = [c for c in vocab.IDENTITY.get(template_id, ()) if c in columns]
    return own or [c for c in columns if c.strip().lower() not in vocab.REFERENCE]


def identity_key(template_id: str, columns: Sequence[str], values: str = "values") -> Column:
    """Array of the normalised identity; an unordered pair is sorted."""
    identity = identity_columns(template_id, columns)
    value = lambda c: F.col(values)[c]
    gene = next((value(c) for c in identity if c.strip().lower() in vocab.KEY_GENE), None)
    pair = vocab.SYMMETRIC.get(template_id)
    if pair and all(c in identity for c in pair):
        others = [normalize_cell(c, value(c), gene) for c in identity if c not in pair]
        return F.concat(F.array(F.lit(template_id), *others), F.array_sort(F.array(*[normalize_cell(c, value(c)) for c in pair])))
    return F.array(F.lit(template_id), *[normalize_cell(c, value(c), gene) for c in identity])


def _normalised(spelled: DataFrame, template_id: str, columns: Sequence[str]) -> DataFrame:
    """Staged spellings (`values`) with their `identity`.

    Each distinct cell is normalised once, a notation once for each gene that it may name, so
    that it doesn't matter how many spellings the cells make up together. What is normalised
    is staged, so that Spark knows its size and broadcasts a small table; spread, for it is
    what costs.
    """
    identity = identity_columns(template_id, columns)
    gene = next((c for c in identity if c.strip().lower() in vocab.KEY_GENE), None)
    for i, c in enumerate(identity):
        own, told = f"_own{i}", f"_told{i}"
        value = F.col("values")[c]
        of = own_gene(value, F.col("values")[gene]) if gene and c.strip().lower() in vocab.NOTATION else F.lit(None).cast("string")
        spelled = spelled.withColumn(own, F.struct(value.alias("v"), of.alias("g")))
        cells = spread(spelled.select(own).distinct()).select(F.col(own).alias("_cell"), normalize_cell(c, F.col(own)["v"], F.col(own)["g"]).alias(told))
        spelled = spelled.join(stage(cells, "merge-cells"), F.col(own).eqNullSafe(F.col("_cell"))).drop("_cell", own)
    told = {c: F.col(f"_told{i}") for i, c in enumerate(identity)}
    pair = vocab.SYMMETRIC.get(template_id) or ()
    pair = pair if pair and all(c in identity for c in pair) else ()
    key = F.array(F.lit(template_id), *[told[c] for c in identity if c not in pair])
    key = F.concat(key, F.array_sort(F.array(*[told[c] for c in pair]))) if pair else key
    return spelled.withColumn("identity", key).drop(*[f"_told{i}" for i in range(len(identity))])


def support(rows: DataFrame, template_id: str, columns: Sequence[str]) -> DataFrame:
    """Identity and number of supporting rows, which are counted by spelling first."""
    parts = [F.col("values")[c].alias(c) for c in identity_columns(template_id, columns)]
    spelled = stage(rows.groupBy(F.struct(*parts).alias("values")).agg(F.count("*").alias("_n")), "merge-spellings")
    return _normalised(spelled, template_id, columns).groupBy("identity").agg(F.sum("_n").alias("n_support"))


def _item(kind: str | Column, at: Column, name: Column, text: Column, n: Column | None = None, rows: Column | None = None, lead: Column | None = None) -> Column:
    none = F.lit(0).cast("bigint")
    return F.struct(
        F.lit(kind).alias("kind"), at.cast("int").alias("at"), name.alias("name"), text.alias("text"),
        (none if n is None else n).alias("n"), (none if rows is None else rows).alias("rows"), (F.lit(None) if lead is None else lead).alias("lead"),
    )


def _items(columns: Sequence[str], folded: Sequence[str], first: Sequence[str]) -> Column:
    """All parts of what a row says, as one array; it stands for `rows` rows with `n` support."""
    lead = F.struct(*[F.coalesce(F.col("values")[c], F.lit("")).alias(c) for c in first])
    empty = F.lit("")
    whole = F.array(_item("row", F.lit(0), empty, empty, F.col("n"), F.col("rows"), lead))
    cells = [_item("value", F.lit(i), F.lit(c), F.coalesce(F.col("values")[c], empty)) for i, c in enumerate(columns) if c in folded]
    flags = F.transform("flags", lambda f, i: _item("flag", i, f, empty))
    notations = F.transform("standard", lambda e, i: _item("standard", i, e["key"], e["value"]))
    old = F.flatten(F.transform("variants", lambda e: F.transform(e["value"], lambda v, i: _item("variant", i, e["key"], v))))
    return F.concat(whole, flags, notations, old, *([F.array(*cells)] if cells else []))


def _passages() -> Column:
    """at, name, text and payload of each passage that a row cites, or of a citation without passages."""
    def passage(c: Column, i: Column, name: Column, payload: Column) -> Column:
        return F.struct(i.cast("int").alias("at"), name.alias("name"), _document(c).alias("text"), payload.alias("payload"))

    def of(c: Column, i: Column) -> Column:
        each = F.transform(c["chunks"], lambda k: passage(c, i, F.concat_ws("\x1f", F.col("_source"), chunk_key(k)), c.withField("chunks", F.array(k))))
        return F.when(F.size(c["chunks"]) > 0, each).otherwise(F.array(passage(c, i, F.col("_source"), c)))

    return F.flatten(F.transform("citations", of))


def _document(c: Column) -> Column:
    """A paper's key; markers without metadata only mean something inside their query."""
    bare = F.coalesce(c["pmid"], c["doi"], c["pmcid"]).isNull()
    return F.when(bare, F.concat_ws(" ", F.col("_source"), document_key(c))).otherwise(document_key(c))


def _prepared(rows: DataFrame) -> DataFrame:
    """Fills in what a row needn't have."""
    have = set(rows.columns)
    defaults = {
        "spec_ord": F.lit(0).cast("bigint"),
        "row_ord": F.lit(0),
        "split_ord": F.lit(0),
        "n_support": F.lit(1).cast("bigint"),
        "query_id": F.lit(""),
        "flags": F.array().cast("array<string>"),
        "standard": F.create_map().cast("map<string,string>"),
        "variants": F.create_map().cast("map<string,array<string>>"),
    }
    rows = rows.withColumns({c: v for c, v in defaults.items() if c not in have})
    if "query_ids" not in have:
        rows = rows.withColumn("query_ids", F.filter(F.array("query_id"), lambda q: q != ""))
    if "citations" not in have:
        from factloom.schema import CITATION

        rows = rows.withColumn("citations", F.array().cast(f"array<{CITATION}>"))
    return rows.withColumn("_source", F.coalesce(F.try_element_at("query_ids", F.lit(1)), F.lit("")))


def _split(template_id: str, columns: Sequence[str]) -> tuple[list[str], list[str]]:
    """Columns that are folded over all rows, and those of which the first row counts."""
    identity = set(vocab.IDENTITY.get(template_id, ()))
    folded = [c for c in columns if c not in identity and c.strip().lower() not in vocab.REFERENCE]
    return folded, [c for c in columns if c not in folded]


def _reduced(parts: DataFrame, *keys: str) -> DataFrame:
    return parts.groupBy(*keys, "kind", "name", "text").agg(
        F.min("early").alias("early"), F.max("late").alias("late"), F.min_by("payload", "early").alias("payload"),
        F.sum("n").alias("n"), F.sum("rows").alias("rows"), F.min_by("lead", "early").alias("lead"),
    )


def _packed() -> Column:
    """A row's place as one number in the order of ORDER, nulls first.

    Minima of numbers are kept in hash tables; those of structs would have all rows sorted.
    """
    def place(name: str) -> Column:
        refused = F.raise_error(F.concat(F.lit(f"{name} is below {LOWEST}: "), F.col(name).cast("string"))).cast("bigint")
        return F.coalesce(F.when(F.col(name) < LOWEST, refused).otherwise(F.col(name).cast("bigint") - LOWEST + 1), F.lit(0).cast("bigint"))

    spec = F.coalesce(F.col(ORDER[0]).cast("decimal(20,0)"), F.lit(str(-(2**63) - 1)).cast("decimal(20,0)"))
    tail = place(ORDER[1]) * _INTS + place(ORDER[2])
    return spec * F.lit(str(_INTS**2)).cast("decimal(19,0)") + tail.cast("decimal(19,0)")


def _unpacked(packed: Column) -> Column:
    """The place that `_packed` made a number of."""
    square = F.lit(str(_INTS**2)).cast("decimal(19,0)")
    tail = F.pmod(packed, square).cast("bigint")
    known = packed >= F.lit(str(-(2**63) * _INTS**2)).cast("decimal(38,0)")
    spec = F.when(known, ((packed - tail.cast("decimal(19,0)")) / square).cast("bigint"))
    place = lambda x: F.when(x > 0, (x + LOWEST - 1).cast("int"))
    split = F.pmod(tail, F.lit(_INTS))
    row = ((tail - split).cast("decimal(19,0)") / F.lit(_INTS).cast("decimal(10,0)")).cast("bigint")
    return F.struct(spec.alias(ORDER[0]), place(row).alias(ORDER[1]), place(split).alias(ORDER[2]))


def _identified(rows: DataFrame, template_id: str, columns: Sequence[str]) -> DataFrame:
    """Rows with their `identity`. The table of spellings is staged, so that Spark knows its size and broadcasts a small one."""
    names = identity_columns(template_id, columns)
    rows = rows.withColumn("_written", F.struct(*[F.col("values")[c].alias(f"c{i}") for i, c in enumerate(names)]))
    spelled = rows.select("_written").distinct()
    values = F.struct(*[F.col("_written")[f"c{i}"].alias(c) for i, c in enumerate(names)])
    # One row for each spelling; normalising is what costs, so they go over all tasks.
    named = spread(spelled).withColumn("values", values).select(F.col("_written").alias("_spelled"), identity_key(template_id, columns).alias("identity"))
    return rows.join(stage(named, "merge-names"), F.col("_written").eqNullSafe(F.col("_spelled"))).drop("_written", "_spelled")


def fact_parts(rows: DataFrame, template_id: str, columns: Sequence[str], *, queries: bool = True) -> DataFrame:
    """Mergeable parts: identity, kind, name, text, early, late, payload, n, rows, lead.

    queries: with a part for each query of a fact, which nothing reduces; without them
    facts know nothing of their number. Rows are read once for each of their spellings,
    wordings, queries and, where they have such a column, citations; `stage` them before
    where they are dear.
    """
    cited = "citations" in rows.columns
    rows = _prepared(rows.drop("identity"))  # merged rows bring one
    citation = rows.schema["citations"].dataType.elementType
    rows = _identified(rows, template_id, columns)
    folded, first = _split(template_id, columns)
    said = rows.select(
        "identity", F.struct(*[F.col("values")[c].alias(c) for c in columns]).alias("values"), "flags", F.map_entries("standard").alias("standard"),
        F.map_entries("variants").alias("variants"), F.col("n_support").cast("bigint").alias("n_support"), _packed().alias("_place"),
    )
    said = said.groupBy("identity", "values", "flags", "standard", "variants").agg(
        F.min("_place").alias("_early"), F.max("_place").alias("_late"), F.sum("n_support").alias("n"), F.count("*").alias("rows")
    )
    # Few rows are left, of which each is several parts.
    said = spread(said).withColumns({"_early": _unpacked(F.col("_early")), "_late": _unpacked(F.col("_late"))})
    items = said.select("identity", "_early", "_late", F.inline(_items(columns, folded, first)))
    when = lambda ord: F.struct(F.col(ord).alias("ord"), F.col("at"))
    parts = _reduced(items.withColumns({"early": when("_early"), "late": when("_late"), "payload": F.lit(None).cast(citation)}), "identity")
    lead, place = parts.schema["lead"].dataType, F.struct(*ORDER).cast(_PLACE)
    others = []
    at = F.struct("ord", "at")
    if queries:
        # By query, before anything else: a query states a fact once or a few times.
        each = rows.select("identity", place.alias("ord"), F.posexplode("query_ids").alias("at", "name"))
        others.append(spread(each, "identity", "name").groupBy("identity", F.lit("query").alias("kind"), "name", F.lit("").alias("text")).agg(
            F.min(at).alias("early"), F.max(at).alias("late"), F.lit(None).cast(citation).alias("payload")))
    if cited:
        each = rows.select("identity", place.alias("ord"), F.inline(_passages())).withColumn("early", at)
        others.append(each.groupBy("identity", F.lit("citation").alias("kind"), "name", "text").agg(F.min(at).alias("early"), F.max(at).alias("late"), F.min_by("payload", "early").alias("payload")))
    nothing = {"n": F.lit(0).cast("bigint"), "rows": F.lit(0).cast("bigint"), "lead": F.lit(None).cast(lead)}
    for other in others:
        parts = parts.unionByName(other.withColumns(nothing))
    return parts


def combine(*parts: DataFrame) -> DataFrame:
    """The parts of all rows from the parts of batches of them."""
    every = parts[0]
    for other in parts[1:]:
        every = every.unionByName(other)
    return _reduced(every, "identity")


def members(parts: DataFrame, kind: str) -> DataFrame:
    """A keyed table of what may be long: kind `query` gives identity, query_id and first, `citation` identity, document, citation and first."""
    own = parts.filter(F.col("kind") == kind)
    first = F.col("early.ord").alias("first")
    if kind == "query":
        return own.select("identity", F.col("name").alias("query_id"), first)
    return own.select("identity", F.col("text").alias("document"), F.col("payload").alias("citation"), first)


def facts_of(parts: DataFrame, template_id: str, columns: Sequence[str], *, listed: bool = True) -> DataFrame:
    """One row per fact: identity, order of first arrival, values, flags, n_support,
    standard, variants, n_queries and n_passages; listed: with arrays of all its citations
    and query_ids as well.
    """
    folded, first = _split(template_id, columns)
    normal = F.lit("")
    for c in folded:
        normal = F.when((F.col("kind") == "value") & (F.col("name") == c), normalize_cell(c, F.col("text"))).otherwise(normal)
    # What is short is folded by several passes over it; long lists stay apart.
    part = F.struct("early", "late", "kind", "name", "text", "norm")
    gathered = lambda part, *kinds: F.sort_array(F.collect_list(F.when(F.col("kind").isin(*kinds), part)))
    lists = [
        gathered(F.struct("early", "late", "name", "text", "payload"), "citation").alias("_cited"), gathered(F.struct("early", "late", "name"), "query").alias("_queries"),
    ] if listed else []
    counted = lambda kind: F.count_if(F.col("kind") == kind)
    facts = parts.withColumn("norm", normal).groupBy("identity").agg(
        F.min(F.when(F.col("kind") == "row", F.col("early.ord"))).alias("first"),
        F.sum("n").alias("n_support"),
        F.sum("rows").alias("_rows"),
        F.min_by("lead", F.when(F.col("kind") == "row", F.col("early"))).alias("_lead"),
        counted("query").alias("n_queries"),
        counted("citation").alias("n_passages"),
        gathered(part, "value", "flag", "standard", "variant").alias("items"), *lists,
    )
    return _assembled(facts, template_id, columns, folded, listed)


def merge_facts(rows: DataFrame, template_id: str, columns: Sequence[str], *, listed: bool = True, queries: bool = True) -> DataFrame:
    """The facts of rows, as `facts_of` gives them; without `queries` they have no n_queries and query_ids."""
    facts = facts_of(fact_parts(rows, template_id, columns, queries=queries), template_id, columns, listed=listed)
    return facts if queries else facts.drop("n_queries", "query_ids")


def _of(kind: str, name: str | None = None) -> Column:
    return F.filter("items", lambda x: (x["kind"] == kind) & (F.lit(True) if name is None else x["name"] == name))


def _fold(column: str, position: int) -> Column:
    """Representative, variants and the first disagreement of one column."""
    arrival = lambda x, when: F.struct(x[when]["ord"].alias("ord"), x["text"].alias("text"), x["norm"].alias("norm"))
    arrivals = F.array_sort(
        F.array_distinct(F.flatten(F.transform(F.filter(_of("value", column), lambda x: x["text"] != ""), lambda x: F.array(arrival(x, "early"), arrival(x, "late")))))
    )

    def step(state: Column, x: Column) -> Column:
        differs = (state["text"] != "") & (x["norm"] != state["norm"])
        seen = F.when(
            differs, F.array_distinct(F.concat(state["variants"], F.array(state["text"]), F.array(x["text"])))
        ).otherwise(state["variants"])
        longer = F.length(F.trim(x["text"])) > F.length(F.trim(state["text"]))
        return F.struct(
            F.when(longer, x["text"]).otherwise(state["text"]).alias("text"),
            F.when(longer, x["norm"]).otherwise(state["norm"]).alias("norm"),
            seen.alias("variants"),
            F.coalesce(state["since"], F.when(differs, x["ord"])).alias("since"),
        )

    order = "struct<spec_ord:bigint,row_ord:int,split_ord:int>"
    start = F.struct(
        F.lit("").alias("text"), F.lit("").alias("norm"), F.array().cast("array<string>").alias("variants"), F.lit(None).cast(order).alias("since")
    )
    cast = lambda x: x.cast(f"struct<text:string,norm:string,variants:array<string>,since:{order}>")
    return F.aggregate(arrivals, cast(start), lambda s, x: cast(step(s, x)))


def _assembled(facts: DataFrame, template_id: str, columns: Sequence[str], folded: Sequence[str], listed: bool) -> DataFrame:
    facts = facts.withColumns({f"fold:{c}": _fold(c, i) for i, c in enumerate(columns) if c in folded})
    cell = lambda c: (F.col(f"`fold:{c}`")["text"] if c in folded else F.coalesce(F.col("_lead")[c], F.lit(""))).alias(c)
    old = lambda c: F.transform(_of("variant", c), lambda x: x["text"])
    variants = F.map_filter(
        F.map_from_arrays(
            F.array(*[F.lit(c) for c in folded]), F.array(*[F.array_distinct(F.concat(old(c), F.col(f"`fold:{c}`")["variants"])) for c in folded])
        ) if folded else F.create_map().cast("map<string,array<string>>"),
        lambda k, v: F.size(v) > 0,
    )
    # A disagreement's flag stands before the flags of the row that brought it.
    raised = F.array_compact(
        F.array(*[F.when(F.col(f"`fold:{c}`")["since"].isNotNull(), F.struct(F.col(f"`fold:{c}`")["since"].alias("ord"), F.lit(i - 1000).alias("at"), F.lit(f"merged_variants:{c}").alias("flag"))) for i, c in enumerate(folded)])
    ) if folded else None
    given = F.transform(_of("flag"), lambda x: F.struct(x["early"]["ord"].alias("ord"), x["early"]["at"].alias("at"), x["name"].alias("flag")))
    every = F.array_sort(given if raised is None else F.concat(given, raised.cast("array<struct<ord:struct<spec_ord:bigint,row_ord:int,split_ord:int>,at:int,flag:string>>")))
    flags = F.array_distinct(F.transform(every, lambda x: x["flag"]))
    flags = F.when((F.col("n_passages") > 0) & (F.col("_rows") > 1), F.array_remove(flags, "no_citation")).otherwise(flags)
    standard = distinct_by(F.transform(_of("standard"), lambda x: F.struct(x["name"].alias("key"), x["text"].alias("value"))), lambda e: e["key"])
    lists = []
    if listed:
        cited = F.col("_cited")

        def paper(key: Column) -> Column:
            own = F.filter(cited, lambda x: x["text"] == key)
            chunks = F.array_sort(distinct_by(F.flatten(F.transform(own, lambda x: x["payload"]["chunks"])), chunk_key))
            return F.get(own, F.lit(0))["payload"].withField("chunks", chunks)

        documents = F.array_distinct(F.transform(cited, lambda x: x["text"]))
        lists = [F.transform(documents, paper).alias("citations"), F.transform("_queries", lambda x: x["name"]).alias("query_ids")]
    return facts.select(
        "identity", "first", F.lit(template_id).alias("template_id"), F.struct(*[cell(c) for c in columns]).alias("values"), flags.alias("flags"), "n_support",
        F.map_from_entries(standard).alias("standard"), variants.alias("variants"), "n_queries", "n_passages", *lists,
    )


def merge_runs(parts: Sequence[tuple[DataFrame, str, Sequence[str]]]) -> DataFrame:
    """Facts of several templates; values become a map, for the columns differ."""
    out = None
    for rows, template_id, columns in parts:
        facts = merge_facts(rows, template_id, columns)
        pairs = [x for c in columns for x in (F.lit(c), F.col("values")[c])]
        facts = facts.withColumn("values", F.create_map(*pairs))
        out = facts if out is None else out.unionByName(facts, allowMissingColumns=True)
    return out


def display(column: str) -> Column:
    """What a flat export shows: standard notation, otherwise all alternatives."""
    primary = F.col("values")[column]
    others = F.coalesce(F.try_element_at("variants", F.lit(column)), F.array().cast("array<string>"))
    listed = F.array_join(F.filter(F.array_distinct(F.concat(F.array(primary), others)), lambda v: v != ""), "; ")
    return F.coalesce(F.try_element_at("standard", F.lit(column)), listed)
