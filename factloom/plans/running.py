"""Qualified keys, incremental merging, filtered and hybrid retrieval, evaluation, glossary and retries as queries, each with its SQL."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import normalize as N
from factloom.operators import batch, context, export, glossary, merge, retrieve, run, score
from factloom.plans import answering, curation
from factloom.schema import SOURCE
from factloom.session import remove_at_exit, spread, stage, staging_dir, table

COLUMNS = answering.MUTATION.columns
_s = answering._s


def norm_mutation_qualified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deletions, insertions, frameshifts and substitutions behind any gene's name, under another row's gene."""
    at, name = (1 + F.col("l_orderkey") % 500).cast("string"), F.concat(F.lit("Gn"), (F.col("l_suppkey") % 90).cast("string"))
    kind, sep = (F.col("l_partkey") % 4).cast("int"), F.get(F.array(*map(F.lit, ("-", "_", ": "))), (F.col("l_suppkey") % 3).cast("int"))
    change = F.concat(F.get(F.array(*map(F.lit, ("P", "D", "p.S", "Gly"))), kind), at, F.get(F.array(*map(F.lit, ("del", "ins", "fs", "Asp"))), kind))
    spelled = table(spark, sf_dir, "lineitem").groupBy(F.concat(name, sep, change).alias("v")).agg(F.count("*").alias("n"))
    return spread(spelled).groupBy(N.normalize_mutation(F.col("v"), F.lit("katX")).alias("mutation")).agg(F.sum("n").alias("n"))


NORM_MUTATION_QUALIFIED = """
SELECT (['p', 'd', 'ps', 'G'])[CAST(l_partkey % 4 AS INT) + 1] || (1 + l_orderkey % 500) || (['del', 'ins', 'fs', 'D'])[CAST(l_partkey % 4 AS INT) + 1] AS mutation, count(*) AS n
FROM lineitem GROUP BY 1"""


def merge_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of three batches of claims, merged from the batches' parts."""
    claims = answering._claims(spark, sf_dir)
    batches = [merge.fact_parts(claims.filter(F.col("split_ord") % 3 == k), "mutation", COLUMNS) for k in range(3)]
    facts = merge.facts_of(merge.combine(*batches), "mutation", COLUMNS, listed=False)
    variants = F.array_join(F.coalesce(F.try_element_at("variants", F.lit("Assertion")), F.array()), ",")
    return facts.select(F.col("identity")[2].alias("gene"), F.col("identity")[3].alias("mutation"), "n_support", "n_queries", F.col("values.Phenotype").alias("phenotype"), variants.alias("variants"), F.col("first.spec_ord").alias("first_order"))


MERGE_INCREMENTAL = f"""
WITH {answering._CLAIMS_SQL}, firsts AS (SELECT gene, mutation, a, min((l_orderkey, l_linenumber, l_partkey)) AS since FROM claims GROUP BY 1, 2, 3),
told AS (SELECT gene, mutation, CASE WHEN count(*) > 1 THEN string_agg(a, ',' ORDER BY since) ELSE '' END AS variants FROM firsts GROUP BY 1, 2)
SELECT gene, mutation, count(*) AS n_support, count(DISTINCT l_orderkey) AS n_queries, max(said) AS phenotype, any_value(variants) AS variants, min(l_orderkey) AS first_order FROM claims JOIN told USING (gene, mutation) GROUP BY 1, 2"""


def merge_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queries behind each fact as a keyed table."""
    parts = merge.fact_parts(answering._claims(spark, sf_dir), "mutation", COLUMNS)
    return merge.members(parts, "query").select(F.col("identity")[2].alias("gene"), F.col("identity")[3].alias("mutation"), "query_id", F.col("first.row_ord").alias("first_row"))


MERGE_MEMBERS = f"""
WITH {answering._CLAIMS_SQL} SELECT gene, mutation, CAST(l_orderkey AS VARCHAR) AS query_id, CAST(min(l_linenumber) AS INT) AS first_row FROM claims GROUP BY gene, mutation, l_orderkey"""


def merge_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of a mutation and a pair template in one run."""
    lines = table(spark, sf_dir, "lineitem")
    pair = (F.lit("virus"), F.concat(F.lit("p"), (F.col("l_partkey") % 12).cast("string")), F.concat(F.lit("p"), (F.col("l_suppkey") % 12).cast("string")), F.lit("binds"), F.lit("[1]"))
    pairs = lines.select(F.col("l_orderkey").alias("spec_ord"), F.struct(*[v.alias(c) for v, c in zip(pair, answering.PAIRS.columns, strict=True)]).alias("values"))
    facts = merge.merge_runs([(answering._claims(spark, sf_dir), "mutation", COLUMNS), (pairs, answering.PAIRS.id, answering.PAIRS.columns)])
    named = F.when(F.col("template_id") == "mutation", F.slice("identity", 3, 2)).otherwise(F.slice("identity", -2, 2))
    return facts.select("template_id", named[0].alias("a"), named[1].alias("b"), "n_support")


MERGE_TEMPLATES = f"""
WITH {answering._CLAIMS_SQL}, pairs AS (SELECT 'p' || (l_partkey % 12) AS x, 'p' || (l_suppkey % 12) AS y FROM lineitem)
SELECT 'mutation' AS template_id, gene AS a, mutation AS b, count(*) AS n_support FROM claims GROUP BY ALL
UNION ALL SELECT 'ppi-extraction', least(x, y), greatest(x, y), count(*) FROM pairs GROUP BY ALL"""


FILTERS = {"collection": ["en", "de", "fr"], "n_chars": {"gte": 300, "lt": 20_000}}


def retrieve_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 in some collections and lengths of a corpus that is laid out for it; the statistics are the whole corpus's."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars", F.coalesce("lang", F.lit("")).alias("collection"))
    path = f"{staging_dir(spark)}/passages-{uuid.uuid4().hex}"
    remove_at_exit(spark, path)
    laid = retrieve.lay_out(docs, path, order=("n_chars", "doc_id"))
    known = retrieve.statistics(laid, text_col="text")
    best = retrieve.bm25_top(laid.filter(retrieve.wanted(FILTERS)), curation._asked(spark, sf_dir), curation.TOP_K, id_col="doc_id", text_col="text", known=known)
    return best.select("query_id", "doc_id", "source_rank", F.round("score", 4).alias("score"))


RETRIEVE_FILTERED = f"""
WITH {curation._BM25}
SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS source_rank, round(score, 4) AS score
FROM lexical WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang IN ('en', 'de', 'fr') AND n_chars >= 300 AND n_chars < 20000) QUALIFY source_rank <= {curation.TOP_K}"""


def fused_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid and BM25 rankings of the same passages, fused: documents that have an embedding, asked by every fiftieth of them."""
    vectors = table(spark, sf_dir, "embeddings").join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "text"), "vec_id")
    vectors = stage(vectors.select("vec_id", "embedding", F.coalesce("text", F.lit("")).alias("text")), "fused-passages")
    asked = vectors.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding", F.substring("text", 1, 80).alias("search_text"))
    near = retrieve.dense(vectors, asked.select("query_id", "embedding"), 50)
    lexical = retrieve.bm25_top(vectors, asked, 50, id_col="vec_id", text_col="text")
    lexical = stage(lexical.select("query_id", "vec_id", "score", "source_rank"), "fused-lexical")
    both = retrieve.hybrid(lexical, near, 50, "vec_id")
    return retrieve.fuse([both, lexical], curation.TOP_K, key="vec_id").select("query_id", "vec_id", "source_rank", F.round("score", 6).alias("score"))


FUSED_MODES = f"""
WITH passages AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, coalesce(text, '') AS text FROM embeddings JOIN documents ON doc_id = vec_id),
asked AS (SELECT vec_id AS query_id, v AS q, substr(text, 1, 80) AS s FROM passages WHERE vec_id % 50 = 0),
near AS (SELECT query_id, vec_id, round(list_cosine_similarity(v, q), 6) AS score FROM passages, asked),
semantic AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS source_rank FROM near QUALIFY source_rank <= 50),
wanted AS (SELECT DISTINCT query_id, term FROM (SELECT query_id, unnest(regexp_split_to_array(lower(s), '[^\\p{{L}}\\p{{N}}]+')) AS term FROM asked) WHERE term <> ''),
words AS (SELECT vec_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '') AS w FROM passages),
corpus AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM words),
counted AS (SELECT vec_id, dl, term, count(*) AS tf FROM (SELECT vec_id, len(w) AS dl, unnest(w) AS term FROM words) WHERE term IN (SELECT term FROM wanted) GROUP BY ALL),
freq AS (SELECT term, count(*) AS df FROM counted GROUP BY term),
scored AS (
  SELECT query_id, vec_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * {retrieve.K1 + 1} / (tf + {retrieve.K1} * (1 - {retrieve.B} + {retrieve.B} * dl / avgdl))), 6) AS score
  FROM counted JOIN freq USING (term) JOIN wanted USING (term), corpus GROUP BY 1, 2
), lexical AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS source_rank FROM scored QUALIFY source_rank <= 50),
hybrid AS (
  SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS source_rank FROM (
    SELECT query_id, vec_id, sum(1.0 / ({retrieve.RRF_K} + CAST(source_rank AS DOUBLE))) AS s FROM (SELECT * FROM semantic UNION ALL SELECT * FROM lexical) GROUP BY 1, 2) QUALIFY source_rank <= 50
), fused AS (SELECT query_id, vec_id, sum(1.0 / ({retrieve.RRF_K} + CAST(source_rank AS DOUBLE))) AS score FROM (SELECT * FROM hybrid UNION ALL SELECT * FROM lexical) GROUP BY 1, 2)
SELECT query_id, vec_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS source_rank, round(score, 6) AS score FROM fused QUALIFY source_rank <= {curation.TOP_K}"""


def _pick(key: str, *values: str) -> Column:
    return F.get(F.array(*map(F.lit, values)), (F.col(key) % len(values)).cast("int"))


def evaluation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as a catalog of alleles and as predicted rows, judged over the genes of even suppliers."""
    lines = table(spark, sf_dir, "lineitem")
    gene, at = F.concat(F.lit("gene"), (F.col("l_suppkey") % 60).cast("string")), (1 + F.col("l_partkey") % 350).cast("string")
    taxa = _pick("l_orderkey", "Escherichia", "Klebsiella_pneumoniae", "Salmonella enterica")
    catalog = lines.select(
        _pick("l_linenumber", "POINT", "POINT ", "POINT_DISRUPT", "POINT", "AMR-SUSCEPTIBLE").alias("subtype"), F.concat(gene, F.lit("_S"), at, _pick("l_partkey", "T", "N", "del")).alias("allele"),
        F.when(F.col("l_partkey") % 11 > 0, gene).otherwise(" ").alias("gene_family"), taxa.alias("whitelisted_taxa"),
    )
    found = lines.filter("l_returnflag <> 'N'").select(
        taxa.alias("Organism"), F.when(F.col("l_partkey") % 13 > 0, F.concat(F.lit(" "), F.upper(gene))).alias("Gene Name"),
        F.when(F.col("l_orderkey") % 4 == 0, "loss").otherwise(F.concat(F.lit("Ser"), at, _pick("l_partkey", "Thr", "Asn"))).alias("Mutation"),
        F.when(F.col("l_orderkey") % 8 == 0, F.concat(F.lit("S"), at, F.lit("T"))).otherwise("").alias("_standard_notation"),
    )
    asked = lines.filter("l_suppkey % 2 = 0").select(F.concat(F.lit(" Gene"), (F.col("l_suppkey") % 60).cast("string")).alias("genes"))
    return score.report(found, catalog, asked)


def _rates_sql(prefix: str, keys: str) -> str:
    return f"""{prefix} AS (SELECT tp, fp, fn, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS r FROM (
  SELECT count(*) FILTER (WHERE f AND w) AS tp, count(*) FILTER (WHERE f AND NOT w) AS fp, count(*) FILTER (WHERE w AND NOT f) AS fn FROM {keys}))"""


def _told_sql(prefix: str, source: str) -> str:
    return ", ".join([f"{source}.{x} AS {prefix}_{x}" for x in ("tp", "fp", "fn")] + [f"round({source}.p, 4) AS {prefix}_precision, round({source}.r, 4) AS {prefix}_recall, round(CASE WHEN {source}.p + {source}.r > 0 THEN 2 * {source}.p * {source}.r / ({source}.p + {source}.r) ELSE 0 END, 4) AS {prefix}_f1"])


EVALUATION_REPORT = f"""
WITH base AS (SELECT *, 'gene' || (l_suppkey % 60) AS gene, 1 + l_partkey % 350 AS spot, (['escherichia', 'klebsiella', 'salmonella'])[CAST(l_orderkey % 3 AS INT) + 1] AS o FROM lineitem),
c AS (SELECT o, gene, l_partkey % 3 AS k, 'S' || spot || (['T', 'N', ''])[CAST(l_partkey % 3 AS INT) + 1] AS m FROM base WHERE l_linenumber % 5 IN (0, 1, 3) AND l_partkey % 11 > 0),
f AS (SELECT o, gene, CASE WHEN l_partkey % 13 = 0 THEN NULL WHEN l_orderkey % 4 > 0 THEN 'S' || spot || (['T', 'N'])[CAST(l_partkey % 2 AS INT) + 1] WHEN l_orderkey % 8 = 0 THEN 'S' || spot || 'T' END AS m FROM base WHERE l_returnflag <> 'N'),
asked AS (SELECT DISTINCT gene FROM base WHERE l_suppkey % 2 = 0),
marks AS (SELECT o, gene, m, false AS f, true AS c, gene IN (SELECT gene FROM asked) AS w FROM c WHERE k < 2 UNION ALL SELECT o, gene, m, true, false, false FROM f WHERE m IS NOT NULL),
ok AS (SELECT o, gene, m, bool_or(f) AS f, bool_or(c) AS c, bool_or(w) AS w FROM marks GROUP BY ALL),
gk AS (SELECT gene, m, bool_or(f) AS f, bool_or(c) AS c, bool_or(w) AS w FROM ok GROUP BY ALL),
{_rates_sql("g", "gk")}, {_rates_sql("s", "ok")}
SELECT (SELECT count(*) FROM f) AS result_rows, (SELECT count(*) FROM f WHERE m IS NULL) AS unscorable_rows, (SELECT count(*) FROM c) AS catalog_rows, (SELECT count(*) FROM c WHERE k = 2) AS catalog_skipped,
  (SELECT count(*) FROM gk WHERE f) AS scorable_predictions, (SELECT count(DISTINCT gene) FROM gk WHERE f) AS genes_in_predictions, (SELECT count(*) FROM gk WHERE c) AS catalog_mutations, (SELECT count(*) FROM gk WHERE w) AS catalog_in_asked_genes,
  {_told_sql("gene", "g")}, {_told_sql("organism", "s")} FROM g, s"""


def glossary_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions of line items' flags, qualified or not; parts' types are terms of the reader's own."""
    own = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("term")).agg(F.max("p_size").cast("string").alias("text")).withColumn("kind", F.lit("flag"))
    ships = F.concat_ws(":", F.col("l_returnflag"), F.col("l_linestatus"))
    flags = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type"), "l_partkey", "left")
    flag = F.when(F.col("l_linenumber") % 3 == 0, F.concat_ws(":", F.upper("p_type"), "l_linestatus")).when(F.col("l_linenumber") % 3 == 1, F.col("p_type")).otherwise(ships)
    counted = flags.groupBy(flag.alias("flag")).agg(F.count("*").alias("n"))
    return glossary.describe_flags(counted, glossary.entries(spark, own)).select("flag", "n", "text")


def prose_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prose answers with their cited sources as JSON records, read back."""
    asked = table(spark, sf_dir, "orders").select(_s("o_orderkey").alias("query_id"), F.col("o_orderpriority").alias("organism"), F.concat(F.lit("Seen in [1] and [2-"), (2 + F.col("o_custkey") % 3).cast("string"), F.lit("].")).alias("answer"))
    cited = answering.E.extract_text(answering.C.with_sources(asked, answering._sources(spark, sf_dir)))
    read = export.prose_records(cited).select(F.from_json("value", "query_id string, answer string, citations array<struct<pmid:string,chunks:array<struct<marker:int>>>>").alias("r"))
    markers = F.array_sort(F.flatten(F.transform("r.citations", lambda c: F.transform(c["chunks"], lambda k: k["marker"]))))
    return read.select("r.query_id", "r.answer", F.array_join(F.transform("r.citations", lambda c: c["pmid"]), ";").alias("pmids"), F.array_join(markers.cast("array<string>"), ";").alias("markers"))


PROSE_RECORDS = """
WITH asked AS (SELECT o_orderkey AS k, 2 + o_custkey % 3 AS n FROM orders)
SELECT CAST(k AS VARCHAR) AS query_id, 'Seen in [1] and [2-' || n || '].' AS answer, (10 * k + 1) || ';' || (10 * k + 2) || CASE WHEN n = 4 THEN ';' || (10 * k + 4) ELSE '' END AS pmids, array_to_string(generate_series(1, n), ';') AS markers FROM asked"""


def request_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of the orders' queries: what is empty is left out, one collection is sent alone."""
    key = F.col("o_custkey") % 4
    names = F.when(key == 0, F.array().cast("array<string>")).when(key == 1, F.array(F.lit("a"), F.lit(""), F.lit("a"))).otherwise(F.array(F.lit("b"), F.lit("a"), F.lit("b")))
    slots = F.when(key < 2, F.create_map().cast("map<string,string>")).otherwise(F.create_map(F.lit("organism"), F.col("o_orderpriority")))
    filters = F.when(key == 3, F.struct(F.struct(F.lit(2000).alias("gte")).alias("year")))
    body = context.request_body(F.col("o_orderpriority"), key + 1, F.lit("hybrid"), template=F.when(key > 1, "mutation").otherwise(" "), slots=slots, collections=names, filters=filters)
    return table(spark, sf_dir, "orders").select("o_orderkey", body.alias("body"))


REQUEST_BODIES = """
SELECT o_orderkey, '{"query":"' || o_orderpriority || '","top_k":' || (o_custkey % 4 + 1) || ',"use_graph":false,"retrieval_mode":"hybrid"' ||
  CASE WHEN o_custkey % 4 > 1 THEN ',"template":"mutation","template_vars":{"organism":"' || o_orderpriority || '"}' ELSE '' END ||
  CASE o_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN ',"collection":"a"' ELSE ',"collections":["b","a"]' END || CASE WHEN o_custkey % 4 = 3 THEN ',"filters":{"year":{"gte":2000}}' ELSE '' END || '}' AS body FROM orders"""


def curation_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole run: benchmark items as specs, documents as passages, and a generator that reports each source it is shown."""
    def complete(prompt: str, most: int) -> dict:
        shown = re.findall(r"^Source (\d+) \(T(\d+)\) \[PMID: \2\]:$", prompt, re.M)
        lines = ["\t".join(("Org", f"gene{int(d) % 20}", f"Ser{int(d) % 50 + 1}Thr", "resistance", "measured", f"[{k}]")) for k, d in shown]
        return {"text": "\n".join(["\t".join(answering.MUTATION.columns), *lines]), "model": "reader", "finish_reason": "stop"}

    meta = spark.createDataFrame([], SOURCE).schema["metadata"].dataType
    named = {"title": F.concat(F.lit("T"), _s("doc_id")), "pmid": _s("doc_id")}
    metadata = F.struct(*[named.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in meta.fields])
    docs = table(spark, sf_dir, "documents")
    passages = docs.select(_s("doc_id").alias("doc_id"), _s("doc_id").alias("chunk_id"), F.coalesce("text", F.lit("")).alias("content"), F.col("source").alias("collection"), metadata.alias("metadata"))
    asked = table(spark, sf_dir, "benchmark").select(
        _s("item_id").alias("query_id"), F.col("item_id").cast("bigint").alias("spec_ord"), F.col("text").alias("organism"), F.lit("").alias("genes"), F.lit("").alias("other_terms"), F.lit(10).alias("top_k"), F.lit("all").alias("collection")
    )
    facts = run.Curation(answering.MUTATION, complete, window=16_000).facts(asked, passages, listed=False)
    return facts.select(F.col("identity")[2].alias("gene"), F.col("identity")[3].alias("mutation"), "n_support", "n_queries", "n_passages", F.col("first.spec_ord").alias("first_spec"))


CURATION_RUN = f"""
WITH {curation._BM25.replace("lower(text)", "lower(coalesce(trim(text) || ' ', '') || 'resistance mutations')", 1)},
ranked AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, CAST(doc_id AS VARCHAR)) AS k FROM lexical QUALIFY k <= 10),
sized AS (SELECT query_id, k, doc_id, length('Source ' || k || ' (T' || doc_id || ') [PMID: ' || doc_id || ']:' || chr(10) || coalesce(text, '')) AS size FROM ranked JOIN documents USING (doc_id)),
used AS (SELECT *, sum(size + 7) OVER (PARTITION BY query_id ORDER BY k) - 7 AS u FROM sized)
SELECT 'gene' || (doc_id % 20) AS gene, 'S' || (doc_id % 50 + 1) || 'T' AS mutation, count(*) AS n_support, count(DISTINCT query_id) AS n_queries, count(*) AS n_passages, CAST(min(query_id) AS BIGINT) AS first_spec
FROM used WHERE u <= 29666 OR k = 1 GROUP BY 1, 2"""


def generate_retried(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a service that is busy for some prompts and refuses others; how often each was asked."""
    def complete(prompt: str, most: int) -> dict:
        key = int(prompt.rsplit(" ", 1)[1])
        tried[key] = tried.get(key, 0) + 1
        if key % 5 == 0:
            raise batch.CallFailed("refused", 400)
        if tried[key] <= key % 6:
            raise batch.CallFailed("busy", 503 if key % 2 else None)
        return {"text": prompt.upper(), "model": "echo", "finish_reason": "stop"}

    tried: dict[int, int] = {}
    asked = table(spark, sf_dir, "customer").select(_s("c_custkey").alias("query_id"), F.concat(F.col("c_mktsegment"), F.lit(" "), _s("c_custkey")).alias("prompt"))
    return batch.generate(spread(asked, "query_id"), complete, at_once=16, pause=0.0).select("query_id", "answer", "error", "attempts")


GENERATE_RETRIED = """
WITH asked AS (SELECT c_custkey AS k, c_mktsegment || ' ' || c_custkey AS p, CASE WHEN c_custkey % 5 = 0 THEN 9 ELSE c_custkey % 6 END AS fails FROM customer)
SELECT CAST(k AS VARCHAR) AS query_id, CASE WHEN fails < 4 THEN upper(p) END AS answer, CASE WHEN fails = 9 THEN 'CallFailed: refused' WHEN fails >= 4 THEN 'CallFailed: busy' END AS error,
  CAST(CASE WHEN fails = 9 THEN 1 WHEN fails >= 4 THEN 4 ELSE fails + 1 END AS INT) AS attempts FROM asked"""

_QUERIES = (
    (norm_mutation_qualified, NORM_MUTATION_QUALIFIED), (merge_incremental, MERGE_INCREMENTAL), (merge_members, MERGE_MEMBERS), (merge_templates, MERGE_TEMPLATES),
    (retrieve_filtered, RETRIEVE_FILTERED), (fused_modes, FUSED_MODES), (evaluation_report, EVALUATION_REPORT),
    (glossary_flags, """
WITH own AS (SELECT p_type AS term, CAST(max(p_size) AS VARCHAR) AS text FROM part GROUP BY 1),
flags AS (SELECT CASE WHEN l_linenumber % 3 = 0 THEN concat_ws(':', upper(p_type), l_linestatus) WHEN l_linenumber % 3 = 1 THEN p_type ELSE concat_ws(':', l_returnflag, l_linestatus) END AS flag FROM lineitem LEFT JOIN part ON p_partkey = l_partkey)
SELECT flag, count(*) AS n, coalesce(any_value(text), '') AS text FROM flags LEFT JOIN own ON lower(term) = lower(split_part(flag, ':', 1)) GROUP BY 1"""),
    (prose_records, PROSE_RECORDS), (curation_run, CURATION_RUN), (request_bodies, REQUEST_BODIES), (generate_retried, GENERATE_RETRIED),
)
QUERIES = {f.__name__: f for f, _ in _QUERIES}
ORACLE = {f.__name__: sql for f, sql in _QUERIES}
