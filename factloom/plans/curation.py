"""The engine's operators as queries over the driver's tables, each with its SQL.

The tables hold no curation answers, so spellings are made from integer keys, and the SQL
computes the canonical answer from the same keys without the normalisers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions import normalize as N
from factloom.functions import text as X
from factloom.functions import vocab
from factloom.operators import citations as C
from factloom.operators import context, merge, retrieve, score
from factloom.session import spread, table
from factloom.sources import corpus, specs

TOP_K = 10
#: Amino acids in the order of the made mutations: letter, three letters, name.
LETTERS = "ARNDCQEGHILKMFPSTWYV"
THREE = "AlaArgAsnAspCysGlnGluGlyHisIleLeuLysMetPheProSerThrTrpTyrVal"
NAMES = tuple(next(n for n, c in vocab.AMINO_NAMES.items() if c == x) for x in LETTERS)
MUTATION = ("Organism", "Gene Name", "Mutation", "Phenotype", "Assertion", "Reference")


def _spelling() -> Column:
    """One of seven notations of the mutation that a line item's keys name."""
    ref, alt, at = (F.col("l_partkey") % 20).cast("int"), (F.col("l_suppkey") % 20).cast("int"), (1 + F.col("l_orderkey") % 400).cast("string")
    letter = lambda i: F.substring(F.lit(LETTERS), i + 1, F.lit(1))
    three = lambda i: F.substring(F.lit(THREE), 3 * i + 1, F.lit(3))
    name = lambda i: F.get(F.array(*[F.lit(n) for n in NAMES]), i)
    short, long = F.concat(letter(ref), at, letter(alt)), F.concat(three(ref), at, three(alt))
    styles = {
        1: short, 2: long, 3: F.concat(_gene(), F.lit("-"), short), 4: F.concat(F.lit("p."), long),
        5: F.concat(three(ref), at, F.lit("->"), three(alt)), 6: F.concat(long, F.lit(" ("), short, F.lit(")")),
        7: F.concat(name(ref), F.lit(" "), at, F.lit(" to "), name(alt)),
    }
    return F.coalesce(*[F.when((F.col("l_linenumber") - 1) % 7 + 1 == k, v) for k, v in styles.items()])


def _gene() -> Column:
    return F.concat(F.lit("gene"), (F.col("l_suppkey") % 50).cast("string"))


CANONICAL = (
    f"substr('{LETTERS}', CAST(l_partkey % 20 AS INT) + 1, 1) || CAST(1 + l_orderkey % 400 AS VARCHAR) || "
    f"substr('{LETTERS}', CAST(l_suppkey % 20 AS INT) + 1, 1)"
)


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the mutation template, one for each line item."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag")
    suppliers = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    joined = lines.join(suppliers.select("s_suppkey", "n_name"), F.col("l_suppkey") == F.col("s_suppkey"))
    cells = [F.col("n_name"), _gene(), _spelling(), F.col("l_returnflag"), F.lit("measured"), F.concat(F.lit("["), F.col("l_linenumber").cast("string"), F.lit("]"))]
    return joined.select(F.struct(*[c.alias(n) for c, n in zip(cells, MUTATION, strict=True)]).alias("values"))


def merge_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = merge.support(claims(spark, sf_dir), "mutation", MUTATION)
    part = lambda i, n: F.get("identity", F.lit(i)).alias(n)
    return merged.select(part(1, "organism"), part(2, "gene"), part(3, "mutation"), "n_support")


MERGE_SUPPORT = f"""
SELECT replace(replace(lower(n_name), '_', ' '), '-', ' ') AS organism, 'gene' || CAST(l_suppkey % 50 AS VARCHAR) AS gene,
  {CANONICAL} AS mutation, count(*) AS n_support
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2, 3"""


def norm_mutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    spelled = table(spark, sf_dir, "lineitem").groupBy(_spelling().alias("v"), _gene().alias("g")).agg(F.count("*").alias("n"))
    distinct = spread(spelled.groupBy("v", N.own_gene(F.col("v"), F.col("g")).alias("g")).agg(F.sum("n").alias("n")))
    return distinct.groupBy(N.normalize_mutation(F.col("v"), F.col("g")).alias("mutation")).agg(F.sum("n").alias("n"))


def _choice(key: Column, values: list[str]) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), (key % len(values)).cast("int"))


def _choice_sql(key: str, values: list[str]) -> str:
    said = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"([{said}])[CAST({key} % {len(values)} AS INT) + 1]"


#: A vocabulary's normaliser, spellings, and their canonical forms in the same order.
SPELLED = {
    "norm_null_tokens": (X.clean, ["N/A", " not  reported ", "x  y", "ND", "-"], ["", "", "x y", "", ""]),
    "norm_sir": (N.normalize_sir, ["Resistant", "S", "SDD", "non-susceptible", "borderline"], ["R", "S", "I", "R", "borderline"]),
    "norm_antibiotic": (N.normalize_antibiotic, ["Ciprofloxacin (CIP)", "Cefotaxime sodium disc", "RIFAMPICIN"], ["ciprofloxacin", "cefotaxime", "rifampicin"]),
    "norm_site": (N.normalize_site, ["Asn-234", "p.Asn234", "N235", "Thr678"], ["N234", "N234", "N235", "T678"]),
    "norm_linkage": (N.normalize_linkage, ["N-glycosylation", "O-glycan", "C-mannosylation", "other"], ["N-linked", "O-linked", "C-mannosylation", "other"]),
    "norm_interaction": (N.normalize_interaction, ["interacts with", "proteolysis", "upregulates", "phosphorylates"], ["binds", "cleaves", "activates", "phosphorylates"]),
    "norm_gene_key": (N.normalize_gene, ["katG gene", "*katG*", "KatG protein", "NA", "N/A"], ["katg", "katg", "katg", "na", ""]),
}


def _vocabulary(name: str):
    function, given, _ = SPELLED[name]
    return lambda spark, sf_dir: table(spark, sf_dir, "part").select("p_partkey", function(_choice(F.col("p_partkey"), given)).alias("canonical"))


def title_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages' titles, and digests of the whole pages, without tags and with white space collapsed."""
    title = F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1)
    return table(spark, sf_dir, "pages").select("page_id", X.clean_title(title).alias("title"), F.sha2(X.clean_title(F.col("html")), 256).alias("page_sha256"))


def _clean_sql(value: str) -> str:
    return f"trim(regexp_replace(regexp_replace(coalesce({value}, ''), '<[^>]+>', '', 'g'), '[\\t-\\r\\x1c-\\x1f\\x20\\x85\\p{{Z}}]+', ' ', 'g'))"


TITLE_CLEAN = f"""
SELECT page_id, {_clean_sql("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS title, sha256({_clean_sql("html")}) AS page_sha256 FROM pages"""


def chunk_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.chunk_documents(table(spark, sf_dir, "documents")).select("chunk_id", "collection", "content", "start_char", "end_char", "prev_chunk_id", "next_chunk_id")


CHUNK_SCAN = """
WITH cut AS (
  SELECT doc_id, source AS collection, text, CAST(ceil(length(text) / 1000.0) AS INT) AS n, unnest(generate_series(0, CAST(ceil(length(text) / 1000.0) AS INT) - 1)) AS k FROM documents
)
SELECT doc_id || ':' || k AS chunk_id, collection, substr(text, CAST(k * 1000 + 1 AS INT), 1000) AS content, CAST(k * 1000 AS INT) AS start_char,
  CAST(least(length(text), k * 1000 + 1000) AS INT) AS end_char, CASE WHEN k > 0 THEN doc_id || ':' || (k - 1) END AS prev_chunk_id,
  CASE WHEN k < n - 1 THEN doc_id || ':' || (k + 1) END AS next_chunk_id
FROM cut"""


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("search_text"))


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = retrieve.bm25_top(table(spark, sf_dir, "documents"), _asked(spark, sf_dir), TOP_K, id_col="doc_id", text_col="text")
    return best.select("query_id", "doc_id", "source_rank", F.round("score", 4).alias("score"))


_BM25 = f"""
wanted AS (
  SELECT DISTINCT query_id, term FROM (SELECT item_id AS query_id, unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+')) AS term FROM benchmark) WHERE term <> ''
), words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '') AS w FROM documents
), corpus AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM words),
counted AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM words) WHERE term IN (SELECT term FROM wanted) GROUP BY ALL),
freq AS (SELECT term, count(*) AS df FROM counted GROUP BY term),
lexical AS (
  SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * {retrieve.K1 + 1} / (tf + {retrieve.K1} * (1 - {retrieve.B} + {retrieve.B} * dl / avgdl))), 6) AS score
  FROM counted JOIN freq USING (term) JOIN wanted USING (term), corpus GROUP BY 1, 2
)"""
BM25_TOPK = f"""
WITH {_BM25}
SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS source_rank, round(score, 4) AS score
FROM lexical QUALIFY source_rank <= {TOP_K}"""


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    every = table(spark, sf_dir, "embeddings")
    return every, every.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.dense(*_vectors(spark, sf_dir), TOP_K).select("query_id", "vec_id", "source_rank", F.round("score", 4).alias("score"))


_DENSE = """
asked AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id % 50 = 0),
near AS (SELECT query_id, vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), q), 6) AS score FROM embeddings, asked),
semantic AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS source_rank FROM near)"""
DENSE_TOPK = f"WITH {_DENSE} SELECT query_id, vec_id, source_rank, round(score, 4) AS score FROM semantic WHERE source_rank <= {TOP_K}"


def rrf_fused_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense ranks fused with a second ranking: the query's own label first, then by id."""
    vectors, asked = _vectors(spark, sf_dir)
    near = retrieve.dense(vectors, asked, 50)
    # The first 50 of each label, before any query meets them: a label may have a third of all rows.
    first = vectors.select("vec_id", "label").withColumn("_at", F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))).filter("_at <= 50")
    labelled = asked.join(vectors.select(F.col("vec_id").alias("query_id"), "label"), "query_id").select("query_id", "label")
    same = retrieve.rank(labelled.join(first, "label").select("query_id", "vec_id", F.lit(0.0).alias("score")), 50, "vec_id")
    return retrieve.fuse([near, same], TOP_K, key="vec_id").select("query_id", "vec_id", "source_rank", F.round("score", 6).alias("score"))


RRF_FUSED_TOPK = f"""
WITH {_DENSE},
same AS (
  SELECT a.vec_id AS query_id, b.vec_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY b.vec_id) AS source_rank
  FROM embeddings a JOIN embeddings b ON a.label = b.label WHERE a.vec_id % 50 = 0 QUALIFY source_rank <= 50
), fused AS (
  SELECT query_id, vec_id, sum(1.0 / ({retrieve.RRF_K} + CAST(source_rank AS DOUBLE))) AS score
  FROM (SELECT query_id, vec_id, source_rank FROM semantic WHERE source_rank <= 50 UNION ALL SELECT * FROM same) GROUP BY 1, 2
)
SELECT query_id, vec_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS source_rank, round(score, 6) AS score
FROM fused QUALIFY source_rank <= {TOP_K}"""


def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id"), "turn", F.char_length(F.coalesce("text", F.lit(""))).alias("size"), F.row_number().over(order).alias("source_rank"))
    return context.within_budget(turns, "size", F.lit(2000)).select("query_id", "turn", "source_rank", "size")


CONTEXT_BUDGET = """
WITH ranked AS (SELECT conv_id AS query_id, turn, length(coalesce(text, '')) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS source_rank FROM conversations),
used AS (SELECT *, sum(size + 7) OVER (PARTITION BY query_id ORDER BY source_rank) - 7 AS u FROM ranked)
SELECT query_id, turn, CAST(source_rank AS INT) AS source_rank, CAST(size AS INT) AS size FROM used WHERE u <= 2000 OR source_rank = 1"""


def _collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as collections; every third name's state is known, and some of those are being built."""
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("collection"))
    known = (F.length("id") + F.ascii(F.substring("id", -1, 1))) % 3
    return corpus.collection_counts(docs).withColumn("state", F.when(known == 0, "active").when(known == 1, "building"))


def collection_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.searchable(_collections(spark, sf_dir)).select("id", "count")


def collection_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of the collections that can be searched."""
    return corpus.total(corpus.searchable(_collections(spark, sf_dir)))


def citation_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    low, line = F.col("l_linenumber").cast("string"), F.col("l_linenumber")
    text = F.concat(F.lit("["), low, F.lit("-"), (line + F.col("l_partkey") % 4).cast("string"), F.lit("]"))
    marked = table(spark, sf_dir, "lineitem").withColumn("_m", C.parse_markers(text, F.lit(100)))
    return marked.select("l_orderkey", "l_linenumber", F.explode("_m").alias("marker"))


CITATION_EXPAND = """
SELECT l_orderkey, l_linenumber, CAST(unnest(generate_series(l_linenumber, l_linenumber + l_partkey % 4)) AS INT) AS marker FROM lineitem"""


def resume_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' queries that no progress record completes."""
    done = table(spark, sf_dir, "events").select(F.col("user_id").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name").join(done, "c_custkey", "left_anti")


def progress_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last record of each query; a maximum, so a hot query is reduced before the shuffle."""
    last = F.max_by(F.struct("event_id", "event_type"), F.struct("ts", "event_id"))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(last.alias("r")).select("user_id", "r.event_id", "r.event_type")


def query_identity_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = [F.col("o_orderpriority"), F.col("o_orderstatus"), F.col("o_custkey")]
    return table(spark, sf_dir, "orders").select("o_orderkey", specs.query_hash(asked).alias("query_id"))


def score_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted: documents of over 1,000 characters; wanted: those of good quality."""
    found = table(spark, sf_dir, "documents").filter(F.col("n_chars") > 1000).select("doc_id")
    wanted = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return score.precision_recall(found, wanted, ["doc_id"])


SCORE_PRF = """
WITH p AS (SELECT DISTINCT doc_id FROM documents WHERE n_chars > 1000 AND doc_id IS NOT NULL), w AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL),
c AS (SELECT (SELECT count(*) FROM p JOIN w USING (doc_id)) AS tp, (SELECT count(*) FROM p) AS np, (SELECT count(*) FROM w) AS nw)
SELECT tp, np - tp AS fp, nw - tp AS fn, round(CASE WHEN np > 0 THEN tp / np ELSE 0 END, 4) AS precision, round(CASE WHEN nw > 0 THEN tp / nw ELSE 0 END, 4) AS recall,
  round(CASE WHEN np + nw > 0 THEN 2.0 * tp / (np + nw) ELSE 0 END, 4) AS f1 FROM c"""

_COLLECTIONS = "SELECT source AS id, count(*) AS count, (length(source) + ascii(right(source, 1))) % 3 AS k FROM documents GROUP BY source"

QUERIES = {f.__name__: f for f in (
    merge_support, norm_mutation, title_clean, chunk_scan, bm25_topk, dense_topk, rrf_fused_topk, context_budget, collection_filter, collection_total, citation_expand,
    resume_pending, progress_last_wins, query_identity_hash, score_prf,
)} | {name: _vocabulary(name) for name in SPELLED}

ORACLE = {
    "merge_support": MERGE_SUPPORT,
    "norm_mutation": f"SELECT {CANONICAL} AS mutation, count(*) AS n FROM lineitem GROUP BY 1",
    "title_clean": TITLE_CLEAN,
    "chunk_scan": CHUNK_SCAN,
    "bm25_topk": BM25_TOPK,
    "dense_topk": DENSE_TOPK,
    "rrf_fused_topk": RRF_FUSED_TOPK,
    "context_budget": CONTEXT_BUDGET,
    "collection_filter": f"SELECT id, count FROM ({_COLLECTIONS}) WHERE k IS NULL OR k <> 1",
    "collection_total": f"SELECT CAST(coalesce(sum(count), 0) AS BIGINT) AS chunks, count(*) AS collections FROM ({_COLLECTIONS}) WHERE k IS NULL OR k <> 1",
    "citation_expand": CITATION_EXPAND,
    "resume_pending": "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE user_id IS NOT NULL)",
    "progress_last_wins": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "query_identity_hash": "SELECT o_orderkey, substr(sha256(coalesce(o_orderpriority, '') || '|' || coalesce(o_orderstatus, '') || '|' || coalesce(CAST(o_custkey AS VARCHAR), '')), 1, 12) AS query_id FROM orders",
    "score_prf": SCORE_PRF,
} | {name: f"SELECT p_partkey, {_choice_sql('p_partkey', wanted)} AS canonical FROM part" for name, (_, _, wanted) in SPELLED.items()}
