"""A Merkle manifest of a dataset: leaf hashes, subroots by group, a root, and proofs.

A leaf is the SHA-256 of a row's fields. In each group the leaves, ascending by id, are
hashed in runs of ARITY until one node remains, the group's subroot; the subroots, ordered
by group, are hashed to the root in the same way.

Leaves get their places from a staged range sort: a place is the row's number inside its
partition plus what earlier partitions hold of its group, so a group of any size needs no
task of its own. The tree is then built by Pregel-style supersteps over RDDs. A vertex is a
block of up to ARITY ** DEPTH neighbouring nodes: children message their digest to the
block above, and a block that has all of them hashes its DEPTH levels and forwards the
digest. In the reverse supersteps a block gets the sibling path above it and sends each
child its own, down to the leaves. Messages are keyed by (group's number, place), blocks
are bounded, and all results are recomputed from the staged leaves if an executor is lost:
the lineage behind them has 2 shuffles for each DEPTH levels.

Edge cases: a null field hashes as "-"; null groups come first, then null ids first; rows
that share an id are ordered by leaf, so equal rows may take each other's place; a lone
leaf is its subroot, and a lone subroot the root, with no hash between; an empty table
gives no rows; columns that aren't named take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

from pyspark import RDD
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.session import ship_package, stage

ARITY, DEPTH = 3, 4
SPAN = ARITY**DEPTH
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<before:string,after:string>>"


def leaf_hash(fields: Sequence[Column]) -> Column:
    """Each field is "-" if null, else its UTF-8 bytes behind their count and a colon."""
    told = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in told]), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its sibling path lead to."""
    return F.aggregate(path, leaf, lambda digest, run: F.sha2(F.concat(run["before"], digest, run["after"]), 256))


def numbered(leaves: DataFrame) -> DataFrame:
    """Leaves (id, group, leaf, seen) with the number of their group and their place in it."""
    parts = int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(c).asc_nulls_first() for c in ("group", "id", "leaf", "seen")]
    dealt = leaves.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    dealt = stage(dealt.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), "merkle-leaves")
    held = stage(dealt.groupBy("part", "group").agg(F.count("*").alias("n"), F.min("at").alias("from")), "merkle-starts")
    earlier = lambda window: window.rowsBetween(Window.unboundedPreceding, -1)
    starts = held.withColumn("before", F.coalesce(F.sum("n").over(earlier(Window.partitionBy("group").orderBy("part"))), F.lit(0)))
    named = held.groupBy("group").agg(F.min("part").alias("part"))
    # One row for each partition; numbers of groups go on from partition to partition.
    first = named.groupBy("part").agg(F.count("*").alias("n"))
    first = first.select("part", F.coalesce(F.sum("n").over(earlier(Window.orderBy("part"))), F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(F.col("group").asc_nulls_first())) - 1
    named = named.withColumn("inside", inside).join(first, "part").select(F.col("group").alias("of"), (F.col("offset") + F.col("inside")).alias("g"))
    starts = starts.join(named, F.col("group").eqNullSafe(F.col("of"))).select(F.col("part").alias("in"), "of", "g", (F.col("before") - F.col("from")).alias("shift"))
    at = (F.col("part") == F.col("in")) & F.col("group").eqNullSafe(F.col("of"))
    return dealt.join(starts, at).select("g", (F.col("at") + F.col("shift")).alias("place"), "leaf", "id", "seen")


def _hash(run: Sequence[str]) -> str:
    return hashlib.sha256("".join(run).encode()).hexdigest()


def levels_of(place: int, digests: Sequence[str]) -> list[Sequence[str]]:
    """All levels of a block; the only block of its tree ends at one node."""
    levels, alone = [digests], place == 0 and len(digests) < SPAN
    for _ in range(DEPTH):
        if alone and len(levels[-1]) == 1:
            break
        levels.append([_hash(levels[-1][i : i + ARITY]) for i in range(0, len(levels[-1]), ARITY)])
    return levels


def path_inside(levels: list[Sequence[str]], at: int) -> tuple:
    """What stands before and after a node of the block in its run, level by level."""
    path = []
    for level in levels[:-1]:
        first = at - at % ARITY
        path.append(("".join(level[first:at]), "".join(level[at + 1 : first + ARITY])))
        at //= ARITY
    return tuple(path)


def _where(key: tuple[int, int]) -> int:
    return key[0] * 1_000_003 + key[1]


class _Tree:
    """The blocks of all trees, level by level, as keyed RDDs."""

    def __init__(self, nodes: RDD, most: int, parts: int):
        """nodes: ((tree, place), (digest, payload)); most: nodes of the largest tree."""
        self.levels = []
        while True:
            self.levels.append(self._blocks(nodes, max(1, parts)))
            most, parts = -(-most // SPAN), parts // SPAN
            if most <= 1:
                break
            nodes = self.top()

    @staticmethod
    def _blocks(nodes: RDD, parts: int) -> RDD:
        sent = nodes.map(lambda n: ((n[0][0], n[0][1] // SPAN), (n[0][1] % SPAN, *n[1])))
        return sent.groupByKey(parts, _where).mapValues(sorted_members)

    def top(self) -> RDD:
        """The digest of each block of the highest level, keyed by (tree, block)."""
        return self.levels[-1].map(lambda b: (b[0], (levels_of(b[0][1], [m[1] for m in b[1]])[-1][0], None)))

    def down(self, messages: RDD) -> RDD:
        """From (carried, path) of each tree to (carried, path) of each node, with its digest and payload."""
        for blocks in reversed(self.levels):
            parts = blocks.getNumPartitions()
            met = blocks.mapValues(lambda b: (b, None)).union(messages.mapValues(lambda m: (None, m)).partitionBy(parts, _where))
            reached = met.groupByKey(parts, _where).flatMap(_forward)
            messages = reached.map(lambda n: (n[0], n[1]))
        return reached


def sorted_members(members) -> list[tuple]:
    return sorted(members, key=lambda m: m[0])


def _forward(met: tuple) -> Iterator[tuple]:
    """A block and the message from above: what each of its nodes gets."""
    (tree, place), both = met
    members = carried = path = None
    for block, message in both:
        if block is not None:
            members = block
        else:
            carried, path = message
    levels = levels_of(place, [m[1] for m in members])
    for at, digest, payload in members:
        yield (tree, place * SPAN + at), (carried, path_inside(levels, at) + path), digest, payload


def prove(leaves: DataFrame) -> DataFrame:
    """id, leaf, seen, subroot, root and path of every leaf (id, group, leaf, seen).

    seen: the hash that is to be verified, with `fold(seen, path)`. path: for each level,
    the siblings before and after, concatenated.
    """
    spark = leaves.sparkSession
    ship_package(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = stage(numbered(leaves), "merkle-placed")
    kind = placed.schema["id"].dataType
    schema = T.StructType().add("id", kind).add("leaf", "string").add("seen", "string").add("subroot", "string").add("root", "string").add("path", T._parse_datatype_string(PATH))
    sizes = placed.agg(F.max("place").alias("place"), F.max("g").alias("g")).first()
    if sizes.place is None:
        return spark.createDataFrame([], schema)
    nodes = placed.rdd.map(lambda r: ((r[0], r[1]), (r[2], (r[3], r[4]))))
    groups = _Tree(nodes, sizes.place + 1, parts)
    # A group's subroot is a leaf of the last tree, at its group's number.
    whole = _Tree(groups.top().map(lambda n: ((0, n[0][0]), n[1])), sizes.g + 1, parts)
    told = whole.down(whole.top().map(lambda n: (n[0], (n[1][0], ()))))
    told = told.map(lambda n: ((n[0][1], 0), ((n[2], n[1][0]), n[1][1])))
    rows = groups.down(told).map(lambda n: (n[3][0], n[2], n[3][1], *n[1][0], list(n[1][1])))
    return spark.createDataFrame(rows, schema, verifySchema=False)


def document_leaves(docs: DataFrame, changed: Column, *, id_col: str = "doc_id", group_col: str = "source", fields: Sequence[str] = FIELDS, text_col: str = "text") -> DataFrame:
    """Leaves of documents; seen is the leaf with the text replaced by `changed`, where that isn't null."""
    leaf = leaf_hash([F.col(c) for c in fields])
    seen = leaf_hash([changed if c == text_col else F.col(c) for c in fields])
    return docs.select(F.col(id_col).alias("id"), F.col(group_col).alias("group"), leaf.alias("leaf"), F.when(changed.isNotNull(), seen).alias("seen")).withColumn("seen", F.coalesce("seen", "leaf"))


def digest_columns(proved: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, the digest of the proof, the root of what was seen, and whether they agree."""
    siblings = F.array_join(F.transform("path", lambda run: F.concat(run["before"], run["after"])), "")
    folded = proved.withColumn("folded_root", fold(F.col("seen"), F.col("path")))
    return folded.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )


#: Documents whose text is taken without line feeds by the query, to see that proofs fail.
TAMPERED_SQL = """
  list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
    lambda c, b: xor(crcs[CAST((xor(c, b) & 255) + 1 AS BIGINT)], (c >> 8))) % 2 = 1"""  # the last step inverts the lowest bit


def _field_sql(name: str) -> str:
    return f"CASE WHEN {name} IS NULL THEN '-' ELSE strlen(CAST({name} AS VARCHAR)) || ':' || {name} END"


SQL = f"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN (c & 1) = 1 THEN xor(CAST(3988292384 AS BIGINT), (c >> 1)) ELSE c >> 1 END)) AS crcs
), leaves AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(source, '') AS s, source IS NOT NULL AS known, h AS leaf, CASE WHEN doc_id IS NOT NULL AND text IS NOT NULL AND {TAMPERED_SQL} THEN sha256(head || {_field_sql("bare")}) ELSE h END AS seen
  FROM (SELECT *, sha256(head || {_field_sql("text")}) AS h, replace(text, chr(10), '') AS bare
    FROM (SELECT *, {" || ".join(_field_sql(c) for c in FIELDS[:-1])} AS head FROM documents, crc))
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY known, s ORDER BY doc_id NULLS FIRST, leaf, seen) - 1 AS place FROM leaves
), nodes(level, known, s, place, d, n) AS (
  SELECT 0, known, s, place, leaf, count(*) OVER (PARTITION BY known, s) FROM placed
  UNION ALL
  SELECT level + 1, known, s, place // 3, sha256(string_agg(d, '' ORDER BY place)), any_value((n + 2) // 3) FROM nodes WHERE n > 1 GROUP BY level, known, s, place // 3
), subroots AS (
  SELECT known, s, d, row_number() OVER (ORDER BY known, s) - 1 AS place, count(*) OVER () AS n FROM nodes WHERE n = 1
), above(level, place, d, n) AS (
  SELECT 1000, place, d, n FROM subroots
  UNION ALL
  SELECT level + 1, place // 3, sha256(string_agg(d, '' ORDER BY place)), any_value((n + 2) // 3) FROM above WHERE n > 1 GROUP BY level, place // 3
), runs AS (
  SELECT level, known, s, place // 3 AS run, list(d ORDER BY place) AS ds FROM nodes WHERE n > 1 GROUP BY ALL
  UNION ALL SELECT level, true, NULL, place // 3, list(d ORDER BY place) FROM above WHERE n > 1 GROUP BY ALL
), wanted AS (
  SELECT p.r, k.level, p.known, p.s, p.place // CAST(pow(3, k.level) AS BIGINT) AS spot FROM placed p JOIN (SELECT DISTINCT level, known, s FROM nodes WHERE n > 1) k ON k.known = p.known AND k.s = p.s
  UNION ALL SELECT p.r, k.level, true, NULL, b.place // CAST(pow(3, k.level - 1000) AS BIGINT) FROM placed p JOIN subroots b ON b.known = p.known AND b.s = p.s, (SELECT DISTINCT level FROM above WHERE n > 1) k
), steps AS (
  SELECT r, w.level, array_to_string(ds[1 : (spot % 3)], '') AS b, array_to_string(ds[(spot % 3 + 2) : 3], '') AS a FROM wanted w JOIN runs q ON w.level = q.level AND w.known = q.known AND w.s IS NOT DISTINCT FROM q.s AND w.spot // 3 = q.run
), paths AS (
  SELECT r, list(b || '|' || a ORDER BY level) AS path, string_agg(b || a, '' ORDER BY level) AS siblings FROM steps GROUP BY r
), folded AS (
  SELECT p.doc_id, p.leaf, b.d AS subroot, (SELECT d FROM above WHERE n = 1) AS root, sha256(coalesce(siblings, '')) AS proof_sha256,
    CASE WHEN path IS NULL THEN seen ELSE list_reduce(list_prepend(seen, path), lambda x, y: sha256(split_part(y, '|', 1) || x || split_part(y, '|', 2))) END AS folded_root
  FROM placed p JOIN subroots b ON b.known = p.known AND b.s = p.s LEFT JOIN paths USING (r)
)
SELECT *, folded_root = root AS verified FROM folded"""
