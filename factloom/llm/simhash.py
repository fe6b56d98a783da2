"""SimHash near-duplicates with BK-trees.

A fingerprint's bit is 1 if it is set in over half of the XXH64 hashes of the word
shingles, repeats included. Distinct fingerprints are dealt to shards; a shard's
fingerprints form a BK-tree, whose children are keyed by their integer Hamming distance
to the parent, and searches follow only edges within the radius. A shard has at most
about BLOCK fingerprints: a shard key with more is cut into blocks, and every block's
fingerprints are queried against every block's tree. Trees travel to the queries by a join
on the shard key, which Spark broadcasts when the trees are below its size threshold and
otherwise does by shuffle. Inside a shard links are reduced to a spanning forest, so a
group of m similar texts gives m - 1 edges and not m squared; components do the rest.

Two kinds of shard keys:

- exact (`link_exact`): radius 3 and 4 bands of 16 bits. Two fingerprints that differ in
  3 bits agree in one band. Keys of over BLOCK fingerprints are refined by 4 bands of the
  other 48 bits, by the same argument. No link is lost.
- by similarity (`similar_pairs`): 256-bit fingerprints of five-word shingles, whose
  distance is concentrated around its mean for a similarity, in tables keyed by sampled
  bits. Fingerprints are those of the distinct shingles, and equal sets are linked first.
  Proposed pairs are verified by the exact Jaccard similarity and give groups. Prefixes of
  the shingle sets then find every pair of different groups that can be similar enough,
  and these are verified too: no link is lost, and fingerprints only save work.

Edge cases: null texts are empty; a text with no words has fingerprint 0 and is linked
like any other; fewer words than a shingle form one shingle; texts of any length are
hashed whole; equal and repeated rows share a fingerprint and are members of their
component; null ids are ignored as representatives; empty tables give no rows.
"""

from __future__ import annotations

import math
import random
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.graph import components
from factloom.session import release, ship_package, stage

SEED = 42
RADIUS = 3
BLOCK = 1024
#: For near-duplicates by similarity.
WORDS = 5
SIMILARITY = 0.8
LANES = 4
#: Fingerprints whose keys one task makes.
DEALT = 1 << 14
#: Fingerprint tables. What they miss is found by prefixes, so they only save work.
TABLES = 8
#: For the order of prefixes: shingles counted at once, texts that make a shingle shared, most shared shingles sent to the tasks.
RUN = 1 << 20
SHARED = 3
MOST = 1 << 20
#: Texts known to have a shingle, from which it is searched by blocks; and its most rows in a list that is searched whole.
LONG = 64
LONGEST = 256
#: Bits of the parity sketch by which block searches rule pairs out.
SKETCH = 512
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_MASK = (1 << 64) - 1


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of every shingle, repeats included."""
    found = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not found:
        return np.empty(0, np.uint64)
    joined, digest = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) <= words:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    pairs = zip(starts[: len(found) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)
    return np.array([digest(joined[a:b], SEED) for a, b in pairs], np.uint64)


def _majority(hashes: np.ndarray) -> int:
    """Bits that over half of the hashes have set."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 255 * 64):
        bits = np.unpackbits(hashes[at : at + 255 * 64].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        for k in range(0, len(bits), 255):
            ones += np.add.reduce(bits[k : k + 255], axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def _mixed(hashes: np.ndarray, lane: int) -> np.ndarray:
    """Another hash of each hash; lane 0 is the hash itself."""
    if not lane:
        return hashes
    x = hashes + np.uint64(lane * 0x9E3779B97F4A7C15 & _MASK)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def majorities(hashes: np.ndarray, lanes: int) -> list[int]:
    """Lanes of the fingerprint of some hashes."""
    return [_majority(_mixed(hashes, k)) if len(hashes) else 0 for k in range(lanes)]


def fingerprint(text: str | None, words: int = 3, lanes: int = 1) -> list[int]:
    """The 64-bit lanes of a text's fingerprint."""
    return majorities(shingle_hashes(text, words), lanes)


def set_fingerprint(text: str | None, words: int = WORDS, lanes: int = LANES) -> list[int]:
    """The same of the distinct shingles."""
    return majorities(np.unique(shingle_hashes(text, words)), lanes)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def with_fingerprint(df: DataFrame, text_col: str = "text", *, words: int = 3, lanes: int = 1, column: str = "fp") -> DataFrame:
    """Adds the lanes as an array of bigint."""
    ship_package(df.sparkSession)

    @F.pandas_udf("array<bigint>")
    def prints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[_signed(x) for x in fingerprint(t, words, lanes)] for t in texts])

    return df.withColumn(column, prints(F.col(text_col)))


class BKTree:
    """Distinct integers; a node's children are keyed by their distance to it."""

    def __init__(self, values: list[int] = ()):
        self.root: list | None = None  # [value, {distance: node}]
        for value in values:
            self.add(value)

    def add(self, value: int) -> None:
        if self.root is None:
            self.root = [value, {}]
            return
        node = self.root
        while True:
            distance = (node[0] ^ value).bit_count()
            if not distance:
                return
            child = node[1].get(distance)
            if child is None:
                node[1][distance] = [value, {}]
                return
            node = child

    def within(self, value: int, radius: int) -> list[tuple[int, int]]:
        """(distance, member) of the members at most `radius` away."""
        found, left = [], [self.root] if self.root else []
        while left:
            member, children = left.pop()
            distance = (member ^ value).bit_count()
            if distance <= radius:
                found.append((distance, member))
            if children:
                low, high = distance - radius, distance + radius
                left += [child for edge, child in children.items() if low <= edge <= high]
        return found


def forest(tree: list[int], queries: list[int], radius: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links between a block's tree and its queries."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = parent[x]
        return x

    index, edges = BKTree(tree), []
    for value in queries:
        for distance, member in index.within(value, radius):
            if distance and (a := root(member)) != (b := root(value)):
                parent[b] = a
                edges.append((value, member))
    return edges


def _linked(blocks: DataFrame, radius: int) -> DataFrame:
    """Edges a, b from rows of (keys..., _block, members): every block against every block."""
    ship_package(blocks.sparkSession)

    @F.pandas_udf("array<struct<a:bigint,b:bigint>>")
    def search(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for trees, queries in batches:
            rows = []
            for tree, asked in zip(trees, queries, strict=True):
                own = [x & _MASK for x in tree.tolist()]
                other = own if asked is None else [x & _MASK for x in asked.tolist()]
                rows.append([{"a": _signed(a), "b": _signed(b)} for a, b in forest(own, other, radius)])
            yield pd.Series(rows)

    keys = [c for c in blocks.columns if c not in ("_block", "_blocks", "members")]
    none = F.lit(None).cast("array<bigint>")
    same = blocks.filter(F.size("members") > 1).select("members", none.alias("asked"))
    several = blocks.filter("_blocks > 1")
    asked = several.select(*keys, F.col("_block").alias("_asking"), F.col("members").alias("asked"))
    cross = several.join(asked, keys).filter("_asking > _block").select("members", "asked")
    pairs = same.unionByName(cross)
    return pairs.select(F.inline(search("members", "asked")))


def _blocks(keyed: DataFrame, keys: list[str], counts: DataFrame, block: int) -> DataFrame:
    """Members of each key with company, in blocks of about `block`."""
    return (
        keyed.join(counts.filter("_n > 1"), keys)
        .withColumn("_blocks", F.ceil(F.col("_n") / block).cast("int"))
        .withColumn("_block", F.pmod(F.xxhash64("fp"), F.col("_blocks")).cast("int"))
        .groupBy(*keys, "_blocks", "_block")
        .agg(F.collect_list("fp").alias("members"))
    )


def _bits(fp: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, shift).bitwiseAND((1 << width) - 1)


def band_keys(distinct: DataFrame) -> DataFrame:
    """fp, band, value for 4 bands of 16 bits."""
    bands = F.array(*[F.struct(F.lit(k).alias("band"), _bits(F.col("fp"), 16 * k, 16).alias("value")) for k in range(4)])
    return distinct.select("fp", F.inline(bands))


def refined_keys(keyed: DataFrame) -> DataFrame:
    """Adds sub and subvalue: 4 bands of 12 bits of the 48 bits outside the band."""
    fp, band = F.col("fp"), F.col("band")
    low = F.expr("fp & (shiftleft(1L, 16 * band) - 1)")
    high = F.when(band < 3, F.expr("shiftleft(shiftrightunsigned(fp, 16 * band + 16), 16 * band)")).otherwise(F.lit(0).cast("bigint"))
    rest = low.bitwiseOR(high)
    subs = F.array(*[F.struct(F.lit(k).alias("sub"), _bits(rest, 12 * k, 12).alias("subvalue")) for k in range(4)])
    return keyed.select(fp, "band", "value", F.inline(subs))


def link_exact(distinct: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """Edges a, b between fingerprints (column fp) at most 3 bits apart, as forests."""
    keyed = band_keys(distinct)
    counts = stage(keyed.groupBy("band", "value").agg(F.count("*").alias("_n")).filter("_n > 1"), "simhash-bands")
    cool = _blocks(keyed, ["band", "value"], counts.filter(F.col("_n") <= block), block)
    hot = refined_keys(keyed.join(counts.filter(F.col("_n") > block), ["band", "value"]))
    finer = ["band", "value", "sub", "subvalue"]
    fine = _blocks(hot, finer, hot.groupBy(*finer).agg(F.count("*").alias("_n")), block)
    return _linked(cool, RADIUS).unionByName(_linked(fine, RADIUS))


def group_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, block: int = BLOCK) -> DataFrame:
    """doc_id, fp and component_id of every row, for 3-word shingles and radius 3."""
    prints = with_fingerprint(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text")), "_text", words=3)
    prints = stage(prints.select("doc_id", F.col("fp")[0].alias("fp")), "simhash-prints")
    distinct = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = stage(components(link_exact(distinct.select("fp"), block=block)), "simhash-roots")
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(rooted.select("fp", "root").join(least, "root").select("fp", "component_id"), "fp")


def expected_distance(similarity: float, bits: int) -> float:
    """Mean Hamming distance of fingerprints of sets with this Jaccard similarity."""
    return bits * math.acos(2 * similarity / (1 + similarity)) / math.pi


def tables_for(rows: int, similarity: float = SIMILARITY, lanes: int = LANES) -> tuple[int, int, int]:
    """Bits of a key, number of tables, and the radius for so many fingerprints."""
    bits = 64 * lanes
    mean = expected_distance(similarity, bits)
    width = min(30, max(8, math.ceil(math.log2(max(2, rows) / 4))))
    return width, TABLES, math.floor(mean + 3 * math.sqrt(mean * (1 - mean / bits)))


def with_table_keys(prints: DataFrame, width: int, tables: int, lanes: int) -> DataFrame:
    """n, fp and key: a row for every table, whose key is the table and its sampled bits."""
    ship_package(prints.sparkSession)
    chosen = [random.Random(f"{SEED}-{t}").sample(range(64 * lanes), width) for t in range(tables)]

    @F.pandas_udf("array<bigint>")
    def keys(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for given in batches:
            values = np.array(given.tolist(), np.int64).reshape(-1, lanes)
            out = np.empty((len(values), tables), np.int64)
            for t, places in enumerate(chosen):
                out[:, t] = t << width
                for place, at in enumerate(places):
                    out[:, t] += ((values[:, at // 64] >> (at % 64)) & 1) << place
            yield pd.Series(list(out))

    return prints.select("n", "fp", F.explode(keys("fp")).alias("key"))


def similar_pairs(prints: DataFrame, rows: int, *, similarity: float = SIMILARITY, block: int = BLOCK, lanes: int = LANES) -> DataFrame:
    """Candidate pairs a < b of numbers (column n) of wide fingerprints (column fp).

    In every shard a fingerprint is paired with its nearest and its smallest-numbered
    predecessor within the radius. These are proposals only: some fail verification, and
    the links that they would have stood for are left to `missing_pairs`.
    """
    width, tables, radius = tables_for(rows, similarity, lanes=lanes)
    # Fingerprints fill few files but make many keys, so they are dealt out, by their number.
    dealt = prints.repartition(max(8, rows // DEALT), "n")
    keyed = with_table_keys(dealt, width, tables, lanes)
    counts = stage(keyed.groupBy("key").agg(F.count("*").alias("_n")).filter("_n > 1"), "similar-keys")
    blocks = (
        keyed.join(counts, "key")
        .withColumn("_blocks", F.ceil(F.col("_n") / block).cast("int"))
        .withColumn("_block", F.pmod(F.xxhash64("n"), F.col("_blocks")).cast("int"))
        .groupBy("key", "_blocks", "_block")
        .agg(F.collect_list(F.struct("n", "fp")).alias("members"))
    )

    @F.pandas_udf("array<struct<a:bigint,b:bigint>>")
    def search(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        def values(members) -> list[tuple[int, int]]:
            out = []
            for m in members:
                value = 0
                for lane in m["fp"].tolist():
                    value = value << 64 | lane & _MASK
                out.append((m["n"], value))
            return sorted(out)

        for trees, queries in batches:
            rows = []
            for tree, asked in zip(trees, queries, strict=True):
                own = values(tree)
                rows.append([{"a": a, "b": b} for a, b in proposals(own, own if asked is None else values(asked), radius, asked is None)])
            yield pd.Series(rows)

    none = F.lit(None).cast("array<struct<n:bigint,fp:array<bigint>>>")
    same = blocks.filter(F.size("members") > 1).select("members", none.alias("asked"))
    several = blocks.filter("_blocks > 1")
    asked = several.select("key", F.col("_block").alias("_asking"), F.col("members").alias("asked"))
    cross = several.join(asked, "key").filter("_asking > _block").select("members", "asked")
    pairs = same.unionByName(cross)
    return pairs.select(F.inline(search("members", "asked"))).distinct()


def proposals(tree: list[tuple[int, int]], queries: list[tuple[int, int]], radius: int, same: bool) -> list[tuple[int, int]]:
    """(smaller, larger) numbers: each query with its nearest and its first neighbour."""
    number: dict[int, int] = {}
    index, out = BKTree(), set()
    if not same:
        for n, value in tree:
            number.setdefault(value, n)
            index.add(value)
    for n, value in queries:
        found = index.within(value, radius)
        if found:
            nearest = min((d, number[m]) for d, m in found)[1]
            first = min(number[m] for _, m in found)
            out |= {(min(n, x), max(n, x)) for x in (nearest, first)}
        if same and value not in number:
            number[value] = n
            index.add(value)
    return sorted(out)


def _packed(values: np.ndarray) -> bytes:
    """Small numbers as compressed planes of their bytes."""
    return zlib.compress(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1).astype(np.int64)


def _summed(buckets: list[np.ndarray], seen: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets in order, and the sums of what belongs to them."""
    values, counts = np.concatenate(buckets), np.concatenate(seen)
    order = np.argsort(values, kind="stable")
    values, counts = values[order], counts[order]
    starts = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    return values[starts], np.add.reduceat(counts, starts)


def shingle_frequencies(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """bucket, seen: how many texts (column _text) have a shingle, for the shared ones.

    A bucket is the first 32 bits of a shingle's hash. All texts are counted. Each task
    sorts its buckets and sends them as runs of differences, one for each range of buckets,
    which takes one or two bytes a shingle; a range is merged in one pass.
    """
    ship_package(docs.sparkSession)
    bits = max(4, math.ceil(math.log2(2 * max(1, docs.rdd.getNumPartitions()))))
    shift = 32 - bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def runs(held: list[np.ndarray]) -> pa.RecordBatch:
            buckets, seen = np.unique(np.concatenate(held), return_counts=True)
            cuts = np.searchsorted(buckets, np.arange((1 << bits) + 1, dtype=np.int64) << shift)
            rows = [(r, buckets[a:b], seen[a:b]) for r, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
            columns = [pa.array([r for r, _, _ in rows], pa.int32()), pa.array([_packed(np.diff(x, prepend=0)) for _, x, _ in rows], pa.binary()), pa.array([_packed(x) for _, _, x in rows], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["part", "steps", "seen"])

        held, size = [], 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.append((np.unique(shingle_hashes(text, words)) >> np.uint64(32)).astype(np.int64))
                size += len(held[-1])
                if size >= RUN:
                    yield runs(held)
                    held, size = [], 0
        if size:
            yield runs(held)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def shared(buckets: np.ndarray, seen: np.ndarray) -> pa.RecordBatch:
            often = seen >= SHARED
            return pa.RecordBatch.from_arrays([pa.array(buckets[often]), pa.array(seen[often])], names=["bucket", "seen"])

        part, buckets, seen, size = None, [], [], 0
        for batch in batches:
            for own, steps, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != part and size:
                    yield shared(*_summed(buckets, seen))
                    buckets, seen, size = [], [], 0
                part = own
                buckets.append(np.cumsum(_unpacked(steps)))
                seen.append(_unpacked(counts))
                size += len(seen[-1])
                if size > 4 * RUN:
                    x, y = _summed(buckets, seen)
                    buckets, seen, size = [x], [y], 1
        if size:
            yield shared(*_summed(buckets, seen))

    runs = docs.select("_text").mapInArrow(count, "part int, steps binary, seen binary")
    return runs.repartition("part").sortWithinPartitions("part").mapInArrow(merge, "bucket bigint, seen bigint")


def most_frequent(docs: DataFrame, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets in order, and how many texts have them, of at most MOST of the most frequent.

    They only order the prefixes; which links are found doesn't depend on them.
    """
    table = stage(shingle_frequencies(docs, words).withColumn("level", F.floor(4 * F.log2("seen")).cast("int")), "similar-frequencies")
    levels = sorted(((r.level, r["count"]) for r in table.groupBy("level").count().collect()), reverse=True)  # 256 levels at most
    least, total = None, 0
    for level, number in levels:
        total += number
        if total > MOST:
            break
        least = level
    if least is None:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    found = table.filter(F.col("level") >= least).select("bucket", "seen").toArrow()
    buckets, seen = found["bucket"].to_numpy(), found["seen"].to_numpy()
    order = np.argsort(buckets)
    release(table)
    return buckets[order].astype(np.uint32), np.minimum(seen[order], (1 << 32) - 1).astype(np.uint32)


def least_common(size: int, similarity: float) -> int:
    """Shingles that a set of this size shares with any set that is similar enough."""
    return math.ceil(similarity * size - 1e-9)


def with_prefix(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray], *, words: int = WORDS, similarity: float = SIMILARITY, lanes: int = LANES) -> DataFrame:
    """n, key, fp, prefix, cold, size and sketch of the distinct shingles of each text (column _text).

    key is a digest of the whole set. Shingles are ordered by how many texts have them
    (`frequent`; what isn't there comes first), then by hash. The prefix is so long that two
    sets similar enough share one of it; fewer than LONG texts are known to have its first
    `cold` shingles. For the sketch see `parities`.
    """
    ship_package(docs.sparkSession)
    buckets, known = frequent

    @F.pandas_udf("struct<key:binary,fp:array<bigint>,prefix:array<bigint>,cold:int,size:int,sketch:array<bigint>>")
    def described(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        def row(text) -> tuple:
            hashes = np.unique(shingle_hashes(text, words))
            fp = [_signed(x) for x in majorities(hashes, lanes)]
            taken = len(hashes) - least_common(len(hashes), similarity) + 1 if len(hashes) else 0
            first, cold = hashes[:taken], taken
            if len(buckets) and taken:
                own = (hashes >> np.uint64(32)).astype(np.uint32)
                at = np.minimum(np.searchsorted(buckets, own), len(buckets) - 1)
                seen = np.where(buckets[at] == own, known[at], 0)
                order = np.argsort(seen, kind="stable")[:taken]  # hashes are in order already
                first, cold = hashes[order], int(np.count_nonzero(seen[order] < LONG))
            return xxhash.xxh3_128_digest(hashes.tobytes()), fp, first.view(np.int64), cold, len(hashes), parities(hashes)

        for texts in batches:
            yield pd.DataFrame([row(t) for t in texts], columns=["key", "fp", "prefix", "cold", "size", "sketch"])

    return docs.select("n", described("_text").alias("d")).select("n", "d.*")


def parities(hashes: np.ndarray) -> np.ndarray:
    """Whether each of SKETCH buckets holds an odd number of the shingles, as 64-bit lanes.

    Two sets differ in at least as many shingles as their sketches differ in bits.
    """
    odd = np.bincount((hashes & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def most_differing(size_a: np.ndarray, size_b: np.ndarray, similarity: float) -> np.ndarray:
    """Shingles that only one of two sets of these sizes has, at most, if they are similar enough."""
    total = size_a + size_b
    return total - 2 * np.ceil(similarity / (1 + similarity) * total - 1e-9)


def fitting(size_a: np.ndarray, size_b: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets of these sizes can be similar enough."""
    return np.minimum(size_a, size_b) >= similarity * np.maximum(size_a, size_b) - 1e-9


def _cold_pairs(postings: DataFrame, similarity: float) -> DataFrame:
    """Pairs a, b of different groups for each shingle of their prefixes that few rows have.

    Lists of over LONGEST rows come out as they are, marked `long`: shingle, n, group, size.
    """
    ship_package(postings.sparkSession)
    names = ["a", "b", "total", "larger", "long"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def table(columns: list[np.ndarray], long: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(np.full(len(columns[0]), long))], names=names)

        def paired(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            starts = np.flatnonzero(np.concatenate(([True], rows[0, 1:] != rows[0, :-1]))) if rows.shape[1] else np.empty(0, np.int64)
            lengths = np.diff(np.append(starts, rows.shape[1]))
            long = np.repeat(lengths > LONGEST, lengths)
            if long.any():
                yield table(list(rows[:, long]), True)
            token, n, group, size = rows[:, ~long]
            firsts, seconds, left, step = [], [], np.arange(len(token)), 1
            while len(left := left[left + step < len(token)]) and len(left := left[token[left] == token[left + step]]):
                i, j = left, left + step
                fits = (group[i] != group[j]) & fitting(size[i], size[j], similarity)
                firsts.append(i[fits])
                seconds.append(j[fits])
                step += 1
            none = np.empty(0, np.int64)
            i, j = np.concatenate([none, *firsts]), np.concatenate([none, *seconds])
            a, b, total = np.minimum(n[i], n[j]), np.maximum(n[i], n[j]), size[i] + size[j]
            yield table([a, b, total, np.maximum(size[i], size[j])], False)

        rest = np.empty((4, 0), np.int64)
        for batch in batches:
            rows = np.concatenate((rest, np.array([c.to_numpy() for c in batch.columns], np.int64).reshape(4, -1)), axis=1)
            if not rows.shape[1]:
                continue
            cut = np.searchsorted(rows[0], rows[0, -1])  # the last shingle may go on
            rest = rows[:, cut:]
            yield from paired(rows[:, :cut])
        yield from paired(rest)

    # Most rows are their own group, and zeros take no room in a shuffle.
    dealt = postings.select("token", "n", (F.col("group") - F.col("n")).alias("group"), "size").repartition("token")
    dealt = dealt.sortWithinPartitions("token").select("token", "n", (F.col("group") + F.col("n")).alias("group"), F.col("size").cast("bigint"))
    return dealt.mapInArrow(search, "a bigint, b bigint, total bigint, larger bigint, long boolean")


def _hot_pairs(postings: DataFrame, similarity: float, block: int) -> DataFrame:
    """The same for shingles that many rows have.

    Rows of a shingle's largest group need no pairs among themselves, so only the others
    are asked, against blocks of all. Pairs whose sketches differ too much don't come out.
    """
    ship_package(postings.sparkSession)
    groups = postings.groupBy("token", "group").agg(F.count("*").alias("_n"))
    counts = groups.groupBy("token").agg(
        F.sum("_n").alias("_n"), F.count("*").alias("_groups"), F.max(F.struct("_n", "group"))["group"].alias("_largest")
    )
    counts = stage(counts.filter("_groups > 1").drop("_groups"), "similar-hot")
    packed, width = F.concat(F.array("n", "group", "size"), F.col("sketch")), 3 + SKETCH // 64
    kept = (
        postings.join(counts, "token")
        .withColumn("_asks", F.col("group") != F.col("_largest"))
        .withColumn("_block", F.pmod(F.xxhash64("n"), F.ceil(F.col("_n") / block)).cast("int"))
    )
    blocks = stage(kept.groupBy("token", "_block", "_asks").agg(F.flatten(F.collect_list(packed)).alias("members")), "similar-blocks")

    @F.pandas_udf("struct<a:array<bigint>,b:array<bigint>,total:array<bigint>,larger:array<bigint>>")
    def search(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for asked, members in batches:
            rows = []
            for x, y in zip(asked, members, strict=True):
                x, y = (np.asarray(v, np.int64).reshape(-1, width) for v in (x, y))
                fits = (x[:, None, 1] != y[None, :, 1]) & fitting(x[:, None, 2], y[None, :, 2], similarity)
                if np.array_equal(x[:, 0], y[:, 0]):
                    fits &= x[:, None, 0] < y[None, :, 0]
                i, j = np.nonzero(fits)
                differing = np.zeros(len(i), np.int64)
                for lane in range(3, width):
                    differing += np.bitwise_count((x[i, lane] ^ y[j, lane]).view(np.uint64))
                near = differing <= most_differing(x[i, 2], y[j, 2], similarity)
                i, j = i[near], j[near]
                a, b, sizes = x[i, 0], y[j, 0], (x[i, 2], y[j, 2])
                rows.append((np.minimum(a, b), np.maximum(a, b), np.add(*sizes), np.maximum(*sizes)))
            yield pd.DataFrame(rows, columns=["a", "b", "total", "larger"])

    asked = blocks.filter("_asks").select("token", F.col("_block").alias("_asking"), F.col("members").alias("asked"))
    # Two blocks that both ask meet once.
    met = blocks.join(asked, "token").filter("not _asks or _asking >= _block")
    found = met.select(search("asked", "members").alias("p"))
    return found.select(F.inline(F.arrays_zip("p.a", "p.b", "p.total", "p.larger"))).toDF("a", "b", "total", "larger")


def missing_pairs(prefixes: DataFrame, *, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """All pairs a < b of different groups (column group) that can be similar enough.

    A pair's common shingles are those counted in both prefixes and others; the others lie
    behind the prefix that ends first, so they are at most what is left of the larger set.
    """
    postings = prefixes.select("n", "group", "size", "cold", "sketch", F.posexplode("prefix").alias("at", "token"))
    cold = stage(_cold_pairs(postings.filter("at < cold"), similarity), "similar-cold")
    long = cold.filter("long").select(F.col("a").alias("token"), F.col("b").alias("n"), F.col("total").alias("group"), F.col("larger").alias("size"))
    long = long.join(prefixes.select("n", "sketch"), "n")
    hot = postings.filter("at >= cold").select("token", "n", "group", F.col("size").cast("bigint"), "sketch").unionByName(long)
    met = cold.filter("not long").drop("long").unionByName(_hot_pairs(hot, similarity, block))
    counted = met.groupBy("a", "b", "total", "larger").agg(F.count("*").alias("_common"))
    most = F.col("_common") + F.ceil(similarity * F.col("larger") - 1e-9) - 1
    return counted.filter(most >= similarity / (1 + similarity) * F.col("total") - 1e-9).select("a", "b")


def verified(pairs: DataFrame, docs: DataFrame, *, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs whose shingle sets have at least this Jaccard similarity."""

    @F.pandas_udf("array<bigint>")
    def shingle_set(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([np.unique(shingle_hashes(t, words)).view(np.int64) for t in texts])

    named = pairs.select(F.explode(F.array("a", "b")).alias("n")).distinct()
    sets = stage(docs.join(named, "n").select("n", shingle_set("_text").alias("s")), "similar-sets")
    both = pairs.join(sets.select(F.col("n").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("n").alias("b"), F.col("s").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - common
    return both.filter((union == 0) | (common >= similarity * union)).select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = WORDS, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """n, id and root of every row: rows of one root are near-duplicates of each other.

    docs must have a row number n. Links have an exact Jaccard similarity of the sets of
    `words`-word shingles of at least `similarity`. Equal sets are linked first, then the
    distinct sets that the fingerprints propose, then every pair of different groups that
    the prefixes leave possible; so the groups are those of all pairs compared.
    """
    docs = docs.select("n", F.col(text_col).alias("_text"))
    rule = {"words": words, "similarity": similarity}
    prints = stage(with_prefix(docs, most_frequent(docs, words), **rule), "similar-prints")
    first = stage(prints.groupBy("key").agg(F.min("n").alias("n"), F.min("fp").alias("fp")), "similar-distinct")
    equal = prints.select("n", "key").join(first.select("key", F.col("n").alias("_first")), "key").filter("n <> _first")
    equal = stage(equal.select(F.col("_first").alias("a"), F.col("n").alias("b")), "similar-equal")
    pairs = stage(similar_pairs(first.select("n", "fp"), first.count(), similarity=similarity, block=block), "similar-pairs")
    links = stage(verified(pairs, docs, **rule), "similar-links")
    release(first, pairs)
    groups = components(links)
    distinct = prints.drop("key", "fp").join(equal.select(F.col("b").alias("n")), "n", "left_anti")
    grouped = distinct.join(groups.withColumnRenamed("node", "n"), "n", "left").withColumn("group", F.coalesce("root", "n"))
    rest = stage(missing_pairs(grouped, similarity=similarity, block=block), "similar-missing")
    release(prints)
    more = stage(verified(rest, docs, **rule), "similar-links")
    return components(links.unionByName(more).unionByName(equal))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each group stays: that with the smallest id, then the first row."""
    own = docs.columns
    docs = docs.toDF(*[f"own{i}" for i in range(len(own))])
    id_col, text_col = (f"own{own.index(c)}" for c in (id_col, text_col))
    named = stage(docs.withColumn("_unique", F.monotonically_increasing_id()), "similar-input")
    roots = near_duplicates(named.select(F.col("_unique").alias("n"), id_col, text_col), id_col, text_col, **options)
    roots = stage(roots, "similar-roots")
    members = roots.join(named.select(F.col("_unique").alias("node"), F.col(id_col).alias("_id")), "node")
    order = F.struct(F.col("_id").isNull().alias("unnamed"), F.col("_id").alias("id"), F.col("node").alias("node"))
    keep = members.groupBy("root").agg(F.min(order)["node"].alias("node"))
    dropped = stage(roots.join(keep, "node", "left_anti").select(F.col("node").alias("_unique")), "similar-dropped")
    return named.join(dropped, "_unique", "left_anti").drop("_unique").toDF(*own)
