"""Exact deduplication by a log-structured merge index, in DataFrame functions.

Each input partition is a memtable: its (digest, row) entries are flushed sorted by digest.
A table is flushed in MEMTABLES parts, each a run of level 0 in a folder of its own;
`MergeIndex` keeps runs by level, and compacts a level of `fanout` runs into one run of the
next, which has one entry for each digest, with the preferred row and the count. Partial
aggregation reduces a hot digest inside each run before anything is shuffled. Runs have
filters, bitmaps over their digests of about FILTER_SHARE bits a digest; `known` probes
them and looks rows up in the runs whose filter they pass. An index with a folder is opened
again from it; a run's folder names the batches it covers, so after a compaction that was
cut off nothing counts twice.

Hits (digests of several rows) receive byte verification. A filter of the hit digests
selects the texts that are compared; the smallest and largest normalised text of a digest
are equal exactly if all its texts are. Digests that fail are grouped again by the texts
themselves. Filters of up to FILTER_BITS are broadcast; larger ones are joined by their
parts, of which each row needs one.

Texts are equal when identical after deleting space, tab, LF, VT, FF and CR; null counts
as empty. The row with the most code points in the original text stays, then the smallest
id, then the first row; null ids come last. Empty tables give no rows; repeated rows are
members of their group, and one of them stays; other columns pass through `deduplicate`.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.session import release, removed, stage

SPACES = " \t\n\x0b\x0c\r"

#: Bits of a filter that is still broadcast (16 MiB), and bits for each of its digests.
FILTER_BITS, FILTER_SHARE = 1 << 27, 16
#: Runs of a level that are compacted into one of the next.
FANOUT = 4
#: Runs that a table is flushed in.
MEMTABLES = 8


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def _entries(docs: DataFrame, id_col: str, text_col: str, key_bytes: int) -> DataFrame:
    sha = F.unhex(F.sha2(normalised(F.col(text_col)), 256))
    return docs.select(
        F.col(id_col).alias("_id"),
        F.char_length(F.coalesce(F.col(text_col), F.lit(""))).alias("_points"),
        sha.alias("_sha"),
        F.monotonically_increasing_id().alias("_row"),
    ).withColumn("_key", F.substring("_sha", 1, key_bytes))


def _best() -> Column:
    """Ordered so that the smallest is the row that stays."""
    return F.struct(
        (-F.col("_points")).alias("fewer"), F.col("_id").isNull().alias("unnamed"), F.col("_id").alias("id"), F.col("_row").alias("row")
    )


def flush(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key_bytes: int = 32, parts: int = 1) -> DataFrame:
    """Sorted digest entries of rows, in folders of `_run`, from 0 to parts - 1."""
    entries = _entries(docs, id_col, text_col, key_bytes).sortWithinPartitions("_key")
    return stage(entries.withColumn("_run", F.spark_partition_id() % parts), "dedup-runs", by=("_run",))


def compact(*runs: DataFrame) -> DataFrame:
    """One entry for each digest over all runs: the preferred row and the count."""
    merged = reduce(DataFrame.unionByName, runs)
    return merged.groupBy("_key").agg(F.min("_keep").alias("_keep"), F.sum("_n").alias("_n"))


def as_run(rows: DataFrame) -> DataFrame:
    """The entries of flushed rows as a run of the lowest level."""
    return rows.select("_key", _best().alias("_keep"), F.lit(1).cast("bigint").alias("_n"))


@dataclass
class Run:
    """Entries of the batches from since to upto. reduced: with one entry for each digest."""

    entries: DataFrame
    level: int
    since: int
    upto: int
    reduced: bool
    path: str | None = None
    filter: tuple[DataFrame, int] | None = None

    def probed(self) -> tuple[DataFrame, int]:
        """The run's filter and its bits, made when it is first asked for."""
        if self.filter is None:
            bits = filter_bits(self.entries.count())
            self.filter = stage(digest_filter(self.entries, bits), "dedup-filter"), bits
        return self.filter


class MergeIndex:
    """Runs of batches by level. Ids must tell rows of different batches apart.

    folder: where the index lives, for `open`; without one it is staged and goes with the driver.
    """

    def __init__(self, *, key_bytes: int = 32, fanout: int = FANOUT, folder: str | None = None):
        self.key_bytes, self.fanout, self.folder = key_bytes, fanout, folder
        self.levels: list[list[Run]] = [[]]
        self.batches = 0

    @classmethod
    def open(cls, spark: SparkSession, folder: str, *, key_bytes: int = 32, fanout: int = FANOUT) -> MergeIndex:
        """The index of a folder; runs that a wider one covers don't count."""
        index = cls(key_bytes=key_bytes, fanout=fanout, folder=folder)
        entries = spark.read.parquet(folder)
        held = sorted((-r.level, r.since, r.upto) for r in entries.select("level", "since", "upto").distinct().collect())
        kept: list[Run] = []
        for level, since, upto in held:
            if not any(k.since <= since and upto <= k.upto for k in kept):
                kept.append(index._read(spark, -level, since, upto))
        index.levels = [sorted((k for k in kept if k.level == n), key=lambda k: k.since) for n in range(max((k.level for k in kept), default=0) + 1)]
        index.batches = max((k.upto + 1 for k in kept), default=0)
        return index

    def _read(self, spark: SparkSession, level: int, since: int, upto: int) -> Run:
        path = f"{self.folder}/level={level}/since={since}/upto={upto}"
        return Run(spark.read.parquet(path), level, since, upto, True, path)

    def _kept(self, entries: DataFrame, level: int, since: int, upto: int) -> Run:
        """Writes a reduced run, sorted by digest."""
        ordered = entries.sortWithinPartitions("_key")
        if self.folder is None:
            return Run(stage(ordered, f"dedup-level{level}"), level, since, upto, True)
        ordered.write.mode("overwrite").parquet(f"{self.folder}/level={level}/since={since}/upto={upto}")
        return self._read(entries.sparkSession, level, since, upto)

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Takes a batch in and gives its flushed rows."""
        rows = flush(docs, id_col, text_col, self.key_bytes)
        self.add_rows(rows)
        return rows

    def add_rows(self, rows: DataFrame) -> None:
        """Takes flushed rows in as a run of level 0; full levels are compacted."""
        at, entries = self.batches, as_run(rows)
        self.batches += 1
        # Without a folder the run is the flushed rows, which are staged already.
        self.levels[0].append(Run(entries, 0, at, at, False) if self.folder is None else self._kept(compact(entries), 0, at, at))
        for level, runs in enumerate(self.levels):
            if len(runs) < self.fanout:
                break
            if level + 1 == len(self.levels):
                self.levels.append([])
            merged = compact(*[r.entries for r in runs])
            self.levels[level + 1].append(self._kept(merged, level + 1, runs[0].since, runs[-1].upto))
            for run in runs:
                if run.path:
                    removed(rows.sparkSession, run.path)
                elif run.level:
                    release(run.entries)
                if run.filter:
                    release(run.filter[0])
            runs.clear()

    def runs(self) -> list[Run]:
        return [run for level in self.levels for run in level]

    def entries(self) -> DataFrame:
        """The whole index, compacted and staged."""
        runs = self.runs()
        if len(runs) == 1 and runs[0].reduced:
            return runs[0].entries
        return stage(compact(*[r.entries for r in runs]), "dedup-index")

    def known(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Rows of another batch whose digest is in the index, with the digest as `_key`.

        Rows are looked up once, in all runs whose filters they pass.
        """
        rows = flush(docs, id_col, text_col, self.key_bytes)
        runs = self.runs()
        if not runs:
            return rows.limit(0)
        maybe = reduce(DataFrame.unionByName, [passing(rows, *r.probed()).withColumn("_in", F.lit(i)) for i, r in enumerate(runs)])
        held = reduce(DataFrame.unionByName, [r.entries.select("_key", F.lit(i).alias("_in")) for i, r in enumerate(runs)])
        return maybe.join(held, ["_key", "_in"], "left_semi").drop("_in").distinct()


def filter_bits(digests: int) -> int:
    """A power of two with FILTER_SHARE bits a digest at least, and whole parts."""
    return 1 << max(15, (FILTER_SHARE * max(digests, 1) - 1).bit_length())


def _slot(key: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(bits)) + 1


def digest_filter(run: DataFrame, bits: int) -> DataFrame:
    """Bitmaps (4 KiB each, `bits` in all) of a run's digests."""
    slot = _slot(F.col("_key"), bits)
    return run.groupBy(F.bitmap_bucket_number(slot).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("_bits"))


def passing(rows: DataFrame, digests: DataFrame, bits: int) -> DataFrame:
    """Rows whose digest (`_key`) may be one of the filter's."""
    slot = _slot(F.col("_key"), bits)
    parts = F.broadcast(digests) if bits <= FILTER_BITS else digests
    probed = rows.withColumn("_bucket", F.bitmap_bucket_number(slot)).join(parts, "_bucket")
    return probed.filter(_is_set(F.col("_bits"), F.bitmap_bit_position(slot))).drop("_bucket", "_bits")


def _is_set(bits: Column, position: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, (F.floor(position / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.floor(byte / F.pow(F.lit(2), position % 8)) % 2 == 1


def differing_hits(docs: DataFrame, index: DataFrame, id_col: str, text_col: str, key_bytes: int) -> DataFrame:
    """Digests whose rows don't all have the same normalised bytes."""
    texts = docs.select(normalised(F.col(text_col)).alias("_text")).withColumn(
        "_key", F.substring(F.unhex(F.sha2("_text", 256)), 1, key_bytes)
    )
    several = index.filter("_n > 1").select("_key")
    bits = filter_bits(several.count())
    hits = passing(texts, digest_filter(several, bits), bits)
    return (
        hits.groupBy("_key")
        .agg(F.min("_text").alias("_low"), F.max("_text").alias("_high"))
        .filter("_low <> _high")
        .select("_key")
    )


def group_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, key_bytes: int = 32, held: list[DataFrame] | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    key_bytes: bytes of the SHA-256 that the index is keyed by. held: gets the staged
    tables that the result reads.
    """
    held = [] if held is None else held
    whole = MergeIndex(key_bytes=key_bytes)
    runs = flush(docs, id_col, text_col, key_bytes, MEMTABLES)
    for k in range(MEMTABLES):
        whole.add_rows(runs.filter(F.col("_run") == k))
    index = whole.entries()
    held += [runs, index]
    differing = stage(differing_hits(docs, index, id_col, text_col, key_bytes), "dedup-differing")
    if differing.isEmpty():
        return _result(runs.join(index, "_key"))
    sound = _result(runs.join(index.join(differing, "_key", "left_anti"), "_key"))
    # Row ids are drawn anew here, so these texts are staged with them.
    again = docs.select(
        F.col(id_col).alias("_id"),
        F.char_length(F.coalesce(F.col(text_col), F.lit(""))).alias("_points"),
        normalised(F.col(text_col)).alias("_text"),
        F.monotonically_increasing_id().alias("_row"),
    ).withColumn("_sha", F.unhex(F.sha2("_text", 256)))
    again = again.withColumn("_key", F.substring("_sha", 1, key_bytes)).join(differing, "_key", "left_semi")
    again = stage(again, "dedup-again")
    held += [differing, again]
    by_text = again.groupBy("_key", "_text").agg(F.min(_best()).alias("_keep"), F.count("*").alias("_n"))
    return sound.unionByName(_result(again.join(by_text, ["_key", "_text"])))


def _result(joined: DataFrame) -> DataFrame:
    return joined.select(
        F.col("_id").alias("doc_id"),
        F.col("_keep.id").alias("keep_id"),
        F.col("_n").cast("bigint").alias("group_size"),
        (F.col("_row") == F.col("_keep.row")).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns.

    Rows are told apart by a row id that is staged with them, so repeated ids are safe.
    """
    own = docs.columns
    docs = docs.toDF(*[f"own{i}" for i in range(len(own))])
    id_col, text_col = (f"own{own.index(c)}" for c in (id_col, text_col))
    named = stage(docs.withColumn("_unique", F.monotonically_increasing_id()), "dedup-input")
    keyed = named.withColumn("_pair", F.struct(F.col(id_col).isNull(), F.col(id_col), F.col("_unique")))
    held: list[DataFrame] = []
    dropped = group_rows(keyed, "_pair", text_col, held=held).filter("not kept").select(F.col("doc_id._unique").alias("_unique"))
    dropped = stage(dropped, "dedup-dropped")
    release(*held)
    return named.join(dropped, "_unique", "left_anti").drop("_unique").toDF(*own)
