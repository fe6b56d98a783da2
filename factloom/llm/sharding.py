"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

The input's partitions are the sources of the exchange. For every partition the number
of its rows that go to every shard is drawn so that the whole matrix has the law it has
under a uniform permutation: row sums are the partitions' sizes, column sums the shards'
exact sizes. Rows are permuted inside their partition by a local sort by a hash, which
moves nothing, and numbered; cut by the matrix, they are exchanged, and permuted again
inside their shard. All steps on rows are DataFrame functions; the driver sees one count
for each partition and draws the matrix, which goes to the tasks as a staged table whose
size Spark knows when it chooses the join.

A draw inverts the distribution outwards from its mode. The mode's probability comes from
binomial ones by their deviance, so it keeps its digits at any number of rows: the sum over
all outcomes is 1 within 1e-9 at 10^13 rows. What is drawn with is a double, so outcomes
below about 1e-16 never come.

Law: `rows`, the shards' counts differ by at most one. Large shards are not sorted in one
task: the second permutation sorts by a hash and is cut into hash ranges of bounded size,
and a running sum of the ranges' counts gives each its first slot.

Edge cases: null texts have size 16 and checksum 0; equal rows and equal or null ids are
told apart by a row id that is drawn once and staged; empty tables give no rows; with
fewer rows than shards some shards stay empty; other columns pass through.
"""

from __future__ import annotations

import math
import random
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.session import stage

#: Rows of a shard that one task orders, on average.
RANGE_ROWS = 100_000


def _stirling(n: int) -> float:
    """log n! less Stirling's formula, without cancelling for large n."""
    if n < 16:
        return math.lgamma(n + 1) - ((n + 0.5) * math.log(n) - n + 0.5 * math.log(2 * math.pi)) if n else 0.0
    square = 1.0 / (n * n)
    return (1 / 12 - square * (1 / 360 - square * (1 / 1260 - square * (1 / 1680 - square / 1188)))) / n


def _deviance(x: int, mean: float) -> float:
    """x log(x / mean) + mean - x, by a series where both are close."""
    gap = x - mean
    if abs(gap) >= 0.1 * (x + mean):
        return x * math.log(x / mean) - gap
    v = gap / (x + mean)
    total, term, k = gap * v, 2 * x * v, 1
    while True:
        term *= v * v
        more = total + term / (2 * k + 1)
        if more == total:
            return more
        total, k = more, k + 1


def _binomial(k: int, n: int, p: float, q: float) -> float:
    """log of the binomial probability of k of n; p + q = 1."""
    if k == 0 or k == n:
        return n * (math.log(q) if k == 0 else math.log(p)) if n else 0.0
    parts = _stirling(n) - _stirling(k) - _stirling(n - k) - _deviance(k, n * p) - _deviance(n - k, n * q)
    return parts - 0.5 * math.log(2 * math.pi * k * ((n - k) / n))


def probability(k: int, good: int, bad: int, draws: int) -> float:
    """Of k good ones among draws without return."""
    p = draws / (good + bad)
    q = (good + bad - draws) / (good + bad)
    if p == 0 or q == 0:
        return 1.0
    return math.exp(_binomial(k, good, p, q) + _binomial(draws - k, bad, p, q) - _binomial(draws, good + bad, p, q))


def hypergeometric(good: int, bad: int, draws: int, rng: random.Random) -> int:
    """A draw by inversion outwards from the mode, about as many steps as its spread."""
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    peak = probability(mode, good, bad, draws)
    left = rng.random() - peak
    up, down, p_up, p_down = mode, mode, peak, peak
    while left > 0:
        moved = False
        if up < high and p_up > 0:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up, left, moved = up + 1, left - p_up, True
            if left <= 0:
                return up
        if down > low and p_down > 0:
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down, left, moved = down - 1, left - p_down, True
            if left <= 0:
                return down
        if not moved:
            return mode
    return mode


def communication_matrix(sizes: list[int], shards: int, seed: int) -> list[list[int]]:
    """Rows: partitions of the given sizes; columns: shards of exact, near equal sizes."""
    rng, total = random.Random(seed), sum(sizes)
    room = [total // shards + (j < total % shards) for j in range(shards)]
    matrix = []
    for size in sizes:
        row, left, rest = [], size, sum(room)
        for j in range(shards):
            n = hypergeometric(room[j], rest - room[j], left, rng)
            rest, left = rest - room[j], left - n
            room[j] -= n
            row.append(n)
        matrix.append(row)
    return matrix


def _key(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col("_row"))


def shard_rows(df: DataFrame, shards: int, *, seed: int = 42, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Adds shard (0 to shards-1) and slot (0, 1, ... inside the shard) to every row.

    They replace input columns of these names; all others pass through, whatever their names.
    """
    spark, given = df.sparkSession, df.drop("shard", "slot")
    own = [f"own{i}" for i in range(len(given.columns))]
    df = given.toDF(*own)
    # The rank after the local permutation is the row's number in its partition.
    given_order = df.withColumn("_row", F.monotonically_increasing_id())
    permuted = given_order.sortWithinPartitions(_key(seed), "_row").withColumn("_row", F.monotonically_increasing_id())
    rows = stage(permuted, "shard-rows").withColumns({"_part": F.shiftright("_row", 33).cast("int"), "_rank": F.col("_row").bitwiseAND((1 << 33) - 1) + 1})
    sizes = sorted((r._part, r.n) for r in rows.groupBy("_part").agg(F.count("*").alias("n")).collect())
    total = sum(n for _, n in sizes)
    if not total:
        return given.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("bigint")}).limit(0)
    drawn = communication_matrix([n for _, n in sizes], shards, seed)
    cuts = [(part, list(accumulate(row))) for (part, _), row in zip(sizes, drawn, strict=True)]
    matrix = stage(spark.createDataFrame(cuts, "_part int, _ends array<bigint>"), "shard-matrix")
    ranges = 2 ** max(0, math.ceil(math.log2(total / shards / range_rows)))
    dealt = (
        rows.join(matrix, "_part")
        .withColumn("shard", F.size(F.filter("_ends", lambda end: end < F.col("_rank"))))
        .withColumn("_order", _key(seed + 1))
        .withColumn("_range", F.pmod(F.shiftright("_order", 20), F.lit(ranges)).cast("int"))
        .drop("_rank", "_ends", "_part")
    )
    dealt = stage(dealt, "shard-dealt")
    before = Window.partitionBy("shard").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    first = (
        dealt.groupBy("shard", "_range")
        .agg(F.count("*").alias("_n"))
        .select("shard", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    )
    inside = Window.partitionBy("shard", "_range").orderBy("_order", "_row")
    return (
        dealt.withColumn("_at", F.row_number().over(inside))
        .join(first, ["shard", "_range"])
        .withColumn("slot", (F.col("_first") + F.col("_at") - 1).cast("bigint"))
        .select(*own, "shard", "slot")
        .toDF(*given.columns, "shard", "slot")
    )


def document_columns(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text plus 16) and the text's CRC-32."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("bigint").alias("size"),
        F.crc32(text).cast("bigint").alias("text_crc32"),
    )
