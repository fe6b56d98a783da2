"""Packing of tokenised documents into sequences by the sum-of-squares rule.

A document's ids are followed by one end id. A document longer than a sequence is cut into
full pieces, the first of which may be shorter. Pieces are dealt at random to groups of
about GROUP_PIECES; each group is packed in one task, longest pieces first, by the
sum-of-squares rule: place the piece where the sum, over residual gaps, of the squared
number of open bins with that gap becomes smallest; of equal choices the smallest gap. A
group leaves at most a few bins half open, so the number of sequences doesn't depend on
the input's size beyond a constant for each GROUP_PIECES pieces.

Edge cases: null texts are empty documents of one end id; full pieces fill a sequence of
their own; equal lengths and repeated rows or ids are told apart by a row id that is
staged with the pieces; empty tables give no rows; other columns don't pass through.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.tokens import encoder
from factloom.session import ship_package, stage

LENGTH = 2048
END_ID = 0
GROUP_PIECES = 16_384
PIECES = "array<struct<piece:int,start:bigint,length:bigint,ids_crc32:bigint{ids}>>"


def cut(total: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of `total` ids."""
    if total <= length:
        return [(0, total)]
    first = total % length
    starts = ([0] if first else []) + list(range(first, total, length))
    return [(a, first if first and not a else length) for a in starts]


def pieces_of(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece; with_ids adds the ids themselves."""
    ship_package(docs.sparkSession)
    kind = PIECES.format(ids=",ids:array<bigint>" if with_ids else "")

    @F.pandas_udf(kind)
    def pieces(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = encoder(path)
        for texts in batches:
            rows = []
            for text in texts:
                ids = np.append(own.ids(text or ""), np.uint32(end_id)).astype("<u4")
                found = []
                for k, (a, n) in enumerate(cut(len(ids), length)):
                    part = ids[a : a + n]
                    row = {"piece": k, "start": a, "length": n, "ids_crc32": zlib.crc32(part.tobytes())}
                    found.append(row | {"ids": part.astype(np.int64).tolist()} if with_ids else row)
                rows.append(found)
            yield pd.Series(rows)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("_row"), pieces(F.col(text_col)).alias("p"))
    return rows.select("doc_id", "_row", F.inline("p"))


def sum_of_squares(lengths: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every piece, given in the order of placement."""
    bins = np.empty(len(lengths), np.int64)
    offsets = np.empty(len(lengths), np.int64)
    open_bins = np.zeros(length + 1, np.int64)  # by gap; a full bin is not open
    waiting: list[list[int]] = [[] for _ in range(length)]
    made = 0
    for i, size in enumerate(lengths.tolist()):
        best, gap = 2 * open_bins[length - size] + 1 if size < length else 0, length
        if size < length:
            fits = open_bins[size:length]
            # From a gap g to g - size: the squares change by 2 (N(g-size) - N(g)) + 2, and
            # by -2 N(g) + 1 where the bin becomes full.
            change = np.where(fits > 0, 2 * (open_bins[: length - size] - fits) + 2, np.iinfo(np.int64).max)
            if fits[0] > 0:
                change[0] = 1 - 2 * fits[0]
            at = int(change.argmin())
            if change[at] <= best:
                gap = at + size
        if gap == length:
            number, made = made, made + 1
        else:
            number = waiting[gap].pop()
            open_bins[gap] -= 1
        bins[i], offsets[i] = number, length - gap
        if gap > size:
            open_bins[gap - size] += 1
            waiting[gap - size].append(number)
    return bins, offsets


def pack(pieces: DataFrame, *, length: int = LENGTH, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Adds sequence_id and offset to every piece."""
    ship_package(pieces.sparkSession)
    pieces = stage(pieces, "packing-pieces")
    groups = max(1, -(-pieces.count() // group_pieces))
    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64("_row", "piece"), F.lit(groups)))
    schema = f"{dealt.schema.simpleString()[7:-1]},sequence_id:bigint,offset:bigint"

    def fill(group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), ("_row", "ascending"), ("piece", "ascending")])
        number, offset = sum_of_squares(group["length"].to_numpy(), length)
        number += group["_group"].to_numpy() << 32
        return group.append_column("sequence_id", pa.array(number)).append_column("offset", pa.array(offset))

    return dealt.groupBy("_group").applyInArrow(fill, schema).drop("_group", "_row")


def pack_documents(docs: DataFrame, path: str, *, length: int = LENGTH, end_id: int = END_ID, **columns) -> DataFrame:
    """The sequences themselves: sequence_id, ids and the documents in each."""
    packed = pack(pieces_of(docs, path, length=length, end_id=end_id, with_ids=True, **columns), length=length)
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "length", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select(
        "sequence_id",
        F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"),
        F.transform("p", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["piece"].alias("piece"), x["offset"].alias("offset"))).alias("documents"),
    )
