"""Corpora: fixed-window chunks with offsets, and the choice of collections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_COLLECTIONS = 5
PREFERRED = "open-access"


def chunk_documents(docs: DataFrame, size: int = 1000, *, id_col: str = "doc_id", text_col: str = "text", collection: str = "source") -> DataFrame:
    """Windows of `size` characters: chunk_id, offsets and neighbours; empty texts have none.

    Parts are cut inside the row, so a document is read once and nothing is shuffled.
    """
    n = F.ceil(F.char_length(text_col) / size).cast("int")
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    parts = F.transform(starts, lambda k: F.struct(k.alias("chunk_index"), F.substring(F.col(text_col), k * size + 1, F.lit(size)).alias("content")))
    doc = F.col(id_col).cast("string")
    name = lambda k: F.concat_ws(":", F.col("doc_id"), k.cast("string"))
    k = F.col("chunk_index")
    return docs.select(doc.alias("doc_id"), F.col(collection).alias("collection"), n.alias("_n"), F.inline(parts)).select(
        "doc_id", "collection", name(k).alias("chunk_id"), "chunk_index", "content", (k * size).alias("start_char"),
        (k * size + F.char_length("content")).alias("end_char"), F.when(k > 0, name(k - 1)).alias("prev_chunk_id"),
        F.when(k < F.col("_n") - 1, name(k + 1)).alias("next_chunk_id"),
    )


def searchable(collections: DataFrame) -> DataFrame:
    """Active collections that have chunks; a missing state counts as active."""
    return collections.filter((F.coalesce("state", F.lit("active")) == "active") & (F.coalesce("count", F.lit(0)) > 0))


def collection_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy(F.col("collection").alias("id")).agg(F.count("*").alias("count"))


def total(collections: DataFrame, ids: list[str] | None = None) -> DataFrame:
    """One row: the chunks and the number of the collections, of all or of the chosen ones."""
    chosen = collections if ids is None else collections.filter(F.col("id").isin(*ids))
    return chosen.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("chunks"), F.count("*").alias("collections"))


def resolve_collections(ids: list[str], value: str | None, server_default: str | None = None) -> list[str]:
    """Ids to search: one, a list, "all", or the default for nothing."""
    if not (value or "").strip():
        chosen = [c for c in (PREFERRED, server_default, *ids[:1]) if c in ids]
        return chosen[:1]
    asked = [p.strip() for p in value.replace(";", ",").split(",") if p.strip()]
    if any(p.lower() == "all" for p in asked):
        if len(ids) > MAX_COLLECTIONS:
            raise ValueError(f"'all' covers {len(ids)} collections; choose at most {MAX_COLLECTIONS} of: {', '.join(ids)}")
        return list(ids)
    unknown = [p for p in asked if p not in ids]
    if unknown:
        raise ValueError(f"unknown collection(s): {', '.join(unknown)}. Available: {', '.join(ids)}, or 'all'")
    distinct = list(dict.fromkeys(asked))
    if len(distinct) > MAX_COLLECTIONS:
        raise ValueError(f"at most {MAX_COLLECTIONS} collections, got {len(distinct)}")
    return distinct


def size_note(count: int) -> str:
    return f"{count / 1e6:.1f}M chunks" if count >= 1_000_000 else f"{count:,} chunks"


def select_corpus(chunks: DataFrame, ids: list[str]) -> DataFrame:
    """A filter on the partition column prunes the others' files."""
    return chunks.filter(F.col("collection").isin(*ids))
