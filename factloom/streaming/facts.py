"""Facts that grow with a stream of rows.

Each micro-batch is reduced to the mergeable parts of `operators.merge` and written as the
folder of its number, over whatever an attempt before a crash left there; so a batch counts
once, however often it is run, and any split of the rows into batches gives the facts of all
rows at once. The state is a table in shared storage: a fact with a third of all rows is
reduced inside its batch before anything is shuffled, and no task holds one fact's history.
`compact` merges the folders of finished batches into one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factloom.operators.merge import combine, fact_parts, facts_of
from factloom.session import release, stage

#: A folder holds the parts of the batches from `since` to `upto`.
_SPAN = ("since", "upto")


def _folder(path: str, since: int, upto: int) -> str:
    return f"{path}/since={since}/upto={upto}"


def write_batch(rows: DataFrame, number: int, path: str, template_id: str, columns: Sequence[str]) -> None:
    """The parts of one batch; writing a number again replaces it."""
    own = stage(rows, "batch-rows")
    fact_parts(own, template_id, columns).write.mode("overwrite").parquet(_folder(path, number, number))
    release(own)


def start(rows: DataFrame, path: str, checkpoint: str, template_id: str, columns: Sequence[str], **trigger) -> StreamingQuery:
    """Merges a stream of rows into the parts at `path`; `trigger` is that of the stream, all that is there by default."""
    stream = rows.writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True}))
    return stream.foreachBatch(lambda batch, number: write_batch(batch, number, path, template_id, columns)).start()


def _spans(parts: DataFrame) -> list[tuple[int, int]]:
    """Folders that count: wider ones hide those inside them."""
    held = sorted((r.since, -r.upto) for r in parts.select(*_SPAN).distinct().collect())
    out, end = [], -1
    for since, upto in held:
        if since > end:
            out.append((since, -upto))
            end = -upto
    return out


def _counting(parts: DataFrame, spans: list[tuple[int, int]]) -> DataFrame:
    wanted = F.lit(False)
    for since, upto in spans:
        wanted = wanted | ((F.col("since") == since) & (F.col("upto") == upto))
    return parts.filter(wanted).drop(*_SPAN)


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    """The parts of all batches so far, reduced."""
    parts = spark.read.parquet(path)
    return combine(_counting(parts, _spans(parts)))


def read_facts(spark: SparkSession, path: str, template_id: str, columns: Sequence[str], *, listed: bool = True) -> DataFrame:
    return facts_of(read_parts(spark, path), template_id, columns, listed=listed)


def compact(spark: SparkSession, path: str) -> None:
    """One folder for all batches so far. The narrow folders stay until the caller removes
    them, so readers that have begun go on; they no longer count."""
    parts = spark.read.parquet(path)
    spans = _spans(parts)
    if len(spans) > 1:
        combine(_counting(parts, spans)).write.mode("overwrite").parquet(_folder(path, spans[0][0], spans[-1][1]))
