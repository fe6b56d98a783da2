"""Query batches as a stream: specs arrive as files, answers leave as progress records.

A micro-batch runs the specs that no progress record completes (an anti join by query id)
and writes its records as the folder of its number. A batch that was cut off before its
records were written runs again; one that was cut off after them, before the stream noted
it, finds them and asks nothing. So a generator is called once for each query, whatever
stops the run between batches; only the queries of a batch that died halfway are asked again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from factloom.operators import batch
from factloom.session import release, stage
from factloom.sources.specs import normalised, with_identity


def spec_stream(spark: SparkSession, folder: str, *, sep: str = "\t", header: str, files_per_batch: int = 1, defaults: dict | None = None) -> DataFrame:
    """Specs of the files that arrive in a folder, with their ids. header: the files' column names, by `sep`."""
    schema = ", ".join(f"`{name}` string" for name in header.split(sep))
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).csv(folder, sep=sep, header=True, escape='"')
    return with_identity(normalised(raw, defaults, ordered=False)).filter("organism <> ''")


def known_ids(spark: SparkSession, path: str) -> DataFrame:
    """query_id of every record so far; none where nothing was written yet."""
    try:
        return batch.read_progress(spark, path).select("query_id")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "query_id string")


def run_batch(specs: DataFrame, number: int, path: str, answered: Callable[[DataFrame], DataFrame]) -> None:
    """Records of one batch. answered: specs to records (query_id, value), as `batch.progress_records` gives them."""
    spark = specs.sparkSession
    once = specs.dropDuplicates(["query_id"])
    pending = stage(batch.pending(once, known_ids(spark, path)), "pending-specs")
    if not pending.isEmpty():
        batch.append_progress(answered(pending), path, number)
    release(pending)


def start(specs: DataFrame, path: str, checkpoint: str, answered: Callable[[DataFrame], DataFrame], **trigger) -> StreamingQuery:
    """Runs a stream of specs; `trigger` is that of the stream, all that is there by default."""
    stream = specs.writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True}))
    return stream.foreachBatch(lambda rows, number: run_batch(rows, number, path, answered)).start()
