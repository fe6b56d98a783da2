"""Batches: generation by an injected function, progress records, and resuming.

Progress is a folder of JSON lines, one for each completed query, with the whole rows:
values, citations, variants, flags, support and provenance. Files are written whole, so a
lost executor leaves no half line; unreadable lines are skipped all the same. Each append
has a number, which its records hold, and the record of the largest number counts.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from queue import Empty, SimpleQueue

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.export import PROVENANCE
from factloom.schema import CITATION
from factloom.session import ship_package

COMPLETION = "query_id string, answer string, model string, truncated boolean, elapsed_s double, error string, attempts int"
ROW = (
    f"struct<row_ord:int,split_ord:int,values:map<string,string>,citations:array<{CITATION}>,flags:array<string>,n_support:bigint,query_ids:array<string>,"
    "provenance:map<string,string>,variants:map<string,array<string>>,standard:map<string,string>>"
)
RECORD = f"query_id string, batch bigint, template_id string, is_table boolean, columns array<string>, answer string, rows array<{ROW}>"
#: How often a call is tried, what the pauses grow by, and how many may be under way in a task; fixed values.
ATTEMPTS, BACKOFF, MOST_AT_ONCE = 4, 1.5, 16
#: Answers that leave a task together, at most: rows, and characters of their texts; fixed values.
OUT_ROWS, OUT_CHARS = 1000, 4_000_000
#: Statuses that may pass; fixed values.
PASSING = frozenset({429, 500, 502, 503, 504})


class CallFailed(Exception):
    """A call that failed, with the service's status where it gave one.

    Without a status the connection failed, which may pass.
    """

    def __init__(self, told: str, status: int | None = None):
        super().__init__(told)
        self.status = status

    @property
    def may_pass(self) -> bool:
        return self.status is None or self.status in PASSING


def _tried(complete: Callable[[str, int], dict], prompt: str, max_tokens: int, attempts: int, pause: float) -> tuple[dict | None, Exception | None, int]:
    """What the call gives, or its last failure, and how often it was made."""
    failed = None
    for attempt in range(1, attempts + 1):
        try:
            return complete(prompt, max_tokens), None, attempt
        except Exception as error:  # noqa: BLE001  whatever the function raises belongs to its row
            failed = error
            if not (isinstance(error, CallFailed) and error.may_pass) or attempt == attempts:
                return None, failed, attempt
            time.sleep(pause * BACKOFF**attempt)
    return None, failed, attempts


def generate(prompts: DataFrame, complete: Callable[[str, int], dict], *, max_tokens: int = 2500, at_once: int = 4, attempts: int = ATTEMPTS, pause: float = 1.0) -> DataFrame:
    """Answers to prompts (query_id, prompt) by complete(prompt, max_tokens).

    It returns a dict with `text` and may add `model`, `finish_reason` and `elapsed_s`. In
    each task up to `at_once` calls (1 to 16) are under way; a new one starts as soon as
    another ends, and rows come in the order in which they end, many in a table. Tasks are
    those of the prompts, so that their number bounds the calls; `spread` them where a scan
    or a small shuffle left few. `CallFailed` with a passing
    status, or none, is tried again after a growing pause; any other exception becomes the
    row's error at once, so one failing query doesn't end the batch.
    """
    if not 1 <= at_once <= MOST_AT_ONCE:
        raise ValueError(f"at_once is from 1 to {MOST_AT_ONCE}")
    ship_package(prompts.sparkSession)
    names = [x.split()[0] for x in COMPLETION.split(", ")]

    def row(query_id: str, said: dict | None, failed: Exception | None, tries: int) -> tuple:
        if failed is not None:
            return query_id, None, None, False, None, f"{type(failed).__name__}: {failed}", tries
        return query_id, said["text"], said.get("model"), said.get("finish_reason") == "length", said.get("elapsed_s"), None, tries

    def answered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked = (pair for batch in batches for pair in zip(batch["query_id"], batch["prompt"], strict=True))
        ended: SimpleQueue = SimpleQueue()

        def call(query_id: str, prompt: str) -> None:
            try:
                ended.put((query_id, *_tried(complete, prompt, max_tokens, attempts, pause)))
            except BaseException as stopped:  # noqa: BLE001  not the row's own: it ends the task
                ended.put(stopped)

        with ThreadPoolExecutor(at_once) as pool:
            running, rows, chars = 0, [], 0
            while True:
                while running < at_once and (pair := next(asked, None)) is not None:
                    pool.submit(call, *pair)
                    running += 1
                if not running:
                    break
                done = [ended.get()]
                try:
                    while True:
                        done.append(ended.get_nowait())
                except Empty:
                    pass
                running -= len(done)
                for one in done:
                    if isinstance(one, BaseException):
                        raise one
                    rows.append(row(*one))
                    chars += len(rows[-1][1] or "")
                # A table for each answer would cost far more than a quick answer itself.
                if len(rows) >= OUT_ROWS or chars >= OUT_CHARS:
                    yield pd.DataFrame(rows, columns=names)
                    rows, chars = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=names)

    return prompts.select("query_id", "prompt").mapInPandas(answered, COMPLETION)


def _earlier(a: Column, b: Column) -> Column:
    place = lambda x: F.struct(x["row_ord"], x["split_ord"])
    return F.when(place(a) < place(b), -1).when(place(a) > place(b), 1).otherwise(0)


def _values(rows: DataFrame, columns: Sequence[str]) -> Column:
    """A row's cells as a map, whether they are one already."""
    return F.create_map(*[x for c in columns for x in (F.lit(c), F.coalesce(F.col("values")[c], F.lit("")))]).cast("map<string,string>")


def whole_rows(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows of any step as what a record keeps of them: query_id and `row`; what a row lacks is empty."""
    have = set(rows.columns)
    cells = {
        "row_ord": F.lit(0), "split_ord": F.lit(0), "citations": F.array(), "flags": F.array(), "n_support": F.lit(1), "query_ids": F.array("query_id"),
        "variants": F.create_map(), "standard": F.create_map(),
    }
    cells = {c: F.col(c) if c in have else v for c, v in cells.items()}
    own = [c for c in PROVENANCE if c in have]
    cells["provenance"] = F.create_map(*[x for c in own for x in (F.lit(c), F.coalesce(F.col(c).cast("string"), F.lit("")))])
    cells["values"] = _values(rows, columns)
    order = [f.split(":")[0] for f in ("row_ord", "split_ord", "values", "citations", "flags", "n_support", "query_ids", "provenance", "variants", "standard")]
    return rows.select("query_id", F.struct(*[cells[c].alias(c) for c in order]).cast(ROW).alias("row"))


def progress_records(rows: DataFrame, runs: DataFrame, columns: Sequence[str], number: int = 0) -> DataFrame:
    """query_id and one JSON text for each query of runs (query_id, template_id, is_table, answer).

    A query's rows are those of one answer, so they are gathered whole.
    """
    own = whole_rows(rows, columns).groupBy("query_id").agg(F.array_sort(F.collect_list("row"), _earlier).alias("rows"))
    joined = runs.join(own, "query_id", "left")
    answer = F.when(F.col("is_table"), "").otherwise(F.coalesce("answer", F.lit("")))
    parts = {
        "query_id": F.col("query_id"), "batch": F.lit(number), "template_id": F.col("template_id"), "is_table": F.col("is_table"),
        "columns": F.array(*map(F.lit, columns)).cast("array<string>"), "answer": answer, "rows": F.coalesce("rows", F.array().cast(f"array<{ROW}>")),
    }
    return joined.select("query_id", F.to_json(F.struct(*[v.alias(k) for k, v in parts.items()])).alias("value"))


def append_progress(records: DataFrame, path: str, number: int = 0) -> None:
    """Writes the records of append `number`; writing a number again replaces it."""
    records.select("value").write.mode("overwrite").text(f"{path}/append={number}")


def parse_progress(lines: DataFrame, order: str) -> DataFrame:
    """Records of JSON texts (column value); the last by batch, then by `order`, counts for each query.

    Texts are shuffled, not what they hold: records as rows of their own are many times as long.
    """
    read = F.from_json("value", RECORD)
    keyed = lines.withColumns({"_id": read["query_id"], "_batch": F.coalesce(read["batch"], F.lit(0))}).filter(F.coalesce("_id", F.lit("")) != "")
    last = keyed.groupBy("_id").agg(F.max_by("value", F.struct("_batch", order)).alias("value"))
    return last.select(read.alias("r")).select("r.*")


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    """Records of a folder; of equal batches later files, and later lines of a file, come last."""
    lines = spark.read.text(path).select("value", F.struct("_metadata.file_modification_time", "_metadata.file_path", F.monotonically_increasing_id()).alias("_at"))
    return parse_progress(lines, "_at")


def restored_rows(records: DataFrame) -> DataFrame:
    """Rows of the table records, as they were; values are a map, provenance is columns."""
    rows = records.filter("is_table").select("query_id", "template_id", F.inline("rows"))
    stamped = [F.try_element_at("provenance", F.lit(c)).alias(c) for c in PROVENANCE]
    return rows.select(*[c for c in rows.columns if c != "provenance"], *stamped)


def restored_template(records: DataFrame) -> DataFrame:
    """One row: the template of all table records, null where they have several."""
    ids = F.collect_set("template_id")
    return records.filter("is_table").agg(F.when(F.size(ids) == 1, F.get(ids, F.lit(0))).alias("template_id"))


def resumed(restored: DataFrame, fresh: DataFrame, specs: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Restored and newly made rows in one form, in the order of the specs, ready to merge."""
    new = whole_rows(fresh, columns).select("query_id", "row.*")
    old = restored.select("query_id", *[c for c in new.columns if c not in ("query_id", "provenance")])
    order = specs.select("query_id", "spec_ord")
    return old.unionByName(new.drop("provenance")).join(order, "query_id")


def pending(specs: DataFrame, records: DataFrame) -> DataFrame:
    return specs.join(records.select("query_id"), "query_id", "left_anti")


def done(specs: DataFrame, records: DataFrame) -> DataFrame:
    return specs.join(records.select("query_id"), "query_id", "left_semi")
