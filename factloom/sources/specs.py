"""Query specifications from TSV, CSV, JSON and YAML files, and from DataFrames."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.session import ship_package, stage

#: Header names, lower-cased with underscores, and the field each stands for; fixed values.
ALIASES = {
    "organism": "organism", "species": "organism", "pathogen": "organism",
    "genes": "genes", "gene": "genes", "gene_name": "genes", "gene_names": "genes",
    "other_terms": "other_terms", "other": "other_terms", "terms": "other_terms", "keywords": "other_terms",
    "data_type": "data_type", "type": "data_type", "datatype": "data_type", "template": "data_type",
    "top_k": "top_k", "topk": "top_k", "k": "top_k", "collection": "collection", "query_id": "query_id", "id": "query_id",
}
FIELDS = ("organism", "genes", "other_terms", "data_type", "top_k", "collection", "query_id")
DEFAULTS = {"data_type": "literature-summary", "top_k": 10, "collection": None}
TOP_K = (1, 100)


class SpecError(ValueError):
    """A batch file that can't be used; the message names the first bad rows."""


def query_hash(parts: Sequence[Column]) -> Column:
    """First 12 hex digits of the SHA-256 of the parts joined by pipes; nulls are empty."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, 12)


def with_identity(specs: DataFrame, backend: str = "server", instructions: str = "") -> DataFrame:
    """query_id is kept where given, otherwise the hash of what is asked; run_hash also
    covers how it is run."""
    asked = [F.col(c) for c in ("organism", "genes", "other_terms", "data_type", "top_k", "collection")]
    asked += [F.lit(backend), F.lit(instructions)]
    own = F.when(F.trim(F.coalesce("query_id", F.lit(""))) != "", F.trim("query_id"))
    how = [F.col(c) for c in ("retrieval_mode", "keep_empty") if c in specs.columns]
    return specs.withColumns({"query_id": F.coalesce(own, query_hash(asked)), "run_hash": query_hash([*asked, *how])})


def normalised(raw: DataFrame, defaults: dict | None = None, *, ordered: bool = True, keep: Sequence[str] = ()) -> DataFrame:
    """Aliased columns only; blanks and unusable top_k take the defaults. ordered: with the rows' order, which a stream hasn't."""
    defaults = DEFAULTS | (defaults or {})
    found: dict[str, list[str]] = {}
    for name in raw.columns:
        field = ALIASES.get(name.strip().lower().replace(" ", "_"))
        if field:
            found.setdefault(field, []).append(name)
    # Rows may use different names of a field; the last one counts.
    text = lambda f: F.trim(F.coalesce(*[F.col(f"`{name}`").cast("string") for name in reversed(found.get(f, []))], F.lit("")))
    filled = lambda f: F.coalesce(F.when(text(f) != "", text(f)), F.lit(defaults[f]).cast("string"))
    return raw.select(
        *([F.monotonically_increasing_id().alias("spec_ord")] if ordered else []),
        text("organism").alias("organism"),
        text("genes").alias("genes"),
        text("other_terms").alias("other_terms"),
        filled("data_type").alias("data_type"),
        F.coalesce(text("top_k").try_cast("int"), F.lit(defaults["top_k"])).alias("top_k"),
        filled("collection").alias("collection"),
        text("query_id").alias("query_id"),
        *keep,
    )


def _fault() -> Column:
    """What keeps a spec from being run, or null."""
    return F.when(F.col("organism") == "", F.lit("no organism")).when(
        ~F.col("top_k").between(*TOP_K), F.concat(F.lit("top_k is not between 1 and 100: "), F.col("top_k").cast("string"))
    )


def invalid(specs: DataFrame) -> DataFrame:
    """spec_ord and error of the rows that can't be run."""
    return specs.withColumn("error", _fault()).filter("error IS NOT NULL").select("spec_ord", "error")


ROWS = "file string, row int, " + ", ".join(f"{f} string" for f in FIELDS) + ", error string"


def _field(name: object) -> str | None:
    return ALIASES.get(str(name).strip().lower().replace(" ", "_"))


def _records(name: str, data: bytes) -> Iterator[object]:
    """The records of one file, by its ending; the delimiter of a table is the expected one only where its header has it."""
    kind, text = name.rsplit(".", 1)[-1].lower(), data.decode("utf-8-sig")
    if kind in ("json", "yaml", "yml"):
        said = json.loads(text) if kind == "json" else _yaml(text)
        rows = said.get("queries", said) if isinstance(said, dict) else said
        if not isinstance(rows, list):
            raise SpecError("expected a list of query rows")
        yield from rows
    elif kind == "jsonl":
        for line in filter(str.strip, text.splitlines()):
            try:
                yield json.loads(line)
            except ValueError:
                yield line
    else:
        head, expected = text.split("\n", 1)[0], "," if kind == "csv" else "\t"
        yield from csv.DictReader(io.StringIO(text, newline=""), delimiter=expected if expected in head else "," if "," in head else "\t")


def parse_file(name: str, data: bytes) -> list[tuple]:
    """A file's rows under ROWS; what can't be read is a row with its error."""
    out, blank = [], [None] * len(FIELDS)
    try:
        for number, record in enumerate(_records(name, data), 1):
            if not isinstance(record, dict):
                out.append((name, number, *blank, "not a mapping"))
                continue
            # Of several names of a field the last one counts.
            found = {f: v for k, v in record.items() if k is not None and (f := _field(k))}
            out.append((name, number, *[None if found.get(f) is None else str(found[f]) for f in FIELDS], None))
    except Exception as unreadable:  # noqa: BLE001  whatever is wrong with a file belongs to it
        out.append((name, 0, *blank, f"unreadable: {unreadable}"))
    return out


def read_specs(spark: SparkSession, path: str | Sequence[str], defaults: dict | None = None) -> DataFrame:
    """Specs of all files of a path, in the order of files and rows, each with its file, row and `error`.

    Files come through Spark's reader, from any of its stores, and each is parsed by a task
    of its own; TSV, CSV, JSON, JSON lines, YAML, and text tables of either delimiter. They
    are what people write for a batch; specs in large tables go through `normalised`.
    """
    ship_package(spark)

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in ROWS.split(", ")]
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"], strict=True):
                yield pd.DataFrame(parse_file(name, bytes(data)), columns=names, dtype=object)

    files = spark.read.format("binaryFile").load(list(path) if not isinstance(path, str) else path).select("path", "content")
    rows = stage(files.mapInPandas(parsed, ROWS), "spec-rows")
    sizes = rows.groupBy("file").agg(F.count("*").alias("_n"))
    # One row for each file.
    first = sizes.select(F.col("file").alias("_file"), (F.sum("_n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))).alias("_first"))
    placed = rows.join(first, F.col("file") == F.col("_file"))
    own = normalised(placed, defaults, ordered=False, keep=("file", "row", "error", "_first"))
    ordered = own.withColumn("spec_ord", (F.coalesce("_first", F.lit(0)) + F.greatest(F.lit(0), F.col("row") - 1)).cast("bigint")).drop("_first")
    return with_identity(ordered.withColumn("error", F.coalesce("error", _fault())))


def load_specs(spark: SparkSession, path: str, defaults: dict | None = None, *, check: bool = True) -> DataFrame:
    """Specs of a file; an error names its first bad rows."""
    specs = read_specs(spark, path, defaults)
    bad = specs.filter("error IS NOT NULL")
    if check and (first := bad.orderBy("spec_ord").limit(5).collect()):
        raise SpecError(f"{path}: " + "; ".join(f"row {r.row}: {r.error}" for r in first))
    return specs.drop("file", "row", "error")


def _yaml(text: str) -> object:
    try:
        import yaml
    except ImportError as missing:
        raise SpecError("reading YAML needs the yaml library") from missing
    return yaml.safe_load(text)
