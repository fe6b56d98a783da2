"""WARC archives of pages: written by Spark's text writer, read as a chunked record table.

Writing. Payloads of equal SHA-1 and at least `min_bytes` are stored once: the row with
the smallest page id (null ids last, then the first row) is the response, the others are
revisits that refer to it; the groups are found from digests and ids, without payloads. A
payload above CHUNK_BYTES is written as a first segment and `continuation` records, so no
record in an archive is larger than a chunk. Segments are cut one after the other from the
Arrow buffer that the payload came in, without copying the whole. Every
record is one row of Spark's text writer, whose line separator is the blank line that ends
a WARC record; the archives are gzip-compressed and committed by Spark like any table, on
any file system.

Reading. Each archive is read by one task as a stream of pieces. A parser that follows
Content-Length turns it into rows of (record identifier, chunk number, payload part, bytes
so far, running digest) of at most CHUNK_BYTES, however large the record is; the digest is
carried from chunk to chunk and no record is ever held whole. Reports that need no payload
read the table without that column. The last chunk's row has the payload's length and digest, which must equal the one
in the record's header.

Edge cases: null payloads are empty, null URLs are `about:blank`, line breaks in URLs are
escaped; null ids are kept by leaving the identifier's header out; repeated rows are
separate records; an empty table makes an empty archive and no rows; other columns of the
input are not archived.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.session import remove_at_exit, ship_package, stage, staging_dir

CHUNK_BYTES = 1 << 20
DATE = "2024-01-01T00:00:00Z"
EOL = "\r\n"
END = EOL + EOL
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CHUNKS = (
    "record_id string, page_id bigint, record_type string, refers_to string, url string, chunk int, "
    "bytes bigint, bytes_so_far bigint, digest_so_far string, header_digest string, last boolean, payload binary"
)


def base32(hexadecimal: Column) -> Column:
    """Base32 of a hexadecimal string of 40 digits, as SHA-1 gives it."""
    def letters(i: int) -> list[Column]:
        bits = F.conv(F.substring(hexadecimal, 5 * i + 1, 5), 16, 10).cast("int")
        return [F.substring(F.lit(_ALPHABET), F.shiftright(bits, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]

    return F.concat(*[x for i in range(8) for x in letters(i)])


def _rows(pages: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    return pages.select(
        F.col(id_col).alias("_id"),
        F.regexp_replace(F.regexp_replace(F.coalesce(F.col(url_col), F.lit("about:blank")), "\r", "%0D"), "\n", "%0A").alias("_url"),
        payload.alias("_payload"),
        F.sha1(F.encode(payload, "UTF-8")).alias("_sha"),
        F.octet_length(payload).cast("bigint").alias("_bytes"),
        F.monotonically_increasing_id().alias("_row"),
    )


def _urn(row: Column) -> Column:
    """A record identifier that depends on the row id alone."""
    h = F.md5(F.concat(F.lit("factloom-record-"), row.cast("string")))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def segment_ends(payload: memoryview, size: int) -> Iterator[int]:
    """Ends of parts of at most `size` bytes (at least 4), none inside a UTF-8 character."""
    at, whole = 0, len(payload)
    while whole - at > size:
        at += size
        while payload[at] & 0xC0 == 0x80:
            at -= 1
        yield at
    yield whole


def segments(row: dict, payload: memoryview, size: int) -> Iterator[bytes]:
    """The WARC records of one page: a whole one, or a first segment and its continuations."""
    ends = [0] if row["_revisit"] else segment_ends(payload, size)
    start, last = 0, 0 if row["_revisit"] else len(payload)
    for k, end in enumerate(ends):
        whole, final = not k and end == last, end == last
        kind = "revisit" if row["_revisit"] else "continuation" if k else "response"
        fields = [("WARC-Type", kind), ("WARC-Record-ID", segment_urn(row["_row"], k) if k else row["_urn"]), ("WARC-Date", DATE), ("WARC-Target-URI", row["_url"])]
        if not k and row["_id"] is not None:
            fields.append(("Page-ID", row["_id"]))
        fields.append(("WARC-Payload-Digest", "sha1:" + row["_digest"]))
        if row["_revisit"]:
            fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", row["_refers"])]
        if not whole:
            fields.append(("WARC-Segment-Number", k + 1))
        if k:
            fields.append(("WARC-Segment-Origin-ID", row["_urn"]))
        if final and not whole:
            fields.append(("WARC-Segment-Total-Length", row["_bytes"]))
        fields += [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", end - start)]
        head = EOL.join(["WARC/1.1", *(f"{name}: {value}" for name, value in fields)]) + END
        yield b"".join((head.encode("utf-8"), payload[start:end]))
        start = end


def segment_urn(row: int, k: int) -> str:
    h = hashlib.md5(f"factloom-record-{row}-{k}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def record_texts(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row `value` per WARC record or segment, in the order it is to be written."""
    ship_package(pages.sparkSession)
    rows = stage(_rows(pages, id_col, url_col, payload_col), "warc-rows")
    first = F.min(F.struct(F.col("_id").isNull().alias("unnamed"), F.col("_id").alias("id"), F.col("_row").alias("row")))
    groups = (
        rows.filter(F.col("_bytes") >= min_bytes).groupBy("_sha").agg(first.alias("_first"), F.count("*").alias("_n")).filter("_n > 1")
    )
    # Only digests that several rows share; Spark broadcasts them below its threshold and
    # otherwise joins by digest, splitting hot digests.
    groups = stage(groups, "warc-groups")
    rows = rows.join(groups, "_sha", "left")
    revisit = F.col("_first.row").isNotNull() & (F.col("_first.row") != F.col("_row")) & (F.col("_bytes") >= min_bytes)
    told = rows.select(
        F.col("_id").cast("string").alias("_id"), "_url", "_row", "_bytes", base32(F.col("_sha")).alias("_digest"),
        _urn(F.col("_row")).alias("_urn"), _urn(F.col("_first.row")).alias("_refers"), revisit.alias("_revisit"), "_payload",
    ).withColumn("_payload", F.when(~F.col("_revisit"), F.col("_payload")))
    names = [c for c in told.columns if c != "_payload"]
    flush_at = 4 * chunk_bytes

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fields = {c: batch.column(c).to_pylist() for c in names}
            payloads, ready, size = batch.column("_payload"), [], 0
            for i in range(batch.num_rows):
                held = payloads[i].as_buffer()
                for record in segments({c: fields[c][i] for c in names}, memoryview(held or b""), chunk_bytes):
                    ready.append(record)
                    size += len(record)
                    if size >= flush_at:
                        yield pa.RecordBatch.from_arrays([pa.array(ready, pa.binary()).cast(pa.string())], names=["value"])
                        ready, size = [], 0
            if ready:
                yield pa.RecordBatch.from_arrays([pa.array(ready, pa.binary()).cast(pa.string())], names=["value"])

    return told.mapInArrow(write, "value string")


def write_archives(pages: DataFrame, path: str, **options) -> None:
    """Gzip-compressed archives under `path`, one for each task."""
    record_texts(pages, **options).write.option("lineSep", END).option("compression", "gzip").text(path)


class Parser:
    """Rows of the chunk table from a stream of bytes; holds no more than a header and a chunk."""

    def __init__(self, payload: bool = True, size: int = CHUNK_BYTES) -> None:
        self.size, self.part = size, bytearray() if payload else None
        self.head = bytearray()
        self.left = self.tail = 0
        self.now: dict | None = None
        self.digest, self.bytes, self.own, self.chunk = hashlib.sha1(), 0, 0, -1

    def feed(self, data: bytes) -> Iterator[tuple]:
        view = memoryview(data)
        while len(view):
            if self.now is not None and self.left:
                part = view[: min(self.left, self.size - self.own)]
                self.digest.update(part)
                if self.part is not None:
                    self.part += part
                self.bytes += len(part)
                self.own += len(part)
                self.left -= len(part)
                view = view[len(part) :]
                if not self.left or self.own == self.size:
                    yield self._row()
            elif self.tail:
                n = min(self.tail, len(view))
                self.tail -= n
                view = view[n:]
            else:
                known = len(self.head)
                self.head += view
                at = self.head.find(b"\r\n\r\n", max(0, known - 3))
                if at < 0:
                    return
                view = view[at + 4 - known :]
                self._start(bytes(self.head[:at]).decode("utf-8"))
                self.head = bytearray()
                if not self.left:
                    yield self._row()

    def _start(self, text: str) -> None:
        version, *lines = text.split("\r\n")
        if version != "WARC/1.1":
            raise ValueError(f"not a WARC record: {version[:40]!r}")
        fields = dict(line.split(": ", 1) for line in lines)
        self.left = int(fields["Content-Length"])
        if fields["WARC-Type"] == "continuation":
            if self.now is None or self.now["WARC-Record-ID"] != fields["WARC-Segment-Origin-ID"]:
                raise ValueError("a segment without its first record")
            self.segment = fields
        else:
            self.now, self.segment, self.chunk = fields, fields, -1
            self.digest, self.bytes = hashlib.sha1(), 0

    def _row(self) -> tuple:
        self.tail = 0 if self.left else 4
        self.chunk += 1
        own, self.own = self.own, 0
        held = None if self.part is None else bytes(self.part)
        if held:
            self.part = bytearray()
        said = self.now
        more = "WARC-Segment-Number" in self.segment and "WARC-Segment-Total-Length" not in self.segment
        page = said.get("Page-ID")
        return (
            said["WARC-Record-ID"], None if page is None else int(page), said["WARC-Type"], said.get("WARC-Refers-To"),
            said["WARC-Target-URI"], self.chunk, own, self.bytes, base64.b32encode(self.digest.digest()).decode(),
            said["WARC-Payload-Digest"].removeprefix("sha1:"), not more and not self.left, held,
        )


def read_chunks(spark: SparkSession, path: str, *, payload: bool = True, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunk table of the archives under a path; with payload False that column is null."""
    ship_package(spark)
    types = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    schema = pa.schema([(name, types[kind]) for name, kind in (x.split() for x in CHUNKS.split(", "))])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser, end, rows, size = Parser(payload, chunk_bytes), END.encode(), [], 0

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

        for batch in batches:
            for piece in batch.column(0):
                for data in (memoryview(piece.as_buffer()), end):
                    for row in parser.feed(data):
                        rows.append(row)
                        size += len(row[-1] or b"") + 256
                        if size >= 4 * chunk_bytes:
                            yield made()
                            rows, size = [], 0
            if rows:
                yield made()
                rows, size = [], 0

    return spark.read.option("lineSep", END).text(path).mapInArrow(parse, CHUNKS)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per page: its type, the payload's length and digest, and what it revisits.

    A response whose payload doesn't have the digest of its header fails the job.
    """
    chunks = read_chunks(spark, path, payload=False).drop("payload").filter("last")
    sound = F.when(
        (F.col("record_type") == "response") & (F.col("digest_so_far") != F.col("header_digest")),
        F.raise_error(F.concat(F.lit("payload differs from its digest: "), F.col("record_id"))),
    ).otherwise(F.col("header_digest"))
    records = stage(chunks.withColumn("payload_digest", sound), "warc-read")
    responses = records.filter("record_type = 'response'")
    revisits = records.filter("record_type = 'revisit'")
    originals = responses.select(
        F.col("record_id").alias("refers_to"), F.col("page_id").alias("_original"), F.col("bytes_so_far").alias("_bytes"), F.col("payload_digest").alias("_digest")
    )
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    first = responses.select("page_id", F.col("bytes_so_far").alias("payload_bytes"), "payload_digest", "record_type", F.lit(None).cast("bigint").alias("refers_to"))
    again = revisits.join(originals, "refers_to").select(
        "page_id", F.col("_bytes").alias("payload_bytes"), F.col("_digest").alias("payload_digest"), "record_type", F.col("_original").alias("refers_to")
    )
    return first.unionByName(again).select(*columns)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Writes the archives into the shared folder and reads them back."""
    spark = pages.sparkSession
    path = f"{staging_dir(spark)}/warc-{uuid.uuid4().hex}"
    remove_at_exit(spark, path)
    write_archives(pages, path, **options)
    return read_records(spark, path)
