"""The smallest tables with awkward rows added."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.parquet as pq

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "pages", "benchmark", "labels", "embeddings", "conversations")
#: Names that the operators might use themselves.
CLASHING = ("_row", "_key", "_part", "shard", "piece", "grade", "fp", "rule", "n_words", "payload")


def awkward(root) -> str:
    long = "alpha beta gamma " * 60_000
    texts = {
        9_000_000: None, 9_000_001: "", 9_000_002: " \t\n\x0b\x0c\r", 9_000_003: "The same text, twice over.", 9_000_004: "The  same text,\ttwice over. ",
        9_000_005: long, 9_000_006: "x" * 50_000, 9_000_007: "JANE@EXAMPLE.COM 10.0.0.1 4111 1111 1111 1111 +44 20 7946 0958", 9_000_008: "ÀÉ İ ß 中文 \U0001f600",
        9_000_009: "<|endoftext|> and more", 9_000_010: "word", 9_000_011: "two words", 9_000_012: "",
    }
    for name in TABLES:
        rows = pq.read_table(f"{SF}/{name}.parquet")
        made = []
        if name == "documents":
            made = [{"doc_id": k, "text": v, "lang": None, "source": None, "n_chars": None} for k, v in texts.items()]
        elif name == "pages":
            html = [None, "", "<p>" + "y" * 3_000_000 + "</p>", "same", "same"]
            urls = [None, "no host", "HTTP://A.Example.NET/en/x?y#z", "https://example.com/de/", "https://x.org/fr/casino"]
            made = [{"page_id": 9_000_000 + i, "url": u, "html": h} for i, (u, h) in enumerate(zip(urls, html, strict=True))]
        elif name == "benchmark":
            made = [{"item_id": 9_000_000, "text": None}, {"item_id": 9_000_001, "text": ""}, {"item_id": 9_000_002, "text": "gamma alpha beta"}]
        elif name == "labels":
            made = [{"doc_id": None, "quality": None, "toxic": None}, {"doc_id": 9_000_001, "quality": 1, "toxic": None}]
        if made:
            rows = pa.concat_tables([rows, pa.Table.from_pylist(made, rows.schema)])
        for extra in CLASHING:
            if extra not in rows.column_names:
                rows = rows.append_column(extra, pa.array(["own"] * len(rows)))
        pq.write_table(rows, root / f"{name}.parquet")
    return str(root)
