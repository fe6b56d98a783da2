"""Token counts and ids of whole texts for a byte-level BPE vocabulary file.

The vocabulary file is that of the `tokenizers` library; its path is a parameter. Counts come
from that library's batch encoding, of which only the lengths leave the Arrow function.
Where ids are wanted (`Encoder.ids`, for packing), texts whose characters all lie below
U+0250 are encoded by `tiktoken` from the same vocabulary (the same pre-tokenisation
pattern, merge ranks equal to ids), which is faster and gives the same ids there; any
other text, and any other kind of file, goes through `tokenizers` itself.

Batches are balanced by UTF-8 bytes (BATCH_BYTES), and texts above SPLIT_CHARS are cut where the
pattern always cuts: before a single space between two characters that aren't white space.
The counts of the parts add up to the count of the whole; a text without such a place
stays whole.

Edge cases: null and empty texts have 0 tokens; special strings inside texts become the
file's special tokens, as the library does by default; ties and repeated rows don't
matter; empty tables give empty results; other columns pass through.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.session import ship_package

SPLIT_CHARS = 1 << 16
BATCH_BYTES = 1 << 20
#: The pre-tokenisation pattern of byte-level BPE files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SAFE = re.compile(r"(?<=\S) (?=\S)")
_WIDE = re.compile("[^\x00-ɏ]")


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Where the public tokenizer files of this machine are."""
    import public_tokenizers

    return public_tokenizers.path(name)


def split_safely(text: str, limit: int = SPLIT_CHARS) -> list[str]:
    """Parts of about `limit` characters whose tokens add up to those of the text."""
    if len(text) <= limit:
        return [text]
    parts, start = [], 0
    while len(text) - start > limit:
        cut = _SAFE.search(text, start + limit)
        if cut is None:
            break
        parts.append(text[start : cut.start()])
        start = cut.start()
    parts.append(text[start:])
    return parts


def _byte_of() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids of texts under one vocabulary file."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.fast = self._fast(path)

    @staticmethod
    def _fast(path: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        steps, model = said.get("pre_tokenizer") or {}, said.get("model", {})
        plain = steps.get("type") == "ByteLevel" and not steps.get("add_prefix_space") and not said.get("normalizer")
        if not plain or model.get("type") != "BPE" or model.get("dropout") or model.get("ignore_merges"):
            return None
        special = {x["content"]: x["id"] for x in said.get("added_tokens", [])}
        if any(x.get(k) for x in said.get("added_tokens", []) for k in ("lstrip", "rstrip", "single_word", "normalized")):
            return None
        # tiktoken merges by id, so merges must make tokens in the order of their ids.
        pairs = [x.split(" ") if isinstance(x, str) else x for x in model.get("merges", [])]
        made = [model["vocab"].get("".join(x), -1) for x in pairs]
        if made != sorted(set(made)) or made[:1] == [-1]:
            return None
        byte = _byte_of()
        ranks = {bytes(byte[c] for c in word): i for word, i in model["vocab"].items() if word not in special}
        return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def ids(self, text: str) -> np.ndarray:
        """All ids of a text, as unsigned 32-bit numbers."""
        found = [self._part(x) for x in split_safely(text)]
        return found[0] if len(found) == 1 else np.concatenate(found)

    def _part(self, text: str) -> np.ndarray:
        if self.fast is not None and not _WIDE.search(text):
            return self.fast.encode_to_numpy(text, allowed_special="all")
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)

    def counts(self, texts: list[str]) -> np.ndarray:
        """Lengths only, by batches of even bytes."""
        out = np.zeros(len(texts), np.int64)
        batch, owners, size = [], [], 0

        def run() -> None:
            found = self.whole.encode_batch_fast(batch, add_special_tokens=False)
            np.add.at(out, owners, [len(x) for x in found])
            batch.clear()
            owners.clear()

        for i, text in enumerate(texts):
            for part in split_safely(text):
                batch.append(part)
                owners.append(i)
                size += len(part) if part.isascii() else len(part.encode("utf-8"))
                if size >= BATCH_BYTES:
                    run()
                    size = 0
        if batch:
            run()
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def count_tokens(df: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """Adds n_bytes (UTF-8) and n_tokens."""
    ship_package(df.sparkSession)

    @F.pandas_udf("bigint")
    def lengths(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = encoder(path)
        for texts in batches:
            yield pd.Series(own.counts(["" if x is None else x for x in texts]))

    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.withColumns({"n_bytes": F.octet_length(text).cast("bigint"), "n_tokens": lengths(F.col(text_col))})
