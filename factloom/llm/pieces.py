"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

Only the model file is read through the library; texts are encoded here. White space
becomes the piece sign, and since no piece of the model joins another character to a
following sign (checked at load), a text's words (signs and what follows them) are merged
independently. Words that a task has seen keep their ids in a table of bounded size; the
others of a batch are laid out as one flat array of symbols and merged together. A round
takes each word's smallest pair rank (a segmented minimum), merges its occurrences at once
from the left, and drops the symbols that were merged; finished words leave the array,
until no pair remains. Characters outside the vocabulary become the ids of their bytes.

Merging all occurrences at once equals the library's order, smallest rank first and ties
leftmost, unless the merged piece can join a neighbour at the same or a smaller rank; words
with such a piece merge only their leftmost occurrence in that round. Words of over
LONGEST symbols are cut where no piece holds the two characters side by side; what is
still longer is merged pair by pair from a heap, so the time is n log n, not rounds times n.

Edge cases: null and empty texts have no ids; whole texts are encoded, however long; ties
and repeated rows don't matter; empty tables give empty results; the result's column
replaces one of its name, all others pass through. Decoding: a null array gives null, ids
outside the vocabulary and null ids are read as unknown, invalid bytes become U+FFFD one
by one, as in the library.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.session import ship_package

SIGN = "▁"
#: Symbols of a word that the rounds take.
LONGEST = 512
#: Words that a task remembers, and characters that are laid out together.
REMEMBERED, GROUP_CHARS = 1 << 18, 1 << 20
#: Places of the table of pairs.
TABLE = 1 << 20
_NONE = np.int32(1 << 30)
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6  # the model format's kinds of pieces


class _Seen(dict):
    """Numbers of words; new ones are listed until they are encoded."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.new.append(word)
        return number


def _flattened(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places of consecutive slices, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


class PieceModel:
    """Ids of texts, and texts of ids, under one BPE model file with byte fallback."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        said = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            said.ParseFromString(file.read())
        rules, trained = said.normalizer_spec, said.trainer_spec
        fits = trained.model_type == 2 and trained.byte_fallback and not trained.treat_whitespace_as_suffix
        plain = not rules.precompiled_charsmap and rules.add_dummy_prefix and rules.escape_whitespaces and not rules.remove_extra_whitespaces
        kinds = np.array([p.type for p in said.pieces])
        if not (fits and plain and np.isin(kinds, (_NORMAL, _UNKNOWN, _CONTROL, _BYTE)).all()):
            raise ValueError(f"{path}: only BPE models with byte fallback, a prefix sign and texts as they are")
        self.unknown = trained.unk_surface
        self._read([p.piece for p in said.pieces], kinds, np.array([p.score for p in said.pieces]))
        self.forget()

    def _read(self, names: list[str], kinds: np.ndarray, scores: np.ndarray) -> None:
        self.names, self.kinds = names, kinds
        ids = {names[i]: int(i) for i in np.flatnonzero(kinds == _NORMAL)}
        if any(re.search(f"[^{SIGN}]{SIGN}", x) for x in ids) or not set("".join(ids)) <= ids.keys():
            raise ValueError("pieces must not join words, and their characters must be pieces")
        self.byte_ids = np.array([names.index(f"<0x{b:02X}>") for b in range(256)], np.int32)
        self.rank = np.unique(-scores, return_inverse=True)[1].astype(np.int32)
        self.of_char = np.full(0x110000, -1, np.int32)
        for piece, i in ids.items():
            if len(piece) == 1:
                self.of_char[ord(piece)] = i
        self.size = len(names)
        joins = sorted((ids[x[:k]] * self.size + ids[x[k:]], i) for x, i in ids.items() for k in range(1, len(x)) if x[:k] in ids and x[k:] in ids)
        self._hash(np.array([k for k, _ in joins], np.int64), np.array([i for _, i in joins], np.int32))
        # Pieces that may join a neighbour at no larger a rank than their own.
        self.eager = np.zeros(self.size, bool)
        for key, i in joins:
            for side in divmod(key, self.size):
                self.eager[side] |= len(names[side]) > 1 and self.rank[i] <= self.rank[side]
        self.side_by_side = {x[k : k + 2] for x in ids for k in range(len(x) - 1)}
        self.words = re.compile(f"{SIGN}+[^{SIGN}]*|[^{SIGN}]+")
        # What each id is in a decoded text.
        self.shown = [x.replace(SIGN, " ") for x in names]
        for i, kind in enumerate(kinds):
            if kind != _NORMAL:
                self.shown[i] = self.unknown if kind == _UNKNOWN else ""
        self.byte_of = np.full(self.size, -1, np.int16)
        self.byte_of[self.byte_ids] = np.arange(256)

    def _hash(self, keys: np.ndarray, ids: np.ndarray) -> None:
        """Pairs in an open table."""
        self.table_keys, self.table_ids = np.full(TABLE, -1, np.int64), np.full(TABLE, -1, np.int32)
        at = self._slot(keys)
        while len(keys):
            free = self.table_keys[at] < 0
            placed = np.zeros(len(keys), bool)
            placed[np.flatnonzero(free)[np.unique(at[free], return_index=True)[1]]] = True
            self.table_keys[at[placed]], self.table_ids[at[placed]] = keys[placed], ids[placed]
            keys, ids, at = keys[~placed], ids[~placed], (at[~placed] + 1) % TABLE

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - TABLE.bit_length() + 1)).astype(np.int64)

    def forget(self) -> None:
        self.seen, self.starts, self.lengths, self.flat = _Seen(), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    # Encoding

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts."""
        return list(self.encoded(texts))

    def encoded(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """The same, a group of texts at a time."""
        group, size = [], 0
        for text in texts:
            group.append(text)
            size += len(text)
            if size >= GROUP_CHARS:
                yield from self._group(group)
                group, size = [], 0
        yield from self._group(group)

    def _group(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.seen) > REMEMBERED:
            self.forget()
        words, counts = [], []
        for text in texts:
            found = self.words.findall(SIGN + text.replace(" ", SIGN)) if text else []
            words += found
            counts.append(len(found))
        numbers = np.fromiter(map(self.seen.__getitem__, words), np.int64, len(words))
        if self.seen.new:
            flat, lengths = self.merge(self.seen.new)
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lengths) - lengths])
            self.lengths = np.concatenate([self.lengths, lengths])
            self.flat = np.concatenate([self.flat, flat])
            self.seen.new = []
        lengths = self.lengths[numbers]
        ids = self.flat[_flattened(self.starts[numbers], lengths)]
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum(counts, dtype=np.int64)]
        return np.split(ids, ends[:-1]) if texts else []

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and how many each has."""
        parts, owners = [], []
        for i, word in enumerate(words):
            own = [word] if len(word) <= LONGEST else self._cut(word)
            parts += own
            owners += [i] * len(own)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        points = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32).astype(np.int64)
        # Characters without a piece are negative until they become bytes.
        symbols = self.of_char[points]
        symbols = np.where(symbols < 0, -1 - points, symbols).astype(np.int32)
        segment = np.repeat(np.arange(len(parts)), sizes)
        short = sizes[segment] <= LONGEST
        done = [self._rounds(symbols[short], segment[short])]
        for i in np.flatnonzero(sizes > LONGEST):
            ids = self._from_heap(symbols[segment == i].tolist())
            done.append((np.array(ids, np.int32), np.full(len(ids), i)))
        ids, segment = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(segment, kind="stable")
        ids, owner = self._with_bytes(ids[order], np.array(owners, np.int64)[segment[order]])
        return ids, np.bincount(owner, minlength=len(words)).astype(np.int64)

    def _cut(self, word: str) -> list[str]:
        """Parts that no piece spans."""
        places = [k + 1 for k in range(len(word) - 1) if word[k : k + 2] not in self.side_by_side]
        return [word[a:b] for a, b in zip([0, *places], [*places, len(word)], strict=True)]

    def _joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece of each pair, or -1."""
        keys = np.where((left >= 0) & (right >= 0), left.astype(np.int64) * self.size + right, -2)
        at = self._slot(keys)
        held = self.table_keys[at]
        made = np.where(held == keys, self.table_ids[at], np.int32(-1))
        left = np.flatnonzero((held != keys) & (held >= 0))
        at = at[left]
        while len(left):
            at = (at + 1) % TABLE
            held = self.table_keys[at]
            made[left[held == keys[left]]] = self.table_ids[at[held == keys[left]]]
            more = (held != keys[left]) & (held >= 0)
            left, at = left[more], at[more]
        return made

    def _pairs(self, symbols: np.ndarray, segment: np.ndarray, at: np.ndarray) -> np.ndarray:
        """What the symbols at these places make with the next one of their word, or -1."""
        nxt = np.minimum(at + 1, len(symbols) - 1)
        inside = (nxt > at) & (segment[nxt] == segment[at])
        return np.where(inside, self._joined(symbols[at], symbols[nxt]), -1)

    def _rounds(self, symbols: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges the words (runs of equal segment) until no pair remains."""
        done_ids, done_segments = [symbols[:0]], [segment[:0]]
        made = self._pairs(symbols, segment, np.arange(len(symbols)))
        while len(symbols):
            rank = np.where(made >= 0, self.rank[made], _NONE)
            first = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
            size = np.diff(np.append(first, len(symbols)))
            lowest = np.minimum.reduceat(rank, first)
            over = np.repeat(lowest == _NONE, size)
            if over.any():
                done_ids.append(symbols[over])
                done_segments.append(segment[over])
                kept = ~over
                symbols, segment, made, rank = symbols[kept], segment[kept], made[kept], rank[kept]
                if not len(symbols):
                    break
                size, lowest = size[lowest < _NONE], lowest[lowest < _NONE]
            word = np.repeat(np.arange(len(size)), size)
            at = np.flatnonzero(rank == lowest[word])
            fresh = np.concatenate([[True], word[at][1:] != word[at][:-1]])
            alone = np.zeros(len(size), bool)
            alone[word[at][self.eager[made[at]]]] = True
            at = at[fresh | ~alone[word[at]]]
            # Of occurrences that overlap, every second one from the left.
            run = np.flatnonzero(np.concatenate([[True], np.diff(at) != 1]))
            at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2 == 0]
            symbols[at] = made[at]
            kept = np.ones(len(symbols), bool)
            kept[at + 1] = False
            changed = np.zeros(len(symbols), bool)
            changed[at] = True
            symbols, segment, made, changed = symbols[kept], segment[kept], made[kept], changed[kept]
            changed[:-1] |= changed[1:]
            at = np.flatnonzero(changed)
            made[at] = self._pairs(symbols, segment, at)
        return np.concatenate(done_ids), np.concatenate(done_segments)

    def _from_heap(self, symbols: list[int]) -> list[int]:
        """The same for one long word, pair by pair."""
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        row = np.array(symbols, np.int32)
        first = self._joined(row[:-1], row[1:]).tolist()
        heap = [(int(self.rank[p]), i, symbols[i], symbols[i + 1], p) for i, p in enumerate(first) if p >= 0]
        heapq.heapify(heap)
        held = self.table_keys >= 0
        joins = dict(zip(self.table_keys[held].tolist(), self.table_ids[held].tolist(), strict=True))

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < n and min(symbols[i], symbols[j]) >= 0 and (p := joins.get(symbols[i] * self.size + symbols[j])) is not None:
                heapq.heappush(heap, (int(self.rank[p]), i, symbols[i], symbols[j], p))

        gone = [False] * n
        while heap:
            _, i, a, b, piece = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j >= n or symbols[i] != a or symbols[j] != b:
                continue
            symbols[i], gone[j], after[i] = piece, True, after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [x for x, lost in zip(symbols, gone, strict=True) if not lost]

    def _with_bytes(self, ids: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece as their UTF-8 bytes."""
        odd = np.flatnonzero(ids < 0)
        if not len(odd):
            return ids, owner
        spelled = [chr(-1 - int(x)).encode("utf-8", "replace") for x in ids[odd]]
        times = np.ones(len(ids), np.int64)
        times[odd] = [len(x) for x in spelled]
        where = np.repeat(ids < 0, times)
        ids, owner = np.repeat(ids, times), np.repeat(owner, times)
        ids[where] = self.byte_ids[np.frombuffer(b"".join(spelled), np.uint8)]
        return ids, owner

    # Decoding

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; the sign that encoding put first goes."""
        ids = np.where((ids >= 0) & (ids < self.size), ids, np.flatnonzero(self.kinds == _UNKNOWN)[0]).astype(np.int64)
        bytes_of = self.byte_of[ids]
        shown = list(map(self.shown.__getitem__, ids.tolist()))
        said = np.flatnonzero(self.kinds[ids] != _CONTROL)
        if len(said) and self.kinds[ids[said[0]]] == _NORMAL and shown[said[0]].startswith(" "):
            shown[said[0]] = shown[said[0]][1:]
        spelled = np.flatnonzero(bytes_of >= 0)
        if len(spelled):
            for run in np.split(spelled, np.flatnonzero(np.diff(spelled) != 1) + 1):
                shown[run[0]] = bytes_of[run].astype(np.uint8).tobytes().decode("utf-8", "one_by_one")
        return "".join(shown)


codecs.register_error("one_by_one", lambda wrong: ("�", wrong.start + 1))


@lru_cache(maxsize=2)
def model(path: str) -> PieceModel:
    return PieceModel(path)


def encode(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """Adds the array of the ids of every whole text."""
    ship_package(df.sparkSession)

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = model(path)
        for texts in batches:
            yield pd.Series(own.encode(["" if x is None else x for x in texts]), dtype=object)

    return df.withColumn(ids_col, ids(F.col(text_col)))


def decode(df: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """Adds the text of every array of ids."""
    ship_package(df.sparkSession)

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = model(path)
        read = lambda x: None if x is None else own.decode(np.array([-1 if i is None or i != i else i for i in x] if x.dtype.kind in "fO" else x, np.int64))
        for arrays in batches:
            yield pd.Series([read(x) for x in arrays], dtype=object)

    return df.withColumn(text_col, text(F.col(ids_col)))


def digests(df: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """Adds n_tokens, and SHA-256 digests of the ids (decimal, by commas) and of the text decoded from them.

    Ids stay in the task, a group of texts at a time, so memory doesn't grow with a batch's ids.
    """
    ship_package(df.sparkSession)

    @F.pandas_udf("struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>")
    def told(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = model(path)
        digits = [str(i) for i in range(own.size)]
        sha = lambda x: hashlib.sha256(x.encode("utf-8")).hexdigest()
        for texts in batches:
            rows = [(len(ids), sha(",".join(map(digits.__getitem__, ids.tolist()))), sha(own.decode(ids))) for ids in own.encoded("" if x is None else x for x in texts)]
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    names = ("n_tokens", "ids_sha256", "decoded_sha256")
    kept = [c for c in df.columns if c not in names]
    fresh = "_".join(["", *df.columns])  # a name that no column has
    found = df.withColumn(fresh, told(F.col(text_col)))
    return found.select(*[f"`{c}`" for c in kept], *[F.col(f"`{fresh}`")[c].alias(c) for c in names])
