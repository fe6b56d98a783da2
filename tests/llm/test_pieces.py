"""Encoding and decoding against the library itself."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.llm import pieces, registry
from tests.llm.planted import awkward

PATH = public_tokenizers.path("piece_bpe_32k.model")
OWN, LIBRARY = pieces.PieceModel(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)
TEXTS = st.text(st.one_of(st.sampled_from(" ▁\t\nabcdeinrst.,09<>/日本é\x00"), st.characters(exclude_categories=["Cs"])), max_size=80)


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXTS, max_size=6))
def test_encodes_and_decodes_as_the_library(texts):
    mine = OWN.encode(texts)
    assert [x.tolist() for x in mine] == LIBRARY.encode(texts)
    assert [OWN.decode(x) for x in mine] == [LIBRARY.decode(x.tolist()) for x in mine]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 31_999), st.just(28705)), max_size=12))
def test_decodes_any_ids_as_the_library(ids):
    assert OWN.decode(np.array(ids, np.int64)) == LIBRARY.decode(ids)


def test_long_words_by_parts_and_from_the_heap(monkeypatch):
    dice = random.Random(3)
    texts = [" " * 3_000 + "x", "x" * 9_000, "ab" * 4_000, "".join(dice.choices("abcdefgHIJK0123+/", k=20_000)), "中" * 2_000, "the" * 3_000, "a" * 513, "e" * 512]
    wanted = LIBRARY.encode(texts)
    assert [x.tolist() for x in OWN.encode(texts)] == wanted
    monkeypatch.setattr(pieces, "LONGEST", 2)  # nearly all by the heap
    OWN.forget()
    assert [x.tolist() for x in OWN.encode([*texts[3:], "one two, three"])] == [*wanted[3:], LIBRARY.encode("one two, three")]
    OWN.forget()


def test_remembered_words_are_bounded(monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 3)
    monkeypatch.setattr(pieces, "GROUP_CHARS", 10)
    texts = ["a few words that are", "not remembered for", "", "long at all", "a few words"]
    assert [x.tolist() for x in OWN.encode(texts)] == LIBRARY.encode(texts)
    assert len(OWN.seen) <= 3 + 5
    OWN.forget()


def test_query_and_columns(spark, tmp_path):
    root = awkward(tmp_path)
    rows = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{root}/documents.parquet").collect()}
    got = registry.queries()["op13_sentencepiece"](spark, root).collect()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    ids = dict(zip(rows, LIBRARY.encode(list(rows.values())), strict=True))
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got} == {k: (len(x), sha(",".join(map(str, x))), sha(LIBRARY.decode(x))) for k, x in ids.items()}


@pytest.mark.parametrize("text_col", ["text", "ids"])
def test_real_ids_and_texts(spark, text_col):
    # Null, empty and repeated rows, a null id, and other columns with the operators' own names.
    rows = [(1, "two words", "x"), (1, "two words", "x"), (None, None, None), (3, "", ""), (4, "日本 \x00", None)]
    df = spark.createDataFrame(rows, f"doc_id long, {text_col} string, _told string")
    coded = pieces.encode(df, PATH, text_col, "made")
    back = pieces.decode(coded, PATH, "made", "decoded").collect()
    assert [(r.doc_id, r["_told"], r.made, r.decoded) for r in back] == [(i, t, LIBRARY.encode(x or ""), x or "") for i, x, t in rows]
    assert pieces.digests(df, PATH, text_col).columns == ["doc_id", text_col, "_told", "n_tokens", "ids_sha256", "decoded_sha256"]
    odd = spark.createDataFrame([(None,), ([],), ([5, None, 40_000],)], "ids array<int>")
    assert [r.decoded for r in pieces.decode(odd, PATH).collect()] == [None, "", OWN.decode(np.array([5, 0, 0]))]
