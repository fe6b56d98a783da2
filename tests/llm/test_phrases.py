"""Collocations against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from factloom.llm import phrases, registry
from tests.llm.planted import awkward


def plain(docs, least=10, most=3, share=50, top=2000):
    """(text, lang) to the rows of every language."""
    counts, sizes = {}, Counter()
    for text, lang in docs:
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        own = counts.setdefault(lang or "und", Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = tuple(re.findall(r"[^\x20\x09]+", piece))
            sizes[lang or "und"] += len(words)
            for k in range(1, most + 1):
                own.update(words[i : i + k] for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = {p[i:j] for p, a in candidates.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and 100 * a >= share * f[p[i:j]]}
        rows = []
        for p, a in candidates.items():
            if p not in inside:
                score, _, l, r = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i, p.decode(), -a, l, r, sizes[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def texts(n, seed=5):
    dice, words = random.Random(seed), ["the", "a", "of", "red", "Blue", "new", "york", "city", "naïve", "日本", "x"]
    made = [" ".join(dice.choices(words, [40, 20, 20, 5, 5, 5, 5, 5, 3, 3, 2], k=dice.randint(0, 60))).replace("of a", dice.choice(["of, a", "of a", "of\ta", "of\x0ba"])) for _ in range(n)]
    return [(t, dice.choice(["en", "de", None])) for t in made]


@pytest.mark.parametrize(("block", "most"), [(1 << 20, 3), (300, 3), (50, 4), (1000, 2)])
def test_blocks_give_the_plain_counts(spark, block, most, monkeypatch):
    docs = texts(300) + [(None, "en"), ("", None), ("  \t ", "fr"), ("word", "fr"), ("x " * 5_000, "en")]
    df = spark.createDataFrame(docs, "text string, lang string").withColumns({"block": F.lit("own"), "name": F.lit("own")})
    got = phrases.collocations(df.repartition(4), most_words=most, block_words=block)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == plain(docs, most=most)


def test_slabs_end_with_pieces(monkeypatch):
    monkeypatch.setattr(phrases, "SLAB", 5)
    text = "One two. three, four five six seven; eight\tNine"
    assert b"".join(phrases.slabs(text)) == b"one two\n three\n four five six seven\n eight nine"
    assert all(x.startswith(b"\n") for x in list(phrases.slabs(text))[1:])


def test_best_of_each_language_and_options(spark):
    docs = texts(200, 8)
    got = phrases.collocations(spark.createDataFrame(docs, "text string, lang string"), least=5, share=80, top=3)
    assert sorted(tuple(r) for r in got.collect()) == plain(docs, least=5, share=80, top=3)


def test_query(spark, tmp_path):
    root = awkward(tmp_path)
    docs = [(r.text, r.lang) for r in spark.read.parquet(f"{root}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in registry.queries()["op12_collocations"](spark, root).collect()) == plain(docs)
