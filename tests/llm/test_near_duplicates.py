"""The near-duplicate stage of the pipeline against all pairs compared."""

from __future__ import annotations

import numpy as np
import pytest

from factloom.llm import simhash

POOL = [f"w{i}" for i in range(5000)]


def groups(texts: list[str]) -> set[tuple[int, ...]]:
    """Components of the pairs whose shingle sets have a Jaccard similarity of 0.8."""
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := t.split()) else set() for t in texts]
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if not a | b or len(a & b) >= 0.8 * len(a | b):
                x, y = sorted((find(root, i), find(root, j)))
                root[y] = x
    return members([find(root, i) for i in range(len(texts))])


def find(root: list[int], i: int) -> int:
    while root[i] != i:
        i = root[i]
    return i


def members(roots: list[int]) -> set[tuple[int, ...]]:
    out: dict[int, list[int]] = {}
    for i, r in enumerate(roots):
        out.setdefault(r, []).append(i)
    return {tuple(x) for x in out.values()}


def found(spark, texts: list[str], **options) -> set[tuple[int, ...]]:
    docs = spark.createDataFrame(list(enumerate(texts)), "n long, text string")
    root = dict(enumerate(range(len(texts)))) | {r.node: r.root for r in simhash.near_duplicates(docs, **options).collect()}
    return members([root[i] for i in range(len(texts))])


def family(rng, variants: int, words: int, changed: int) -> list[str]:
    """Variants of a template with so many words changed, about 5 shingles each."""
    base, out = rng.choice(POOL, words).tolist(), []
    for v in range(variants):
        own = list(base)
        for k, at in enumerate(rng.choice(words, changed, replace=False)):
            own[at] = f"v{v}x{k}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("block", [1024, 16])
def test_families_of_borderline_variants(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "LONG", 8)
    rng = np.random.default_rng(7)
    texts = [*family(rng, 300, 260, 4), *family(rng, 120, 120, 2), "", None, " ", "one", "one two"]
    expected = groups([t or "" for t in texts])
    assert 1 < len(expected) < len(texts)
    assert found(spark, texts, block=block) == expected


def test_texts_dominated_by_one_line(spark):
    rng, line = np.random.default_rng(8), " ".join(POOL[:9])
    bodies = [rng.choice(POOL, 300).tolist() for _ in range(2)]
    copy = [*bodies[1][:150], "changed", *bodies[1][151:]]
    texts = [" ".join([*body, *[line] * 200]) for body in (*bodies, copy)]
    assert found(spark, texts) == groups(texts) == {(0,), (1, 2)}


def test_repeated_passages_count_once(spark):
    rng, texts = np.random.default_rng(9), []
    for words, passage, times in ((300, 40, 5), (300, 30, 20), (1000, 30, 40)):
        body, own = rng.choice(POOL, words).tolist(), rng.choice(POOL, passage).tolist()
        texts += [" ".join([*body, *own]), " ".join([*body, *own * times])]
    assert found(spark, texts) == groups(texts) == {(0, 1), (2, 3), (4, 5)}
    a, b = ([x for lane in simhash.set_fingerprint(t) for x in f"{lane:064b}"] for t in texts[:2])
    assert sum(x != y for x, y in zip(a, b, strict=True)) <= simhash.tables_for(40_695)[2]


def test_pairs_at_the_least_similarity(spark):
    rng, texts = np.random.default_rng(10), []
    for _ in range(400):
        words = rng.choice(POOL, 104).tolist()
        other = list(words)
        other[20] = other[50] = "changed"  # 10 of 100 shingles differ: 90 / 110
        texts += [" ".join(words), " ".join(other)]
    assert found(spark, texts) == groups(texts)
    assert len(groups(texts)) == 400
