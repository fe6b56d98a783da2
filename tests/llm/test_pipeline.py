"""Each stage of the pipeline against brute force on what its predecessor kept, and the whole."""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from factloom.llm import simhash, toxicity
from factloom.session import stage, table
from tests.llm.planted import awkward

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """The documents before each stage and after the last one, and the last result."""
    root = awkward(tmp_path_factory.mktemp("pipeline"))
    docs, seen = table(spark, root, "documents"), []
    for name, apply in corpus_pipeline.STAGES:
        seen.append([r.asDict() for r in docs.collect()])
        before, docs = docs, stage(apply(spark, docs, root), f"test-{name}")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == before.columns
    return root, seen, [r.asDict() for r in docs.collect()]


def ids(rows):
    return sorted(r["doc_id"] for r in rows)


def text(row):
    return row["text"] or ""


def test_toxicity(spark, steps):
    root, seen, _ = steps
    docs = table(spark, root, "documents")
    model = toxicity.fit(docs, table(spark, root, "labels"))
    kept = [d for d in seen[0] if model.score(d["text"])[1] < toxicity.LIMIT]
    assert ids(kept) == ids(seen[1]) and len(kept) > 0.9 * len(seen[0])
    toxic = {r.doc_id for r in table(spark, root, "labels").filter("toxic = 1").collect()}
    assert len(toxic & set(ids(seen[1]))) <= len(toxic) / 2


def test_exact_dedup(steps):
    _, seen, _ = steps
    groups = defaultdict(list)
    for d in seen[1]:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text(d))].append(d)
    kept = [min(g, key=lambda d: (-len(text(d)), d["doc_id"])) for g in groups.values()]
    assert ids(kept) == ids(seen[2]) and len(seen[2]) < len(seen[1])


def kept_of_groups(docs):
    """The smallest id of every component of pairs with a similarity of 0.8 or more."""
    sets = []
    for d in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", text(d).translate(UPPER))
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    order = sorted(range(len(docs)), key=lambda i: len(sets[i]))
    for at, i in enumerate(order):
        for j in order[at + 1 :]:
            if len(sets[i]) < 0.8 * len(sets[j]):
                break
            common = len(sets[i] & sets[j])
            if common >= 0.8 * (len(sets[i]) + len(sets[j]) - common):
                root[find(j)] = find(i)
    best = {}
    for i, d in enumerate(docs):
        best[find(i)] = min(best.get(find(i), d["doc_id"]), d["doc_id"])
    return sorted(best.values())


def test_near_dedup(steps):
    _, seen, _ = steps
    assert kept_of_groups(seen[2]) == ids(seen[3]) and len(seen[3]) < len(seen[2])


def test_near_dedup_loses_no_link_on_larger_tables(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    assert kept_of_groups([r.asDict() for r in docs.collect()]) == sorted(r.doc_id for r in simhash.drop_near_duplicates(docs).collect())


def test_decontamination(steps):
    root, seen, _ = steps
    words_of = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (x or "").translate(UPPER))
    windows = set()
    for item in pq.read_table(f"{root}/benchmark.parquet").column("text").to_pylist():
        words = words_of(item)
        windows |= {tuple(words[i : i + 10]) for i in range(max(1, len(words) - 9))} if words else set()
    clean = []
    for d in seen[3]:
        words = words_of(d["text"])
        if not any(tuple(words[i : i + n]) in windows for n in {len(w) for w in windows} for i in range(len(words) - n + 1)):
            clean.append(d)
    assert ids(clean) == ids(seen[4]) and len(clean) < len(seen[3])


def test_packing(steps):
    _, seen, packed = steps
    vocabulary = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    lengths, bins = defaultdict(int), defaultdict(list)
    for r in packed:
        lengths[r["doc_id"]] += r["length"]
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert dict(lengths) == {d["doc_id"]: len(vocabulary.encode(text(d), add_special_tokens=False).ids) + 1 for d in seen[4]}
    for parts in bins.values():
        starts = np.cumsum([0, *[n for _, n in sorted(parts)]])
        assert [at for at, _ in sorted(parts)] == starts[:-1].tolist() and starts[-1] <= 2048


def test_the_whole_is_its_stages(spark, steps):
    root, _, packed = steps
    whole = corpus_pipeline.run(spark, root).collect()
    shown = lambda rows: sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in rows)
    assert shown(r.asDict() for r in whole) == shown(packed)
