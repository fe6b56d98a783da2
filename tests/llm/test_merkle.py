"""The tree against a plain one, and tampered rows."""

from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from factloom.llm import merkle, registry
from tests.llm.planted import awkward


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(leaves):
    """The root, and each leaf's siblings by level."""
    paths, level, places = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for i, at in enumerate(places):
            run = level[at // 3 * 3 : at // 3 * 3 + 3]
            paths[i].append(("".join(run[: at % 3]), "".join(run[at % 3 + 1 :])))
        level = [sha(*level[i : i + 3]) for i in range(0, len(level), 3)]
        places = [x // 3 for x in places]
    return level[0], paths


def plain(rows):
    """(group, id, leaf) to (id, leaf, subroot, root, path), in order."""
    groups = {}
    for group, row_id, leaf in sorted(rows, key=lambda r: (r[0] is not None, (r[0] or "").encode(), r[1] is not None, r[1] or 0, r[2])):
        groups.setdefault(group, []).append((row_id, leaf))
    trees = [tree([leaf for _, leaf in own]) for own in groups.values()]
    root, above = tree([t[0] for t in trees])
    return [(i, leaf, t[0], root, p + up) for own, t, up in zip(groups.values(), trees, above, strict=True) for (i, leaf), p in zip(own, t[1], strict=True)]


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 3, None: 2}, {"a": 81, "b": 82, "é": 80}, {"one": 700, "z": 1} | {f"g{i}": 1 + i % 3 for i in range(100)}])
def test_blocks_give_the_plain_tree(spark, sizes):
    rows = [(g, i - 1 if i else None, sha(str(g), str(i))) for g, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "group string, id long, leaf string").withColumn("seen", F.lit("x")).repartition(5)
    got = sorted((r.id is not None, r.id or 0, r.leaf, r.subroot, r.root, [tuple(s) for s in r.path]) for r in merkle.prove(df).collect())
    assert got == sorted((i is not None, i or 0, leaf, sub, root, path) for i, leaf, sub, root, path in plain(rows))


def told(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def test_query(spark, tmp_path):
    root = awkward(tmp_path)
    docs = [r.asDict() for r in spark.read.parquet(f"{root}/documents.parquet").collect()]
    leaf_of = lambda d, text: sha(*[told(d[c]) for c in merkle.FIELDS[:-1]], told(text))
    whole = {i: rest for i, *rest in plain([(d["source"], d["doc_id"], leaf_of(d, d["text"])) for d in docs])}
    got = {r.doc_id: r for r in registry.queries()["op11_merkle"](spark, root).collect()}
    assert len(got) == len(docs)
    failed = 0
    for d in docs:
        row, (leaf, sub, top, path) = got[d["doc_id"]], whole[d["doc_id"]]
        text = d["text"].replace("\n", "") if d["text"] and zlib.crc32(str(d["doc_id"]).encode()) % 2 == 0 else d["text"]
        folded = leaf_of(d, text)
        for before, after in path:
            folded = sha(before, folded, after)
        assert (row.leaf, row.subroot, row.root, row.proof_sha256) == (leaf, sub, top, sha(*[b + a for b, a in path]))
        assert (row.folded_root, row.verified) == (folded, text == d["text"])
        failed += not row.verified
    assert 0 < failed < len(docs)


def test_nulls_and_repeated_rows(spark):
    rows = [(None, None, None), (1, "s", "text"), (1, "s", "text"), (2, "s", ""), (None, "s", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumns({"part": F.lit("own"), "path": F.lit(1)})
    leaves = merkle.document_leaves(docs, F.lit(None).cast("string"), fields=("doc_id", "source", "text"))
    got = merkle.digest_columns(merkle.prove(leaves)).collect()
    assert len(got) == 5 and all(r.verified and r.folded_root == r.root for r in got)
    assert sorted(r.leaf for r in got) == sorted(sha(*map(told, x)) for x in rows)
