"""Collocations of each language by hierarchical pair naming.

Texts are cut into pieces at punctuation and pieces into words. Level 1 names the frequent
words; at each further level adjacent frequent (k-1)-grams are replaced by the name of
their pair, if it is frequent, so that a k-gram's name has two parents: its first and its
last k-1 words. Names are global.

Occurrences never travel one by one. Tasks gather the words of about BLOCK_WORDS words of
text into a block: an array of block-local codes, and one row for each distinct code with
its count. Counting and naming are a grouping and a join of these rows, so a word that
makes a third of all text is one row for each block; the join may be split by adaptive
execution. A block then meets its codes' names (a cogroup whose groups are bounded by the
block's size) and makes the codes of the next level. Counts and cuts follow the parents:
the count of a phrase's first j words is that of its first parent's, and so on; a phrase is
subsumed if a frequent child has a large enough share of its occurrences.

Edge cases: null texts are empty, a null language is UNNAMED; languages without phrases
give no rows; ties are ordered by count, then by phrase; equal rows all count; a text of any
length is read in slabs that end at a piece's end; a piece without punctuation stays whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.session import release, ship_package, stage

BLOCK_WORDS = 1 << 21
#: Bytes of a text that are read together, at least.
SLAB = 1 << 20
#: Parts of a language that are ranked by themselves.
PARTS = 32
UNNAMED = "und"
BREAKS = ".,;:!?\n\x0b\x0c\r"
_ENDS = b"\n"
_TABLE = bytes(10 if chr(b) in BREAKS else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
_WORDS = pa.schema([("block", pa.int64()), ("codes", pa.binary()), ("code", pa.int32()), ("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])
_PAIRS = pa.schema([("block", pa.int64()), ("codes", pa.binary()), ("code", pa.int32()), ("left", pa.int64()), ("right", pa.int64()), ("n", pa.int64())])
WORDS_DDL = "block bigint, codes binary, code int, lang string, word string, n bigint"
PAIRS_DDL = "block bigint, codes binary, code int, left bigint, right bigint, n bigint"


class _Codes(dict):
    """Codes of one language's words in a block."""

    def __init__(self, lang: str, block: _Block):
        self.lang, self.block = lang, block
        self[_ENDS], self[b""] = -1, -2

    def __missing__(self, word: bytes) -> int:
        self[word] = code = len(self.block.words)
        self.block.words.append(word)
        self.block.langs.append(self.lang)
        return code


class _Block:
    def __init__(self, number: int):
        self.number, self.size = number, 0
        self.words: list[bytes] = []
        self.langs: list[str] = []
        self.parts: list[np.ndarray] = []
        self.codes: dict[str, _Codes] = {}

    def take(self, lang: str, slab: bytes) -> None:
        own = self.codes.get(lang) or self.codes.setdefault(lang, _Codes(lang, self))
        tokens = slab.replace(_ENDS, b" \n ").split(b" ")
        codes = np.fromiter(map(own.__getitem__, tokens), np.int32, len(tokens))
        self.parts += [codes[codes > -2], np.array([-1], np.int32)]
        self.size += len(self.parts[-2])

    def rows(self) -> Iterator[pa.RecordBatch]:
        codes = np.concatenate(self.parts)
        n, known = len(self.words), np.bincount(codes[codes >= 0], minlength=len(self.words))
        names = [pa.array(np.full(n, self.number)), pa.nulls(n, pa.binary()), pa.array(np.arange(n, dtype=np.int32)), pa.array(self.langs, pa.string()), pa.array(self.words, pa.binary()).cast(pa.string()), pa.array(known.astype(np.int64))]
        yield pa.RecordBatch.from_arrays(names, schema=_WORDS)
        yield _codes_row(self.number, codes, _WORDS)


def _codes_row(number: int, codes: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
    own = {"block": number, "codes": codes.tobytes()}
    return pa.RecordBatch.from_arrays([pa.array([own.get(f.name)], f.type) for f in schema], schema=schema)


def slabs(text: str) -> Iterator[bytes]:
    """A text's bytes, folded, in slabs of whole pieces."""
    data = text.encode("utf-8", "replace").translate(_TABLE)
    start = 0
    while len(data) - start > SLAB and (end := data.find(_ENDS, start + SLAB)) >= 0:
        yield data[start:end]
        start = end
    yield data[start:]


def coded(docs: DataFrame, text_col: str, lang_col: str, block_words: int) -> DataFrame:
    """Blocks of codes, and their words with counts."""
    ship_package(docs.sparkSession)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = _Block(TaskContext.get().partitionId() << 33)
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1), strict=True):
                for slab in slabs(text.as_py()):
                    block.take(lang.as_py(), slab)
                    if block.size >= block_words:
                        yield from block.rows()
                        block = _Block(block.number + 1)
        if block.size:
            yield from block.rows()

    said = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.col(lang_col), F.lit(UNNAMED)).alias("lang"))
    return said.mapInArrow(blocks, WORDS_DDL)


def _paired(last: bool):
    """A block's codes and the names of those that are frequent: its distinct pairs, and the codes of the pairs."""

    def pairs(blocks: pa.Table, named: pa.Table) -> pa.Table:
        if not len(blocks) or not len(named):
            return _PAIRS.empty_table()
        number = blocks.column("block")[0].as_py()
        codes = np.frombuffer(blocks.column("codes")[0].as_py(), np.int32)
        n = int(codes.max()) + 1
        names = np.full(n + 1, -1, np.int64)  # the last is for breaks
        names[named.column("code").to_numpy()] = named.column("name").to_numpy()
        known = names[codes] >= 0
        at = np.flatnonzero(known[:-1] & known[1:])
        keys, code, count = np.unique(codes[at].astype(np.int64) * n + codes[at + 1], return_inverse=True, return_counts=True)
        m = len(keys)
        made = [np.full(m, number), pa.nulls(m, pa.binary()), np.arange(m, dtype=np.int32), names[keys // n], names[keys % n], count.astype(np.int64)]
        out = [pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in made], schema=_PAIRS)]
        if not last:
            paired = np.full(len(codes), -1, np.int32)
            paired[at] = code
            out.append(_codes_row(number, paired, _PAIRS))
        return pa.Table.from_batches(out, schema=_PAIRS)

    return pairs


def grams(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", least: int = 10, most_words: int = 3, block_words: int = BLOCK_WORDS) -> tuple[list[DataFrame], DataFrame]:
    """Frequent grams by length: (name, lang, word, f), then (name, left, right, f); and each language's words."""
    compact = {"compression": "zstd"}
    spark = docs.sparkSession
    level = stage(coded(docs, text_col, lang_col, block_words), "phrase-words", options=compact)
    own = level.filter("codes is null")
    sizes = stage(own.groupBy("lang").agg(F.sum("n").alias("n")), "phrase-sizes")
    keys, found = ["lang", "word"], []
    for k in range(1, most_words + 1):
        counted = own.groupBy(*keys).agg(F.sum("n").alias("f")).filter(F.col("f") >= least)
        found.append(stage(counted.select(F.monotonically_increasing_id().alias("name"), *keys, "f"), f"phrase-grams{k}", options=compact))
        if k == most_words:
            break
        named = own.select("block", "code", *keys).join(found[-1].drop("f"), keys).select(F.col("block").alias("of"), "code", "name")
        blocks = level.filter("codes is not null").select("block", "codes")
        pairs = blocks.groupBy("block").cogroup(named.groupBy("of")).applyInArrow(_paired(k + 1 == most_words), PAIRS_DDL)
        before, level = level, stage(pairs, f"phrase-pairs{k + 1}", options=compact)
        release(before)
        own, keys = level.filter("codes is null"), ["left", "right"]
    release(level)
    return found, sizes


def _whole(n: Column | int) -> Column:
    return (F.lit(n) if isinstance(n, int) else n).cast("decimal(15,0)")


def _cuts(words: int) -> Column:
    """Score, place and both parts' counts of every cut; `firsts` and `lasts` hold counts by number of words."""

    def cut(j: int) -> Column:
        left, right = F.col("firsts")[j - 1], F.col("lasts")[words - j - 1]
        # 7 + 15 + 15 digits; counts below 10^15.
        scaled = F.lit(1_000_000).cast("decimal(7,0)") * (_whole(F.col("f")) * _whole(F.col("f"))).cast("decimal(30,0)")
        score = F.call_function("div", scaled, (_whole(left) * _whole(right)).cast("decimal(30,0)"))
        return F.struct(score.cast("bigint").alias("score"), F.lit(j).alias("cut"), left.alias("l"), right.alias("r"))

    return F.array_min(F.array(*[cut(j) for j in range(1, words)]))


def collocations(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", least: int = 10, most_words: int = 3, share: int = 50, top: int = 2000, block_words: int = BLOCK_WORDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score, the best `top` of each language.

    least: occurrences of a candidate. share: percent of a phrase's occurrences that make
    a longer candidate subsume it. Scores are whole numbers, computed exactly.
    """
    found, sizes = grams(docs, text_col=text_col, lang_col=lang_col, least=least, most_words=most_words, block_words=block_words)
    none = F.array().cast("array<bigint>")
    known = found[0].select("name", "lang", F.array("word").alias("words"), "f", none.alias("firsts"), none.alias("lasts"))
    scored = None
    for k, level in enumerate(found[1:], 2):
        first = known.select(F.col("name").alias("left"), "lang", F.col("words").alias("head"), F.concat("firsts", F.array("f")).alias("firsts"))
        last = known.select(F.col("name").alias("right"), F.element_at("words", -1).alias("tail"), F.concat("lasts", F.array("f")).alias("lasts"))
        joined = level.join(first, "left").join(last, "right")
        known = joined.select("name", "lang", F.concat("head", F.array("tail")).alias("words"), "f", "firsts", "lasts")
        if k < most_words:
            known = stage(known, f"phrase-known{k}")
        kept = known
        if k < most_words:
            longer = found[k].select(F.explode(F.array("left", "right")).alias("name"), F.col("f").alias("_longer")).groupBy("name").agg(F.max("_longer").alias("_longer"))
            kept = known.join(longer, "name", "left").filter(F.coalesce(F.col("_longer") * 100 < F.col("f") * share, F.lit(True)))
        own = kept.select("lang", F.array_join("words", " ").alias("phrase"), F.col("f").alias("a"), _cuts(k).alias("best"))
        scored = own if scored is None else scored.unionByName(own)
    if scored is None:
        raise ValueError("phrases have two words at least")
    order = (F.col("best.score").desc(), F.col("a").desc(), F.col("phrase"))
    # First in PARTS of a language, so that a large one isn't left to one task.
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    nearly = scored.withColumn("_place", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).filter(F.col("_place") <= top)
    ranked = nearly.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).filter(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "best.l", "best.r", "n", "best.score")


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), listed AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces
), placed AS (
  SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM listed
), f1 AS (SELECT lang, ws[i] AS w1, count(*) AS f FROM placed GROUP BY 1, 2),
f2 AS (SELECT lang, ws[i] AS w1, ws[i + 1] AS w2, count(*) AS f FROM placed WHERE i < len(ws) GROUP BY 1, 2, 3),
f3 AS (SELECT lang, ws[i] AS w1, ws[i + 1] AS w2, ws[i + 2] AS w3, count(*) AS f FROM placed WHERE i + 1 < len(ws) GROUP BY 1, 2, 3, 4 HAVING count(*) >= 10),
sizes AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f1 GROUP BY 1),
two AS (
  SELECT lang, p.w1 || ' ' || p.w2 AS phrase, p.f AS a, x.f AS l, y.f AS r FROM f2 p JOIN f1 x USING (lang, w1) JOIN (SELECT lang, w1 AS w2, f FROM f1) y USING (lang, w2)
  WHERE p.f >= 10 AND NOT EXISTS (SELECT 1 FROM f3 t WHERE t.lang = p.lang AND t.w1 = p.w1 AND t.w2 = p.w2 AND 100 * t.f >= 50 * p.f)
    AND NOT EXISTS (SELECT 1 FROM f3 t WHERE t.lang = p.lang AND t.w2 = p.w1 AND t.w3 = p.w2 AND 100 * t.f >= 50 * p.f)
), three AS (
  SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3 AS phrase, t.f AS a, x.f AS l1, b.f AS r1, c.f AS l2, y.f AS r2
  FROM f3 t JOIN f1 x ON x.lang = t.lang AND x.w1 = t.w1 JOIN f2 b ON b.lang = t.lang AND b.w1 = t.w2 AND b.w2 = t.w3
    JOIN f2 c ON c.lang = t.lang AND c.w1 = t.w1 AND c.w2 = t.w2 JOIN f1 y ON y.lang = t.lang AND y.w1 = t.w3
), cut AS (
  SELECT lang, phrase, a, l, r, 1000000 * CAST(a AS HUGEINT) * a // (CAST(l AS HUGEINT) * r) AS score, 1 AS k FROM two
  UNION ALL SELECT lang, phrase, a, l1, r1, 1000000 * CAST(a AS HUGEINT) * a // (CAST(l1 AS HUGEINT) * r1), 1 FROM three
  UNION ALL SELECT lang, phrase, a, l2, r2, 1000000 * CAST(a AS HUGEINT) * a // (CAST(l2 AS HUGEINT) * r2), 2 FROM three
), best AS (
  SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM best
)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN sizes USING (lang) WHERE rank <= 2000"""
