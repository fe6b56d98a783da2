"""URL filtering: host/path rules first, then a weighted vocabulary.

The vocabulary is a table of (term, stem, weight, strict): built in, loaded from a file, or
learned from judged URLs. Its terms are one Aho-Corasick automaton. A term counts only
where the characters on both sides are not ASCII letters or digits ("boundary checks").
Terms of one stem are one hit. A strict stem weighs 1 and rejects alone; soft stems weigh
less, each counts once however often and in however many spellings it occurs, and the URL
is rejected when the distinct hits' weights reach 1.

The built-in table is made by a rule from the stems below: each with its plural, and stems
of LEET_FROM letters and more with the digits that are written for their letters. It is a
start of general subjects, in English, not a survey of the web; a table of one's own is a
parameter, of up to MAX_TERMS terms, as it is sent to every task.

Edge cases: a null URL or one without "://" has an empty host and path, fits no rule,
has no hits and is allowed; empty tables give empty results; repeated rows are judged
one by one; other columns of the input pass through, and result columns replace
columns of the same name. Vocabulary rows without a term or weight are left out; of equal
terms the strict and then the heaviest one counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import product

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.session import ship_package

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Host, path and decision, as the contract of the query states them.
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)

#: Stems that reject alone: unambiguous by themselves.
STRICT = (
    "adult-x", "adult-xxx", "bestiality", "camgirl", "camwhore", "escort-girl", "hardcore-porn", "hentai", "keygen", "link-farm", "milf", "phishkit", "porn", "porno", "pornography",
    "pornstar", "sexcam", "sextube", "warez", "x-rated", "xxx", "xvideo",
)
#: Subjects that a clean page may have as well, and words that such pages advertise with. One
#: subject and any other stem reject, as do three advertising words; one stem never does.
SUBJECT, ADVERTISING = 0.67, 0.34
SUBJECTS = (
    "ad", "adult", "adware", "bet", "betting", "bingo", "blackjack", "bookmaker", "botox", "cannabis", "casino", "cialis", "clickbait", "counterfeit", "cracked", "dating", "erotic", "erotica",
    "escort", "fetish", "forex", "gambling", "gigolo", "hacked", "hookup", "jackpot", "lingerie", "lottery", "malware", "naked", "nude", "nudity", "opioid", "payday", "pharmacy", "phishing",
    "pill", "poker", "pyramid", "replica", "roulette", "seduction", "sex", "sexy", "slot", "spam", "spyware", "steroid", "stripper", "swinger", "torrent", "tramadol", "valium", "viagra", "vape", "xanax",
)
PROMOTIONS = (
    "bonus", "buy", "cam", "cash", "cheap", "clearance", "coupon", "crack", "credit", "deal", "discount", "download", "farm", "free", "gratis", "girl", "hot", "instant", "live", "loan",
    "lucky", "offer", "online", "order", "prize", "promo", "promotion", "reward", "rx", "sale", "singles", "track", "tracker", "trial", "unlimited", "vip", "voucher", "win", "winner",
)
#: Digits that are written for letters (fixed values), and the letters from which stems have such spellings.
LEET, LEET_FROM = {"a": "4", "e": "3", "i": "1", "o": "0", "s": "5"}, 4
MAX_TERMS = 1 << 20

LIMIT = 1.0
_ALNUM = frozenset(LOWER + "0123456789")
HITS = "strict array<string>, soft array<string>, score double"
TERMS = "term string, stem string, weight double, strict boolean"


@dataclass(frozen=True)
class Term:
    term: str
    stem: str
    weight: float
    strict: bool = False


def spellings(stem: str) -> list[str]:
    """A stem, its plural, and both with digits for letters, kind by kind of letter."""
    plain = [stem] if stem.endswith("s") else [stem, stem + "s"]
    letters = [x for x in LEET if x in stem] if sum(c.isalpha() for c in stem) >= LEET_FROM else []
    out = []
    for word in plain:
        for chosen in product((False, True), repeat=len(letters)):
            out.append(word.translate({ord(x): LEET[x] for x, on in zip(letters, chosen, strict=True) if on}))
    return list(dict.fromkeys(out))


def built_in() -> tuple[Term, ...]:
    """The table that is made from the stems."""
    stems = {x: Term(x, x, SUBJECT) for x in SUBJECTS} | {x: Term(x, x, ADVERTISING) for x in PROMOTIONS} | {x: Term(x, x, 1.0, True) for x in STRICT}
    found: dict[str, Term] = {}
    for own in stems.values():
        for word in spellings(own.stem):
            found.setdefault(word, Term(word, own.stem, own.weight, own.strict))
    return tuple(found.values())


def vocabulary_of(table: DataFrame) -> tuple[Term, ...]:
    """The vocabulary of a table (term, weight; strict and stem where it has them), of up to MAX_TERMS terms."""
    have = set(table.columns)
    term = F.translate(F.trim("term"), UPPER, LOWER)
    stem = F.coalesce(F.when(F.trim("stem") != "", F.translate(F.trim("stem"), UPPER, LOWER)), term) if "stem" in have else term
    strict = F.coalesce(F.col("strict").cast("boolean"), F.lit(False)) if "strict" in have else F.lit(False)
    rows = table.select(term.alias("term"), stem.alias("stem"), F.col("weight").cast("double").alias("weight"), strict.alias("strict")).filter("term <> '' AND weight IS NOT NULL")
    best = rows.groupBy("term").agg(F.max(F.struct("strict", "weight", "stem")).alias("b")).select("term", "b.stem", "b.weight", "b.strict")
    found = best.limit(MAX_TERMS + 1).collect()
    if len(found) > MAX_TERMS:
        raise ValueError(f"a vocabulary has at most {MAX_TERMS} terms")
    return tuple(Term(r.term, r.stem, r.weight, r.strict) for r in sorted(found))


def load_vocabulary(spark: SparkSession, path: str, sep: str = "\t") -> tuple[Term, ...]:
    """The vocabulary of a file with a header (term, weight; strict, stem)."""
    return vocabulary_of(spark.read.csv(path, sep=sep, header=True))


def learn_vocabulary(urls: DataFrame, bad: Column, *, url: str = "url", least: int = 20, strict_from: float = 0.99) -> DataFrame:
    """Weights of the words of judged URLs, as a table for `vocabulary_of`.

    A word of `least` bad URLs or more weighs its smoothed share of bad ones among the URLs
    that have it, above the share of all (weights are 0 to 1); from `strict_from` it is strict.
    """
    words = F.array_distinct(F.filter(F.split(F.translate(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), "(?s)^.*?://(.*)$", 1), UPPER, LOWER), "[^a-z0-9]+"), lambda w: F.length(w) > 2))
    judged = urls.select(words.alias("words"), F.coalesce(bad, F.lit(False)).cast("int").alias("bad"))
    base = judged.agg(F.avg("bad").alias("base"))  # one row
    counted = judged.select(F.explode("words").alias("term"), "bad").groupBy("term").agg(F.count("*").alias("n"), F.sum("bad").alias("n_bad")).filter(F.col("n_bad") >= least)
    share = F.col("n_bad") / (F.col("n") + 1)
    weight = F.greatest(F.lit(0.0), (share - F.col("base")) / F.greatest(F.lit(1e-9), 1 - F.col("base")))
    told = counted.crossJoin(base).select("term", F.when(share >= strict_from, 1.0).otherwise(weight).alias("weight"), (share >= strict_from).alias("strict"))
    return told.filter("weight > 0")


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without "://"."""
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, parts, 1), UPPER, LOWER), F.regexp_extract(url, parts, 2)


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its decision; null where none fits."""
    rule, decision = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, prefix, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        rule = F.when(fits, F.lit(name + prefix)).otherwise(rule)
        decision = F.when(fits, F.lit(verdict)).otherwise(decision)
    return rule, decision


@lru_cache(maxsize=4)
def _automaton(terms: tuple[Term, ...]) -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for t in terms:
        automaton.add_word(t.term, (len(t.term), t.stem, t.weight, t.strict))
    automaton.make_automaton()
    return automaton


def vocabulary_hits(url: str | None, automaton: ahocorasick.Automaton) -> tuple[list[str], list[str], float]:
    """Distinct strict and soft stems with boundaries on both sides, and their weight."""
    if not url or "://" not in url or not len(automaton):
        return [], [], 0.0
    text = url.partition("://")[2].translate(_LOWERED)
    strict, soft = {}, {}
    for end, (length, stem, weight, is_strict) in automaton.iter(text):
        start = end - length
        if (start < 0 or text[start] not in _ALNUM) and (end + 1 == len(text) or text[end + 1] not in _ALNUM):
            found = strict if is_strict else soft
            found[stem] = max(weight, found.get(stem, 0.0))
    return sorted(strict), sorted(soft), sum(strict.values()) + sum(w for x, w in soft.items() if x not in strict)


_LOWERED = str.maketrans(UPPER, LOWER)


def filter_urls(df: DataFrame, url: str = "url", *, rules=RULES, vocabulary: tuple[Term, ...] | None = None, limit: float = LIMIT) -> DataFrame:
    """Adds host, path, rule, verdict and the vocabulary's hits to every row."""
    ship_package(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(built_in() if vocabulary is None else vocabulary)  # at most MAX_TERMS

    @F.pandas_udf(HITS)
    def hits(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = _automaton(shared.value)
        for urls in batches:
            found = [vocabulary_hits(x, automaton) for x in urls]
            yield pd.DataFrame(found, columns=["strict", "soft", "score"])

    host, path = host_path(F.col(url))
    out = df.withColumns({"host": host, "path": path, "hits": hits(F.col(url))})
    rule, decision = matching_rule(F.col("host"), F.col("path"), rules)
    rejected = (F.size("hits.strict") > 0) | (F.col("hits.score") >= limit)
    own = F.when(rejected, F.lit("block")).otherwise(F.lit("allow"))
    return out.withColumns({"rule": rule, "verdict": F.coalesce(decision, own)})


def verdict_sql(table: str = "pages") -> str:
    """The same judgement in SQL for the query's oracle; hyphens of terms become a word's sign."""
    # A term without hyphens is a whole word of the URL; one with them is searched for.
    rows = ", ".join(f"('{t.term}', '{t.stem}', {t.weight}, {t.strict})" for t in built_in())
    cases = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    fits = {r: f"(host = '{r[0]}' OR ends_with(host, '.{r[0]}')) AND starts_with(path, '{r[1]}')" for r in cases}
    return f"""
WITH parts AS (
  SELECT row_number() OVER () AS r, page_id,
    translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path,
    translate(regexp_extract(coalesce(url, ''), '^.*?://(.*)$', 1, 's'), '{UPPER}', '{LOWER}') AS u
  FROM {table}
), terms(term, stem, weight, strict) AS (
  VALUES {rows}
), found AS (
  SELECT DISTINCT r, stem, weight, strict FROM (SELECT r, unnest(regexp_split_to_array(u, '[^a-z0-9]+')) AS term FROM parts) JOIN terms USING (term)
  UNION SELECT r, stem, weight, strict FROM parts JOIN terms ON term LIKE '%-%' AND contains(u, term) AND regexp_matches(u, '(^|[^a-z0-9])' || term || '([^a-z0-9]|$)')
), scores AS (
  SELECT r, bool_or(strict) OR sum(weight) >= {LIMIT} AS rejected FROM (SELECT r, stem, max(weight) AS weight, bool_or(strict) AS strict FROM found GROUP BY ALL) GROUP BY r
), judged AS (
  SELECT page_id, host, path,
    CASE {" ".join(f"WHEN {fits[r]} THEN '{r[0]}{r[1]}'" for r in cases)} END AS rule,
    CASE {" ".join(f"WHEN {fits[r]} THEN '{r[2]}'" for r in cases)} END AS decision,
    coalesce(rejected, false) AS rejected
  FROM parts LEFT JOIN scores USING (r)
)
SELECT page_id, host, path, rule, coalesce(decision, CASE WHEN rejected THEN 'block' ELSE 'allow' END) AS verdict
FROM judged"""
