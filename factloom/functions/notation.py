"""A reader of mutation notations: a cell becomes lexemes, each with a class and a code.

Forms are then told by the row of classes (the shape), one character for each lexeme, and
their values are taken by place. Nothing here depends on the order of the forms tried.

Classes: A three-letter residue, M residue name, B base name, L single letter, N number,
T word or arrow of change, P "at", Q word of position, Z "amino acid", R non-coding region,
W any other word; punctuation stands for itself. White space only separates.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions import vocab
from factloom.functions.text import let

LEXEME = "(?i)(?:aspartic|glutamic|amino)[ -]acid|-{1,2}>|\\p{L}+|\\d+|\\S"
#: Class and code of every known lexeme, in lower case.
LEXICON = (
    {word: "M" + code for word, code in vocab.AMINO_NAMES.items()}
    | {word: "A" + code for word, code in vocab.AMINO_THREE.items()}
    | {word: "B" + code for word, code in vocab.BASE_NAMES.items()}
    | {word: "T" for word in ("to", "into", "by", "for", *vocab.ARROWS)}
    | {"at": "P", "position": "Q", "codon": "Q", "residue": "Q", "amino acid": "Z"}
    | {word: "R" for word in ("utr", "nc", "promoter", "intron")}
    | {"–": "-", "_": "-"}
)


def read(token: Column) -> Column:
    """struct(shape, codes) of a text."""
    def entry(lexeme: Column) -> Column:
        kind = F.when(lexeme.rlike("^\\d"), "N").when(~lexeme.rlike("^\\p{L}"), "").when(F.length(lexeme) == 1, "L").otherwise("W")
        return F.coalesce(vocab.lookup(F.lower(lexeme), LEXICON), F.concat(kind, F.upper(lexeme)))

    entries = F.transform(F.regexp_extract_all(token, F.lit(LEXEME), F.lit(0)), entry)
    return let(
        entries,
        lambda e: F.struct(F.array_join(F.transform(e, lambda x: F.left(x, F.lit(1))), "").alias("shape"), F.transform(e, lambda x: F.substr(x, F.lit(2))).alias("codes")),
    )


def code(seen: Column, place: int) -> Column:
    """Code of the lexeme at a place, from 1; from the end where it is negative."""
    return F.try_element_at(seen["codes"], F.lit(place))


def _last(seen: Column, classes: str) -> Column:
    """Code of the last lexeme of some classes."""
    return F.element_at(seen["codes"], F.length(F.regexp_extract(seen["shape"], f"^.*[{classes}]", 0)))


def is_shape(seen: Column, pattern: str) -> Column:
    return seen["shape"].rlike(f"^(?:{pattern})$")


def whole_number(digits: Column) -> Column:
    """Digits without leading zeros; a minus sign stays, except before zero."""
    plain = F.regexp_replace(digits, "^(-?)0+(?=\\d)", "$1")
    return F.when(plain == "-0", "0").otherwise(plain)


def _position(seen: Column, negative: Column) -> Column:
    return whole_number(F.concat(F.when(negative, "-").otherwise(""), _last(seen, "N")))


#: What may stand before a hyphen or colon and a position: a protein or a region.
QUALIFIER = "(?:[A-Z'’/]{1,8}[-:])?"
CHANGE = "-?T-?"
#: Where a hyphen before the position is its sign, not a separator.
SIGNED = "(?:^|[PQZ:-])-N[^N]*$|-N$"
RESIDUES_IN_WORDS = (
    f"P?[QZ]-?N,*[AM]{CHANGE}[AM]|{QUALIFIER}-?N,*[AM]{CHANGE}[AM]"  # the position first
    f"|[AM]-{{0,2}}N{CHANGE}[AM]"  # inside
    f"|[AM]{CHANGE}[AM]P?Q?-?N"  # last
)
BASES_IN_WORDS = f"{QUALIFIER}-?N,?[BL]{CHANGE}[BL]"


def in_words(seen: Column) -> Column:
    """Canonical form of a change that words or an arrow tell, or null."""
    sites, swapped = F.regexp_replace(seen["shape"], "[^ABLM]", ""), seen["shape"].rlike(SIGNED)
    changed = F.filter(F.arrays_zip(F.split(seen["shape"], "").alias("k"), seen["codes"].alias("c")), lambda x: x["k"].isin("A", "B", "L", "M"))
    ref, alt = F.try_element_at(changed, F.lit(-2))["c"], F.try_element_at(changed, F.lit(-1))["c"]
    spelled = F.left(F.right(sites, F.lit(2)), F.lit(1)) == "B"
    bases = is_shape(seen, BASES_IN_WORDS) & ref.isin(*"ACGTU") & alt.isin(*"ACGTU") & (spelled | F.contains(seen["shape"], F.lit("R")))
    place = _position(seen, swapped)
    told = F.when(bases, F.concat(F.lit("n"), place, alt)).when(is_shape(seen, RESIDUES_IN_WORDS), F.concat(ref, place, alt))
    return F.when(F.contains(seen["shape"], F.lit("T")), told)


def substitution(token: Column, seen: Column) -> Column:
    """Residue, number, residue without white space, or null."""
    fits = is_shape(seen, "(?:L\\.)?[AL*]N[AL*]") & ~F.contains(token, F.lit(" ")) & (~F.contains(seen["shape"], F.lit(".")) | (code(seen, 1) == "P"))
    symbol = lambda at: F.when(F.substring(seen["shape"], at, 1) == "*", "*").otherwise(code(seen, at))
    return F.when(fits, F.concat(symbol(-3), whole_number(code(seen, -2)), symbol(-1)))


def base_change(token: Column, seen: Column) -> Column:
    """Bases around a position: in lower case, before the start, or in coding notation; else null."""
    base = lambda at: code(seen, at).isin(*"ACGT")
    negative = F.contains(seen["shape"], F.lit("-N"))
    plain = is_shape(seen, "L-?NL") & base(1) & base(-1) & ((F.lower(token) == token) | (negative & ~code(seen, -2).rlike("^0+$")))
    coding = is_shape(seen, "L\\.-?N(?:LT)?L") & (code(seen, 1) == "C") & base(-1)
    return F.when(plain | coding, F.concat(F.lit("n"), _position(seen, negative), code(seen, -1)))


def is_notation(canonical: Column) -> Column:
    """Whether a canonical form names a change of one place."""
    return canonical.rlike("^(?:n|\\p{Lu})-?[0-9]+(?:\\p{Lu}|\\*)$")
