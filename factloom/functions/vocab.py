"""Closed vocabularies of the curation rules. Everything here is a fixed value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings of "nothing here".
NULL_TOKENS = (
    "", "n/a", "na", "n.a.", "none", "null", "-", "--", "not available", "not applicable",
    "not reported", "not specified", "unknown", "unspecified", "nd", "n/d",
)
#: Null spellings that are symbols in gene and protein columns.
RESCUED_SYMBOLS = ("na", "nd")

AMINO_THREE = {
    "ala": "A", "arg": "R", "asn": "N", "asp": "D", "cys": "C", "gln": "Q", "glu": "E", "gly": "G",
    "his": "H", "ile": "I", "leu": "L", "lys": "K", "met": "M", "phe": "F", "pro": "P", "ser": "S",
    "thr": "T", "trp": "W", "tyr": "Y", "val": "V", "ter": "*", "stop": "*", "sec": "U", "pyl": "O",
}
AMINO_NAMES = {
    "alanine": "A", "arginine": "R", "asparagine": "N", "aspartate": "D", "aspartic acid": "D", "aspartic-acid": "D",
    "cysteine": "C", "glutamine": "Q", "glutamate": "E", "glutamic acid": "E", "glutamic-acid": "E", "glycine": "G",
    "histidine": "H", "isoleucine": "I", "leucine": "L", "lysine": "K", "methionine": "M", "phenylalanine": "F",
    "proline": "P", "serine": "S", "threonine": "T", "tryptophan": "W", "tyrosine": "Y", "valine": "V",
    "selenocysteine": "U", "pyrrolysine": "O", "stop": "*", "termination": "*",
}
#: Signs of change.
ARROWS = ("->", "-->", "→", "⟶", ">")
BASE_NAMES = {"adenine": "A", "cytosine": "C", "guanine": "G", "thymine": "T", "thymidine": "T", "uracil": "U"}

SIR = {
    "s": "S", "susceptible": "S", "sensitive": "S", "susceptible (s)": "S", "i": "I", "intermediate": "I",
    "intermediate (i)": "I", "susceptible dose dependent": "I", "sdd": "I", "r": "R", "resistant": "R",
    "resistant (r)": "R", "nonsusceptible": "R", "non-susceptible": "R",
}
SALTS = (
    "sodium", "potassium", "hydrochloride", "hcl", "sulfate", "sulphate", "succinate", "mesylate", "tartrate",
    "trihydrate", "dihydrate", "monohydrate", "disc", "disk",
)
LINKAGES = {
    "n": "N-linked", "n linked": "N-linked", "nlinked": "N-linked", "n glycosylation": "N-linked", "n glycan": "N-linked",
    "n linked glycosylation": "N-linked", "asn linked": "N-linked", "o": "O-linked", "o linked": "O-linked",
    "olinked": "O-linked", "o glycosylation": "O-linked", "o glycan": "O-linked", "o linked glycosylation": "O-linked",
    "c mannosylation": "C-mannosylation", "c mannosylated": "C-mannosylation", "c linked": "C-mannosylation",
    "c mannose": "C-mannosylation",
}
LINKAGE_FILLERS = ("glycosylation", "glycosylated", "glycan", "site", "linked")
LINKAGE_RESIDUE = {"N-linked": "N", "C-mannosylation": "W"}
LINKAGE_NAMES = ("N-linked", "O-linked", "C-mannosylation")

INTERACTION_VERBS = ("binds", "cleaves", "inhibits", "activates", "degrades", "relocalizes")
INTERACTION_OF = {
    "binds": "binds", "bind": "binds", "binding": "binds", "bound": "binds", "interacts": "binds", "interacts with": "binds", "interaction": "binds",
    "associates": "binds", "associates with": "binds", "association": "binds", "complexes with": "binds", "physical interaction": "binds",
    "direct interaction": "binds", "co precipitates": "binds", "cleaves": "cleaves", "cleave": "cleaves", "cleavage": "cleaves", "cleaved": "cleaves",
    "proteolysis": "cleaves", "proteolytic cleavage": "cleaves", "processes": "cleaves", "inhibits": "inhibits", "inhibit": "inhibits",
    "inhibition": "inhibits", "blocks": "inhibits", "block": "inhibits", "suppresses": "inhibits", "suppression": "inhibits",
    "antagonizes": "inhibits", "antagonises": "inhibits", "impairs": "inhibits", "disrupts": "inhibits", "downregulates": "inhibits",
    "represses": "inhibits", "activates": "activates", "activate": "activates", "activation": "activates", "induces": "activates",
    "induction": "activates", "stimulates": "activates", "upregulates": "activates", "enhances": "activates", "promotes": "activates",
    "degrades": "degrades", "degrade": "degrades", "degradation": "degrades", "targets for degradation": "degrades",
    "promotes degradation": "degrades", "proteasomal degradation": "degrades", "ubiquitinates": "degrades", "relocalizes": "relocalizes",
    "relocalises": "relocalizes", "relocalization": "relocalizes", "relocalisation": "relocalizes", "mislocalizes": "relocalizes",
    "mislocalises": "relocalizes", "sequesters": "relocalizes", "sequestration": "relocalizes", "retains": "relocalizes",
    "redistributes": "relocalizes", "translocates": "relocalizes",
}

ASSERTIONS = ("measured", "inferred", "predicted", "reported", "disputed")
NOT_A_METHOD = ("measured", "reported", "inferred", "disputed")

#: Column classes, by lower-cased column name.
SUBJECT = (
    "organism", "pathogen", "species", "gene name", "gene", "protein", "protein a", "protein b", "strain", "isolate",
    "antibiotic", "drug", "antimicrobial", "agent", "genbank accession", "accession", "biosample", "viral protein",
    "host protein", "host organism", "site", "position", "residue",
)
REFERENCE = ("reference", "references", "citation", "citations", "source")
STATUS = ("assertion", "confidence", "evidence")
KEY_VALUE = ("mutation", "function", "interaction type", "site")
METHOD = ("method", "methods", "technique", "assay")
NOTATION = ("mutation", "variant", "allele")
SITE = ("site", "position", "residue")
LINKAGE = ("glycosylation type", "glycan type", "linkage")
SYMBOL = ("gene name", "gene", "protein", "protein a", "protein b", "viral protein", "host protein")
SPLITTABLE = (
    "gene name", "gene", "mutation", "variant", "allele", "protein", "antibiotic", "drug", "antimicrobial", "mic", "sir",
    "site", "position", "residue", "viral protein", "host protein",
)
TARGET_GENE = ("gene name", "gene", "protein", "protein a", "protein b", "viral protein")
ORGANISM = ("organism", "pathogen", "species")
HOST = ("host protein", "host organism")
EITHER_OR = ("mic", "sir")
KEY_GENE = ("gene name", "gene", "protein a", "protein b", "protein")
KEY_DRUG = ("antibiotic", "drug", "antimicrobial", "agent")
KEY_INTERACTION = ("interaction type", "interaction")
KEY_SIR = ("sir", "interpretation", "category", "phenotype (sir)")

#: Identity columns of each template.
IDENTITY = {
    "mutation": ("Organism", "Gene Name", "Mutation"),
    "protein-function": ("Organism", "Gene Name", "Function"),
    "ppi-extraction": ("Pathogen", "Protein A", "Protein B"),
    "ast": ("Organism", "Strain", "Antibiotic"),
    "glycosylation": ("Organism", "Protein", "Strain", "Site"),
    "host-virus": ("Organism", "Viral Protein", "Interaction Type", "Host Protein"),
}
SYMMETRIC = {"ppi-extraction": ("Protein A", "Protein B")}


def lookup(key: Column, table: dict[str, str]) -> Column:
    """Value of a literal map, or null. The map is one foldable call, so plans stay small."""
    pairs = ",".join(f"{k}:{v}" for k, v in table.items())
    return F.try_element_at(F.expr(f"str_to_map('{pairs}', ',', ':')"), key)
