"""Templates (data types): declarations, aliases, slots and hashes. Driver-side metadata."""

from __future__ import annotations

import hashlib
import json
import tomllib
from collections.abc import Iterable, Sequence
from dataclasses import replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.schema import STANDARD_SLOTS, Slot, Template

#: Other names of the data types; fixed values.
ALIASES = {
    "ast": "ast", "susceptibility": "ast", "amr": "ast", "mic": "ast",
    "host-virus": "host-virus", "host_virus": "host-virus", "virus-host": "host-virus", "virus_host": "host-virus", "hvi": "host-virus",
    "host": "host-virus",
    "glyco": "glycosylation", "glycan": "glycosylation", "glycosite": "glycosylation", "glycosites": "glycosylation",
    "glycosylation_sites": "glycosylation",
    "ppi": "ppi-extraction", "protein_function": "protein-function", "protein-function": "protein-function", "function": "protein-function",
    "mutation": "mutation", "mutations": "mutation",
    "summary": "literature-summary", "literature_summary": "literature-summary", "none": "literature-summary",
}
#: Columns of the data types; fixed values.
COLUMNS = {
    "mutation": ("Organism", "Gene Name", "Mutation", "Phenotype", "Assertion", "Reference"),
    "ppi-extraction": ("Pathogen", "Protein A", "Protein B", "Interaction Type", "Method", "Assertion", "Reference"),
    "protein-function": ("Organism", "Gene Name", "Function", "Assertion", "Reference"),
    "ast": ("Organism", "Strain", "GenBank Accession", "BioSample", "Antibiotic", "MIC", "SIR", "Reference"),
    "glycosylation": ("Organism", "Protein", "Strain", "Site", "Glycosylation Type", "Glycan", "Method", "Effect", "Assertion", "Reference"),
    "host-virus": (
        "Organism", "Viral Protein", "Interaction Type", "Host Protein", "Host Organism", "Biological Consequence", "Method", "Assertion",
        "Reference",
    ),
}

SERVER = (
    Template("literature-summary", "Literature summary", "text", 1),
    Template("mutation", "mutations and their phenotypes", "table", 2, columns=COLUMNS["mutation"], max_output_tokens=2500),
    Template("ppi-extraction", "protein-protein interactions", "table", 2, columns=COLUMNS["ppi-extraction"], max_output_tokens=2500),
    Template("protein-function", "protein functions", "table", 2, columns=COLUMNS["protein-function"], max_output_tokens=2500),
)
BUILTIN = (
    Template("ast", "antimicrobial susceptibility tests", columns=COLUMNS["ast"], max_output_tokens=3000, source="local", guidance=(
        "Give each pair of a strain and a drug a row of its own.",
        "Copy the MIC with its unit and inequality sign; never convert it.",
        "SIR holds the category alone, and is not derived from the MIC.",
    )),
    Template("glycosylation", "glycosylation sites", columns=COLUMNS["glycosylation"], max_output_tokens=3000, source="local", guidance=(
        "Give each site a row of its own, with its residue and position as published.",
        "Glycosylation Type is the linkage: N-linked, O-linked or C-mannosylation.",
    )),
    Template("host-virus", "interactions of viral with host proteins", columns=COLUMNS["host-virus"], max_output_tokens=3000, source="local",
             required=("Viral Protein", "Interaction Type", "Host Protein"), guidance=(
        "The viral protein acts on the host protein; keep that direction.",
        "Interaction Type is one of: binds, cleaves, inhibits, activates, degrades, relocalizes.",
    )),
)


class TemplateError(ValueError):
    """An unknown template or unusable slot values."""


def declaration_hash(template: Template) -> str:
    """First 16 hex digits of the SHA-256 of the declaration without its hash."""
    said = {
        "id": template.id, "label": template.label, "output": template.output, "version": template.version, "columns": template.columns,
        "required": template.required, "max_output_tokens": template.max_output_tokens, "guidance": template.guidance,
        "slots": [vars(s) for s in template.slots], "source": template.source,
    }
    return hashlib.sha256(json.dumps(said, sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:16]


def finished(template: Template) -> Template:
    named = replace(template, label=template.label or template.id)
    return replace(named, hash=declaration_hash(named))


def from_mapping(said: dict, source: str = "local") -> Template:
    slots = tuple(Slot(s["name"], bool(s.get("required")), s.get("max_len") or 200, s.get("label") or "") for s in said.get("slots", []))
    return Template(
        said["id"], said.get("label") or said["id"], said.get("output", "table"), said.get("version", 1), said.get("hash", ""),
        tuple(said.get("columns") or ()), tuple(said.get("required") or ()), said.get("max_output_tokens"), slots or STANDARD_SLOTS,
        source, tuple(said.get("guidance") or ()),
    )


def user_templates(path: str | Path | None) -> list[Template]:
    """[[templates]] of a TOML file that have an id; a missing or broken file has none."""
    try:
        found = tomllib.loads(Path(path).read_text(encoding="utf-8")).get("templates", []) if path else []
    except (OSError, ValueError):
        return []
    return [from_mapping(t) for t in found if isinstance(t, dict) and t.get("id")]


def local_templates(path: str | Path | None = None) -> list[Template]:
    """Built-in declarations, then the user's; a built-in wins an id."""
    own = {t.id: t for t in user_templates(path)}
    return [finished(t) for t in (*BUILTIN, *[t for i, t in own.items() if i not in {b.id for b in BUILTIN}])]


class Registry:
    """All templates; the server's win ids that both declare."""

    def __init__(self, server: Iterable[Template] = SERVER, local: Iterable[Template] | None = None):
        self.templates = {t.id: finished(t) if not t.hash else t for t in server}
        for t in local_templates() if local is None else local:
            self.templates.setdefault(t.id, t)

    @property
    def ids(self) -> list[str]:
        return sorted(self.templates)

    def resolve(self, name: str | None) -> Template:
        """By id, then alias, then id in any case."""
        key = (name or "").strip()
        if not key:
            raise TemplateError("no data type given")
        for found in (key, ALIASES.get(key.lower().replace(" ", "_")), next((i for i in self.templates if i.lower() == key.lower()), None)):
            if found in self.templates:
                return self.templates[found]
        raise TemplateError(f"unknown data type '{name}'. Available: {', '.join(self.ids)}")

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(t.id, t.label, t.output, t.version, t.hash, list(t.columns), t.max_output_tokens, t.source, list(t.required)) for t in self.templates.values()]
        return spark.createDataFrame(
            rows, "id string, label string, output string, version int, hash string, columns array<string>, max_output_tokens int, source string, required array<string>"
        )


def union_templates(server: DataFrame, local: DataFrame) -> DataFrame:
    """Server declarations, and the local ones whose ids the server doesn't have."""
    return server.unionByName(local.join(server.select("id"), "id", "left_anti"), allowMissingColumns=True)


def resolve_names(specs: DataFrame, templates: DataFrame, name: str = "data_type") -> DataFrame:
    """Adds template_id: by id, then alias, then id in any case; null where nothing fits."""
    ids = templates.select(F.col("id"), F.lower("id").alias("_low")).dropDuplicates(["id"])
    # A handful of templates; the optimizer broadcasts them by their size.
    alias = F.try_element_at(F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair]), F.replace(F.lower(F.trim(name)), F.lit(" "), F.lit("_")))
    keyed = specs.withColumns({"_key": F.trim(F.col(name)), "_alias": alias, "_lowered": F.lower(F.trim(F.col(name)))})
    for k, test in enumerate(("_key", "_alias")):
        keyed = keyed.join(ids.select(F.col("id").alias(f"_id{k}")), F.col(test) == F.col(f"_id{k}"), "left")
    lowered = ids.groupBy("_low").agg(F.min("id").alias("_id2"))
    keyed = keyed.join(lowered, F.col("_lowered") == F.col("_low"), "left")
    return keyed.withColumn("template_id", F.coalesce("_id0", "_id1", "_id2")).select(*specs.columns, "template_id")


def validate_slots(template: Template, values: dict[str, str | None]) -> dict[str, str]:
    """Trimmed non-blank values; unknown, missing and too long ones are errors."""
    known = {s.name for s in template.slots}
    unknown = sorted(set(values) - known)
    if unknown:
        raise TemplateError(f"template '{template.id}' has no slot(s): {', '.join(unknown)}. Available: {', '.join(sorted(known)) or 'none'}")
    kept = {}
    for slot in template.slots:
        value = (values.get(slot.name) or "").strip()
        if not value and slot.required:
            raise TemplateError(f"template '{template.id}' requires a value for '{slot.name}' ({slot.label or slot.name})")
        if slot.max_len and len(value) > slot.max_len:
            raise TemplateError(f"'{slot.name}' is {len(value)} characters; template '{template.id}' allows at most {slot.max_len}")
        if value:
            kept[slot.name] = value
    return kept


def slot_errors(specs: DataFrame, slots: Sequence[Slot] = STANDARD_SLOTS) -> DataFrame:
    """query_id and error of every spec that fails; empty where all are usable."""
    problems = []
    for s in slots:
        value = F.trim(F.coalesce(F.col(s.name), F.lit("")))
        if s.required:
            problems.append(F.when(value == "", F.lit(f"'{s.name}' is required")))
        problems.append(F.when(F.length(value) > s.max_len, F.lit(f"'{s.name}' is longer than {s.max_len} characters")))
    found = specs.withColumn("errors", F.array_compact(F.array(*problems)))
    return found.filter(F.size("errors") > 0).select("query_id", F.array_join("errors", "; ").alias("error"))


def fold_instructions(other_terms: str, instructions: str, limit: int = 200) -> str:
    """Instructions appended to the search terms, where they fit."""
    joined = "; ".join(x.strip() for x in (other_terms, instructions) if x and x.strip())
    if len(joined) > limit:
        raise TemplateError(f"instructions are too long: {limit - len(other_terms.strip()) - 2} characters are left")
    return joined
