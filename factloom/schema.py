"""Schemas of the data model."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

METADATA = (
    "struct<title:string,journal:string,year:int,authors:array<string>,pmid:string,pmcid:string,doi:string,"
    "start_char:int,end_char:int,prev_chunk_id:string,next_chunk_id:string,keywords:array<string>,content_type:string,"
    "doc_type:string,filename:string,source_path:string,source_url:string,licence:string,publisher:string,n_citations:int>"
)
#: A retrieved passage; source_rank is its marker, from 1.
SOURCE = f"query_id string, source_rank int, doc_id string, chunk_id string, content string, score double, collection string, metadata {METADATA}"
CHUNK = "struct<marker:int,chunk_id:string,doc_id:string,start_char:int,end_char:int,score:double>"
CITATION = (
    "struct<marker:int,pmid:string,pmcid:string,doi:string,journal:string,year:string,title:string,first_author:string,"
    f"resolved:boolean,matched_by:string,chunks:array<{CHUNK}>>"
)
SPEC = (
    "query_id string, spec_ord bigint, organism string, genes string, other_terms string, data_type string, top_k int, "
    "collection string, retrieval_mode string, keep_empty boolean, instructions string"
)
ANSWER = "query_id string, answer string, model string, truncated boolean, elapsed_s double, error string"
COLLECTION = "id string, label string, count bigint, chunk_method string, state string"
CATALOG = "subtype string, allele string, gene_family string, whitelisted_taxa string"


def struct_of(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)  # noqa: SLF001


@dataclass(frozen=True)
class Slot:
    name: str
    required: bool = False
    max_len: int = 200
    label: str = ""


STANDARD_SLOTS = (Slot("organism", True, 120), Slot("genes", False, 200), Slot("other_terms", False, 200))


@dataclass(frozen=True)
class Template:
    """A data type: its columns, what identifies a fact, and what a row must have."""

    id: str
    label: str = ""
    output: str = "table"
    version: int = 1
    hash: str = ""
    columns: tuple[str, ...] = ()
    required: tuple[str, ...] = ()
    max_output_tokens: int | None = None
    slots: tuple[Slot, ...] = field(default=STANDARD_SLOTS)
    source: str = "server"
    guidance: tuple[str, ...] = ()

    @property
    def is_table(self) -> bool:
        return self.output == "table" and bool(self.columns)
