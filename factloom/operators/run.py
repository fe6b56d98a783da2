"""A whole curation run: specs and passages to facts.

Retrieval, the context budget, prompts, generation, parsing, citations, merging and
provenance, joined by query id. What the budget leaves out isn't a source: markers are
resolved among the passages that the generator saw. Answers are staged as soon as they are
made, so nothing that comes later asks the generator again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators import batch, context, export, extract, merge, retrieve
from factloom.operators import citations as C
from factloom.schema import Template
from factloom.session import spread, stage


@dataclass(frozen=True)
class Curation:
    """How a data type is curated.

    complete: the generator, as for `batch.generate`. window: its context in tokens.
    filters: as for `retrieve.wanted`. known: statistics of the corpus that the passages
    are a part of.
    """

    template: Template
    complete: Callable[[str, int], dict]
    window: int = 60_000
    filters: dict = field(default_factory=dict)
    known: retrieve.Statistics | None = None
    at_once: int = 4
    instructions: str = ""

    def sources(self, specs: DataFrame, passages: DataFrame) -> DataFrame:
        """Each spec's best passages (at most its top_k) that fit the budget, with their blocks.

        passages: doc_id, chunk_id, content, collection, metadata.
        """
        own = passages.filter(retrieve.wanted(self.filters))
        text = context.search_text(F.col("organism"), F.col("genes"), F.col("other_terms"), self.template)
        asked = specs.select("query_id", text.alias("search_text"))
        most = max(specs.agg(F.max("top_k")).first()[0] or 0, 1)
        best = retrieve.bm25_top(own, asked, most, known=self.known).join(specs.select("query_id", "top_k"), "query_id").filter("source_rank <= top_k")
        # Staged, so that Spark knows how few they are, and no passage's text is shuffled to meet them.
        found = stage(best.drop("top_k"), "run-ranked").join(own.select("chunk_id", "doc_id", "content", "collection", "metadata"), "chunk_id")
        block = context.source_block(F.col("source_rank"), F.col("metadata.title"), F.col("metadata.pmid"), F.col("metadata.doi"), F.col("content"))
        sized = found.withColumns({"block": block, "n_sources": F.count("*").over(Window.partitionBy("query_id"))}).withColumn("block_chars", F.char_length("block"))
        room = context.context_chars(context.context_tokens(self.window, context.output_tokens(self.template, F.col("n_sources"))))
        return context.within_budget(sized.withColumn("room", room), "block_chars", "room").drop("block_chars", "room", "n_sources")

    def prompts(self, specs: DataFrame, sources: DataFrame) -> DataFrame:
        """query_id and prompt of the specs that have sources."""
        about = context.subject(F.col("organism"), F.col("genes"), F.col("other_terms"))
        told = F.lit(self.instructions) if self.instructions else None
        made = specs.join(context.contexts(sources), "query_id")
        return made.select("query_id", context.prompt(self.template, about, F.col("context"), F.col("n_included"), told).alias("prompt"))

    def answers(self, prompts: DataFrame) -> DataFrame:
        """Staged answers with the hash of their prompt and the time they were made."""
        most = self.template.max_output_tokens or context.DEFAULT_OUTPUT_TOKENS
        made = batch.generate(spread(prompts, "query_id"), self.complete, max_tokens=most, at_once=self.at_once)
        hashed = prompts.select("query_id", context.prompt_hash(F.col("prompt")).alias("_prompt_hash"))
        return stage(made.join(hashed, "query_id").withColumn("_retrieved_at", export.now()), "run-answers")

    def rows(self, specs: DataFrame, passages: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Stamped rows of all answers, as the parser leaves them, and the answers."""
        sources = stage(self.sources(specs, passages), "run-sources")
        answers = self.answers(self.prompts(specs, sources))
        joined = answers.filter("answer IS NOT NULL").select("query_id", "answer").join(specs.select("query_id", "spec_ord", "genes"), "query_id")
        given = C.with_sources(joined, sources)
        rows = extract.kept(extract.extract_table(given, self.template)) if self.template.is_table else extract.extract_text(given)
        record = answers.join(specs.select("query_id", "top_k", "collection"), "query_id").select(
            "query_id", F.lit(self.template.id).alias("_template"), F.lit(self.template.version).alias("_template_version"), F.lit(self.template.hash).alias("_template_hash"),
            F.col("model").alias("_model"), F.col("collection").alias("_collection"), F.col("top_k").alias("_top_k"), F.lit("bm25").alias("_retrieval_mode"), "_retrieved_at", "_prompt_hash", F.lit("local").alias("_generator"),
        )
        return export.stamped(rows.withColumn("query_ids", F.array("query_id")), record), answers

    def facts(self, specs: DataFrame, passages: DataFrame, *, listed: bool = True) -> DataFrame:
        """Merged facts of a table template over all specs."""
        rows, _ = self.rows(specs, passages)
        return merge.merge_facts(stage(rows, "run-rows"), self.template.id, self.template.columns, listed=listed)
