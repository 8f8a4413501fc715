"""One object over the operators: load a table, prepare it, look at the map, search, ask, filter, export."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config
from .functions import text as T
from .operators import filters, lexical, points, prepare, rag, similarity
from .sources import datasets, readers


@dataclass
class Engine:
    """Tables of one collection and what is done with them. Every method gives a plan; nothing is collected but answers."""

    spark: SparkSession
    config: Config = field(default_factory=Config)
    filters: filters.Filters = field(default_factory=dict)
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def columns(self, path: str) -> tuple[list[str], DataFrame, int]:
        """Of an uploaded table: columns, first rows, count."""
        return readers.preview(readers.load_table(self.spark, path))

    def process(self, table: DataFrame, text: str, ordinal: str, as_given: bool = False) -> DataFrame:
        """Documents of a table: filled, each text once; and their passages.

        as_given: only null texts are left out, and texts are the same if they differ by space separators around them alone.
        """
        docs = prepare.extract_documents(table, text, ordinal, as_given).drop("has_empty_text")
        docs = docs.filter(F.col("text").isNotNull()) if as_given else prepare.drop_empty(docs)
        docs = prepare.dedupe_exact(docs, order="original_index", spaces=T.SEPARATORS if as_given else T.SPACES).drop("doc_id").withColumnRenamed("id", "doc_id")
        c = self.config.values["chunking"]
        whole = c["chunk_size"] if c["enabled"] else 1 << 30
        self.tables |= {"documents": docs, "chunks": prepare.chunk(docs, size=whole, overlap=c["chunk_overlap"] if c["enabled"] else 0, least=c["min_chunk_size"])}
        return docs

    def visualization(self, metadata: list[str]) -> DataFrame:
        """Map points; needs tables projection (doc_id, x, y) and clusters (doc_id, cluster, cluster_probability)."""
        return points.map_points(self.tables["documents"], self.tables["projection"], self.tables["clusters"], metadata)

    def delete_all(self, root: str) -> None:
        datasets.clear(self.spark, root)

    def set_filters(self, wanted: filters.Filters) -> str:
        """Keeps the filters for searches and questions; their summary in words."""
        self.filters = wanted
        return filters.summarize(wanted)

    def _filtered(self) -> DataFrame:
        return filters.apply_filters(self.tables["documents"], self.filters)

    def search(self, query: str, kind: str = "fast", k: int = 10, vector: list[float] | None = None) -> DataFrame:
        """Hits (doc_id, score) of the documents that the filters let through: fast, boolean, bm25 or semantic."""
        docs = self.tables["documents"]
        if kind == "semantic":
            if vector is None:
                raise ValueError("a semantic search needs the query's vector")
            rows = self.tables["embeddings"]
            rows = filters.in_scope(rows, self._filtered().select("doc_id")) if self.filters else rows
            return similarity.vector_topk(rows, vector, rag.semantic_k(k), "doc_id")
        if kind == "bm25":
            return lexical.bm25_topk(docs, query, k, scope=filters.condition(docs, self.filters) if self.filters else None)
        if lexical.is_boolean(query):
            return lexical.boolean_scores(self._filtered(), query, k)
        return lexical.fast_search(self._filtered(), query, k).select("doc_id", "score")

    def query(self, question: str, vector: list[float], model: rag.LanguageModel, template: str, lasso: DataFrame | None = None) -> rag.Answer:
        """An answer from the lasso's documents, else the filtered ones, else all."""
        s, docs, chunks = self.config.values["search"], self.tables["documents"], self.tables["chunks"]
        kind, ids = points.resolve_scope(lasso, None, docs, filters.condition(docs, self.filters) if self.filters else None)
        vectors = self.tables["chunk_embeddings"]
        parents = docs.select(F.col("doc_id").alias("parent_id"), "text")
        whole = self.tables["embeddings"].withColumnRenamed("doc_id", "parent_id")
        if ids is not None:
            chunks, vectors, parents, whole = (filters.in_scope(t, ids, "parent_id") for t in (chunks, vectors, parents, whole))
        groups = rag.retrieve_grouped(chunks, vectors, parents, whole, question, vector, s["num_results"], weight=s["vector_weight"], min_score=s["similarity_threshold"], scope=None if ids is None else F.lit(True))
        return rag.answer(question, groups, model, template, temperature=self.config.get("llm.temperature"), max_tokens=self.config.get("llm.max_tokens"))

    def configuration(self, changes: dict[str, Any] | None = None) -> dict[str, Any]:
        """The settings, after changes by dotted path."""
        for path, value in (changes or {}).items():
            self.config.set(path, value)
        return self.config.values

    def metadata_schema(self, nulls: bool = True) -> DataFrame:
        docs = self.tables["documents"]
        return prepare.metadata_schema_api(docs, [c for c in docs.columns if c not in ("doc_id", "text", "original_index")], "original_index", nulls=nulls)
