"""Answering questions: hybrid retrieval, passages by document, context within a budget, prompts, models, logs."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import lexical, similarity

#: Hits before grouping, tokens kept for the frame of a prompt, and the least budget.
RETRIEVED, PROMPT_FRAME, LEAST_BUDGET = 60, 150, 500


def retrieve(docs: DataFrame, vectors: DataFrame, question: str, vector: list[float], k: int = RETRIEVED, weight: float = similarity.VECTOR_WEIGHT, scope: Column | None = None) -> DataFrame:
    """Hybrid hits (doc_id, score): weight 1 is vectors only, 0 is BM25 only. Scope holds before both top-k."""
    near = similarity.vector_topk(vectors, vector, k, "doc_id", keep=scope) if weight > 0 else None
    words = lexical.bm25_topk(docs, question, k, scope=scope) if weight < 1 else None
    if near is None or words is None:
        return near if words is None else words
    return similarity.rrf_fuse(near, words, k, weight).select("doc_id", "score")


def retrieve_grouped(chunks: DataFrame, chunk_vectors: DataFrame, parents: DataFrame, parent_vectors: DataFrame, question: str, vector: list[float], k: int = 5, per_parent: int = 5, weight: float = similarity.VECTOR_WEIGHT, min_score: float = 0.7, scope: Column | None = None) -> DataFrame:
    """Passages found both ways, by document: (parent_id, max_score, avg_score, n_chunks, chunks, text), at most k.

    Hits are cut to k * per_parent * 2 before they are grouped. Where a scope is given and no
    passage in it is found, its documents are searched by their own vectors instead. chunks:
    (chunk_id, parent_id, position, text); chunk_vectors: (chunk_id, parent_id, embedding); parents:
    (parent_id, text); parent_vectors: (parent_id, embedding); scope: a test of parent_id.
    """
    pool = max(k, RETRIEVED)
    near = similarity.vector_topk(chunk_vectors, vector, pool, "chunk_id", keep=scope, min_score=min_score) if weight > 0 else None
    words = lexical.bm25_topk(chunks, question, pool, "chunk_id", scope=scope) if weight < 1 else None
    hits = (near if words is None else words) if near is None or words is None else similarity.rrf_fuse(near, words, pool, weight, "chunk_id").select("chunk_id", "score")
    few = hits.orderBy(F.desc("score"), "chunk_id").limit(k * per_parent * 2)
    groups = similarity.group_chunks(few.join(chunks.select("chunk_id", "parent_id", "position", "text"), "chunk_id"), k, per_parent)
    found = join_parent(groups, parents)
    if scope is not None and found.isEmpty():
        whole = similarity.vector_topk(parent_vectors, vector, k, "parent_id", keep=scope, min_score=min_score).join(parents, "parent_id")
        chunk = F.struct(F.lit(0).alias("position"), F.col("parent_id").cast("string").alias("chunk_id"), "text", "score")
        return whole.select("parent_id", F.col("score").alias("max_score"), F.col("score").alias("avg_score"), F.lit(1).cast("long").alias("n_chunks"), F.array(chunk).alias("chunks"), "text")
    return found


def join_parent(groups: DataFrame, parents: DataFrame, parent: str = "parent_id", text: str = "text") -> DataFrame:
    """groups with text: that of their document, or the passages' joined by a space where it has none."""
    own = parents.select(parent, F.col(text).alias("_text"))
    passages = F.array_join(F.transform("chunks", lambda c: c["text"]), " ")
    return groups.join(own, parent, "left").select(*groups.columns, F.coalesce(F.nullif("_text", F.lit("")), passages).alias("text"))


def within_budget(hits: DataFrame, budget: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Hits (key, text, score) in order until the first that doesn't fit; adds rank, n_tokens and used. For top-k frames."""
    by = Window.orderBy(F.desc("score"), key)
    sized = hits.withColumn("rank", F.row_number().over(by)).withColumn("n_tokens", T.prompt_tokens(F.col(text)))
    return sized.withColumn("used", F.sum("n_tokens").over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))).filter(F.col("used") < budget)


def context(hits: DataFrame, fields: tuple[str, ...] = (), text: str = "text") -> DataFrame:
    """One row: the ranked hits as numbered passages with their fields."""
    meta = F.concat_ws(", ", *(F.concat(F.lit(f"{f}: "), F.col(f).cast("string")) for f in fields))
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col(text), F.when(meta != "", F.concat(F.lit("\n   ("), meta, F.lit(")"))).otherwise(F.lit("")))
    lines = F.array_sort(F.collect_list(F.struct("rank", line.alias("line"))))
    return hits.agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n\n").alias("context"))


def context_budget(window: int, system: str, max_tokens: int) -> int:
    """Tokens that are left for passages."""
    return max(LEAST_BUDGET, window - -(-len(system) * 11 // 35) - PROMPT_FRAME - max_tokens)


def prompt(template: str, context_text: str, question: str) -> str:
    """The first {context} and the first {question} replaced, as they are."""
    return template.replace("{context}", context_text, 1).replace("{question}", question, 1)


def turns(conversations: DataFrame) -> DataFrame:
    """Per conversation: turns, and roles in order of turn."""
    listed = F.array_sort(F.collect_list(F.struct("turn", "role")))
    return conversations.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.array_join(F.transform(listed, lambda x: x["role"]), "|").alias("roles"))


def passages_in_budget(groups: DataFrame, budget: int, fields: Column | None = None, parent: str = "parent_id") -> DataFrame:
    """One row (context, tokens_used, limited): documents in order of max_score with those of their passages that fit.

    A document's passages end at the first that doesn't fit; later documents are still tried. A
    single passage of over 0.3 of the budget is cut into pieces of 0.15, of which three are tried.
    Headers and fields are not counted. For top-k frames: all groups meet in one row.
    """
    big = (F.size("chunks") == 1) & (T.prompt_tokens(F.col("chunks")[0]["text"]) > budget * 0.3)
    pieces = F.when(big, F.slice(T.rechunk(F.col("chunks")[0]["text"], max(1, int(budget * 0.15))), 1, 3)).otherwise(F.transform("chunks", lambda c: c["text"]))
    head = F.coalesce(fields, F.lit("")) if fields is not None else F.lit("")
    by = Window.orderBy(F.desc("max_score"), parent)
    rows = groups.select(F.row_number().over(by).alias("n"), head.alias("head"), pieces.alias("pieces"))
    listed = rows.agg(F.array_sort(F.collect_list(F.struct("n", "head", "pieces"))).alias("groups"))

    def line(state: Column, piece: Column) -> Column:
        text = F.concat(F.lit("\n   » "), piece)
        used = state["used"] + T.prompt_tokens(text)
        fits = ~state["stopped"] & (used < budget)
        return F.struct(F.when(fits, F.concat(state["text"], text)).otherwise(state["text"]).alias("text"), F.when(fits, used).otherwise(state["used"]).alias("used"), (state["stopped"] | ~fits).alias("stopped"), (state["limited"] | ~fits).alias("limited"))

    def document(state: Column, g: Column) -> Column:
        title = F.concat(F.when(state["text"] == "", F.lit("")).otherwise(F.lit("\n\n")), F.lit("\n[Document "), g["n"].cast("string"), F.lit("]"), F.when(g["head"] != "", F.concat(F.lit("\n   Metadata: "), g["head"])).otherwise(F.lit("")), F.lit("\n   Relevant passages:"))
        begin = F.struct(F.concat(state["text"], title).alias("text"), state["used"].alias("used"), F.lit(False).alias("stopped"), state["limited"].alias("limited"))
        return F.aggregate(g["pieces"], begin, line)

    none = F.struct(F.lit("").alias("text"), F.lit(0).cast("long").alias("used"), F.lit(False).alias("stopped"), F.lit(False).alias("limited"))
    done = listed.select(F.aggregate("groups", none, document).alias("s"))
    return done.select(F.col("s.text").alias("context"), F.col("s.used").alias("tokens_used"), F.col("s.limited").alias("limited"))


@dataclass(frozen=True)
class ModelLimits:
    """What a language model takes. Defaults hold for small instruction models."""

    temperature: tuple[float, float] = (0.0, 2.0)
    max_tokens: tuple[int, int] = (1, 8192)
    context_window: int = 8192
    thinks: bool = False


def clamped(limits: ModelLimits, temperature: float, max_tokens: int) -> tuple[float, int]:
    """Both within the model's range; models that think get three times the tokens, as far as the range goes."""
    t = max(limits.temperature[0], min(limits.temperature[1], temperature))
    n = max(limits.max_tokens[0], min(limits.max_tokens[1], max_tokens))
    return t, min(3 * n, limits.max_tokens[1]) if limits.thinks else n


class LanguageModel(Protocol):
    """What answers need of a model."""

    name: str
    limits: ModelLimits

    def stream(self, prompt_text: str, temperature: float, max_tokens: int) -> Iterable[str]: ...


class Extract:
    """Stands in for a model: answers with the first sentences of the prompt's passages."""

    name, limits = "extract", ModelLimits()

    def stream(self, prompt_text: str, temperature: float, max_tokens: int) -> Iterable[str]:
        passages = re.findall(r"(?:» |\[\d+\] )([^\n]*)", prompt_text)
        for k, p in enumerate(passages[:3]):
            yield (" " if k else "") + re.split(r"(?<=[.!?])\s", p, maxsplit=1)[0][: 4 * max_tokens]


def without_thoughts(pieces: Iterable[str]) -> Iterator[str]:
    """The pieces of a stream without what stands between think tags, also where a tag is cut between pieces."""
    held, thinking = "", False
    for piece in pieces:
        held += piece
        while True:
            tag = "</think>" if thinking else "<think>"
            at = held.find(tag)
            if at < 0:
                break
            if not thinking and at:
                yield held[:at]
            held, thinking = held[at + len(tag) :], not thinking
        tag = "</think>" if thinking else "<think>"
        keep = next((n for n in range(min(len(held), len(tag) - 1), 0, -1) if tag.startswith(held[-n:])), 0)
        if not thinking and len(held) > keep:
            yield held[: len(held) - keep]
        held = held[len(held) - keep :] if keep else ""
    if held and not thinking:
        yield held


@dataclass(frozen=True)
class Answer:
    text: str
    sources: DataFrame
    tokens_used: int
    limited: bool


#: Fixed value: how a hypothetical answer is asked for.
HYPOTHESIS = "Write a short factual paragraph that could answer this question:"


def hypothesis(question: str, model: LanguageModel, temperature: float = 0.2, max_tokens: int = 256) -> str:
    """A made-up answer, to be embedded in place of the question; prompt and BM25 still take the question."""
    said = "".join(without_thoughts(model.stream(f"{HYPOTHESIS}\n{question}", *clamped(model.limits, temperature, max_tokens))))
    return said.strip() or question


def answer(question: str, groups: DataFrame, model: LanguageModel, template: str, system: str = "", temperature: float = 0.5, max_tokens: int = 768) -> Answer:
    """The model's answer from retrieved groups; only the context, of at most the model's window, reaches the driver."""
    t, n = clamped(model.limits, temperature, max_tokens)
    packed = passages_in_budget(groups, context_budget(model.limits.context_window, system, n)).first()
    text = "".join(without_thoughts(model.stream(prompt(template, packed["context"], question), t, n))).strip()
    return Answer(text, groups.select("parent_id", "max_score"), packed["tokens_used"], packed["limited"])


def log_answer(path: str, question: str, said: Answer, model: LanguageModel, temperature: float) -> None:
    """Appends a question to the conversation's table: (timestamp, query, answer, sources, model, temperature)."""
    ids = said.sources.agg(F.array_sort(F.collect_list(F.struct(-F.col("max_score"), F.col("parent_id").cast("string").alias("id")))).alias("s"))
    row = ids.select(F.current_timestamp().cast("string").alias("timestamp"), F.lit(question).alias("query"), F.lit(said.text).alias("answer"), F.transform("s", lambda x: x["id"]).alias("sources"), F.lit(model.name).alias("model"), F.lit(temperature).alias("temperature"))
    row.coalesce(1).write.mode("append").parquet(path)


def semantic_k(k: int, allowed: tuple[int, ...] = (5, 10, 20, 50)) -> int:
    """k if it is one that is offered, else 10."""
    return k if k in allowed else 10
