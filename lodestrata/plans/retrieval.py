"""Hybrid retrieval of a batch of queries as one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.text import base_name, technical_tokens
from lodestrata.operators import bm25, fusion, knn
from lodestrata.session import small_side


@dataclass(frozen=True)
class RetrievalParams:
    candidates: int = 15
    rrf_constant: int = 60
    fused: int = 8
    context: int = 3
    min_score: float = -1.0
    rrf_floor: float = 0.015
    fallback: bool = True
    dim: int = 64


def vector_hits(vectors: DataFrame, queries: DataFrame, p: RetrievalParams, sources: tuple[str, str] | None = None) -> DataFrame:
    """(query_id, doc_id, distance, rank): the nearest vectors of vectors(vec_id, row_id, embedding), a text counted at
    its nearest vector. `sources` names the columns of the vectors' source and of the queries' filter on it."""
    source, wanted = sources or (None, None)
    near = knn.knn_topk(vectors, "vec_id", "embedding", queries, "query_id", "embedding", p.candidates, p.dim, source_col=source, filter_col=wanted)
    rows = vectors.select(F.col("vec_id").alias("id"), F.col("row_id").alias("doc_id")).filter("doc_id is not null").join(small_side(near), "id")
    return rows.groupBy("query_id", "doc_id").agg(F.min("distance").alias("distance"), F.min("rank").alias("rank"))


def candidates(chunks: DataFrame, vectors: DataFrame, queries: DataFrame, p: RetrievalParams = RetrievalParams()) -> DataFrame:
    """Fused candidates with both ranks and scores of queries(query_id, query, embedding)."""
    text = bm25.bm25_topk(chunks, "row_id", "documents", queries, "query_id", "query", p.candidates)
    return fusion.fuse(vector_hits(vectors, queries, p), text, p.rrf_constant, p.fused)


def candidates_within(chunks: DataFrame, vectors: DataFrame, queries: DataFrame, p: RetrievalParams = RetrievalParams()) -> DataFrame:
    """candidates of queries(query_id, query, embedding, source_filter), each over the sources that contain its filter."""
    text = bm25.bm25_within(chunks, "row_id", "documents", "source", queries, "query_id", "query", "source_filter", p.candidates)
    placed = vectors.join(chunks.select("row_id", "source"), "row_id")
    return fusion.fuse(vector_hits(placed, queries, p, ("source", "source_filter")), text, p.rrf_constant, p.fused)


def retrieve(chunks: DataFrame, vectors: DataFrame, queries: DataFrame, p: RetrievalParams = RetrievalParams(), within: bool = False) -> DataFrame:
    """Accepted candidates of each query with text, citation fields, rerank_score and final_rank.

    Texts are joined only after the cut to the fused candidates, which are the broadcast side as long as they are few,
    so that the texts are never shuffled; blank ones are dropped before the rerank. With
    `within` each query searches only the sources that contain its source_filter.
    """
    found = (candidates_within if within else candidates)(chunks, vectors, queries, p)
    text = chunks.select(F.col("row_id").alias("doc_id"), F.col("documents").alias("text"), "source", "page", "parent_context", "has_visual", "image_path")
    full = text.filter(F.trim("text") != "").join(small_side(found.join(queries.select("query_id", "query"), "query_id")), "doc_id")
    scored = full.withColumn("rerank_score", fusion.lexical_overlap(technical_tokens(F.col("query")), technical_tokens(F.col("text"))))
    return fusion.rerank_decision(scored, p.min_score, p.rrf_floor, p.fallback, p.context)


def contexts(retrieved: DataFrame, budget: int | Column = 4500) -> DataFrame:
    """(query_id, context, citations): the leading texts within the budget and their sources, each cited once."""
    blocks = fusion.within_budget(retrieved, ["query_id"], ["final_rank"], "text", budget if isinstance(budget, Column) else F.lit(budget))
    text = fusion.joined_text(blocks, ["query_id"], "final_rank", "text")
    cited = fusion.distinct_citations(blocks.withColumn("name", base_name(F.col("source"))), ["query_id"], ["final_rank"], ["name", "page"])
    each = F.array_sort(F.collect_list(F.struct("final_rank", "name", "page", "rerank_score", "rrf_score")))
    return text.join(cited.groupBy("query_id").agg(each.alias("citations")), "query_id", "left")
