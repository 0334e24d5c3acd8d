"""Fusion of ranked lists, rerank decisions, context and citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rrf(rank: Column, k: int = 60) -> Column:
    """Reciprocal-rank contribution of a rank counted from 0."""
    return F.lit(1.0) / (F.lit(k) + rank)


def fuse(vector_hits: DataFrame, text_hits: DataFrame, k_constant: int = 60, top: int = 8, digits: int = 9) -> DataFrame:
    """Full outer fusion of (query_id, doc_id, distance, rank) with (query_id, doc_id, score, rank).

    Keeps both ranks and scores and adds rrf_score and candidate_rank, the `top` best by (rrf_score down, doc_id up).
    """
    v = vector_hits.select("query_id", "doc_id", F.col("rank").alias("vector_rank"), F.col("distance").alias("vector_distance"))
    t = text_hits.select("query_id", "doc_id", F.col("rank").alias("bm25_rank"), F.col("score").alias("bm25_score"))
    part = lambda c: F.coalesce(rrf(F.col(c), k_constant), F.lit(0.0))
    both = v.join(t, ["query_id", "doc_id"], "full_outer").withColumn("rrf_score", F.round(part("vector_rank") + part("bm25_rank"), digits))
    best = Window.partitionBy("query_id").orderBy(F.desc("rrf_score"), "doc_id")
    return both.withColumn("candidate_rank", F.row_number().over(best)).filter(F.col("candidate_rank") <= top)


def lexical_overlap(query_tokens: Column, text_tokens: Column) -> Column:
    """Offline rerank score: the share of the query's tokens in the text, between -2 and 2."""
    share = F.size(F.array_intersect(query_tokens, text_tokens)) / F.greatest(F.size(query_tokens), F.lit(1))
    return F.round(share * 4 - 2, 6)


def rerank_decision(candidates: DataFrame, min_score: float = -1.0, rrf_floor: float = 0.015, fallback: bool = True, top: int = 3) -> DataFrame:
    """Candidates of the accepted queries, with accepted_by ('score' or 'fallback') and final_rank up to `top`.

    A query is accepted if its best rerank_score reaches `min_score`, or with `fallback` if its best rrf_score reaches
    the floor.
    """
    per_query = Window.partitionBy("query_id")
    best, best_rrf = F.max("rerank_score").over(per_query), F.max("rrf_score").over(per_query)
    how = F.when(best >= min_score, F.lit("score")).when(F.lit(fallback) & (best_rrf >= rrf_floor), F.lit("fallback"))
    order = per_query.orderBy(F.desc("rerank_score"), F.desc("rrf_score"), "doc_id")
    judged = candidates.withColumn("accepted_by", how).withColumn("final_rank", F.row_number().over(order))
    return judged.filter(F.col("final_rank") <= top).filter(F.col("accepted_by").isNotNull())


def within_budget(blocks: DataFrame, keys: list[str], order: list[str], text_col: str, limit: Column, separator: int = 2) -> DataFrame:
    """The leading blocks of each key that fit into `limit` characters with separators between them.

    The first block alone, if it is longer than the limit, is cut to it. Blank blocks are left out.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    kept = blocks.filter(F.trim(F.col(text_col)) != "")
    kept = kept.withColumn("_used", F.sum(F.length(text_col) + separator).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_nth", F.row_number().over(w))
    fits = F.col("_used") <= limit + separator
    cut = F.when((F.col("_nth") == 1) & ~fits, F.rtrim(F.left(F.col(text_col), limit))).otherwise(F.col(text_col))
    return kept.withColumn(text_col, cut).filter(fits | (F.col("_nth") == 1)).drop("_used", "_nth")


def joined_text(blocks: DataFrame, keys: list[str], order: str, text_col: str, separator: str = "\n\n") -> DataFrame:
    """One context text for each key, its blocks in order."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text_col).alias("t"))))
    return blocks.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda x: x["t"]), separator).alias("context"))


def distinct_citations(rows: DataFrame, keys: list[str], order: list[str], identity: list[str]) -> DataFrame:
    """The first row, by order, of each identity within the keys."""
    w = Window.partitionBy(*keys, *identity).orderBy(*order)
    return rows.withColumn("_nth", F.row_number().over(w)).filter(F.col("_nth") == 1).drop("_nth")


def last_turns(turns: DataFrame, key: str, order: list[str], role_col: str, text_col: str, k: int) -> DataFrame:
    """(key, history): the last k turns, oldest first, as lines 'User: …' or 'Assistant: …'; blank turns are left out."""
    newest = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    spoken = turns.filter(F.trim(F.coalesce(F.col(text_col), F.lit(""))) != "")
    last = spoken.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= k)
    who = F.when(F.col(role_col) == "user", F.lit("User: ")).otherwise(F.lit("Assistant: "))
    line = F.struct((-F.col("_n")).alias("n"), F.concat(who, F.col(text_col)).alias("t"))
    return last.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["t"]), "\n").alias("history"))


def last_context(turns: DataFrame, key: str, order: str, role_col: str, context_col: str) -> DataFrame:
    """(key, context): the context of the last assistant turn."""
    spoken = turns.filter(F.col(role_col) != "user")
    return spoken.groupBy(key).agg(F.max_by(context_col, order).alias("context"))
