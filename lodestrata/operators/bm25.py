"""BM25 over an inverted index held as tables."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.text import technical_tokens
from lodestrata.session import checkpointed, spread


@dataclass(frozen=True)
class Bm25Params:
    k1: float = 1.5
    b: float = 0.75
    epsilon: float = 0.25  # a negative idf becomes this share of the mean idf


def tokenised(chunks: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, tokens): the distinct tokens of each text, materialised, as every statistic reads them."""
    texts = spread(chunks.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    return checkpointed(texts.select("doc_id", technical_tokens(F.col("text")).alias("tokens")))


def postings(tokens: DataFrame) -> DataFrame:
    """(doc_id, term, tf, dl): tokens are distinct in a text, so tf is 1 and dl the number of distinct tokens."""
    return tokens.select("doc_id", F.explode("tokens").alias("term"), F.lit(1).alias("tf"), F.size("tokens").alias("dl"))


def corpus_stats(tokens: DataFrame) -> DataFrame:
    """One row (n, avgdl); texts without tokens count."""
    return tokens.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("tokens")).alias("avgdl"))


def term_stats(posts: DataFrame, corpus: DataFrame, params: Bm25Params = Bm25Params()) -> DataFrame:
    """(term, df, idf) with the floor for terms in more than half of the texts."""
    df = posts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    raw = F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    with_raw = df.crossJoin(F.broadcast(corpus)).select("term", "df", raw.alias("raw"))
    mean = with_raw.agg(F.avg("raw").alias("mean_idf"))
    floor = F.when(F.col("raw") < 0, params.epsilon * F.col("mean_idf")).otherwise(F.col("raw"))
    return with_raw.crossJoin(F.broadcast(mean)).select("term", "df", floor.alias("idf"))


def _sums(own: pd.Series, vocabulary: dict[str, int], weights: np.ndarray) -> np.ndarray:
    """Text by query: the sum of the weights of a text's tokens."""
    counts = np.array([len(t) for t in own])
    terms = np.array([vocabulary[t] for tokens in own for t in tokens], dtype=np.int64)
    start = np.r_[0, np.cumsum(counts)]
    scores = np.zeros((len(own), weights.shape[1]))
    for a in range(0, len(own), 500):
        some = a + np.flatnonzero(counts[a : a + 500])
        if len(some):
            lo, hi = start[a], start[min(a + 500, len(own))]
            scores[some] = np.add.reduceat(weights[terms[lo:hi]], start[some] - lo, axis=0)
    return scores


def first_of(values: np.ndarray, n: int) -> np.ndarray:
    """Positions of the n smallest values of each row in ascending order, equal ones by position."""
    if n < values.shape[1]:
        edge = np.partition(values, n - 1, axis=1)[:, n - 1 : n]
        below = values < edge
        tied = (values == edge) & ((values == edge).cumsum(axis=1) <= n - below.sum(axis=1, keepdims=True))
        at = np.nonzero(below | tied)[1].reshape(len(values), n)
    else:
        at = np.broadcast_to(np.arange(n), values.shape)
    return np.take_along_axis(at, np.argsort(np.take_along_axis(values, at, 1), axis=1, kind="stable"), 1)


def _score(vocabulary: dict[str, int], weights: np.ndarray, query_ids: np.ndarray, k: int, digits: int):
    """Best k texts of a batch for each query; weights is a row of idf by query for each term of the vocabulary."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            pdf = pdf.sort_values("doc_id")
            scores = _sums(pdf["tokens"], vocabulary, weights)
            scores = np.round(scores * pdf["norm"].to_numpy()[:, None], digits).T
            ids = pdf["doc_id"].to_numpy()
            n = min(k, len(ids))
            order = first_of(-scores, n)
            yield pd.DataFrame({"query_id": np.repeat(query_ids, n), "doc_id": ids[order].ravel(), "score": np.take_along_axis(scores, order, 1).ravel()})

    return run


def bm25_topk(
    chunks: DataFrame,
    id_col: str,
    text_col: str,
    queries: DataFrame,
    query_id: str,
    query_col: str,
    k: int = 15,
    params: Bm25Params = Bm25Params(),
    digits: int = 9,
    queries_at_once: int = 500,
) -> DataFrame:
    """(query_id, doc_id, score, rank): the k best texts of each query by (score down, doc_id up), rank from 0.

    Scores are rounded to `digits` before ranking. A text's tokens that no query holds are dropped in the scan; batches
    of texts are scored against at most `queries_at_once` queries by matrix products, and only the k best of a batch
    are shuffled. Texts without a query term score 0 and fill the list where it would be shorter than k. Null and empty
    texts count in the statistics; queries without tokens list the first ids.
    """
    tokens = tokenised(chunks, id_col, text_col)
    corpus = corpus_stats(tokens)
    stats = checkpointed(term_stats(postings(tokens), corpus, params))
    return index_topk(tokens, corpus, stats, queries, query_id, query_col, k, params, digits, queries_at_once)


def index_topk(
    tokens: DataFrame, corpus: DataFrame, stats: DataFrame, queries: DataFrame, query_id: str, query_col: str, k: int = 15, params: Bm25Params = Bm25Params(), digits: int = 9, queries_at_once: int = 500
) -> DataFrame:
    """bm25_topk over the tables of an index: tokens(doc_id, tokens), corpus(n, avgdl) and stats(term, df, idf)."""
    asked = queries.select(F.col(query_id).cast("long").alias("query_id"), technical_tokens(F.col(query_col)).alias("terms")).filter("query_id is not null")
    passes = max(1, math.ceil(asked.count() / queries_at_once))
    dl = F.size("tokens")
    norm = (params.k1 + 1) / (1 + params.k1 * (1 - params.b + params.b * dl / F.col("avgdl")))
    texts = tokens.filter("doc_id is not null").crossJoin(F.broadcast(corpus)).select(F.col("doc_id").cast("long").alias("doc_id"), F.when(dl > 0, norm).otherwise(0.0).alias("norm"), "tokens")
    out = None
    for p in range(passes):
        part = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == p)
        rows = part.collect()
        idf = {r.term: r.idf for r in stats.join(F.broadcast(part.select(F.explode("terms").alias("term")).distinct()), "term", "left_semi").collect()}
        vocabulary = {t: i for i, t in enumerate(sorted(idf))}
        weights = np.zeros((max(1, len(vocabulary)), len(rows)))
        for j, r in enumerate(rows):
            for t in r.terms:
                if t in vocabulary:
                    weights[vocabulary[t], j] = idf[t]
        own = texts.withColumn("tokens", _only(F.col("tokens"), list(vocabulary)))
        near = own.mapInPandas(_score(vocabulary, weights, np.array([r.query_id for r in rows], dtype=np.int64), k, digits), "query_id long, doc_id long, score double")
        out = near if out is None else out.unionByName(near)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    ranked = out.withColumn("rn", F.row_number().over(best)).filter(F.col("rn") <= k)
    return ranked.select("query_id", "doc_id", "score", (F.col("rn") - 1).alias("rank"))


def within_stats(tokens: DataFrame, filters: DataFrame, params: Bm25Params = Bm25Params()) -> DataFrame:
    """(source_filter, avgdl, term, idf) over the texts of tokens(doc_id, tokens, src) whose src contains the filter."""
    pairs = filters.join(tokens.select("src").distinct(), F.col("src").contains(F.col("source_filter")))
    sizes = tokens.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("tokens")).alias("dl"))
    corpus = pairs.join(sizes, "src").groupBy("source_filter").agg(F.sum("n").alias("n"), (F.sum("dl") / F.sum("n")).alias("avgdl"))
    df = tokens.select("src", F.explode("tokens").alias("term")).groupBy("src", "term").agg(F.count(F.lit(1)).alias("df"))
    df = pairs.join(df, "src").groupBy("source_filter", "term").agg(F.sum("df").alias("df"))
    raw = df.join(corpus, "source_filter").withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.groupBy("source_filter").agg(F.avg("raw").alias("mean_idf"))
    floor = F.when(F.col("raw") < 0, params.epsilon * F.col("mean_idf")).otherwise(F.col("raw"))
    return raw.join(mean, "source_filter").select("source_filter", "avgdl", "term", floor.alias("idf"))


def _score_within(vocabulary: dict[str, int], weights: np.ndarray, query_ids: np.ndarray, filters: list[str], averages: np.ndarray, k: int, params: Bm25Params, digits: int):
    """_score in which a query sees only the texts whose src contains its filter; averages holds avgdl by query."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        allowed = Allowed(filters)
        for pdf in batches:
            if not len(pdf):
                continue
            pdf = pdf.sort_values("doc_id")
            dl = pdf["dl"].to_numpy(dtype=np.float64)[:, None]
            norm = np.where(dl > 0, (params.k1 + 1) / (1 + params.k1 * (1 - params.b + params.b * dl / averages)), 0.0)
            scores = np.round(_sums(pdf["tokens"], vocabulary, weights) * norm, digits)
            scores = np.where(allowed.of(pdf["src"]), scores, -np.inf).T
            ids = pdf["doc_id"].to_numpy()
            n = min(k, len(ids))
            order = first_of(-scores, n)
            best = np.take_along_axis(scores, order, 1).ravel()
            out = pd.DataFrame({"query_id": np.repeat(query_ids, n), "doc_id": ids[order].ravel(), "score": best})
            yield out[np.isfinite(best)]

    return run


class Allowed:
    """Which queries may see a source: those whose filter it contains."""

    def __init__(self, filters: list[str]) -> None:
        self.names, self.which = np.unique(np.array(filters, dtype=object).astype(str), return_inverse=True)
        self.known: dict[str, np.ndarray] = {}

    def of(self, sources: pd.Series) -> np.ndarray:
        """Source by query."""
        for s in sources.unique():
            if s not in self.known:
                self.known[s] = np.array([n in s for n in self.names], dtype=bool)
        return np.array([self.known[s] for s in sources], dtype=bool).reshape(len(sources), -1)[:, self.which]


def bm25_within(
    chunks: DataFrame, id_col: str, text_col: str, source_col: str, queries: DataFrame, query_id: str, query_col: str, filter_col: str, k: int = 15, params: Bm25Params = Bm25Params(), digits: int = 9, queries_at_once: int = 500
) -> DataFrame:
    """bm25_topk of each query over the texts, with their own statistics, whose lower-cased source contains its filter.

    All filters are answered together: each batch of texts is scored against at most `queries_at_once` queries a pass.
    """
    own = chunks.filter(F.col(source_col).isNotNull())
    tokens = checkpointed(own.select(F.col(id_col).alias("doc_id"), technical_tokens(F.col(text_col)).alias("tokens"), F.lower(source_col).alias("src")))
    asked = queries.select(F.col(query_id).cast("long").alias("query_id"), technical_tokens(F.col(query_col)).alias("terms"), F.col(filter_col).alias("source_filter")).filter("query_id is not null and source_filter is not null")
    stats = checkpointed(within_stats(tokens, asked.select("source_filter").distinct(), params))
    passes = max(1, math.ceil(asked.count() / queries_at_once))
    texts = tokens.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.size("tokens").alias("dl"), "tokens", "src")
    out = None
    for p in range(passes):
        part = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == p)
        rows = part.collect()
        wanted = part.select("source_filter", F.explode("terms").alias("term")).distinct()
        idf = {(r.source_filter, r.term): r.idf for r in stats.join(F.broadcast(wanted), ["source_filter", "term"], "left_semi").collect()}
        average = {r.source_filter: r.avgdl for r in stats.join(F.broadcast(part.select("source_filter").distinct()), "source_filter", "left_semi").select("source_filter", "avgdl").distinct().collect()}
        vocabulary = {t: i for i, t in enumerate(sorted({t for _, t in idf}))}
        weights = np.zeros((max(1, len(vocabulary)), len(rows)))
        for j, r in enumerate(rows):
            for t in r.terms:
                if (r.source_filter, t) in idf:
                    weights[vocabulary[t], j] = idf[r.source_filter, t]
        score = _score_within(vocabulary, weights, np.array([r.query_id for r in rows], dtype=np.int64), [r.source_filter for r in rows], np.array([average.get(r.source_filter, 1.0) for r in rows]), k, params, digits)
        near = texts.withColumn("tokens", _only(F.col("tokens"), list(vocabulary))).mapInPandas(score, "query_id long, doc_id long, score double")
        out = near if out is None else out.unionByName(near)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    ranked = out.withColumn("rn", F.row_number().over(best)).filter(F.col("rn") <= k)
    return ranked.select("query_id", "doc_id", "score", (F.col("rn") - 1).alias("rank"))


def _only(tokens: Column, vocabulary: list[str]) -> Column:
    return F.filter(tokens, lambda t: t.isin(vocabulary)) if vocabulary else F.array().cast("array<string>")


def source_lists(chunks: DataFrame, id_col: str, source: Column, block: int = 100_000) -> DataFrame:
    """(source, block, ids, rows): the rows of each source in ascending order, in blocks of `block` ids, so that no list
    grows with the table; a source's lists in the order of their blocks are its whole list."""
    placed = chunks.select(source.alias("source"), F.col(id_col).alias("id"), F.floor(F.col(id_col) / block).alias("block"))
    return placed.groupBy("source", "block").agg(F.array_sort(F.collect_list("id")).alias("ids"), F.count(F.lit(1)).alias("rows"))
