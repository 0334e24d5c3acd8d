"""Exact nearest vectors of a stated set of queries: in blocks, by matrix products."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.operators.bm25 import Allowed
from lodestrata.session import spread


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def l2_normalised(v: Column) -> Column:
    norm = l2_norm(v)
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm))


def cosine(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return dot / (l2_norm(a) * l2_norm(b))


def usable(v: Column, dim: int) -> Column:
    return v.isNotNull() & (F.size(v) == dim) & F.coalesce(l2_norm(v) > 0, F.lit(False))


#: Queries and stored vectors that meet in one matrix product: it takes 4 MB in single precision.
QUERIES, ROWS = 512, 2048
#: Stands for NaN, which pandas would make null: more than any distance.
NO_DISTANCE = 3


def _unit(vectors: pd.Series, dim: int) -> np.ndarray:
    m = np.array(vectors.tolist(), dtype=np.float64).reshape(-1, dim)
    with np.errstate(invalid="ignore", over="ignore"):
        return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def _best(asked: np.ndarray, dist: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the k first (distance, id) of each query, in order, and their ranks."""
    order = np.lexsort((ids, dist, asked))
    own = asked[order]
    start = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    rank = np.arange(len(own)) - np.repeat(start, np.diff(np.r_[start, len(own)]))
    return order[rank < k], rank[rank < k]


def _scan(ids: np.ndarray, matrix: np.ndarray, k: int, digits: int, filters: list[str] | None = None):
    """The k best of a task's rows for each query. Products in single precision find the pairs that may be among them, with
    a margin above their error; only these get their distance in double precision, a slice at a time."""
    dim = matrix.shape[1]
    margin = (dim + 8) * 2.0**-23 + 10.0**-digits
    odd = ~np.isfinite(matrix).all(axis=1)  # vectors with NaN or infinite values: behind all others
    single = np.where(odd[:, None], 0, matrix).astype(np.float32)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        allowed = None if filters is None else Allowed(filters)
        dist, near = np.full((len(ids), k), np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)

        def take(asked: np.ndarray, rows: np.ndarray, m: np.ndarray, base: np.ndarray) -> None:
            d = np.round(1 - np.einsum("ij,ij->i", matrix[asked], m[rows]), digits) + 0.0  # no negative zero
            d[np.isnan(d)] = NO_DISTANCE
            kept = d <= dist[asked, -1]
            asked, d, own = asked[kept], d[kept], base[rows[kept]]
            some = np.unique(asked)
            asked, d, own = np.r_[np.repeat(some, k), asked], np.r_[dist[some].ravel(), d], np.r_[near[some].ravel(), own]
            at, rank = _best(asked, d, own, k)
            dist[asked[at], rank], near[asked[at], rank] = d[at], own[at]

        for pdf in batches:
            for lo in range(0, len(pdf), ROWS):
                part = pdf.iloc[lo : lo + ROWS]
                base, m = part["id"].to_numpy(), _unit(part["v"], dim)
                far = ~np.isfinite(m).all(axis=1)
                block = np.where(far[:, None], 0, m).astype(np.float32).T
                within = None if allowed is None else allowed.of(part["src"]).T
                for a in range(0, len(ids), QUERIES):
                    sims = single[a : a + QUERIES] @ block
                    sims[odd[a : a + QUERIES]] = -2
                    sims[:, far] = -2
                    if within is not None:
                        sims[~within[a : a + QUERIES]] = -9
                    cut = np.maximum(1 - dist[a : a + QUERIES, -1] - margin, -4)
                    new = np.flatnonzero(cut == -4)
                    if len(new) and k < sims.shape[1]:  # fewer than k so far: the k best of this block are near enough
                        cut[new] = np.maximum(np.partition(sims[new], -k, axis=1)[:, -k] - 2 * margin, -4)
                    at = np.flatnonzero(sims >= cut.astype(np.float32)[:, None])
                    for i in range(0, len(at), 100_000):
                        asked, rows = np.divmod(at[i : i + 100_000], sims.shape[1])
                        take(a + asked, rows, m, base)
        asked, at = np.nonzero(np.isfinite(dist))
        yield pd.DataFrame({"query_id": ids[asked], "id": near[asked, at], "distance": dist[asked, at]})

    return run


def knn_topk(
    base: DataFrame, id_col: str, vector_col: str, queries: DataFrame, query_id: str, query_vector: str, k: int = 15, dim: int = 64, digits: int = 6, queries_at_once: int = 20_000, source_col: str | None = None, filter_col: str | None = None
) -> DataFrame:
    """(query_id, id, distance, rank): the k nearest by cosine distance, ties to the smaller id, rank from 0.

    Every task keeps the k best of its rows for each query, so that the shuffle holds k rows for a query and task. At
    most `queries_at_once` queries go to the executors at a time: more are taken in several passes over the base. A task
    holds these, its best and one block of distances, however many rows it reads.
    Vectors that are null, all zero or not of length `dim` neither ask nor answer. With `source_col` and `filter_col` a
    query sees only the vectors whose lower-cased source contains its filter; one without a filter sees none.
    """
    within = filter_col is not None
    wanted = queries.filter(usable(F.col(query_vector), dim)).select(F.col(query_id).cast("long").alias("q"), F.col(query_vector).alias("v"), *([F.col(filter_col).alias("f")] if within else []))
    if within:
        wanted, base = wanted.filter("f is not null"), base.filter(F.col(source_col).isNotNull())
    passes = max(1, math.ceil(wanted.count() / queries_at_once))
    stored = spread(base.filter(usable(F.col(vector_col), dim)).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), *([F.lower(source_col).alias("src")] if within else [])))
    out = None
    for p in range(passes):
        part = wanted.filter(F.pmod(F.xxhash64("q"), F.lit(passes)) == p).toPandas()
        near = stored.mapInPandas(_scan(part["q"].to_numpy(), _unit(part["v"], dim), k, digits, part["f"].tolist() if within else None), "query_id long, id long, distance double")
        out = near if out is None else out.unionByName(near)
    best = Window.partitionBy("query_id").orderBy("distance", "id")
    ranked = out.withColumn("rn", F.row_number().over(best)).filter(F.col("rn") <= k)
    distance = F.when(F.col("distance") < NO_DISTANCE, F.col("distance")).otherwise(float("nan"))
    return ranked.select("query_id", "id", distance.alias("distance"), (F.col("rn") - 1).alias("rank"))
