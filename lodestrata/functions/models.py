"""Boundaries to models: injectable callables with deterministic offline defaults, run batch-wise in Python workers."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Any

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.session import checkpointed


@lru_cache(maxsize=8)
def client(factory: Callable[[], Any]) -> Any:
    """One client for each Python worker and factory."""
    return factory()


def retried(call: Callable[[], Any], tries: int = 3, first_wait: float = 0.5) -> Any:
    """The result of a call, tried again with growing pauses; the last error is raised."""
    for n in range(tries):
        try:
            return call()
        except Exception:  # noqa: BLE001 - whatever the service raises
            if n + 1 == tries:
                raise
            time.sleep(first_wait * 2**n)


def hashed_embeddings(texts: list[str], dim: int = 64) -> np.ndarray:
    """Offline embedder: signed feature hashing of words, normalised; an empty text is the zero vector."""
    out = np.zeros((len(texts), dim), dtype=np.float32)
    for i, t in enumerate(texts):
        for w in (t or "").lower().split():
            h = xxhash.xxh64_intdigest(w)
            out[i, h % dim] += 1.0 if h >> 63 else -1.0
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1)


def embedded(df: DataFrame, text_col: str, embed: Callable[[list[str]], np.ndarray] = hashed_embeddings, batch: int = 16, out_col: str = "embedding") -> DataFrame:
    """df with the embedding of a text column, asked for in batches."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        values = texts.fillna("").tolist()
        parts = [embed(values[i : i + batch]) for i in range(0, len(values), batch)]
        return pd.Series([list(map(float, v)) for part in parts for v in part])

    return df.withColumn(out_col, run(F.col(text_col)))


def pooled(token_vectors: np.ndarray, mask: np.ndarray, how: str = "mean") -> np.ndarray:
    """Sentence vectors of (batch, token, dim): the mean over unmasked tokens, or the first token's."""
    if how == "cls":
        return token_vectors[:, 0]
    m = mask[:, :, None].astype(token_vectors.dtype)
    return (token_vectors * m).sum(axis=1) / np.maximum(m.sum(axis=1), 1e-9)


def reranked(df: DataFrame, query_col: str, text_col: str, score: Callable[[list[tuple[str, str]]], list[float]], batch: int = 8, out_col: str = "rerank_score") -> DataFrame:
    """df with a model's score of each (query, text)."""

    @F.pandas_udf("double")
    def run(queries: pd.Series, texts: pd.Series) -> pd.Series:
        pairs = list(zip(queries.fillna(""), texts.fillna(""), strict=True))
        return pd.Series([float(s) for i in range(0, len(pairs), batch) for s in score(pairs[i : i + batch])])

    return df.withColumn(out_col, run(F.col(query_col), F.col(text_col)))


def completed(df: DataFrame, prompt_col: str, factory: Callable[[], Callable[[str], str]], fallback: str | None = None, out_col: str = "answer") -> DataFrame:
    """df with a model's completion of each prompt; a prompt that fails three times gets the fallback, or raises."""
    fields = [f for f in df.schema.fields if f.name != out_col]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + f", `{out_col}` string"

    def ask(prompt: str) -> str | None:
        try:
            return retried(lambda: client(factory)(prompt))
        except Exception:  # noqa: BLE001
            if fallback is None:
                raise
            return fallback

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(**{out_col: [None if p is None else ask(p) for p in pdf[prompt_col]]})

    return df.select(*[f.name for f in fields]).mapInPandas(run, schema)


def captioned(images: DataFrame, caption: Callable[[bytes], str], placeholder: str = "No description is available.") -> DataFrame:
    """(img_hash, caption) of images(img_hash, content); a picture that the model fails on gets the placeholder."""

    def one(content: bytes) -> str:
        try:
            return retried(lambda: caption(bytes(content)))
        except Exception:  # noqa: BLE001
            return placeholder

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"img_hash": pdf["img_hash"], "caption": [one(c) for c in pdf["content"]]})

    return images.select("img_hash", "content").mapInPandas(run, "img_hash string, caption string")


def tagged(texts: DataFrame, id_col: str, text_col: str, tag: Callable[[str], list[tuple[str, str, str | None]]]) -> DataFrame:
    """(id, position, text, lemma, pos) of every word by an injected tagger."""

    @F.pandas_udf("array<struct<text: string, lemma: string, pos: string>>")
    def run(column: pd.Series) -> pd.Series:
        return pd.Series([[{"text": a, "lemma": b, "pos": c} for a, b, c in tag(t or "")] for t in column])

    return texts.select(F.col(id_col).alias("id"), F.posexplode(run(F.col(text_col))).alias("position", "w")).select("id", "position", "w.*")


def corrected(df: DataFrame, text_col: str, feedback, rewrite, tries: int = 2) -> DataFrame:
    """df with text_col rewritten while it is not compliant, at most `tries` times, and was_corrected.

    `feedback` (DataFrame to DataFrame) adds compliant and messages; `rewrite` (DataFrame to DataFrame) replaces the
    text of the rows it is given. Rows that are compliant, or that a rewrite leaves as they are, are not asked again.
    """
    todo = checkpointed(feedback(df).withColumn("was_corrected", F.lit(False)).withColumn("_stop", F.col("compliant")))
    for _ in range(tries):
        done, open_ = todo.filter("_stop"), todo.filter("not _stop").withColumn("_before", F.col(text_col))
        again = rewrite(open_.drop("compliant", "messages"))
        changed = ~F.col(text_col).eqNullSafe(F.col("_before"))
        again = feedback(again.withColumn("was_corrected", F.col("was_corrected") | changed).withColumn("_stop", ~changed).drop("_before"))
        todo = checkpointed(done.unionByName(again.withColumn("_stop", F.col("_stop") | F.col("compliant"))))
    return todo.drop("_stop")
