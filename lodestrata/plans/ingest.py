"""Ingestion: from items to stored chunks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import hashing
from lodestrata.functions.models import embedded, hashed_embeddings
from lodestrata.operators.chunking import attach_images, chunk_documents


@dataclass(frozen=True)
class IngestParams:
    collection: str = "documents"
    model: str = "offline-hash"
    dimension: int = 64
    chunker: str = "hierarchical"
    max_length: int = 1500
    overlap: int = 200


def chunk_rows(items: DataFrame, files: DataFrame, images: DataFrame | None = None, p: IngestParams = IngestParams(), embed=hashed_embeddings) -> DataFrame:
    """Rows of a collection from items and files(source, document_hash): packed, with pictures, marked, hashed, embedded."""
    chunks = chunk_documents(items, p.max_length, p.overlap).withColumn("image_path", F.lit("")).withColumn("has_visual", F.lit(False))
    if images is not None:
        chunks = attach_images(chunks, images)
    lits = {"collection_name": p.collection, "embedding_model": p.model, "embedding_dimension": p.dimension, "chunker": p.chunker, "max_chunk_length": p.max_length}
    rows = chunks.join(files.select("source", "document_hash"), "source").withColumns({k: F.lit(v) for k, v in lits.items()})
    sign = hashing.signature(*[F.col(c) for c in ("document_hash", "collection_name", "embedding_model", "embedding_dimension", "chunker", "max_chunk_length")])
    rows = rows.withColumn("ingestion_signature", sign).withColumn("documents", hashing.decorated(F.col("source"), F.col("page"), F.col("text"))).drop("text")
    rows = rows.withColumn("chunk_hash", hashing.chunk_hash(F.col("ingestion_signature"), F.col("chunk_index"), F.col("documents")))
    return embedded(rows, "documents", embed)


def manifest_rows(chunks: DataFrame, folder: str) -> DataFrame:
    """One manifest record for each ingested file."""
    keys = ["source", "document_hash", "ingestion_signature", "collection_name", "embedding_model", "embedding_dimension", "chunker", "max_chunk_length"]
    counted = chunks.groupBy(*keys).agg(F.count(F.lit(1)).cast("int").alias("chunk_count"))
    return counted.withColumnRenamed("source", "filename").withColumn("source_path", F.concat(F.lit(folder.rstrip("/") + "/"), F.col("filename"))).withColumn("ingested_at", hashing.utc_now())
