"""Hashes and signatures of files, texts and ingestions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def text_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def pixel_hash(pixels: Column) -> Column:
    return F.md5(pixels)


def chunk_hash(signature: Column, index: Column, text: Column) -> Column:
    return F.sha2(F.concat_ws("\n", signature, index.cast("string"), text), 256)


def json_string(c: Column) -> Column:
    """A string as JSON writes it, non-ASCII characters kept."""
    out = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for raw, name in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
        out = F.replace(out, F.lit(raw), F.lit(name))
    return F.concat(F.lit('"'), out, F.lit('"'))


def signature(document_hash: Column, collection: Column, model: Column, dimension: Column, chunker: Column, max_length: Column) -> Column:
    """SHA-256 of the sorted-key JSON of what determines an ingestion's chunks."""
    fields = {
        "chunker": json_string(chunker), "collection_name": json_string(collection), "document_hash": json_string(document_hash),
        "embedding_dimension": dimension.cast("string"), "embedding_model": json_string(model), "max_chunk_length": max_length.cast("string"),
    }
    body = [F.lit("{")]
    for i, (k, v) in enumerate(sorted(fields.items())):
        body += [F.lit(f'{", " if i else ""}"{k}": '), F.coalesce(v, F.lit("null"))]
    return F.sha2(F.concat(*body, F.lit("}")), 256)


def decorated(source: Column, page: Column, text: Column) -> Column:
    """A chunk's text under its marker line."""
    return F.concat(F.lit("--- SOURCE: "), source, F.lit(" | PAGE "), F.coalesce(page.cast("string"), F.lit("?")), F.lit(" ---\n"), text)


def utc_now() -> Column:
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
