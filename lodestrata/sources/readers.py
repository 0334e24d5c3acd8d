"""Readers of files and rule sets, and writers of their counterparts."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.functions.hashing import content_hash

ITEM_SCHEMA = "source string, item_idx int, item_type string, headings array<string>, page int, text string"
WORD_SCHEMA = "page int, text string, x0 double, top double, bottom double"


def tables(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    """Parquet tables of a folder, also registered as temporary views for spark.sql."""
    out = {}
    for name in names:
        out[name] = spark.read.parquet(f"{folder}/{name}.parquet")
        out[name].createOrReplaceTempView(name)
    return out


def document_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, filename, document_hash, content) of the PDF files directly in a folder, in any letter case."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").load(folder)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), content_hash(F.col("content")).alias("document_hash"), "content")


def parsed_items(files: DataFrame, parse: Callable[[str, bytes], list[dict]]) -> DataFrame:
    """Items of every file by an injected parser; a file that it fails on yields none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows: list[dict] = []
            for name, content in zip(pdf["filename"], pdf["content"], strict=True):
                try:
                    rows += [{"source": name, "item_idx": i, **item} for i, item in enumerate(parse(name, content))]
                except Exception:  # noqa: BLE001 - one broken file must not end the run
                    continue
            yield pd.DataFrame(rows, columns=["source", "item_idx", "item_type", "headings", "page", "text"])

    return files.select("filename", "content").mapInPandas(run, ITEM_SCHEMA)


def page_words(files: DataFrame, extract: Callable[[bytes, int, int], list[dict]], first: int, last: int) -> DataFrame:
    """Words of a range of pages by an injected extractor; pages that a file lacks are skipped."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [w for content in pdf["content"] for w in extract(content, first, last)]
            yield pd.DataFrame(rows, columns=["page", "text", "x0", "top", "bottom"])

    return files.select("content").mapInPandas(run, WORD_SCHEMA).filter(F.col("page").between(first, last))


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Rows of JSON-lines files; blank lines are skipped, any other bad line fails with its number and text.

    Lines are numbered within their file, which is therefore read as a whole: these are sets of cases, not corpora."""
    whole = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("at", "value"))
    raw = whole.filter(F.trim("value") != "")
    parsed = raw.select("at", "value", F.from_json("value", schema).alias("r"), F.try_parse_json("value").isNotNull().alias("ok"))
    checked = F.when(F.col("ok"), F.col("r")).otherwise(F.raise_error(F.concat(F.lit("line "), (F.col("at") + 1).cast("string"), F.lit(": not a JSON line: "), F.left("value", F.lit(200)))))
    return parsed.select(checked.alias("r")).select("r.*")


def rule_rows(spark: SparkSession, path: str) -> DataFrame:
    """One row for each rule of a JSON file that is a list or an object with the key rules."""
    text = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    items = F.coalesce(F.try_variant_get("v", "$.rules", "array<variant>"), F.try_variant_get("v", "$", "array<variant>"))
    return text.select(F.posexplode(items).alias("position", "rule"))


def text_list(path: str, key: str) -> list[str]:
    """A list of strings from a JSON file that is the list or an object with it; empty if the file is missing or bad."""
    try:
        data = json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return []
    data = data.get(key, []) if isinstance(data, dict) else data
    return [x for x in data if isinstance(x, str)] if isinstance(data, list) else []


def settings(path: str) -> dict:
    """A YAML or JSON settings file as a dictionary; empty if it is missing or bad."""
    try:
        text = Path(path).read_text(encoding="utf-8")
    except OSError:
        return {}
    try:
        return json.loads(text) or {}
    except ValueError:
        pass
    try:
        import yaml

        return yaml.safe_load(text) or {}
    except Exception:  # noqa: BLE001 - no parser, or no YAML
        return {}


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def store_assets(images: DataFrame, folder: str) -> None:
    """Write each picture (img_hash, content) as vis_<hash>.png into a folder that all executors share, if absent."""

    def run(rows) -> None:
        for r in rows:
            target = Path(folder) / f"vis_{r.img_hash}.png"
            if not target.exists():
                part = target.with_suffix(f".{r.img_hash}.part")
                part.write_bytes(bytes(r.content))
                part.replace(target)

    images.select("img_hash", "content").dropDuplicates(["img_hash"]).foreachPartition(run)
