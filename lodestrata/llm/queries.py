"""Queries of the training-data operators over the test tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    from lodestrata.llm.repeated_lines import repeated_lines

    return repeated_lines(_table(spark, folder, "bm25_cache"), "row_id", "documents", "source").withColumnRenamed("id", "row_id")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    from lodestrata.llm.scans import scan_defects

    defects, _ = scan_defects(_table(spark, folder, "bm25_cache"), "row_id", "documents", "source", "chunk_index")
    return defects.withColumnRenamed("id", "row_id")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    from lodestrata.llm.pairs import defective_pairs

    results = _table(spark, folder, "faithfulness_results")
    return defective_pairs(results, "result_id", "query", "final_text", "expected_not_found").withColumnRenamed("id", "result_id")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    from lodestrata.llm.covering import near_duplicates, similar_pairs

    links, members = near_duplicates(_table(spark, folder, "bm25_cache"), "row_id", "documents", threshold=0.7, shingle=3)
    return similar_pairs(links, members).select(F.col("a").alias("row_id_a"), F.col("b").alias("row_id_b"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    from lodestrata.llm.curves import nearest_vectors

    near = nearest_vectors(_table(spark, folder, "chunk_vectors"), "vec_id", "embedding", k=10)
    close = near.filter(F.col("similarity") >= 0.9)
    return close.select(F.least("id", "neighbour").alias("vec_id_a"), F.greatest("id", "neighbour").alias("vec_id_b")).distinct()


def p6_pack(spark: SparkSession, folder: str) -> DataFrame:
    from lodestrata.llm.packing import pack

    return pack(_table(spark, folder, "documents"), "doc_id", "text")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    from lodestrata.llm.automaton import leaks

    found = leaks(_table(spark, folder, "documents"), "doc_id", "text", _table(spark, folder, "eval_items"), "item_id", "passage", with_text=False)
    return found.select("doc_id", F.explode("leaks.item_id").alias("item_id"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    from lodestrata.llm.kernel_language import document_languages

    found = document_languages(_table(spark, folder, "documents"), "doc_id", "text", "lang").filter(F.col("lang").isNotNull())
    wrong = F.when(~F.col("lang").eqNullSafe(F.col("label_lang")), F.array(F.struct(F.lit(0).alias("line_no"), F.col("lang").alias("lang"))))
    mixed = F.when(F.size("segments") > 1, F.transform("segments", lambda s: F.struct(s["line_no"].alias("line_no"), s["lang"].alias("lang"))))
    none = F.array().cast("array<struct<line_no: int, lang: string>>")
    cases = F.concat(F.coalesce(wrong, none), F.coalesce(mixed, none))
    return found.select("doc_id", F.explode(cases).alias("c")).select("doc_id", "c.line_no", "c.lang")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p2_found": p2_found, "p3_found": p3_found, "p4_found": p4_found, "p5_found": p5_found, "p6_pack": p6_pack, "p7_found": p7_found, "p8_found": p8_found}


# Windows of words; letters, digits and, as in Python, the marks that lower-casing leaves apart split words.
P4_SQL = """
with w as (select row_id, regexp_extract_all(lower(replace(documents, 'İ', 'i' || chr(775))), '[\\p{L}\\p{N}]+') as w from bm25_cache where documents is not null),
s as (select distinct row_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from (select row_id, w, unnest(range(1, len(w) - 1)) as i from w)),
n as (select row_id, count(*) as n from s group by 1),
c as (select a.row_id as row_id_a, b.row_id as row_id_b, count(*) as shared from s a join s b on a.g = b.g and a.row_id < b.row_id group by all)
select row_id_a, row_id_b from c join n a on a.row_id = row_id_a join n b on b.row_id = row_id_b where shared >= 0.7 * (a.n + b.n - shared)
"""
P7_SQL = """
with p as (select item_id, regexp_extract_all(lower(replace(passage, 'İ', 'i' || chr(775))), '[\\p{L}\\p{N}]+') as w from eval_items where passage is not null),
d as (select doc_id, regexp_extract_all(lower(replace(text, 'İ', 'i' || chr(775))), '[\\p{L}\\p{N}]+') as w from documents where text is not null),
pg as (select distinct item_id, array_to_string(w[i:i + 11], ' ') as g from (select item_id, w, unnest(range(1, len(w) - 10)) as i from p)),
dg as (select distinct doc_id, array_to_string(w[i:i + 11], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 10)) as i from d))
select distinct doc_id, item_id from dg join pg using (g)
"""


def oracle_sql() -> dict[str, str]:
    """SQL for what it can express in acceptable time; the other queries are tested against brute force."""
    return {"p4_found": P4_SQL, "p7_found": P7_SQL}
