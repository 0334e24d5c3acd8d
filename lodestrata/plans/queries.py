"""Queries of the engine's operators over the test tables, with the same results in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import hashing, text
from lodestrata.operators import answers, bm25, chunking, evaluation, fusion, knn, querying
from lodestrata.plans import retrieval
from lodestrata.session import spread
from lodestrata.sources import store
from lodestrata.streaming.ingest import event_windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _wide(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """These columns of a table over all cores, for work that costs more than a shuffle of them."""
    return spread(_t(spark, folder, name).select(*columns))


# --- fragments of SQL that several oracles share ---------------------------------------------------------------------

SQL_BASE = r"lower(trim(regexp_extract({0}, '[^/\\]*$')))"
SQL_WORDS = "len(regexp_extract_all({0}, '[A-Za-z0-9]+(?:[-_/][A-Za-z0-9]+)?'))"
SQL_SENTENCES = (
    r"list_filter(list_transform(string_split(regexp_replace(regexp_replace(coalesce({0}, ''), '([.!?])[\s\p{{Z}}]+', '\1' || chr(10), 'g'), '\n+', chr(10), 'g'), chr(10)), "
    r"lambda s: regexp_replace(s, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')), lambda s: s <> '')"
)
SQL_STRIP = r"regexp_replace({0}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
UNITS_SQL = "(" + ", ".join(f"'{u}'" for u in text.UNITS) + ")"
SQL_TOKENS = rf"""
raw as (select id, t, coalesce(regexp_extract_all(lower(replace(t, 'İ', 'i' || chr(775))), '{text.TOKEN}'), []) as r from src),
tok as (select id, list_distinct(list_concat(r,
  flatten(list_transform(r, lambda x: list_filter(regexp_split_to_array(x, '[-_/]'), lambda p: p <> ''))),
  list_filter(list_transform(range(1, len(r)), lambda i: case when regexp_full_match(r[i], '[0-9]+(\.[0-9]+)?') and r[i + 1] in {UNITS_SQL} then r[i] || r[i + 1] end), lambda x: x is not null))) as tokens from raw)
"""  # fmt: skip


def sql_markers(c: str, markers: list[str], labels: list[tuple[str, str]]) -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    found = ", ".join(f"case when contains(lower(coalesce({c}, '')), {q(m)}) then {q(m)} end" for m in markers)
    per = ", ".join(rf"case when regexp_matches(coalesce({c}, ''), '(?im){p}') then {q(label)} end" for p, label in labels)
    return f"list_sort(list_distinct(list_filter([{found}, {per}], lambda x: x is not null)))"


# --- text ------------------------------------------------------------------------------------------------------------


@query(f"with src as (select row_id as id, documents as t from bm25_cache), {SQL_TOKENS} select id as row_id, len(tokens) as n_tokens, array_to_string(list_sort(tokens), ' ') as tokens from tok")
def tokenize_chunks(spark: SparkSession, d: str) -> DataFrame:
    tokens = _wide(spark, d, "bm25_cache", "row_id", "documents").select("row_id", text.technical_tokens(F.col("documents")).alias("t"))
    return tokens.select("row_id", F.size("t").cast("long").alias("n_tokens"), F.array_join(F.array_sort("t"), " ").alias("tokens"))


SQL_BM25 = f"""
with src as (select row_id as id, documents as t from bm25_cache {{where}}), {SQL_TOKENS},
p as (select id as doc_id, unnest(tokens) as term, len(tokens) as dl from tok),
c as (select count(*) as n, avg(len(tokens)) as avgdl from tok),
d as (select term, count(*) as df from p group by term),
i0 as (select term, df, ln(n - df + 0.5) - ln(df + 0.5) as raw from d, c),
i as (select term, df, case when raw < 0 then 0.25 * (select avg(raw) from i0) else raw end as idf from i0)
"""
SQL_QUERY_TERMS = SQL_TOKENS.replace("raw as", "qraw as").replace("tok as", "qtok as").replace("from src", "from qsrc").replace("from raw", "from qraw")
SQL_BM25_TOP = f"""{SQL_BM25}, qsrc as (select item_id as id, query as t from eval_items), {SQL_QUERY_TERMS},
q as (select id as query_id, unnest(tokens) as term from qtok),
s as (select q.query_id, p.doc_id, round(sum(i.idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * p.dl / c.avgdl))), 9) as score from q join i using (term) join p using (term), c group by all),
f as (select e.item_id as query_id, b.doc_id, 0.0 as score from eval_items e, (select id as doc_id from src order by 1 limit 30) b where not exists (select 1 from s where s.query_id = e.item_id and s.doc_id = b.doc_id)),
r as (select *, row_number() over (partition by query_id order by score desc, doc_id) - 1 as rank from (select * from s union all select * from f)),
top as (select * from r where rank < 15)
"""


@query(SQL_BM25.format(where="") + "select term, df, round(idf, 6) as idf from i")
def bm25_term_stats(spark: SparkSession, d: str) -> DataFrame:
    tokens = bm25.tokenised(_t(spark, d, "bm25_cache"), "row_id", "documents")
    stats = bm25.term_stats(bm25.postings(tokens), bm25.corpus_stats(tokens))
    return stats.select("term", "df", F.round("idf", 6).alias("idf"))


@query(SQL_BM25_TOP.format(where="") + "select query_id as item_id, doc_id as row_id, round(score, 6) as score, rank from top")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    top = bm25.bm25_topk(_t(spark, d, "bm25_cache"), "row_id", "documents", _t(spark, d, "eval_items"), "item_id", "query")
    return top.select(F.col("query_id").alias("item_id"), F.col("doc_id").alias("row_id"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(SQL_BM25_TOP.format(where="where contains(lower(source), 'handbook')") + "select query_id as item_id, doc_id as row_id, round(score, 6) as score, rank from top")
def source_filtered_retrieval(spark: SparkSession, d: str) -> DataFrame:
    chunks = _t(spark, d, "bm25_cache").filter(F.lower("source").contains("handbook"))
    top = bm25.bm25_topk(chunks, "row_id", "documents", _t(spark, d, "eval_items"), "item_id", "query")
    return top.select(F.col("query_id").alias("item_id"), F.col("doc_id").alias("row_id"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


SQL_VECTORS = """v as (select vec_id, row_id, list_transform(embedding, lambda x: x::double) as e from chunk_vectors where len(embedding) = 64 and list_sum(list_transform(embedding, lambda x: x::double * x::double)) > 0)"""


@query(f"""with {SQL_VECTORS}, p as (select q.vec_id as query_id, b.vec_id as vec_id, round(1 - list_cosine_similarity(q.e, b.e), 6) as distance from v q, v b where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by distance, vec_id) - 1 as rank from p) select * from r where rank < 15""")
def knn_topk(spark: SparkSession, d: str) -> DataFrame:
    vectors = _t(spark, d, "chunk_vectors")
    near = knn.knn_topk(vectors, "vec_id", "embedding", vectors.filter("vec_id % 50 = 0"), "vec_id", "embedding")
    return near.select("query_id", F.col("id").alias("vec_id"), "distance", F.col("rank").cast("long").alias("rank"))


@query(f"with {SQL_VECTORS} select vec_id, round(sqrt(list_sum(list_transform(e, lambda x: x * x))), 5) as norm, round(e[1] / sqrt(list_sum(list_transform(e, lambda x: x * x))), 5) as first from v")
def unit_vectors(spark: SparkSession, d: str) -> DataFrame:
    v = _t(spark, d, "chunk_vectors").filter(knn.usable(F.col("embedding"), 64))
    return v.select("vec_id", F.round(knn.l2_norm(F.col("embedding")), 5).alias("norm"), F.round(knn.l2_normalised(F.col("embedding"))[0], 5).alias("first"))


def _hybrid_inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Each evaluation item asks with its text and with the vector of the same number."""
    vectors = _t(spark, d, "chunk_vectors")
    items = _t(spark, d, "eval_items").select(F.col("item_id").alias("query_id"), "query")
    queries = items.join(vectors.select(F.col("vec_id").alias("query_id"), "embedding"), "query_id", "left")
    return _t(spark, d, "bm25_cache"), vectors, queries


SQL_FUSED = SQL_BM25_TOP.format(where="") + f""", {SQL_VECTORS},
vp as (select q.vec_id as query_id, b.vec_id, b.row_id, round(1 - list_cosine_similarity(q.e, b.e), 6) as distance from v q join eval_items e on e.item_id = q.vec_id, v b),
vr as (select *, row_number() over (partition by query_id order by distance, vec_id) - 1 as rank from vp),
vh as (select query_id, row_id as doc_id, min(distance) as distance, min(rank) as rank from vr where rank < 15 and row_id is not null group by all),
fu as (select coalesce(vh.query_id, top.query_id) as query_id, coalesce(vh.doc_id, top.doc_id) as doc_id, vh.rank as vector_rank, vh.distance as vector_distance, top.rank as bm25_rank, round(top.score, 6) as bm25_score,
  round(coalesce(1.0::double / (60 + vh.rank), 0) + coalesce(1.0::double / (60 + top.rank), 0), 9) as rrf_score from vh full outer join top on vh.query_id = top.query_id and vh.doc_id = top.doc_id),
fused as (select * from (select *, row_number() over (partition by query_id order by rrf_score desc, doc_id) as candidate_rank from fu) where candidate_rank <= 8)
"""  # fmt: skip


@query(SQL_FUSED + "select query_id as item_id, doc_id as row_id, vector_rank, vector_distance, bm25_rank, bm25_score, rrf_score, candidate_rank from fused")
def retrieval_explain(spark: SparkSession, d: str) -> DataFrame:
    found = retrieval.candidates(*_hybrid_inputs(spark, d))
    return found.select(
        F.col("query_id").alias("item_id"), F.col("doc_id").alias("row_id"), F.col("vector_rank").cast("long").alias("vector_rank"), "vector_distance",
        F.col("bm25_rank").cast("long").alias("bm25_rank"), F.round("bm25_score", 6).alias("bm25_score"), "rrf_score", F.col("candidate_rank").cast("long").alias("candidate_rank"),
    )


SQL_RERANKED = SQL_FUSED + """,
tx as (select f.*, b.documents as text, b.source, b.page from fused f join bm25_cache b on b.row_id = f.doc_id where trim(b.documents) <> ''),
sc as (select tx.*, round(len(list_intersect(qtok.tokens, tok.tokens)) / greatest(len(qtok.tokens), 1) * 4 - 2, 6) as rerank_score from tx join tok on tok.id = tx.doc_id join qtok on qtok.id = tx.query_id),
ju as (select *, max(rerank_score) over (partition by query_id) as best, max(rrf_score) over (partition by query_id) as best_rrf, row_number() over (partition by query_id order by rerank_score desc, rrf_score desc, doc_id) as final_rank from sc),
ac as (select *, case when best >= -1 then 'score' when best_rrf >= 0.015 then 'fallback' end as accepted_by from ju where final_rank <= 3),
ok as (select * from ac where accepted_by is not null)
"""


@query(SQL_RERANKED + "select query_id as item_id, doc_id as row_id, rerank_score, accepted_by, final_rank from ok")
def rerank_decisions(spark: SparkSession, d: str) -> DataFrame:
    found = retrieval.retrieve(*_hybrid_inputs(spark, d))
    return found.select(F.col("query_id").alias("item_id"), F.col("doc_id").alias("row_id"), "rerank_score", "accepted_by", F.col("final_rank").cast("long").alias("final_rank"))


@query(SQL_RERANKED + f""",
bu as (select *, sum(length(text) + 2) over (partition by query_id order by final_rank) as used from ok),
ke as (select *, case when final_rank = (select min(final_rank) from ok o where o.query_id = bu.query_id) and used > 2002 then rtrim(text[:2000]) else text end as kept from bu where used <= 2002 or final_rank = (select min(final_rank) from ok o where o.query_id = bu.query_id)),
ci as (select query_id, {SQL_BASE.format("source")} as name, page, min(final_rank) as fr from ke group by all)
select query_id as item_id, length(string_agg(kept, chr(10) || chr(10) order by final_rank)) as context_length, sha256(string_agg(kept, chr(10) || chr(10) order by final_rank)) as context_hash,
  (select string_agg(coalesce(name, '?') || '#' || coalesce(page::varchar, '?'), ',' order by fr) from ci where ci.query_id = ke.query_id) as citations from ke group by query_id""")
def hybrid_contexts(spark: SparkSession, d: str) -> DataFrame:
    made = retrieval.contexts(retrieval.retrieve(*_hybrid_inputs(spark, d)), 2000)
    cited = F.array_join(F.transform("citations", lambda c: F.concat(F.coalesce(c["name"], F.lit("?")), F.lit("#"), F.coalesce(c["page"].cast("string"), F.lit("?")))), ",")
    return made.select(F.col("query_id").alias("item_id"), F.length("context").cast("long").alias("context_length"), F.sha2("context", 256).alias("context_hash"), cited.alias("citations"))


def hybrid_retrieval(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: accepted texts of every evaluation query."""
    found = retrieval.retrieve(*_hybrid_inputs(spark, d))
    return found.select(F.col("query_id").alias("item_id"), F.col("doc_id").alias("row_id"), "source", "page", "rrf_score", "rerank_score", "accepted_by", "final_rank")


@query(f"select {SQL_BASE.format('source')} as source, row_id // 100000 as block, count(*) as n_rows, array_to_string(list_sort(list(row_id)), ',') as row_ids from bm25_cache where source is not null group by 1, 2")
def source_inverted_list(spark: SparkSession, d: str) -> DataFrame:
    chunks = _t(spark, d, "bm25_cache").filter("source is not null")
    lists = bm25.source_lists(chunks, "row_id", text.base_name(F.col("source")))
    return lists.select("source", "block", F.col("rows").alias("n_rows"), F.array_join(F.col("ids").cast("array<string>"), ",").alias("row_ids"))


@query("select row_id, lower(has_visual) = 'true' as visual, nullif(trim(string_split(image_path, ',')[1]), '') as first_image, len(list_filter(string_split(coalesce(image_path, ''), ','), lambda p: trim(p) <> '')) as n_images from bm25_cache")
def visual_flags(spark: SparkSession, d: str) -> DataFrame:
    paths = F.split(F.coalesce("image_path", F.lit("")), ",")
    first = F.nullif(F.trim(F.split("image_path", ",")[0]), F.lit(""))
    return _t(spark, d, "bm25_cache").select("row_id", (F.lower("has_visual") == "true").alias("visual"), first.alias("first_image"), F.size(F.filter(paths, lambda p: F.trim(p) != "")).cast("long").alias("n_images"))


@query(r"select row_id, case when length(t) > 120 then t[:120] || '...' else t end as preview from (select row_id, trim(regexp_replace(coalesce(documents, ''), '[\s\p{Z}]+', ' ', 'g')) as t from bm25_cache)")
def text_previews(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "bm25_cache").select("row_id", text.preview(F.col("documents"), 120).alias("preview"))


@query(r"select row_id, lower(trim(regexp_extract(regexp_extract(documents, '(?i)---\s*SOURCE:\s*(.*?)\s*\|\s*PAGE\s*([^-\n]+?)\s*---', 1), '[^/\\]*$'))) as marked_source, lower(trim(regexp_extract(documents, '(?i)---\s*SOURCE:\s*(.*?)\s*\|\s*PAGE\s*([^-\n]+?)\s*---', 2))) as marked_page from bm25_cache where documents is not null")
def marker_keys(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "bm25_cache").filter("documents is not null").select("row_id", text.source_block_key(F.col("documents")).alias("k"))
    return rows.select("row_id", F.col("k.source").alias("marked_source"), F.col("k.page").alias("marked_page"))


@query(f"""with m as (select item_id, query, '/' || coalesce(expected_sources[1], 'nowhere.pdf') || ' ' || trim(coalesce(query, '')) as q from eval_items),
e as (select item_id, q, nullif(lower(regexp_extract(q, '(?:^|\\s)/([\\w.-]+)', 1)), '') as cmd, trim(regexp_replace(q, '(?:^|\\s)/([\\w.-]+)', '', 'g')) as standalone from m)
select item_id, standalone, case when exists (select 1 from bm25_cache b where contains(lower({SQL_BASE.format('b.source')}), cmd)) then cmd end as source_filter from e""")
def slash_commands(spark: SparkSession, d: str) -> DataFrame:
    asked = F.concat(F.lit("/"), F.coalesce(F.try_element_at("expected_sources", F.lit(1)), F.lit("nowhere.pdf")), F.lit(" "), F.trim(F.coalesce("query", F.lit(""))))
    queries = _t(spark, d, "eval_items").select("item_id", asked.alias("q"))
    sources = _t(spark, d, "bm25_cache").select(text.base_name(F.col("source")).alias("s")).filter("s is not null")
    return querying.with_source_filter(queries, "q", sources, "s").select("item_id", "standalone", "source_filter")


EXPANSIONS = [(["rated", "value"], "nominal reading limit"), (["tool", "remove"], "release clamp removal"), (["report", "code"], "firmware code message")]


@query(r"""with a as (select result_id, trim(coalesce(query, '')) as t, lower(coalesce(template_type, '')) as k from faithfulness_results),
b as (select *, trim(regexp_replace(regexp_replace(regexp_replace(t, '(?i)\basd[-\s]?ste100\b|\bprocedure\b|\bdescriptive\s+text\b|\bsafety\s+warning\b|\bsafety\s+caution\b', ' ', 'g'), '[^A-Za-z0-9./_-]+', ' ', 'g'), '\s+', ' ', 'g')) as c from a),
e as (select *, case when contains(lower(c), 'rated') and contains(lower(c), 'value') then 'nominal reading limit' when contains(lower(c), 'tool') and contains(lower(c), 'remove') then 'release clamp removal'
  when contains(lower(c), 'report') and contains(lower(c), 'code') then 'firmware code message' else '' end as x, case when k = 'safety' then 'warning caution danger safety' else '' end as y from b)
select result_id, coalesce(nullif(array_to_string(list_filter([c, x, y], lambda z: z <> ''), ' '), ''), t) as retrieval_query from e""")
def query_expansion(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "faithfulness_results")
    return rows.select("result_id", querying.retrieval_query(F.col("query"), F.col("template_type"), EXPANSIONS).alias("retrieval_query"))


@query(f"select result_id, len(s) as n_sentences, coalesce(list_max(list_transform(s, lambda x: {SQL_WORDS.format('x')})), 0) as longest, {SQL_WORDS.format("coalesce(f, '')")} as n_words from (select result_id, final_text as f, {SQL_SENTENCES.format('final_text')} as s from faithfulness_results)")
def sentence_lengths(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "faithfulness_results").select("result_id", "final_text", text.sentences(F.col("final_text")).alias("s"))
    longest = F.coalesce(F.array_max(F.transform("s", text.word_count)), F.lit(0))
    return rows.select("result_id", F.size("s").cast("long").alias("n_sentences"), longest.cast("long").alias("longest"), text.word_count(F.col("final_text")).cast("long").alias("n_words"))


SQL_INSTRUCTION = r"(regexp_matches({0}, '(?i)^(?:\d+[).\s-]+|[A-Z][).\s-]+|[-*•]\s+)') or lower(regexp_extract({0}, '[A-Za-z][A-Za-z-]*')) in (" + ", ".join(f"'{w}'" for w in answers.COMMANDS) + "))"
SQL_STYLE_MARKERS = sql_markers("final_text", answers.STYLE_MARKERS, [(r"^\s*tags\.\s*$", r"^\s*tags\.\s*$"), (r"^\s*plan\s*:\s*$", r"^\s*plan\s*:\s*$")])
SQL_STYLE = rf"""with a as (select result_id, strict_mode, is_compliant, lower(coalesce(template_type, '')) as k, final_text, {SQL_SENTENCES.format("final_text")} as s,
  len(list_filter(string_split(regexp_replace(coalesce(final_text, ''), '\r\n|[\r\x0b\x0c\x1c-\x1e]', chr(10), 'g'), chr(10)), lambda x: {SQL_INSTRUCTION.format(SQL_STRIP.format("x"))})) as n, {SQL_STYLE_MARKERS} as m from faithfulness_results),
b as (select *, len(list_filter(s, lambda x: {SQL_WORDS.format("x")} > case when k = 'procedure' then 20 else 25 end)) as n_long, k <> 'procedure' or n >= 1 as lines_ok,
  k <> 'safety' or contains(lower(coalesce(final_text, '')), 'warning') or contains(lower(coalesce(final_text, '')), 'caution') or contains(lower(coalesce(final_text, '')), 'danger') as risk_ok from a)"""


@query(SQL_STYLE + " select result_id, n_long = 0 and lines_ok and risk_ok and len(m) = 0 as passed, n_long as n_long, n as instruction_lines, lines_ok, risk_ok, array_to_string(m, ';') as markers, (n_long > 0)::int + (not lines_ok)::int + (not risk_ok)::int + (len(m) > 0)::int as n_feedback from b")
def style_audit(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("int")
    a = answers.style_audit(F.col("final_text"), F.col("template_type"), none, none, F.lit(True))
    rows = _wide(spark, d, "faithfulness_results", "result_id", "final_text", "template_type").select("result_id", a.alias("a"))
    return rows.select(
        "result_id", "a.passed", F.size("a.long_sentences").cast("long").alias("n_long"), F.col("a.instruction_lines").cast("long").alias("instruction_lines"), F.col("a.instruction_ok").alias("lines_ok"),
        F.col("a.risk_word_ok").alias("risk_ok"), F.array_join("a.markers", ";").alias("markers"), F.size("a.feedback").alias("n_feedback"),
    )


@query(f"select result_id, array_to_string({sql_markers('final_text', answers.EVAL_MARKERS, [(r'^\s*tags\.\s*$', 'tags.'), (r'^\s*plan\s*:\s*$', 'plan:')])}, ';') as markers from faithfulness_results")
def output_markers(spark: SparkSession, d: str) -> DataFrame:
    return _wide(spark, d, "faithfulness_results", "result_id", "final_text").select("result_id", F.array_join(answers.eval_markers(F.col("final_text")), ";").alias("markers"))


def _sql_any(c: str, markers: list[str]) -> str:
    return "(" + " or ".join(f"contains(lower({c}), '{m.replace(chr(39), chr(39) * 2)}')" for m in markers) + ")"


SQL_CLEAN = rf"""with a as (select result_id, coalesce(final_text, '') as t from faithfulness_results),
b as (select result_id, {SQL_STRIP.format(r"case when regexp_matches(t, '(?is)<\s*answer\s*>(.*?)<\s*/\s*answer\s*>') then regexp_extract(t, '(?is)<\s*answer\s*>(.*?)<\s*/\s*answer\s*>', 1) else regexp_replace(regexp_replace(t, '(?is)<\s*think\b[^>]*>.*?<\s*/\s*think\s*>|<\s*thinking\b[^>]*>.*?<\s*/\s*thinking\s*>', '', 'g'), '(?is)<\s*(thinking|think)\b[^>]*>.*$', '', 'g') end")} as t from a),
c as (select result_id, {SQL_STRIP.format(r"regexp_replace(t, '(?i)<\s*/?\s*(answer|thinking|think)\s*>', '', 'g')")} as t from b),
ls as (select result_id, string_split(t, chr(10)) as l from c),
d1 as (select result_id, coalesce(list_position(list_transform(l, lambda x: not regexp_matches(x, '{answers.PROMPT_LINE}')), true), 0) as f, l from ls),
d2 as (select result_id, {SQL_STRIP.format("case when f = 0 then '' else array_to_string(l[f:], chr(10)) end")} as t from d1),
e1 as (select result_id, t, list_filter(list_transform(regexp_split_to_array(t, '\n\s*\n'), lambda x: {SQL_STRIP.format("x")}), lambda x: x <> '') as p from d2),
e2 as (select result_id, t, p, coalesce(list_position(list_transform(p, lambda x: not {_sql_any("x", answers.PLAN_MARKERS)}), true), 0) as f from e1),
e3 as (select result_id, string_split(case when f > 0 then array_to_string(p[f:], chr(10) || chr(10)) else t end, chr(10)) as l from e2),
g1 as (select result_id, l, len(list_filter(l, lambda x: regexp_matches(x, '(?i)^\s*plan\s*:\s*$'))) > 0 as headed from e3),
g2 as (select result_id, l, coalesce(list_position(list_transform(l, lambda x: not (trim(x) = '' or {_sql_any("x", answers.PLAN_MARKERS)} or (headed and regexp_matches(x, '^\s*(?:\d+[).\s-]+|[-*•]\s+)')))), true), 0) as f from g1),
h as (select result_id, {SQL_STRIP.format("case when f = 0 then '' else array_to_string(l[f:], chr(10)) end")} as t from g2)
select result_id, case when {_sql_any("t", answers.LEAK_MARKERS)} then '' else t end as answer from h"""


@query(SQL_CLEAN)
def cleaned_answers(spark: SparkSession, d: str) -> DataFrame:
    return _wide(spark, d, "faithfulness_results", "result_id", "final_text").select("result_id", answers.cleaned_output(F.col("final_text")).alias("answer"))


@query("select result_id, " + " or ".join(f"contains(lower(coalesce(final_text, '')), '{m}')" for m in text.NOT_FOUND) + " as not_found from faithfulness_results")
def not_found_flags(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "faithfulness_results").select("result_id", text.says_not_found(F.col("final_text")).alias("not_found"))


SQL_NORM = r"trim(regexp_replace(regexp_replace(regexp_replace(replace(lower(nfc_normalize(coalesce({0}, ''))), 'ı', 'i'), '[-_/\\]+', ' ', 'g'), '[^a-z0-9.%+#]+', ' ', 'g'), ' +', ' ', 'g'))"


@query(f"select item_id, {SQL_NORM.format('query')} as normalised, replace({SQL_NORM.format('query')}, ' ', '') as compact from eval_items")
def normalised_queries(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "eval_items").select("item_id", text.eval_normalised(F.col("query")).alias("normalised"), text.eval_compact(F.col("query")).alias("compact"))


SQL_IN = "({p} = '' or contains({n}, {p}) or (replace({p}, ' ', '') <> '' and contains(replace({n}, ' ', ''), replace({p}, ' ', ''))))"
SQL_JUDGED = f"""j as (select r.result_id, r.collection_name, coalesce(r.strict_mode, false) as strict_mode, r.final_text, r.is_compliant, r.expected_not_found, e.expected_sources as es, e.expected_pages as ep, coalesce(e.expected_keywords, []) as kw, coalesce(e.must_not_include, []) as mn,
  list_transform(r.returned_sources, lambda s: s.source) as rs, list_transform(r.returned_sources, lambda s: s.page) as rp, {SQL_NORM.format("r.final_text")} as n from faithfulness_results r join eval_items e using (item_id)),
k as (select *, case when len(kw) = 0 then 1.0 else len(list_filter(kw, lambda x: {SQL_IN.format(p="(" + SQL_NORM.format("x") + ")", n="n")})) / len(kw) end as keyword_rate, len(list_filter(mn, lambda x: {SQL_IN.format(p="(" + SQL_NORM.format("x") + ")", n="n")})) as n_forbidden,
  coalesce(len(es), 0) = 0 or coalesce(list_has_any(list_transform(es, lambda x: {SQL_BASE.format("x")}), list_transform(rs, lambda x: {SQL_BASE.format("x")})), false) as source_hit,
  coalesce(len(ep), 0) = 0 or coalesce(len(list_filter(rp, lambda p: len(list_filter(ep, lambda q: abs(p - q) <= 1)) > 0)) > 0, false) as page_hit,
  {" or ".join(f"contains(lower(coalesce(final_text, '')), '{m}')" for m in text.NOT_FOUND)} as missing, len({sql_markers("final_text", answers.EVAL_MARKERS, [(r"^\\s*tags\\.\\s*$", "tags."), (r"^\\s*plan\\s*:\\s*$", "plan:")])}) = 0 as no_leak from j)"""  # fmt: skip


def _judged(spark: SparkSession, d: str) -> DataFrame:
    items = _t(spark, d, "eval_items").select("item_id", "expected_sources", "expected_pages", "expected_keywords", "must_not_include")
    rows = _t(spark, d, "faithfulness_results").join(items, "item_id")
    answer = F.col("final_text")
    none = F.lit(None).cast("int")
    return rows.select(
        "result_id", "collection_name", F.coalesce("strict_mode", F.lit(False)).alias("strict_mode"), "final_text", "is_compliant", "expected_not_found",
        evaluation.hit_rate(answer, evaluation.expected_groups(F.col("expected_keywords"))).alias("keyword_rate"),
        F.size(evaluation.forbidden_hits(answer, evaluation.expected_groups(F.col("must_not_include")))).alias("n_forbidden"),
        evaluation.source_hit(F.col("expected_sources"), F.col("returned_sources.source")).alias("source_hit"),
        evaluation.page_hit(F.col("expected_pages"), F.col("returned_sources.page")).alias("page_hit"),
        text.says_not_found(answer).alias("missing"), (F.size(answers.eval_markers(answer)) == 0).alias("no_leak"),
        answers.style_audit(answer, F.col("template_type"), none, none, F.lit(False))["passed"].alias("style_ok"),
    )


@query(f"with {SQL_JUDGED} select result_id, round(keyword_rate, 6) as keyword_rate, n_forbidden, source_hit, page_hit from k")
def expectation_hits(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d).select("result_id", F.round("keyword_rate", 6).alias("keyword_rate"), F.col("n_forbidden").cast("long").alias("n_forbidden"), "source_hit", "page_hit")


def _retrieval_ok(j: DataFrame) -> Column:
    return evaluation.retrieval_passed(F.col("final_text"), F.col("source_hit"), F.col("page_hit"), F.col("keyword_rate"))


def _faithful_ok(j: DataFrame) -> Column:
    return evaluation.faithfulness_passed(F.col("expected_not_found"), F.col("missing"), F.col("source_hit"), F.col("keyword_rate"), F.col("n_forbidden") == 0, F.col("no_leak"))


SQL_RETRIEVAL_OK = "(trim(coalesce(final_text, '')) <> '' and source_hit and page_hit and keyword_rate >= 0.5)"
SQL_FAITHFUL_OK = "(case when coalesce(expected_not_found, false) then missing and n_forbidden = 0 and no_leak else not missing and source_hit and keyword_rate >= 0.5 and n_forbidden = 0 and no_leak end)"


@query(f"with {SQL_JUDGED} select result_id, {SQL_RETRIEVAL_OK} as retrieval_passed, {SQL_FAITHFUL_OK} as faithfulness_passed from k")
def case_verdicts(spark: SparkSession, d: str) -> DataFrame:
    j = _judged(spark, d)
    return j.select("result_id", _retrieval_ok(j).alias("retrieval_passed"), _faithful_ok(j).alias("faithfulness_passed"))


@query(f"with {SQL_JUDGED} select collection_name, count(*) as cases, count(*) filter (where {SQL_RETRIEVAL_OK}) as passed, round(avg(source_hit::int), 6) as source_rate, round(avg(page_hit::int), 6) as page_rate, round(avg(keyword_rate), 6) as keyword_rate from k group by 1")
def retrieval_summary(spark: SparkSession, d: str) -> DataFrame:
    j = _judged(spark, d)
    return evaluation.summary(j, ["collection_name"], {"source_rate": F.col("source_hit").cast("int"), "page_rate": F.col("page_hit").cast("int"), "keyword_rate": F.col("keyword_rate")}, _retrieval_ok(j))


@query(f"with {SQL_JUDGED} select coalesce(expected_not_found, false) as not_found_expected, count(*) as cases, count(*) filter (where {SQL_FAITHFUL_OK}) as passed, round(avg(keyword_rate), 6) as include_rate, round(avg((n_forbidden = 0)::int), 6) as clean_rate, round(avg(no_leak::int), 6) as leak_free_rate from k group by 1")
def faithfulness_summary(spark: SparkSession, d: str) -> DataFrame:
    j = _judged(spark, d).withColumn("not_found_expected", F.coalesce("expected_not_found", F.lit(False)))
    rates = {"include_rate": F.col("keyword_rate"), "clean_rate": (F.col("n_forbidden") == 0).cast("int"), "leak_free_rate": F.col("no_leak").cast("int")}
    return evaluation.summary(j, ["not_found_expected"], rates, _faithful_ok(j))


@query(f"with {SQL_JUDGED} select strict_mode, count(*) as cases, count(*) filter (where {SQL_FAITHFUL_OK}) as passed, round(avg(coalesce(is_compliant, false)::int), 6) as compliant_rate, round(avg(no_leak::int), 6) as leak_free_rate from k group by rollup (strict_mode)")
def strict_mode_summary(spark: SparkSession, d: str) -> DataFrame:
    j = _judged(spark, d)
    rates = {"compliant_rate": F.coalesce("is_compliant", F.lit(False)).cast("int"), "leak_free_rate": F.col("no_leak").cast("int")}
    return evaluation.summary(j, ["strict_mode"], rates, _faithful_ok(j), rollup=True)


PLAIN_SQL = ", ".join(f"'{w}'" for w in answers.PLAIN_WORDS)
SQL_GROUND = r"trim(regexp_replace(replace(lower({0}), 'μ', 'u'), '[\s\p{{Z}}]+', ' ', 'g'))"
SQL_UNITS_OF = (
    r"list_concat(list_filter(list_transform(string_split({0}, chr(10)), lambda x: " + SQL_STRIP.replace("{0}", "x") + r"), lambda x: x <> ''), "
    r"list_filter(list_transform(list_filter(list_transform(string_split({0}, chr(10)), lambda x: trim(x)), lambda x: contains(x, '|')), lambda x: array_to_string(list_filter(list_transform(string_split(x, '|'), lambda y: trim(y)), lambda y: y <> ''), ' ')), lambda x: x <> ''), "
    r"list_filter(list_transform(string_split(regexp_replace(regexp_replace({0}, '[\s\p{{Z}}]+', ' ', 'g'), '([.!?])\s+', '\1' || chr(10), 'g'), chr(10)), lambda x: " + SQL_STRIP.replace("{0}", "x") + r"), lambda x: x <> ''))"
)
SQL_CLAIM = r"list_distinct(list_transform(list_filter(regexp_extract_all(coalesce({0}, ''), '[A-Za-z0-9][A-Za-z0-9./_+-]*'), lambda t: lower(t) not in (" + PLAIN_SQL + r") and (regexp_matches(t, '[0-9./_+-]') or (regexp_matches(t, '[A-Z]') and length(t) <= 12) or (length(t) >= 2 and not regexp_matches(t, '[a-z]')))), lambda t: lower(t)))"


@query(f"""with a as (select r.result_id, {SQL_CLAIM.format("r.final_text")} as tk, list_transform({SQL_UNITS_OF.format("coalesce(e.passage, '')")}, lambda u: {SQL_GROUND.format("u")}) as un from faithfulness_results r join eval_items e using (item_id))
select result_id, len(tk) as n_tokens, len(un) as n_units, len(tk) > 0 and len(list_filter(un, lambda u: len(list_filter(tk, lambda t: not (case when regexp_matches(t, '[^a-z0-9]') then contains(u, t) else contains(' ' || regexp_replace(u, '[^a-z0-9]', ' ', 'g') || ' ', ' ' || t || ' ') end))) = 0)) > 0 as grounded from a""")
def grounding_check(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "faithfulness_results").join(_t(spark, d, "eval_items").select("item_id", "passage"), "item_id")
    claim, context = F.col("final_text"), F.coalesce("passage", F.lit(""))
    return rows.select("result_id", F.size(answers.claim_tokens(claim)).cast("long").alias("n_tokens"), F.size(answers.evidence_units(context)).cast("long").alias("n_units"), answers.grounded(claim, context).alias("grounded"))


@query("""select result_id, case when was_corrected then 'UNSUPPORTED' when not was_corrected then 'SUPPORTED' else '' end as verdict,
case when len(feedback_report) > 1 then 'a|b' when len(feedback_report) = 1 then 'one' else '3' end as claims from faithfulness_results""")
def verdict_parsing(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "faithfulness_results")
    claims = F.when(F.size("feedback_report") > 1, '["a", "b"]').when(F.size("feedback_report") == 1, '"one"').otherwise("3")
    said = F.when(F.col("was_corrected"), " unsupported ").when(~F.col("was_corrected"), "Supported").otherwise("")
    raw = F.concat(F.lit('Here: {"verdict": "'), said, F.lit('", "unsupported_claims": '), claims, F.lit("} end"))
    verdict, found = querying.verdict_of(text.json_in(raw))
    return rows.select("result_id", verdict.alias("verdict"), F.array_join(found, "|").alias("claims"))


@query("""with t as (select collection_name as c, result_id, logged_at, 2 * result_id as turn, 'user' as role, query as x from faithfulness_results union all select collection_name, result_id, logged_at, 2 * result_id + 1, 'assistant', final_text from faithfulness_results),
r as (select *, row_number() over (partition by c order by logged_at desc, turn desc) as n from t where trim(coalesce(x, '')) <> '')
select c as collection_name, string_agg(case when role = 'user' then 'User: ' else 'Assistant: ' end || x, chr(10) order by n desc) as history from r where n <= 6 group by 1""")
def history_last_turns(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "faithfulness_results")
    both = F.array(F.struct(F.lit("user").alias("role"), (2 * F.col("result_id")).alias("turn"), F.col("query").alias("x")), F.struct(F.lit("assistant").alias("role"), (2 * F.col("result_id") + 1).alias("turn"), F.col("final_text").alias("x")))
    turns = rows.select("collection_name", "logged_at", F.explode(both).alias("t")).select("collection_name", "logged_at", "t.*")
    return fusion.last_turns(turns, "collection_name", ["logged_at", "turn"], "role", "x", 6)


@query("select collection_name, max_by(final_text, struct_pack(a := logged_at, b := result_id)) as context from faithfulness_results where logged_at is not null and final_text is not null group by 1")
def last_assistant_text(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "faithfulness_results").filter("logged_at is not null and final_text is not null").select("collection_name", F.struct("logged_at", "result_id").alias("at"), F.lit("assistant").alias("role"), "final_text")
    return fusion.last_context(rows, "collection_name", "at", "role", "final_text")


# --- ingestion and state ---------------------------------------------------------------------------------------------


@query("select row_id, sha256(documents) as text_hash, sha256(coalesce(ingestion_signature || chr(10), '') || coalesce(chunk_index::varchar || chr(10), '') || documents) as chunk_hash_again, length('--- SOURCE: ' || source || ' | PAGE ' || coalesce(page::varchar, '?') || ' ---' || chr(10) || documents) as marked_length from bm25_cache where documents is not null and source is not null")
def chunk_hashes(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "bm25_cache").filter("documents is not null and source is not null")
    c = {n: F.col(n) for n in ("documents", "ingestion_signature", "chunk_index", "source", "page")}
    return rows.select("row_id", hashing.text_hash(c["documents"]).alias("text_hash"), hashing.chunk_hash(c["ingestion_signature"], c["chunk_index"], c["documents"]).alias("chunk_hash_again"), F.length(hashing.decorated(c["source"], c["page"], c["documents"])).cast("long").alias("marked_length"))


@query("""select manifest_id, sha256('{"chunker": ' || q(chunker) || ', "collection_name": ' || q(collection_name) || ', "document_hash": ' || q(document_hash) || ', "embedding_dimension": ' || coalesce(embedding_dimension::varchar, 'null') || ', "embedding_model": ' || q(embedding_model) || ', "max_chunk_length": ' || coalesce(max_chunk_length::varchar, 'null') || '}') as signature from manifest""".replace("q(chunker)", "coalesce('\"' || chunker || '\"', 'null')").replace("q(collection_name)", "coalesce('\"' || collection_name || '\"', 'null')").replace("q(document_hash)", "coalesce('\"' || document_hash || '\"', 'null')").replace("q(embedding_model)", "coalesce('\"' || embedding_model || '\"', 'null')"))
def ingestion_signatures(spark: SparkSession, d: str) -> DataFrame:
    cols = [F.col(c) for c in ("document_hash", "collection_name", "embedding_model", "embedding_dimension", "chunker", "max_chunk_length")]
    return _t(spark, d, "manifest").select("manifest_id", hashing.signature(*cols).alias("signature"))


SQL_MANIFEST = """mt as (select *, coalesce(try_strptime(replace(replace(trim(ingested_at), 'Z', ''), '+00:00', ''), '%Y-%m-%dT%H:%M:%S'), try_strptime(trim(ingested_at), '%Y-%m-%d %H:%M:%S'), try_strptime(trim(ingested_at), '%Y-%m-%d %H:%M'), try_strptime(trim(ingested_at), '%d.%m.%Y %H:%M:%S'), try_strptime(trim(ingested_at), '%d.%m.%Y %H:%M'), try_strptime(trim(ingested_at), '%d/%m/%Y %H:%M:%S'), try_strptime(trim(ingested_at), '%d/%m/%Y %H:%M'), try_strptime(trim(ingested_at), '%Y-%m-%d')) as ts from manifest),
ml as (select * from (select *, row_number() over (partition by filename order by ts desc nulls last, manifest_id desc) as n from mt) where n = 1)"""  # fmt: skip


@query(f"with {SQL_MANIFEST} select filename, manifest_id, chunk_count, strftime(ts, '%Y-%m-%d %H:%M:%S') as ingested from ml")
def manifest_latest(spark: SparkSession, d: str) -> DataFrame:
    m = store.latest_manifest(_t(spark, d, "manifest"))
    return m.select("filename", "manifest_id", "chunk_count", F.date_format("ingested_ts", "yyyy-MM-dd HH:mm:ss").alias("ingested"))


@query(f"""with {SQL_MANIFEST}, inc as (select distinct {SQL_BASE.format("source")} as filename, ingestion_signature as signature from bm25_cache where source is not null and ingestion_signature is not null),
done as (select distinct filename, ingestion_signature as signature from manifest where chunk_count is not null)
select inc.filename, inc.signature, case when ml.ingestion_signature is null then 'new' when ml.ingestion_signature <> inc.signature then 'changed' when done.signature is not null then 'unchanged' else 'resume' end as action
from inc left join ml on ml.filename = inc.filename left join done on done.filename = inc.filename and done.signature = inc.signature""")
def ingest_actions(spark: SparkSession, d: str) -> DataFrame:
    manifest = _t(spark, d, "manifest")
    chunks = _t(spark, d, "bm25_cache").filter("source is not null and ingestion_signature is not null")
    incoming = chunks.select(text.base_name(F.col("source")).alias("filename"), F.col("ingestion_signature").alias("signature")).distinct()
    # a record without a number of chunks is of an ingestion that did not end
    done = manifest.filter("chunk_count is not null").select("filename", F.col("ingestion_signature").alias("signature")).distinct()
    return store.ingest_actions(incoming, store.latest_manifest(manifest), done).select("filename", "signature", "action")


@query("select document_hash, count(*) as chunks, count(distinct chunk_hash) as distinct_chunks from bm25_cache group by 1")
def chunk_counts(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "bm25_cache").groupBy("document_hash").agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct("chunk_hash").alias("distinct_chunks"))


@query("with s as (select distinct chunk_hash from bm25_cache where collection_name = 'doc_store' and chunk_hash is not null) select collection_name, count(*) as n from (select 'doc_store' as collection_name, chunk_hash from s union all select distinct 'added', chunk_hash from bm25_cache where chunk_hash is not null and chunk_hash not in (select chunk_hash from s)) group by 1")
def chunk_upsert(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "bm25_cache").filter("chunk_hash is not null")
    stored = rows.filter("collection_name = 'doc_store'").select("chunk_hash", "collection_name").dropDuplicates(["chunk_hash"])
    both = store.upserted(stored, rows.select("chunk_hash", F.lit("added").alias("collection_name")), "chunk_hash")
    return both.groupBy("collection_name").agg(F.count(F.lit(1)).alias("n"))


@query("select collection_name, count(*) as n, count(distinct source) as sources from bm25_cache where source is distinct from 'velmora_service_handbook.pdf' group by 1")
def delete_source(spark: SparkSession, d: str) -> DataFrame:
    left = store.without_source(_t(spark, d, "bm25_cache"), "source", "velmora_service_handbook.pdf")
    return left.groupBy("collection_name").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source").alias("sources"))


@query("select distinct filename || '::' || ingestion_signature as key from manifest where filename is not null and ingestion_signature is not null and not starts_with(filename || '::' || ingestion_signature, 'velmora_service_handbook.pdf::')")
def checkpoint_set(spark: SparkSession, d: str) -> DataFrame:
    done = _t(spark, d, "manifest").filter("filename is not null and ingestion_signature is not null").select("filename", F.col("ingestion_signature").alias("signature"))
    return store.without_file(store.checkpoint_keys(done), "velmora_service_handbook.pdf")


@query("""with i as (select distinct trim(unnest(string_split(image_path, ','))) as p from bm25_cache where image_path is not null), c as (select distinct trim(string_split(image_path, ',')[1]) as p from bm25_cache)
select md5(p) as img_hash, case when p in (select p from c where p is not null) then 'cached ' || p else 'fresh ' || md5(p) end as caption from i where p <> ''""")
def caption_cache(spark: SparkSession, d: str) -> DataFrame:
    """Captions are known of the pictures that stand first in some row."""
    paths = F.filter(F.transform(F.split("image_path", ","), lambda p: F.trim(p)), lambda p: p != "")
    first = F.trim(F.split("image_path", ",")[0])
    each = _t(spark, d, "bm25_cache").select(F.explode(paths).alias("p")).distinct()
    images = each.select(F.md5(F.col("p").cast("binary")).alias("img_hash"), F.col("p").cast("binary").alias("content"))
    cache = _t(spark, d, "bm25_cache").select(first.alias("p")).filter("p <> ''").distinct().select(F.md5(F.col("p").cast("binary")).alias("img_hash"), F.concat(F.lit("cached "), "p").alias("caption"))
    fresh = lambda df: df.select("img_hash", F.concat(F.lit("fresh "), F.col("img_hash")).alias("caption"))
    return store.with_captions(images, cache, fresh).select("img_hash", "caption")


@query(f"""with a as (select {SQL_BASE.format("source")} as s, row_id, coalesce(parent_context, '') as h from bm25_cache where source is not null),
b as (select *, coalesce((lag(h) over (partition by s order by row_id) <> h)::int, 0) as c from a), e as (select *, sum(c) over (partition by s order by row_id rows unbounded preceding) as section from b)
select s as source, section::bigint as section, count(*) as n, min(row_id) as first_row from e group by 1, 2""")
def heading_sections(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "bm25_cache").filter("source is not null").select(text.base_name(F.col("source")).alias("source"), "row_id", F.coalesce("parent_context", F.lit("")).alias("h"))
    return chunking.section_ids(rows, "source", "row_id", F.col("h")).groupBy("source", "section").agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first_row"))


@query(rf"""with recursive ln as (select doc_id, unnest(string_split(text, chr(10))) as l, generate_subscripts(string_split(text, chr(10)), 1) as n from documents where text is not null),
li as (select doc_id, n, l, {SQL_STRIP.format("l")} as v, starts_with(l, '|') as tab from ln where trim(l) <> ''), it as materialized (select doc_id, row_number() over (partition by doc_id order by n) as i, l, v, tab from li where tab or v <> ''),
st(doc_id, i, cur, size, full_one, table_one) as (select distinct doc_id, 0::bigint, null::varchar, 0::bigint, null::varchar, null::varchar from it union all
  select s.doc_id, it.i, case when tab then null when cur is null then v when size + length(v) > 1500 then '... ' || right(cur, 200) || chr(10) || v else cur || chr(10) || v end,
    case when tab then 0 when cur is not null and size + length(v) > 1500 then 4 + least(200, length(cur)) + length(v) else size + length(v) end, case when tab or size + length(v) > 1500 then cur end, case when tab then l end
  from st s join it on it.doc_id = s.doc_id and it.i = s.i + 1),
ch as (select doc_id, i, 1 as k, full_one as t from st union all select doc_id, i, 2, table_one from st union all select doc_id, max(i), 3, max_by(coalesce(cur, chr(0)), i) from st group by 1)
select doc_id, (row_number() over (partition by doc_id order by i, k) - 1)::int as chunk_index, length(t) as chars, sha256(t) as text_hash from ch where t is not null and t <> chr(0)""")
def packed_chunks(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents").filter("text is not null")
    made = chunking.chunk_documents(chunking.line_items(docs, "doc_id", "text"))
    return made.select(F.col("source").cast("long").alias("doc_id"), "chunk_index", F.length("text").alias("chars"), F.sha2("text", 256).alias("text_hash"))


@query(f"""with c as (select {SQL_BASE.format("source")} as source, coalesce(page, 0) as page, row_id, coalesce(documents, '') as text, coalesce(image_path, '') as image_path from bm25_cache where source is not null),
im as (select source, page, row_id * 100 + i as img_idx, trim(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '' and not starts_with(x, '--- SOURCE:'))[1]) as anchor, trim(p) as path
  from (select *, unnest(string_split(image_path, ',')) as p, generate_subscripts(string_split(image_path, ','), 1) - 1 as i from c) where trim(p) <> ''),
p as (select im.source, im.img_idx, im.path, c.row_id, coalesce(im.anchor <> '' and contains(c.text, im.anchor), false) as hit from im join c using (source, page)),
r as (select *, row_number() over (partition by source, img_idx order by hit desc, row_id) as n from p), g as (select * from r where n = 1)
select row_id, count(*) as n_images, string_agg(path, ',' order by (not hit)::int, img_idx) as images from g group by 1""")
def image_injection(spark: SparkSession, d: str) -> DataFrame:
    """The pictures of every row, anchored by its first line of text, go back to the chunks of their page."""
    rows = _t(spark, d, "bm25_cache").filter("source is not null")
    page = rows.select(text.base_name(F.col("source")).alias("source"), F.coalesce("page", F.lit(0)).alias("page"), "row_id", F.coalesce("documents", F.lit("")).alias("text"), "image_path")
    lines = F.filter(F.split("text", "\n"), lambda x: (F.trim(x) != "") & ~x.startswith("--- SOURCE:"))
    images = page.select("source", "page", "row_id", F.trim(F.get(lines, F.lit(0))).alias("anchor_text"), F.posexplode(F.split("image_path", ",")).alias("i", "p")).filter(F.trim("p") != "")
    images = images.select("source", "page", (F.col("row_id") * 100 + F.col("i")).alias("img_idx"), "anchor_text", F.lit("").alias("summary"), F.trim("p").alias("image_path"))
    chunks = page.select("source", "page", F.col("row_id").alias("chunk_index"), "text", F.lit("").alias("image_path"))
    out = chunking.attach_images(chunks, images).filter("image_path <> ''")
    return out.select(F.col("chunk_index").alias("row_id"), F.size(F.split("image_path", ",")).cast("long").alias("n_images"), F.col("image_path").alias("images"))


SQL_RUNNING = " or ".join(f"contains(u, '{p}')" for p in chunking.RUNNING)


@query(f"with l as (select doc_id, upper(trim(unnest(string_split(text, chr(10))))) as u from documents where text is not null) select doc_id, count(*) as lines, count(*) filter (where u = '' or {SQL_RUNNING} or regexp_matches(u, '\\b\\d{{4}}-\\d{{2}}-\\d{{2}}\\b|ISSUE \\d+|PAGE [A-Z0-9-]+')) as unwanted from l group by 1")
def unwanted_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = _t(spark, d, "documents").filter("text is not null").select("doc_id", F.explode(F.split("text", "\n")).alias("l"))
    return lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.count_if(chunking.unwanted_line(F.col("l"))).alias("unwanted"))


# A small lexicon: words that the corpus uses, some of them not approved.
LEXICON = [("inspect", "v", False, ["CHECK"]), ("watch", None, False, ["LOOK AT", "MONITOR"]), ("align", "v", True, []), ("whenever", None, False, []), ("slowly", "adv", True, []), ("bleed", "v", False, ["DRAIN"])]
SQL_LEXICON = "lx(keyword, alt) as (values ('inspect', 'CHECK'), ('watch', 'LOOK AT, MONITOR'), ('whenever', 'an approved alternative'), ('bleed', 'DRAIN'))"


@query(f"""with {SQL_LEXICON}, w as (select row_id, regexp_extract_all(documents, '[\\p{{L}}\\p{{N}}]+(?:[-''’][\\p{{L}}\\p{{N}}]+)*') as ws from bm25_cache where documents is not null),
t as (select row_id, unnest(ws) as x, generate_subscripts(ws, 1) as i from w), h as (select row_id, 'Do not use the word ''' || x || '''. Use: ' || alt || '.' as m, min(i) as i from t join lx on lx.keyword = lower(x) group by 1, 2)
select row_id, string_agg(m, ' ' order by i) as messages from h group by 1""")
def lexicon_audit(spark: SparkSession, d: str) -> DataFrame:
    rules = spark.createDataFrame(LEXICON, "keyword string, pos string, is_approved boolean, alternatives array<string>")
    found = answers.lexicon_audit(_wide(spark, d, "bm25_cache", "row_id", "documents").filter("documents is not null"), "row_id", "documents", rules)
    return found.select(F.col("id").alias("row_id"), F.array_join("messages", " ").alias("messages"))


CORE_RULES = ["Use the approved words.", "Keep sentences short."]
TEMPLATE_RULES = {"procedure": ["Give one instruction in each sentence."], "safety": ["Begin with the level of risk."]}


@query("""select result_id, '<CORE_RULES>' || chr(10) || '- Use the approved words.' || chr(10) || '- Keep sentences short.' || chr(10) || '</CORE_RULES>' || chr(10) || chr(10) || '<DYNAMIC_RULES>' || chr(10) || 'Output Format Required: ' || upper(coalesce(template_type, 'general')) || case lower(template_type) when 'procedure' then chr(10) || '- Give one instruction in each sentence.' when 'safety' then chr(10) || '- Begin with the level of risk.' else '' end
|| chr(10) || '</DYNAMIC_RULES>' || chr(10) || case when len(feedback_report) > 0 then chr(10) || '<DICTIONARY_RESTRICTIONS>' || chr(10) || array_to_string(feedback_report, chr(10)) || chr(10) || '</DICTIONARY_RESTRICTIONS>' else '' end || ' Question: ' || coalesce(query, '') as prompt from faithfulness_results""")
def rule_prompts(spark: SparkSession, d: str) -> DataFrame:
    rules = querying.rules_prompt(CORE_RULES, TEMPLATE_RULES, F.col("template_type"), F.col("feedback_report"))
    prompt = querying.filled(F.lit("{rules} Question: {query}"), {"rules": rules, "query": F.col("query")})
    return _t(spark, d, "faithfulness_results").select("result_id", prompt.alias("prompt"))


@query("select collection_name, embedding_model, embedding_dimension, count(*) as chunks, count(distinct document_hash) as files from bm25_cache group by all")
def collection_listing(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "bm25_cache").groupBy("collection_name", "embedding_model", "embedding_dimension").agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct("document_hash").alias("files"))


@query(f"with a as (select row_id, {SQL_BASE.format('source')} as s, page, row_number() over (partition by {SQL_BASE.format('source')}, page order by row_id) as n from bm25_cache) select s as source, page, row_id from a where n = 1")
def citation_dedupe(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "bm25_cache").select(text.base_name(F.col("source")).alias("source"), "page", "row_id")
    return fusion.distinct_citations(rows, [], ["row_id"], ["source", "page"]).select("source", "page", "row_id")


# --- extensions ------------------------------------------------------------------------------------------------------


@query("select date_trunc('hour', ts) as window_start, event_type, count(*) as n, round(sum(value), 4) as total from events where ts is not null group by 1, 2")
def windowed_event_counts(spark: SparkSession, d: str) -> DataFrame:
    return event_windows(_t(spark, d, "events").filter("ts is not null"))


@query("select n_name, sum(l_extendedprice * (1 - l_discount))::decimal(38, 2)::double as revenue, count(*) as n from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey where o_orderstatus <> 'P' group by 1")
def revenue_by_nation(spark: SparkSession, d: str) -> DataFrame:
    lines, orders = _t(spark, d, "lineitem"), _t(spark, d, "orders").filter("o_orderstatus <> 'P'")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(_t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(_t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(38,2)").cast("double").alias("revenue"), F.count(F.lit(1)).alias("n"))


@query("select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(avg(l_discount), 6) as avg_disc, count(*) as n from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2")
def line_summary(spark: SparkSession, d: str) -> DataFrame:
    lines = _t(spark, d, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return lines.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from lodestrata.plans import page_queries  # noqa: F401 - registers its queries

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from lodestrata.plans import page_queries  # noqa: F401

    return dict(ORACLE)


__all__ = ["hybrid_retrieval", "oracle_sql", "queries"]
