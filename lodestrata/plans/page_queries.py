"""Queries of the operators on pages, dictionaries, verdicts and restricted retrieval, with the same results in SQL.

Pages, words and spans are made from the lines of documents: the page is the document, a line's position gives its top, a
word's position its left edge. Claims, verdicts and overrides are made from the logged answers. All rows take part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import text
from lodestrata.operators import answers, bm25, chunking, evaluation
from lodestrata.plans import answer
from lodestrata.plans.queries import SQL_CLAIM, SQL_GROUND, SQL_IN, SQL_INSTRUCTION, SQL_NORM, SQL_SENTENCES, SQL_STRIP, SQL_STYLE_MARKERS, SQL_TOKENS, SQL_UNITS_OF, SQL_WORDS, _t, _wide, query

SQL_LINES = "ln as (select doc_id, unnest(string_split(text, chr(10))) as l, generate_subscripts(string_split(text, chr(10)), 1) - 1 as n from documents where text is not null)"


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, n, l): the lines of documents, numbered from 0."""
    docs = _wide(spark, d, "documents", "doc_id", "text").filter("text is not null")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "l"))


# --- dictionary pages ------------------------------------------------------------------------------------------------


@query(f"""with {SQL_LINES}, w as (select doc_id, n, list_filter(string_split(l, ' '), lambda x: x <> '') as ws from ln),
c as (select doc_id, n, unnest([1, 2]) as col, unnest([array_to_string(ws[1:3], ' '), array_to_string(ws[4:6], ' ')]) as t from w where n between 80 and 919)
select doc_id as page, dense_rank() over (partition by doc_id order by n) - 1 as line, col::bigint as col, t as text from c where t <> ''""")
def page_columns(spark: SparkSession, d: str) -> DataFrame:
    words = _lines(spark, d).select("doc_id", "n", F.posexplode(F.filter(F.split("l", " "), lambda x: x != "")).alias("i", "text"))
    # 12 points a line; a third of a point of unrest within it; 1,000 lines on a page
    placed = words.select(F.col("doc_id").alias("page"), "text", (10.0 + 45 * F.col("i")).alias("x0"), (12.0 * F.col("n") + 1 + (F.col("i") % 4) / 3).alias("top"))
    lines = chunking.word_lines(chunking.columns_of(placed, F.lit(12_000.0)))
    return lines.select("page", F.col("line").cast("long").alias("line"), F.col("column").cast("long").alias("col"), "text")


SQL_TAGS = "['" + "', '".join(chunking.POS_TAGS) + "']"
#: A line whose first word begins with a capital opens an entry, with a tag by the word's length; long words are approved.
SQL_ENTRIES = f"""{SQL_LINES}, w as (select doc_id, n, list_filter(string_split(regexp_replace(l, '[^A-Za-z ]', ' ', 'g'), ' '), lambda x: x <> '') as ws from ln),
o as (select doc_id, n, ws, regexp_matches(ws[1], '^[A-Z]') and length(ws[1]) > 1 as opens, case when length(ws[1]) > 6 then upper(ws[1]) else ws[1] end as word, {SQL_TAGS}[(length(ws[1]) % 9) + 1] as pos from w where len(ws) > 0),
p as (select doc_id as page, n as line, case when opens then word || ' (' || pos || ')' else upper(ws[1]) end as c1, array_to_string(ws[2:5], ' ') || case when opens and length(word) % 2 = 0 then ' USE (v)' else '' end as c2 from o)"""


def _entry_lines(spark: SparkSession, d: str) -> DataFrame:
    # a generator's output is computed once: filters on it are not pushed into it
    ws = F.filter(F.split(F.regexp_replace("l", "[^A-Za-z ]", " "), " "), lambda x: x != "")
    words = _lines(spark, d).select("doc_id", "n", F.explode(F.array(ws)).alias("ws")).filter(F.size("ws") > 0)
    first = F.get("ws", F.lit(0))
    opens = first.rlike("^[A-Z]") & (F.length(first) > 1)
    word = F.when(F.length(first) > 6, F.upper(first)).otherwise(first)
    pos = F.element_at(F.array(*map(F.lit, chunking.POS_TAGS)), (F.length(first) % 9 + 1).cast("int"))
    c1 = F.when(opens, F.concat(word, F.lit(" ("), pos, F.lit(")"))).otherwise(F.upper(first))
    c2 = F.concat(F.array_join(F.slice("ws", 2, 4), " "), F.when(opens & (F.length(word) % 2 == 0), " USE (v)").otherwise(""))
    return words.select(F.col("doc_id").alias("page"), F.col("n").alias("line"), F.inline(F.array(F.struct(c1.alias("c1"), c2.alias("c2")))))


SQL_RUNNING_LINE = "(trim(u) = '' or " + " or ".join(f"contains(u, '{x}')" for x in chunking.RUNNING) + r" or regexp_matches(u, '\b\d{4}-\d{2}-\d{2}\b|ISSUE \d+|PAGE [A-Z0-9-]+'))"
SQL_POS = r"\((?:" + "|".join(chunking.POS_TAGS) + r")\)"
SQL_FOLDED = f"""with {SQL_ENTRIES}, k as (select *, regexp_matches(c1, '{SQL_POS}')::int as op from (select *, upper(trim(c1 || ' ' || c2)) as u from p) where not {SQL_RUNNING_LINE}),
e as (select *, sum(op) over (order by page, line rows unbounded preceding) as entry from k),
f as (select entry::bigint as entry, min(page) as page, trim(string_agg(c1, ' ' order by page, line)) as c1, trim(string_agg(c2, ' ' order by page, line)) as c2 from e where entry > 0 group by 1)"""


@query(SQL_FOLDED + " select entry, page, c1, c2 from f")
def dictionary_entries(spark: SparkSession, d: str) -> DataFrame:
    return chunking.lexicon_entries(_entry_lines(spark, d)).select(F.col("entry").cast("long").alias("entry"), "page", "c1", "c2")


SQL_PARSED = SQL_FOLDED + rf""", h as (select entry, trim(regexp_extract(c1, '^([A-Za-z\s-]+?)\s*({SQL_POS})', 1)) as word, replace(replace(regexp_extract(c1, '^([A-Za-z\s-]+?)\s*({SQL_POS})', 2), '(', ''), ')', '') as pos,
  list_filter(regexp_extract_all(regexp_replace(c1, '^([A-Za-z\s-]+?)\s*({SQL_POS})', '', 'g'), '[A-Z]+'), lambda x: length(x) > 1) as more,
  case when regexp_matches(c2, '(?i)\bNOTE:') then trim(regexp_extract(c2, '(?is)\bNOTE:(.*)', 1)) end as note, trim(regexp_replace(c2, '(?is)\bNOTE:.*', '')) as main from f),
g as (select *, word = upper(word) as ok, list_transform(regexp_extract_all(main, '[A-Z][A-Z\s-]+\s*{SQL_POS}'), lambda x: trim(x)) as alts from h where word <> ''),
r as (select entry, lower(word) as keyword, pos, ok, case when not ok then alts else [] end as alts, case when ok and main <> '' then main end as meaning,
  nullif(concat_ws(' ', case when not ok and len(alts) = 0 and main <> '' then main end, note), '') as note, list_distinct(list_concat([word], more)) as forms from g)"""


@query(SQL_PARSED + " select keyword, sum(len(forms))::bigint as n_forms, count(*) filter (where ok) as approved, string_agg(array_to_string(alts, ';'), '|' order by entry) as alternatives, md5(coalesce(string_agg(note, ' ' order by entry), '')) as notes_hash from r group by 1")
def dictionary_keywords(spark: SparkSession, d: str) -> DataFrame:
    rows = chunking.parsed_entries(chunking.lexicon_entries(_entry_lines(spark, d)))
    each = chunking.lexicon(rows).withColumn("e", chunking.form_entries("forms"))
    return each.select(
        "keyword", F.size("forms").cast("long").alias("n_forms"), F.size(F.filter("e", lambda x: x["is_approved"])).cast("long").alias("approved"),
        F.array_join(F.transform("e", lambda x: F.array_join(x["alternatives"], ";")), "|").alias("alternatives"), F.md5(F.coalesce("notes", F.lit("")).cast("binary")).alias("notes_hash"),
    )


@query(f"""with {SQL_LINES}, s as (select doc_id, n, trim(l) as t, (case when starts_with(l, '#') then 14 else 9 end) > 11 or regexp_matches(l, ':\\s*$') as head from ln),
m as (select *, sum(head::int) over (partition by doc_id order by n) as section, last_value(case when head then t end ignore nulls) over (partition by doc_id order by n rows unbounded preceding) as heading from s),
b as (select doc_id, section, coalesce(min(heading), 'General') as heading, string_agg(t, ' ' order by n) as body from m where not head group by 1, 2)
select doc_id, section::bigint as section, heading, length(body) as chars, md5(body) as body_hash from b where length(body) > 20""")
def heading_blocks(spark: SparkSession, d: str) -> DataFrame:
    lines = _lines(spark, d)
    spans = lines.select(F.col("doc_id").alias("source"), F.col("n").alias("span"), F.col("l").alias("text"), F.when(F.col("l").startswith("#"), 14).otherwise(9).alias("size"), F.col("l").rlike(r":\s*$").alias("bold"))
    made = chunking.font_sections(spans)
    return made.select(F.col("source").alias("doc_id"), F.col("section").cast("long").alias("section"), "heading", F.length("text").cast("long").alias("chars"), F.md5(F.col("text").cast("binary")).alias("body_hash"))


@query(f"""with {SQL_LINES}, o as (select doc_id, n, length(l) as w, sum(length(l) * 8 + 8) over (partition by doc_id order by n rows unbounded preceding) - (length(l) * 8 + 8) as x0 from ln),
b as (select doc_id, x0::double as x0, (x0 + least(w, 60))::double as x1 from o where w > 0), g as (select *, (x0 - max(x1) over (partition by doc_id order by x0, x1 rows between unbounded preceding and 1 preceding) > 150)::int as cut from b),
i as (select *, sum(coalesce(cut, 0)) over (partition by doc_id order by x0, x1 rows unbounded preceding) as k from g) select doc_id as page, min(x0) as x0, max(x1) as x1 from i group by doc_id, k""")
def merged_boxes(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    own = F.length("l") * 8 + 8
    at = _lines(spark, d).withColumn("x0", F.sum(own).over(w) - own).filter(F.length("l") > 0)
    boxes = at.select(F.col("doc_id").alias("page"), F.col("x0").cast("double").alias("x0"), F.lit(0.0).alias("y0"), (F.col("x0") + F.least(F.length("l"), F.lit(60))).cast("double").alias("x1"), F.lit(9.0).alias("y1"))
    return chunking.merge_boxes(boxes).select("page", "x0", "x1")


@query("""select row_id, array_to_string(list_filter(list_transform([parent_context, image_path, source], lambda c: trim(c)), lambda c: c <> ''), ' ') as anchor from bm25_cache""")
def anchor_texts(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "bm25_cache").select("row_id", text.anchor_text(F.array("parent_context", "image_path", "source")).alias("anchor"))


@query("""select doc_id, array_to_string(list_filter(list_transform(string_split(coalesce(title, '') || ' ' || coalesce(revision, '') || ' 7 x', ' '), lambda x: case when regexp_full_match(trim(x), '[+-]?[0-9]{1,9}') then trim(x)::int end), lambda x: x is not null), ',') as numbers from documents""")
def lenient_numbers(spark: SparkSession, d: str) -> DataFrame:
    words = F.split(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("revision", F.lit("")), F.lit(" 7 x")), " ")
    return _t(spark, d, "documents").select("doc_id", F.array_join(text.lenient_ints(words).cast("array<string>"), ",").alias("numbers"))


# --- verdicts --------------------------------------------------------------------------------------------------------

SQL_GROUNDED = """len({tk}) > 0 and len(list_filter({un}, lambda u: len(list_filter({tk}, lambda t: not (case when regexp_matches(t, '[^a-z0-9]') then contains(u, t) else contains(' ' || regexp_replace(u, '[^a-z0-9]', ' ', 'g') || ' ', ' ' || t || ' ') end))) = 0)) > 0"""


@query(f"""with a as (select r.result_id, r.final_text as f, r.strict_mode as s, r.is_compliant as c, e.passage as p, {SQL_CLAIM.format("r.final_text")} as tk, list_transform({SQL_UNITS_OF.format("coalesce(e.passage, '')")}, lambda u: {SQL_GROUND.format("u")}) as un from faithfulness_results r join eval_items e using (item_id))
select result_id, case when not coalesce(s, true) then true when trim(coalesce(p, '')) = '' or trim(coalesce(f, '')) = '' then false when contains(lower(f), 'information not found') then true when coalesce(c, false) then true else {SQL_GROUNDED.format(tk="tk", un="un")} end as accepted from a""")
def verifier_decisions(spark: SparkSession, d: str) -> DataFrame:
    """The verifier is asked in strict mode or where none is given; it supports what was compliant; the answer is the claim."""
    rows = _t(spark, d, "faithfulness_results").join(_t(spark, d, "eval_items").select("item_id", "passage"), "item_id")
    verdict = F.when(F.coalesce("is_compliant", F.lit(False)), " supported ").otherwise("UNSUPPORTED")
    return rows.select("result_id", answers.verifier_verdict(F.coalesce("strict_mode", F.lit(True)), F.col("passage"), F.col("final_text"), verdict, F.array("final_text")).alias("accepted"))


SQL_HAS = SQL_IN.format(p="(" + SQL_NORM.format("{x}") + ")", n="n")


@query(f"""with a as (select r.result_id, {SQL_NORM.format("r.final_text")} as n, e.expected_keywords as k from faithfulness_results r join eval_items e using (item_id) where len(e.expected_keywords) >= 2),
h as (select result_id, list_transform(k, lambda x: {SQL_HAS.format(x="x")}) as hit from a)
select result_id, round(((hit[1] or hit[2])::int + (hit[1])::int + (hit[2])::int + (hit[1] or hit[2])::int + len(list_filter(hit, lambda x: x))) / (4 + len(hit)), 6) as rate from h""")
def expected_forms(spark: SparkSession, d: str) -> DataFrame:
    """The first two keywords as a list, as {all} and as {any}, and every keyword as it is."""
    items = _t(spark, d, "eval_items").filter(F.size("expected_keywords") >= 2).select("item_id", F.col("expected_keywords").alias("k"))
    two = F.to_json(F.slice("k", 1, 2))
    forms = F.concat(F.array(two, F.concat(F.lit('{"all": '), two, F.lit("}")), F.concat(F.lit('{"any": '), two, F.lit("}"))), F.col("k"))
    rows = _t(spark, d, "faithfulness_results").join(items, "item_id")
    return rows.select("result_id", F.round(evaluation.hit_rate(F.col("final_text"), evaluation.expected_groups(forms)), 6).alias("rate"))


SQL_MODES = rf"""with a as (select r.result_id, lower(coalesce(r.template_type, '')) as k, r.final_text, coalesce(r.is_compliant, false) as compliant, coalesce(r.source_hit, false) as content, len(e.expected_keywords) * 5 as most, len(e.expected_pages) as least, {SQL_SENTENCES.format("r.final_text")} as s,
  len(list_filter(string_split(regexp_replace(coalesce(final_text, ''), '\r\n|[\r\x0b\x0c\x1c-\x1e]', chr(10), 'g'), chr(10)), lambda x: {SQL_INSTRUCTION.format(SQL_STRIP.format("x"))})) as n, {SQL_STYLE_MARKERS} as m from faithfulness_results r join eval_items e using (item_id)),
b as (select *, len(list_filter(s, lambda x: {SQL_WORDS.format("x")} > coalesce(nullif(most, 0), case when k = 'procedure' then 20 else 25 end))) = 0 and (k <> 'procedure' or n >= coalesce(least, 1))
  and (k <> 'safety' or contains(lower(coalesce(final_text, '')), 'warning') or contains(lower(coalesce(final_text, '')), 'caution') or contains(lower(coalesce(final_text, '')), 'danger')) and len(m) = 0 as style from a)"""


@query(SQL_MODES + " select result_id, unnest([false, true]) as strict, unnest([content, content and compliant and style]) as passed from b")
def mode_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Each logged answer in both modes; its item limits the words of a sentence and asks for instruction lines."""
    items = _t(spark, d, "eval_items").select("item_id", (F.size("expected_keywords") * 5).alias("most"), F.when(F.col("expected_pages").isNotNull(), F.size("expected_pages")).alias("least"))
    rows = _t(spark, d, "faithfulness_results").join(items, "item_id")
    style = answers.style_audit(F.col("final_text"), F.col("template_type"), F.col("least"), F.when(F.col("most") > 0, F.col("most")), F.lit(True))["passed"]
    judged = rows.select("result_id", F.coalesce("source_hit", F.lit(False)).alias("content"), F.coalesce("is_compliant", F.lit(False)).alias("compliant"), style.alias("style"))
    modes = judged.withColumn("strict", F.explode(F.array(F.lit(False), F.lit(True))))
    return modes.select("result_id", "strict", evaluation.style_passed(F.col("strict"), F.col("content"), F.col("compliant"), F.col("style")).alias("passed"))


SQL_KIND = "case lower(trim(coalesce(template_type, ''))) when 'safety' then {} when 'procedure' then {} when 'descriptive' then {} else {} end"


@query(f"select result_id, {SQL_KIND.format(5500, 4500, 7000, 6000)} as chars, {SQL_KIND.format(768, 768, 1024, 1024)} as tokens, {SQL_KIND.format(3, 3, 3, 3)} as texts from faithfulness_results")
def template_limits(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("template_type")
    limits = {"chars": answer.BUDGETS, "tokens": answer.MOST_TOKENS, "texts": answer.TEXTS}
    return _t(spark, d, "faithfulness_results").select("result_id", *[answer.template_value(kind, v).alias(n) for n, v in limits.items()])


@query("""select result_id, '[' || result_id || '] ' || case when coalesce(passed, false) then 'PASS' else 'FAIL' end || chr(10) || 'Query: ' || coalesce(query, '') || chr(10) || 'Source hit: ' || coalesce(source_hit::varchar, '-') || chr(10) || 'Context: ' || coalesce(context_length::varchar, '-') as report from faithfulness_results""")
def case_reports(spark: SparkSession, d: str) -> DataFrame:
    figures = {"Source hit": F.col("source_hit"), "Context": F.col("context_length")}
    return _t(spark, d, "faithfulness_results").select("result_id", evaluation.case_report(F.col("result_id"), F.coalesce("passed", F.lit(False)), F.col("query"), figures).alias("report"))


# --- retrieval within sources ----------------------------------------------------------------------------------------

_TOK = SQL_TOKENS
_QTOK = SQL_TOKENS.replace("raw as", "qraw as").replace("tok as", "qtok as").replace("from src", "from qsrc").replace("from raw", "from qraw")


@query(f"""with src as (select row_id as id, documents as t, lower(source) as s from bm25_cache where source is not null), {_TOK},
qsrc as (select item_id as id, query as t, lower(expected_sources[1]) as f from eval_items where len(expected_sources) > 0), {_QTOK},
fl as (select distinct f from qsrc where f is not null), inn as (select f, tok.id, tok.tokens from fl join src on contains(src.s, fl.f) join tok on tok.id = src.id),
c as (select f, count(*) as n, avg(len(tokens)) as avgdl from inn group by 1), p as (select f, id, unnest(tokens) as term, len(tokens) as dl from inn),
i0 as (select f, term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) as raw from p join c using (f) group by f, term, n), mi as (select f, avg(raw) as m from i0 group by 1),
i as (select f, term, case when raw < 0 then 0.25 * m else raw end as idf from i0 join mi using (f)), q as (select qsrc.id as qid, qsrc.f, unnest(qtok.tokens) as term from qsrc join qtok on qtok.id = qsrc.id),
sc as (select qid, p.id, round(sum(idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) as score from q join i using (f, term) join p using (f, term) join c using (f) group by 1, 2),
al as (select qsrc.id as qid, inn.id, coalesce(sc.score, 0.0) as score from qsrc join inn using (f) left join sc on sc.qid = qsrc.id and sc.id = inn.id),
r as (select *, row_number() over (partition by qid order by score desc, id) - 1 as rank from al) select qid as item_id, id as row_id, round(score, 6) as score, rank from r where rank < 15""")
def filtered_topk(spark: SparkSession, d: str) -> DataFrame:
    """Each evaluation query within the sources that contain the name of its first expected one, all filters in one plan."""
    items = _t(spark, d, "eval_items").filter(F.size("expected_sources") > 0).select("item_id", "query", F.lower(F.col("expected_sources")[0]).alias("f"))
    top = bm25.bm25_within(_t(spark, d, "bm25_cache"), "row_id", "documents", "source", items, "item_id", "query", "f")
    return top.select(F.col("query_id").alias("item_id"), F.col("doc_id").alias("row_id"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))
