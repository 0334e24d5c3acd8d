"""Core operators: micro-cases, properties, brute force, and the plans that they must have."""

import hashlib
import json
import random
import re
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestrata.functions import hashing, models, text
from lodestrata.operators import answers, bm25, chunking, evaluation, fusion, knn, querying
from lodestrata.plans import answer, ingest, page_queries, retrieval
from lodestrata.sources import readers, store
from lodestrata.streaming.ingest import event_windows, ingest_stream


def one(spark, column, **values):
    """The value of a Column over one row with these fields."""
    return spark.createDataFrame([tuple(values.values())] if values else [(1,)], list(values) or ["x"]).select(column.alias("r")).first().r


@pytest.mark.parametrize(
    ("raw", "tokens"),
    [
        ("GS-12-Q", ["gs-12-q", "gs", "12", "q"]), ("TR-440/B", ["tr-440/b", "tr", "440", "b"]), ("24 V", ["24", "v", "24v"]), ("4.9V", ["4.9v"]), ("5.\nmm", ["5.", "mm"]),
        ("a--b a", ["a", "b"]), ("größe", ["gr", "e"]), ("", []), ("one two one", ["one", "two"]), ("10 kHz x_y", ["10", "khz", "x_y", "x", "y", "10khz"]),
    ],
)
def test_tokens(spark, raw, tokens):
    assert one(spark, text.technical_tokens(F.col("t")), t=raw) == tokens


def test_tokens_of_null(spark):
    df = spark.createDataFrame([(None,)], "t string")
    assert df.select(text.technical_tokens(F.col("t")).alias("r")).first().r == []


def test_sentences_and_words(spark):
    t = "One two. Three-four five!\nSix\n\n 7.5 bar  "
    assert one(spark, text.sentences(F.col("t")), t=t) == ["One two.", "Three-four five!", "Six", "7.5 bar"]
    assert one(spark, text.word_count(F.col("t")), t=t) == len(re.findall(r"[A-Za-z0-9]+(?:[-_/][A-Za-z0-9]+)?", t))


@pytest.mark.parametrize(
    ("t", "phrase", "hit"),
    [("runs at 10 Hz", "10Hz", True), ("runs at 10Hz", "10 Hz", True), ("the XJ-900-V2 unit", "xj 900 v2", True), ("abc", "", True), ("abc", "abd", False), ("ﬁlter ①", "filter", True)],
)
def test_phrases(spark, t, phrase, hit):
    c = text.phrase_in(text.eval_normalised(F.col("t")), text.eval_compact(F.col("t")), F.col("p"))
    assert one(spark, c, t=t, p=phrase) is hit


def test_expected_groups(spark):
    items = ["plain", '["5V", "5 V"]', '{"any": ["a", "b"]}', '{"all": ["c", "d"]}']
    got = one(spark, evaluation.expected_groups(F.col("i")), i=items)
    assert got == [["plain"], ["5V", "5 V"], ["a", "b"], ["c"], ["d"]]
    assert one(spark, evaluation.hit_rate(F.lit("5 v or b"), evaluation.expected_groups(F.col("i"))), i=items) == 0.4
    assert one(spark, evaluation.hit_rate(F.lit("x"), evaluation.expected_groups(F.array().cast("array<string>")))) == 1.0


@pytest.mark.parametrize(
    ("raw", "clean"),
    [
        ("x <ANSWER>\n Yes. \n</answer> y", "Yes."), ("<think>no</think>Fine.", "Fine."), ("Fine.<thinking>never closed", "Fine."), ("`\n.\nAnswer directly\nFine.\n\nMore.", "Fine.\n\nMore."),
        ("Plan:\n1. a\n- b\nFine.", "Fine."), ("I need to think.\n\nFine.", "Fine."), ("Fine, as provided in the context", ""), (None, ""), ("  ", ""),
    ],
)
def test_clean_output(spark, raw, clean):
    df = spark.createDataFrame([(raw,)], "t string")
    assert df.select(answers.cleaned_output(F.col("t")).alias("r")).first().r == clean


@pytest.mark.parametrize(
    ("claim", "context", "ok"),
    [
        ("rated 24V on AB-12", "| AB-12 | 24V |", True), ("rated 24V on AB-12", "AB-12 first.\nThen 24V.", False), ("the pump is on", "the pump is on", False), ("", "x", False),
        ("uses X1", "prefix x12 here", False), ("uses X1", "set x1, then go", True), ("5 μm", "5 um wide", True),
    ],
)
def test_grounding(spark, claim, context, ok):
    assert one(spark, answers.grounded(F.col("c"), F.col("x")), c=claim, x=context) is ok
    assert one(spark, answers.all_grounded(F.array(F.col("c")), F.col("x")), c=claim, x=context) is ok


def test_style_limits(spark):
    words = lambda n: " ".join(["word"] * n) + "."
    none = F.lit(None).cast("int")

    def audit(t, kind, lines=none, most=none, risk=False):
        return one(spark, answers.style_audit(F.col("t"), F.col("k"), lines, most, F.lit(risk)), t=t, k=kind)

    assert audit("Check " + words(19), "Procedure").passed and not audit("Check " + words(20), "Procedure").sentence_length_ok
    assert audit(words(25), "Descriptive").passed and not audit(words(26), "Safety").passed
    assert audit(words(22), "Procedure", F.lit(0), F.lit(0)).sentence_length_ok is False
    assert audit(words(22), "Procedure", F.lit(0), F.lit(30)).passed
    assert [audit(x, "Procedure").instruction_lines for x in ("A pump is here", "1) go", "• go", "turn it", "The pump")] == [1, 1, 1, 1, 0]
    assert not audit("Go.", "Safety", risk=True).risk_word_ok and audit("Warning: go.", "Safety", risk=True).passed
    assert audit("I need to go.\nplan:", "General").markers == [r"^\s*plan\s*:\s*$", "i need to"]


def test_verifier(spark):
    claims = F.array(F.lit("rated 24V"))
    def decide(context, answer, verdict, on=True):
        return one(spark, answers.verifier_verdict(F.lit(on), F.lit(context), F.lit(answer), F.lit(verdict), claims))

    assert decide("", "a", "SUPPORTED", on=False) and not decide(" ", "a", "SUPPORTED") and decide("c", "Information not found in provided documents.", "x")
    assert decide("c", "a", " supported ") and not decide("c", "a", "unsupported") and decide("it has 24V", "a", "unsupported")


def test_json_and_verdicts(spark):
    parsed = text.json_in(F.col("t"))
    verdict, claims = querying.verdict_of(parsed)
    for raw, want in (('ok {"verdict": " supported ", "unsupported_claims": ["a", "b"]} end', ("SUPPORTED", ["a", "b"])), ('{"verdict": "no", "unsupported_claims": "one"}', ("NO", ["one"])), ("nothing", (None, []))):
        r = spark.createDataFrame([(raw,)], ["t"]).select(verdict.alias("v"), claims.alias("c")).first()
        assert (r.v, r.c) == want


def test_lexicon_audit(spark):
    rules = spark.createDataFrame([("stop", "v", False, ["HALT"]), ("good", None, True, []), ("big", "adj", False, [])], "keyword string, pos string, is_approved boolean, alternatives array<string>")
    texts = spark.createDataFrame([(1, "Stop the good big pump, stop"), (2, "good"), (3, None)], "id long, t string")
    plain = {r.id: r.messages for r in answers.lexicon_audit(texts, "id", "t", rules).collect()}
    assert plain == {1: ["Do not use the word 'Stop'. Use: HALT.", "Do not use the word 'big'. Use: an approved alternative.", "Do not use the word 'stop'. Use: HALT."]}
    tags = models.tagged(texts, "id", "t", lambda t: [(w, w.lower().rstrip("s"), "NOUN") for w in t.split()])
    assert answers.lexicon_audit(texts, "id", "t", rules, tags).count() == 0


def test_slash_and_expansion(spark):
    queries = spark.createDataFrame([(1, "/A.PDF how?"), (2, "how /none.pdf now"), (3, "a/b c")], "id int, q string")
    sources = spark.createDataFrame([("dir_a.pdf",)], "s string")
    got = {r.id: (r.standalone, r.source_filter) for r in querying.with_source_filter(queries, "q", sources, "s").collect()}
    assert got == {1: ("how?", "a.pdf"), 2: ("how now", None), 3: ("a/b c", None)}
    rule = [(["pump", "power"], "24V supply")]
    assert one(spark, querying.retrieval_query(F.col("q"), F.lit("Safety"), rule), q="Write an ASD-STE100 procedure for the Pump: power!") == "the Pump power 24V supply warning caution danger safety"
    assert one(spark, querying.retrieval_query(F.col("q"), F.lit(None).cast("string"), rule), q="procedure") == "procedure"
    assert one(spark, querying.label_in(F.col("q"), ["SEARCH", "CHAT"], "SEARCH"), q="it is chat.") == "CHAT"


def test_budget(spark):
    def kept(sizes, limit):
        df = spark.createDataFrame([("q", i, "x" * n) for i, n in enumerate(sizes)], "k string, o int, t string")
        return [len(r.t) for r in fusion.within_budget(df, ["k"], ["o"], "t", F.lit(limit)).orderBy("o").collect()]

    assert kept([10, 10, 10], 22) == [10, 10] and kept([30, 5], 20) == [20] and kept([10, 30, 5], 20) == [10] and kept([5], 20) == [5]


def test_rerank_decisions(spark):
    df = spark.createDataFrame([("a", i, 0.02 - i / 1000, s) for i, s in enumerate((-2.0, 0.5, 0.5, 1.0))] + [("b", 9, 0.02, -3.0), ("c", 9, 0.01, -3.0)], "query_id string, doc_id int, rrf_score double, rerank_score double")
    got = {(r.query_id, r.final_rank): (r.doc_id, r.accepted_by) for r in fusion.rerank_decision(df).collect()}
    assert got == {("a", 1): (3, "score"), ("a", 2): (1, "score"), ("a", 3): (2, "score"), ("b", 1): (9, "fallback")}
    assert fusion.rerank_decision(df, fallback=False).filter("query_id = 'b'").count() == 0


def reference_bm25(texts, query):
    toks = [set(re.findall(r"[a-z]+", t)) for t in texts]
    n, avg = len(toks), np.mean([len(t) for t in toks])
    df = {w: sum(w in t for t in toks) for t in toks for w in t}
    idf = {w: np.log(n - d + 0.5) - np.log(d + 0.5) for w, d in df.items()}
    mean = np.mean(list(idf.values()))
    idf = {w: 0.25 * mean if v < 0 else v for w, v in idf.items()}
    return [sum(idf[w] * 2.5 / (1 + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in query.split() if w in t) for t in toks]


def test_bm25_against_a_scalar_version(spark):
    rnd = random.Random(3)
    texts = [" ".join(rnd.choices("abcdefghijklmnop", k=rnd.randint(1, 12))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    queries = spark.createDataFrame([(1, "a b z"), (2, ""), (3, None)], "q long, t string")
    for at_once in (1, 100):
        top = bm25.bm25_topk(docs, "id", "t", queries, "q", "t", k=5, queries_at_once=at_once).collect()
        want = reference_bm25(texts, "a b z")
        best = sorted(range(60), key=lambda i: (-round(want[i], 9), i))[:5]
        assert [r.doc_id for r in sorted(top, key=lambda r: r.rank) if r.query_id == 1] == best
        assert [r.doc_id for r in sorted(top, key=lambda r: r.rank) if r.query_id == 2] == [0, 1, 2, 3, 4]


def test_knn_passes_agree(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(50)] + [(50, None), (51, [0.0] * 4), (52, [1.0])]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    a = sorted(map(tuple, knn.knn_topk(df, "id", "v", df, "id", "v", k=3, dim=4).collect()))
    b = sorted(map(tuple, knn.knn_topk(df, "id", "v", df, "id", "v", k=3, dim=4, queries_at_once=7).collect()))
    assert a == b and len(a) == 150 and all(r[0] == r[1] for r in a if r[3] == 0)


def test_neighbours_of_many_queries_in_little_memory():
    rng = np.random.default_rng(4)
    v = rng.normal(size=(3000, 8)).astype(np.float32)
    v[1500:] = v[:1500]  # ties
    ids = rng.permutation(3000)
    unit = v / np.sqrt((v.astype(np.float64) ** 2).sum(axis=1, keepdims=True))
    scan = knn._scan(np.arange(3000), unit, 15, 6)
    batches = [pd.DataFrame({"id": ids[a : a + 1500], "v": list(v[a : a + 1500])}) for a in (0, 1500)]
    tracemalloc.start()
    got = pd.concat(list(scan(iter(batches))))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6  # all distances of a batch take 36 MB, several times
    dist = np.round(1 - unit @ unit.T, 6) + 0.0
    best = got.sort_values(["query_id", "distance", "id"]).groupby("query_id").head(15)
    assert best["id"].to_numpy().reshape(3000, 15).tolist() == [ids[np.lexsort((ids, d))[:15]].tolist() for d in dist]


def test_neighbours_with_not_a_number_come_last(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [float("nan"), 1.0])]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    got = [(r.query_id, r.id, str(r.distance)) for r in knn.knn_topk(df, "id", "v", df, "id", "v", k=2, dim=2).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1, "0.0"), (1, 2, "1.0"), (2, 2, "0.0"), (2, 1, "1.0"), (3, 1, "nan"), (3, 2, "nan")]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab \n", max_size=40), max_size=25), st.integers(5, 60), st.integers(1, 10))
def test_packing_loses_nothing(texts, most, overlap):
    items = [("TextItem", [], 1, t) for t in texts]
    chunks = list(chunking.pack_items(items, most, overlap))
    said = [t.strip() for t in texts if t.strip()]
    assert sum(c.count("a") + c.count("b") for c, _, _ in chunks) >= sum(t.count("a") + t.count("b") for t in said)
    assert all(len(c) <= most + overlap + 45 + len(said) for c, _, _ in chunks)
    assert bool(chunks) == bool(said)


def test_sections_by_blocks(spark):
    rnd = random.Random(5)
    rows = [(k, i, rnd.choice("ab")) for k in "xy" for i in range(40)]
    want, last = {}, {}
    for k, i, h in rows:
        section = want.get((k, i - 1), 0) + (i > 0 and last[k] != h)
        want[k, i], last[k] = section, h
    df = spark.createDataFrame(rows, "k string, i long, h string")
    for block in (7, 100_000):
        got = chunking.section_ids(df, "k", "i", F.col("h"), block=block)
        assert got.columns == ["k", "i", "h", "section"] and {(r.k, r.i): r.section for r in got.collect()} == want


def test_packing_rules():
    items = [("TextItem", ["A"], 1, "x" * 90), ("TextItem", ["A"], 2, "y" * 30), ("TableItem", ["A"], 3, "| t |"), ("ListItem", ["A", "B"], None, "z"), ("PictureItem", ["A", "B"], 4, "no")]
    got = list(chunking.pack_items(items, 100, 20))
    assert got == [("x" * 90, "A", 2), ("... " + "x" * 20 + "\n" + "y" * 30, "A", 3), ("| t |", "A", 3), ("z", "A > B", 4)]


def test_chunks_of_documents_are_deterministic(spark):
    docs = spark.createDataFrame([(1, "one\n- two\n| a | b |\nthree"), (2, ""), (3, None)], "id long, t string")
    got = chunking.chunk_documents(chunking.line_items(docs, "id", "t")).orderBy("chunk_index").collect()
    assert [(r.source, r.text) for r in got] == [("1", "one\n- two"), ("1", "| a | b |"), ("1", "three")]


def test_images(spark):
    chunks = spark.createDataFrame([("s", 0, 1, "first part", ""), ("s", 1, 1, "the anchor here", "old.png"), ("s", 2, 2, "other", "")], "source string, chunk_index int, page int, text string, image_path string")
    images = spark.createDataFrame([("s", 0, 1, "", "S0", "0.png"), ("s", 1, 1, "anchor", "S1", "1.png"), ("s", 2, 1, "missing", "S2", "2.png"), ("s", 3, 9, "x", "S3", "3.png")], "source string, img_idx int, page int, anchor_text string, summary string, image_path string")
    got = {r.chunk_index: (r.text, r.image_path, r.has_visual) for r in chunking.attach_images(chunks, images).collect()}
    assert got == {0: ("first part\nS0\nS2", "0.png,2.png", True), 1: ("the anchor here\nS1", "old.png,1.png", True), 2: ("other", "", False)}


def test_lexicon_pages(spark):
    words = spark.createDataFrame([(1, "STOP", 10.0, 100.0), (1, "(v),", 60.0, 101.0), (1, "To", 150.0, 102.0), (1, "halt", 180.0, 100.5), (1, "far", 400.0, 100.0), (1, "foot", 10.0, 990.0)], "page int, text string, x0 double, top double")
    lines = chunking.word_lines(chunking.columns_of(words, F.lit(1000.0)))
    assert {(r.column, r.text) for r in lines.collect()} == {(1, "STOP (v),"), (2, "To halt")}
    raw = spark.createDataFrame(
        [(1, 0, "x", "lost"), (1, 1, "STOP (v),", "To end motion"), (1, 2, "STOPS", "NOTE: of machines"), (1, 3, "PAGE 1-2", ""), (2, 0, "utilize (v)", "USE (v)"), (2, 1, "big (adj)", "Many words")],
        "page int, line int, c1 string, c2 string",
    )
    rows = chunking.parsed_entries(chunking.lexicon_entries(raw))
    got = {r.keyword: r for r in chunking.lexicon(rows).collect()}
    assert [f.word_form for f in got["stop"].forms] == ["STOP", "STOPS"] and got["stop"].forms[0].meaning == "To end motion" and got["stop"].notes == "of machines"
    assert got["utilize"].forms[0].alternatives == ["USE (v)"] and not got["utilize"].forms[0].is_approved and got["big"].notes == "Many words"


def test_lexicon_with_a_frequent_keyword(spark):
    n = 20_000
    rows = spark.range(n).select(
        F.col("id").alias("entry"), F.lit("stop").alias("keyword"), F.explode(F.array(F.lit("STOP"), F.lit("STOPS"))).alias("word_form"), F.lit("v").alias("pos"), (F.col("id") % 2 == 0).alias("is_approved"),
        F.array(F.col("id").cast("string")).alias("alternatives"), F.lit("m").alias("meaning"), F.when(F.col("id") % 4 == 0, F.concat(F.lit("n"), F.col("id"))).alias("note"),
    )
    made = chunking.lexicon(rows)
    assert "Join" not in made._jdf.queryExecution().optimizedPlan().toString()
    got = made.withColumn("e", chunking.form_entries("forms")).select("notes", F.size("forms").alias("forms"), F.col("e.entry").alias("entries")).collect()
    assert [(r.forms, r.entries, r.notes) for r in got] == [(2 * n, list(range(n)), " ".join(f"n{i}" for i in range(0, n, 4)))]


def test_dictionary_keywords_compares_no_entry_with_all_others(spark):
    made = page_queries.dictionary_keywords(spark, "/root/testdata/sf0.001")
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "array_distinct(transform(" not in plan and "collect_set" in plan


def test_font_sections_and_boxes(spark):
    spans = spark.createDataFrame([("s", 0, "An early line that is long enough", 9, False), ("s", 1, "Head", 14, False), ("s", 2, "body text that is", 9, False), ("s", 3, "long enough", 9, False), ("s", 4, "Bold", 9, True), ("s", 5, "short", 9, False)], "source string, span int, text string, size int, bold boolean")
    got = [(r.heading, r.text) for r in chunking.font_sections(spans).orderBy("section").collect()]
    assert got == [("General", "An early line that is long enough"), ("Head", "body text that is long enough")]
    boxes = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 10.0), (1, 100.0, 0.0, 110.0, 10.0), (1, 250.0, 0.0, 260.0, 10.0), (1, 900.0, 900.0, 910.0, 910.0), (2, 0.0, 0.0, 1.0, 1.0)], "page long, x0 double, y0 double, x1 double, y1 double")
    assert sorted(map(tuple, chunking.merge_boxes(boxes).collect())) == [(1, 0.0, 0.0, 260.0, 10.0), (1, 900.0, 900.0, 910.0, 910.0), (2, 0.0, 0.0, 1.0, 1.0)]
    sizes = spark.createDataFrame([(80, 80), (79, 200)], "w int, h int")
    assert chunking.large_images(sizes, "w", "h").count() == 1


def test_hashes(spark):
    fields = {"document_hash": 'a"b\\', "collection_name": "größe", "embedding_model": "m", "embedding_dimension": 64, "chunker": "c\n", "max_chunk_length": 1500}
    want = hashlib.sha256(json.dumps(fields, sort_keys=True, ensure_ascii=False).encode()).hexdigest()
    assert one(spark, hashing.signature(*[F.col(c) for c in fields]), **fields) == want
    assert one(spark, hashing.text_hash(F.col("t")), t="é") == hashlib.sha256("é".encode()).hexdigest()
    assert one(spark, hashing.pixel_hash(F.col("t")), t=b"ab") == hashlib.md5(b"ab").hexdigest()
    assert re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{6}\+00:00", one(spark, hashing.utc_now()))


def test_manifest_and_actions(spark):
    m = spark.createDataFrame([(1, "a", "s1", "2025-01-06T06:23:40+00:00"), (2, "a", "s2", "2025-01-06T08:00:00+02:00"), (3, "b", "s3", "06.01.2025 10:00"), (4, "c", "s4", "soon")], "manifest_id long, filename string, ingestion_signature string, ingested_at string")
    latest = store.latest_manifest(m)
    assert {r.filename: r.manifest_id for r in latest.collect()} == {"a": 1, "b": 3, "c": 4}
    incoming = spark.createDataFrame([("a", "s1"), ("b", "x"), ("c", "s4"), ("d", "s")], "filename string, signature string")
    done = spark.createDataFrame([("a", "s1")], "filename string, signature string")
    assert {r.filename: r.action for r in store.ingest_actions(incoming, latest, done).collect()} == {"a": "unchanged", "b": "changed", "c": "resume", "d": "new"}


def test_store_and_stream(spark, tmp_path):
    items = spark.createDataFrame([("a.pdf", 0, "TextItem", ["H"], 1, "Some text"), ("b.pdf", 0, "TextItem", [], 2, "Other text")], readers.ITEM_SCHEMA)
    files = spark.createDataFrame([("a.pdf", "h1"), ("b.pdf", "h2")], "source string, document_hash string")
    chunks = ingest.chunk_rows(items, files)
    assert {len(r.embedding) for r in chunks.collect()} == {64} and ingest.manifest_rows(chunks, "in").count() == 2
    c = store.Collections(spark, str(tmp_path / "root"))
    c.add("one", chunks)
    c.add("one", chunks)
    assert c.names() == ["one"] and c.read("one").count() == 2
    c.delete_source("one", "a.pdf")
    assert [r.source for r in c.read("one").collect()] == ["b.pdf"]
    few = store.Collections(spark, str(tmp_path / "few"), buckets=1)
    few.add("one", chunks)
    few.delete_source("one", "a.pdf")
    few.delete_source("one", "none.pdf")
    assert [r.source for r in few.read("one").collect()] == ["b.pdf"]
    chunks.write.parquet(str(tmp_path / "new"))
    for _ in range(2):
        ingest_stream(spark, str(tmp_path / "new"), chunks.schema, c, "two", str(tmp_path / "cp")).awaitTermination()
    assert c.read("two").count() == 2
    store.write_bm25(c.read("two"), "chunk_hash", "documents", str(tmp_path / "root/index"))
    assert spark.read.parquet(str(tmp_path / "root/index/terms")).count() > 0
    assert store.missing_paths([str(tmp_path), "/no/such"]) == ["/no/such"]
    assert store.missing_paths([str(tmp_path), "/no/such"], spark) == ["/no/such"]
    assert store.reset_index(spark, str(tmp_path / "root"), keep=("index",)) == ["collection_name=one", "collection_name=two"]
    with pytest.raises(ValueError):
        store.reset_index(spark, "/")
    with pytest.raises(ValueError):
        c.read("../x")


def test_readers(spark, tmp_path):
    (tmp_path / "a.PDF").write_bytes(b"good")
    (tmp_path / "b.pdf").write_bytes(b"bad")
    (tmp_path / "c.txt").write_bytes(b"no")

    def parse(name, content):
        if content == b"bad":
            raise ValueError("broken")
        return [{"item_type": "TextItem", "headings": ["H"], "page": 1, "text": content.decode()}]

    files = readers.document_files(spark, str(tmp_path))
    assert sorted(r.filename for r in files.collect()) == ["a.PDF", "b.pdf"]
    assert [tuple(r) for r in readers.parsed_items(files, parse).collect()] == [("a.PDF", 0, "TextItem", ["H"], 1, "good")]
    (tmp_path / "x.jsonl").write_text('{"q": "a"}\n\n{"q": "b"}\n')
    assert [r.q for r in readers.json_lines(spark, str(tmp_path / "x.jsonl"), "q string").collect()] == ["a", "b"]
    (tmp_path / "y.jsonl").write_text('{"q": "a"}\n\n{bad\n')
    with pytest.raises(Exception, match="line 3: not a JSON line"):
        readers.json_lines(spark, str(tmp_path / "y.jsonl"), "q string").collect()
    (tmp_path / "r.json").write_text('{"rules": [{"a": 1}, 2], "core": ["x", 3]}')
    assert readers.rule_rows(spark, str(tmp_path / "r.json")).count() == 2
    assert readers.text_list(str(tmp_path / "r.json"), "core") == ["x"] and readers.text_list("nowhere", "core") == []
    assert readers.settings(str(tmp_path / "r.json"))["core"] == ["x", 3] and readers.settings("nowhere") == {}
    readers.store_assets(spark.createDataFrame([("h", b"png")], "img_hash string, content binary"), str(tmp_path))
    assert (tmp_path / "vis_h.png").read_bytes() == b"png"


def test_models(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "id int, t string")
    assert [len(r.embedding) for r in models.embedded(df, "t", batch=1).collect()] == [64, 64]
    assert [r.rerank_score for r in models.reranked(df, "t", "t", lambda ps: [len(a) for a, _ in ps]).orderBy("id").collect()] == [3.0, 0.0]
    assert [r.answer for r in models.completed(df, "t", lambda: str.upper).orderBy("id").collect()] == ["A B", None]
    images = spark.createDataFrame([("h", b"x")], "img_hash string, content binary")

    def broken(_):
        raise OSError

    assert models.captioned(images, broken, "none").first().caption == "none"
    assert models.pooled(np.array([[[2.0], [4.0]]]), np.array([[1, 0]])).tolist() == [[2.0]]
    check = lambda d: d.withColumn("compliant", ~F.col("t").contains("!")).withColumn("messages", F.array())
    texts = spark.createDataFrame([(1, "ok"), (2, "a!"), (3, "a!!!"), (4, "stuck!x")], "id int, t string")
    fixed = models.corrected(texts, "t", check, lambda d: d.withColumn("t", F.regexp_replace("t", "!$", "")))
    assert {r.id: (r.t, r.compliant, r.was_corrected) for r in fixed.collect()} == {1: ("ok", True, False), 2: ("a", True, True), 3: ("a!", False, True), 4: ("stuck!x", False, False)}


def test_history(spark):
    turns = spark.createDataFrame([("c", 1, "user", "q1", None), ("c", 2, "assistant", "a1", "ctx1"), ("c", 3, "system", "a2", "ctx2"), ("c", 4, "user", " ", None)], "conv string, turn int, role string, t string, ctx string")
    assert fusion.last_turns(turns, "conv", ["turn"], "role", "t", 2).first().history == "Assistant: a1\nAssistant: a2"
    assert fusion.last_context(turns, "conv", "turn", "role", "ctx").first().context == "ctx2"


def test_windows(spark):
    events = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 2.0), ("2024-01-01 01:00:00", "b", 4.0)], "t string, event_type string, value double").withColumn("ts", F.to_timestamp("t"))
    assert sorted((r.event_type, r.n, r.total) for r in event_windows(events).collect()) == [("a", 2, 3.0), ("b", 1, 4.0)]
    assert event_windows(events, "1 hour", "30 minutes").count() == 5


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark):
    d = "/root/testdata/sf0.001"
    chunks = spark.read.parquet(f"{d}/bm25_cache.parquet")
    p = plan(chunks.select("row_id", answers.cleaned_output(F.col("documents"))))
    assert "Python" not in p and "ReadSchema: struct<row_id:bigint,documents:string>" in p
    p = plan(bm25.bm25_topk(chunks, "row_id", "documents", spark.read.parquet(f"{d}/eval_items.parquet"), "item_id", "query"))
    assert "WindowGroupLimit" in p and "CartesianProduct" not in p
    p = plan(store.without_source(chunks, "source", "x").filter("page = 3").select("row_id"))
    assert "PushedFilters: [" in p and "EqualTo(page,3)]" in p and "ReadSchema: struct<row_id:bigint,source:string,page:int>" in p


def test_retrieval_never_shuffles_the_texts(spark):
    from lodestrata.plans import queries

    p = plan(retrieval.retrieve(*queries._hybrid_inputs(spark, "/root/testdata/sf0.001")))
    assert "SortMergeJoin" not in p and "BroadcastHashJoin" in p and "BuildRight" in p


def test_index_gives_the_same_hits(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"{w} pump valve {i}") for i, w in enumerate("abcdefgh")], "id long, t string")
    queries = spark.createDataFrame([(1, "c pump"), (2, "valve 5")], "q long, t string")
    store.write_bm25(docs, "id", "t", str(tmp_path / "i"))
    stored = bm25.index_topk(*store.read_bm25(spark, str(tmp_path / "i")), queries, "q", "t", k=3)
    direct = bm25.bm25_topk(docs, "id", "t", queries, "q", "t", k=3)
    assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, direct.collect()))


def test_answers_end_to_end(spark):
    texts = ["--- SOURCE: a.pdf | PAGE 1 ---\nThe pump X1 runs at 24V.", "--- SOURCE: b.pdf | PAGE 2 ---\nThe valve opens slowly.", " "]
    rows = [(i, t, f"{'ab'[i % 2]}.pdf", i + 1, "", "False", "") for i, t in enumerate(texts)]
    chunks = spark.createDataFrame(rows, "row_id long, documents string, source string, page int, parent_context string, has_visual string, image_path string")
    vectors = models.embedded(chunks.select("row_id", (F.col("row_id") + 10).alias("vec_id"), "documents"), "documents").select("vec_id", "row_id", "embedding")

    def reply(prompt):
        if prompt.startswith("Is the question"):
            return "CHAT" if "hello" in prompt else "SEARCH"
        if prompt.startswith("Rewrite the question"):
            return "What voltage has the pump X1?"
        if prompt.startswith("Does the context"):
            return 'so {"verdict": "UNSUPPORTED", "unsupported_claims": ["' + ("the pump X1 at 24V" if "24V" in prompt.split("Answer:")[1] else "the fan Z9") + '"]}'
        if "Rewrite the answer" in prompt:
            return "<answer>Check the pump X1 at 24V.</answer>"
        if "hello" in prompt:
            return "<think>greet</think>Hello."
        return "<answer>It has a fan Z9.</answer>" if "valve" in prompt.split("Question:")[1] else "<answer>The pump X1 at 24V. " + "word " * 30 + "</answer>"

    model = lambda d: models.completed(d, "prompt", lambda: reply)
    questions = spark.createDataFrame(
        [(1, "its voltage?", "User: tell me of the pump X1", "General", False, None), (2, "How does the valve open?", None, "General", False, None), (3, "hello", None, None, False, "old"), (4, "the pump X1 voltage", None, "Procedure", True, None), (5, "/b.pdf the pump X1", None, "Safety", False, None), (6, "", None, "Safety", False, None)],
        "query_id long, query string, history string, template_type string, strict_mode boolean, last_context string",
    )
    embed = lambda d: models.embedded(d, "query")
    got = {r.query_id: r for r in answer.answered(questions, chunks, vectors, embed, model).collect()}
    assert len(got) == 6
    assert got[1].final_text.startswith("The pump X1 at 24V.") and not got[1].was_corrected and got[1].sources
    assert got[2].final_text == answer.NOTHING_FOUND and got[2].sources is None and got[2].context
    assert got[3].final_text == "Hello." and got[3].context == "old" and got[3].is_compliant
    assert got[4].final_text == "Check the pump X1 at 24V." and got[4].was_corrected and got[4].is_compliant
    assert all(s.name == "b.pdf" for s in got[5].sources or [])


def test_kept_sources(spark):
    df = spark.createDataFrame([("--- SOURCE: d/A.pdf | PAGE 2 ---\nx", [("a.pdf", 2), ("a.pdf", 3)]), ("no marker", [("a.pdf", 2)])], "c string, s array<struct<source: string, page: int>>")
    assert [len(r.k) for r in df.select(answer.kept_sources(F.col("c"), F.col("s")).alias("k")).collect()] == [1, 1]


def test_retrieval_end_to_end(spark):
    from lodestrata.plans.queries import hybrid_retrieval

    found = hybrid_retrieval(spark, "/root/testdata/sf0.001").collect()
    assert found and all(r.final_rank <= retrieval.RetrievalParams().context for r in found)


def test_every_source_filter_is_searched(spark):
    n = 1100
    chunk = "row_id long, documents string, source string, page int, parent_context string, has_visual string, image_path string"
    chunks = spark.createDataFrame([(i, f"The pump X{i} runs at {i % 48}V.", f"d/S{i:04d}.pdf", 1, "", "False", "") for i in range(n)], chunk)
    vectors = models.embedded(chunks.select("row_id", (F.col("row_id") + n).alias("vec_id"), "documents"), "documents").select("vec_id", "row_id", "embedding")
    questions = spark.createDataFrame([(i, f"/s{i:04d}.pdf the pump", None, "Safety", False, None) for i in range(n)], "query_id long, query string, history string, template_type string, strict_mode boolean, last_context string")
    model = lambda d: models.completed(d, "prompt", lambda: lambda prompt: "<answer>A pump.</answer>")
    out = answer.answered(questions, chunks, vectors, lambda d: models.embedded(d, "query"), model, answer.AnswerParams(verify=False)).collect()
    assert len(out) == n and all(f"X{r.query_id} " in r.context for r in out)


def test_filtered_retrieval_equals_retrieval_in_the_filtered_sources(spark):
    data = "/root/testdata/sf0.001"
    chunks, vectors = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("bm25_cache", "chunk_vectors"))
    names = [r[0] for r in chunks.select(F.lower(F.regexp_extract("source", r"([a-z0-9]+)_", 1)).alias("s")).filter("s <> ''").distinct().orderBy("s").limit(2).collect()] + ["pdf"]
    asked = [(i, q, names[i % 3]) for i, q in enumerate(["the pump pressure", "Ventil und Pumpe", "", "error code", "sensor"])]
    queries = models.embedded(spark.createDataFrame(asked, "query_id long, query string, source_filter string"), "query")
    key = lambda r: (r.query_id, r.doc_id, r.vector_rank, r.bm25_rank, r.bm25_score, r.rrf_score)
    got = {key(r) for r in retrieval.candidates_within(chunks, vectors, queries).collect()}
    want = set()
    for name in names:
        own = chunks.filter(F.lower("source").contains(name))
        mine = vectors.join(own.select("row_id"), "row_id", "left_semi")
        want |= {key(r) for r in retrieval.candidates(own, mine, queries.filter(F.col("source_filter") == name)).collect()}
    assert got == want and want


def test_service(spark, tmp_path):
    from lodestrata.plans import service

    for header, token, status in ((None, "", 503), ("Basic x", "x", 401), ("Bearer y", "x", 401), (None, "x", 401)):
        with pytest.raises(service.Refused) as e:
            service.check_token(header, token)
        assert e.value.status == status
    service.check_token("Bearer x ", " x")
    answer_ = lambda q: q.select("query_id", "query", "history", "template_type", "strict_mode", "last_context")
    asked = {"query": "how?", "collection_name": "c", "history": [{"role": "user", "content": "a"}, {"role": "bot", "content": "b", "context_text": "t"}, {"role": "user", "content": None}]}
    got = service.ask(spark, asked, "Bearer x", "x", [str(tmp_path)], answer_)
    assert got == {"query_id": 0, "query": "how?", "history": "User: a\nAssistant: b", "template_type": "General", "strict_mode": False, "last_context": "t"}
    with pytest.raises(service.Refused, match="missing"):
        service.ask(spark, asked, "Bearer x", "x", ["/no/such"], answer_)
    with pytest.raises(service.Refused, match="query"):
        service.requests(spark, [{"collection_name": "c"}])
    assert service.health("m", batch=8) == {"status": "ok", "model": "m", "batch": 8}


def test_visual_regions_and_saved_keys(spark, tmp_path):
    box = "page long, x0 double, y0 double, x1 double, y1 double"
    images = spark.createDataFrame([(1, 0.0, 0.0, 60.0, 60.0), (1, 0.0, 0.0, 60.0, 50.0)], box)
    drawings = spark.createDataFrame([(1, 0.0, 0.0, 6.0, 1.0), (1, 0.0, 0.0, 5.0, 5.0), (2, 0.0, 0.0, 9.0, 9.0), (2, 0.0, 0.0, 9.0, 9.0), (2, 0.0, 0.0, 9.0, 9.0)], box)
    blocks = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1.0, "x"), (1, 0.0, 0.0, 2.0, 2.0, "x" * 200)], box + ", text string")
    assert sorted(r.x1 for r in chunking.visual_regions(images, drawings, blocks, 2).collect()) == [1.0, 6.0, 60.0]
    store.save_checkpoints(spark.createDataFrame([("b",), ("a",), ("b",)], "key string"), str(tmp_path / "keys"))
    assert [r.key for r in spark.read.json(str(tmp_path / "keys")).collect()] == ["a", "b"]
