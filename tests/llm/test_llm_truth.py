"""Operators against brute force, exact round trips, held-out accuracy and small cases with known answers."""

import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import queries as Q
from lodestrata.llm.automaton import Matcher, leaks
from lodestrata.llm.covering import BLOCKS, POSITIONS, RADIUS
from lodestrata.llm.curves import hilbert_keys, nearest_vectors
from lodestrata.llm.kernel_language import LABELS, document_languages
from lodestrata.llm.packing import load_tokenizer
from lodestrata.llm.pairs import classify, defective_pairs
from lodestrata.llm.repeated_lines import Folder, Wordings, fold_token, variant_of
from lodestrata.llm.scans import confusion_cost, misread_number, page_number_form, repaired_paragraphs, scan_defects, word_of

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\W_]+")


def rows(spark, table, *cols):
    return [tuple(r) for r in spark.read.parquet(f"{DATA}/{table}.parquet").select(*cols).collect()]


def test_every_difference_within_the_radius_misses_a_block():
    for bad in combinations(range(POSITIONS), RADIUS):
        assert any(not set(bad) & set(b) for b in BLOCKS)


def test_near_duplicates_against_all_pairs(spark):
    sets = {}
    for i, t in rows(spark, "bm25_cache", "row_id", "documents"):
        w = WORD.findall((t or "").lower())
        if len(w) >= 3:
            sets[i] = set(zip(w, w[1:], w[2:]))
    truth = {(a, b) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= 0.7 * len(sets[a] | sets[b])}
    found = {tuple(r) for r in Q.p4_found(spark, DATA).collect()}
    assert found <= truth
    assert len(found) >= 0.97 * len(truth)


def test_neighbours_against_all_pairs(spark):
    base = spark.read.parquet("/root/testdata/sf0.01/chunk_vectors.parquet")
    vs = [(i, np.asarray(v, dtype=float)) for i, v in base.select("vec_id", "embedding").toLocalIterator() if v is not None and len(v) == 64 and any(v)]
    ids = np.array([i for i, _ in vs])
    m = np.array([v / np.linalg.norm(v) for _, v in vs])
    near = defaultdict(set)
    for r in nearest_vectors(base, "vec_id", "embedding").collect():
        near[r.id].add(r.neighbour)
    asked = [k for k, i in enumerate(ids) if i % 50 == 0]
    hits = 0
    for k in asked:
        s = m @ m[k]
        s[k] = -2
        hits += len(near[ids[k]] & set(ids[np.lexsort((ids, -s))[:10]]))
    assert hits >= 0.9 * 10 * len(asked)


def test_hilbert_neighbours_touch():
    side = np.stack(np.meshgrid(np.arange(8), np.arange(8), np.arange(8)), -1).reshape(-1, 3)
    path = side[np.argsort(hilbert_keys(side, 3))]
    assert len(np.unique(hilbert_keys(side, 3))) == 512
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_leaks_against_all_windows(spark):
    held = defaultdict(set)
    for i, p in rows(spark, "eval_items", "item_id", "passage"):
        w = WORD.findall((p or "").lower())
        for k in range(len(w) - 11):
            held[tuple(w[k : k + 12])].add(i)
    truth = set()
    for d, t in rows(spark, "documents", "doc_id", "text"):
        w = WORD.findall((t or "").lower())
        truth |= {(d, i) for k in range(len(w) - 11) for i in held.get(tuple(w[k : k + 12]), ())}
    assert {tuple(r) for r in Q.p7_found(spark, DATA).collect()} == truth
    docs, items = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/eval_items.parquet")
    size = items.agg(F.sum(F.length("passage"))).first()[0]
    three = leaks(docs, "doc_id", "text", items, "item_id", "passage", automaton_chars=size // 3 + 1)
    assert {tuple(r) for r in three.select("doc_id", F.explode("leaks.item_id")).collect()} == truth


def test_automaton_on_overlapping_items():
    rng = np.random.default_rng(1)
    items = [(i, " ".join(rng.choice(list("abc"), 12))) for i in range(12)]
    text = list(rng.choice(list("abc"), 200))
    m = Matcher(items, 4)
    found = m.spans(text)
    for i, p in items:
        w = p.split()
        grams = {tuple(w[k : k + 4]) for k in range(9)}
        covered = {k + j for k in range(197) if tuple(text[k : k + 4]) in grams for j in range(4)}
        assert covered == {k for a, b in found.get(i, []) for k in range(a, b)}


def test_packing_round_trip(spark):
    encode = load_tokenizer().encode_ordinary
    size = {d: len(encode(t or "")) for d, t in rows(spark, "documents", "doc_id", "text")}
    placed = Counter()
    bins = defaultdict(list)
    for r in Q.p6_pack(spark, DATA).collect():
        placed[r.doc_id] += r.n_tokens
        if r.container is not None:
            bins[r.container].append((r.token_offset, r.n_tokens))
    assert placed == Counter(size)
    for own in bins.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:]))
        assert sum(n for _, n in own) <= 2048
    assert len(bins) <= 1.05 * -(-sum(size.values()) // 2048) + 1


def test_languages_of_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    named = {n: lang for lang, names in LABELS.items() for n in names.split()}
    right = total = 0
    for r in document_languages(docs, "doc_id", "text", "lang").join(docs.select("doc_id", docs["lang"].alias("label")), "doc_id").collect():
        want = named.get((r.label or "").strip().lower())
        if want and r.lang:
            total += 1
            right += want == r.lang
    assert right >= 0.85 * total  # a share of the labels is wrong


@pytest.mark.parametrize(
    ("query", "answer", "flag", "defect"),
    [
        ("Where is the pump?", None, False, "empty"), ("Where is the pump?", "<think>near the door</think>\n## Answer\n", False, "empty"), ("Where is the pump?", "42 bar", False, None),
        ("Where is the pump?", "I'm sorry, but I can't help with this request.", None, "refusal"), ("Where is the pump?", "The answer was not found in the supplied manuals.", False, "refusal"),
        ("Where is the pump?", "The answer was not found in the supplied manuals.", True, None), ("Where is the pump?", "Sorry for the length of this list. The pump is fitted near the door.", False, None),
        ("Where is the feed pump fitted?", "You asked: where is the feed pump fitted", False, "copy"), ("Where is the feed pump fitted?", "Where is the feed pump fitted?\nIt stands near the main door of the hall.", False, None),
        ("Where is the feed pump fitted?", "Die Pumpe ist neben der Tür und wird mit dem Ventil geliefert.", False, "wrong_language"),
        ("Give the note on the pump in German.", "Die Pumpe ist neben der Tür und wird mit dem Ventil geliefert.", False, None),
        ("Where is the pump?", "Keep the pump near the door and,", False, "truncated"), ("Which codes apply?", "| AB-12 | 4 bar |\n| CD-9", False, "truncated"), ("Which codes apply?", "| AB-12 | 4 bar |", False, None),
        (None, "Keep the pump near the door.", None, None),
    ],
)
def test_pair_defects(query, answer, flag, defect):
    assert classify(query, answer, flag)[0] == defect


def test_folding():
    assert fold_token("va1ve") == fold_token("VALVE,") == fold_token("valve")
    assert fold_token("frorn") == fold_token("from")
    assert fold_token("2024-05-21") == "" and fold_token("|") == ""
    assert fold_token("JU-868-78") == fold_token("(ju-112-78).")
    lines = Folder().lines
    assert lines("Reviewed by T. Halloux on 2024-05-21") == lines("* REVIEWED BY B. ORLANE ON 01/02/2003;")
    assert lines("A loss of 12 bar") != lines("A loss of 12 kPa") and lines("A loss of 12 bar") == lines("A loss of 3.5bar")
    assert lines("Page 3S of 78") == lines("Page 12 of 78") and lines("--- SOURCE: a | PAGE 1 ---\nx1") == ["", ""]


def test_variants():
    seeds = [(k, k.split(" ")) for k in ("share this topic", "read the booklet before you work")]
    known = Wordings([k for k, _ in seeds], 0.45, 0.4)
    find = lambda k: variant_of(k, seeds, 0.45, 0.4)
    assert all(known.of(k) == find(k) for k in ("share this topic", "share this orlane topic", "read the booklet you work", "before you work", "share the booklet"))
    assert [find(k) for k in ("share this topic", "share this orlane topic", "read the booklet you work", "before you work", "share the booklet")] == [0, 0, 1, -1, -1]


def test_scan_parts():
    assert word_of("N0ise") == "n0ise" and word_of("KY-58-Z") is None and word_of("64.77") is None
    assert misread_number("9B.2") and misread_number("4l7") and not misread_number("B6") and not misread_number("417")
    assert confusion_cost("rnodule", "module") <= 0.5 and confusion_cost("house", "mouse") > 1
    assert [page_number_form(x) and page_number_form(x)[0] for x in ("- 3 -", "Seite 4 von 9", "xii", "Read the booklet", "[I2]")] == ["0", "seite 0 von 0", "0", None, "0"]


def test_scanned_page(spark):
    clean = "The pressure sensor stands beside the valve and the operator may open it slowly whenever the lamp is green."
    filler = [(i, f"{clean} {clean}", "clean.pdf", i) for i in range(1, 30)]
    pages = [
        (101, "Acme Works 12\nThe pres-\nsure sensor stands beside the vaIve\nand the operat0r may open it slowly when-\n- 1 -", "scan.pdf", 0),
        (102, "Acme Works 12\never the lamp is green.\nThe operator may open the valve\n- 2 -", "scan.pdf", 1),
        (103, "Acme Works 12\nThe lamp is green and the operator\nmay open it\n- 3 -", "scan.pdf", 2),
    ]
    df = spark.createDataFrame(filler + pages, "row_id long, documents string, source string, chunk_index int")
    got = {tuple(r) for r in scan_defects(df, "row_id", "documents", "source", "chunk_index")[0].collect()}
    assert {(i, 1, "header") for i in (101, 102, 103)} <= got
    assert {(101, 5, "page_number"), (102, 4, "page_number"), (103, 4, "page_number")} <= got
    assert {(101, 2, "hyphen"), (101, 4, "hyphen"), (101, 4, "char")} <= got
    assert not any(i < 100 for i, _, _ in got)


def test_scanned_pages_become_paragraphs(spark):
    clean = "The pressure sensor stands beside the valve and the operator may open it slowly whenever the lamp is green."
    filler = [(i, f"{clean} {clean}", "clean.pdf", i) for i in range(1, 30)]
    first = "Acme Works 12\nThe pres-\nsure sensor stands beside the va1ve\nand the operat0r may open it slowly when-\n- 1 -"
    pages = [
        (101, first, "scan.pdf", 0), (104, first, "dir/SCAN.pdf", 0),
        (102, "Acme Works 12\never the lamp is green.\n\n0perator and valve stand beside the\n- 2 -", "scan.pdf", 1),
        (103, "Acme Works 12\nlamp.\nThe lamp is green and the operator\nmay open it 4l7 times.\n- 3 -", "scan.pdf", 2),
    ]
    df = spark.createDataFrame(filler + pages, "row_id long, documents string, source string, chunk_index int")
    got = sorted(map(tuple, repaired_paragraphs(df, "row_id", "documents", "source", "chunk_index").collect()))
    assert got == [
        ("scan.pdf", 1, [101, 102], clean),
        ("scan.pdf", 2, [102, 103], "Operator and valve stand beside the lamp."),
        ("scan.pdf", 3, [103], "The lamp is green and the operator may open it 417 times."),
    ]


def test_many_equal_vectors_list_the_smallest_ids(spark):
    rng = np.random.default_rng(3)
    other = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(4000)]
    df = spark.createDataFrame(other + [(i, [2.0] * 8) for i in range(10_000, 18_000)], "i long, v array<float>")
    near = defaultdict(list)
    for r in nearest_vectors(df, "i", "v", dim=8, axes=4).orderBy("id", "rank").collect():
        near[r.id].append(r.neighbour)
    assert len(near) == 12_000
    for i in range(10_000, 18_000):
        assert near[i] == [x for x in range(10_000, 10_011) if x != i][:10]


def test_recall_of_neighbours_on_a_larger_table(spark):
    base = spark.read.parquet("/root/testdata/check_l/chunk_vectors.parquet")
    vs = [(i, np.asarray(v, dtype=np.float32)) for i, v in base.select("vec_id", "embedding").toLocalIterator() if v is not None and len(v) == 64 and any(v)]
    ids = np.array([i for i, _ in vs])
    m = np.array([v / np.linalg.norm(v) for _, v in vs])
    asked = [k for k, i in enumerate(ids) if i % 50 == 0][::8]
    near = defaultdict(set)
    for r in nearest_vectors(base, "vec_id", "embedding").filter(F.col("id").isin([int(ids[k]) for k in asked])).collect():
        near[r.id].add(r.neighbour)
    hits = 0
    for k in asked:
        s = m @ m[k]
        s[k] = -2
        hits += len(near[ids[k]] & set(ids[np.lexsort((ids, -s))[:10]]))
    assert hits >= 0.9 * 10 * len(asked)


def test_a_refusal_with_a_courtesy_or_referral():
    q = "Where is the feed pump fitted?"
    for text in (
        "I cannot provide this information. Please ask your service partner.", "Please ask your service partner. I cannot provide this information.",
        "Thank you for asking about the feed pump. It is a topic I have to leave to your dealer.", "I cannot provide this information. Have a nice day.",
        "Dazu darf ich keine Auskunft geben. Bitte wenden Sie sich an den Kundendienst.", "Lo siento, no puedo ayudarle con eso. Me es imposible dar indicaciones sobre HB7068.",
        "The sources at hand say nothing about it. Please ask your service partner.",
    ):
        assert classify(q, text, False)[0] == "refusal", text
    for text in (
        "I cannot provide this information. The feed pump stands near the door.", "I cannot provide this information. Torque is 12 Nm.", "Please ask your service partner for the feed pump.",
        "Open the cover first. Please ask your service partner.", "You cannot skip this step.",
    ):
        assert classify(q, text, False)[0] is None, text


def test_the_words_of_all_rows_choose_the_repair(spark):
    # "1amp" may be lamp or the commoner iamp; only the clean rows have a pair with "green"
    clean = [(i, "the green lamp stands by the blue iamp and a red iamp and an old iamp " + "and so this line is longer than any page of a scanned book", "clean.pdf", i) for i in range(30)]
    pages = [(100 + i, "The work\nstarts with the green\nnew parts", "scan.pdf", i) for i in range(3)] + [(200, "one and the green 1amp\nis here", "scan.pdf", 4)]
    df = spark.createDataFrame(clean + pages, "row_id long, documents string, source string, chunk_index int")
    got = [tuple(r) for r in scan_defects(df, "row_id", "documents", "source", "chunk_index")[1].collect()]
    assert (200, 1, "1amp", "lamp") in got


def test_refusals_are_recognised_by_classes_of_words():
    q = "Where is the feed pump fitted?"
    for text in (
        "I have no permission to discuss that subject.", "This assistant will not respond to such prompts.", "We are unable to share details about the gearbox.", "Ich darf zu diesem Thema leider keine Auskunft geben.",
        "Nous ne pouvons pas répondre à cette demande.", "Non possiamo fornire informazioni su questo argomento.", "Lo siento, no podemos responder a esta solicitud.", "Maalesef bu konuda bilgi veremem.", "That request has been declined.",
    ):
        assert classify(q, text, False)[0] == "refusal", text
    for text in (
        "I cannot open the valve without the special key; use tool 4.", "We regret that the valve cannot be opened by hand.", "The pump cannot be started without oil.", "Do not answer the alarm before the lamp is off.",
        "Die Pumpe darf nicht ohne Öl gestartet werden.", "No se puede abrir la válvula sin la llave.",
    ):
        assert classify(q, text, False)[0] != "refusal", text


def test_languages_of_answers_by_the_kernel(spark):
    rows = [(1_000_000 + i, q, t, False) for i, (q, t) in enumerate([
        ("Where is the feed pump of the second press fitted?", "Pression élevée, débit faible, moteur chaud"), ("Which voltage does the pump need when it starts?", "Voltage 24 V, current 3 A, power low"),
        ("Which voltage does the pump need when it starts? Answer in French, please.", "Pression élevée, débit faible, moteur chaud"),
    ])]
    base = spark.read.parquet("/root/testdata/sf0.01/faithfulness_results.parquet").select("result_id", "query", "final_text", "expected_not_found")
    df = base.unionByName(spark.createDataFrame(rows, base.schema))
    got = {r.id: r.defect for r in defective_pairs(df, "result_id", "query", "final_text", "expected_not_found").filter("id >= 1000000").collect()}
    assert got.get(1_000_000) == "wrong_language" and got.get(1_000_001) != "wrong_language" and got.get(1_000_002) != "wrong_language"


def test_leaked_spans_are_cut(spark):
    items = spark.createDataFrame([(1, "one two three four"), (2, "six seven eight nine"), (3, "one two three four")], "i long, p string")
    docs = spark.createDataFrame([(1, "a b c d e f, One two THREE four! six g h"), (2, "x: six seven eight nine."), (3, "y one two three four six seven eight nine w v u t s r q p"), (3, "y one two three four six seven eight nine w v u t s r q p"), (4, "five")], "d long, t string")
    for size in (1_000, 20):
        got = {r.doc_id: (r.clean_text, [x.item_id for x in r.leaks], [x.words for x in r.leaks]) for r in leaks(docs, "d", "t", items, "i", "p", least=4, automaton_chars=size).collect()}
        assert got == {1: ("a b c d e f, ! six g h", [1, 3], [4, 4]), 2: (None, [2], [4]), 3: ("y  w v u t s r q p", [1, 2, 3], [4, 4, 4])}
