"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names."""

import pytest
from pyspark.sql import functions as F

from lodestrata.llm.automaton import leaks
from lodestrata.llm.covering import near_duplicates, similar_pairs
from lodestrata.llm.curves import nearest_vectors
from lodestrata.llm.kernel_language import document_languages, fit, label_language
from lodestrata.llm.packing import pack
from lodestrata.llm.pairs import defective_pairs
from lodestrata.llm.repeated_lines import fold_token, folded_cost, remove_lines, repeated_lines
from lodestrata.llm.scans import scan_defects

CLASH = ["id", "text", "src", "key", "rep", "a", "b", "n", "doc_id", "container", "lang", "label_lang", "defect", "tail", "fp", "sketch", "rank"]
SCHEMA = "row_no bigint, body string, origin string, label string, pos int, vec array<float>, flag boolean, " + ", ".join(f"{c} string" for c in CLASH)
WORDS = "pressure torque voltage humidity vibration current speed temperature level flow gasket spindle compressor bearing manifold actuator sensor relay conduit flange".split()
LONG = "the pump starts when the valve opens " * 20_000


def frame(spark, rows):
    """rows of (row_no, body, origin, label, pos, vec, flag), with columns beside that clash with the operators' own."""
    return spark.createDataFrame([(*r, *["x"] * len(CLASH)) for r in rows], SCHEMA)


ROWS = [
    (1, "Ein Satz mit der Pumpe und dem Ventil, das man nicht öffnen darf.", "a.pdf", "de", 0, [1.0, 0.0], True),
    (2, "Ein Satz mit der Pumpe und dem Ventil, das man nicht öffnen darf.", "a.pdf", None, 0, [1.0, 0.0], None),
    (2, "Ein Satz mit der Pumpe und dem Ventil, das man nicht öffnen darf.", "a.pdf", None, 1, [1.0, 0.0], None),
    (3, None, None, None, None, None, None),
    (4, "", "a.pdf", "en", 2, [0.0, 0.0], False),
    (5, " \n\t\n ", "A.PDF ", "", 3, [float("nan"), 1.0], False),
    (6, LONG, "dir/a.pdf", "en", None, [1.0], True),
    (None, "The safety relay stops the pump when the valve is open.", "b.pdf", "xx", 5, [0.5, 0.5], True),
    (7, "x", "b.pdf", "fr", 6, [0.0, 1.0], True),
    (8, "퟿\U0001f600 ﬁ İ ß — “quoted”", "b.pdf", "tr", 7, [0.5, 0.5], True),
]


def weights():
    lines = {
        "en": "the pump starts when the valve opens and stops", "de": "die Pumpe startet wenn das Ventil öffnet und nicht", "fr": "la pompe démarre lorsque la vanne est ouverte",
        "es": "la bomba arranca cuando la válvula está abierta", "it": "la pompa parte quando la valvola è aperta", "tr": "vana açıldığında pompa çalışmaya başlar ve durur",
    }
    return fit(list(lines.values()), list(lines), landmarks=6)


OPERATORS = {
    "p1": lambda df: repeated_lines(df, "row_no", "body", "origin", least_rows=2),
    "p2": lambda df: scan_defects(df, "row_no", "body", "origin", "pos")[0],
    "p2r": lambda df: scan_defects(df, "row_no", "body", "origin", "pos")[1],
    "p3": lambda df: defective_pairs(df, "row_no", "origin", "body", "flag"),
    "p4": lambda df: similar_pairs(*near_duplicates(df, "row_no", "body")),
    "p5": lambda df: nearest_vectors(df, "row_no", "vec", k=3, dim=2, axes=2),
    "p6": lambda df: pack(df, "row_no", "body", capacity=64),
    "p7": lambda df: leaks(df, "row_no", "body", df, "row_no", "body", least=3),
    "p8": lambda df: document_languages(df, "row_no", "body", "label", weights()),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_dirty_rows_and_empty_table(spark, name):
    out = OPERATORS[name](frame(spark, ROWS)).collect()
    assert name != "p4" or sorted(map(tuple, out)) == [(1, 2)]
    assert OPERATORS[name](frame(spark, [])).collect() == []


def test_pack_keeps_every_row_and_the_capacity(spark):
    out = OPERATORS["p6"](frame(spark, ROWS))
    assert out.select("doc_id", "piece").filter("piece = 0").count() == len(ROWS)
    assert out.filter("n_tokens = 0").filter("container is not null").count() == 0
    used = out.filter("container is not null").groupBy("container").agg(F.sum("n_tokens").alias("u"), F.max(F.col("token_offset") + F.col("n_tokens")).alias("end"))
    assert used.filter("u > 64 or end <> u").count() == 0
    whole = out.filter("doc_id = 6").agg(F.sum("n_tokens"), F.min("token_start"), F.count("*")).first()
    assert whole[0] > 64 and whole[1] == 0 and whole[2] == -(-whole[0] // 64)


def test_ties_go_to_the_smaller_id_and_unusable_vectors_take_no_part(spark):
    near = OPERATORS["p5"](frame(spark, ROWS))
    assert {r.id for r in near.collect()} == {1, 2, 7, 8}
    assert [r.neighbour for r in near.filter("id = 7").orderBy("rank").collect()][0] == 8


def test_pairs_of_copies(spark):
    rows = [(i, "one two three four five six seven", None, None, None, None, None) for i in (5, 1, 9)]
    assert sorted(map(tuple, OPERATORS["p4"](frame(spark, rows)).collect())) == [(1, 5), (1, 9), (5, 9)]


@pytest.mark.parametrize("limits", [{"bucket_limit": 5}, {"bucket_limit": 5, "block": 7}, {"heavy_least": 3, "block": 7}, {"part_entries": 100}, {"filter_bits": 64}])
def test_hot_buckets_are_split(spark, limits):
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base[:50] + [f"u{i}"] + base[50:]), None, None, None, None, None) for i in range(40)]
    links, members = near_duplicates(frame(spark, rows), "row_no", "body", threshold=0.8, shingle=3, **limits)
    assert similar_pairs(links, members).count() == 40 * 39 // 2


def test_lines_are_cut_and_others_kept(spark):
    rows = [(i, f"{WORDS[i]} rises\nRead the booklet first, {i}.\n{WORDS[i + 10]}", "s.pdf", None, None, None, None) for i in range(10)]
    df = frame(spark, rows)
    doomed = repeated_lines(df, "row_no", "body", "origin")
    assert sorted(map(tuple, doomed.collect())) == [(i, 2) for i in range(10)]
    left = remove_lines(df, "row_no", "body", doomed)
    assert left.columns == df.columns
    assert sorted(r.body for r in left.collect()) == sorted(f"{WORDS[i]} rises\n{WORDS[i + 10]}" for i in range(10))


def test_a_misread_word_in_a_short_title_is_the_same_line(spark):
    assert folded_cost(fold_token("Aritriebe"), fold_token("Antriebe")) <= 1 and folded_cost(fold_token("Manteriimiento"), fold_token("Mantenimiento")) <= 1
    assert folded_cost(fold_token("house"), fold_token("ground")) > 1
    titles = ["Karvelt Antriebe"] * 18 + ["Karvelt Aritriebe", "Karvelt Getriebe"]
    rows = [(i, f"{t}\n{WORDS[i]} rises", "s.pdf") for i, t in enumerate(titles)]
    out = repeated_lines(spark.createDataFrame(rows, "i long, t string, s string"), "i", "t", "s")
    assert sorted(map(tuple, out.collect())) == [(i, 1) for i in range(19)]


@pytest.mark.parametrize("share_rows", [20_000, 7])
def test_variants_count_together_and_sources_are_divided(spark, share_rows):
    # 45 rows need 9; the line stands in three forms, two of them with a name that is common in the source, 4 rows each
    names = ["Karvelt", "Orlane", "Miraridole"]
    forms = ["Read the service notes every month", "Read the Karvelt service notes every month", "Read the Orlane service notes every month"]
    body = lambda i: f"{WORDS[i % 20]} of {names[i % 3]} number {WORDS[(i * 7 + 3) % 20]}"
    rows = [(i, body(i) + (f"\n{forms[i % 3]}" if i < 12 else ""), "s.pdf") for i in range(45)]
    df = spark.createDataFrame(rows, "i long, t string, s string")
    out = repeated_lines(df, "i", "t", "s", share_rows=share_rows)
    assert sorted(map(tuple, out.filter("line_no = 2").collect())) == [(i, 2) for i in range(12)]
    assert repeated_lines(df.filter("i > 3"), "i", "t", "s", share_rows=share_rows).filter("line_no = 2").isEmpty()  # 8 of 41


def test_labels_and_corpora_without_labels(spark):
    labels = {"de-DE": "de", "fr_CA": "fr", "de-en": None, "de-IT": "de", "English": "en", "en-gb": "en", "mul": None, "": None, " TR ": "tr"}
    df = spark.createDataFrame([(k,) for k in labels], "l string")
    assert {r.l: r.v for r in df.select("l", label_language(F.col("l")).alias("v")).collect()} == labels
    texts = [(i, f"The pump is near the door and it must not be opened before the valve {i}.") for i in range(20)] + [(100 + i, f"Die Pumpe ist neben der Tür und darf nicht vor dem Ventil {i} geöffnet werden.") for i in range(20)]
    none = spark.createDataFrame([(i, t, None) for i, t in texts], "i long, t string, l string")
    got = {r.doc_id: r.lang for r in document_languages(none, "i", "t", "l").collect()}
    assert {got[i] for i in range(20)} == {"en"} and {got[100 + i] for i in range(20)} == {"de"}
    one = spark.createDataFrame([(i, t, "en") for i, t in texts[:20]], "i long, t string, l string")
    assert {r.lang for r in document_languages(one, "i", "t", "l").collect()} == {"en"}
