"""Text functions as Catalyst expressions: each takes and returns Columns and stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Units that follow a number in a measurement.
UNITS = ["mm", "cm", "m", "km", "in", "inch", "ft", "kg", "g", "mg", "v", "vdc", "vac", "a", "ma", "hz", "khz", "mhz", "nm", "n", "pa", "kpa", "mpa", "bar", "psi", "deg", "rpm"]
#: A compound, a token with digits, a number or a word, tried in this order at each place.
TOKEN = r"[a-z0-9]+(?:[-_/][a-z0-9]+)+|[a-z]*[0-9]+[a-z0-9.]*|[0-9]+(?:\.[0-9]+)?|[a-z]+"
#: Line ends as Python's splitlines knows them.
LINE_END = "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085\u2028\u2029]"
SENTENCE_END = r"(?<=[.!?])(?U:\s+)|\n+"
WORD = "[A-Za-z0-9]+(?:[-_/][A-Za-z0-9]+)?"
BLANKS = r"(?U)\s+"
EDGE_BLANKS = r"(?U)^\s+|\s+$"
# What says that nothing was found, and what marks a risk.
NOT_FOUND = ["information not found", "not found in provided documents", "not found in provided fragment"]
RISK_WORDS = ["warning", "caution", "danger"]


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body uses it."""
    return F.transform(F.array(value), lambda x: body(x))[0]


def strip(c: Column) -> Column:
    """c without blanks of any kind at its ends."""
    return F.regexp_replace(c, EDGE_BLANKS, "")


def base_name(c: Column) -> Column:
    """Last part of a path, trimmed and lower-cased."""
    return F.lower(F.trim(F.element_at(F.split(c, r"[/\\]"), -1)))


def technical_tokens(text: Column) -> Column:
    """Distinct tokens in order of appearance: raw tokens, each followed by the parts of compounds, then number and
    unit written together. Null and empty texts have none."""

    def with_parts(t: Column) -> Column:
        whole = F.array(t)
        return F.when(t.rlike("[-_/]"), F.concat(whole, F.filter(F.split(t, "[-_/]"), lambda p: (p != "") & (p != t)))).otherwise(whole)

    def tokens(raw: Column) -> Column:
        following = F.slice(raw, F.lit(2), F.greatest(F.size(raw) - 1, F.lit(0)))
        pairs = F.zip_with(raw, following, lambda a, b: F.when(b.isin(UNITS) & a.rlike(r"^[0-9]+(\.[0-9]+)?$"), F.concat(a, b)))
        return F.array_distinct(F.concat(F.flatten(F.transform(raw, with_parts)), F.array_compact(pairs)))

    raw = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    return F.when(F.coalesce(F.length(text), F.lit(0)) > 0, let(raw, tokens)).otherwise(F.array().cast("array<string>"))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0))


def sentences(text: Column) -> Column:
    """Non-blank sentences: pieces after a full stop and blanks, or after a line end."""
    pieces = F.transform(F.split(F.coalesce(text, F.lit("")), SENTENCE_END), strip)
    return F.filter(pieces, lambda s: s != "")


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), LINE_END)


def squeezed(text: Column) -> Column:
    """Every run of blanks as one space, none at the ends; null as empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " "))


def preview(text: Column, limit: int) -> Column:
    one = squeezed(text)
    return F.when(F.length(one) > limit, F.concat(F.left(one, F.lit(limit)), F.lit("..."))).otherwise(one)


def eval_normalised(text: Column) -> Column:
    """Lower-case words, numbers and . % + # for comparison. Compatibility forms are folded where they are common in
    technical text: full-width signs, ligatures, superscripts and the ohm and micro signs."""
    t = F.translate(F.coalesce(text, F.lit("")), "ﬁﬂ", "\ue000\ue001")
    t = F.replace(F.replace(t, F.lit("\ue000"), F.lit("fi")), F.lit("\ue001"), F.lit("fl"))
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
    t = F.translate(t, wide + "²³¹⁰⁴⁵⁶⁷⁸⁹ªº", "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + "231045678" + "9ao")
    t = F.translate(F.lower(t), "ı", "i")
    t = F.regexp_replace(t, "[•●▪▫◦‣⁃·]", " ")
    t = F.regexp_replace(t, r"[-_/\\]+", " ")
    t = F.regexp_replace(t, "[^a-z0-9.%+#]+", " ")
    return F.trim(F.regexp_replace(t, " +", " "))


def eval_compact(text: Column) -> Column:
    return F.regexp_replace(eval_normalised(text), " ", "")


def phrase_in(norm: Column, compact: Column, phrase: Column) -> Column:
    """Whether a phrase stands in a text given in both normal forms; an empty phrase always does."""
    p, q = eval_normalised(phrase), eval_compact(phrase)
    return (p == "") | norm.contains(p) | ((q != "") & compact.contains(q))


def contains_any(text: Column, markers: list[str]) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    hit = F.lit(False)
    for m in markers:
        hit = hit | low.contains(m)
    return hit


def says_not_found(text: Column) -> Column:
    return contains_any(text, NOT_FOUND)


def has_risk_word(text: Column) -> Column:
    return contains_any(text, RISK_WORDS)


def source_block_key(block: Column) -> Column:
    """struct<source, page> of a block's marker line; empty strings where there is none."""
    marker = r"(?i)---\s*SOURCE:\s*(.*?)\s*\|\s*PAGE\s*([^-\n]+?)\s*---"
    b = F.coalesce(block, F.lit(""))
    return F.struct(base_name(F.regexp_extract(b, marker, 1)).alias("source"), F.lower(F.trim(F.regexp_extract(b, marker, 2))).alias("page"))


def grounding_form(text: Column) -> Column:
    """Lower case, the micro sign as u, single spaces."""
    return squeezed(F.translate(F.lower(text), "μ", "u"))


def table_cells(line: Column) -> Column:
    """The cells of a table row joined by spaces."""
    return F.array_join(F.filter(F.transform(F.split(line, r"\|"), strip), lambda c: c != ""), " ")


def merged_paths(paths: Column, more: Column) -> Column:
    """Comma list of both comma lists, without empty entries."""
    both = F.concat(F.split(F.coalesce(paths, F.lit("")), ","), F.split(F.coalesce(more, F.lit("")), ","))
    return F.array_join(F.filter(F.transform(both, lambda p: F.trim(p)), lambda p: p != ""), ",")


def anchor_text(captions: Column) -> Column:
    return F.array_join(F.filter(F.transform(captions, lambda c: F.trim(c)), lambda c: c != ""), " ")


def heading_path(headings: Column) -> Column:
    return F.coalesce(F.array_join(headings, " > "), F.lit(""))


def lenient_ints(values: Column) -> Column:
    """The integers among strings; what is none is left out."""
    return F.filter(F.transform(values, lambda v: v.try_cast("int")), lambda v: v.isNotNull())


def json_in(text: Column) -> Column:
    """The JSON object that a text holds between its first and last brace, as a variant; null if there is none."""
    return F.try_parse_json(F.regexp_extract(F.coalesce(text, F.lit("")), r"(?s)\{.*\}", 0))
