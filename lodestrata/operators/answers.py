"""Cleaning of model output, evidence grounding, style and lexicon audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.text import BLANKS, contains_any, grounding_form, has_risk_word, let, lines, sentences, strip, table_cells, word_count

# Fragments that betray reasoning, plans or prompts in an output.
LEAK_MARKERS = ["<thinking", "</thinking", "<think", "</think", "analyze document context", "synthesize and resolve conflict", "final plan", "the user is asking", "i will construct", "i will provide", "wait,", "let's re-read", "no conversational fillers", "ensure the answer is direct", "answer directly", "omit conversational fillers", "[image attached to this message]", "i will draft", "i will ensure", "i will structure", "i will use", "i will not use", "i need to", "key information to include", "xml structure", "` tags", "sentence 1:", "sentence 2:", "sentence 3:", "the procedure should", "the descriptive text must", "the safety text must", "tags.", "plan:", "i must ignore", "provided in the context", "conflicts with the text source", "primary authority"]
PLAN_MARKERS = ["i will draft", "i will ensure", "i will structure", "i will use", "i will not use", "i need to", "key information to include", "xml structure", "` tags", "tags.", "plan:", "i must ignore", "provided in the context", "conflicts with the text source", "primary authority", "sentence 1:", "sentence 2:", "sentence 3:", "the procedure should", "the descriptive text must", "the safety text must"]
PROMPT_LINE = r"(?i)^\s*`*\s*\.?\s*$|no conversational fillers|ensure the answer is direct|answer directly|omit conversational fillers"
EVAL_MARKERS = ["<thinking", "</thinking", "<think", "</think", "analyze document context", "synthesize and resolve conflict", "final plan:", "the user is asking", "i will construct", "i will provide", "let's re-read", "no conversational fillers", "ensure the answer is direct", "answer directly", "omit conversational fillers", "[image attached to this message]", "i will draft", "i will ensure", "i will structure", "i will use", "i will not use", "i need to", "key information to include", "xml structure", "` tags", "sentence 1:", "sentence 2:", "sentence 3:", "the procedure should", "the descriptive text must", "the safety text must", "plan:", "i must ignore", "image provided in the context", "the image provided in the context", "provided in the context", "conflicts with the text source", "primary authority", "text source is the primary authority"]
STYLE_MARKERS = ["i must ignore", "image provided in the context", "the image provided in the context", "provided in the context", "conflicts with the text source", "primary authority", "text source is the primary authority", "i need to", "i will", "key information to include", "xml structure", "` tags"]
# Verbs that begin an instruction.
COMMANDS = ["adjust", "apply", "attach", "calibrate", "check", "clean", "close", "connect", "disconnect", "do", "examine", "install", "make", "measure", "move", "open", "perform", "press", "remove", "replace", "set", "start", "stop", "turn", "use", "verify", "write"]
# Words that say nothing about a claim.
PLAIN_WORDS = ["a", "an", "and", "as", "at", "be", "by", "for", "from", "in", "into", "is", "it", "of", "on", "or", "the", "to", "use", "uses", "using", "with", "while", "when", "connect", "connected", "connecting", "connection", "pin", "pins", "wire", "wires", "signal", "signals", "interface", "port", "serial", "input", "output", "system", "device", "unit", "part", "component"]


def _after_first(items: Column, drop) -> Column:
    """items without the leading ones for which drop holds."""

    def rest(all_: Column) -> Column:
        first = F.array_position(F.transform(all_, lambda x: ~drop(x)), F.lit(True)).cast("int")
        return F.when(first == 0, F.array().cast("array<string>")).otherwise(F.slice(all_, F.greatest(first, F.lit(1)), F.greatest(F.size(all_), F.lit(1))))

    return let(items, rest)


def cleaned_output(text: Column) -> Column:
    """The answer of a raw model output, empty if something internal is left in it.

    An answer element wins; else reasoning elements go, also unclosed ones, and so do stray tags, leading prompt lines
    and leading plan paragraphs and lines. Null is empty.
    """
    answer = r"(?is)<\s*answer\s*>(.*?)<\s*/\s*answer\s*>"

    def visible(t: Column) -> Column:
        bare = F.regexp_replace(t, r"(?is)<\s*(thinking|think)\b[^>]*>.*?<\s*/\s*\1\s*>", "")
        bare = F.regexp_replace(bare, r"(?is)<\s*(thinking|think)\b[^>]*>.*$", "")
        shown = F.when(t.rlike(answer), F.regexp_extract(t, answer, 1)).otherwise(bare)
        return strip(F.regexp_replace(strip(shown), r"(?i)<\s*/?\s*(answer|thinking|think)\s*>", ""))

    def without_prompt(t: Column) -> Column:
        return strip(F.array_join(_after_first(lines(t), lambda x: x.rlike(PROMPT_LINE)), "\n"))

    def without_plan_paragraphs(t: Column) -> Column:
        paragraphs = F.filter(F.transform(F.split(t, r"\n\s*\n"), strip), lambda p: p != "")
        rest = _after_first(paragraphs, lambda p: contains_any(p, PLAN_MARKERS))
        return let(rest, lambda r: F.when(F.size(r) > 0, F.array_join(r, "\n\n")).otherwise(t))

    def without_plan_lines(t: Column) -> Column:
        # list items belong to the plan where a bare heading opens it
        headed = t.rlike(r"(?im)^\s*plan\s*:\s*$")
        plan = lambda x: (strip(x) == "") | contains_any(x, PLAN_MARKERS) | (headed & x.rlike(r"^\s*(?:\d+[).\s-]+|[-*•]\s+)"))
        return strip(F.array_join(_after_first(lines(t), plan), "\n"))

    t = F.coalesce(text, F.lit(""))
    for step in (visible, without_prompt, without_plan_paragraphs, without_plan_lines):
        t = let(t, step)
    return let(t, lambda x: F.when(contains_any(x, LEAK_MARKERS), "").otherwise(x))


def output_markers(text: Column, markers: list[str], line_labels: dict[str, str]) -> Column:
    """Sorted distinct markers that a text contains, with a label for each line pattern."""
    low = F.lower(F.coalesce(text, F.lit("")))
    found = [F.when(low.contains(m), F.lit(m)) for m in markers]
    per_line = [F.when(F.coalesce(text, F.lit("")).rlike("(?im)" + p), F.lit(label)) for p, label in line_labels.items()]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*found, *per_line))))


def eval_markers(text: Column) -> Column:
    return output_markers(text, EVAL_MARKERS, {r"^\s*tags\.\s*$": "tags.", r"^\s*plan\s*:\s*$": "plan:"})


def style_markers(text: Column) -> Column:
    return output_markers(text, STYLE_MARKERS, {p: p for p in (r"^\s*tags\.\s*$", r"^\s*plan\s*:\s*$")})


def instruction_line(line: Column) -> Column:
    """Whether a line reads as an instruction: numbered, lettered or bulleted, or with a command first."""
    t = strip(line)
    listed = t.rlike(r"(?i)^(?:\d+[).\s-]+|[A-Z][).\s-]+|[-*•]\s+)")
    return listed | F.lower(F.regexp_extract(t, "[A-Za-z][A-Za-z-]*", 0)).isin(COMMANDS)


def style_audit(text: Column, template: Column, min_lines: Column, max_words: Column, need_risk_word: Column) -> Column:
    """struct of the style checks of an answer: passed, sentence_length_ok, long_sentences, instruction_lines,
    instruction_ok, risk_word_ok, hygiene_ok, markers, feedback."""
    kind = F.lower(F.coalesce(template, F.lit("")))
    words = F.coalesce(F.nullif(max_words, F.lit(0)), F.when(kind == "procedure", 20).otherwise(25))
    least = F.coalesce(min_lines, F.when(kind == "procedure", 1).otherwise(0))
    long = F.filter(sentences(text), lambda s: word_count(s) > words)
    n = F.size(F.filter(lines(text), instruction_line))
    length_ok = F.size(long) == 0
    lines_ok = (kind != "procedure") | (n >= least)
    risk_ok = (kind != "safety") | ~F.coalesce(need_risk_word, F.lit(False)) | has_risk_word(text)
    markers = style_markers(text)
    clean = F.size(markers) == 0
    feedback = F.array_compact(
        F.array(
            F.when(~length_ok, F.concat(F.lit("Use at most "), words.cast("string"), F.lit(" words in each sentence."))),
            F.when(~lines_ok, F.lit("Write each step as an instruction that begins with a command.")),
            F.when(~risk_ok, F.lit("Begin with a word that names the risk: warning, caution or danger.")),
            F.when(~clean, F.lit("Remove planning and prompt fragments from the output.")),
        )
    )
    return F.struct(
        (length_ok & lines_ok & risk_ok & clean).alias("passed"), length_ok.alias("sentence_length_ok"), long.alias("long_sentences"), n.alias("instruction_lines"),
        lines_ok.alias("instruction_ok"), risk_ok.alias("risk_word_ok"), clean.alias("hygiene_ok"), markers.alias("markers"), feedback.alias("feedback"),
    )


def claim_tokens(claim: Column) -> Column:
    """Distinct technical tokens of a claim in order: with a digit or one of . / _ + -, or with a capital and short."""
    raw = F.regexp_extract_all(F.coalesce(claim, F.lit("")), F.lit(r"[A-Za-z0-9][A-Za-z0-9./_+-]*"), F.lit(0))
    good = F.filter(raw, lambda t: ~F.lower(t).isin(PLAIN_WORDS) & (t.rlike(r"[0-9./_+-]") | (t.rlike("[A-Z]") & (F.length(t) <= 12)) | ((F.length(t) >= 2) & ~t.rlike("[a-z]"))))
    return F.array_distinct(F.transform(good, F.lower))


def evidence_units(context: Column) -> Column:
    """Lines, the joined cells of table rows, and sentences of the squeezed text."""
    text = F.coalesce(context, F.lit(""))
    rows = F.filter(F.transform(lines(text), strip), lambda x: x != "")
    cells = F.filter(F.transform(F.filter(rows, lambda x: x.contains("|")), table_cells), lambda x: x != "")
    whole = F.filter(F.transform(F.split(F.regexp_replace(text, BLANKS, " "), r"(?<=[.!?])\s+"), strip), lambda x: x != "")
    return F.concat(rows, cells, whole)


def grounded(claim: Column, context: Column) -> Column:
    """Whether some evidence unit holds every technical token of the claim; a claim without such tokens is not grounded.

    A token with a sign is looked for as it stands, others between bounds of letters and digits.
    """
    tokens = F.filter(F.transform(claim_tokens(claim), grounding_form), lambda t: t != "")
    units = F.transform(evidence_units(context), lambda u: F.struct(grounding_form(u).alias("raw"), F.concat(F.lit(" "), F.regexp_replace(grounding_form(u), "[^a-z0-9]", " "), F.lit(" ")).alias("words")))
    holds = lambda u, t: F.when(t.rlike("[^a-z0-9]"), u["raw"].contains(t)).otherwise(u["words"].contains(F.concat(F.lit(" "), t, F.lit(" "))))
    return (F.size(tokens) > 0) & F.exists(units, lambda u: F.forall(tokens, lambda t: holds(u, t)))


def all_grounded(claims: Column, context: Column) -> Column:
    """Whether there is a claim that is not blank, and all such are grounded."""
    said = F.filter(F.coalesce(claims, F.array().cast("array<string>")), lambda c: F.trim(c) != "")
    return (F.size(said) > 0) & F.forall(said, lambda c: grounded(c, context))


def verifier_verdict(enabled: Column, context: Column, answer: Column, verdict: Column, claims: Column) -> Column:
    """The decision about an answer from a model's verdict, with the deterministic check behind it."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    missing = F.lower(answer).contains("information not found")
    said = F.upper(F.trim(F.coalesce(verdict, F.lit(""))))
    return F.when(~enabled, True).when(blank(context) | blank(answer), False).when(missing, True).when(said == "SUPPORTED", True).otherwise(all_grounded(claims, context))


def lexicon_audit(texts: DataFrame, id_col: str, text_col: str, lexicon: DataFrame, tagged: DataFrame | None = None) -> DataFrame:
    """(id, messages): what the lexicon(keyword, pos, is_approved, alternatives) forbids, in order of appearance.

    `tagged` (id, position, text, lemma, pos) comes from a tagger; without it a word is its own lemma and has any part
    of speech. Word and lemma are looked up by one equi-join over both.
    """
    if tagged is None:
        words = texts.select(F.col(id_col).alias("id"), F.posexplode(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"[\p{L}\p{N}]+(?:[-'’][\p{L}\p{N}]+)*"), F.lit(0))).alias("position", "text"))
        tagged = words.select("id", "position", "text", F.lower("text").alias("lemma"), F.lit(None).cast("string").alias("pos"))
    keyed = tagged.select("id", "position", "text", "pos", F.explode(F.array_distinct(F.array(F.lower("lemma"), F.lower("text")))).alias("keyword"))
    rules = lexicon.filter(~F.coalesce("is_approved", F.lit(True))).select(F.lower("keyword").alias("keyword"), F.upper("pos").alias("rule_pos"), "alternatives")
    hits = keyed.join(rules, "keyword").filter(F.col("rule_pos").isNull() | F.col("pos").isNull() | (F.col("pos") == F.col("rule_pos")))
    instead = F.when(F.size("alternatives") > 0, F.array_join("alternatives", ", ")).otherwise(F.lit("an approved alternative"))
    message = F.concat(F.lit("Do not use the "), F.coalesce("pos", F.lit("word")), F.lit(" '"), F.col("text"), F.lit("'. Use: "), instead, F.lit("."))
    first = hits.select("id", "position", message.alias("message")).groupBy("id", "message").agg(F.min("position").alias("position"))
    return first.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "message"))), lambda x: x["message"]).alias("messages"))


