"""Questions to answers as one batch plan; models come as callables over DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.models import corrected
from lodestrata.functions.text import base_name, json_in, says_not_found, source_block_key
from lodestrata.operators import answers, querying
from lodestrata.plans import retrieval
from lodestrata.session import checkpointed

#: A model: takes a DataFrame with a prompt column and returns it with an answer column.
Model = Callable[[DataFrame], DataFrame]
NOTHING_FOUND = "Information not found in provided documents."
# What the templates allow: characters of context, tokens of an answer, texts of the context.
BUDGETS = {"safety": 5500, "procedure": 4500, "descriptive": 7000, "general": 6000}
MOST_TOKENS = {"safety": 768, "procedure": 768, "descriptive": 1024, "general": 1024}
TEXTS = {"safety": 3, "procedure": 3, "descriptive": 3, "general": 3}

PROMPTS = {
    "rewrite": "Rewrite the question so that it stands alone.\nConversation:\n{history}\nQuestion: {query}",
    "route": "Is the question to be answered by search or by chat? Answer SEARCH or CHAT.\n{query}",
    "answer": "{rules}\nConversation:\n{history}\nContext:\n{context}\nQuestion: {query}\nPut the answer into an answer element.",
    "verify": 'Does the context support the answer? Reply as JSON {"verdict": "SUPPORTED" or "UNSUPPORTED", "unsupported_claims": [...]}.\nContext:\n{context}\nAnswer:\n{answer}',
    "correct": "{rules}\nRewrite the answer so that these findings no longer hold:\n{findings}\nAnswer:\n{answer}",
}


@dataclass(frozen=True)
class AnswerParams:
    retrieval: retrieval.RetrievalParams = retrieval.RetrievalParams()
    verify: bool = True
    corrections: int = 2
    core_rules: list[str] = field(default_factory=list)
    template_rules: dict[str, list[str]] = field(default_factory=dict)
    expansions: list[tuple[list[str], str]] = field(default_factory=list)
    prompts: dict[str, str] = field(default_factory=lambda: PROMPTS)


def _ask(model: Model, df: DataFrame, template: str, fields: dict[str, Column], out: str) -> DataFrame:
    """df with a model's answer to the filled template."""
    asked = model(df.withColumn("prompt", querying.filled(F.lit(template), fields)))
    return asked.withColumnRenamed("answer", out).drop("prompt")


def _only_where(df: DataFrame, condition: Column, step: Callable[[DataFrame], DataFrame], otherwise: dict[str, Column]) -> DataFrame:
    """step over the rows of a condition, the other columns over the rest: a model must not see the rest at all.

    The input and the result are materialised: both branches read the one, and no later plan asks the model again.
    """
    yes = F.coalesce(condition, F.lit(False))
    df = checkpointed(df.withColumn("_yes", yes))
    done = step(df.filter("_yes")).unionByName(df.filter("not _yes").withColumns(otherwise))
    return checkpointed(done.drop("_yes"))


def template_value(template: Column, values: dict[str, int]) -> Column:
    """The value of a template, without regard to letter case and blanks; that of general for any other."""
    kind = F.lower(F.trim(F.coalesce(template, F.lit("general"))))
    out = F.lit(values["general"])
    for name, value in values.items():
        out = F.when(kind == name, value).otherwise(out)
    return out


def context_limit(template: Column) -> Column:
    return template_value(template, BUDGETS)


def prepared(questions: DataFrame, sources: DataFrame, model: Model, p: AnswerParams) -> DataFrame:
    """questions(query_id, query, history, template_type, strict_mode, last_context) with route, source_filter and the
    standalone query. A given template means search without asking; a question without history is not rewritten."""
    q = querying.with_source_filter(questions, "query", sources, "source")
    given = F.col("template_type").isNotNull() & (F.lower("template_type") != "general")
    route = lambda d: _ask(model, d, p.prompts["route"], {"query": F.col("standalone")}, "route")
    q = _only_where(q, ~given, route, {"route": F.lit("SEARCH")}).withColumn("route", querying.label_in(F.col("route"), ["SEARCH", "CHAT"], "SEARCH"))
    spoken = (F.col("route") == "SEARCH") & (F.trim(F.coalesce("history", F.lit(""))) != "")
    rewrite = lambda d: _ask(model, d, p.prompts["rewrite"], {"history": F.col("history"), "query": F.col("standalone")}, "rewritten")
    q = _only_where(q, spoken, rewrite, {"rewritten": F.lit(None).cast("string")})
    asked = F.coalesce(F.nullif(F.trim("rewritten"), F.lit("")), F.col("standalone"))
    return q.withColumn("standalone", querying.retrieval_query(asked, F.col("template_type"), p.expansions)).drop("rewritten")


def answered(questions: DataFrame, chunks: DataFrame, vectors: DataFrame, embed: Callable[[DataFrame], DataFrame], model: Model, p: AnswerParams = AnswerParams(), lexicon: DataFrame | None = None) -> DataFrame:
    """One row for each question: query_id, final_text, context, is_compliant, was_corrected, feedback, sources.

    `embed` adds the column embedding to a DataFrame with query. Questions with an empty context are answered that
    nothing was found, without a model. An answer that its context does not support is replaced likewise and loses its
    sources. A restricted question searches only the sources that contain its filter.
    """
    q = prepared(questions, chunks.select(base_name(F.col("source")).alias("source")).filter("source is not null"), model, p)
    ask = checkpointed(embed(q.filter("route = 'SEARCH'").select("query_id", F.col("standalone").alias("query"), "source_filter")))
    free = retrieval.retrieve(chunks, vectors, ask.filter("source_filter is null").drop("source_filter"), p.retrieval)
    found = free.unionByName(retrieval.retrieve(chunks, vectors, ask.filter("source_filter is not null"), p.retrieval, within=True))
    limits = q.select("query_id", context_limit(F.col("template_type")).alias("_limit"))
    made = checkpointed(retrieval.contexts(found.join(limits, "query_id"), F.col("_limit")))
    rows = q.join(made, "query_id", "left")
    chat = F.col("route") == "CHAT"
    rows = rows.withColumn("context", F.coalesce(F.when(chat, F.col("last_context")).otherwise(F.col("context")), F.lit("")))

    rules = querying.rules_prompt(p.core_rules, p.template_rules, F.col("template_type"), F.array().cast("array<string>"))
    generate = lambda d: _ask(model, d, p.prompts["answer"], {"rules": rules, "history": F.col("history"), "context": F.col("context"), "query": F.col("query")}, "raw")
    rows = _only_where(rows, chat | (F.trim("context") != ""), generate, {"raw": F.lit(NOTHING_FOUND)}).withColumn("final_text", answers.cleaned_output(F.col("raw"))).drop("raw")

    checkable = F.lit(p.verify) & ~chat & ~says_not_found(F.col("final_text")) & (F.trim("final_text") != "")
    check = lambda d: _ask(model, d, p.prompts["verify"], {"context": F.col("context"), "answer": F.col("final_text")}, "reply")
    rows = _only_where(rows, checkable, check, {"reply": F.lit(None).cast("string")})
    verdict, claims = querying.verdict_of(json_in(F.col("reply")))
    good = answers.verifier_verdict(F.lit(p.verify), F.col("context"), F.col("final_text"), verdict, claims)
    rows = rows.withColumn("_good", chat | F.coalesce(good, F.lit(False))).drop("reply")
    rows = rows.withColumn("final_text", F.when(F.col("_good"), F.col("final_text")).otherwise(NOTHING_FOUND)).withColumn("sources", F.when(F.col("_good"), F.col("citations"))).drop("_good", "citations")

    def audit(d: DataFrame) -> DataFrame:
        none = F.lit(None).cast("int")
        style = answers.style_audit(F.col("final_text"), F.col("template_type"), none, none, F.lit(True))
        quiet = says_not_found(F.col("final_text")) | (F.col("route") == "CHAT")
        out = d.withColumn("messages", F.when(quiet, F.array().cast("array<string>")).otherwise(style["feedback"]))
        if lexicon is not None:
            words = answers.lexicon_audit(d, "query_id", "final_text", lexicon).select(F.col("id").alias("query_id"), F.col("messages").alias("_words"))
            out = out.join(words, "query_id", "left").withColumn("messages", F.concat("messages", F.coalesce("_words", F.array().cast("array<string>")))).drop("_words")
        return out.withColumn("compliant", F.size("messages") == 0)

    def rewrite(d: DataFrame) -> DataFrame:
        told = _ask(model, audit(d), p.prompts["correct"], {"rules": rules, "findings": F.array_join("messages", "\n"), "answer": F.col("final_text")}, "again").drop("messages", "compliant")
        return told.withColumn("final_text", F.coalesce(F.nullif(answers.cleaned_output(F.col("again")), F.lit("")), F.col("final_text"))).drop("again")

    strict = F.coalesce("strict_mode", F.lit(False))
    fixed = corrected(rows.filter(strict), "final_text", audit, rewrite, p.corrections)
    plain = audit(rows.filter(~strict)).withColumn("was_corrected", F.lit(False))
    done = fixed.unionByName(plain.select(fixed.columns))
    return done.select("query_id", "final_text", "context", F.col("compliant").alias("is_compliant"), "was_corrected", F.col("messages").alias("feedback"), "sources")


def kept_sources(context: Column, sources: Column) -> Column:
    """The sources whose marker stands in a trimmed context; all, if it has no marker."""
    blocks = F.filter(F.transform(F.split(context, "(?=--- SOURCE:)"), source_block_key), lambda k: k["source"] != "")
    keys = F.transform(blocks, lambda k: F.concat_ws("|", k["source"], k["page"]))
    own = F.filter(sources, lambda s: F.array_contains(keys, F.concat_ws("|", base_name(s["source"]), F.coalesce(s["page"].cast("string"), F.lit("")))))
    return F.when(F.size(keys) > 0, own).otherwise(sources)
