"""Preparation of queries: source commands, clean-up and expansion, routing labels, prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMMAND = r"(?:^|\s)/([\w.-]+)"
REQUEST = r"(?i)^\s*(?:write|create|generate|produce|provide)\s+(?:an?\s+)?(?:asd[-\s]?ste100\s+)?(?:procedure|descriptive\s+text|safety\s+warning|safety\s+caution)\s+(?:for|about|on)\s+"
FORMAT_WORDS = r"(?i)\basd[-\s]?ste100\b|\bprocedure\b|\bdescriptive\s+text\b|\bsafety\s+warning\b|\bsafety\s+caution\b"


def source_command(query: Column) -> tuple[Column, Column]:
    """(command, query without it): the first word after a slash, null if there is none."""
    command = F.nullif(F.lower(F.regexp_extract(query, COMMAND, 1)), F.lit(""))
    return command, F.trim(F.regexp_replace(query, COMMAND, ""))


def with_source_filter(queries: DataFrame, query_col: str, sources: DataFrame, source_col: str) -> DataFrame:
    """queries with source_filter and standalone query: a command that names no known source is dropped but cut out."""
    command, rest = source_command(F.col(query_col))
    marked = queries.withColumn("_command", command).withColumn("standalone", rest)
    known = sources.select(F.lower(F.col(source_col)).alias("_known")).distinct()
    commands = marked.select("_command").filter("_command is not null").distinct()
    valid = commands.join(known, F.col("_known").contains(F.col("_command")), "left_semi").select("_command", F.col("_command").alias("source_filter"))
    return marked.join(valid, "_command", "left").drop("_command")


def retrieval_query(query: Column, template: Column, rules: list[tuple[list[str], str]], safety_terms: str = "warning caution danger safety") -> Column:
    """The query without request phrases, format words and other signs than . / _ -, with the terms of the first rule
    whose triggers it all contains, and with `safety_terms` for the safety template. Never empty for a non-empty query."""
    t = F.trim(F.coalesce(query, F.lit("")))
    clean = F.regexp_replace(F.regexp_replace(t, REQUEST, ""), FORMAT_WORDS, " ")
    clean = F.trim(F.regexp_replace(F.regexp_replace(clean, "[^A-Za-z0-9./_-]+", " "), r"\s+", " "))
    low, extra = F.lower(clean), F.lit("")
    for triggers, terms in reversed(rules):
        hit = F.lit(True)
        for x in triggers:
            hit = hit & low.contains(x)
        extra = F.when(hit, F.lit(terms)).otherwise(extra)
    safety = F.when(F.lower(F.coalesce(template, F.lit(""))) == "safety", F.lit(safety_terms)).otherwise("")
    out = F.array_join(F.filter(F.array(clean, extra, safety), lambda x: x != ""), " ")
    return F.when(out == "", t).otherwise(out)


def label_in(text: Column, labels: list[str], default: str) -> Column:
    """The first label that a model's answer contains."""
    up = F.upper(F.coalesce(text, F.lit("")))
    out = F.lit(default)
    for label in reversed(labels):
        out = F.when(up.contains(label.upper()), F.lit(label)).otherwise(out)
    return out


def filled(template: Column, fields: dict[str, Column]) -> Column:
    """A prompt template with its {fields} replaced."""
    for name, value in fields.items():
        template = F.replace(template, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return template


def rules_prompt(core: list[str], by_template: dict[str, list[str]], template: Column, restrictions: Column) -> Column:
    """The rules part of a prompt: core rules, those of the template, and restrictions of the lexicon if there are any."""
    kind = F.lower(F.coalesce(template, F.lit("general")))
    own = F.lit("")
    for name, rules in by_template.items():
        own = F.when(kind == name, F.lit("".join(f"\n- {r}" for r in rules))).otherwise(own)
    head = "<CORE_RULES>" + "".join(f"\n- {r}" for r in core) + "\n</CORE_RULES>\n\n<DYNAMIC_RULES>\nOutput Format Required: "
    some = F.size(F.coalesce(restrictions, F.array().cast("array<string>"))) > 0
    tail = F.when(some, F.concat(F.lit("\n<DICTIONARY_RESTRICTIONS>\n"), F.array_join(restrictions, "\n"), F.lit("\n</DICTIONARY_RESTRICTIONS>"))).otherwise("")
    return F.concat(F.lit(head), F.upper(kind), own, F.lit("\n</DYNAMIC_RULES>\n"), tail)


def verdict_of(parsed: Column) -> tuple[Column, Column]:
    """(verdict, claims) of a verifier's parsed JSON: claims may be one string or a list, anything else is none."""
    verdict = F.upper(F.trim(F.try_variant_get(parsed, "$.verdict", "string")))
    many = F.try_variant_get(parsed, "$.unsupported_claims", "array<string>")
    one = F.try_variant_get(parsed, "$.unsupported_claims", "string")
    is_list = F.schema_of_variant(F.try_variant_get(parsed, "$.unsupported_claims", "variant")).startswith("ARRAY")
    return verdict, F.when(is_list, many).when(one.isNotNull(), F.array(one)).otherwise(F.array().cast("array<string>"))
