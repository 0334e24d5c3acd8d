"""Offline evaluation: expectations, hits, verdicts and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.text import base_name, eval_compact, eval_normalised, phrase_in


def expected_groups(items: Column) -> Column:
    """Array of alternatives from strings that may be JSON lists or {any: …} / {all: …} objects."""

    def group(x: Column) -> Column:
        listed = F.from_json(x, "array<string>")
        either = F.from_json(x, "struct<any: array<string>, all: array<string>>")
        one = F.array(F.array(x))
        return (
            F.when(x.rlike(r"^\s*\["), F.array(F.coalesce(listed, F.array(x))))
            .when(x.rlike(r"^\s*\{") & either["any"].isNotNull(), F.array(either["any"]))
            .when(x.rlike(r"^\s*\{") & either["all"].isNotNull(), F.transform(either["all"], lambda y: F.array(y)))
            .otherwise(one)
        )

    return F.flatten(F.transform(F.coalesce(items, F.array().cast("array<string>")), group))


def group_hits(text: Column, groups: Column) -> Column:
    """The groups of which some phrase stands in the text."""
    norm, compact = eval_normalised(text), eval_compact(text)
    return F.filter(groups, lambda g: F.exists(g, lambda p: phrase_in(norm, compact, p)))


def hit_rate(text: Column, groups: Column) -> Column:
    """Share of the groups that are hit; 1 without groups."""
    return F.when(F.size(groups) == 0, F.lit(1.0)).otherwise(F.size(group_hits(text, groups)) / F.size(groups))


def forbidden_hits(text: Column, groups: Column) -> Column:
    norm, compact = eval_normalised(text), eval_compact(text)
    return F.filter(F.flatten(groups), lambda p: phrase_in(norm, compact, p))


def source_hit(expected: Column, returned: Column) -> Column:
    """Whether some expected source is among the returned ones, by base name; true if none is expected."""
    want = F.transform(F.coalesce(expected, F.array().cast("array<string>")), base_name)
    have = F.transform(F.coalesce(returned, F.array().cast("array<string>")), base_name)
    return (F.size(want) == 0) | F.coalesce(F.arrays_overlap(want, have), F.lit(False))


def page_hit(expected: Column, returned: Column, tolerance: int = 1) -> Column:
    """Whether some returned page lies within the tolerance of an expected one; true if none is expected."""
    want = F.coalesce(expected, F.array().cast("array<int>"))
    have = F.filter(F.coalesce(returned, F.array().cast("array<int>")), lambda p: p.isNotNull())
    return (F.size(want) == 0) | F.exists(have, lambda p: F.exists(want, lambda e: F.abs(p - e) <= tolerance))


def retrieval_passed(context: Column, source_ok: Column, page_ok: Column, keyword_rate: Column, least: float = 0.5) -> Column:
    return (F.trim(F.coalesce(context, F.lit(""))) != "") & source_ok & page_ok & (keyword_rate >= least)


def faithfulness_passed(expected_missing: Column, missing: Column, source_ok: Column, include_rate: Column, clean: Column, no_leak: Column, least: float = 0.5) -> Column:
    found = ~missing & source_ok & (include_rate >= least) & clean & no_leak
    return F.when(F.coalesce(expected_missing, F.lit(False)), missing & clean & no_leak).otherwise(found)


def style_passed(strict: Column, base: Column, compliant: Column, style: Column) -> Column:
    """In strict mode compliance and style count too."""
    return base & (~F.coalesce(strict, F.lit(False)) | (compliant & style))


def case_report(nth: Column, passed: Column, query: Column, figures: dict[str, Column]) -> Column:
    """The lines that report one case: number and outcome, query, and a line for each figure."""
    head = F.concat(F.lit("["), nth.cast("string"), F.lit("] "), F.when(passed, "PASS").otherwise("FAIL"))
    lines = [F.concat(F.lit(f"{name}: "), F.coalesce(value.cast("string"), F.lit("-"))) for name, value in figures.items()]
    return F.concat_ws("\n", head, F.concat(F.lit("Query: "), F.coalesce(query, F.lit(""))), *lines)


def summary(results: DataFrame, keys: list[str], rates: dict[str, Column], passed: Column, rollup: bool = False) -> DataFrame:
    """Cases, passed cases and mean rates, rounded, by the keys; with `rollup` also their totals."""
    grouped = results.rollup(*keys) if rollup else results.groupBy(*keys)
    means = [F.round(F.avg(c.cast("double")), 6).alias(n) for n, c in rates.items()]
    return grouped.agg(F.count(F.lit(1)).alias("cases"), F.count_if(passed).alias("passed"), *means)
