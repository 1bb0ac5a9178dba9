"""Literal replacement with counts, context windows, placeholders and escaping, as column expressions.

Null texts stay null and count no hits; an empty rule pattern or a rule that changes nothing is rejected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rule = tuple[str, str]


def check_rules(rules: list[Rule]) -> list[Rule]:
    """The rules, or ValueError naming the first that has an empty pattern or replaces a text by itself."""
    for k, (old, new) in enumerate(rules):
        if not old:
            raise ValueError(f"rule {k}: nothing to look for")
        if old == new:
            raise ValueError(f"rule {k}: {old!r} is replaced by itself")
    return rules


def valid_rule(old: Column, new: Column) -> Column:
    return (F.coalesce(old, F.lit("")) != "") & (old != F.coalesce(new, F.lit("")))


def replace_one(text: Column, rule: Rule) -> Column:
    """All non-overlapping hits from left to right, literally and case-sensitively."""
    return F.replace(text, F.lit(rule[0]), F.lit(rule[1]))


def replace_all(text: Column, rules: list[Rule]) -> Column:
    """The rules in order, each on what the earlier ones left; one nested expression, so one projection."""
    return reduce(replace_one, check_rules(rules), text)


def hits(text: Column, old: str) -> Column:
    """Non-overlapping occurrences of `old`."""
    cut = F.replace(text, F.lit(old), F.lit(""))
    return F.coalesce((F.length(text) - F.length(cut)) / F.lit(len(old)), F.lit(0)).cast("long")


def replace_steps(df: DataFrame, text: str, rules: list[Rule]) -> DataFrame:
    """`df` with ``replaced`` and ``hits_0`` ...: the count of each rule on the text before it.

    The texts between the rules are columns of their own, so each is computed once."""
    check_rules(rules)
    keep = list(df.columns)
    now = df.withColumn("_t0", F.col(text))
    for k, rule in enumerate(rules):
        now = now.withColumn(f"hits_{k}", hits(F.col(f"_t{k}"), rule[0])).withColumn(f"_t{k + 1}", replace_one(F.col(f"_t{k}"), rule))
    return now.select(*keep, F.col(f"_t{len(rules)}").alias("replaced"), *[f"hits_{k}" for k in range(len(rules))])


def context(text: Column, term: str, around: int = 200, otherwise: int = 400) -> Column:
    """The first hit with `around` characters on either side, clamped; without a hit the first `otherwise` characters."""
    at = F.instr(text, term)
    start = F.greatest(at - around, F.lit(1))
    stop = at + len(term) + around
    return F.when(at > 0, F.substring(text, start, stop - start)).otherwise(F.substring(text, 1, otherwise))


def placeholders(text: Column) -> Column:
    """What stands between each ``{{`` and the next ``}}`` after it, in order; unclosed ones run to the end."""
    parts = F.split(text, r"\{\{", -1)
    return F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.split(p, r"\}\}", 2)[0])


def render(template: Column, values: dict[str, Column]) -> Column:
    """``{{key}}`` replaced by the values, keys in sorted order so that the result is determined; null values as ''."""
    return reduce(lambda t, k: F.replace(t, F.lit("{{" + k + "}}"), F.coalesce(values[k].cast("string"), F.lit(""))), sorted(values), template)


def escape_html(text: Column) -> Column:
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")], text)


def escape_xml(text: Column) -> Column:
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")], text)


def line_diff(before: DataFrame, after: DataFrame, key: str, text: str) -> DataFrame:
    """Positional difference of lines: (key, pos, op, line) with op '-' (only before), '+' (only after) or ' ' (same)."""
    lines = lambda df, name: df.select(F.col(key), F.posexplode(F.split(text, "\n", -1)).alias("pos", name))
    both = lines(before, "a").join(lines(after, "b"), [key, "pos"], "full_outer")
    same = F.col("a").eqNullSafe(F.col("b"))
    ops = F.when(same, F.array(F.struct(F.lit(" ").alias("op"), F.col("a").alias("line")))).otherwise(
        F.filter(F.array(F.struct(F.lit("-").alias("op"), F.col("a").alias("line")), F.struct(F.lit("+").alias("op"), F.col("b").alias("line"))), lambda x: x["line"].isNotNull())
    )
    return both.select(key, "pos", F.explode(ops).alias("o")).select(key, "pos", "o.op", "o.line")
