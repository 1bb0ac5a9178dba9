"""Checks of cells against rules: list, whole number, decimal and custom formula.

Blank cells pass a rule that allows blanks (lists do unless said otherwise) and fail the others.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.refs import parse
from leafmill.operators.cells import NUMBER, in_range


@dataclass(frozen=True)
class Check:
    range: str
    kind: str
    values: tuple[str, ...] = ()
    expression: str = ""
    message: str = ""
    allow_blank: bool = False


def dropdown(values: list[str], range: str = "A1:A100", message: str = "") -> Check:
    return Check(range, "List", tuple(values), message=message, allow_blank=True)


def whole_number(range: str = "A1:A100", message: str = "") -> Check:
    return Check(range, "WholeNumber", message=message)


def decimal(range: str = "A1:A100", message: str = "") -> Check:
    return Check(range, "Decimal", message=message)


def passes(value: Column, check: Check) -> Column:
    v = F.coalesce(value, F.lit(""))
    if check.kind == "List":
        ok = v.isin(*check.values)
    elif check.kind == "WholeNumber":
        ok = v.rlike(r"^[+-]?[0-9]+$")
    elif check.kind == "Decimal":
        ok = v.rlike(NUMBER)
    elif check.kind == "Custom":
        ok = F.coalesce(F.expr(check.expression), F.lit(False))
    else:
        raise ValueError(f"unknown kind {check.kind}")
    return F.when(v == "", F.lit(check.allow_blank)).otherwise(ok)


def violations(cells: DataFrame, checks: list[Check]) -> DataFrame:
    """(workbook, sheet, row, col, value, rule, message) of the cells that fail; each rule is a predicate, and the cells
    are read once for all."""
    failed = F.filter(
        F.array(*[F.when(in_range(parse(c.range)) & ~passes(F.col("value"), c), F.struct(F.lit(c.kind).alias("rule"), F.lit(c.message).alias("message"))) for c in checks]),
        lambda x: x.isNotNull(),
    )
    near = reduce(lambda a, b: a | b, [in_range(parse(c.range)) for c in checks])
    return cells.where(near).select("workbook", "sheet", "row", "col", "value", F.explode(failed).alias("f")).select("workbook", "sheet", "row", "col", "value", "f.rule", "f.message")
