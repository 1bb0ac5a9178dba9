"""Pivot definitions and the plans they stand for.

A definition is plain data (JSON).  Its plan is page filter, one grouped aggregate, then windows over the grouped rows
for the ways to show values; windows therefore run over groups, not over the source rows.

Conventions: Count counts values that are not null or empty; CountNumbers counts numbers; a share of a total that is zero
is null; differences and shares of a base take the base item, or without one the previous item in order; the parent of
a row is the outer row field; Index is value * grand total / (row total * column total), null where a total is zero.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.operators.cells import NUMBER


def _numbers(c: Column) -> Column:
    return F.when(c.cast("string").rlike(NUMBER), c.cast("double"))


AGGREGATES = {
    "Sum": F.sum,
    "Count": lambda c: F.count(F.when(c.cast("string") != "", c)),
    "Average": F.avg,
    "Max": F.max,
    "Min": F.min,
    "Product": F.product,
    "CountNumbers": lambda c: F.count(_numbers(c)),
    "StdDev": F.stddev_samp,
    "StdDevP": F.stddev_pop,
    "Var": F.var_samp,
    "VarP": F.var_pop,
}
SHOW_AS = (
    "Normal", "PercentOfGrandTotal", "PercentOfColumnTotal", "PercentOfRowTotal", "PercentOf", "PercentDifferenceFrom", "DifferenceFrom", "RunningTotalIn",
    "PercentOfParentRowTotal", "PercentOfParentColumnTotal", "PercentOfParentTotal", "Index",
)
COMPARISONS = (
    "Equals", "NotEquals", "GreaterThan", "GreaterThanOrEqual", "LessThan", "LessThanOrEqual", "Between", "NotBetween", "Contains", "NotContains", "StartsWith", "EndsWith",
)


@dataclass
class DataField:
    source_field: str
    function: str = "Sum"
    display_name: str | None = None
    show_values_as: str = "Normal"
    base_field: str | None = None
    base_item: str | None = None

    @property
    def title(self) -> str:
        words = {"Sum": "Sum of", "Count": "Count of", "Average": "Average of", "Max": "Max of", "Min": "Min of"}
        return self.display_name or f"{words.get(self.function, 'Value of')} {self.source_field}"


@dataclass
class Filter:
    field: str
    comparison: str
    value: object = None
    value2: object = None
    case_sensitive: bool = False


@dataclass
class Pivot:
    name: str
    source: str = ""
    sheet: str = ""
    row_fields: list[str] = field(default_factory=list)
    column_fields: list[str] = field(default_factory=list)
    data_fields: list[DataField] = field(default_factory=list)
    page_filters: list[Filter] = field(default_factory=list)
    grand_totals_rows: bool = True
    grand_totals_columns: bool = True

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=2, ensure_ascii=False)

    @classmethod
    def from_dict(cls, got: dict) -> Pivot:
        return cls(**{**got, "data_fields": [DataField(**d) for d in got.get("data_fields", [])], "page_filters": [Filter(**f) for f in got.get("page_filters", [])]})


def export_definitions(pivots: list[Pivot]) -> str:
    return json.dumps([asdict(p) for p in pivots], indent=2, ensure_ascii=False)


def import_definitions(text: str, into: list[Pivot] | None = None) -> list[Pivot]:
    """The definitions of a JSON array, appended to those given."""
    return [*(into or []), *(Pivot.from_dict(p) for p in json.loads(text))]


def condition(c: Column, comparison: str, value: object = None, value2: object = None, case_sensitive: bool = True) -> Column:
    text = isinstance(value, str)
    if text and not case_sensitive:
        c, value, value2 = F.lower(c), value.lower(), value2.lower() if isinstance(value2, str) else value2
    table = {
        "Equals": lambda: c == value, "NotEquals": lambda: c != value, "GreaterThan": lambda: c > value, "GreaterThanOrEqual": lambda: c >= value,
        "LessThan": lambda: c < value, "LessThanOrEqual": lambda: c <= value, "Between": lambda: c.between(value, value2), "NotBetween": lambda: ~c.between(value, value2),
        "Contains": lambda: c.contains(value), "NotContains": lambda: ~c.contains(value), "StartsWith": lambda: c.startswith(value), "EndsWith": lambda: c.endswith(value),
    }
    if comparison not in table:
        raise ValueError(f"unknown comparison {comparison}")
    return table[comparison]()


def filtered(df: DataFrame, filters: list[Filter]) -> DataFrame:
    return reduce(lambda d, f: d.where(condition(F.col(f.field), f.comparison, f.value, f.value2, f.case_sensitive)), filters, df)


def grouped(df: DataFrame, pivot: Pivot) -> DataFrame:
    """The long form: row fields, column fields, one column for each data field."""
    exprs = [AGGREGATES[d.function](F.col(d.source_field)).alias(d.title) for d in pivot.data_fields]
    return filtered(df, pivot.page_filters).groupBy(*pivot.row_fields, *pivot.column_fields).agg(*exprs)


def crossed(df: DataFrame, pivot: Pivot, items: list) -> DataFrame:
    """The wide form for one column field; `items` are its values, given so that the plan is one job."""
    exprs = [AGGREGATES[d.function](F.col(d.source_field)).alias(d.title) for d in pivot.data_fields]
    return filtered(df, pivot.page_filters).groupBy(*pivot.row_fields).pivot(pivot.column_fields[0], items).agg(*exprs)


def with_totals(df: DataFrame, pivot: Pivot) -> DataFrame:
    """The long form with grand totals of rows and columns; ``total_of`` is the grouping id."""
    fields = pivot.row_fields + pivot.column_fields
    exprs = [AGGREGATES[d.function](F.col(d.source_field)).alias(d.title) for d in pivot.data_fields]
    return filtered(df, pivot.page_filters).cube(*fields).agg(F.grouping_id().cast("long").alias("total_of"), *exprs)


def with_subtotals(df: DataFrame, pivot: Pivot) -> DataFrame:
    """The long form with a subtotal for each prefix of the row fields."""
    exprs = [AGGREGATES[d.function](F.col(d.source_field)).alias(d.title) for d in pivot.data_fields]
    return filtered(df, pivot.page_filters).rollup(*pivot.row_fields).agg(F.grouping_id().cast("long").alias("total_of"), *exprs)


def show_as(long: DataFrame, value: str, mode: str, rows: list[str], columns: list[str], base_item: object = None, to: str = "shown") -> DataFrame:
    """The long form with `value` shown in one of the SHOW_AS modes."""
    v = F.col(value)
    over = lambda keys: Window.partitionBy(*keys)
    share = lambda whole: F.try_divide(v, whole)
    base_field = rows[-1]
    others = [k for k in rows + columns if k != base_field]
    if base_item is not None:
        base = F.max(F.when(F.col(base_field) == base_item, v)).over(over(others))
    else:
        base = F.lag(v).over(over(others).orderBy(base_field))
    total = F.sum(v)
    grand = long.agg(total.alias("total")).scalar()  # one value, not a window over everything
    table = {
        "Normal": lambda: v,
        "PercentOfGrandTotal": lambda: share(grand),
        "PercentOfColumnTotal": lambda: share(total.over(over(columns))),
        "PercentOfRowTotal": lambda: share(total.over(over(rows))),
        "PercentOf": lambda: share(base),
        "PercentDifferenceFrom": lambda: F.try_divide(v - base, base),
        "DifferenceFrom": lambda: v - base,
        "RunningTotalIn": lambda: total.over(over(others).orderBy(base_field).rowsBetween(Window.unboundedPreceding, 0)),
        "PercentOfParentRowTotal": lambda: share(total.over(over(rows[:-1] + columns))),
        "PercentOfParentColumnTotal": lambda: share(total.over(over(rows + columns[:-1]))),
        "PercentOfParentTotal": lambda: share(total.over(over(rows[:1] + columns))),
        "Index": lambda: F.try_divide(v * grand, total.over(over(rows)) * total.over(over(columns))),
    }
    return long.withColumn(to, table[mode]())


def top(df: DataFrame, keys: list[str], value: str, n: int, ties: list[str]) -> DataFrame:
    """The n groups with the largest sums; an ordered limit, which Spark takes per partition first."""
    return df.groupBy(*keys).agg(F.sum(value).alias("total")).orderBy(F.desc("total"), *ties).limit(n)


def above_average(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Groups whose sum is above the average of the sums, which is a scalar subquery."""
    sums = df.groupBy(*keys).agg(F.sum(value).alias("total"))
    return sums.where(F.col("total") > sums.agg(F.avg("total")).scalar())


def sort_key(item: Column, order: str | list) -> Column:
    """Ascending, Descending, Manual (all alike, so that the order stays as it is) or a list in its order, what is not in it last."""
    if order == "Manual":
        return F.lit(0)
    if isinstance(order, list):
        at = F.array_position(F.array(*[F.lit(x) for x in order]), item)
        return F.when(at > 0, at).otherwise(F.lit(len(order) + 1))
    return {"Ascending": F.asc, "Descending": F.desc}[order](item)


def metadata(definitions: DataFrame) -> DataFrame:
    """(sheet, pivots, names, sources, estimated_rows) of a table of definitions with name, sheet, source, row_fields."""
    return definitions.groupBy("sheet").agg(
        F.count(F.lit(1)).alias("pivots"), F.array_join(F.array_sort(F.collect_list("name")), ",").alias("names"),
        F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.sum(F.size("row_fields") * 100).cast("long").alias("estimated_rows"),
    )


def uses_source(definitions: DataFrame, source: str) -> DataFrame:
    return definitions.where(F.col("source") == source)
