"""Data behind charts: series and categories, and what each kind of chart draws of them.

Kinds with a variant of their own for markers or percent draw like their plain kind (fixed values).  A stacked chart
piles series in their order; a 100 % chart shows shares of the category; a pie shows shares of the whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.refs import parse
from leafmill.operators.cells import in_range, number

# Chart kind to (plain kind, way of piling) (fixed values).
KINDS = {
    "Column": ("column", "plain"), "ColumnStacked": ("column", "stacked"), "ColumnPercentStacked": ("column", "percent"),
    "Bar": ("bar", "plain"), "BarStacked": ("bar", "stacked"), "BarPercentStacked": ("bar", "percent"),
    "Line": ("line", "plain"), "LineStacked": ("line", "stacked"), "LinePercentStacked": ("line", "percent"), "LineMarkers": ("line", "plain"),
    "Area": ("area", "plain"), "AreaStacked": ("area", "stacked"), "AreaPercentStacked": ("area", "percent"),
    "Pie": ("pie", "share"), "Doughnut": ("doughnut", "share"),
    "Scatter": ("scatter", "plain"), "ScatterSmooth": ("scatter", "plain"), "ScatterLines": ("scatter", "plain"), "ScatterMarkers": ("scatter", "plain"),
    "Radar": ("radar", "plain"), "RadarMarkers": ("radar", "plain"), "RadarFilled": ("radar", "plain"),
}


def series_data(cells: DataFrame, name: str, data_range: str, category_range: str | None = None) -> DataFrame:
    """(workbook, sheet, series, ordinal, category, value): values and categories paired, workbook by workbook, by their place in
    their ranges.  Without a sheet in a range each sheet has a series of its own, and the categories are of the same sheet."""
    def column(ref: str, to: str) -> DataFrame:
        box = parse(ref)
        place = (F.col("row") - box.row) * (box.end_col - box.col + 1) + (F.col("col") - box.col)
        return cells.where(in_range(box)).select("workbook", "sheet", place.cast("long").alias("ordinal"), F.col("value").alias(to))

    values = column(data_range, "value")
    keys = ["workbook", "ordinal"] + (["sheet"] if not (category_range and parse(category_range).sheet) else [])
    categories = column(category_range, "category") if category_range else None
    if categories is not None and "sheet" not in keys:
        categories = categories.drop("sheet")
    got = values.join(categories, keys, "left") if categories is not None else values.withColumn("category", (F.col("ordinal") + 1).cast("string"))
    return got.select("workbook", "sheet", F.lit(name).alias("series"), "ordinal", "category", number(F.col("value")).alias("value"))


def drawn(data: DataFrame, kind: str) -> DataFrame:
    """`data` (series, category, value) with ``kind``, ``base`` and ``drawn``: where a mark begins and how long it is."""
    plain, way = KINDS[kind]
    pile = Window.partitionBy("category").orderBy("series").rowsBetween(Window.unboundedPreceding, -1)
    whole = F.sum("value").over(Window.partitionBy("category"))
    got = data.withColumn("kind", F.lit(plain))
    if way == "stacked":
        return got.withColumn("base", F.coalesce(F.sum("value").over(pile), F.lit(0.0))).withColumn("drawn", F.col("value"))
    if way == "percent":
        return got.withColumn("base", F.try_divide(F.coalesce(F.sum("value").over(pile), F.lit(0.0)), whole)).withColumn("drawn", F.try_divide(F.col("value"), whole))
    if way == "share":
        return got.withColumn("base", F.lit(0.0)).withColumn("drawn", F.try_divide(F.col("value"), F.sum("value").over(Window.partitionBy("series"))))
    return got.withColumn("base", F.lit(0.0)).withColumn("drawn", F.col("value"))


def placement(charts: int, data_rows: int, gap: int = 2, height: int = 20) -> list[int]:
    """First rows of charts set below the data."""
    return [data_rows + gap + k * height for k in range(charts)]
