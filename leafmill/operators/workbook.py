"""A workbook as one object over its cells: the sheet-level operations, each giving a new table of cells.

Rules here may be regular expressions, may ignore case and may be bound to a range.  Null values stay null.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.refs import parse
from leafmill.operators import cells as c
from leafmill.operators import charts as ch


@dataclass(frozen=True)
class CellRule:
    name: str
    pattern: str
    replacement: str
    target_range: str | None = None
    case_sensitive: bool = True
    regex: bool = False

    @property
    def expression(self) -> str:
        text = self.pattern if self.regex else "\\Q" + self.pattern.replace("\\E", "\\E\\\\E\\Q") + "\\E"
        return text if self.case_sensitive else "(?i)" + text

    @property
    def new(self) -> str:
        """What a regular-expression replacement takes; without `regex` it is literal."""
        return self.replacement if self.regex else self.replacement.replace("\\", "\\\\").replace("$", "\\$")


def applied(value: Column, rule: CellRule) -> Column:
    inside = c.in_range(parse(rule.target_range)) if rule.target_range else F.lit(True)
    return F.when(inside, F.regexp_replace(value, F.lit(rule.expression), F.lit(rule.new))).otherwise(value)


def apply_rules(cells: DataFrame, rules: list[CellRule]) -> DataFrame:
    """`cells` with the rules applied in order and ``changed``: one projection, whatever the number of rules."""
    done = reduce(applied, rules, F.col("value"))
    return cells.withColumn("_new", done).withColumn("changed", ~F.col("_new").eqNullSafe(F.col("value"))).withColumn("value", F.col("_new")).drop("_new")


def rule_hits(cells: DataFrame, rules: list[CellRule]) -> DataFrame:
    """(rule, cells): how many cells each rule alone would change; one pass."""
    sums = cells.agg(*[F.count_if(applied(F.col("value"), r) != F.col("value")).alias(f"_{k}") for k, r in enumerate(rules)])
    rows = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.col(f"_{k}").alias("cells")) for k, r in enumerate(rules)])
    return sums.select(F.explode(rows).alias("r")).select("r.*")


@dataclass(frozen=True)
class Workbook:
    cells: DataFrame

    def sheets(self) -> DataFrame:
        return c.list_sheets(self.cells)

    def read(self, ref: str, max_rows: int | None = None, max_columns: int | None = None) -> DataFrame:
        return c.read_range(self.cells, ref, max_rows, max_columns)

    def write(self, ref: str, values: DataFrame) -> Workbook:
        """The cells of the range replaced by `values` (row, col, value), whose places count from the range's corner."""
        box = parse(ref)
        kept = self.cells.where(~c.in_range(box))
        name = F.lit(box.sheet) if box.sheet else F.lit("Sheet1")
        books = self.cells.select("workbook").distinct().limit(1)
        new = values.where((F.col("row") <= box.end_row - box.row) & (F.col("col") <= box.end_col - box.col)).select(
            name.alias("sheet"), (F.col("row") + box.row).cast("long").alias("row"), (F.col("col") + box.col).cast("int").alias("col"), F.coalesce("value", F.lit("")).alias("value")
        )
        return Workbook(kept.unionByName(new.withColumn("workbook", books.scalar()).select(*kept.columns)))

    def replace(self, rules: list[CellRule]) -> Workbook:
        return Workbook(apply_rules(self.cells, rules).drop("changed"))

    def with_sheet(self, cells: DataFrame) -> Workbook:
        return Workbook(self.cells.unionByName(cells))

    def without_sheet(self, sheet: str) -> Workbook:
        return Workbook(self.cells.where(F.col("sheet") != sheet))

    def metadata(self, files: DataFrame | None = None) -> DataFrame:
        """(workbook, title, sheets, names, modified): `files` may give path and modificationTime, as ``binaryFile`` does."""
        got = self.sheets().groupBy("workbook").agg(F.count(F.lit(1)).alias("sheets"), F.array_join(F.array_sort(F.collect_list("sheet")), ",").alias("names"))
        got = got.withColumn("title", F.regexp_extract("workbook", r"([^/\\]*?)(?:\.[^./\\]*)?$", 1))
        if files is None:
            return got.withColumn("modified", F.lit(None).cast("long"))
        when = files.select(F.col("path").alias("workbook"), F.unix_seconds(F.col("modificationTime")).alias("modified"))
        return got.join(when, "workbook", "left")

    def report(self, sheet: str, charts: list[tuple[str, str, str, str | None]]) -> DataFrame:
        """(chart, kind, first_row, series, ordinal, category, value): the charts of a report set below the data of a
        sheet; kinds that are not known are left out."""
        rows = self.cells.where(F.col("sheet") == sheet).agg((F.max("row") + 1).alias("n"))
        known = [x for x in charts if x[1] in ch.KINDS]
        parts = [
            ch.series_data(self.cells.where(F.col("sheet") == sheet), name, data, categories).select(
                F.lit(name).alias("chart"), F.lit(ch.KINDS[kind][0]).alias("kind"), (rows.scalar() + F.lit(2 + 20 * k)).alias("first_row"), "series", "ordinal", "category", "value"
            )
            for k, (name, kind, data, categories) in enumerate(known)
        ]
        return reduce(DataFrame.unionByName, parts)
