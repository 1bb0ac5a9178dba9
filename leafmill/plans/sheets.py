"""Queries over tables taken as sheets of cells: ranges, search, types, chunks, formulas, checks, charts; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import refs
from leafmill.operators import cells as c
from leafmill.operators import charts, formula, validate
from leafmill.session import table
from leafmill.streaming import chunked

PART = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]
REFS = ["A1", "Z9", "AA10", "Sheet1!B2:D10", "A0", "a1", "AB", "XFD1048576", "S_1!AA1:AB2", "B2:A0", "", "A1:", "Sheet 1!A1"]
EDGES = ["1", "-2.5", "1e5", ".5", "5.", "+3", " 1 ", "1d", "1_0", "inf", "nan", "", "true", "TRUE", "=A1", "-", "1e", "text", "0x10", "٣"]
FORMULAS = {
    "total": "=SUM(F:F)", "mean": "=AVERAGE(E:E)", "cells": "=COUNT(A:C)", "low": "=MIN(E:E)", "high": "=MAX(F:F)", "few": "=SUM(F1:F200)", "sum2": "=F1+F2*2-E1/4", "choice": '=IF(F1>F2,"first","second")',
    "nested": "=ROUND(SUM(E:E)/COUNT(E:E),3)+ABS(-2)", "missing": "=ZZ99+1", "zero": "=1/A900000", "text": "=B1+1",
}
ARITH = {"revenue": "=C1*(1-D1)", "charge": "=C1*(1-D1)*(1+E1)"}


def part_cells(spark: SparkSession, d: str) -> DataFrame:
    rows = c.numbered(table(spark, d, "part").select(*PART), ["p_partkey"])
    return c.from_table(rows, PART, F.col("row"), F.lit("part"))


def _all_sheets(spark: SparkSession, d: str) -> DataFrame:
    out = part_cells(spark, d)
    for name, key, columns in (
        ("region", "r_regionkey", ["r_regionkey", "r_name"]), ("nation", "n_nationkey", ["n_nationkey", "n_name", "n_regionkey"]),
        ("supplier", "s_suppkey", ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"]),
    ):
        rows = c.numbered(table(spark, d, name).select(*columns), [key])
        out = out.unionByName(c.from_table(rows, columns, F.col("row"), F.lit(name)))
    return out


def _out(df: DataFrame) -> DataFrame:
    return df.select("sheet", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "value")


def list_sheets(spark: SparkSession, d: str) -> DataFrame:
    return c.list_sheets(_all_sheets(spark, d)).select("sheet", "row_count", F.col("column_count").cast("long").alias("column_count"))


def read_range(spark: SparkSession, d: str) -> DataFrame:
    return _out(c.read_range(part_cells(spark, d), "B2:D120"))


def read_limits(spark: SparkSession, d: str) -> DataFrame:
    return _out(c.read_range(part_cells(spark, d), "part!A1:F2000", max_rows=50, max_columns=2))


def search_cells(spark: SparkSession, d: str) -> DataFrame:
    return _out(c.search(_all_sheets(spark, d), "1"))


def count_cells(spark: SparkSession, d: str) -> DataFrame:
    return c.count_filled(_all_sheets(spark, d)).select("sheet", "filled", "cells")


def sheet_text(spark: SparkSession, d: str) -> DataFrame:
    return c.sheet_texts(_all_sheets(spark, d)).select("sheet", F.md5("text").alias("digest"))


def chunk_dump(spark: SparkSession, d: str) -> DataFrame:
    lines = c.row_texts(part_cells(spark, d), keep_empty=True, closing=True)
    got = c.chunks(lines, 50).groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("row", "line"))).alias("l"))
    return got.select("chunk", F.md5(F.array_join(F.transform("l", lambda x: F.concat(x["line"], F.lit("\n"))), "")).alias("digest"))


def cell_types(spark: SparkSession, d: str) -> DataFrame:
    edges = spark.createDataFrame([(v,) for v in EDGES], "value string")
    both = edges.unionByName(_all_sheets(spark, d).select("value"))
    return both.groupBy(c.cell_type(F.col("value")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def shown_numbers(spark: SparkSession, d: str) -> DataFrame:
    got = part_cells(spark, d).where("col in (4, 5)")
    return got.select("row", F.col("col").cast("long").alias("col"), c.shown(c.number(F.col("value"))).alias("shown"))


def chunk_plan(spark: SparkSession, d: str) -> DataFrame:
    rows = c.numbered(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), ["l_orderkey", "l_linenumber"])
    return c.chunks(rows, chunked.PRESETS["default"].chunk_rows).groupBy("chunk", "start_row", "end_row").agg(F.count(F.lit(1)).alias("rows"), F.sum("l_quantity").alias("quantity"))


def chunk_progress(spark: SparkSession, d: str) -> DataFrame:
    return c.progress(chunk_plan(spark, d).select("chunk", "rows"), F.col("processed") / F.lit(1000.0)).select("chunk", "rows", "processed", "total", "percentage", F.round("eta", 6).alias("eta"))


def each_chunk(spark: SparkSession, d: str) -> DataFrame:
    """A function on batches of rows: quantities by flag, folded afterwards."""
    def fold(rows):
        return rows.groupby("l_returnflag", as_index=False).agg(rows=("l_quantity", "size"), quantity=("l_quantity", "sum"))

    got = chunked.each_chunk(table(spark, d, "lineitem").select("l_returnflag", "l_quantity"), fold, "l_returnflag string, rows long, quantity double")
    return got.groupBy("l_returnflag").agg(F.sum("rows").alias("rows"), F.sum("quantity").alias("quantity"))


def memory_plan(spark: SparkSession, d: str) -> DataFrame:
    from leafmill.operators.batch import memory_estimate

    got = memory_estimate(F.col("file_size"), 1)
    return table(spark, d, "pdf_documents").select("pdf_id", got["memory_mb"].alias("memory_mb"), got["streaming"].alias("streaming")).distinct()


def col_to_index(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(18278).select(F.col("id").alias("idx"), refs.column_letters(F.col("id")).alias("letters"), refs.column_index(refs.column_letters(F.col("id"))).alias("back"))


def a1_parse(spark: SparkSession, d: str) -> DataFrame:
    got = spark.createDataFrame([(r,) for r in REFS], "ref string").withColumn("r", refs.reference(F.col("ref")))
    return got.select("ref", "r.sheet", "r.col", "r.row", "r.end_col", "r.end_row", refs.format_reference(F.col("r")).alias("again"))


def range_expand(spark: SparkSession, d: str) -> DataFrame:
    box = refs.parse("B2:E40")
    rows = spark.range(1).select(F.explode(F.sequence(F.lit(box.row), F.lit(box.end_row))).alias("row"))
    return rows.select(F.col("row").cast("long").alias("row"), F.explode(F.sequence(F.lit(box.col), F.lit(box.end_col))).alias("c")).select("row", F.col("c").cast("long").alias("col"))


def formulas(spark: SparkSession, d: str) -> DataFrame:
    got = formula.evaluate(part_cells(spark, d), FORMULAS, sheet="part")
    return got.select(*[F.round(k, 4).alias(k) if k not in ("choice",) else F.col(k) for k in FORMULAS])


def formula_arith(spark: SparkSession, d: str) -> DataFrame:
    """Row formulas as columns: price, discount and tax of each line are C, D and E."""
    l = table(spark, d, "lineitem")  # noqa: E741
    names = {"C1": F.col("l_extendedprice"), "D1": F.col("l_discount"), "E1": F.col("l_tax")}

    def build(node: formula.Node):
        if node.kind == "num":
            return F.lit(node.value)
        if node.kind == "cell":
            return names[refs.index_to_letters(node.value.col) + str(node.value.row + 1)]
        a, b = (build(x) for x in node.args)
        return {"+": a + b, "-": a - b, "*": a * b}[node.value]

    made = {k: build(formula.parse_formula(t)) for k, t in ARITH.items()}
    return l.groupBy("l_returnflag").agg(*[F.round(F.sum(e), 2).alias(k) for k, e in made.items()])


def formula_refs(spark: SparkSession, d: str) -> DataFrame:
    """References of formulas joined to cells; missing ones count 0."""
    pairs = [(name, box.row, box.col) for name, text in FORMULAS.items() for box in formula.references(text) if not box.whole and box.cells == 1]
    asked = spark.createDataFrame(pairs, "formula string, row long, col long")
    got = asked.join(part_cells(spark, d).select("row", F.col("col").cast("long").alias("col"), "value"), ["row", "col"], "left")
    return got.select("formula", "row", "col", F.coalesce(c.number(F.col("value")), F.lit(0.0)).alias("num"))


def sheet_formulas(spark: SparkSession, d: str) -> DataFrame:
    """The formulas that stand in two workbooks, whose sheets have the same name: a column of row formulas and one total each."""
    cells = part_cells(spark, d)
    rows = c.numbered(table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal"), ["s_suppkey"])
    cells = cells.unionByName(c.from_table(rows, ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"], F.col("row"), F.lit("part"), workbook="suppliers"))
    cells = cells.withColumn("col", F.col("col").cast("long"))
    n = F.col("row") + 1
    lines = cells.where("col = 0").select("workbook", "sheet", "row", F.lit(6).cast("long").alias("col"), F.when(F.col("workbook") == "book", F.concat(F.lit("=F"), n, F.lit("*2+E"), n)).otherwise(
        F.concat(F.lit("=IF(D"), n, F.lit('>0,D'), n, F.lit("-A"), n, F.lit(",-1)"))).alias("value"))
    totals = spark.createDataFrame([("book", "part", 0, 7, "=SUM(F:F)"), ("book", "part", 1, 7, "=G1+1"), ("suppliers", "part", 0, 7, "=MAX(D:D)+COUNT(A1:B2)"), ("suppliers", "part", 1, 7, "=1/Z9")], "workbook string, sheet string, row long, col long, value string")
    got = formula.sheet_formulas(cells.unionByName(lines).unionByName(totals))
    return got.select("workbook", "row", "col", "formula", F.round(c.number(F.col("result")), 4).alias("num"), F.col("result").startswith("#ERROR").alias("failed"))


def validate_cells(spark: SparkSession, d: str) -> DataFrame:
    checks = [
        validate.Check("C:C", "List", ("Brand#11", "Brand#12", "Brand#21", "Brand#33"), allow_blank=True, message="brand"), validate.whole_number("E:E", "size"),
        validate.whole_number("F:F", "price"), validate.decimal("F:F"), validate.Check("E:E", "Custom", expression="try_cast(value AS INT) % 2 = 0", message="even"),
    ]
    got = validate.violations(part_cells(spark, d), checks)
    return got.groupBy("rule", "message").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first_row"))


def chart_series(spark: SparkSession, d: str) -> DataFrame:
    got = charts.series_data(part_cells(spark, d), "price", "F:F", "C:C")
    return got.select("series", "ordinal", "category", "value")


def _drawn(kind: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        l = table(spark, d, "lineitem")  # noqa: E741
        data = l.groupBy(F.col("l_returnflag").alias("series"), F.col("l_linestatus").alias("category")).agg(F.sum("l_quantity").alias("value"))
        got = charts.drawn(data, kind)
        return got.select("series", "category", "kind", F.round("base", 8).alias("base"), F.round("drawn", 8).alias("drawn"))

    return query


QUERIES = {f.__name__: f for f in (
    list_sheets, read_range, read_limits, search_cells, count_cells, sheet_text, chunk_dump, cell_types, shown_numbers, chunk_plan, chunk_progress, each_chunk, memory_plan, col_to_index, a1_parse,
    range_expand, formulas, sheet_formulas, formula_arith, formula_refs, validate_cells, chart_series,
)}
QUERIES |= {f"chart_{k}": _drawn(kind) for k, kind in (("column", "Column"), ("stacked", "ColumnStacked"), ("percent", "BarPercentStacked"), ("pie", "Pie"), ("scatter", "ScatterSmooth"))}


def _sheet(name: str, key: str, columns: list[str]) -> str:
    values = ", ".join(f"coalesce({x}::VARCHAR, '')" for x in columns)
    return f"SELECT '{name}' AS sheet, row, unnest(range({len(columns)})) AS col, unnest([{values}]) AS value FROM (SELECT *, row_number() OVER (ORDER BY {key}) - 1 AS row FROM {name})"


_PART = _sheet("part", "p_partkey", PART)
_ALL = " UNION ALL ".join([
    _PART, _sheet("region", "r_regionkey", ["r_regionkey", "r_name"]), _sheet("nation", "n_nationkey", ["n_nationkey", "n_name", "n_regionkey"]),
    _sheet("supplier", "s_suppkey", ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"]),
])
_NUM = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"
_CHUNKS = """SELECT row // 1000 AS chunk, row // 1000 * 1000 AS start_row, (row // 1000 + 1) * 1000 AS end_row, count(*) AS rows, sum(l_quantity) AS quantity
    FROM (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_quantity) - 1 AS row, l_quantity FROM lineitem) GROUP BY ALL"""
_FIRST = "(SELECT {0} FROM part ORDER BY p_partkey LIMIT 1 OFFSET {1})"
_OF_ALL = "(SELECT {0} FROM part)"
_DRAWN = "SELECT series, category, '{0}' AS kind, round({1}, 8) AS base, round({2}, 8) AS drawn FROM (SELECT l_returnflag AS series, l_linestatus AS category, sum(l_quantity) AS value FROM lineitem GROUP BY ALL)"
_PILE = "coalesce(sum(value) OVER (PARTITION BY category ORDER BY series ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)"
_LETTERS = "CASE WHEN i < 26 THEN chr(65 + i::INT) WHEN i < 702 THEN chr((65 + (i - 26) // 26)::INT) || chr((65 + (i - 26) % 26)::INT) ELSE chr((65 + (i - 702) // 676)::INT) || chr((65 + (i - 702) // 26 % 26)::INT) || chr((65 + (i - 702) % 26)::INT) END"
_REF = r"^(?:([A-Za-z0-9_]+)!)?([A-Z]{1,3})([0-9]{1,7})(?::([A-Z]{1,3})([0-9]{1,7}))?$"
_INDEX = "list_reduce(list_prepend(0::BIGINT, list_transform(string_split({0}, ''), lambda x: (ord(x) - 64)::BIGINT)), lambda a, b: a * 26 + b) - 1"

SQL = {
    "list_sheets": f"SELECT sheet, max(row) + 1 AS row_count, max(col) + 1 AS column_count FROM ({_ALL}) GROUP BY sheet",
    "read_range": f"SELECT sheet, row, col, value FROM ({_PART}) WHERE row BETWEEN 1 AND 119 AND col BETWEEN 1 AND 3",
    "read_limits": f"SELECT sheet, row, col, value FROM ({_PART}) WHERE row < 50 AND col < 2",
    "search_cells": f"SELECT sheet, row, col, value FROM ({_ALL}) WHERE contains(value, '1')",
    "count_cells": f"SELECT sheet, count(*) FILTER (value <> '') AS filled, count(*) AS cells FROM ({_ALL}) GROUP BY sheet",
    "sheet_text": f"""SELECT sheet, md5(string_agg(line, chr(10) ORDER BY row) || chr(10)) AS digest FROM (SELECT sheet, row, string_agg(value, chr(9) ORDER BY col) AS line FROM ({_ALL})
        WHERE value <> '' GROUP BY sheet, row) GROUP BY sheet""",
    "chunk_dump": f"""SELECT row // 50 AS chunk, md5(string_agg(line || chr(10), '' ORDER BY row)) AS digest FROM (SELECT row, coalesce(string_agg(value || chr(9), '' ORDER BY col) FILTER (value <> ''), '') AS line
        FROM ({_PART}) GROUP BY row) GROUP BY chunk""",
    "cell_types": f"""SELECT CASE WHEN value = '' THEN 'empty' WHEN starts_with(value, '=') THEN 'formula' WHEN regexp_matches(value, '{_NUM}') OR lower(value) IN ('inf', '-inf', '+inf', 'infinity', 'nan') THEN 'number'
        WHEN value IN ('true', 'false') THEN 'boolean' ELSE 'text' END AS kind, count(*) AS n FROM (SELECT value FROM ({_ALL}) UNION ALL SELECT unnest([{', '.join("'" + e + "'" for e in EDGES)}])) GROUP BY kind""",
    "shown_numbers": f"""SELECT row, col, CASE WHEN v = floor(v) THEN v::BIGINT::VARCHAR ELSE v::VARCHAR END AS shown FROM (SELECT row, col, value::DOUBLE AS v FROM ({_PART}) WHERE col IN (4, 5))""",
    "chunk_plan": _CHUNKS,
    "chunk_progress": f"""SELECT chunk, rows, processed, total, round(100.0::DOUBLE * processed / total, 4) AS percentage, round((100.0::DOUBLE - round(100.0::DOUBLE * processed / total, 4)) * (processed / 1000.0::DOUBLE)
        / round(100.0::DOUBLE * processed / total, 4), 6) AS eta FROM (SELECT chunk, rows, (sum(rows) OVER (ORDER BY chunk))::BIGINT AS processed, (sum(rows) OVER ())::BIGINT AS total FROM ({_CHUNKS}))""",
    "each_chunk": "SELECT l_returnflag, count(*) AS rows, sum(l_quantity) AS quantity FROM lineitem GROUP BY l_returnflag",
    "memory_plan": "SELECT DISTINCT pdf_id, floor(file_size * 2.5::DOUBLE / 1048576)::BIGINT AS memory_mb, floor(file_size * 2.5::DOUBLE / 1048576) > 1 AS streaming FROM pdf_documents",
    "col_to_index": f"SELECT i AS idx, {_LETTERS} AS letters, i AS back FROM (SELECT range AS i FROM range(18278))",
    "a1_parse": f"""SELECT ref, CASE WHEN ok THEN nullif(sheet, '') END AS sheet, CASE WHEN ok THEN {_INDEX.format('c1')} END AS col, CASE WHEN ok THEN r1::BIGINT - 1 END AS row,
        CASE WHEN ok AND c2 <> '' THEN {_INDEX.format('c2')} END AS end_col, CASE WHEN ok AND c2 <> '' THEN r2::BIGINT - 1 END AS end_row, CASE WHEN ok THEN ref END AS again FROM (SELECT *, r1 <> '' AND coalesce(try_cast(r1 AS BIGINT), 0) > 0
        AND (r2 = '' OR coalesce(try_cast(r2 AS BIGINT), 0) > 0) AS ok FROM (SELECT ref, regexp_extract(ref, '{_REF}', 1) AS sheet, regexp_extract(ref, '{_REF}', 2) AS c1, regexp_extract(ref, '{_REF}', 3) AS r1,
        regexp_extract(ref, '{_REF}', 4) AS c2, regexp_extract(ref, '{_REF}', 5) AS r2 FROM (SELECT unnest([{', '.join("'" + r + "'" for r in REFS)}]) AS ref)))""",
    "range_expand": "SELECT r.range AS row, c.range AS col FROM range(1, 40) r, range(1, 5) c",
    "formulas": f"""SELECT round({_OF_ALL.format('sum(p_retailprice)')}, 4) AS total, round({_OF_ALL.format('avg(p_size)')}, 4) AS mean, {_OF_ALL.format('count(*) * 3.0::DOUBLE')} AS cells,
        {_OF_ALL.format('min(p_size)')}::DOUBLE AS low, round({_OF_ALL.format('max(p_retailprice)')}, 4) AS high,
        round((SELECT sum(p_retailprice) FROM (SELECT * FROM part ORDER BY p_partkey LIMIT 200)), 4) AS few,
        round({_FIRST.format('p_retailprice', 0)} + {_FIRST.format('p_retailprice', 1)} * 2 - {_FIRST.format('p_size', 0)} / 4.0::DOUBLE, 4) AS sum2,
        CASE WHEN {_FIRST.format('p_retailprice', 0)} > {_FIRST.format('p_retailprice', 1)} THEN 'first' ELSE 'second' END AS choice,
        round(round({_OF_ALL.format('avg(p_size)')}, 3) + 2, 4) AS nested, 1.0::DOUBLE AS missing, NULL::DOUBLE AS zero, 1.0::DOUBLE AS text""",
    "sheet_formulas": """WITH p AS (SELECT row_number() OVER (ORDER BY p_partkey) AS n, * FROM part), s AS (SELECT row_number() OVER (ORDER BY s_suppkey) AS n, * FROM supplier)
        SELECT 'book' AS workbook, n - 1 AS row, 6::BIGINT AS col, '=F' || n || '*2+E' || n AS formula, round(p_retailprice * 2 + p_size, 4) AS num, false AS failed FROM p
        UNION ALL SELECT 'suppliers', n - 1, 6, '=IF(D' || n || '>0,D' || n || '-A' || n || ',-1)', round(CASE WHEN s_acctbal > 0 THEN s_acctbal - s_suppkey ELSE -1 END, 4), false FROM s
        UNION ALL SELECT 'book', 0, 7, '=SUM(F:F)', (SELECT round(sum(p_retailprice), 4) FROM p), false UNION ALL SELECT 'book', 1, 7, '=G1+1', 1.0, false
        UNION ALL SELECT 'suppliers', 0, 7, '=MAX(D:D)+COUNT(A1:B2)', (SELECT round(max(s_acctbal) + 4, 4) FROM s), false UNION ALL SELECT 'suppliers', 1, 7, '=1/Z9', NULL, true""",
    "formula_arith": """SELECT l_returnflag, round(sum(l_extendedprice * (1.0::DOUBLE - l_discount)), 2) AS revenue, round(sum(l_extendedprice * (1.0::DOUBLE - l_discount) * (1.0::DOUBLE + l_tax)), 2) AS charge
        FROM lineitem GROUP BY l_returnflag""",
    "formula_refs": f"""SELECT f.formula, f.row, f.col, coalesce(CASE WHEN regexp_matches(value, '{_NUM}') THEN try_cast(value AS DOUBLE) END, 0.0) AS num FROM (VALUES ('sum2', 0, 5), ('sum2', 1, 5), ('sum2', 0, 4),
        ('choice', 0, 5), ('choice', 1, 5), ('missing', 98, 701), ('zero', 899999, 0), ('text', 0, 1)) f(formula, row, col) LEFT JOIN ({_PART}) p ON p.row = f.row AND p.col = f.col""",
    "validate_cells": f"""WITH c AS (SELECT * FROM ({_PART})) SELECT rule, message, count(*) AS n, min(row) AS first_row FROM (
        SELECT 'List' AS rule, 'brand' AS message, row FROM c WHERE col = 2 AND value <> '' AND value NOT IN ('Brand#11', 'Brand#12', 'Brand#21', 'Brand#33')
        UNION ALL SELECT 'WholeNumber', 'size', row FROM c WHERE col = 4 AND NOT regexp_matches(value, '^[+-]?[0-9]+$') UNION ALL SELECT 'WholeNumber', 'price', row FROM c WHERE col = 5 AND NOT regexp_matches(value, '^[+-]?[0-9]+$')
        UNION ALL SELECT 'Decimal', '', row FROM c WHERE col = 5 AND NOT regexp_matches(value, '{_NUM}') UNION ALL SELECT 'Custom', 'even', row FROM c WHERE col = 4 AND (value = '' OR try_cast(value AS INT) % 2 <> 0)) GROUP BY rule, message""",
    "chart_series": f"""SELECT 'price' AS series, v.row AS ordinal, k.value AS category, v.value::DOUBLE AS value FROM ({_PART}) v JOIN ({_PART}) k ON v.row = k.row AND k.col = 2 WHERE v.col = 5""",
    "chart_column": _DRAWN.format("column", "0.0::DOUBLE", "value"),
    "chart_stacked": _DRAWN.format("column", _PILE, "value"),
    "chart_percent": _DRAWN.format("bar", f"{_PILE} / sum(value) OVER (PARTITION BY category)", "value / sum(value) OVER (PARTITION BY category)"),
    "chart_pie": _DRAWN.format("pie", "0.0::DOUBLE", "value / sum(value) OVER (PARTITION BY series)"),
    "chart_scatter": _DRAWN.format("scatter", "0.0::DOUBLE", "value"),
}
