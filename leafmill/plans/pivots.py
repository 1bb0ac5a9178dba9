"""Pivot queries: aggregates, cross tables, filters, totals, ways to show values, sorts; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.operators import pivot as p
from leafmill.session import table

SPEC = p.Pivot("lines", "lineitem", "sales", ["l_returnflag"], ["l_linestatus"], [p.DataField("l_quantity", display_name="v")])
PRIORITIES = ["2-HIGH", "1-URGENT", "5-LOW", "3-MEDIUM", "4-NOT SPECIFIED"]
STATUSES = ["F", "O", "P"]


def _aggregate(name: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        column = "l_discount" if name == "Product" else "l_quantity"
        source = table(spark, d, "lineitem")
        if name == "Product":
            # Factors near one, by order, so that the product neither overflows nor vanishes.
            source = source.withColumn("l_discount", F.col("l_discount") + 1)
            spec = p.Pivot("x", row_fields=["l_orderkey"], data_fields=[p.DataField(column, name, "v")])
            return p.grouped(source, spec).select("l_orderkey", F.round("v", 6).alias("v"))
        spec = p.Pivot("x", row_fields=["l_returnflag", "l_linestatus"], data_fields=[p.DataField(column, name, "v")])
        got = p.grouped(source, spec)
        return got.select("l_returnflag", "l_linestatus", F.round("v", 6).alias("v") if name not in ("Count", "CountNumbers") else F.col("v"))

    return query


def pivot_text_values(spark: SparkSession, d: str) -> DataFrame:
    """Count against CountNumbers over text with empty and numeric values."""
    source = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k"))
    spec = p.Pivot("x", row_fields=["event_type"], data_fields=[p.DataField("k", "Count", "n"), p.DataField("k", "CountNumbers", "numbers")])
    return p.grouped(source, spec)


def pivot_cross(spark: SparkSession, d: str) -> DataFrame:
    spec = p.Pivot("x", row_fields=["o_orderpriority"], column_fields=["o_orderstatus"], data_fields=[p.DataField("o_totalprice", "Sum", "v")])
    got = p.crossed(table(spark, d, "orders"), spec, STATUSES)
    return got.select("o_orderpriority", *[F.round(s, 2).alias(f"status_{s}") for s in STATUSES])


def pivot_page_filter(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    spec = p.Pivot("x", row_fields=["o_orderpriority"], data_fields=[p.DataField("o_totalprice", "Average", "v")], page_filters=[p.Filter("c_mktsegment", "Equals", "building")])
    return p.grouped(orders, spec).select("o_orderpriority", F.round("v", 4).alias("v"))


_FILTERS = {
    "Equals": ("c_mktsegment", "building", None, "lower(c_mktsegment) = 'building'"),
    "NotEquals": ("c_mktsegment", "BUILDING", None, "lower(c_mktsegment) <> 'building'"),
    "GreaterThan": ("c_acctbal", 500.0, None, "c_acctbal > 500"),
    "GreaterThanOrEqual": ("c_nationkey", 12, None, "c_nationkey >= 12"),
    "LessThan": ("c_acctbal", 0.0, None, "c_acctbal < 0"),
    "LessThanOrEqual": ("c_nationkey", 3, None, "c_nationkey <= 3"),
    "Between": ("c_acctbal", 100.0, 900.0, "c_acctbal BETWEEN 100 AND 900"),
    "NotBetween": ("c_acctbal", 100.0, 900.0, "c_acctbal NOT BETWEEN 100 AND 900"),
    "Contains": ("c_name", "00009", None, "contains(lower(c_name), '00009')"),
    "NotContains": ("c_name", "1", None, "NOT contains(lower(c_name), '1')"),
    "StartsWith": ("c_mktsegment", "m", None, "starts_with(lower(c_mktsegment), 'm')"),
    "EndsWith": ("c_mktsegment", "LD", None, "ends_with(lower(c_mktsegment), 'ld')"),
}


def _filter(op: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        name, a, b, _ = _FILTERS[op]
        got = p.filtered(table(spark, d, "customer"), [p.Filter(name, op, a, b)])
        return got.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))

    return query


def pivot_manual_filter(spark: SparkSession, d: str) -> DataFrame:
    got = table(spark, d, "orders").where(F.col("o_orderpriority").isin(PRIORITIES[:2]))
    return got.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


def pivot_date_filter(spark: SparkSession, d: str) -> DataFrame:
    got = table(spark, d, "orders").where(F.col("o_orderdate").between(F.lit("1995-01-01").cast("timestamp_ntz"), F.lit("1995-12-31").cast("timestamp_ntz")))
    return got.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def pivot_filter_topn(spark: SparkSession, d: str) -> DataFrame:
    return p.top(table(spark, d, "orders"), ["o_custkey"], "o_totalprice", 25, ["o_custkey"]).select("o_custkey", F.round("total", 2).alias("total"))


def pivot_filter_above_avg(spark: SparkSession, d: str) -> DataFrame:
    return p.above_average(table(spark, d, "orders"), ["o_custkey"], "o_totalprice").select("o_custkey", F.round("total", 2).alias("total"))


def pivot_subtotals(spark: SparkSession, d: str) -> DataFrame:
    # Which side is broadcast is left to Spark, which knows the sizes of the files.
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    spec = p.Pivot("x", row_fields=["r_name", "n_name"], data_fields=[p.DataField("c_acctbal", "Sum", "v"), p.DataField("c_custkey", "Count", "n")])
    return p.with_subtotals(c, spec).select("r_name", "n_name", "total_of", F.round("v", 2).alias("v"), "n")


def pivot_grand_totals(spark: SparkSession, d: str) -> DataFrame:
    return p.with_totals(table(spark, d, "lineitem"), SPEC)


def pivot_sort_custom(spark: SparkSession, d: str) -> DataFrame:
    got = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return got.withColumn("place", p.sort_key(F.col("o_orderpriority"), PRIORITIES).cast("long"))


_DEFINITIONS = [("a", "s1", "A1:D100", ["x"]), ("b", "s1", "A1:D100", ["x", "y"]), ("c", "s2", "F1:G9", [])]


def pivot_metadata(spark: SparkSession, d: str) -> DataFrame:
    return p.metadata(spark.createDataFrame(_DEFINITIONS, "name string, sheet string, source string, row_fields array<string>"))


def pivot_source(spark: SparkSession, d: str) -> DataFrame:
    defs = spark.createDataFrame(_DEFINITIONS, "name string, sheet string, source string, row_fields array<string>")
    return p.uses_source(defs, "A1:D100").select("name", "sheet")


def pivot_json_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """A definition exported, imported and run."""
    again = p.import_definitions(p.export_definitions([SPEC]))[0]
    return p.grouped(table(spark, d, "lineitem"), again)


def _sales(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.groupBy("o_orderpriority", F.year("o_orderdate").alias("year"), "o_orderstatus").agg(F.sum("o_totalprice").alias("v"))


_BASE = {"PercentOf": 1995, "PercentDifferenceFrom": None, "DifferenceFrom": 1995}


def _shown(mode: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        got = p.show_as(_sales(spark, d), "v", mode, ["o_orderpriority", "year"], ["o_orderstatus"], _BASE.get(mode))
        return got.select("o_orderpriority", F.col("year").cast("long").alias("year"), "o_orderstatus", F.round("shown", 6 if mode.startswith("Percent") else 2).alias("shown"))

    return query


def _snake(name: str) -> str:
    return "".join("_" + x.lower() if x.isupper() else x for x in name).lstrip("_")


QUERIES = {f"pivot_{_snake(n)}": _aggregate(n) for n in p.AGGREGATES}
QUERIES |= {f.__name__: f for f in (
    pivot_text_values, pivot_cross, pivot_page_filter, pivot_manual_filter, pivot_date_filter, pivot_filter_topn, pivot_filter_above_avg, pivot_subtotals, pivot_grand_totals, pivot_sort_custom,
    pivot_metadata, pivot_source, pivot_json_roundtrip,
)}
QUERIES |= {f"pivot_filter_{_snake(op)}": _filter(op) for op in p.COMPARISONS}
QUERIES |= {f"show_as_{_snake(m)}": _shown(m) for m in p.SHOW_AS}

_AGG = {
    "Sum": "sum(l_quantity)", "Count": "count(l_quantity)", "Average": "avg(l_quantity)", "Max": "max(l_quantity)", "Min": "min(l_quantity)", "CountNumbers": "count(l_quantity)",
    "StdDev": "stddev_samp(l_quantity)", "StdDevP": "stddev_pop(l_quantity)", "Var": "var_samp(l_quantity)", "VarP": "var_pop(l_quantity)",
}
SQL = {f"pivot_{_snake(n)}": f"SELECT l_returnflag, l_linestatus, {e if n.startswith('Count') else f'round({e}, 6)'} AS v FROM lineitem GROUP BY ALL" for n, e in _AGG.items()}
SQL["pivot_product"] = "SELECT l_orderkey, round(product(l_discount + 1), 6) AS v FROM lineitem GROUP BY l_orderkey"
SQL |= {f"pivot_filter_{_snake(op)}": f"SELECT c_mktsegment, count(*) AS n FROM customer WHERE {w} GROUP BY c_mktsegment" for op, (_, _, _, w) in _FILTERS.items()}
_SALES = "SELECT o_orderpriority AS r, year(o_orderdate)::BIGINT AS y, o_orderstatus AS c, sum(o_totalprice) AS v FROM orders GROUP BY ALL"
_OVER = {
    "Normal": "v", "PercentOfGrandTotal": "v / nullif(sum(v) OVER (), 0)", "PercentOfColumnTotal": "v / nullif(sum(v) OVER (PARTITION BY c), 0)", "PercentOfRowTotal": "v / nullif(sum(v) OVER (PARTITION BY r, y), 0)",
    "PercentOf": "v / nullif(max(CASE WHEN y = 1995 THEN v END) OVER (PARTITION BY r, c), 0)", "PercentDifferenceFrom": "(v - lag(v) OVER (PARTITION BY r, c ORDER BY y)) / nullif(lag(v) OVER (PARTITION BY r, c ORDER BY y), 0)",
    "DifferenceFrom": "v - max(CASE WHEN y = 1995 THEN v END) OVER (PARTITION BY r, c)", "RunningTotalIn": "sum(v) OVER (PARTITION BY r, c ORDER BY y ROWS UNBOUNDED PRECEDING)",
    "PercentOfParentRowTotal": "v / nullif(sum(v) OVER (PARTITION BY r, c), 0)", "PercentOfParentColumnTotal": "v / nullif(sum(v) OVER (PARTITION BY r, y), 0)",
    "PercentOfParentTotal": "v / nullif(sum(v) OVER (PARTITION BY r, c), 0)",
    "Index": "v * sum(v) OVER () / nullif(sum(v) OVER (PARTITION BY r, y) * sum(v) OVER (PARTITION BY c), 0)",
}
SQL |= {f"show_as_{_snake(m)}": f"SELECT r AS o_orderpriority, y AS year, c AS o_orderstatus, round({e}, {6 if m.startswith('Percent') else 2}) AS shown FROM ({_SALES})" for m, e in _OVER.items()}
SQL |= {
    "pivot_text_values": r"""SELECT event_type, count(*) FILTER (k <> '') AS n, count(*) FILTER (regexp_matches(k, '^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$')) AS numbers
        FROM (SELECT event_type, props->>'$.k' AS k FROM events) GROUP BY event_type""",
    "pivot_cross": "SELECT o_orderpriority, " + ", ".join(f"round(sum(o_totalprice) FILTER (o_orderstatus = '{s}'), 2) AS status_{s}" for s in STATUSES) + " FROM orders GROUP BY o_orderpriority",
    "pivot_page_filter": "SELECT o_orderpriority, round(avg(o_totalprice), 4) AS v FROM orders JOIN customer ON o_custkey = c_custkey WHERE lower(c_mktsegment) = 'building' GROUP BY o_orderpriority",
    "pivot_manual_filter": "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderpriority IN ('2-HIGH', '1-URGENT') GROUP BY o_orderpriority",
    "pivot_date_filter": "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1995-12-31' GROUP BY o_orderstatus",
    "pivot_filter_topn": "SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey ORDER BY sum(o_totalprice) DESC, o_custkey LIMIT 25",
    "pivot_filter_above_avg": "WITH s AS (SELECT o_custkey, sum(o_totalprice) AS t FROM orders GROUP BY o_custkey) SELECT o_custkey, round(t, 2) AS total FROM s WHERE t > (SELECT avg(t) FROM s)",
    "pivot_subtotals": """SELECT r_name, n_name, grouping(r_name, n_name) AS total_of, round(sum(c_acctbal), 2) AS v, count(c_custkey) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)""",
    "pivot_grand_totals": "SELECT l_returnflag, l_linestatus, grouping(l_returnflag, l_linestatus) AS total_of, sum(l_quantity) AS v FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "pivot_sort_custom": "SELECT o_orderpriority, count(*) AS n, list_position(['2-HIGH', '1-URGENT', '5-LOW', '3-MEDIUM', '4-NOT SPECIFIED'], o_orderpriority)::BIGINT AS place FROM orders GROUP BY o_orderpriority",
    "pivot_metadata": "SELECT * FROM (VALUES ('s1', 2::BIGINT, 'a,b', 'A1:D100', 300::BIGINT), ('s2', 1, 'c', 'F1:G9', 0)) t(sheet, pivots, names, sources, estimated_rows)",
    "pivot_source": "SELECT * FROM (VALUES ('a', 's1'), ('b', 's1')) t(name, sheet)",
    "pivot_json_roundtrip": "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS v FROM lineitem GROUP BY ALL",
}
