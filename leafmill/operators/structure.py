"""Pages, lines, elements and tables of plain text.

Null texts give no rows.  Empty texts give one empty page and no elements.  White space is trimmed by its Unicode kinds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: White space by Unicode, in a form that Java and RE2 read alike.
SPACE = r"[\t-\r \x{85}\p{Z}]"
#: Letters that are not capitals.
SMALL = r"[\p{Ll}\p{Lt}\p{Lm}\p{Lo}]"
TABLE_MARK = "--- Table"


def trimmed(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, f"^{SPACE}+", ""), f"{SPACE}+$", "")


def pages_at_form_feeds(df: DataFrame, text: str = "text") -> DataFrame:
    """(…, page, page_text): split at form feeds, empty pages kept; pages count from 1."""
    return df.select("*", F.posexplode(F.split(text, "\x0c", -1)).alias("_p", "page_text")).withColumn("page", F.col("_p") + 1).drop("_p")


def pages_evenly(df: DataFrame, pages: Column, text: str = "text", strict: bool = False) -> DataFrame:
    """(…, page, page_text): `pages` pages of equal length; the last takes the rest, or with `strict` the rest is dropped."""
    size = F.floor(F.length(text) / F.col("_n")).cast("int")
    cut = df.withColumn("_n", pages.cast("int")).where("_n > 0").withColumn("_k", size).withColumn("page", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    length = F.col("_k") if strict else F.when(F.col("page") == F.col("_n"), F.length(text)).otherwise(F.col("_k"))
    return cut.withColumn("page_text", F.substring(F.col(text), (F.col("page") - 1) * F.col("_k") + 1, length)).drop("_n", "_k")


def lines(df: DataFrame, text: str = "text") -> DataFrame:
    """(…, pos, line): all lines of `text`, which is dropped."""
    return df.select(*[c for c in df.columns if c != text], F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))


def element_of(line: Column) -> tuple[Column, Column, Column]:
    """(type, level, marker) of a trimmed line that is not blank.  In this order: table mark, heading (fewer than 100
    bytes and no letter but capitals, so also lines without letters), list item, paragraph."""
    marker = F.substring(line, 1, 1)
    kind = (
        F.when(line.startswith(TABLE_MARK), "table")
        .when((F.octet_length(line) < 100) & ~line.rlike(SMALL), "heading")
        .when(F.substring(line, 1, 2).isin("• ", "- ", "* "), "list_item")
        .otherwise("paragraph")
    )
    return kind, F.when(kind == "heading", 2), F.when(kind == "list_item", marker)


def elements(df: DataFrame, text: str = "text") -> DataFrame:
    """(…, pos, content, element_type, level, marker) of the lines that are not blank."""
    trimmed_lines = lines(df, text).withColumn("content", trimmed(F.col("line"))).where("content <> ''").drop("line")
    kind, level, marker = element_of(F.col("content"))
    return trimmed_lines.withColumn("element_type", kind).withColumn("level", level).withColumn("marker", marker)


def pdf_blocks(df: DataFrame, text: str = "text", top: float = 720.0, step: float = 14.0) -> DataFrame:
    """(…, pos, content, block_type, level, y): the other rule set, for text of pages with positions.  Capitals and spaces
    only and short: heading 2; list mark: list item; fewer than 50 bytes: heading 3; else paragraph."""
    got = lines(df, text).withColumn("content", trimmed(F.col("line"))).where("content <> ''").drop("line")
    c = F.col("content")
    kind = (
        F.when(~c.rlike(r"[^\p{Lu} ]") & (F.octet_length(c) < 100), "heading2").when(F.substring(c, 1, 2).isin("• ", "- "), "list_item")
        .when(F.octet_length(c) < 50, "heading3").otherwise("paragraph")
    )
    level = F.when(F.col("block_type") == "heading2", 2).when(F.col("block_type") == "heading3", 3)
    return got.withColumn("block_type", kind).withColumn("level", level).withColumn("y", F.lit(top) - F.lit(step) * F.col("pos"))


def paragraphs(df: DataFrame, text: str = "text") -> DataFrame:
    """(…, pos, content, element_type, level): text between blank lines; a short one with a capital that does not end in a
    full stop is a heading."""
    got = df.select(*[c for c in df.columns if c != text], F.posexplode(F.split(text, "\n\n", -1)).alias("pos", "raw"))
    got = got.withColumn("content", trimmed(F.regexp_replace("raw", "\n", " "))).where("content <> ''").drop("raw")
    c = F.col("content")
    heading = (F.octet_length(c) < 100) & c.rlike(r"\p{Lu}") & ~c.endswith(".")
    return got.withColumn("element_type", F.when(heading, "heading").otherwise("paragraph")).withColumn("level", F.when(heading, 2))


def _row_like(line: Column, tokens: int, gaps: int) -> Column:
    spaces = F.length(line) - F.length(F.regexp_replace(line, SPACE, ""))
    return (spaces >= gaps) & (F.size(_cells(line)) >= tokens)


def _cells(line: Column) -> Column:
    return F.filter(F.split(line, f"{SPACE}+", -1), lambda w: w != "")


def table_rows(df: DataFrame, keys: list[str], text: str = "text", tokens: int = 3, gaps: int = 4, least: int = 2) -> DataFrame:
    """(keys, island, pos, cells): rows of detected tables.  A line is row-like with `tokens` words and `gaps` white-space
    characters; a run of `least` row-like lines is a table.

    Lines without a row-like neighbour are dropped within the document's own row, so only the rows of tables are
    exploded and shuffled; runs are told apart by place minus ordinal.
    """
    got = df.select(*keys, F.split(F.col(text), "\n", -1).alias("_l")).withColumn("_f", F.transform("_l", lambda x: _row_like(x, tokens, gaps)))
    near = lambda i, step: F.coalesce(F.get("_f", i + step), F.lit(False))
    kept = F.filter(
        F.transform("_l", lambda x, i: F.when(F.get("_f", i) & ((least < 2) | near(i, -1) | near(i, 1)), F.struct(i.alias("pos"), x.alias("line")))), lambda x: x.isNotNull()
    )
    rows = got.select(*keys, F.explode(kept).alias("_r")).select(*keys, F.col("_r.pos").alias("pos"), _cells(F.col("_r.line")).alias("cells"))
    rows = rows.withColumn("island", F.col("pos") - F.row_number().over(Window.partitionBy(*keys).orderBy("pos")))
    run = Window.partitionBy(*keys, "island")
    return rows.withColumn("_n", F.count(F.lit(1)).over(run)).where(F.col("_n") >= least).select(*keys, "island", "pos", "cells")


def tables(df: DataFrame, keys: list[str], text: str = "text", width: float = 612.0, **rule: int) -> DataFrame:
    """(keys, table_index, start, rows, cols, confidence, y, width, height, data): detected tables, numbered from 0."""
    got = table_rows(df, keys, text, **rule)
    per = got.groupBy(*keys, "island").agg(
        F.min("pos").alias("start"), F.count(F.lit(1)).alias("rows"), F.max(F.size("cells")).alias("cols"),
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "cells"))), lambda x: x["cells"]).alias("data"),
    )
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("start")) - 1
    return per.withColumn("table_index", number).withColumn("confidence", F.lit(0.8)).withColumn("y", F.lit(400.0) - F.lit(14.0) * F.col("start")).withColumn(
        "width", F.lit(width - 144.0)
    ).withColumn("height", F.lit(14.0) * F.col("rows")).drop("island")


def stats(df: DataFrame, text: str = "text") -> DataFrame:
    """One row: documents, pages, blocks, bytes and megabytes."""
    t = F.col(text)
    solid = F.size(F.filter(F.split(t, "\n", -1), lambda x: x.rlike(f"[^{SPACE[1:-1]}]")))
    return df.where(t.isNotNull()).agg(
        F.count(F.lit(1)).alias("documents"), F.sum(F.size(F.split(t, "\x0c", -1))).alias("pages"), F.sum(solid).alias("blocks"),
        F.sum(F.octet_length(t)).alias("bytes"), F.round(F.sum(F.octet_length(t)) / F.lit(1048576.0), 6).alias("megabytes"),
    )
