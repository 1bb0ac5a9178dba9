"""Sheets as long tables of cells: workbook, sheet, row, col, value (text).

Null and empty values are empty cells.  A sheet made from a table has a row for each row of the table, numbered in the
order of a key; the number is found without gathering the table in one task, see :func:`numbered`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.refs import Range, parse
from leafmill.session import materialise

# Numbers as a cell has them typed in: no blanks, no type suffixes, no underscores.
NUMBER = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"


#: Rows of one slice where rows are numbered, and rows of one block of a sheet's text.
SLICE_ROWS, BLOCK_ROWS = 2_000_000, 10_000


def slices(df: DataFrame) -> int:
    """How many slices of about SLICE_ROWS rows `df` needs, and as many as the session's shuffles have at least."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // SLICE_ROWS))


def numbered(df: DataFrame, keys: list[str], to: str = "row") -> DataFrame:
    """`df` with the ordinal of each row in the order of `keys`, from 0.

    Rows are sorted by range partitioning and numbered within their slice; the sizes of the slices, one row each, give
    the offsets.  So no task holds more than its slice, where a window without partitions would hold everything.  The
    sorted slices are written once, so that the sizes and the rows speak of the same slices even if a task is run again.
    Ties are ordered by all columns; equal rows are interchangeable.
    """
    order = [F.col(k) for k in keys] + [F.col(c) for c in df.columns if c not in keys and not isinstance(df.schema[c].dataType.jsonValue(), dict)]
    placed = df.repartitionByRange(slices(df), *[F.col(k) for k in keys]).sortWithinPartitions(*order)
    # monotonically_increasing_id holds the slice in its upper bits and the place within it in the lower 33.
    placed = materialise(placed.withColumn("_id", F.monotonically_increasing_id()), "numbered")
    placed = placed.withColumn("_slice", F.shiftright("_id", 33)).withColumn("_at", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = placed.groupBy("_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    # There is one offset a slice.
    return placed.join(F.broadcast(offsets), "_slice").withColumn(to, F.col("_off") + F.col("_at")).drop("_slice", "_id", "_at", "_off")


def from_table(df: DataFrame, columns: list[str], row: Column, sheet: Column, workbook: str = "book") -> DataFrame:
    """The cells of a table: `row` numbers its rows, `columns` are the columns in order.  Columns are unpivoted by one
    explode of an array, so the table is read once."""
    values = F.array(*[F.col(c).cast("string") for c in columns])
    return df.select(F.lit(workbook).alias("workbook"), sheet.alias("sheet"), row.cast("long").alias("row"), F.posexplode(values).alias("col", "value")).withColumn(
        "value", F.coalesce("value", F.lit(""))
    )


def in_range(box: Range) -> Column:
    got = F.col("row").between(box.row, box.end_row) & F.col("col").between(box.col, box.end_col)
    return got & (F.col("sheet") == box.sheet) if box.sheet else got


def read_range(cells: DataFrame, ref: str, max_rows: int | None = None, max_columns: int | None = None) -> DataFrame:
    """The cells of a range in A1 notation; limits count from its corner.  All are predicates that reach the scan."""
    box = parse(ref)
    got = cells.where(in_range(box))
    if max_rows is not None:
        got = got.where(F.col("row") < box.row + max_rows)
    if max_columns is not None:
        got = got.where(F.col("col") < box.col + max_columns)
    return got


def list_sheets(cells: DataFrame) -> DataFrame:
    return cells.groupBy("workbook", "sheet").agg((F.max("row") + 1).alias("row_count"), (F.max("col") + 1).alias("column_count"))


def row_texts(cells: DataFrame, keep_empty: bool = False, closing: bool = False) -> DataFrame:
    """(workbook, sheet, row, line): cells of each row joined by tabs.  Empty cells and rows are left out; with
    `keep_empty` empty rows stay; with `closing` each cell is followed by a tab, as chunk dumps have it."""
    packed = F.array_sort(F.collect_list(F.when(F.col("value") != "", F.struct("col", "value"))))
    texts = cells.groupBy("workbook", "sheet", "row").agg(F.transform(packed, lambda c: c["value"]).alias("cells"))
    line = F.array_join(F.transform("cells", lambda c: F.concat(c, F.lit("\t"))), "") if closing else F.array_join("cells", "\t")
    got = texts.select("workbook", "sheet", "row", line.alias("line"))
    return got if keep_empty else got.where("line <> ''")


def text_blocks(cells: DataFrame) -> DataFrame:
    """(workbook, sheet, block, text): the lines of a sheet in order, each closed by a line feed, BLOCK_ROWS rows a block.  A
    block is the most that one task holds, however long the sheet."""
    rows = F.array_sort(F.collect_list(F.struct("row", "line")))
    lines = row_texts(cells).withColumn("block", F.floor(F.col("row") / BLOCK_ROWS))
    return lines.groupBy("workbook", "sheet", "block").agg(F.concat(F.array_join(F.transform(rows, lambda r: r["line"]), "\n"), F.lit("\n")).alias("text"))


def sheet_texts(cells: DataFrame) -> DataFrame:
    """(workbook, sheet, text): the blocks of a sheet put together.  The text is one value, so a sheet must fit in one, as sheets
    of the file format with its 1,048,576 rows do; `text_blocks` is for longer tables."""
    blocks = F.array_sort(F.collect_list(F.struct("block", "text")))
    return text_blocks(cells).groupBy("workbook", "sheet").agg(F.array_join(F.transform(blocks, lambda b: b["text"]), "").alias("text"))


def search(cells: DataFrame, term: str) -> DataFrame:
    """(workbook, sheet, row, col, value) of the cells that contain `term`, case-sensitively."""
    return cells.where(F.contains("value", F.lit(term)))


def count_filled(cells: DataFrame) -> DataFrame:
    return cells.groupBy("workbook", "sheet").agg(F.count_if(F.col("value") != "").alias("filled"), F.count(F.lit(1)).alias("cells"))


def cell_type(value: Column) -> Column:
    """What a value becomes when written: formula, number, boolean, text, or empty."""
    return (
        F.when(F.coalesce(value, F.lit("")) == "", "empty").when(value.startswith("="), "formula").when(value.rlike(NUMBER) | F.lower(value).isin("inf", "-inf", "+inf", "infinity", "nan"), "number")
        .when(value.isin("true", "false"), "boolean").otherwise("text")
    )


def number(value: Column) -> Column:
    return F.when(value.rlike(NUMBER), value.try_cast("double") if hasattr(value, "try_cast") else value.cast("double"))


def shown(value: Column) -> Column:
    """A number as a cell shows it: without a fraction of .0 and without exponents below 1e15."""
    whole = (value == F.floor(value)) & (F.abs(value) < 1e15)
    return F.when(value.isNull(), "").when(whole, value.cast("long").cast("string")).otherwise(value.cast("string"))


def chunks(df: DataFrame, size: int, row: str = "row") -> DataFrame:
    """`df` with the chunk of each row, its first row and its end (exclusive)."""
    c = F.floor(F.col(row) / size).cast("long")
    return df.withColumn("chunk", c).withColumn("start_row", c * size).withColumn("end_row", (c + 1) * size)


def progress(chunk_rows: DataFrame, elapsed: Column | None = None) -> DataFrame:
    """(chunk, rows) with processed, total, percentage and, with `elapsed` seconds, eta.  Chunks are summed within slices of
    their range, and the sums of the slices, one row each, give what came before; no task holds all chunks."""
    placed = chunk_rows.repartitionByRange(slices(chunk_rows), "chunk").withColumn("_slice", F.spark_partition_id())
    placed = materialise(placed, "progress")
    sizes = placed.groupBy("_slice").agg(F.sum("rows").alias("_n"))
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    run = Window.partitionBy("_slice").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)
    got = placed.join(F.broadcast(offsets), "_slice").withColumn("processed", F.col("_off") + F.sum("rows").over(run))
    got = got.withColumn("total", sizes.agg(F.sum("_n")).scalar()).drop("_slice", "_off")
    got = got.withColumn("percentage", F.round(F.lit(100.0) * F.col("processed") / F.col("total"), 4))
    if elapsed is not None:
        got = got.withColumn("eta", F.when((F.col("percentage") > 0) & (elapsed > 0), (F.lit(100.0) - F.col("percentage")) * elapsed / F.col("percentage")))
    return got
