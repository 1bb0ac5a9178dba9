"""Cell references in A1 notation, as column expressions and as plain values.

Rows and columns count from 0.  A text that is no reference, and row 0, give null.  Whole columns (C:C, S!A:B) are read by
:func:`parse` only; they end where the sheet ends, however many rows that are.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

REFERENCE = r"^(?:([A-Za-z0-9_]+)!)?([A-Z]{1,3})([0-9]{1,7})(?::([A-Z]{1,3})([0-9]{1,7}))?$"
COLUMNS = r"^(?:([A-Za-z0-9_]+)!)?([A-Z]{1,3}):([A-Z]{1,3})$"
# The last row of whole columns, beyond any sheet.
OPEN = (1 << 62) - 1


@dataclass(frozen=True)
class Range:
    sheet: str | None
    col: int
    row: int
    end_col: int
    end_row: int

    @property
    def whole(self) -> bool:
        return self.end_row == OPEN

    @property
    def cells(self) -> int:
        """How many cells the rectangle has; that of whole columns is known only from their sheet."""
        if self.whole:
            raise ValueError("whole columns have no fixed size")
        return (self.end_row - self.row + 1) * (self.end_col - self.col + 1)


def letters_to_index(letters: str) -> int:
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return n - 1


def index_to_letters(index: int) -> str:
    out = ""
    n = index + 1
    while n > 0:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def parse(text: str) -> Range:
    if m := re.match(COLUMNS, text):
        c1, c2 = letters_to_index(m[2]), letters_to_index(m[3])
        return Range(m[1], min(c1, c2), 0, max(c1, c2), OPEN)
    m = re.match(REFERENCE, text)
    if not m or int(m[3]) < 1 or (m[5] and int(m[5]) < 1):
        raise ValueError(f"no cell reference: {text!r}")
    c1, r1 = letters_to_index(m[2]), int(m[3]) - 1
    c2, r2 = (letters_to_index(m[4]), int(m[5]) - 1) if m[4] else (c1, r1)
    return Range(m[1], min(c1, c2), min(r1, r2), max(c1, c2), max(r1, r2))


def column_index(letters: Column) -> Column:
    """Capital letters to the number of the column: A is 0, AA is 26; null for anything else."""
    value = F.aggregate(F.split(letters, ""), F.lit(0).cast("long"), lambda n, c: F.when(c == "", n).otherwise(n * 26 + F.ascii(c) - 64))
    return F.when(letters.rlike("^[A-Z]{1,6}$"), value - 1)


def column_letters(index: Column) -> Column:
    """The inverse, up to three letters."""
    letter = lambda n: F.chr((65 + n).cast("long"))
    i = index.cast("long")
    two = i - 26
    three = i - 702
    return (
        F.when(i < 0, None).when(i < 26, letter(i)).when(i < 702, F.concat(letter(F.floor(two / 26)), letter(two % 26)))
        .when(i < 18278, F.concat(letter(F.floor(three / 676)), letter(F.floor(three / 26) % 26), letter(three % 26)))
    )


def reference(text: Column) -> Column:
    """struct(sheet, col, row, end_col, end_row); the end is null for a single cell, all is null for no reference."""
    g = lambda k: F.regexp_extract(text, REFERENCE, k)
    row = lambda k: F.when(g(k) != "", g(k).cast("long") - 1)
    got = F.struct(
        F.when(g(1) != "", g(1)).alias("sheet"), column_index(g(2)).alias("col"), row(3).alias("row"), column_index(g(4)).alias("end_col"), row(5).alias("end_row")
    )
    ok = text.rlike(REFERENCE) & (row(3) >= 0) & F.coalesce(row(5) >= 0, F.lit(True))
    return F.when(ok, got)


def format_reference(ref: Column) -> Column:
    one = lambda c, r: F.concat(column_letters(c), (r + 1).cast("string"))
    first = one(ref["col"], ref["row"])
    both = F.when(ref["end_col"].isNotNull(), F.concat(first, F.lit(":"), one(ref["end_col"], ref["end_row"]))).otherwise(first)
    return F.when(ref["sheet"].isNotNull(), F.concat(ref["sheet"], F.lit("!"), both)).otherwise(both)


def split_sheet(text: Column) -> Column:
    """struct(sheet, range): cut at the first exclamation mark."""
    at = F.instr(text, "!")
    return F.struct(
        F.when(at > 0, F.substring(text, F.lit(1), at - 1)).alias("sheet"),
        F.when(at > 0, F.substring(text, at + 1, F.length(text))).otherwise(text).alias("range"),
    )
