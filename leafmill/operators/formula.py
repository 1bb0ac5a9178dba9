"""Formulas of cells, translated on the driver to column expressions and aggregates.

Supported: numbers, texts in quotes, TRUE and FALSE, cell references (with a sheet), + - * / ^ & and comparisons, and
SUM, AVERAGE, COUNT, MIN, MAX, PRODUCT, IF, AND, OR, NOT, ABS, ROUND, LEN, UPPER, LOWER, CONCAT over ranges and values.
Missing and non-numeric cells count as 0.0 in arithmetic.  COUNT counts the rectangle and AVERAGE divides by it; with
``excel_semantics`` both look at numbers only.  The rectangle of whole columns (F:F) ends at their last cell.  Division by zero and what cannot be parsed are errors, given as values.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.refs import OPEN, Range, parse
from leafmill.operators.cells import number
from leafmill.session import materialise

_TOKEN = re.compile(
    r"\s*(?:(?P<num>\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+)|(?P<str>\"(?:[^\"]|\"\")*\")|(?P<ref>(?:[A-Za-z0-9_]+!)?(?:[A-Z]{1,3}\d+(?::[A-Z]{1,3}\d+)?|[A-Z]{1,3}:[A-Z]{1,3}))(?![A-Za-z0-9_(])"
    r"|(?P<name>[A-Za-z][A-Za-z0-9.]*)|(?P<op><=|>=|<>|[-+*/^&=<>(),;]))"
)


class FormulaError(ValueError):
    pass


@dataclass(frozen=True)
class Node:
    kind: str
    value: object = None
    args: tuple = ()


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        if text[at:].isspace():
            break
        m = _TOKEN.match(text, at)
        if not m:
            raise FormulaError(f"cannot read {text[at:]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


def references(formula: str) -> list[Range]:
    """The references in the order in which they stand."""
    return [parse(v) for k, v in tokens(formula.removeprefix("=")) if k == "ref"]


class _Parser:
    _LEVELS = (("=", "<>", "<", ">", "<=", ">="), ("&",), ("+", "-"), ("*", "/"))

    def __init__(self, text: str):
        self.tokens, self.at = tokens(text.removeprefix("=")), 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self) -> tuple[str, str]:
        got = self.peek()
        self.at += 1
        return got

    def whole(self) -> Node:
        got = self.level(0)
        if self.peek()[0] != "end":
            raise FormulaError(f"unexpected {self.peek()[1]!r}")
        return got

    def level(self, k: int) -> Node:
        if k == len(self._LEVELS):
            return self.power()
        left = self.level(k + 1)
        while self.peek()[0] == "op" and self.peek()[1] in self._LEVELS[k]:
            op = self.take()[1]
            left = Node("op", op, (left, self.level(k + 1)))
        return left

    def power(self) -> Node:
        left = self.unary()
        if self.peek() == ("op", "^"):
            self.take()
            return Node("op", "^", (left, self.power()))
        return left

    def unary(self) -> Node:
        if self.peek() in (("op", "-"), ("op", "+")):
            op = self.take()[1]
            return Node("neg", None, (self.unary(),)) if op == "-" else self.unary()
        return self.atom()

    def atom(self) -> Node:
        kind, text = self.take()
        if kind == "num":
            return Node("num", float(text))
        if kind == "str":
            return Node("str", text[1:-1].replace('""', '"'))
        if kind == "ref":
            box = parse(text)
            return Node("range" if ":" in text else "cell", box)
        if kind == "name":
            if text.upper() in ("TRUE", "FALSE") and self.peek() != ("op", "("):
                return Node("bool", text.upper() == "TRUE")
            if self.take() != ("op", "("):
                raise FormulaError(f"unknown name {text!r}")
            args = []
            if self.peek() != ("op", ")"):
                args.append(self.level(0))
                while self.peek() in (("op", ","), ("op", ";")):
                    self.take()
                    args.append(self.level(0))
            if self.take() != ("op", ")"):
                raise FormulaError("missing )")
            return Node("call", text.upper(), tuple(args))
        if (kind, text) == ("op", "("):
            got = self.level(0)
            if self.take() != ("op", ")"):
                raise FormulaError("missing )")
            return got
        raise FormulaError(f"unexpected {text!r}" if text else "formula ends early")


def parse_formula(text: str) -> Node:
    return _Parser(text).whole()


#: Functions added by users: name to (function of columns, function of values).
REGISTERED: dict[str, tuple[Callable[..., Column], Callable[..., object]]] = {}


def register(name: str, columns: Callable[..., Column], values: Callable[..., object]) -> None:
    """Add a function of values to formulas, as columns for :func:`evaluate` and as plain values for :func:`sheet_formulas`."""
    REGISTERED[name.upper()] = (columns, values)


AGGREGATES = ("SUM", "AVERAGE", "COUNT", "MIN", "MAX", "PRODUCT")


def _inside(box: Range, default: str | None) -> Column:
    got = F.col("row").between(box.row, box.end_row) & F.col("col").between(box.col, box.end_col)
    sheet = box.sheet or default
    return got & (F.col("sheet") == sheet) if sheet else got


def _size(box: Range, default: str | None) -> Column:
    """How many cells the rectangle has; whole columns end at the last row that has a cell in them."""
    if not box.whole:
        return F.lit(float(box.cells))
    rows = F.max(F.when(_inside(box, default), F.col("row"))) + 1
    return F.coalesce(rows, F.lit(0)).cast("double") * F.lit(float(box.end_col - box.col + 1))


def aggregate_over(name: str, box: Range, sheet: str | None = None, excel_semantics: bool = False) -> Column:
    """An aggregate over the cells table for a function of one range; conditional, so that many share one scan."""
    inside = _inside(box, sheet)
    value = F.when(inside, number(F.col("value")))
    total = F.coalesce(F.sum(value), F.lit(0.0))
    if name == "SUM":
        return total
    if name == "COUNT":
        return F.count(value).cast("double") if excel_semantics else _size(box, sheet)
    if name == "AVERAGE":
        return F.try_divide(total, F.count(value)) if excel_semantics else F.try_divide(total, _size(box, sheet))
    if name == "PRODUCT":
        return F.product(F.coalesce(value, F.lit(1.0)))
    return F.min(value) if name == "MIN" else F.max(value)


def evaluate(cells: DataFrame, formulas: dict[str, str], sheet: str | None = None, excel_semantics: bool = False) -> DataFrame:
    """One row a workbook with a column for each formula, and for each an ``error_…`` text where it cannot be read.

    All cells and ranges that the formulas mention are picked by conditional aggregates in one pass over the cells,
    workbook by workbook; the arithmetic follows on the single row.  `sheet` is meant where a reference names none; without
    it all sheets of the workbook are.  These are given formulas over many workbooks; for those that stand in cells see
    :func:`sheet_formulas`.
    """
    picks: dict[str, Column] = {}
    results: dict[str, Column] = {}
    errors: dict[str, str] = {}

    def pick(expr: Column, box: Range) -> Column:
        name = f"_p{len(picks)}"
        picks[name] = expr
        return F.col(name)

    def size(nodes: tuple) -> Column:
        """The cells of several ranges and values together."""
        n = F.lit(float(sum(1 if x.kind != "range" else 0 if x.value.whole else x.value.cells for x in nodes)))
        for x in nodes:
            if x.kind == "range" and x.value.whole:
                n = n + pick(_size(x.value, sheet), x.value)
        return n

    def cell(box: Range) -> Column:
        return F.coalesce(pick(F.max(F.when(_inside(box, sheet), number(F.col("value")))), box), F.lit(0.0))

    def build(node: Node) -> Column:
        if node.kind in ("num", "str", "bool"):
            return F.lit(node.value)
        if node.kind == "cell":
            return cell(node.value)
        if node.kind == "neg":
            return -build(node.args[0])
        if node.kind == "range":
            raise FormulaError("a range needs a function")
        if node.kind == "op":
            a, b = (build(x) for x in node.args)
            op = node.value
            if op == "/":
                return F.try_divide(a.cast("double"), b.cast("double"))
            if op == "^":
                return F.pow(a, b)
            if op == "&":
                return F.concat(a.cast("string"), b.cast("string"))
            return {"+": a + b, "-": a - b, "*": a * b}[op] if op in "+-*" else {"=": a == b, "<>": a != b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[op]
        name, args = node.value, node.args
        if name in AGGREGATES:
            parts = [pick(aggregate_over(name, x.value, sheet, excel_semantics), x.value) if x.kind == "range" else build(x) for x in args]
            if not parts:
                raise FormulaError(f"{name} needs arguments")
            if len(parts) == 1:
                return parts[0] if args[0].kind == "range" or name != "COUNT" else F.lit(1.0)
            total = parts[0]
            for p in parts[1:]:
                total = total * p if name == "PRODUCT" else total + p
            if name in ("MIN", "MAX"):
                return F.least(*parts) if name == "MIN" else F.greatest(*parts)
            if name == "COUNT":
                return size(args)
            if name == "AVERAGE":
                sums = [pick(aggregate_over("SUM", x.value, sheet), x.value) if x.kind == "range" else build(x) for x in args]
                whole = sums[0]
                for s in sums[1:]:
                    whole = whole + s
                return F.try_divide(whole, size(args))
            return total
        values = [build(x) for x in args]
        if name == "IF" and len(values) == 3:
            # A condition that is no boolean counts as false.
            boolean = args[0].kind == "bool" or args[0].kind == "op" and args[0].value in ("=", "<>", "<", ">", "<=", ">=") or args[0].kind == "call" and args[0].value in ("AND", "OR", "NOT")
            return F.when(values[0], values[1]).otherwise(values[2]) if boolean else values[2]
        if name in ("AND", "OR") and values:
            whole = values[0]
            for v in values[1:]:
                whole = whole & v if name == "AND" else whole | v
            return whole
        simple = {"NOT": lambda v: ~v, "ABS": F.abs, "LEN": F.length, "UPPER": F.upper, "LOWER": F.lower}
        if name in simple and len(values) == 1:
            return simple[name](values[0])
        if name == "ROUND" and len(args) == 2 and args[1].kind == "num":
            return F.round(values[0], int(args[1].value))
        if name in ("CONCAT", "CONCATENATE"):
            return F.concat(*[v.cast("string") for v in values])
        if name in REGISTERED:
            return REGISTERED[name][0](*values)
        raise FormulaError(f"unknown function {name}/{len(values)}")

    for name, text in formulas.items():
        try:
            results[name] = build(parse_formula(text))
        except (FormulaError, ValueError) as e:
            results[name], errors[name] = F.lit(None).cast("double"), f"#ERROR: {e}"
    got = cells.groupBy("workbook").agg(F.count(F.lit(1)).alias("_n"), *[c.alias(k) for k, c in picks.items()])
    return got.select("workbook", *[c.alias(k) for k, c in results.items()], *[F.lit(e).alias(f"error_{k}") for k, e in errors.items()])


def _plain(v: object) -> str:
    """A value as a cell shows it."""
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, (int, float)):
        return str(int(v)) if v == math.floor(v) and abs(v) < 1e15 else repr(float(v))
    return str(v)


def value_of(node: Node, picked: dict[tuple, tuple], functions: dict[str, Callable[..., object]], excel_semantics: bool = False) -> object:
    """The value of a parsed formula, given (total, numbers, low, high, product, cells) of each rectangle it mentions."""
    again = lambda x: value_of(x, picked, functions, excel_semantics)
    if node.kind in ("num", "str", "bool"):
        return node.value
    if node.kind == "cell":
        return picked[_box(node.value)][0]
    if node.kind == "neg":
        return -again(node.args[0])
    if node.kind == "range":
        raise FormulaError("a range needs a function")
    if node.kind == "op":
        a, b, op = again(node.args[0]), again(node.args[1]), node.value
        if op == "&":
            return _plain(a) + _plain(b)
        if op in ("=", "<>"):
            return (a == b) == (op == "=")
        if isinstance(a, str) != isinstance(b, str):
            raise FormulaError(f"{op} between text and number")
        if op in ("<", ">", "<=", ">="):
            return {"<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[op]
        if isinstance(a, str):
            raise FormulaError(f"{op} of texts")
        if op == "/" and b == 0:
            raise FormulaError("division by zero")
        return a + b if op == "+" else a - b if op == "-" else a * b if op == "*" else a / b if op == "/" else a**b
    name, args = node.value, node.args
    if name in AGGREGATES:
        if not args:
            raise FormulaError(f"{name} needs arguments")
        parts = [picked[_box(x.value)] if x.kind == "range" else (lambda v: (v, 1, v, v, v, 1))(float(again(x))) for x in args]
        size = sum(p[1] if excel_semantics else p[5] for p in parts)
        if name == "COUNT":
            return float(size)
        if name == "AVERAGE" and not size:
            raise FormulaError("division by zero")
        if name in ("SUM", "AVERAGE"):
            return sum(p[0] for p in parts) / (size if name == "AVERAGE" else 1)
        if name == "PRODUCT":
            return math.prod(p[4] for p in parts)
        known = [p[2 if name == "MIN" else 3] for p in parts if p[2] is not None]
        return (min if name == "MIN" else max)(known) if known else 0.0
    values = [again(x) for x in args]
    if name == "IF" and len(values) == 3:
        return values[1] if values[0] is True else values[2]  # a condition that is no boolean counts as false
    if name in ("AND", "OR") and values:
        return (all if name == "AND" else any)(v is True for v in values)
    simple = {"NOT": lambda v: v is not True, "ABS": abs, "LEN": lambda v: len(_plain(v)), "UPPER": lambda v: _plain(v).upper(), "LOWER": lambda v: _plain(v).lower()}
    if name in simple and len(values) == 1:
        return simple[name](values[0])
    if name == "ROUND" and len(values) == 2:
        scale = 10 ** int(values[1])
        return math.copysign(math.floor(abs(values[0]) * scale + 0.5) / scale, values[0])
    if name in ("CONCAT", "CONCATENATE"):
        return "".join(map(_plain, values))
    if name in functions:
        return functions[name](*values)
    raise FormulaError(f"unknown function {name}/{len(values)}")


def _box(box: Range) -> tuple:
    return (box.sheet, box.row, box.end_row, box.col, box.end_col)


def _boxes(node: Node) -> set[tuple]:
    here = {_box(node.value)} if node.kind in ("cell", "range") else set()
    return here.union(*(_boxes(x) for x in node.args))


_CELL = ["workbook", "sheet", "row", "col"]


def sheet_formulas(cells: DataFrame, excel_semantics: bool = False) -> DataFrame:
    """(workbook, sheet, row, col, formula, result) of every cell that holds a formula, for any number of workbooks.

    Formulas see the literal cells of their own workbook, and of their own sheet unless a reference names another; a cell
    that is missing, no number or itself a formula counts as 0.0.  What cannot be read or computed has a result that begins
    with ``#ERROR``.  Formulas are parsed in Arrow batches; each rectangle that a sheet's formulas mention is computed once,
    by joins on workbook, sheet and column, single cells by their row as well; then each formula gets its own values.
    """
    made = cells.where("value like '=%'").select(*_CELL, F.col("value").alias("formula"))
    functions = {k: v[1] for k, v in REGISTERED.items()}

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for book, sheet, row, col, text in batch[[*_CELL, "formula"]].itertuples(index=False):
                try:
                    found = _boxes(parse_formula(text))
                except ValueError:
                    continue  # told when the formula is computed
                rows += [(book, sheet, row, col, b[0], b[0] or sheet, *b[1:]) for b in found]
            yield pd.DataFrame(rows, columns=[*_CELL, "named", "of", "r0", "r1", "c0", "c1"])

    kinds = dict(cells.dtypes)
    asked = made.mapInPandas(ask, f"workbook string, sheet string, row long, col {kinds['col']}, named string, of string, r0 long, r1 long, c0 long, c1 long")
    asked = materialise(asked, "references")
    box = ["workbook", "of", "r0", "r1", "c0", "c1"]
    wanted = asked.select(*box).distinct()
    literal = cells.where("value <> '' and not value like '=%'").select("workbook", F.col("sheet").alias("of"), F.col("row").alias("at"), F.col("col").cast("long").alias("c"), number(F.col("value")).alias("v"))
    single = wanted.where("r0 = r1 and c0 = c1").select(*box, F.col("r0").alias("at"), F.col("c0").alias("c")).join(literal, ["workbook", "of", "at", "c"], "left")
    wide = wanted.where("r0 < r1 or c0 < c1").select(*box, F.explode(F.sequence("c0", "c1")).alias("c"))
    wide = wide.join(literal.withColumnsRenamed({"workbook": "_w", "of": "_o", "c": "_c"}), (F.col("workbook") == F.col("_w")) & (F.col("of") == F.col("_o")) & (F.col("c") == F.col("_c")) & F.col("at").between(F.col("r0"), F.col("r1")), "left")
    both = single.select(*box, "at", "v").unionByName(wide.select(*box, "at", "v"))
    rows_of = F.when(F.col("r1") == OPEN, F.coalesce(F.max("at") + 1, F.lit(0))).otherwise(F.col("r1") - F.col("r0") + 1)
    # min and max of no number are null; the others have their neutral values.
    values = both.groupBy(*box).agg(
        F.coalesce(F.sum("v"), F.lit(0.0)).alias("total"), F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.product(F.coalesce("v", F.lit(1.0))).alias("product"),
        (rows_of * (F.col("c1") - F.col("c0") + 1)).alias("cells"),
    )
    told = asked.join(values, box).groupBy(*_CELL).agg(F.collect_list(F.struct("named", "r0", "r1", "c0", "c1", "total", "n", "low", "high", "product", "cells")).alias("picked"))

    def compute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, picked in zip(batch["formula"], batch["picked"]):
                got = {tuple(x[k] for k in ("named", "r0", "r1", "c0", "c1")): tuple(x[k] for k in ("total", "n", "low", "high", "product", "cells")) for x in ([] if picked is None else picked)}
                try:
                    out.append(_plain(value_of(parse_formula(text), got, functions, excel_semantics)))
                except (ValueError, TypeError, ArithmeticError) as e:
                    out.append(f"#ERROR: {e}")
            yield batch[[*_CELL, "formula"]].assign(result=out)

    joined = made.join(told, _CELL, "left")
    return joined.mapInPandas(compute, f"workbook string, sheet string, row long, col {kinds['col']}, formula string, result string")


def display(value: Column, kind: str) -> Column:
    """A result as text: numbers without .0, TRUE and FALSE in capitals, errors marked."""
    from leafmill.operators.cells import shown

    if kind == "boolean":
        return F.when(value, "TRUE").otherwise("FALSE")
    return shown(value) if kind == "number" else value.cast("string")
