"""Markdown to sections and elements: a small subset of CommonMark.

Front matter between ``---`` lines gives string fields.  Headings of level 1 and 2 open sections; the title is the front
matter's, else the first heading of level 1.  Lines of a paragraph are joined by spaces.  Nested lists are flattened
with their depth.  Null and empty texts have no elements.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ITEM = re.compile(r"^(\s*)([-*+]|\d{1,9}[.)])\s+(.*)$")
_HEADING = re.compile(r"^ {0,3}(#{1,6})\s+(.*?)(?:\s+#+)?\s*$")
_RULE = re.compile(r"^ {0,3}([-*_])(?:\s*\1){2,}\s*$")
_FENCE = re.compile(r"^ {0,3}(```+|~~~+)\s*([^`]*)$")


def front_matter(text: str) -> tuple[dict[str, str], str]:
    m = re.match(r"^---\n(.*?)\n---\n", text, re.S)
    if not m:
        return {}, text
    fields = {}
    for line in m[1].split("\n"):
        key, colon, value = line.partition(":")
        value = value.strip().strip("'\"")
        if colon and key.strip() and not key.startswith((" ", "-")) and value and not re.fullmatch(r"[-+]?\d+(\.\d+)?|true|false|null|\[.*\]|\{.*\}", value):
            fields[key.strip()] = value
    return fields, text[m.end() :]


def parse(text: str) -> tuple[dict[str, str], str | None, list[tuple[int, int, str, int | None, str]]]:
    """(front matter, title, elements as (section, seq, kind, level, content))."""
    fields, body = front_matter(text)
    out: list[tuple[int, int, str, int | None, str]] = []
    section, title = 0, fields.get("title")
    para: list[str] = []
    lines = body.split("\n")

    def add(kind: str, level: int | None, content: str) -> None:
        out.append((section, len(out), kind, level, content))

    def close() -> None:
        if para:
            add("paragraph", None, " ".join(para))
            para.clear()

    k = 0
    while k < len(lines):
        line = lines[k]
        k += 1
        if m := _FENCE.match(line):
            close()
            block = []
            while k < len(lines) and not lines[k].strip().startswith(m[1][:3]):
                block.append(lines[k])
                k += 1
            k += 1
            add("code", None, "\n".join(block))
        elif m := _HEADING.match(line):
            close()
            level = len(m[1])
            if level <= 2 and out:
                section += 1
            if title is None and level == 1:
                title = m[2]
            add("heading", level, m[2])
        elif _RULE.match(line):
            close()
            add("rule", None, "")
        elif m := _ITEM.match(line):
            close()
            add("ordered_item" if m[2][0].isdigit() else "list_item", len(m[1]) // 2, m[3].strip())
        elif line.startswith(">"):
            close()
            add("quote", None, line.lstrip("> ").strip())
        elif line.strip().startswith("|") and line.strip().endswith("|"):
            close()
            if not re.fullmatch(r"[|\s:-]+", line):
                add("table_row", None, "\t".join(c.strip() for c in line.strip().strip("|").split("|")))
        elif not line.strip():
            close()
        else:
            para.append(line.strip())
    close()
    return fields, title, out


def elements(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, title, section, seq, kind, level, content)."""
    source = df.select(key, text).where(F.col(text).isNotNull())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, places = [], []
            for k, t in enumerate(batch.column(1).to_pylist()):
                _, title, parts = parse(t)
                rows += [(title, *p) for p in parts]
                places += [k] * len(parts)
            cols = list(zip(*rows)) or [()] * 6
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(places, pa.int64())), *[pa.array(list(c), t) for c, t in zip(cols, kinds)]],
                names=[key, "title", "section", "seq", "kind", "level", "content"],
            )

    return source.mapInArrow(work, f"{key} {dict(df.dtypes)[key]}, title string, section int, seq int, kind string, level int, content string")


# Spans within a line, in the order in which they are taken out of it: kind, pattern, whether its second group is an address.
INLINE = (
    ("inline_code", r"`([^`\n]+)`", False), ("image", r"!\[([^\]\n]*)\]\(([^)\s]*)\)", True), ("link", r"\[([^\]\n]+)\]\(([^)\s]*)\)", True),
    ("bold", r"\*\*([^*\n]+)\*\*", False), ("italic", r"\*([^*\s][^*\n]*)\*", False), ("strikethrough", r"~~([^~\n]+)~~", False), ("line_break", r"( {2})\n", False),
)


def _span(kind: str):
    return lambda x: F.struct(F.lit(kind).alias("kind"), x["a"].alias("text"), x["b"].alias("url"))


def inlines(text: Column) -> Column:
    """The spans of a text as an array of (kind, text, url): code, images, links, bold, italic, strikethrough and line breaks.
    A span is taken out before the next kind is looked for, so nothing within code or an image counts.  All in the JVM."""
    left, parts = F.coalesce(text, F.lit("")), []
    for kind, pattern, address in INLINE:
        said = F.regexp_extract_all(left, F.lit(pattern), F.lit(1))
        at = F.regexp_extract_all(left, F.lit(pattern), F.lit(2)) if address else F.transform(said, lambda _: F.lit(None).cast("string"))
        parts.append(F.transform(F.arrays_zip(said.alias("a"), at.alias("b")), _span(kind)))
        left = F.regexp_replace(left, pattern, " ")
    return F.concat(*parts)


def counts(parsed: DataFrame, key: str) -> DataFrame:
    return parsed.groupBy(key).agg(F.countDistinct("section").alias("sections"), F.count(F.lit(1)).alias("elements"))
