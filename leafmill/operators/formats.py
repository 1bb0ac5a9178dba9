"""Documents rendered as text, Markdown, HTML and JSON.

Input is one row a document with ``title``, ``author`` and ``elements``: an ordered array of struct(element_type, content,
level, marker).  Everything is higher-order functions over the array, so a document is rendered where it lies.
Null titles and authors are left out; null or empty arrays render as nothing but the head.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.operators.structure import element_of, trimmed
from leafmill.operators.textops import escape_html


def with_elements(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, elements): the elements of each document in order, made within its row; nothing is exploded or shuffled.
    A document without elements has an empty array, a null text a null one."""
    got = df.select(*keys, F.split(F.col(text), "\n", -1).alias("_l"))
    solid = F.filter(F.transform("_l", lambda x, i: F.struct(i.alias("pos"), trimmed(x).alias("content"))), lambda e: e["content"] != "")

    def one(e: Column) -> Column:
        kind, level, marker = element_of(e["content"])
        return F.struct(e["pos"].alias("pos"), kind.alias("element_type"), e["content"].alias("content"), level.alias("level"), marker.alias("marker"))

    return got.withColumn("_s", solid).select(*keys, F.transform("_s", one).alias("elements"))


def as_text(pages: Column) -> Column:
    """Pages that are not blank, each closed by a line feed."""
    return F.array_join(F.transform(F.filter(pages, lambda p: F.trim(p) != ""), lambda p: F.concat(p, F.lit("\n"))), "")


def _level(e: Column) -> Column:
    return F.least(F.greatest(F.coalesce(e["level"], F.lit(1)), F.lit(1)), F.lit(6))


def as_markdown(title: Column, author: Column, parts: Column) -> Column:
    def one(e: Column) -> Column:
        kind = e["element_type"]
        return (
            F.when(kind == "heading", F.concat(F.repeat(F.lit("#"), _level(e)), F.lit(" "), e["content"], F.lit("\n\n")))
            .when(kind == "list_item", F.concat(F.coalesce(e["marker"], F.lit("*")), F.lit(" "), F.regexp_replace(e["content"], "^[•*-] ", ""), F.lit("\n")))
            .otherwise(F.concat(e["content"], F.lit("\n\n")))
        )

    head = F.concat(
        F.when(title.isNotNull(), F.concat(F.lit("# "), title, F.lit("\n\n"))).otherwise(""),
        F.when(author.isNotNull(), F.concat(F.lit("**Author:** "), author, F.lit("\n\n"))).otherwise(""),
    )
    return F.concat(head, F.coalesce(F.array_join(F.transform(parts, one), ""), F.lit("")))


def as_html(title: Column, author: Column, parts: Column) -> Column:
    def one(e: Column) -> Column:
        kind, content = e["element_type"], escape_html(e["content"])
        tag = F.concat(F.lit("h"), _level(e).cast("string"))
        return (
            F.when(kind == "heading", F.concat(F.lit("<"), tag, F.lit(">"), content, F.lit("</"), tag, F.lit(">\n")))
            .when(kind == "list_item", F.concat(F.lit("<ul><li>"), content, F.lit("</li></ul>\n")))
            .otherwise(F.concat(F.lit("<p>"), content, F.lit("</p>\n")))
        )

    head = F.concat(
        F.lit("<!DOCTYPE html>\n<html>\n<head><meta charset=\"utf-8\"><title>"), F.coalesce(escape_html(title), F.lit("")), F.lit("</title></head>\n<body>\n"),
        F.when(author.isNotNull(), F.concat(F.lit("<address>"), escape_html(author), F.lit("</address>\n"))).otherwise(""),
    )
    return F.concat(head, F.coalesce(F.array_join(F.transform(parts, one), ""), F.lit("")), F.lit("</body>\n</html>\n"))


def markdown_table(rows: Column) -> Column:
    """A pipe table of ``array<array<string>>``; the first row is the head, cells have their bars escaped."""
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, lambda c: F.replace(c, F.lit("|"), F.lit("\\|"))), " | "), F.lit(" |\n"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.size(rows[0])), F.lit("\n"))
    body = F.array_join(F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), line), "")
    return F.when(F.size(rows) > 0, F.concat(line(rows[0]), rule, body)).otherwise("")


def html_table(rows: Column) -> Column:
    cells = lambda r, tag: F.array_join(F.transform(r, lambda c: F.concat(F.lit(f"<{tag}>"), escape_html(c), F.lit(f"</{tag}>"))), "")
    line = lambda r, tag: F.concat(F.lit("<tr>"), cells(r, tag), F.lit("</tr>"))
    body = F.array_join(F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), lambda r: line(r, "td")), "")
    return F.when(F.size(rows) > 0, F.concat(F.lit("<table><thead>"), line(rows[0], "th"), F.lit("</thead><tbody>"), body, F.lit("</tbody></table>"))).otherwise("")


def as_json(record: Column) -> Column:
    return F.to_json(record, {"pretty": "true", "ignoreNullFields": "false"})
