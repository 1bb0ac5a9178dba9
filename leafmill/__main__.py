"""``python -m leafmill``: extract, replace, create and template over files, as Spark jobs.

    extract FOLDER OUT [--format text|json|markdown|html] [--recursive] [--exclude GLOB]
    replace FOLDER RULES OUT [--dry-run] [--recursive]
    create FILE.md OUT.docx|OUT.pptx
    template FILE OUT --set key=value ...
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.operators import batch, formats, markdown, textops
from leafmill.session import local_session, materialise
from leafmill.sources import files, ooxml


def _found(spark, folder: str, recursive: bool, exclude: str | None) -> DataFrame:
    got = ooxml.binary_files(spark, folder, recursive=recursive).where(batch.reader(F.col("path")).isNotNull() & ~batch.is_temporary(F.col("path")))
    return got.where(~batch.excluded(F.col("path"), exclude)) if exclude else got


def extract(a: argparse.Namespace) -> dict:
    spark = local_session("extract")
    found = _found(spark, a.folder, a.recursive, a.exclude)
    kind = batch.reader(F.col("path"))
    office = ooxml.read_documents(found.where(kind.isin("word", "powerpoint", "excel"))).select("path", "page", "text", "title", "author", "error")
    pdf = files.read_pdfs(found.where(kind == "pdf")).select("path", "page", "text", "title", "author", "error")
    plain = found.where(kind == "text").select("path", F.lit(1).alias("page"), F.decode("content", "UTF-8").alias("text"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("author"), F.lit(None).cast("string").alias("error"))
    pages = office.unionByName(pdf).unionByName(plain)
    whole = pages.groupBy("path").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda p: p["text"]), "\n\n").alias("text"), F.max("title").alias("title"), F.max("author").alias("author"), F.max("error").alias("error")
    )
    parts = formats.with_elements(whole, ["path", "title", "author", "error"])
    made = {
        "text": F.array_join(F.transform("elements", lambda e: e["content"]), "\n"), "markdown": formats.as_markdown(F.col("title"), F.col("author"), F.col("elements")),
        "html": formats.as_html(F.col("title"), F.col("author"), F.col("elements")), "json": formats.as_json(F.struct("path", "title", "author", "error", "elements")),
    }[a.format]
    ext = {"text": "txt", "markdown": "md", "html": "html", "json": "json"}[a.format]
    out = materialise(parts.select(batch.base_name(batch.output_path("", F.col("path"), ext)).alias("name"), F.encode(F.coalesce(made, F.lit("")), "UTF-8").alias("content"), "error"), "extracted")
    ooxml.write_files(out.where("error is null"), a.out)
    return batch.fold(out, F.col("error").isNull(), F.octet_length("content"), []).first().asDict()


def replace(a: argparse.Namespace) -> dict:
    spark = local_session("replace")
    rules = files.load_rules(a.rules)
    found = _found(spark, a.folder, a.recursive, None)
    kind = batch.reader(F.col("path"))
    office = ooxml.replace_in(found.where(kind.isin("word", "powerpoint")), rules)
    plain = textops.replace_steps(found.where(kind == "text").select("path", F.decode("content", "UTF-8").alias("text")), "text", rules)
    hits = sum((F.col(f"hits_{k}") for k in range(len(rules))), F.lit(0))
    both = office.unionByName(plain.select("path", F.encode("replaced", "UTF-8").alias("content"), hits.cast("long").alias("hits"), F.lit(None).cast("string").alias("error")))
    both = materialise(both, "replaced")
    if not a.dry_run:
        ooxml.write_files(both.where("hits > 0 and error is null").select(batch.base_name(F.col("path")).alias("name"), "content"), a.out)
    return both.agg(F.count(F.lit(1)).alias("files"), F.sum("hits").alias("replacements"), F.count("error").alias("errors")).first().asDict()


def create(a: argparse.Namespace) -> dict:
    fields, title, parts = markdown.parse(Path(a.file).read_text(encoding="utf-8"))
    if a.out.endswith(".pptx"):
        pages: dict[int, list[str]] = {}
        for section, _, _, _, content in parts:
            pages.setdefault(section, []).append(content)
        made = ooxml.make_slides(list(pages.values()), title, fields.get("author"))
    else:
        made = ooxml.make_word([(kind, level, content) for _, _, kind, level, content in parts], title, fields.get("author"))
    Path(a.out).write_bytes(made)
    return {"sections": len({p[0] for p in parts}), "elements": len(parts)}


def template(a: argparse.Namespace) -> dict:
    text = Path(a.file).read_text(encoding="utf-8")
    for pair in sorted(a.set):
        key, _, value = pair.partition("=")
        text = text.replace("{{" + key + "}}", value)
    Path(a.out).write_text(text, encoding="utf-8")
    return {"unresolved": [p.split("}}")[0] for p in text.split("{{")[1:]]}


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="leafmill")
    commands = parser.add_subparsers(required=True)
    for name, job, places in (("extract", extract, ("folder", "out")), ("replace", replace, ("folder", "rules", "out")), ("create", create, ("file", "out")), ("template", template, ("file", "out"))):
        p = commands.add_parser(name)
        p.set_defaults(job=job)
        for x in places:
            p.add_argument(x)
        if name in ("extract", "replace"):
            p.add_argument("--recursive", action="store_true")
    commands.choices["extract"].add_argument("--format", default="text", choices=("text", "json", "markdown", "html"))
    commands.choices["extract"].add_argument("--exclude")
    commands.choices["replace"].add_argument("--dry-run", action="store_true")
    commands.choices["template"].add_argument("--set", action="append", default=[])
    a = parser.parse_args(args)
    print(json.dumps(a.job(a), ensure_ascii=False))
    return 0


if __name__ == "__main__":
    sys.exit(main())
