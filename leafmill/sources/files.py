"""Plain texts, rule files, settings, and a small reader for the text of PDF files."""

from __future__ import annotations

import json
import re
import tomllib
import zlib
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.operators.textops import Rule, check_rules


def read_texts(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """(path, title, text): whole UTF-8 files; the title is the stem."""
    got = spark.read.text(folder, wholetext=True, recursiveFileLookup=recursive)
    path = F.col("_metadata.file_path")
    return got.select(path.alias("path"), F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1).alias("title"), F.col("value").alias("text"))


def load_rules(path: str) -> list[Rule]:
    """Rules of a YAML or JSON file: a list of {old, new} or one under ``replacements``."""
    text = Path(path).read_text(encoding="utf-8")
    got = json.loads(text) if path.endswith(".json") else yaml.safe_load(text)
    rows = got.get("replacements", []) if isinstance(got, dict) else got or []
    return check_rules([(r["old"], r["new"]) for r in rows])


DEFAULTS = {"language": "en", "max_workers": 4, "max_tokens": 2000, "temperature": 0.7, "backup": True, "custom": {}}


def load_settings(path: str | None) -> dict:
    """Settings over their defaults; a missing file gives the defaults, unknown keys go under ``custom``."""
    got: dict = {}
    if path and Path(path).exists():
        text = Path(path).read_text(encoding="utf-8")
        got = json.loads(text) if path.endswith(".json") else yaml.safe_load(text) if path.endswith((".yaml", ".yml")) else tomllib.loads(text)
    known = {k: v for k, v in (got or {}).items() if k in DEFAULTS and k != "custom"}
    return {**DEFAULTS, **known, "custom": {k: v for k, v in (got or {}).items() if k not in DEFAULTS}}


def get_setting(settings: dict, key: str):
    """A setting by its dotted key; unknown ones are looked for under ``custom``."""
    node = settings
    for part in key.split("."):
        if not isinstance(node, dict) or part not in node:
            return settings.get("custom", {}).get(key)
        node = node[part]
    return node


def set_setting(settings: dict, key: str, value) -> dict:
    """New settings with one changed; keys without a default go under ``custom``."""
    if key in DEFAULTS and key != "custom":
        return {**settings, key: type(DEFAULTS[key])(value) if not isinstance(DEFAULTS[key], bool) else str(value).lower() == "true"}
    return {**settings, "custom": {**settings.get("custom", {}), key: value}}


def unset_setting(settings: dict, key: str) -> dict:
    """New settings with one back at its default, or gone from ``custom``."""
    if key in DEFAULTS and key != "custom":
        return {**settings, key: DEFAULTS[key]}
    return {**settings, "custom": {k: v for k, v in settings.get("custom", {}).items() if k != key}}


def save_settings(settings: dict, path: str) -> None:
    text = json.dumps(settings, indent=2, ensure_ascii=False) if path.endswith(".json") else yaml.safe_dump(settings, allow_unicode=True)
    Path(path).write_text(text, encoding="utf-8")


_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\nendstream", re.S)
_SHOWN = re.compile(rb"\((?:\\.|[^\\()])*\)\s*(?:Tj|'|\")|\[(?:[^\]\\]|\\.)*\]\s*TJ|T\*|Td|TD|BT")
_LITERAL = re.compile(rb"\(((?:\\.|[^\\()])*)\)")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def pdf_text(content: bytes) -> list[str]:
    """Texts of the content streams of a PDF file, one for each stream that shows text, for simple encodings only."""
    pages = []
    for m in _STREAM.finditer(content):
        data = m[1]
        try:
            data = zlib.decompress(data)
        except zlib.error:
            pass
        if b"BT" not in data:
            continue
        out = []
        for s in _SHOWN.finditer(data):
            if s[0] in (b"T*", b"Td", b"TD", b"BT"):
                if out and out[-1] != "\n":
                    out.append("\n")
                continue
            for lit in _LITERAL.findall(s[0]):
                raw = re.sub(rb"\\([0-7]{1,3}|.)", lambda e: _ESCAPES.get(e[1]) or (bytes([int(e[1], 8) & 255]) if e[1].isdigit() else e[1]), lit)
                out.append(raw.decode("latin-1"))
        pages.append("".join(out).strip())
    return pages


def pdf_info(content: bytes) -> dict[str, str | None]:
    """title, author, creation_date, version and whether an encryption dictionary is named."""
    got = {}
    for key, name in ((b"Title", "title"), (b"Author", "author"), (b"CreationDate", "creation_date")):
        m = re.search(rb"/" + key + rb"\s*\(((?:\\.|[^\\()])*)\)", content)
        got[name] = m[1].decode("latin-1") if m else None
    v = re.match(rb"%PDF-(\d\.\d)", content)
    return {**got, "version": v[1].decode() if v else None, "encrypted": str(b"/Encrypt" in content).lower()}


def read_pdfs(files: DataFrame) -> DataFrame:
    """(path, page, text, title, author, creation_date, version, encrypted, error) of `files` (path, content)."""
    columns = ["path", "page", "text", "title", "author", "creation_date", "version", "encrypted", "error"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                if not content.startswith(b"%PDF"):
                    rows.append((path, None, None, None, None, None, None, None, "no PDF file"))
                    continue
                info = pdf_info(content)
                for k, t in enumerate(pdf_text(content) or [""], 1):
                    rows.append((path, k, t, info["title"], info["author"], info["creation_date"], info["version"], info["encrypted"] == "true", None))
            yield pd.DataFrame(rows, columns=columns)

    schema = "path string, page int, text string, title string, author string, creation_date string, version string, encrypted boolean, error string"
    return files.select("path", "content").mapInPandas(run, schema)
