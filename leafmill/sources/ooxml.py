"""Word, presentation and workbook archives, read and written with the standard library inside Arrow batches.

An archive that cannot be read gives a row with its ``error`` and nothing else (permissive), or fails the query
(``fail_fast``).  Parts are read one at a time; an archive is held by the task that reads it.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from leafmill.functions.refs import index_to_letters, letters_to_index

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
A = "http://schemas.openxmlformats.org/drawingml/2006/main"
S = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PKG = "http://schemas.openxmlformats.org/package/2006"


def parts(content: bytes) -> dict[str, bytes]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return {n: z.read(n) for n in z.namelist()}


def with_parts(content: bytes, changed: dict[str, bytes]) -> bytes:
    """The archive with some parts replaced, the others as they were."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as z, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:
        for n in z.namelist():
            new.writestr(n, changed.get(n, z.read(n)))
        for n in changed.keys() - set(z.namelist()):
            new.writestr(n, changed[n])
    return out.getvalue()


def _texts(xml: bytes, tag: str) -> list[str]:
    return [e.text or "" for e in ET.fromstring(xml).iter() if e.tag.rpartition("}")[2] == tag]


def properties(archive: dict[str, bytes]) -> dict[str, str | None]:
    """title, author, subject, created, modified, application, pages and slides of the property parts."""
    names = {"title": "title", "creator": "author", "subject": "subject", "created": "created", "modified": "modified", "Application": "application", "Pages": "pages", "Slides": "slides"}
    out: dict[str, str | None] = dict.fromkeys(names.values())
    for part in ("docProps/core.xml", "docProps/app.xml"):
        if part in archive:
            for e in ET.fromstring(archive[part]).iter():
                if (to := names.get(e.tag.rpartition("}")[2])) and (e.text or "").strip():
                    out[to] = e.text
    return out


def word_text(archive: dict[str, bytes]) -> str:
    return " ".join(_texts(archive["word/document.xml"], "t")).strip()


def slides(archive: dict[str, bytes], natural: bool = False) -> list[tuple[str, str]]:
    """(part, text) of the slides, in the byte order of their names, or with `natural` by number."""
    names = [n for n in archive if re.fullmatch(r"ppt/slides/slide[^/]*\.xml", n)]
    names.sort(key=(lambda n: (int(re.sub(r"\D", "", n.rpartition("/")[2]) or 0), n)) if natural else None)
    return [(n, " ".join(t for t in _texts(archive[n], "t") if t).strip()) for n in names]


def slides_text(found: list[tuple[str, str]]) -> str:
    return "\n".join((f"--- Slide {k + 1} ---\n" if k else "") + t for k, (_, t) in enumerate(found) if t)


def sheets(archive: dict[str, bytes]) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """(name, cells as (row, col, value)) of a workbook's sheets; formulas are kept with their equals sign."""
    shared: list[str] = []
    if "xl/sharedStrings.xml" in archive:
        for si in ET.fromstring(archive["xl/sharedStrings.xml"]).iter(f"{{{S}}}si"):
            shared.append("".join(t.text or "" for t in si.iter(f"{{{S}}}t")))
    targets = {}
    if "xl/_rels/workbook.xml.rels" in archive:
        targets = {e.get("Id"): e.get("Target") for e in ET.fromstring(archive["xl/_rels/workbook.xml.rels"])}
    out = []
    for k, sheet in enumerate(ET.fromstring(archive["xl/workbook.xml"]).iter(f"{{{S}}}sheet"), 1):
        target = targets.get(sheet.get(f"{{{R}}}id"), f"worksheets/sheet{k}.xml")
        part = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        cells = []
        if part in archive:
            for c in ET.fromstring(archive[part]).iter(f"{{{S}}}c"):
                m = re.match(r"([A-Z]+)(\d+)", c.get("r", ""))
                if not m:
                    continue
                kind, v, f = c.get("t"), c.find(f"{{{S}}}v"), c.find(f"{{{S}}}f")
                if f is not None and f.text:
                    value = "=" + f.text
                elif kind == "inlineStr":
                    value = "".join(t.text or "" for t in c.iter(f"{{{S}}}t"))
                else:
                    value = v.text or "" if v is not None else ""
                    if kind == "s" and value:
                        value = shared[int(value)]
                    elif kind == "b":
                        value = "true" if value == "1" else "false"
                    elif kind == "e":
                        value = f"#ERR: {value}"
                    elif kind in (None, "n") and value:
                        value = re.sub(r"\.0$", "", value)
                cells.append((int(m[2]) - 1, letters_to_index(m[1]), value))
        out.append((sheet.get("name"), cells))
    return out


def replaced(archive: dict[str, bytes], rules: list[tuple[str, str]], tags: tuple[str, ...] = ("t",), slide: int | None = None) -> tuple[dict[str, bytes], int]:
    """(changed parts, hits): the rules in order within each text node of the body parts, or of one slide only, which
    counts from 0 in the order of names."""
    changed, hits = {}, 0
    only = slides(archive)[slide][0] if slide is not None else None
    for name, xml in archive.items():
        if only is not None and name != only:
            continue
        if not re.match(r"(word/document|ppt/slides/slide[^/]*)\.?.*xml$", name):
            continue
        root, before = ET.fromstring(xml), hits
        for e in root.iter():
            if e.tag.rpartition("}")[2] in tags and e.text:
                for old, new in rules:
                    hits += e.text.count(old)
                    e.text = e.text.replace(old, new)
        if hits > before:
            changed[name] = ET.tostring(root, encoding="utf-8", xml_declaration=True)
    return changed, hits


def _types(overrides: dict[str, str]) -> bytes:
    lines = "".join(f'<Override PartName="/{p}" ContentType="application/vnd.openxmlformats-officedocument.{t}+xml"/>' for p, t in overrides.items())
    return (
        f'<?xml version="1.0" encoding="UTF-8"?><Types xmlns="{PKG}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
        f'<Default Extension="xml" ContentType="application/xml"/>{lines}'
        '<Override PartName="/docProps/core.xml" ContentType="application/vnd.openxmlformats-package.core-properties+xml"/></Types>'
    ).encode()


def _rels(targets: list[tuple[str, str]]) -> bytes:
    kinds = lambda kind: f"{PKG}/relationships/metadata/core-properties" if kind == "core" else f"{R}/{kind}"
    lines = "".join(f'<Relationship Id="rId{k}" Type="{kinds(kind)}" Target="{target}"/>' for k, (kind, target) in enumerate(targets, 1))
    return f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{PKG}/relationships">{lines}</Relationships>'.encode()


def _zipped(made: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for n, b in made.items():
            z.writestr(n, b)
    return out.getvalue()


def _escape(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;").replace("'", "&apos;")


def _core(title: str | None, author: str | None) -> bytes:
    dc = "http://purl.org/dc/elements/1.1/"
    return (
        f'<?xml version="1.0" encoding="UTF-8"?><cp:coreProperties xmlns:cp="{PKG}/metadata/core-properties" xmlns:dc="{dc}"><dc:title>{_escape(title or "")}</dc:title>'
        f"<dc:creator>{_escape(author or '')}</dc:creator></cp:coreProperties>"
    ).encode()


def make_word(elements: list[tuple[str, int | None, str]], title: str | None = None, author: str | None = None) -> bytes:
    """A Word archive of (kind, level, content)."""
    body = ""
    for kind, level, content in elements:
        style = f'<w:pPr><w:pStyle w:val="Heading{min(max(level or 1, 1), 6)}"/></w:pPr>' if kind == "heading" else '<w:pPr><w:pStyle w:val="ListParagraph"/></w:pPr>' if "item" in kind else ""
        body += f'<w:p>{style}<w:r><w:t xml:space="preserve">{_escape(content)}</w:t></w:r></w:p>'
    return _zipped({
        "[Content_Types].xml": _types({"word/document.xml": "wordprocessingml.document.main"}), "_rels/.rels": _rels([("officeDocument", "word/document.xml"), ("core", "docProps/core.xml")]),
        "word/document.xml": f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>'.encode(), "docProps/core.xml": _core(title, author),
    })


_P = "http://schemas.openxmlformats.org/presentationml/2006/main"
_TREE = '<p:nvGrpSpPr><p:cNvPr id="1" name=""/><p:cNvGrpSpPr/><p:nvPr/></p:nvGrpSpPr><p:grpSpPr/>'
# The colours a theme has to name, in the order of the standard (fixed values); the shades are this library's own.
_COLOURS = {"dk1": "000000", "lt1": "FFFFFF", "dk2": "333F50", "lt2": "EEEEEE", "accent1": "3B6EA5", "accent2": "C06014", "accent3": "6B8E23", "accent4": "8E5BA6", "accent5": "2A9D8F", "accent6": "B5838D", "hlink": "1F5FBF", "folHlink": "6A4C93"}
_MAP = " ".join(f'{k}="{v}"' for k, v in {"bg1": "lt1", "tx1": "dk1", "bg2": "lt2", "tx2": "dk2", **{f"accent{n}": f"accent{n}" for n in range(1, 7)}, "hlink": "hlink", "folHlink": "folHlink"}.items())


def _slide_part(tag: str, boxes: str, rest: str = "") -> bytes:
    return (
        f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><p:{tag} xmlns:p="{_P}" xmlns:a="{A}" xmlns:r="{R}"><p:cSld><p:spTree>{_TREE}{boxes}</p:spTree></p:cSld>{rest}</p:{tag}>'
    ).encode()


def _theme() -> bytes:
    colours = "".join(f'<a:{k}><a:srgbClr val="{v}"/></a:{k}>' for k, v in _COLOURS.items())
    font = '<a:latin typeface="Arial"/><a:ea typeface=""/><a:cs typeface=""/>'
    fill = '<a:solidFill><a:schemeClr val="phClr"/></a:solidFill>'
    return (
        f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><a:theme xmlns:a="{A}" name="plain"><a:themeElements><a:clrScheme name="plain">{colours}</a:clrScheme>'
        f'<a:fontScheme name="plain"><a:majorFont>{font}</a:majorFont><a:minorFont>{font}</a:minorFont></a:fontScheme><a:fmtScheme name="plain"><a:fillStyleLst>{fill * 3}</a:fillStyleLst>'
        f'<a:lnStyleLst>{f"<a:ln>{fill}</a:ln>" * 3}</a:lnStyleLst><a:effectStyleLst>{"<a:effectStyle><a:effectLst/></a:effectStyle>" * 3}</a:effectStyleLst><a:bgFillStyleLst>{fill * 3}</a:bgFillStyleLst>'
        "</a:fmtScheme></a:themeElements></a:theme>"
    ).encode()


def make_slides(pages: list[list[str]], title: str | None = None, author: str | None = None) -> bytes:
    """A presentation archive with a slide of text boxes for each page, and the master, layout and theme that a slide needs."""
    numbers = range(1, len(pages) + 1)
    made = {
        "[Content_Types].xml": _types({
            "ppt/presentation.xml": "presentationml.presentation.main", "ppt/slideMasters/slideMaster1.xml": "presentationml.slideMaster", "ppt/slideLayouts/slideLayout1.xml": "presentationml.slideLayout",
            "ppt/theme/theme1.xml": "theme", **{f"ppt/slides/slide{k}.xml": "presentationml.slide" for k in numbers},
        }),
        "_rels/.rels": _rels([("officeDocument", "ppt/presentation.xml"), ("core", "docProps/core.xml")]),
        "ppt/presentation.xml": (
            f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><p:presentation xmlns:p="{_P}" xmlns:r="{R}"><p:sldMasterIdLst><p:sldMasterId id="2147483648" r:id="rId{len(pages) + 1}"/></p:sldMasterIdLst>'
            + ("<p:sldIdLst>" + "".join(f'<p:sldId id="{255 + k}" r:id="rId{k}"/>' for k in numbers) + "</p:sldIdLst>" if pages else "") + '<p:sldSz cx="9144000" cy="6858000"/><p:notesSz cx="6858000" cy="9144000"/></p:presentation>'
        ).encode(),
        "ppt/_rels/presentation.xml.rels": _rels([*[("slide", f"slides/slide{k}.xml") for k in numbers], ("slideMaster", "slideMasters/slideMaster1.xml"), ("theme", "theme/theme1.xml")]),
        "ppt/slideMasters/slideMaster1.xml": _slide_part("sldMaster", "", f'<p:clrMap {_MAP}/><p:sldLayoutIdLst><p:sldLayoutId id="2147483649" r:id="rId1"/></p:sldLayoutIdLst>'),
        "ppt/slideMasters/_rels/slideMaster1.xml.rels": _rels([("slideLayout", "../slideLayouts/slideLayout1.xml"), ("theme", "../theme/theme1.xml")]),
        "ppt/slideLayouts/slideLayout1.xml": _slide_part("sldLayout", "", "<p:clrMapOvr><a:masterClrMapping/></p:clrMapOvr>"),
        "ppt/slideLayouts/_rels/slideLayout1.xml.rels": _rels([("slideMaster", "../slideMasters/slideMaster1.xml")]), "ppt/theme/theme1.xml": _theme(), "docProps/core.xml": _core(title, author),
    }
    for k, texts in enumerate(pages, 1):
        boxes = "".join(
            f'<p:sp><p:nvSpPr><p:cNvPr id="{n + 1}" name="Text {n}"/><p:cNvSpPr txBox="1"/><p:nvPr/></p:nvSpPr><p:spPr><a:xfrm><a:off x="457200" y="{457200 * n}"/><a:ext cx="8229600" cy="411480"/></a:xfrm>'
            f'<a:prstGeom prst="rect"><a:avLst/></a:prstGeom></p:spPr><p:txBody><a:bodyPr wrap="square"/><a:lstStyle/><a:p><a:r><a:t>{_escape(t)}</a:t></a:r></a:p></p:txBody></p:sp>'
            for n, t in enumerate(texts, 1)
        )
        made[f"ppt/slides/slide{k}.xml"] = _slide_part("sld", boxes, "<p:clrMapOvr><a:masterClrMapping/></p:clrMapOvr>")
        made[f"ppt/slides/_rels/slide{k}.xml.rels"] = _rels([("slideLayout", "../slideLayouts/slideLayout1.xml")])
    return _zipped(made)


_PLAIN = re.compile(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$")


def make_workbook(content: dict[str, list[list[str]]]) -> bytes:
    """A workbook archive of sheets of rows of texts; formulas, numbers and booleans get their type."""
    names = list(content)
    made = {
        "[Content_Types].xml": _types({"xl/workbook.xml": "spreadsheetml.sheet.main"} | {f"xl/worksheets/sheet{k}.xml": "spreadsheetml.worksheet" for k in range(1, len(names) + 1)}),
        "_rels/.rels": _rels([("officeDocument", "xl/workbook.xml"), ("core", "docProps/core.xml")]), "docProps/core.xml": _core(None, None), "xl/_rels/workbook.xml.rels": _rels([("worksheet", f"worksheets/sheet{k}.xml") for k in range(1, len(names) + 1)]),
        "xl/workbook.xml": (f'<?xml version="1.0"?><workbook xmlns="{S}" xmlns:r="{R}"><sheets>' + "".join(f'<sheet name="{_escape(n)}" sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(names, 1)) + "</sheets></workbook>").encode(),
    }
    for k, n in enumerate(names, 1):
        rows = ""
        for r, cells in enumerate(content[n], 1):
            row = ""
            for c, v in enumerate(cells):
                at = f"{index_to_letters(c)}{r}"
                if v is None or v == "":
                    continue
                if v.startswith("="):
                    row += f'<c r="{at}"><f>{_escape(v[1:])}</f></c>'
                elif _PLAIN.match(v):
                    row += f'<c r="{at}"><v>{v}</v></c>'
                elif v in ("true", "false"):
                    row += f'<c r="{at}" t="b"><v>{int(v == "true")}</v></c>'
                else:
                    row += f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{_escape(v)}</t></is></c>'
            rows += f'<row r="{r}">{row}</row>'
        made[f"xl/worksheets/sheet{k}.xml"] = f'<?xml version="1.0"?><worksheet xmlns="{S}"><sheetData>{rows}</sheetData></worksheet>'.encode()
    return _zipped(made)


def _documents(path: str, content: bytes) -> list[dict]:
    archive = parts(content)
    ext = path.rpartition(".")[2].lower()
    meta = properties(archive)
    if ext == "docx":
        pages = [(1, word_text(archive))]
    elif ext == "pptx":
        pages = [(k, t) for k, (_, t) in enumerate(slides(archive), 1) if t] or [(1, "")]
    else:
        pages = []
        for k, (name, cells) in enumerate(sheets(archive), 1):
            rows: dict[int, list[tuple[int, str]]] = {}
            for r, c, v in cells:
                if v != "":
                    rows.setdefault(r, []).append((c, v))
            pages.append((k, "\n".join("\t".join(v for _, v in sorted(rows[r])) for r in sorted(rows))))
        pages = [(k, t) for k, t in pages if t] or [(1, "")]
    return [{"path": path, "page": k, "text": t, "title": meta["title"], "author": meta["author"], "created": meta["created"], "modified": meta["modified"], "error": None} for k, t in pages]


DOCUMENTS = "path string, page int, text string, title string, author string, created string, modified string, error string"
CELLS = "workbook string, sheet string, row long, col long, value string, error string"


def _mapped(files: DataFrame, work: Callable[[str, bytes], list[dict]], schema: str, fail_fast: bool) -> DataFrame:
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[dict] = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    rows += work(path, content)
                except Exception as e:
                    if fail_fast:
                        raise
                    if "error" in columns:
                        rows.append(dict.fromkeys(columns) | {columns[0]: path, "error": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame(rows, columns=columns, dtype=object)

    return files.select("path", "content").mapInPandas(run, schema)


def read_documents(files: DataFrame, fail_fast: bool = False) -> DataFrame:
    """Pages of Office archives; `files` has path and content, as ``binaryFile`` gives them."""
    return _mapped(files, _documents, DOCUMENTS, fail_fast)


def read_cells(files: DataFrame, fail_fast: bool = False) -> DataFrame:
    """The cells of workbooks.  An unreadable one gives one row with its error and no cell, unless `fail_fast`."""
    return _mapped(files, lambda path, content: [{"workbook": path, "sheet": n, "row": r, "col": c, "value": v, "error": None} for n, cells in sheets(parts(content)) for r, c, v in cells], CELLS, fail_fast)


def replace_in(files: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """(path, content, hits, error): archives with the rules applied within their text nodes."""
    def one(path: str, content: bytes) -> list[dict]:
        changed, hits = replaced(parts(content), rules)
        return [{"path": path, "content": with_parts(content, changed) if changed else content, "hits": hits, "error": None}]

    return _mapped(files, one, "path string, content binary, hits long, error string", False)


def binary_files(spark: SparkSession, folder: str, glob: str | None = None, recursive: bool = False) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(folder)


def write_files(made: DataFrame, folder: str) -> None:
    """One file for each row of (name, content) in a folder that all executors share, each written under another name
    first and then renamed, so a task that is run again leaves whole files."""
    import os
    import uuid

    def put(rows) -> None:
        for r in rows:
            at = os.path.join(folder, r["name"])
            os.makedirs(os.path.dirname(at), exist_ok=True)
            part = f"{at}.{uuid.uuid4().hex}.part"
            with open(part, "wb") as f:
                f.write(r["content"])
            os.replace(part, at)

    made.select("name", "content").foreachPartition(put)


class OfficeSource(DataSource):
    """``spark.read.format("office").load(folder)``: pages of the Office files of a folder, one partition a file."""

    @classmethod
    def name(cls) -> str:
        return "office"

    def schema(self) -> str:
        return DOCUMENTS

    def reader(self, schema) -> DataSourceReader:
        return _OfficeReader(self.options["path"], self.options.get("recursive", "false") == "true")


class _OfficeReader(DataSourceReader):
    def __init__(self, folder: str, recursive: bool):
        self.folder, self.recursive = folder.removeprefix("file:"), recursive

    def partitions(self) -> list[InputPartition]:
        from pathlib import Path

        found = Path(self.folder).rglob("*") if self.recursive else Path(self.folder).glob("*")
        return [InputPartition(str(p)) for p in sorted(found) if p.suffix.lower() in (".docx", ".pptx", ".xlsx") and not p.name.startswith("~$")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        try:
            with open(partition.value, "rb") as f:
                rows = _documents(partition.value, f.read())
        except Exception as e:  # noqa: BLE001 - an unreadable file is a row with its error
            rows = [dict.fromkeys(c.split()[0] for c in DOCUMENTS.split(", ")) | {"path": partition.value, "error": f"{type(e).__name__}: {e}"}]
        yield from (tuple(r.values()) for r in rows)


def xml_texts(xml: str, tag: str = "t"):
    """A column expression: the text nodes of a tag joined by spaces, in the JVM."""
    return F.array_join(F.expr(f"xpath({xml}, \"//*[local-name()='{tag}']/text()\")"), " ")
