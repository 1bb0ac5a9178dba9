import zipfile

import pytest
from pyspark.sql import functions as F

from leafmill.functions import refs
from leafmill.operators import batch, cells, charts, formats, formula, markdown, pivot, structure, textops, validate
from leafmill.sources import files, ooxml
from leafmill.streaming import breaker, chunked


def test_letters_round_trip():
    for i in (0, 1, 25, 26, 51, 52, 701, 702, 18277):
        assert refs.letters_to_index(refs.index_to_letters(i)) == i
    assert [refs.letters_to_index(x) for x in ("A", "B", "Z", "AA")] == [0, 1, 25, 26]


def test_parse_rejects_row_zero():
    with pytest.raises(ValueError):
        refs.parse("A0")
    box = refs.parse("S!C3:A1")
    assert (box.sheet, box.col, box.row, box.end_col, box.end_row, box.cells) == ("S", 0, 0, 2, 2, 9)


def test_rules_are_checked():
    with pytest.raises(ValueError):
        textops.check_rules([("", "x")])
    with pytest.raises(ValueError):
        textops.check_rules([("a", "a")])


def test_replace_is_literal_and_ordered(spark):
    df = spark.createDataFrame([("a.b $1 ^x*",), (None,), ("",)], "text string")
    got = textops.replace_steps(df, "text", [("a.b", "$1"), ("$1", "Z"), ("^x*", "\\")]).collect()
    assert got[0]["replaced"] == "Z Z \\" and [got[0][f"hits_{k}"] for k in range(3)] == [1, 2, 1]
    assert got[1]["replaced"] is None and got[1]["hits_0"] == 0 and got[2]["replaced"] == ""


def test_placeholders_and_render(spark):
    df = spark.createDataFrame([("a {{x}} b {{y}} {{open",), ("none",), (None,)], "t string")
    assert [r[0] for r in df.select(textops.placeholders(F.col("t"))).collect()] == [["x", "y", "open"], [], None]
    got = df.select(textops.render(F.col("t"), {"y": F.lit("{{x}}"), "x": F.lit("1")})).first()[0]
    assert got == "a 1 b {{x}} {{open"


def test_elements(spark):
    text = "TITLE\n• one\n- two\n  \n1234\nSome words.\nGRÖSSE ÜBER\n가나다"
    got = structure.elements(spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, text string")).orderBy("pos").collect()
    assert [r["element_type"] for r in got] == ["heading", "list_item", "list_item", "heading", "paragraph", "heading", "paragraph"]
    assert [r["marker"] for r in got][1:3] == ["•", "-"]


def test_tables_need_two_rows(spark):
    text = "a  b  c  d\ne  f  g  h\nx\na  b  c  d\ny"
    got = structure.tables(spark.createDataFrame([(1, text)], "id int, text string"), ["id"]).collect()
    assert len(got) == 1 and got[0]["rows"] == 2 and got[0]["data"] == [list("abcd"), list("efgh")]


def test_even_pages(spark):
    df = spark.createDataFrame([(1, "abcdefg")], "id int, text string")
    assert [r["page_text"] for r in structure.pages_evenly(df, F.lit(3)).orderBy("page").collect()] == ["ab", "cd", "efg"]
    assert [r["page_text"] for r in structure.pages_evenly(df, F.lit(3), strict=True).orderBy("page").collect()] == ["ab", "cd", "ef"]


def test_formats(spark):
    df = spark.createDataFrame([(1, "A & B", None, "HEAD\n- item <1>\ntext")], "id int, title string, author string, text string")
    got = formats.with_elements(df, ["id", "title", "author"])
    md, html = got.select(formats.as_markdown(F.col("title"), F.col("author"), F.col("elements")), formats.as_html(F.col("title"), F.col("author"), F.col("elements"))).first()
    assert md == "# A & B\n\n## HEAD\n\n- item <1>\ntext\n\n"
    assert "<title>A &amp; B</title>" in html and "<li>- item &lt;1&gt;</li>" in html and "<h2>HEAD</h2>" in html
    rows = spark.range(1).select(F.array(F.array(F.lit("a"), F.lit("b|c")), F.array(F.lit("1"), F.lit("2"))).alias("r"))
    t, h = rows.select(formats.markdown_table(F.col("r")), formats.html_table(F.col("r"))).first()
    assert t == "| a | b\\|c |\n| --- | --- |\n| 1 | 2 |\n" and h.startswith("<table><thead><tr><th>a</th>")


def test_numbered_without_one_partition(spark):
    df = spark.range(1000).select((F.lit(1000) - F.col("id")).alias("k"), F.lit("x").alias("v"))
    got = cells.numbered(df, ["k"]).orderBy("row").collect()
    assert [r["row"] for r in got] == list(range(1000)) and [r["k"] for r in got] == list(range(1, 1001))
    assert cells.numbered(df.where("k < 0"), ["k"]).count() == 0


@pytest.fixture(scope="module")
def sheet(spark):
    data = [("A1", "1"), ("A2", "2"), ("A3", "3"), ("B1", "10"), ("B2", "text"), ("C1", "true")]
    rows = [("w", "s", refs.parse(a).row, refs.parse(a).col, v) for a, v in data]
    return spark.createDataFrame(rows, "workbook string, sheet string, row long, col int, value string")


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("=A1+B1", 11.0), ("=SUM(A1:A3)", 6.0), ("=AVERAGE(A1:A4)", 1.5), ("=COUNT(A1:B3)", 6.0), ("=MAX(A1:B3)", 10.0), ("=MIN(A1:A3)", 1.0), ("=PRODUCT(A1:A3)", 6.0), ("=2^3^2", 512.0), ("=-A2*2", -4.0),
        ("=IF(A1<B1,1,2)", 1), ("=IF(A1,1,2)", 2), ("=B2+1", 1.0), ("=1/0", None), ("=s!A3*2", 6.0), ("=ROUND(10/4,1)", 2.5), ('="a"&"b"', "ab"), ("=SUM(A1:A2,B1)", 13.0), ("=MAX(A1,A2,B1)", 10.0),
    ],
)
def test_formula(sheet, text, want):
    assert formula.evaluate(sheet, {"x": text}, sheet="s").first()["x"] == want


def test_formula_semantics_and_errors(sheet):
    got = formula.evaluate(sheet, {"n": "=COUNT(A1:B3)", "m": "=AVERAGE(A1:B3)"}, sheet="s", excel_semantics=True).first()
    assert got["n"] == 4.0 and got["m"] == 4.0
    bad = formula.evaluate(sheet, {"x": "=FOO(1)", "y": "=1+", "z": "=A1:A2"}).first()
    assert all(bad[k] is None and bad[f"error_{k}"].startswith("#ERROR") for k in "xyz")
    assert [b.cells for b in formula.references("=A1 + SUM(A1:B3)")] == [1, 6]


def test_cells(sheet):
    assert cells.read_range(sheet, "A1:A2").count() == 2
    assert cells.read_range(sheet, "other!A1:A2").count() == 0
    assert cells.sheet_texts(sheet).first()["text"] == "1\t10\ttrue\n2\ttext\n3\n"
    assert {r["kind"] for r in sheet.select(cells.cell_type(F.col("value")).alias("kind")).collect()} == {"number", "text", "boolean"}


def test_validation(sheet):
    got = validate.violations(sheet, [validate.dropdown(["1", "2"], "A1:A3"), validate.whole_number("B1:B2")]).collect()
    assert sorted((r["row"], r["col"], r["rule"]) for r in got) == [(1, 1, "WholeNumber"), (2, 0, "List")]


def test_charts(sheet, spark):
    assert charts.series_data(sheet, "a", "A1:A3", "B1:B3").count() == 3
    assert len(charts.KINDS) == 22 and charts.placement(2, 10) == [12, 32]
    data = spark.createDataFrame([("a", "x", 1.0), ("b", "x", 3.0), ("a", "y", 0.0), ("b", "y", 0.0)], "series string, category string, value double")
    got = {(r["series"], r["category"]): r["drawn"] for r in charts.drawn(data, "BarPercentStacked").collect()}
    assert got["b", "x"] == 0.75 and got["a", "y"] is None


def test_pivot_definitions():
    one = pivot.Pivot("n", "A1:D100", "s", ["a"], ["b"], [pivot.DataField("v")])
    again = pivot.import_definitions(pivot.export_definitions([one]), [one])
    assert again == [one, one] and one.data_fields[0].title == "Sum of v"
    with pytest.raises(ValueError):
        pivot.condition(F.lit(1), "Like", 1)


def test_breaker_by_hand():
    b = breaker.Breaker(2, 2, 10.0)
    told = [b.step(at, ok) for at, ok in ((0, False), (1, False), (2, True), (11, True), (12, True), (13, False), (14, True))]
    assert told == [(True, "closed"), (True, "open"), (False, "open"), (True, "half_open"), (True, "closed"), (True, "closed"), (True, "closed")]


def test_breaker_stream_equals_table(spark, sf):
    from leafmill.plans import services

    key = lambda df: sorted((r["key"], r["event_id"], r["admitted"], r["state"]) for r in df.collect())
    assert key(services.circuit_breaker_stream(spark, sf)) == key(services.circuit_breaker(spark, sf))


def test_chunks_fail_or_drop(spark):
    def work(frame):
        if (frame["id"] == 3).any():
            raise RuntimeError("bad")
        return frame

    df = spark.range(10).repartition(10)
    assert chunked.each_chunk(df, work, "id long", fail_fast=False).count() < 10
    with pytest.raises(Exception, match="bad"):
        chunked.each_chunk(df, work, "id long").collect()


def test_office_round_trip(spark, tmp_path):
    made = {
        "a.docx": ooxml.make_word([("paragraph", None, "a & b"), ("paragraph", None, "{{NAME}}")], "T", "me"), "b.pptx": ooxml.make_slides([["one"], [""], ["three"]]),
        "c.xlsx": ooxml.make_workbook({"s": [["1", "x"], ["=A1", "true"]]}), "bad.docx": b"no archive",
    }
    ooxml.write_files(spark.createDataFrame([(k, bytearray(v)) for k, v in made.items()], "name string, content binary"), str(tmp_path / "in"))
    found = ooxml.binary_files(spark, f"file://{tmp_path}/in")
    pages = {(r["path"].rpartition("/")[2], r["page"]): r for r in ooxml.read_documents(found).collect()}
    assert pages["a.docx", 1]["text"] == "a & b {{NAME}}" and pages["a.docx", 1]["title"] == "T"
    assert pages["b.pptx", 3]["text"] == "three" and ("b.pptx", 2) not in pages and pages["c.xlsx", 1]["text"] == "1\tx\n=A1\ttrue"
    assert pages["bad.docx", None]["error"].startswith("BadZipFile")
    with pytest.raises(Exception, match="zip"):
        ooxml.read_documents(found, fail_fast=True).collect()
    changed = {r["path"].rpartition("/")[2]: r for r in ooxml.replace_in(found.where(F.col("path").endswith("a.docx")), [("{{NAME}}", "you")]).collect()}["a.docx"]
    assert changed["hits"] == 1 and ooxml.word_text(ooxml.parts(changed["content"])) == "a & b you"
    spark.dataSource.register(ooxml.OfficeSource)
    assert spark.read.format("office").load(str(tmp_path / "in")).count() == 5


def test_slides_by_name_and_by_number():
    archive = ooxml.parts(ooxml.make_slides([[str(k)] for k in range(1, 12)]))
    assert [t for _, t in ooxml.slides(archive)][:3] == ["1", "10", "11"] and [t for _, t in ooxml.slides(archive, natural=True)][:3] == ["1", "2", "3"]


def test_stored_archive_parts():
    raw = ooxml.make_workbook({"s": [["v"]]})
    assert ooxml.sheets(ooxml.parts(ooxml.with_parts(raw, {"extra.xml": b"<a/>"})))[0][1] == [(0, 0, "v")]
    assert zipfile.is_zipfile(__import__("io").BytesIO(raw))


def test_files(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "note.one.txt").write_text("line\nüber", encoding="utf-8")
    r = files.read_texts(spark, f"file://{tmp_path}/t").first()
    assert r["title"] == "note.one" and r["text"] == "line\nüber"
    rules = tmp_path / "r.yaml"
    rules.write_text("replacements:\n  - {old: a, new: b}\n")
    assert files.load_rules(str(rules)) == [("a", "b")]
    assert files.load_settings(None)["max_workers"] == 4
    s = tmp_path / "c.toml"
    s.write_text("max_workers = 9\nodd = 1\n")
    got = files.load_settings(str(s))
    assert got["max_workers"] == 9 and got["custom"] == {"odd": 1}
    pdf = b"%PDF-1.4\n1 0 obj<</Title (A title)>>endobj\nstream\nBT (Hello) Tj T* (a\\)b) Tj ET\nendstream\n"
    got = files.read_pdfs(spark.createDataFrame([("x.pdf", bytearray(pdf)), ("y.pdf", bytearray(b"zz"))], "path string, content binary")).orderBy("path").collect()
    assert got[0]["text"] == "Hello\na)b" and got[0]["title"] == "A title" and got[1]["error"]


def test_markdown():
    fields, title, parts = markdown.parse("---\ntitle: T\nn: 3\n---\n# One\nsoft\nline\n\n- a\n  - b\n1. c\n\n```py\nx = 1\n```\n## Two\n> q\n---\n| a | b |\n| - | - |\n")
    assert fields == {"title": "T"} and title == "T"
    assert [(p[0], p[2], p[4]) for p in parts] == [
        (0, "heading", "One"), (0, "paragraph", "soft line"), (0, "list_item", "a"), (0, "list_item", "b"), (0, "ordered_item", "c"), (0, "code", "x = 1"), (1, "heading", "Two"), (1, "quote", "q"),
        (1, "rule", ""), (1, "table_row", "a\tb"),
    ]
    assert markdown.parse("") == ({}, None, [])


def test_generation_errors_are_rows(spark):
    from leafmill.operators import generate as g

    def client():
        def call(provider, model, system, prompt, limit):
            if "bad" in prompt:
                raise TimeoutError("late")
            return prompt.upper(), 1, 2

        return call

    df = spark.createDataFrame([(1, "good"), (2, "bad")], "id int, p string")
    asked = g.requests(df, F.col("p"), F.lit("email"), F.lit("gpt-x"), {"audience": F.lit("all"), "tone": F.lit("dry")})
    got = g.generate(asked, "id", client).orderBy("id").collect()
    assert got[0]["content"] == "GOOD" and got[0]["total_tokens"] == 3 and got[1]["error"] == "TimeoutError: late"
    assert asked.first()["system"] == "Write a short message to all in a dry tone."


def test_batch(spark):
    df = spark.createDataFrame([("/a/~$x.docx", 5), ("b.PDF", 2048), ("noext", 3 * 1024**3), (None, None)], "name string, size long")
    got = df.select(batch.extension(F.col("name")), batch.reader(F.col("name")), batch.is_temporary(F.col("name")), batch.size_text(F.col("size"))).collect()
    assert [tuple(r) for r in got][:3] == [("docx", "word", True, "5 B"), ("pdf", "pdf", False, "2.00 KB"), (None, None, False, "3.00 GB")]
    assert batch.glob_pattern("a*[!b]?.x") == "^a.*[^b].\\.x$" and len(batch.ERRORS) == 14
