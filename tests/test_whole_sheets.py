"""Queries over a sheet look at all of its rows, not at a head of fixed size."""

import pytest
from pyspark.sql import functions as F

from leafmill.functions import refs
from leafmill.operators import formula
from leafmill.plans import sheets

ROWS = 2500


@pytest.fixture(scope="module")
def long_part(spark, tmp_path_factory):
    """A folder with a `part` of more rows than any range in the queries once had; sizes are even but for the last row's."""
    d = str(tmp_path_factory.mktemp("long"))
    spark.range(ROWS).select(
        F.col("id").alias("p_partkey"), F.lit("n").alias("p_name"), F.when(F.col("id") < ROWS - 1, "Brand#11").otherwise("Brand#99").alias("p_brand"), F.lit("t").alias("p_type"),
        F.when(F.col("id") < ROWS - 1, 2).otherwise(1).alias("p_size"), (F.col("id") + 0.5).alias("p_retailprice"),
    ).write.parquet(f"{d}/part.parquet")
    return d


def test_whole_columns():
    box = refs.parse("S!C:A")
    assert (box.sheet, box.col, box.row, box.end_col, box.whole) == ("S", 0, 0, 2, True)
    with pytest.raises(ValueError):
        box.cells  # noqa: B018


def test_checks_reach_the_last_row(spark, long_part):
    got = {(r["rule"], r["message"]): (r["n"], r["first_row"]) for r in sheets.validate_cells(spark, long_part).collect()}
    assert got == {("List", "brand"): (1, ROWS - 1), ("WholeNumber", "price"): (ROWS, 0), ("Custom", "even"): (1, ROWS - 1)}


def _formulas_by_sql(con, part: str) -> tuple:
    return con.execute(f"SELECT round(sum(p_retailprice), 4), round(avg(p_size), 4), count(*) * 3.0, min(p_size), round(max(p_retailprice), 4), round(round(avg(p_size), 3) + 2, 4) FROM {part}").fetchone()


def test_formulas_reach_the_last_row(spark, con, sf, long_part):
    for d, part in ((sf, "part"), (long_part, f"'{long_part}/part.parquet/*.parquet'")):
        got = sheets.QUERIES["formulas"](spark, d).first()
        assert tuple(got[k] for k in ("total", "mean", "cells", "low", "high", "nested")) == pytest.approx(tuple(map(float, _formulas_by_sql(con, part))), rel=1e-9)


def test_whole_columns_in_formulas(spark):
    one = spark.createDataFrame([("w", "s", 0, 0, "1"), ("w", "s", 4, 0, "9"), ("w", "s", 1, 1, "x"), ("w", "t", 9, 0, "7")], "workbook string, sheet string, row long, col int, value string")
    asked = {"sum": "=SUM(A:A)", "count": "=COUNT(A:B)", "mean": "=AVERAGE(A:A)", "two": "=COUNT(A:A,B1:B2,3)", "both": "=AVERAGE(A:A,5)", "other": "=SUM(t!A:A)", "none": "=AVERAGE(D:D)"}
    got = formula.evaluate(one, asked, sheet="s").first()
    assert [got[k] for k in asked] == [10.0, 10.0, 2.0, 8.0, 2.5, 7.0, None]


def test_series_reaches_the_last_row(spark, con, sf, long_part):
    for d, part in ((sf, "part"), (long_part, f"'{long_part}/part.parquet/*.parquet'")):
        want = con.execute(f"SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS row, coalesce(p_brand, ''), p_retailprice FROM {part} ORDER BY row").fetchall()
        got = sheets.QUERIES["chart_series"](spark, d).orderBy("ordinal").collect()
        assert [(r["ordinal"], r["category"], r["value"]) for r in got] == want and {r["series"] for r in got} == {"price"}


def test_formulas_in_cells_of_two_workbooks(spark):
    rows = [("a", "s", 0, 0, "1"), ("a", "s", 1, 0, "x"), ("b", "s", 0, 0, "10"), ("b", "t", 0, 0, "7"), ("a", "s", 0, 1, "=A1+A2*2"), ("b", "s", 0, 1, "=A1+t!A1"), ("a", "s", 1, 1, "=B1"), ("a", "s", 2, 1, "=AVERAGE(A1:A2)"),
            ("a", "s", 3, 1, '=IF(A1=1,"yes","no")&LEN("abc")'), ("a", "s", 4, 1, "=SUM("), ("a", "s", 5, 1, "=TWICE(A1)"), ("a", "s", 6, 1, "=1/0"), ("a", "s", 7, 1, "=ROUND(-2.345,2)"), ("b", "s", 1, 1, "=MIN(C:C)"), ("b", "s", 2, 1, "=A1*TRUE")]
    cells = spark.createDataFrame(rows, "workbook string, sheet string, row long, col long, value string")
    formula.register("twice", lambda v: v * 2, lambda v: v * 2)
    try:
        got = {(r["workbook"], r["row"]): r["result"] for r in formula.sheet_formulas(cells).collect()}
        assert formula.evaluate(cells.where("workbook = 'b'"), {"x": "=TWICE(A1)"}, sheet="s").first()["x"] == 20.0
        per_book = {r["workbook"]: r["x"] for r in formula.evaluate(cells, {"x": "=A1"}, sheet="s").collect()}
    finally:
        formula.REGISTERED.clear()
    assert per_book == {"a": 1.0, "b": 10.0}
    want = {("a", 0): "1", ("b", 0): "17", ("a", 1): "0", ("a", 2): "0.5", ("a", 3): "yes3", ("a", 5): "2", ("a", 7): "-2.35", ("b", 1): "0", ("b", 2): "10"}
    assert {k: got[k] for k in want} == want
    assert got["a", 4].startswith("#ERROR") and got["a", 6] == "#ERROR: division by zero"
    assert formula.sheet_formulas(cells.where("row > 90")).count() == 0


def test_series_of_two_workbooks(spark):
    from leafmill.operators import charts

    cells = spark.createDataFrame([(w, "s", r, c, v) for w, x in (("a", "1"), ("b", "2")) for r, c, v in ((0, 0, "k"), (0, 1, x))], "workbook string, sheet string, row long, col int, value string")
    got = charts.series_data(cells, "n", "B1:B1", "A1:A1").collect()
    assert sorted((r["workbook"], r["category"], r["value"]) for r in got) == [("a", "k", 1.0), ("b", "k", 2.0)]


def test_progress_and_texts_in_slices(spark, monkeypatch):
    from leafmill.operators import cells as c

    monkeypatch.setattr(c, "SLICE_ROWS", 3)
    monkeypatch.setattr(c, "BLOCK_ROWS", 4)
    df = spark.createDataFrame([(k, k + 1) for k in range(40)], "chunk long, rows long")
    got = {r["chunk"]: (r["processed"], r["total"]) for r in c.progress(df).collect()}
    assert got == {k: ((k + 1) * (k + 2) // 2, 820) for k in range(40)}
    assert sorted((r["chunk"], r["row"]) for r in c.numbered(df, ["chunk"]).collect()) == [(k, k) for k in range(40)]
    one = c.from_table(df, ["rows"], F.col("chunk"), F.lit("s"))
    assert c.sheet_texts(one).first()["text"] == "".join(f"{k + 1}\n" for k in range(40)) and c.text_blocks(one).count() == 10


def test_shared_folder_is_asked_for_on_a_cluster():
    from types import SimpleNamespace

    from leafmill.session import shared_dir

    conf = SimpleNamespace(get=lambda *a: None)
    cluster = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="yarn", getConf=lambda: conf))
    with pytest.raises(RuntimeError):
        shared_dir(cluster)


def test_unreadable_workbooks_are_told(spark):
    from leafmill.sources import ooxml

    files = spark.createDataFrame([("bad.xlsx", b"no archive"), ("good.xlsx", ooxml.make_workbook({"s": [["1"]]}))], "path string, content binary")
    got = {r["workbook"]: (r["value"], r["error"] is None) for r in ooxml.read_cells(files).collect()}
    assert got == {"bad.xlsx": (None, False), "good.xlsx": ("1", True)}


def test_a_presentation_has_every_part_it_names():
    """Each relationship leads to a part, each part has a content type, and every slide reaches a master and a theme."""
    import posixpath
    from xml.etree import ElementTree as ET

    from leafmill.sources import ooxml

    archive = ooxml.parts(ooxml.make_slides([["a & b"], ["c"]], title="t", author="x"))
    named = {e.get("PartName") for e in ET.fromstring(archive["[Content_Types].xml"]) if e.get("PartName")}
    assert named == {f"/{n}" for n in archive if n.endswith(".xml") and not n.startswith("[")}
    reached = {}
    for name, xml in archive.items():
        ET.fromstring(xml)
        if name.endswith(".rels"):
            base = posixpath.dirname(posixpath.dirname(name))
            reached[name] = {posixpath.normpath(posixpath.join(base, e.get("Target"))) for e in ET.fromstring(xml)}
            assert reached[name] <= set(archive), name
    assert reached["ppt/slides/_rels/slide2.xml.rels"] == {"ppt/slideLayouts/slideLayout1.xml"} and "ppt/theme/theme1.xml" in reached["ppt/slideMasters/_rels/slideMaster1.xml.rels"]
    assert [t for _, t in ooxml.slides(archive)] == ["a & b", "c"] and ooxml.properties(archive)["title"] == "t"


def test_a_failing_batch_can_be_told(spark):
    import pandas as pd

    from leafmill.streaming import chunked

    def work(batch):
        if (batch["id"] >= 5).any():
            raise ValueError("too large")
        return batch.assign(error=None)

    got = chunked.each_chunk(spark.range(10).repartition(4), work, "id long, error string", failed=lambda b, e: pd.DataFrame({"id": b["id"], "error": str(e)})).collect()
    assert len(got) == 10 and all((r["error"] == "too large") or r["id"] < 5 for r in got) and any(r["error"] for r in got)


def test_rows_behind_the_watermark_are_dropped(spark, tmp_path):
    """A stream of three files: the second moves the watermark, and what the third brings from before it is too late."""
    import datetime as dt

    from leafmill.streaming import breaker, chunked

    at = lambda day, hour: dt.datetime(2024, 1, day, hour)
    schema = "ts timestamp, event_type string, value double"
    files = [[(at(1, 1), "view", 1.0), (at(1, 2), "view", 2.0)], [(at(5, 0), "view", 4.0)], [(at(1, 3), "view", 8.0), (at(4, 23), "view", 16.0), (at(9, 0), "view", 32.0)]]
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    for k, rows in enumerate(files):  # each is taken in before the next arrives
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = breaker.windowed_failures(chunked.folder_stream(spark, folder, spark.createDataFrame([], schema).schema, 1), "1 hour", "1 day")
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start(out).awaitTermination()
    got = {(r["start"].day, r["start"].hour): r["total"] for r in spark.read.parquet(out).collect()}
    assert got[1, 1] == 1.0 and got[1, 2] == 2.0 and got[4, 23] == 16.0 and got[5, 0] == 4.0 and (1, 3) not in got


def test_spans_of_a_line(spark):
    from leafmill.operators import markdown

    text = "**bold** and *thin* `a *b*` ![pic](p.png) [site](http://x) ~~old~~ end  \nnext"
    got = spark.createDataFrame([(text,), (None,)], "t string").select(F.explode(markdown.inlines(F.col("t"))).alias("s")).select("s.*").collect()
    assert [tuple(r) for r in got] == [("inline_code", "a *b*", None), ("image", "pic", "p.png"), ("link", "site", "http://x"), ("bold", "bold", None), ("italic", "thin", None), ("strikethrough", "old", None), ("line_break", "  ", None)]
