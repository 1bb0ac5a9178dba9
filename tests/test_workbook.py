import json

import pytest
from pyspark.sql import functions as F

from leafmill import __main__ as cli
from leafmill.operators import batch, engines
from leafmill.operators import workbook as w
from leafmill.sources import files, ooxml

SCHEMA = "workbook string, sheet string, row long, col int, value string"


@pytest.fixture(scope="module")
def book(spark):
    rows = [("/d/b.xlsx", "s", 0, 0, "a.b"), ("/d/b.xlsx", "s", 0, 1, "A.B"), ("/d/b.xlsx", "s", 1, 0, "axb $1"), ("/d/b.xlsx", "t", 0, 0, "5")]
    return w.Workbook(spark.createDataFrame(rows, SCHEMA))


def values(df):
    return {(r["sheet"], r["row"], r["col"]): r["value"] for r in df.collect()}


def test_rules(book):
    literal, loose = w.CellRule("1", "a.b", "$1\\"), w.CellRule("2", "a.b", "x", case_sensitive=False)
    assert values(w.apply_rules(book.cells, [literal])) == {("s", 0, 0): "$1\\", ("s", 0, 1): "A.B", ("s", 1, 0): "axb $1", ("t", 0, 0): "5"}
    assert values(book.replace([loose]).cells)["s", 0, 1] == "x"
    regex = w.CellRule("3", "a(.)b", "<$1>", "s!A1:A2", regex=True)
    assert values(book.replace([regex]).cells) == {("s", 0, 0): "<.>", ("s", 0, 1): "A.B", ("s", 1, 0): "<x> $1", ("t", 0, 0): "5"}
    assert {r["rule"]: r["cells"] for r in w.rule_hits(book.cells, [literal, loose, regex]).collect()} == {"1": 1, "2": 2, "3": 2}


def test_sheets(book, spark):
    new = book.write("s!A1:B1", spark.createDataFrame([(0, 0, "n"), (0, 5, "outside")], "row long, col int, value string"))
    assert values(new.cells) == {("s", 0, 0): "n", ("s", 1, 0): "axb $1", ("t", 0, 0): "5"}
    assert book.without_sheet("s").sheets().count() == 1 and book.with_sheet(book.read("t!A1").withColumn("sheet", F.lit("u"))).sheets().count() == 3
    m = book.metadata().first()
    assert (m["title"], m["sheets"], m["names"]) == ("b", 2, "s,t")
    got = book.report("t", [("c", "Column", "A1:A1", None), ("d", "Hologram", "A1", None)]).collect()
    assert len(got) == 1 and got[0]["first_row"] == 3 and got[0]["value"] == 5.0


def test_retry():
    calls, slept = [], []

    def flaky(x):
        calls.append(x)
        if len(calls) < 3:
            raise TimeoutError
        return x

    assert engines.with_retry(flaky, 4, sleep=slept.append)(7) == 7 and slept == [0.1, 0.2]
    with pytest.raises(ValueError):
        engines.with_retry(lambda: int("x"), 5, sleep=slept.append)()
    assert len(slept) == 2


def test_recognise(spark):
    def engine():
        def read(content, language):
            if content == b"bad":
                raise OSError("no image")
            return f"{language}:{len(content)}", 0.9 if language == "kor" else 0.4

        return read

    df = spark.createDataFrame([(1, bytearray(b"xx")), (2, bytearray(b"bad"))], "id long, content binary")
    got = engines.recognise(df, "id", engine, ("eng", "kor"), least=0.8).orderBy("id").collect()
    assert tuple(got[0]) == (1, "kor:2", 0.9, "kor", None) and got[1]["error"] == "OSError: no image"


def test_macros_and_text(spark):
    df = spark.createDataFrame([("a.xlsm", "High", False)], "name string, level string, signed boolean")
    assert df.select(batch.macro_warnings(batch.has_macros(F.col("name")), F.col("level"), F.col("signed"))).first()[0].count("\n") == 2
    with pytest.raises(Exception, match="blocked"):
        df.select(batch.macro_outcome(F.col("name"), F.lit("Block"))).collect()
    got = spark.range(1).select(batch.advanced_text(F.array(F.lit("one")), F.array(F.array(F.array(F.lit("a"), F.lit("b")))))).first()[0]
    assert got == "one\n--- Table 1 ---\na\tb\n--- End table ---"


def test_one_slide():
    archive = ooxml.parts(ooxml.make_slides([["x"], ["x"]]))
    changed, hits = ooxml.replaced(archive, [("x", "y")], slide=1)
    assert hits == 1 and list(changed) == ["ppt/slides/slide2.xml"]


def test_settings(tmp_path):
    s = files.set_setting(files.load_settings(None), "max_workers", "8")
    s = files.set_setting(s, "own.key", "v")
    assert s["max_workers"] == 8 and files.get_setting(s, "own.key") == "v" and files.get_setting(files.unset_setting(s, "own.key"), "own.key") is None
    files.save_settings(s, str(tmp_path / "s.yaml"))
    assert files.unset_setting(s, "max_workers")["max_workers"] == 4
    assert files.load_settings(str(tmp_path / "s.yaml"))["max_workers"] == 8


def test_commands(spark, tmp_path, capsys):
    d = tmp_path / "in"
    d.mkdir()
    (d / "a.docx").write_bytes(ooxml.make_word([("paragraph", None, "old text")], "T"))
    (d / "b.txt").write_text("HEAD\nold old", encoding="utf-8")
    (d / "c.pptx").write_bytes(b"broken")
    (d / "~$a.docx").write_bytes(b"lock")
    assert cli.main(["extract", f"file://{d}", str(tmp_path / "out"), "--format", "markdown"]) == 0
    told = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert (told["processed"], told["succeeded"], told["failed"]) == (3, 2, 1)
    assert (tmp_path / "out" / "a.md").read_text() == "# T\n\nold text\n\n" and (tmp_path / "out" / "b.md").read_text() == "## HEAD\n\nold old\n\n"
    rules = tmp_path / "r.yaml"
    rules.write_text("- {old: old, new: new}\n")
    assert cli.main(["replace", f"file://{d}", str(rules), str(tmp_path / "new"), "--dry-run"]) == 0 and not (tmp_path / "new").exists()
    assert cli.main(["replace", f"file://{d}", str(rules), str(tmp_path / "new")]) == 0
    told = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert told == {"files": 3, "replacements": 3, "errors": 1} and (tmp_path / "new" / "b.txt").read_text() == "HEAD\nnew new"
    md = tmp_path / "x.md"
    md.write_text("# A\ntext {{k}}\n## B\n- i\n")
    assert cli.main(["template", str(md), str(tmp_path / "y.md"), "--set", "k=v"]) == 0
    assert cli.main(["create", str(tmp_path / "y.md"), str(tmp_path / "y.pptx")]) == 0
    assert [t for _, t in ooxml.slides(ooxml.parts((tmp_path / "y.pptx").read_bytes()))] == ["A text v", "B i"]


def test_written_intermediates_can_be_released(spark):
    from leafmill import session

    session.release(spark)
    df = session.materialise(spark.range(5), "some")
    assert df.count() == 5 and session.release(spark) == 1 and session.release(spark) == 0
    with pytest.raises(Exception, match="not exist|NOT_EXIST|not found|PATH"):
        spark.read.schema("id long").parquet(df.inputFiles()[0]).count()
