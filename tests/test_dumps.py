"""Dumps as cells and as files, cut by Spark's CSV parser."""

import pytest

from wikiloom.operators import harvest
from wikiloom.sources import dumps

UNTIDY = 'lang,"pre ""x""",prefix,http\nFrench,z,"x"y,200\nEnglish,,5" disc,404\r\nGerman,a,"two\nlines, ""q""",1\nshort\na,b,c,d,e\n'
ROWS = [("French", '"x"y', "200"), ("English", '5" disc', "404"), ("German", 'two\nlines, "q"', "1"), ("short", "", ""), ("a", "c", "d")]


def read(rows):
    return [(r.lang, r.prefix, r.http) for r in rows.orderBy("line_no").collect()]


def test_text_after_a_closing_quote_is_kept(spark):
    body = "lang,prefix,v,http\nFrench,\"x\"y,v,200\n"
    rows = harvest.dump_rows(spark.createDataFrame([("s", body)], "source string, body string"))
    assert read(rows) == [("French", '"x"y', "200")]


def test_cells(spark):
    rows = harvest.dump_rows(spark.createDataFrame([("s", UNTIDY), ("t", "prefix\nen")], "source string, body string"))
    assert read(rows.filter("source = 's'")) == ROWS
    assert read(rows.filter("source = 't'")) == [(None, "en", None)]
    assert rows.filter("source = 's'").first().columns == ["lang", 'pre "x"', "prefix", "http"]


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "s.csv").write_text(UNTIDY.replace("\r\n", "\n"))
    (tmp_path / "t.csv").write_text("prefix\n" + "".join(f"p{i}\n" for i in range(5000)))
    (tmp_path / "gone.csv").write_text("error: table name not set or unknown")
    (tmp_path / "empty.csv").write_text("")
    return str(tmp_path)


def test_files(spark, folder):
    rows = dumps.read_dumps(spark, folder)
    assert read(rows.filter("source = 's'")) == ROWS
    assert [(r.prefix, r.line_no) for r in rows.filter("source = 't'").orderBy("line_no").collect()] == [(f"p{i}", i) for i in range(5000)]
    assert {r.source for r in rows.select("source").distinct().collect()} == {"s", "t"}
    assert [r.source for r in dumps.missing_dumps(spark, folder).collect()] == ["gone"]


def test_files_equal_cells(spark, folder):
    cells = spark.createDataFrame([("s", UNTIDY.replace("\r\n", "\n"))], "source string, body string")
    files = dumps.read_dumps(spark, folder).filter("source = 's'")
    assert sorted(map(str, harvest.dump_rows(cells).drop("columns").collect())) == sorted(map(str, files.drop("columns").collect()))


def test_no_dumps(spark):
    assert harvest.dump_rows(spark.createDataFrame([], "source string, body string")).count() == 0
    only = spark.createDataFrame([("e", ""), ("n", None)], "source string, body string")
    assert harvest.dump_rows(only).count() == 0
