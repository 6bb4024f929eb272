from __future__ import annotations

from maskwright.sources import csvs


def test_rows_and_tables():
    assert csvs.delimiter_of('a;b;"x,y,z,w"') == ";" and csvs.delimiter_of("a") == ","
    assert csvs.rows_of('\ufeffa,b\r\n"1\n2","q""r"\r\n , \r\n3\r\n') == [["a", "b"], ["1\n2", 'q"r'], ["3"]]
    assert csvs.table_of([["a", "b"], ["x|y"]]) == "| a | b |\n| --- | --- |\n| x\\|y |  |"
    assert csvs.table_of([]) == ""


def test_source(spark, tmp_path):
    (tmp_path / "a.csv").write_text("name;mail\nAna;a@b.com\n", encoding="utf-8")
    (row,) = csvs.read(spark, f"file://{tmp_path}/a.csv").collect()
    assert row.text == "| name | mail |\n| --- | --- |\n| Ana | a@b.com |" and row.warnings == []
    given = spark.createDataFrame([(1, None), (2, "")], "id int, content string")
    assert [r.text for r in csvs.from_table(given).collect()] == ["", ""]
