"""Operators on small hand-made tables, and independence of the number of partitions."""

import pytest
from pyspark.sql import functions as F

from gneiss.functions import tokens as tk
from gneiss.operators import sections as sc
from gneiss.operators import spatial as sp
from gneiss.operators import tables as tb
from gneiss.plans import codec as cd
from gneiss.sources import blocks as bl
from gneiss.streaming import windows as sw


def table(spark, rows):
    return spark.createDataFrame([("t", i, *r) for i, r in enumerate(rows)], "t string, i int, a string, b string, c string")


@pytest.mark.parametrize("parts", [1, 7])
def test_codes_round_trip(spark, parts):
    rows = [("a" if i == 3 else ["Germany", "United States", "France", "Spain"][i % 4], f"unique {i}", "same value") for i in range(60)]
    cells = tb.to_cells(table(spark, rows).repartition(parts), ["a", "b", "c"], ["t"], ["i"])
    books = tb.codebooks(cells, ["t"])
    got = [(r.col, r.code, r.value) for r in books.orderBy("ci", "value").collect()]
    assert [x[0] for x in got] == ["a"] * 5 and "a" not in [x[1] for x in got]  # the literal cell "a" is left out
    back = tb.decode(tb.encode(cells, books, ["t"]), books, ["t"])
    assert back.exceptAll(cells).count() == 0 and cells.exceptAll(back).count() == 0


def test_constants_and_ditto(spark):
    rows = [("x", "", "1"), ("x", "y", "1"), ("x", "y", "2"), ("x", "y", None)]
    t = table(spark, rows)
    assert [(r.col, r.value) for r in tb.constant_columns(t, ["a", "b", "c"], ["t"]).collect()] == [("a", "x")]
    long = table(spark, [("value one", "^", "z"), ("value one", "^", "z"), ("value one", "w", "")])
    e = tb.elide_repeats(long, ["a", "b", "c"], ["t"], ["i"])
    assert [r.a for r in e.orderBy("i").collect()] == ["value one", "^", "^"]
    d = tb.restore_repeats(e, ["a", "b", "c"], ["t"], ["i"])
    assert d.exceptAll(long).count() == 0


def test_code_names(spark):
    got = [r[0] for r in spark.range(0, 18000).select(tb.code_name(F.col("id"))).collect()]
    assert got[:2] == ["a", "b"] and got[26] == "aa" and got[701] == "zz" and got[702] == "aaa" and len(set(got)) == len(got)


def test_units(spark):
    t = table(spark, [("$5", "5%", "1"), ("$-7", "", "2"), ("-$3", "6%", "3"), ("$1", "9%", "x")])
    cells = tb.to_cells(t, ["a", "b", "c"], ["t"], ["i"])
    assert {(r.col, r.mark) for r in tb.unit_marks(cells, ["t"]).collect()} == {("a", "$"), ("b", "%")}
    got = {(r.row, r.col): r.value for r in tb.hoist_units(cells, ["t"]).collect()}
    assert got[1, "a($)"] == "-7" and got[2, "a($)"] == "-3" and got[0, "b(%)"] == "5" and got[3, "c"] == "x"


def test_sections(spark):
    doc = bl.read_markdown("# T\n\nintro words\n\n## A\n\none two\n\n### B\n\nthree\n\n## C\n\nfour")
    b = bl.parsed_blocks(spark.createDataFrame([(1, "# T\n\nintro words\n\n## A\n\none two\n\n### B\n\nthree\n\n## C\n\nfour")], "doc_id long, md string"), bl.read_markdown, "doc_id", "md")
    got = [(r.section, r.title, r.tokens) for r in sc.skeleton(b).orderBy("section_pos").collect()]
    assert got == [("0", "(preamble)", 2), ("1", "A", 2), ("1.1", "B", 1), ("2", "C", 1)]
    assert [r.text for r in sc.expand(b, ["1"]).orderBy("pos").collect()] == ["A", "one two", "B", "three"]
    assert cd.encode_documents(b).first().dense == cd.encode(doc)


def test_borderless_table(spark):
    rows = [("words", i, x, 20.0 + 16 * i, x + 30, 30.0 + 16 * i, f"r{i}c{j}") for i in range(9) for j, x in enumerate([60.0, 150.0, 260.0, 330.0, 430.0])]
    w = spark.createDataFrame([(p, k, x0, y0, x1, y1, t) for k, (p, _, x0, y0, x1, y1, t) in enumerate(rows)], "page string, id int, x0 double, y0 double, x1 double, y1 double, text string")
    g = sp.borderless_tables(w, ["page"])
    assert g.count() == 45 and g.select("anchor").distinct().count() == 5 and g.select("row").distinct().count() == 9


def test_headings_by_size(spark):
    s = spark.createDataFrame([("d", "Big", 20.0), ("d", "body text that is long", 10.0), ("d", "Mid", 13.6), ("d", "more body", 10.0)], "doc string, text string, size double")
    assert {r.text: r.level for r in sp.heading_levels(s, ["doc"]).collect()} == {"Big": 1, "Mid": 2, "body text that is long": None, "more body": None}


def test_stream_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = sw.event_windows(stream, late="3650 days").writeStream.outputMode("complete").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    batch, got = sw.event_windows(events).drop("total"), spark.table("windows").drop("total")
    assert got.exceptAll(batch).count() == 0 and batch.exceptAll(got).count() == 0


def test_counters(spark):
    d = spark.createDataFrame([("one two",), ("",), (None,)], "a string")
    assert [tuple(r) for r in d.select(tk.words(F.col("a")), tk.chars(F.col("a"))).collect()] == [(2, 2), (0, 0), (0, 0)]
    assert d.limit(1).select(tk.cheapest(tk.chars, F.lit("long text"), F.lit("ab"), F.lit("cd"))).first()[0] == "ab"


def test_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("# T\n\npara")
    (tmp_path / "b.csv").write_text("x,y\n1,2\n")
    (tmp_path / "c.bin").write_text("no")
    got = bl.read_files(spark, str(tmp_path))
    assert sorted(r.kind for r in got.collect()) == ["para", "table"]


def test_cli(tmp_path, capsys):
    from gneiss.__main__ import main

    f = tmp_path / "a.md"
    f.write_text("# T\n\n## A\n\ntext here\n\n## B\n\nmore")
    assert main(["convert", str(f)]) == 0 and "## A" in capsys.readouterr().out
    assert main(["verify", str(f)]) == 0 and main(["stats", str(f)]) == 0 and main(["convert", str(f), "--to", "skeleton"]) == 0
    assert main(["expand", str(f), "2"]) == 0 and "more" in capsys.readouterr().out
    assert main(["diff", str(f), str(f)]) == 0 and main(["convert", "nothing.md"]) == 1


def test_data_source(spark, tmp_path):
    from gneiss.sources.datasource import register

    register(spark)
    (tmp_path / "a.md").write_text("# T\n\npara\n\n- x\n- y")
    (tmp_path / "b.csv").write_text("x,y\n1,2\n")
    got = {r.kind: r for r in spark.read.format("docblocks").load(str(tmp_path)).collect()}
    assert set(got) == {"para", "list", "table"} and got["list"]["items"] == ["x", "y"] and got["table"]["rows"] == [["1", "2"]]
