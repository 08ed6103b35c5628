"""Every query against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from gneiss.plans import catalog


def plain(v):
    if pd.isna(v):
        return "null"
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return f"{v:.9g}"
    return str(v)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(plain, r)) for r in frame.astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, sf, duck, name):
    ours, theirs = catalog.QUERIES[name](spark, sf).toPandas(), duck.execute(catalog.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0


def test_entry_without_llm(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_section_ids_of_cut_references(spark, tmp_path):
    """Titles that were cut inside a character reference, as its SQL reads them."""
    heads = ["ores*** &amp;&amp;&amp", "a &lt", "&quot;b&quot", "c &amp;lt; d", "AT&T &am", "&", "e &lt;f&gt;"]
    pages = pd.DataFrame({"page_id": range(len(heads)), "html": [f"<html><body><h1>{h}</h1><p>x &amp y</p></body></html>" for h in heads]})
    spark.createDataFrame(pages).write.parquet(f"{tmp_path}/pages.parquet")
    duck = duckdb.connect()
    duck.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = rows(duck.execute(catalog.ORACLES["section_ids"]).df())
    assert rows(catalog.section_ids(spark, str(tmp_path)).toPandas()) == want
