"""Every registered query with SQL against DuckDB, and all of them for a stable schema."""

from __future__ import annotations

import datetime
import decimal

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return float(v)
    return v.isoformat() if isinstance(v, (datetime.date, datetime.datetime)) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    want = duck.sql(entry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    left = sorted(str([plain(r[c]) for c in cols]) for r in got.collect())
    right = sorted(str([plain(v) for v in r]) for r in duck.sql(f"select {', '.join(cols)} from ({entry.oracle_sql()[name]})").fetchall())
    assert left == right


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ("html_to_text", "epub_text", "epub_files"))
def test_cut_references_stay_as_in_the_sql(spark, tmp_path, name):
    """Titles of larger tables are cut inside a reference."""
    c = duckdb.connect()
    cut = "<h1>a&amp;&amp</h1><p>b&amp;amp c&am d&quot; e&quot &copy;&middot; &copy & f</p><script>x && y</script>"
    c.sql(f"copy (select page_id, case when page_id % 2 = 0 then '{cut}' else html end as html from read_parquet('{SF}/pages.parquet')) to '{tmp_path}/pages.parquet' (format parquet)")
    c.sql(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet')")
    got = entry.queries()[name](spark, str(tmp_path))
    want = c.sql(f"select {', '.join(got.columns)} from ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
