"""Queries of pages on tables with odd titles and repeated addresses, against their SQL."""

import duckdb
import pytest
from corpusmill.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def odd_pages(spark, tmp_path_factory):
    """Two pages share an address, two others their body; titles hold references that are cut short or end with the title."""
    titles = ["a &amp; b", "c &amp;&amp", "&quot;d&quot &lt;", "e &am; &amp;lt; &copy;", "f", "f", "g &nosuch; &ampx;"]
    urls = ["http://h.org/1", "http://h.org/same", "http://h.org/3", "http://h.org/same", "http://h.org/5", "http://h.org/6", "http://h.org/7"]
    rows = [(k, u, f"<html><head><title>{t}</title></head><body>b</body></html>") for k, (u, t) in enumerate(zip(urls, titles), 3)]
    path = tmp_path_factory.mktemp("odd")
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"file:{path}/pages.parquet")
    return path


def same_as_sql(spark, path, name):
    frame = QUERIES[name](spark, str(path))
    with duckdb.connect() as con:
        con.sql(f"CREATE VIEW pages AS SELECT * FROM '{path}/pages.parquet/*.parquet'")
        want = con.sql(f"SELECT {', '.join(frame.columns)} FROM ({SQL[name]})").fetchall()
    got = [tuple(r) for r in frame.collect()]
    assert want and sorted(map(repr, got)) == sorted(map(repr, want))


def test_titles_decode_whole_references_alone(spark, odd_pages):
    same_as_sql(spark, odd_pages, "page_titles")


def test_re_extraction_counts_each_page(spark, odd_pages):
    same_as_sql(spark, odd_pages, "re_extract_counts")


def test_hits_with_one_address_are_projected_once(spark, odd_pages):
    same_as_sql(spark, odd_pages, "hit_projection")
