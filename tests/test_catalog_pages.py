"""Catalog queries on small tables of pages against their SQL."""

import duckdb

from catalog import all_queries, all_sql


def test_titles_keep_references_as_the_sql_states(spark, tmp_path):
    titles = ["a &amp; b", "say &quot;x&quot; &lt;y&gt; &#39;z", "cut&amp", "R&D &amp;lt; &euro; &amp;amp;", "plain  one"]
    pages = [(i, f"https://a.example/{i}", f'<html lang="en"><head><title>{t}</title></head><body><p>text</p></body></html>') for i, t in enumerate(titles)]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    found = con.execute(f"SELECT url, language, title FROM ({all_sql()['page_titles']})").fetchall()
    rows = all_queries()["page_titles"](spark, str(tmp_path)).select("url", "language", "title").collect()
    assert sorted(map(tuple, rows)) == sorted(found)
