"""Hand-written documents: feeds, items, releases, search, lists, pages, URLs, rules, sinks."""

import time
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions.text import clean_tags, detect_language, language_tag, published_at, translated_title
from millrace.functions.urls import normal_form, resolve_canonical, unsafe_reason
from millrace.operators import classify as C
from millrace.operators.ingest import newest, search_queries
from millrace.plans.dedup import deduplicate
from millrace.plans.enrich import analyze_changed, embed_changed
from millrace.sources import documents as S
from millrace.sources.pages import extract_articles, feed_links, without_site_name
from millrace.sources.sinks import replace_users, upsert
from millrace.sources.url_list import first_url, read_url_lines, screen_registrations

URLS = [
    ("HTTPS://Example.COM:443/a/?b=2&a=1&utm_source=x#top", "https://example.com/a?a=1&b=2"),
    ("http://user:pw@example.com:8080/", "http://example.com:8080/"),
    ("http://example.com", "http://example.com/"),
    ("https://example.com/a//", "https://example.com/a"),
    ("https://example.com/?ref=1&Fbclid=2&q=", "https://example.com/?q="),
    ("  mailto:x@example.com ", "mailto:x@example.com"),
    ("http://example.com:99999/x", "http://example.com:99999/x"),
    ("http://[::1]/x", "http://::1/x"),
    ("https://example.com/p?x=a%20b&y=%7E*", "https://example.com/p?x=a+b&y=~%2A"),
]


@pytest.mark.parametrize(("raw", "want"), URLS)
def test_normal_form(raw, want):
    assert normal_form(raw) == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b", "utm_x", "ref", "q"]), st.text("xyz &=", max_size=4)), max_size=6))
def test_normal_form_ignores_order_and_tracking(pairs):
    from urllib.parse import urlencode

    base = normal_form("https://h.example/p?" + urlencode(pairs))
    kept = [p for p in pairs if p[0] in "abq"]
    assert base == normal_form("https://H.example/p/?" + urlencode(kept[::-1]) + "#f")
    assert normal_form(base) == base


def test_canonical_and_safety(spark):
    links = [("https://a.example/x", h) for h in ("/y?utm_a=1", "https://evil.example/y", None, "", "http://[bad")]
    found = spark.createDataFrame(links, "u string, h string").select(resolve_canonical("u", "h")).collect()
    assert [r[0] for r in found] == ["https://a.example/y"] + ["https://a.example/x"] * 4
    assert [unsafe_reason(u) for u in ("ftp://a/b", "http://10.0.0.1/", "http://169.254.169.254/x", "http://[::1]/", "http://8.8.8.8/", "http://a.example")] == [
        "scheme", "address", "address", "address", None, None,
    ]


def test_first_url():
    cases = {
        "see [t](https://e.example/a_(b)) now": "https://e.example/a_(b)",
        "x <http://e.example/?ids[]=1>.": "http://e.example/?ids[]=1",
        "読む https://e.example/x。": "https://e.example/x",
        "no :// here but ftp://e.example": "ftp://e.example",
        "http://... then https://e.example!": "https://e.example",
        "plain": None,
        "1+http://e.example": "http://e.example",
        "(http://e.example/a://b)": "http://e.example/a://b",
        "a://] b://c": "b://c",
    }
    assert {line: first_url(line) for line in cases} == cases


def test_first_url_is_linear():
    start = time.perf_counter()
    assert first_url("a" * 400_000) is None
    assert first_url("://" * 100_000) is None
    assert time.perf_counter() - start < 2


def test_feeds(spark):
    rss = """<?xml version="1.0"?><rss><channel><title>c</title>
      <item><title> One &amp; two </title><link>https://e.example/1</link><pubDate>Mon, 29 Jan 2024 10:00:00 +0900</pubDate></item>
      <item><title><![CDATA[Three <b>]]></title><link>https://e.example/3</link></item>
      <item><title>  </title><link>https://e.example/4</link></item><item><title>no link</title></item></channel></rss>"""
    atom = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><title type="html">A
       b</title><link rel="self" href="https://e.example/self"/><link rel="alternate" href="https://e.example/a"/>
       <updated>2024-01-02T03:04:05Z</updated></entry></feed>"""
    broken = "<rss><channel><item><title>kept</title><link>https://e.example/k</link></item><item><title>lost"
    docs = [("u1", "n1", rss), ("u2", "n2", atom), ("u3", "n3", broken), ("u4", "n4", "<html><p>no feed"), ("u5", "n5", "<rss><channel/></rss>"), ("u6", "n6", None)]
    feeds = spark.createDataFrame(docs, "feed_url string, feed_name string, content string")
    rows = {r["url"]: (r["title"], r["published_at"]) for r in S.feed_candidates(feeds).collect()}
    assert rows == {
        "https://e.example/1": ("One & two", datetime(2024, 1, 29, 1)),
        "https://e.example/3": ("Three <b>", None),
        "https://e.example/a": ("A\n       b", datetime(2024, 1, 2, 3, 4, 5)),
        "https://e.example/k": ("kept", None),
    }
    assert [r["title"] for r in S.arxiv_candidates(feeds.filter("feed_url = 'u2'")).collect()] == ["A b"]
    status = {r["feed_url"]: (r["succeeded"], r["entry_count"]) for r in S.feed_status(feeds).collect()}
    assert status == {"u1": (True, 2), "u2": (True, 1), "u3": (True, 1), "u4": (False, 0), "u5": (True, 0), "u6": (False, 0)}


def test_json_sources(spark):
    top = spark.createDataFrame([("[3, 1, \"x\", 2, 9]",)], "content string")
    items = spark.createDataFrame(
        [(1, '{"url": "https://e/1", "title": "one", "time": 1700000000}'), (2, '{"title": "ask"}'), (3, '{"url": "https://e/3", "title": "three", "time": "soon"}'), (9, "broken")],
        "item_id long, content string",
    )
    rows = {r["url"]: (r["position"], r["published_at"]) for r in S.hacker_news_candidates(top, items).collect()}
    assert rows == {"https://e/3": (0, None), "https://e/1": (1, datetime(2023, 11, 14, 22, 13, 20))}
    releases = spark.createDataFrame(
        [("o/r", '[{"html_url": "https://e/r1", "name": " ", "tag_name": "v1", "created_at": "2024-01-01T00:00:00Z"}, {"html_url": "https://e/r2", "name": "n", "draft": true}, 5]'), ("o/s", "{}")],
        "repository string, content string",
    )
    assert [(r["url"], r["title"], r["published_at"]) for r in S.release_candidates(releases).collect()] == [("https://e/r1", "o/r v1", datetime(2024, 1, 1))]
    found = spark.createDataFrame(
        [("q", '{"web": {"results": [{"url": "https://e/s", "title": " t ", "page_age": "2024-01-02T03:04:05"}, {"url": 7, "title": "x"}, "no"]}}'), ("q2", '{"web": 3}'), ("q3", "nope")],
        "query string, content string",
    )
    assert [(r["url"], r["title"], r["published_at"], r["source_hint"]) for r in S.search_candidates(found).collect()] == [("https://e/s", "t", datetime(2024, 1, 2, 3, 4, 5), "q")]


def test_url_list_screening(spark):
    text = "# head\nhttps://e.example/a\nhttps://e.example/a/?utm_source=x\nftp://e.example/f\nhttps://e.example/known\n" + "https://e.example/" + "x" * 3000
    lists = spark.createDataFrame([(1, text)], "list_id long, content string")
    known = spark.createDataFrame([("https://e.example/known",)], "normalized_url string")
    rows = {r["line_number"]: r["status"] for r in screen_registrations(read_url_lines(lists), known).collect()}
    assert rows == {2: "created", 3: "duplicate", 4: "bad_scheme", 5: "duplicate", 6: "too_long"}


PAGE = """<!DOCTYPE html><html lang="ja"><head><title>Deep dive | My Site</title><meta property="og:site_name" content="my site">
<link rel="canonical" href="/deep?utm_source=x"><meta property="article:published_time" content="2024-01-02T03:04:05+09:00">
<meta name="author" content="Someone"></head><body><nav>menu words</nav><script>var t = "</p> evil";</script>
<article><h1>Deep dive</h1><p onclick="x()">{0}<p>unclosed{0}</article><footer>foot</footer></body></html>"""


def test_pages(spark):
    html = PAGE.format("Useful sentence about engines. " * 5)
    pages = spark.createDataFrame([("https://e.example/x", html), ("https://e.example/short", "<title>t</title><p>tiny</p>"), ("https://e.example/none", None)], "url string, html string")
    rows = {r["url"]: r for r in extract_articles(pages).collect()}
    good = rows["https://e.example/x"]
    assert (good["title"], good["canonical_url"], good["language"], good["author"]) == ("Deep dive", "https://e.example/deep", "ja", "Someone")
    assert good["published_at"] == datetime(2024, 1, 1, 18, 4, 5) and good["error_reason"] is None
    assert "evil" not in good["body"] and "menu" not in good["body"] and "unclosed" in good["body"]
    assert rows["https://e.example/short"]["error_reason"] == "no_body"
    assert without_site_name("A - B - Site", ["site"]) == "A - B" and without_site_name("Site - A", ["site"]) == "Site - A"
    links = "".join(f'<link rel="alternate" type="application/rss+xml" href="/{i}">' for i in range(8))
    home = spark.createDataFrame([("e.example", "https://e.example/", links)], "domain string, url string, html string")
    assert [r["feed_url"] for r in feed_links(home).orderBy("position").collect()] == [f"https://e.example/{i}" for i in range(5)]


def test_rules_and_fallback(spark):
    rules = spark.createDataFrame(
        [("E", "example.com", None, None, "official_blog", 0.9, False), ("Docs", "example.com", "/docs", None, "official_documentation", 1.0, False),
         ("Rel", "github.com", "/*/*/releases", "Org", "official_github_release", 0.9, False), ("Bad", "bad.example", None, None, "nonsense", 0.9, False)],
        "entity_name string, domain string, path_pattern string, github_org string, source_type string, authority_score double, verified boolean",
    )
    want = {
        "https://blog.example.com/docs/a": "official_documentation", "https://example.com/documentation": "official_blog",
        "https://notexample.com/docs": "unknown", "https://github.com/org/x/releases/tag": "official_github_release",
        "https://github.com/fork/x/releases": "unknown", "https://bad.example/": "unknown", "https://atmarkit.itmedia.co.jp/x": "tech_media",
        "https://tech.firm.example/": "company_tech_blog", "https://technology.firm.example/": "unknown",
        "https://firm.example/Techblog/1": "company_tech_blog", "nonsense": "unknown",
    }
    urls = spark.createDataFrame([(u,) for u in want], "url string")
    assert {r["url"]: r["source_type"] for r in C.classify_sources(urls, rules).collect()} == want
    with pytest.raises(ValueError):
        C.seed_registry(rules.union(rules), rules)


def test_text_rules(spark):
    row = spark.range(1).select(
        language_tag(F.lit("EN_us")).alias("a"), language_tag(F.lit("x-default")).alias("b"), language_tag(F.lit("english")).alias("c"),
        published_at(F.lit("2024-01-02T00:00:00Z")).alias("d"), published_at(F.lit("2024-01-02 nonsense")).alias("e"), published_at(F.lit("soon")).alias("f"),
        F.array_join(clean_tags(F.array(F.lit(" a\x00 "), F.lit("a"), F.lit(""), F.lit("b"))), ",").alias("g"),
        translated_title(F.lit("T"), F.lit("T"), F.lit("en")).alias("h"), translated_title(F.lit("U"), F.lit("T"), F.lit("en")).alias("i"),
        detect_language(F.lit("これは日本語の文章です。技術の話をします。とても長い文章が続いています。もう少し続きます。")).alias("j"),
        detect_language(F.lit("the cat is on the mat and it was there for all of the day")).alias("k"), detect_language(F.lit("short")).alias("l"),
    ).first()
    assert tuple(row) == ("en", None, None, datetime(2024, 1, 2), datetime(2024, 1, 2), None, "a,b", None, "U", "ja", "en", None)


def test_queries_and_cap(spark):
    terms = spark.createDataFrame([(["topic", " "], ["Go", "Rust"], "fr-CA"), ([], [], "en"), (["solo"], [], None)], "topics array<string>, technologies array<string>, language string")
    rows = [r["queries"] for r in search_queries(terms, F.col("language")).collect()]
    assert rows[0] == ["Go topic 解説", "Go topic 入門", "Rust topic 解説", "Rust topic 入門", "Go topic guide", "Go topic release", "Rust topic guide", "Rust topic release", "Go topic", "Rust topic"]
    assert rows[1] == [] and rows[2] == ["solo 解説", "solo 入門", "solo guide", "solo release"]
    cands = spark.createDataFrame([("u1", None, 0, 0), ("u2", datetime(2024, 1, 1), 0, 1), ("u3", datetime(2024, 1, 2), 0, 2)], "url string, published_at timestamp, source_order int, position long")
    cands = cands.withColumns({"feed_url": F.lit(None).cast("string"), "source_hint": F.lit(None).cast("string")})
    assert [r["url"] for r in newest(cands, 2).collect()] == ["u3", "u2"] and newest(cands, 0).count() == 0


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "prefs")
    first = spark.createDataFrame([(u, "t", 1.0) for u in range(20)], "user_id long, topic string, w double")
    upsert(first, path, ["user_id", "topic"])
    upsert(spark.createDataFrame([(3, "t", 9.0), (3, "s", 2.0)], first.schema), path, ["user_id", "topic"])
    rows = {(r["user_id"], r["topic"]): r["w"] for r in spark.read.parquet(path).collect()}
    assert len(rows) == 21 and rows[3, "t"] == 9.0 and rows[4, "t"] == 1.0
    users = spark.createDataFrame([(3,), (4,), (50,)], "user_id long")
    replace_users(spark.createDataFrame([(4, "new", 5.0)], first.schema), users, path)
    rows = {(r["user_id"], r["topic"]): r["w"] for r in spark.read.parquet(path).collect()}
    assert len(rows) == 19 and rows[4, "new"] == 5.0 and (3, "t") not in rows and rows[5, "t"] == 1.0


def test_enrichment(spark):
    rows = spark.createDataFrame(
        [(1, "T", "the body of the article is here for you", "h1", None, None, None, None), (2, "T", "b", "h2", [0.5], "h2", "s", "h2")],
        "article_id long, title string, body string, body_hash string, embedding array<float>, embedded_body_hash string, summary string, analyzed_body_hash string",
    ).withColumn("language", F.lit("en-GB"))
    embedded = embed_changed(rows).collect()
    assert [(r["article_id"], len(r["embedding"])) for r in embedded] == [(1, 1024)]
    assert sum(x * x for x in embedded[0]["embedding"]) == pytest.approx(1.0, abs=1e-5)
    done = analyze_changed(rows).collect()
    assert [(r["article_id"], r["analysis_status"], r["language"]) for r in done] == [(1, "completed", "en")]

    def broken(text):
        raise TimeoutError

    failed = analyze_changed(rows, broken).first()
    assert (failed["analysis_status"], failed["error"], failed["attempts"], failed["analyzed_body_hash"]) == ("failed", "TimeoutError", 3, None)


def test_failing_judge_means_duplicate(spark):
    now = datetime(2024, 1, 31)
    rows = [(i, "https://e.example/a", "https://e.example/a", f"title number {i}", "body", f"h{i}", 0.9 - i / 100, "tech_media", "research", 0.8, now, now, False, None, None, None) for i in range(4)]
    df = spark.createDataFrame(
        rows,
        "article_id long, canonical_url string, original_url string, title string, body string, body_hash string, source_authority double, "
        "source_type string, content_type string, technical_quality double, published_at timestamp, fetched_at timestamp, is_dead boolean, "
        "judged_body_hash string, has_unique_value boolean, event_id string",
    ).withColumn("embedding", F.lit(None).cast("array<float>"))

    def broken(title, body):
        raise TimeoutError

    run = deduplicate(df, F.lit(now), broken)
    rows = {r["article_id"]: (r["duplicate_of"], r["duplicate_penalty"]) for r in run.decisions.collect()}
    assert rows == {0: (None, 0.0), 1: (0, 1.0), 2: (0, 1.0), 3: (0, 1.0)}
    counters = run.counters.first()
    assert (counters["judged"], counters["duplicates"], counters["limit_reached"]) == (2, 3, False)
    run = deduplicate(df, F.lit(now), lambda title, body: title.endswith("1"))
    assert {r["article_id"] for r in run.decisions.filter("duplicate_of is null").collect()} == {0, 1}
    assert len({r["event_id"] for r in run.decisions.collect()}) == 1


def test_crawl_and_stories_past_the_caps(spark):
    from catalog import all_queries

    rows = {n: all_queries()[n](spark, "/root/testdata/sf0.01").count() for n in ("crawl_enqueued_capped", "story_items_capped", "crawl_enqueued", "story_items")}
    assert rows["crawl_enqueued"] > rows["crawl_enqueued_capped"] == 50 and rows["story_items"] > rows["story_items_capped"]


def test_embeddings_equal_a_plain_count_of_hashed_grams(spark):
    import numpy as np
    import pandas as pd

    from millrace.plans.enrich import DIMENSIONS, embed_changed

    rows = [(1, "A Title", "one two one", "h1", None, None), (2, None, "b", "h2", None, None), (3, "t", "same", "h3", [1.0], "h3"), (4, "t", "new", "h4", [1.0], "old"), (5, "", "", "h5", None, None)]
    articles = spark.createDataFrame(rows, "article_id long, title string, body string, body_hash string, embedding array<double>, embedded_body_hash string")
    got = {r.article_id: r for r in embed_changed(articles).collect()}
    assert set(got) == {1, 2, 4, 5} and all(got[r[0]].embedded_body_hash == r[3] for r in rows if r[0] in got)
    for article, title, body, *_ in rows:
        if article in got:
            words = "\n\n".join(x for x in (title, body) if x is not None).lower().split()
            want = np.zeros(DIMENSIONS)
            for gram in [*words, *map(" ".join, zip(words, words[1:]))]:
                code = int(pd.util.hash_array(np.array([gram, ""], dtype=object), categorize=False)[0])
                want[code % DIMENSIONS] += 1.0 if code >> 63 else -1.0
            norm = np.linalg.norm(want)
            assert np.allclose(got[article].embedding, want / norm if norm else want, atol=1e-6), article
