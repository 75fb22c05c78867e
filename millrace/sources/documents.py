"""Landed feed, release, item and search documents to candidate articles.

Readers take one row per landed document with its raw ``content``; broken parts become missing rows
or a failed status, never an exception.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.config import DEFAULT
from millrace.schemas import CANDIDATE_ARTICLE

ENTRY = (
    "title STRUCT<_VALUE: STRING>, link ARRAY<STRUCT<_VALUE: STRING, _href: STRING, _rel: STRING>>, "
    "pubDate STRING, published STRING, updated STRING, `dc:date` STRING"
)


def feed_date(value: Column) -> Column:
    """RFC 822 or ISO date to a UTC timestamp, else null."""
    text = F.regexp_replace(F.trim(value), r"^[A-Za-z]+,\s*", "")
    formats = ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm Z", "d MMM yyyy HH:mm z")
    return F.coalesce(F.try_to_timestamp(text), *[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def _entry_link(links: Column) -> Column:
    """Element text, or the alternate link, or the first link with an address."""
    texts = F.filter(F.transform(links, lambda x: F.trim(x["_VALUE"])), lambda t: F.length(t) > 0)
    main = F.filter(links, lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
    hrefs = F.transform(F.concat(main, links), lambda x: x["_href"])
    return F.coalesce(F.get(texts, F.lit(0)), F.get(F.filter(hrefs, lambda h: F.length(h) > 0), F.lit(0)))


def read_feed_entries(feeds: DataFrame) -> DataFrame:
    """One row per parsed entry of RSS or Atom documents (feed_url, feed_name, content).

    Entries are cut out first and parsed one by one, so a broken document keeps its sound entries.
    """
    entries = F.regexp_extract_all("content", F.lit(r"(?s)<(item|entry)[\s>].*?</\1>"), F.lit(0))
    parsed = feeds.select("feed_url", "feed_name", F.posexplode(entries).alias("pos", "xml")).withColumn(
        "entry", F.from_xml(F.col("xml"), ENTRY, {"mode": "PERMISSIVE"})
    )
    published = F.coalesce(
        feed_date(F.col("entry.pubDate")),
        feed_date(F.col("entry.published")),
        feed_date(F.col("entry.`dc:date`")),
        feed_date(F.col("entry.updated")),
    )
    return parsed.select(
        "feed_url",
        "feed_name",
        "pos",
        _entry_link(F.col("entry.link")).alias("url"),
        F.trim("entry.title._VALUE").alias("title"),
        published.alias("published_at"),
    ).filter((F.length("url") > 0) & (F.length("title") > 0))


def feed_candidates(feeds: DataFrame, collector: str = "rss") -> DataFrame:
    return read_feed_entries(feeds).select(
        "url",
        "title",
        "published_at",
        F.lit(collector).alias("collector_name"),
        F.col("feed_name").alias("source_hint"),
        "feed_url",
        F.col("pos").cast("long").alias("position"),
    )


def feed_status(feeds: DataFrame) -> DataFrame:
    """Success and entry count per feed: fails only if nothing could be read from broken content."""
    counts = read_feed_entries(feeds).groupBy("feed_url").agg(F.count("*").alias("entry_count"))
    has_entries = F.col("content").rlike(r"(?s)<(item|entry)[\s>].*?</\1>")
    whole = F.from_xml(F.col("content"), "_c STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_c"})
    sound = has_entries | (whole.isNotNull() & whole["_c"].isNull())
    return (
        feeds.select("feed_url", F.coalesce(sound, F.lit(False)).alias("succeeded"))
        .join(counts, "feed_url", "left")
        .select("feed_url", "succeeded", F.coalesce("entry_count", F.lit(0)).alias("entry_count"))
    )


def arxiv_candidates(feeds: DataFrame) -> DataFrame:
    """Paper feeds, one per category: titles lose line breaks; there is no feed to watch."""
    title = F.trim(F.regexp_replace("title", r"(?U)\s+", " "))
    return feed_candidates(feeds, "arxiv").withColumns({"title": title, "feed_url": F.lit(None).cast("string")})


def _json_text(document: Column, path: str) -> Column:
    """String member of a variant; other types give null."""
    value = F.try_variant_get(document, path, "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(document, path, "string"))


def _json_number(document: Column, path: str) -> Column:
    kind = F.schema_of_variant(F.try_variant_get(document, path, "variant"))
    number = kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    return F.when(number, F.try_variant_get(document, path, "double"))


def _candidate(rows: DataFrame, collector: str, url: Column, title: Column, published: Column, hint: Column) -> DataFrame:
    out = rows.select(
        url.alias("url"),
        title.alias("title"),
        published.alias("published_at"),
        F.lit(collector).alias("collector_name"),
        hint.cast("string").alias("source_hint"),
        F.lit(None).cast("string").alias("feed_url"),
        F.col("position").cast("long").alias("position"),
    )
    return out.filter((F.length("url") > 0) & (F.length(F.trim("title")) > 0))


def hacker_news_candidates(top: DataFrame, items: DataFrame, limit: int | None = DEFAULT.hacker_news_top_items) -> DataFrame:
    """Story ids of the landed list (content), the first ``limit`` if given, joined to items (item_id, content)."""
    ids = F.filter(F.transform(F.from_json("content", "array<string>"), lambda s: s.try_cast("long")), lambda i: i.isNotNull())
    wanted = top.select(F.posexplode(ids if limit is None else F.slice(ids, 1, limit)).alias("position", "item_id"))
    rows = wanted.join(items, "item_id").withColumn("j", F.try_parse_json("content"))
    j = F.col("j")
    date = F.timestamp_seconds(_json_number(j, "$.time"))
    return _candidate(rows, "hacker_news", _json_text(j, "$.url"), _json_text(j, "$.title"), date, F.lit(None))


def release_candidates(releases: DataFrame) -> DataFrame:
    """Release lists per repository (repository, content); drafts and pre-releases drop out."""
    rows = releases.select(
        "repository", F.posexplode(F.from_json("content", "array<string>")).alias("position", "raw")
    ).withColumn("j", F.try_parse_json("raw"))
    j = F.col("j")

    def truthy(path: str) -> Column:
        return F.coalesce(F.try_variant_get(j, path, "boolean"), F.lit(False))

    rows = rows.filter(~truthy("$.draft") & ~truthy("$.prerelease"))
    name, tag = _json_text(j, "$.name"), _json_text(j, "$.tag_name")
    label = F.when(F.length(F.trim(name)) > 0, name).otherwise(F.when(F.length(F.trim(tag)) > 0, tag))
    title = F.concat("repository", F.lit(" "), label)
    date = F.coalesce(*[F.try_to_timestamp(_json_text(j, f"$.{k}")) for k in ("published_at", "created_at")])
    return _candidate(rows, "github_releases", _json_text(j, "$.html_url"), title, date, F.col("repository"))


def search_candidates(responses: DataFrame) -> DataFrame:
    """Web-search responses (query, content): web.results[]; malformed structure gives no rows."""
    results = F.from_json(F.get_json_object("content", "$.web.results"), "array<string>")
    rows = responses.select("query", F.posexplode(results).alias("position", "raw")).withColumn(
        "j", F.try_parse_json("raw")
    )
    j = F.col("j")
    date = F.try_to_timestamp(_json_text(j, "$.page_age"))
    return _candidate(rows, "web_search", _json_text(j, "$.url"), F.trim(_json_text(j, "$.title")), date, F.col("query"))


def union_candidates(sources: list[DataFrame]) -> DataFrame:
    """Bag union of all collectors in the given order; a missing source is simply absent."""
    columns = [*CANDIDATE_ARTICLE.fieldNames(), "position"]
    tagged = [df.select(*columns).withColumn("source_order", F.lit(i)) for i, df in enumerate(sources)]
    return reduce(lambda a, b: a.unionByName(b), tagged)


def source_status(landed: dict[str, DataFrame], candidates: dict[str, DataFrame]) -> DataFrame:
    """(source, documents, unreadable, candidates, succeeded) of every source, in the order of ``landed``.

    ``landed``: documents with raw ``content``; ``candidates``: what each source gave.  A source fails if it has landed
    documents and none can be read (no markup, no JSON); the others keep their rows.
    """
    shown = F.trim("content")
    readable = F.coalesce(shown.startswith("<") | F.try_parse_json("content").isNotNull(), F.lit(False))
    parts = []
    for place, (name, documents) in enumerate(landed.items()):
        read = documents.agg(F.count("*").alias("documents"), F.count_if(~readable).alias("unreadable"))
        given = candidates[name].agg(F.count("*").alias("candidates"))
        one = [F.lit(place).alias("place"), F.lit(name).alias("source")]
        parts.append(read.select(*one, "documents", "unreadable").join(given.select(one[0], "candidates"), "place"))
    status = reduce(lambda a, b: a.unionByName(b), parts)
    return status.drop("place").withColumn("succeeded", (F.col("documents") == 0) | (F.col("unreadable") < F.col("documents")))
