"""Table functions for SQL: one text in, any number of rows out, joined with LATERAL."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from millrace.config import DEFAULT
from millrace.sources.pages import page_feed_links
from millrace.sources.url_list import LINE_BREAKS, first_url

_BREAKS = re.compile(LINE_BREAKS)


@udtf(returnType="line_number int, line string, url string")
class UrlLines:
    """``url_lines(content)``: every line of a text that holds a URL; nothing for null."""

    def eval(self, content: str) -> Iterator[tuple[int, str, str]]:
        for number, line in enumerate(_BREAKS.split(content) if content else [], 1):
            url = first_url(line)
            if url is not None:
                yield number, line, url


@udtf(returnType="position int, feed_url string")
class FeedLinks:
    """``feed_links(url, html)``: the first feed links that a home page announces for its own site."""

    def eval(self, url: str, html: str) -> Iterator[tuple[int, str]]:
        if url and html:
            yield from enumerate(page_feed_links(url, html)[: DEFAULT.feeds.links_per_domain], 1)


def register_table_functions(spark: SparkSession) -> None:
    """Make ``url_lines`` and ``feed_links`` callable from SQL in this session."""
    spark.udtf.register("url_lines", UrlLines)
    spark.udtf.register("feed_links", FeedLinks)
