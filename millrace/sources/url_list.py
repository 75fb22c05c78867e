"""URL lists: lines of landed text to URLs, screened for registration."""

from __future__ import annotations

import re
from collections import Counter
from itertools import pairwise

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.config import DEFAULT
from millrace.functions.urls import normalize_url
from millrace.operators.distributed import first_per_key

# Fixed values of the line format.
LINE_BREAKS = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
TRAILING_PUNCTUATION = ".,;:!?。、！？；："
CLOSED_BY = {"(": ")", "[": "]", "{": "}"}
_SCHEME_BACKWARDS = re.compile(r"[A-Za-z0-9+.-]*")
_BODY = re.compile(r"""[^\s"'<>]*""")
_BRACKET = re.compile(r"[()\[\]{}]")


def first_url(line: str | None) -> str | None:
    """First ``scheme://`` URL of a line, from the pieces between the marks; every piece is read once each way."""
    if not line or "://" not in line:
        return None
    pieces = line.split("://")
    after = len(pieces[0]) + 3
    for before, piece in pairwise(pieces):
        scheme = _SCHEME_BACKWARDS.match(before[::-1]).group()[::-1].lstrip("0123456789+.-")
        # A later mark may belong to the same URL: the body runs on in the line, not in the piece.
        body = _balanced(_BODY.match(line, after).group()).rstrip(TRAILING_PUNCTUATION) if scheme else ""
        if body:
            return f"{scheme}://{body}"
        after += len(piece) + 3
    return None


def _balanced(body: str) -> str:
    """The part before the first closing bracket that has no opening one of its kind."""
    surplus = Counter()
    for bracket in _BRACKET.finditer(body):
        sign = bracket.group()
        surplus[CLOSED_BY.get(sign, sign)] += 1 if sign in CLOSED_BY else -1
        if surplus[sign] < 0:
            return body[: bracket.start()]
    return body


@F.pandas_udf(T.StringType())
def url_of_line(lines: pd.Series) -> pd.Series:
    return lines.map(first_url)


def read_url_lines(documents: DataFrame) -> DataFrame:
    """(list_id, line_number, line, url) of every line with a URL; ``documents``: (list_id, content)."""
    lines = documents.select("list_id", F.posexplode(F.split("content", LINE_BREAKS)).alias("at", "line"))
    found = lines.select("list_id", (F.col("at") + 1).alias("line_number"), "line", url_of_line("line").alias("url"))
    return found.filter(F.col("url").isNotNull())


def screen_registrations(lines: DataFrame, registered: DataFrame, max_length: int = DEFAULT.max_url_length) -> DataFrame:
    """Status per line: bad_scheme, too_long, duplicate (in the list or already registered) or created.

    ``registered``: (normalized_url).  The first line of a URL in a list wins.
    """
    good_scheme = F.col("url").startswith("http://") | F.col("url").startswith("https://")
    checked = lines.withColumn(
        "error", F.when(~good_scheme, "bad_scheme").when(F.length("url") > max_length, "too_long")
    ).withColumn("normalized_url", F.when(F.col("error").isNull(), normalize_url("url")))
    valid = checked.filter(F.col("error").isNull())
    winners = first_per_key(
        valid.select("list_id", "normalized_url", "line_number"), ["list_id", "normalized_url"], F.col("line_number")
    ).withColumn("_first", F.lit(True))
    known = registered.select("normalized_url").distinct().withColumn("_known", F.lit(True))
    status = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(F.col("_first").isNull() | F.col("_known").isNotNull(), "duplicate")
        .otherwise("created")
    )
    return (
        checked.join(winners, ["list_id", "normalized_url", "line_number"], "left")
        .join(known, "normalized_url", "left")
        .select("list_id", "line_number", "url", "normalized_url", status.alias("status"))
    )
