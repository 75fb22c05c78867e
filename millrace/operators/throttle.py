"""Request rates: how many requests a key made in the window before each request.

The time axis is cut into pieces of one window length.  A request is seen by its own piece and the next one, so a
window partition is one piece of one key, whatever the share of the key in the log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.config import DEFAULT


def request_rates(
    events: DataFrame, limit: int = DEFAULT.throttle_max_requests, window_seconds: int = DEFAULT.throttle_window_seconds
) -> DataFrame:
    """(key, event_id, recent, over_limit): requests of the key in (at - window, at], itself included.

    ``events``: (key, event_id, at).  Requests of one instant count together.
    """
    width = window_seconds * 1_000_000
    timed = events.select("key", "event_id", F.unix_micros("at").alias("_at"))
    piece = F.floor(F.col("_at") / width)
    seen = timed.withColumn("_piece", F.explode(F.array(piece, piece + 1)))
    frame = Window.partitionBy("key", "_piece").orderBy("_at").rangeBetween(-width + 1, 0)
    own = F.col("_piece") == piece
    return (
        seen.withColumn("recent", F.count("*").over(frame))
        .filter(own)
        .select("key", "event_id", "recent", (F.col("recent") > limit).alias("over_limit"))
    )


def request_counts(events: DataFrame, window_seconds: int = DEFAULT.throttle_window_seconds, lateness: str = "10 minutes") -> DataFrame:
    """Streaming form: requests per key and tumbling window, with a watermark."""
    width = f"{window_seconds} seconds"
    counts = events.withWatermark("at", lateness).groupBy("key", F.window("at", width)).agg(F.count("*").alias("requests"))
    return counts.select("key", F.col("window.start").alias("window_start"), "requests")
