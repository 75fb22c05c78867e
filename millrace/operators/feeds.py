"""Life cycle of discovered feeds: consecutive counters, disabling, discovery and revival.

Counters with resets are differences of running totals, so a feed with very many runs is spread
over tasks by the global order instead of being folded in one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.config import DEFAULT, FeedLifecycle
from millrace.operators.distributed import range_sorted, running_totals
from millrace.session import materialize

def _steps() -> dict[str, tuple[Column, Column]]:
    """Per counter: when it counts up and when it resets.

    A failure leaves the other two alone; scoped crawls say nothing about new entries.
    """
    ok, wide = F.col("succeeded"), F.col("succeeded") & ~F.col("scoped")
    return {
        "consecutive_failures": (~ok, ok),
        "consecutive_empty_fetches": (ok & (F.col("entry_count") == 0), ok & (F.col("entry_count") > 0)),
        "consecutive_no_new_entries": (wide & (F.col("new_entry_count") == 0), wide & (F.col("new_entry_count") > 0)),
    }


def consecutive_counters(runs: DataFrame, key: str = "feed_url", initial: bool = False) -> DataFrame:
    """Counter values after every run.  ``initial``: columns ``start_<counter>`` hold earlier values."""
    order = [F.col(key), F.col("run_id")]
    ups = {f"_up_{name}": up.cast("int") for name, (up, _reset) in _steps().items()}
    # One global sort carries all counters.
    rows = running_totals(range_sorted(runs.withColumns(ups), order), list(ups))
    rows = rows.withColumns({f"_{name}": F.col(f"before__up_{name}") + F.col(f"_up_{name}") for name in _steps()})
    # The total at the last reset is a running maximum: totals never fall.
    inside = Window.partitionBy("_task").orderBy("_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)  # one row per task
    first = rows.groupBy(key).agg(F.min("run_id").alias("_start"))
    rows = rows.join(first, key)
    marks, resets = {}, _steps()
    for name, (up, reset) in resets.items():
        entering = F.col(f"_{name}") - up.cast("int")
        at_start = F.when(F.col("run_id") == F.col("_start"), entering)
        marks[f"_m_{name}"] = F.when(reset, F.col(f"_{name}")).otherwise(at_start)
        marks[f"_r_{name}"] = F.when(reset, F.col("run_id"))
    rows = materialize(rows.withColumns(marks))
    tops = rows.groupBy("_task").agg(*[F.max(f"_m_{n}").alias(f"_t_{n}") for n in resets])
    tops = tops.select("_task", *[F.max(f"_t_{n}").over(whole).alias(f"_b_{n}") for n in resets])
    rows = rows.join(F.broadcast(tops), "_task")  # one row per task
    firsts = rows.groupBy(key).agg(*[F.min(f"_r_{n}").alias(f"_f_{n}") for n in resets])
    base = {n: F.greatest(F.max(f"_m_{n}").over(inside), F.col(f"_b_{n}")) for n in resets}
    rows = rows.withColumns({f"_z_{n}": base[n] for n in resets}).join(firsts, key)
    result = {}
    for name in resets:
        value = F.col(f"_{name}") - F.col(f"_z_{name}")
        if initial:
            untouched = F.col(f"_f_{name}").isNull() | (F.col("run_id") < F.col(f"_f_{name}"))
            value = value + F.when(untouched, F.col(f"start_{name}")).otherwise(0)
        result[name] = value.cast("int")
    return rows.select(*runs.columns, *[c.alias(n) for n, c in result.items()])


def apply_runs(feeds: DataFrame, runs: DataFrame, settings: FeedLifecycle = DEFAULT.feeds) -> DataFrame:
    """Feed rows after a series of crawls.

    One feed URL may belong to several rows; disabled rows and unknown URLs are skipped.  A row is
    disabled at its first run that reaches a limit, and later runs leave it alone.
    """
    live = feeds.filter(F.col("status") != "disabled")
    starts = [F.col(n).alias(f"start_{n}") for n in _steps()]
    hits = runs.join(live.select("domain", "feed_url", *starts), "feed_url")
    counted = materialize(consecutive_counters(hits, key="domain", initial=True))
    by_health = (F.col("consecutive_failures") >= settings.max_failures) | (
        F.col("consecutive_empty_fetches") >= settings.max_empty_fetches
    )
    stale = F.col("consecutive_no_new_entries") >= settings.max_no_new_entries
    ends = counted.groupBy("domain").agg(
        F.min(F.when(by_health | stale, F.col("run_id"))).alias("latch"), F.max("run_id").alias("last_run")
    )
    final = counted.join(ends, "domain").filter(F.col("run_id") == F.coalesce("latch", "last_run"))
    # Health is recorded first: the run that disables a row for it says nothing about new entries,
    # the counter stays where the run before left it.
    earlier = (
        counted.join(ends, "domain")
        .filter(F.col("run_id") < F.col("latch"))
        .groupBy("domain")
        .agg(F.max_by("consecutive_no_new_entries", "run_id").alias("_before"))
    )
    final = final.join(earlier, "domain", "left")
    before = F.coalesce("_before", "start_consecutive_no_new_entries")
    no_new = F.when(by_health, before).otherwise(F.col("consecutive_no_new_entries"))
    after = final.select(
        "domain",
        F.col("latch").isNotNull().alias("_off"),
        F.col("consecutive_failures").alias("_failures"),
        F.col("consecutive_empty_fetches").alias("_empty"),
        no_new.alias("_stale"),
    )
    off = F.coalesce("_off", F.lit(False))
    return feeds.join(after, "domain", "left").select(
        *[c for c in feeds.columns if c not in (*_steps(), "status", "enabled")],
        F.when(off, "disabled").otherwise(F.col("status")).alias("status"),
        (F.col("enabled") & ~off).alias("enabled"),
        F.coalesce("_failures", "consecutive_failures").alias("consecutive_failures"),
        F.coalesce("_empty", "consecutive_empty_fetches").alias("consecutive_empty_fetches"),
        F.coalesce("_stale", "consecutive_no_new_entries").alias("consecutive_no_new_entries"),
    )


def remaining_slots(feeds: DataFrame, settings: FeedLifecycle = DEFAULT.feeds) -> DataFrame:
    found = F.count_if(F.col("status") == "found")
    return feeds.agg(F.greatest(F.lit(0), F.lit(settings.max_feeds) - found).cast("long").alias("remaining"))


def discovery_targets(domains: DataFrame, feeds: DataFrame, now: Column, settings: FeedLifecycle = DEFAULT.feeds) -> DataFrame:
    """Best domains (source_domain, article_count) that are neither found nor cooling down."""
    slots = min(settings.domains_per_run, remaining_slots(feeds, settings).first()["remaining"])
    cutoff = now - F.expr(f"INTERVAL {settings.retry_days} DAYS")
    closed = feeds.filter((F.col("status") == "found") | (F.col("last_attempted_at") >= cutoff))
    open_domains = domains.join(closed.select(F.col("domain").alias("source_domain")), "source_domain", "left_anti")
    return open_domains.orderBy(F.desc("article_count"), "source_domain").limit(slots)


def record_discovery(feeds: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """Feed table after discovery results (domain, feed_url, status, article_count).

    A found row starts afresh with all counters at zero; other results keep the counters.
    """
    fresh = results.select("domain", *[F.col(c).alias(f"n_{c}") for c in ("feed_url", "status", "article_count")])
    joined = feeds.join(fresh, "domain", "full")
    tried, found = F.col("n_status").isNotNull(), F.coalesce(F.col("n_status") == "found", F.lit(False))

    def pick(name: str) -> Column:
        return F.when(tried, F.col(f"n_{name}")).otherwise(F.col(name)).alias(name)

    counters = [
        F.when(found, 0).otherwise(F.coalesce(n, F.lit(0))).cast("int").alias(n) for n in _steps()
    ]
    return joined.select(
        "domain",
        pick("feed_url"),
        pick("status"),
        pick("article_count"),
        F.when(tried, now).otherwise(F.col("last_attempted_at")).alias("last_attempted_at"),
        F.when(tried, found).otherwise(F.col("enabled")).alias("enabled"),
        *counters,
    )


def enabled_feeds(feeds: DataFrame) -> DataFrame:
    """Feeds to crawl: found, enabled, with an address."""
    return feeds.filter((F.col("status") == "found") & F.col("enabled") & (F.length("feed_url") > 0)).select(
        F.col("domain").alias("feed_name"), "feed_url"
    )
