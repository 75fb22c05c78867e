"""Life cycle of feeds as keyed state: crawls and discovery results of a domain arrive as a stream.

The state of a domain is its feed row.  A crawl moves its counters and disables it at a limit; a disabled row leaves crawls alone until
it is found again.  When a domain is disabled or not found, a processing-time timer is set to ``retry_days`` after its last
attempt; when it fires the domain is emitted as due for discovery.  An attempt in the meantime moves the timer.  Timers keep a
query busy: run it with a processing-time or once trigger, not until no data is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from millrace.config import DEFAULT, FeedLifecycle

#: Crawls have ``succeeded`` and its companions, discovery results ``status``; ``seq`` orders both within a domain.
EVENTS = (
    "seq long, domain string, at timestamp, succeeded boolean, entry_count long, new_entry_count long, scoped boolean, "
    "status string, feed_url string, article_count long"
)
FEED = (
    "domain string, feed_url string, status string, article_count long, last_attempted_at timestamp, enabled boolean, "
    "consecutive_failures int, consecutive_empty_fetches int, consecutive_no_new_entries int"
)
_STATE = "feed_url string, status string, article_count long, attempted long, enabled boolean, failures long, empty long, stale long"
OUTPUT = f"{FEED}, due boolean"
_DAY_MS = 86_400_000


def _micros(moment) -> int | None:
    return None if moment is None or pd.isna(moment) else pd.Timestamp(moment).value // 1000


class FeedProcessor(StatefulProcessor):
    def __init__(self, settings: FeedLifecycle) -> None:
        self.settings = settings

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.row = handle.getValueState("feed", _STATE)
        self.timer = handle.getValueState("timer", "at long")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        r = initialState.iloc[0]
        row = [
            r["feed_url"], r["status"], None if pd.isna(r["article_count"]) else int(r["article_count"]), _micros(r["last_attempted_at"]), bool(r["enabled"]),
            *(int(r[f"consecutive_{n}"]) for n in ("failures", "empty_fetches", "no_new_entries")),
        ]
        self.row.update(tuple(row))
        self._set_timer(row, timerValues)

    def _set_timer(self, row: list, timer_values) -> None:
        pending = self.timer.get()
        if pending:
            self.handle.deleteTimer(pending[0])
            self.timer.clear()
        if row[1] != "found" and row[3] is not None:
            # Attempts of the past are due at once.
            moment = max(row[3] // 1000 + int(self.settings.retry_days * _DAY_MS), timer_values.getCurrentProcessingTimeInMs() + 1)
            self.handle.registerTimer(moment)
            self.timer.update((moment,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        stored = self.row.get()
        row = list(stored) if stored else [None, None, None, None, False, 0, 0, 0]
        moved = False
        for event in pd.concat(list(rows)).sort_values("seq", kind="stable").itertuples():
            if event.status is not None:
                found = event.status == "found"
                count = None if pd.isna(event.article_count) else int(event.article_count)
                row = [event.feed_url, event.status, count, _micros(event.at), found, *([0, 0, 0] if found else row[5:])]
                moved = True
            elif row[1] is not None and row[1] != "disabled":
                moved |= self._crawl(row, event)
        if row[1] is None:
            return  # crawls of a domain nobody has discovered
        self.row.update(tuple(row))
        if moved:
            self._set_timer(row, timerValues)
        yield self._out(key[0], row, False)

    def _crawl(self, row: list, event) -> bool:
        """Apply one crawl; tells whether it disables the row."""
        s = self.settings
        if event.succeeded:
            row[5], row[6] = 0, 0 if event.entry_count > 0 else row[6] + 1
        else:
            row[5] += 1
        off = row[5] >= s.max_failures or row[6] >= s.max_empty_fetches
        if event.succeeded and not event.scoped and not off:
            row[7] = 0 if event.new_entry_count > 0 else row[7] + 1
            off = row[7] >= s.max_no_new_entries
        if off:
            row[1], row[4] = "disabled", False
        return off

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.timer.clear()
        yield self._out(key[0], list(self.row.get()), True)

    @staticmethod
    def _out(domain: str, row: list, due: bool) -> pd.DataFrame:
        attempted = None if row[3] is None else pd.Timestamp(row[3], unit="us")
        values = [domain, row[0], row[1], row[2], attempted, row[4], *row[5:], due]
        return pd.DataFrame([values], columns=[c.split()[0] for c in OUTPUT.split(", ")])

    def close(self) -> None:
        pass


def feed_changes(events: DataFrame, feeds: DataFrame, settings: FeedLifecycle = DEFAULT.feeds) -> DataFrame:
    """Feed row of every domain a batch touches, and rows with ``due`` when a domain may be tried again.

    ``events``: a stream as of ``EVENTS``; ``feeds``: the static table the state starts from.
    """
    return events.groupBy("domain").transformWithStateInPandas(FeedProcessor(settings), OUTPUT, "Update", "ProcessingTime", feeds.groupBy("domain"))
