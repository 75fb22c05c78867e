"""Opinions, owned articles and preferences as keyed state of a feedback stream.

Every rule keeps what it needs in the state store: nothing is read again from the log, and a batch costs what it brings.

* opinions and owned articles: one value each per (user, article);
* preferences: per (user, topic) or (user, source) the counts of positive posts, the negative weight and the opinions on its
  articles in a map state, entry by entry in the store.  The few newest opinions, which decide the negative weight, are a value
  beside it; the map is read through only when one of them is removed.

Events of a key are taken in the order of ``seq`` inside a batch; batches must arrive in that order too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from heapq import nlargest

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from millrace.config import DEFAULT, DecaySettings, EngineConfig
from millrace.operators.preferences import source_keys, topic_keys
from millrace.streaming.state_table import StateTable

OPINION = "user_id long, article_id long, action string, created_at timestamp"
OWNED = "user_id long, article_id long, origin string, interest_weight double, created_at timestamp"
CHANGES = (
    "user_id long, article_id long, action string, opinion_at timestamp, origin string, interest_weight double, owned_at timestamp"
)
PREFERENCE = "user_id long, key string, positive_weight double, negative_weight double, effective_weight double"


def _in_order(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values("seq", kind="stable")


def _micros(moment) -> int:
    return pd.Timestamp(moment).value // 1000


def _moment(micros: int | None):
    return None if micros is None else pd.Timestamp(micros, unit="us")


class OpinionProcessor(StatefulProcessor):
    """Current opinion and owned row of one user and article."""

    def __init__(self, cfg: EngineConfig, ttl_ms: int | None) -> None:
        self.gains = {"good": ("good", cfg.feedback.good), "save": ("saved", cfg.feedback.save)}
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.opinion = handle.getValueState("opinion", "action string, at long", self.ttl_ms)
        self.owned = handle.getValueState("owned", "origin string, weight double, at long", self.ttl_ms)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        row = initialState.iloc[0]
        self.owned.update((row["origin"], float(row["interest_weight"]), _micros(row["created_at"])))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        opinion, owned = self.opinion.get(), self.owned.get()
        for event in _in_order(rows).itertuples():
            at = _micros(event.created_at)
            post = event.op == "post"
            opinion = (event.action, opinion[1] if opinion else at) if post else None
            gain = self.gains.get(event.action) if post else None
            if gain is None:
                owned = None if owned and owned[0] in ("good", "saved") else owned
            elif owned is None:
                owned = (*gain, at)
            elif owned[1] < gain[1]:
                owned = (*gain, owned[2])
        for state, value in ((self.opinion, opinion), (self.owned, owned)):
            if value is None:
                state.clear()
            else:
                state.update(tuple(value))
        action, first = opinion or (None, None)
        origin, weight, since = owned or (None, None, None)
        yield pd.DataFrame(
            {"user_id": [key[0]], "article_id": [key[1]], "action": [action], "opinion_at": [_moment(first)], "origin": [origin],
             "interest_weight": [weight], "owned_at": [_moment(since)]}
        )

    def close(self) -> None:
        pass


class PreferenceProcessor(StatefulProcessor):
    """Preference of one user for one key."""

    def __init__(self, settings: DecaySettings, cfg: EngineConfig, signed: bool, ttl_ms: int | None) -> None:
        self.settings, self.signed, self.ttl_ms = settings, signed, ttl_ms
        self.good, self.save = cfg.feedback.good, cfg.feedback.save

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.totals = handle.getValueState("totals", "good long, save long, negative double, written boolean", self.ttl_ms)
        self.opinions = handle.getMapState("opinions", "article long", "action string, at long", self.ttl_ms)
        # The newest opinions, newest first, as many as the window.
        self.newest = handle.getValueState("newest", "at array<long>, article array<long>, action array<string>", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        good, save, negative, written = self.totals.get() or (0, 0, 0.0, False)
        stored = self.newest.get()
        newest = list(zip(stored[0], stored[1], stored[2], strict=True)) if stored else []
        for event in _in_order(rows).itertuples():
            article, post = int(event.article_id), event.op == "post"
            before = self.opinions.getValue((article,)) if self.opinions.containsKey((article,)) else None
            if before is None and not post:
                continue
            at = before[1] if before else _micros(event.created_at)
            cached = any(a == article for _, a, _ in newest)
            newest = [n for n in newest if n[1] != article]
            if post:
                self.opinions.updateValue((article,), (event.action, at))
                newest = sorted([*newest, (at, article, event.action)], reverse=True)[: self.settings.recent_window]
            else:
                self.opinions.removeKey((article,))
                if cached:  # an older opinion moves up
                    every = ((v[1], k[0], v[0]) for k, v in self.opinions.iterator())
                    newest = nlargest(self.settings.recent_window, every)
            if post and event.action in ("good", "save"):
                good, save, written = good + (event.action == "good"), save + (event.action == "save"), True
                continue
            bad = sum(action == "bad" for _, _, action in newest)
            threshold = self.settings.bad_threshold
            value = (bad - threshold + 1) * self.settings.decay_step if bad >= threshold else 0.0
            written = written or value != negative
            negative = float(value)
        self.totals.update((int(good), int(save), float(negative), bool(written)))
        self.newest.update(tuple([n[i] for n in newest] for i in range(3)))
        if written:
            positive = good * self.good + save * self.save
            effective = positive - negative if self.signed else positive / (1.0 + negative)
            yield pd.DataFrame({"user_id": [key[0]], "key": [key[1]], "positive_weight": [positive], "negative_weight": [negative], "effective_weight": [effective]})

    def close(self) -> None:
        pass


def opinion_changes(events: DataFrame, owned: DataFrame, cfg: EngineConfig = DEFAULT, ttl_ms: int | None = None) -> DataFrame:
    """New opinion and owned row of every pair a batch touches; nulls where there is none left.  ``owned`` is where the state starts."""
    return events.groupBy("user_id", "article_id").transformWithStateInPandas(
        OpinionProcessor(cfg, ttl_ms), CHANGES, "Update", "ProcessingTime" if ttl_ms else "None", owned.groupBy("user_id", "article_id")
    )


def preference_changes(
    events: DataFrame, keys: DataFrame, settings: DecaySettings, signed: bool, cfg: EngineConfig = DEFAULT, ttl_ms: int | None = None
) -> DataFrame:
    """New preference rows of the (user, key) pairs a batch touches; ``keys``: static (article_id, key)."""
    return events.join(keys, "article_id").groupBy("user_id", "key").transformWithStateInPandas(
        PreferenceProcessor(settings, cfg, signed, ttl_ms), PREFERENCE, "Update", "ProcessingTime" if ttl_ms else "None"
    )


@dataclass(frozen=True)
class FeedbackTables:
    """What :func:`start_feedback_streams` keeps up to date."""

    opinions: StateTable
    owned: StateTable
    topics: StateTable
    sources: StateTable

    @staticmethod
    def at(spark: SparkSession, folder: str) -> FeedbackTables:
        def table(name: str, schema: str, keys: list[str]) -> StateTable:
            return StateTable(spark, f"{folder}/{name}", schema, keys)

        pair = ["user_id", "article_id"]
        named = [PREFERENCE.replace("key string", f"{n} string") for n in ("topic", "source_domain")]
        return FeedbackTables(
            table("article_feedback", OPINION, pair), table("user_articles", OWNED, pair),
            table("topic_preferences", named[0], ["user_id", "topic"]), table("source_preferences", named[1], ["user_id", "source_domain"]),
        )


def start_feedback_streams(
    events: DataFrame, articles: DataFrame, owned: DataFrame, folder: str, cfg: EngineConfig = DEFAULT, ttl_ms: int | None = None, **trigger
) -> list[StreamingQuery]:
    """Start the three queries of a feedback stream (seq, user_id, article_id, op, action, created_at) on tables in ``folder``.

    The table of owned articles starts as ``owned``.  ``trigger``: arguments of ``DataStreamWriter.trigger``.
    """
    tables = FeedbackTables.at(events.sparkSession, folder)
    if not tables.owned._folders("base", "upto="):
        owned.select("user_id", "article_id", "origin", "interest_weight", "created_at").write.mode("overwrite").parquet(f"{tables.owned.path}/base/upto=-1")

    def pairs(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        opinion = batch.select("user_id", "article_id", "action", F.col("opinion_at").alias("created_at"), F.col("action").isNull().alias("removed"))
        mine = batch.select("user_id", "article_id", "origin", "interest_weight", F.col("owned_at").alias("created_at"), F.col("origin").isNull().alias("removed"))
        tables.opinions.append(opinion, batch_id)
        tables.owned.append(mine, batch_id)
        batch.unpersist()

    def preferences(table: StateTable, name: str):
        def write(batch: DataFrame, batch_id: int) -> None:
            table.append(batch.withColumnRenamed("key", name).withColumn("removed", F.lit(False)), batch_id)

        return write

    work = {
        "pairs": (opinion_changes(events, owned, cfg, ttl_ms), pairs),
        "topics": (preference_changes(events, topic_keys(articles), cfg.topic_decay, False, cfg, ttl_ms), preferences(tables.topics, "topic")),
        "sources": (preference_changes(events, source_keys(articles), cfg.source_decay, True, cfg, ttl_ms), preferences(tables.sources, "source_domain")),
    }
    return [
        changes.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", f"{folder}/_checkpoints/{name}").trigger(**trigger).start()
        for name, (changes, write) in work.items()
    ]
