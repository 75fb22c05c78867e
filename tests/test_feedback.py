"""Decomposed feedback rules against an event-by-event replay."""

import random
from datetime import datetime, timedelta

import pytest

from millrace.config import DEFAULT
from millrace.operators import feedback as FB
from millrace.operators import preferences as P

START = datetime(2024, 1, 1)
GAIN = {"good": 0.8, "save": 0.5}


def make_log(seed, n=700, users=4, articles=12):
    rng = random.Random(seed)
    log = []
    for seq in range(n):
        user = 0 if rng.random() < 0.4 else rng.randrange(users)
        article = rng.randrange(articles)
        delete = rng.random() < 0.25
        # Some users are mostly negative, so penalties appear and vanish again.
        action = None if delete else rng.choices(["good", "save", "bad"], [1, 1, 8 if user % 2 else 3])[0]
        log.append((seq, user, article, "delete" if delete else "post", action, START + timedelta(minutes=seq)))
    return log


def replay(log, keys, settings, effective):
    opinions, prefs = {}, {}
    for seq, user, article, op, action, at in log:
        if op == "delete":
            if (user, article) not in opinions:
                continue
            del opinions[user, article]
        else:
            first = opinions.get((user, article), (None, at))[1]
            opinions[user, article] = (action, first)
        for key in keys[article]:
            positive, negative = prefs.get((user, key), (0.0, 0.0))
            if action in GAIN:
                prefs[user, key] = (positive + GAIN[action], negative)
                continue
            mine = [(at_, a, act) for (u, a), (act, at_) in opinions.items() if u == user and key in keys[a]]
            recent = sorted(mine, reverse=True)[: settings.recent_window]
            bad = sum(1 for r in recent if r[2] == "bad")
            new = (bad - settings.bad_threshold + 1) * settings.decay_step if bad >= settings.bad_threshold else 0.0
            if new != negative:
                prefs[user, key] = (positive, new)
    return opinions, {k: (p, n, effective(p, n)) for k, (p, n) in prefs.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_preferences_equal_replay(spark, seed):
    log = make_log(seed)
    topics = {a: {f"t{a % 3}", f"t{a % 5}"} for a in range(12)}
    events = spark.createDataFrame(
        log, "seq long, user_id long, article_id long, op string, action string, created_at timestamp"
    )
    articles = spark.createDataFrame(
        [(a, sorted(t), f"d{a % 4}") for a, t in topics.items()], "article_id long, topics array<string>, source_domain string"
    )
    opinions, want = replay(log, topics, DEFAULT.topic_decay, lambda p, n: p / (1 + n))
    got = {(r[0], r[1]): tuple(r[2:]) for r in P.topic_preferences(events, articles).collect()}
    assert got.keys() == want.keys()
    for key in want:
        assert got[key] == pytest.approx(want[key])
    sources = {a: {f"d{a % 4}"} for a in topics}
    _, want = replay(log, sources, DEFAULT.source_decay, lambda p, n: p - n)
    got = {(r[0], r[1]): tuple(r[2:]) for r in P.source_preferences(events, articles).collect()}
    assert got.keys() == want.keys()
    for key in want:
        assert got[key] == pytest.approx(want[key])
    latest = {(r["user_id"], r["article_id"]): (r["action"], r["created_at"]) for r in FB.latest_feedback(events).collect()}
    assert latest == opinions


def test_owned_articles_equal_replay(spark):
    log = make_log(3)
    base = {(u, a): (o, w, START) for u, a, o, w in [(0, 1, "manual", 1.0), (0, 2, "read_full", 0.2), (1, 3, "clicked", 0.1), (0, 4, "good", 0.8), (9, 9, "saved", 0.5)]}
    state = dict(base)
    for _, user, article, op, action, at in log:
        key = (user, article)
        if op == "post" and action in GAIN:
            row = state.get(key)
            name = "good" if action == "good" else "saved"
            if row is None:
                state[key] = (name, GAIN[action], at)
            elif row[1] < GAIN[action]:
                state[key] = (name, GAIN[action], row[2])
        elif state.get(key, ("",))[0] in ("good", "saved"):
            del state[key]
    events = spark.createDataFrame(
        log, "seq long, user_id long, article_id long, op string, action string, created_at timestamp"
    )
    owned = spark.createDataFrame(
        [(*k, *v) for k, v in base.items()],
        "user_id long, article_id long, origin string, interest_weight double, created_at timestamp",
    )
    got = {(r[0], r[1]): tuple(r[2:]) for r in FB.apply_feedback_to_owned(events, owned).collect()}
    assert got == state


def test_read_and_population_rules(spark):
    owned = spark.createDataFrame(
        [(1, 1, "clicked", 0.1, START)],
        "user_id long, article_id long, origin string, interest_weight double, created_at timestamp",
    )
    feedback = spark.createDataFrame(
        [(1, 1, "good", START + timedelta(days=1)), (1, 2, "good", START), (1, 3, "bad", START)],
        "user_id long, article_id long, action string, created_at timestamp",
    )
    rows = {r["article_id"]: r["origin"] for r in FB.interest_population(owned, feedback).collect()}
    assert rows == {1: "clicked", 2: "good"}
    assert FB.read_flags(owned).count() == 1
    counts = FB.origin_counts(FB.interest_population(owned, feedback), 1).first()
    # Equal times keep the smaller id.
    assert (counts["clicked_count"], counts["good_count"], counts["manual_count"]) == (1, 0, 0)
