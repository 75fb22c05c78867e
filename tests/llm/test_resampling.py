"""Importance resampling against a plain loop over words."""

import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from millrace.llm.resampling import FeatureCoder, Head, ResampleSettings, draw, importance_scores, learn_head, resample, resample_digest
from tests.llm.cases import AWKWARD, frame

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return _WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def features(text, n):
    w = words(text)
    return [" ".join(w[i : i + k]).encode() for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def brute(docs, target, s):
    source, goal = [0] * s.buckets, [0] * s.buckets
    for counts, texts in ((source, [d[1] for d in docs]), (goal, target)):
        for text in texts:
            for f in features(text, s.max_n):
                counts[zlib.crc32(f) % s.buckets] += 1
    total_s, total_t = sum(source) + s.buckets, sum(goal) + s.buckets
    gain = [math.floor(1000 * math.log((t + 1) * total_s / ((x + 1) * total_t))) for x, t in zip(source, goal, strict=True)]
    out = []
    for doc_id, text, *_ in docs:
        found = features(text, s.max_n)
        weight = sum(gain[zlib.crc32(f) % s.buckets] for f in found)
        h = int(hashlib.sha256(f"{s.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        noise = math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((doc_id, len(words(text)), len(found), weight, weight + noise))
    able = sorted((r for r in out if r[1] >= s.min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = [r[0] for r in able[: s.percent * len(able) // 100]]
    return out, drawn


def corpus(n=120, seed=3):
    rng = random.Random(seed)
    vocabulary = ["Alpha", "beta", "gamma9", "déjà", "x", "y", "z"] + [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(60))), "en", "s", 1) for i in range(100, 100 + n)]
    return rows, ["alpha beta w1 w2 w3", "Alpha-beta, w1", None, ""]


@pytest.mark.parametrize(("max_n", "head_words", "head_pairs"), [(1, 50_000, 100), (1, 2, 0), (2, 40, 30), (3, 1, 1), (2, 0, 0)])
def test_scores_and_draw_equal_brute_force(spark, max_n, head_words, head_pairs):
    docs, target = corpus()
    docs = [*docs, *AWKWARD]
    s = ResampleSettings(max_n=max_n, head_words=head_words, head_pairs=head_pairs, buckets=101, percent=30, min_words=5)
    frame_ = frame(spark, docs).withColumns({"score": F.lit("old"), "_text": F.lit(1), "rank": F.lit(7)})
    want, drawn = brute(docs, target, s)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    scored = importance_scores(frame_, goal, s)
    key = lambda r: tuple((v is None, v or 0) for v in r)
    got = sorted(((r.doc_id, r.n_words, r.n_features, r.weight, r.score) for r in scored.collect()), key=key)
    assert got == sorted(want, key=key)
    ranked = draw(scored, s).filter("rank is not null").orderBy("rank").collect()
    assert [r.rank for r in ranked] == list(range(1, len(drawn) + 1)) and [r.doc_id for r in ranked] == drawn
    whole = resample(frame_, goal, s).orderBy("rank").collect()
    assert [(r.doc_id, r.rank) for r in whole] == [(r.doc_id, r.rank) for r in ranked]
    texts = {d[0]: d[1] for d in docs}
    assert all(r.text == texts[r.doc_id] for r in whole)


def test_head_is_bounded_and_holds_the_frequent_words(spark):
    docs, _ = corpus()
    docs += [(i, "alpha beta " * 40, "en", "s", 1) for i in range(20)]
    head = learn_head(frame(spark, docs), ResampleSettings(max_n=2, head_words=20, head_pairs=10))
    assert len(head.words) == 20 and len(head.pairs) <= 10 and all(b" " in p for p in head.pairs)
    assert {b"alpha", b"beta"} <= set(head.words) and {b"alpha beta", b"beta alpha"} <= set(head.pairs)
    coder = FeatureCoder(Head((b"a", b"b"), (b"a b", b"b q")), ResampleSettings(max_n=2))
    assert len(coder.pair_codes) == 1  # a pair whose words are not in the head stays in the tail


def test_repeated_rows_empty_tables_and_no_target(spark):
    text = "one two three four five six " * 5
    rows = [(7, text, "en", "s", 1)] * 20 + [(8, "other words " * 20, "en", "s", 1)]
    none = frame(spark, []).select("text")
    s = ResampleSettings(percent=50)
    got = resample_digest(frame(spark, rows), none, s).collect()
    assert sorted(r.rank for r in got if r.rank) == list(range(1, 11)) and len(got) == 21
    assert len({(r.weight, r.score) for r in got if r.doc_id == 7}) == 1
    assert resample_digest(frame(spark, []), none, s).count() == 0 and resample(frame(spark, []), none, s).count() == 0
    assert resample_digest(frame(spark, rows[:1]), none).first().rank is None  # a tenth of one document is none


def test_a_long_text_and_a_long_word(spark):
    rows = [(1, "ab " * 300_000, "en", "s", 1), (2, "z" * 1_000_000 + " " + "q " * 30, "en", "s", 1)]
    want, _ = brute(rows, ["ab"], ResampleSettings())
    got = importance_scores(frame(spark, rows), spark.createDataFrame([("ab",)], "text string"))
    assert sorted((r.doc_id, r.n_words, r.n_features, r.weight, r.score) for r in got.collect()) == sorted(want)
