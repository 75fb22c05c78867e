"""Spelling variants against a comparison of all pairs of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm.spelling import CrcJoiner, SpellingSettings, follow, rotations, spelling_variants
from tests.llm.cases import AWKWARD, frame

_RUN = re.compile("[A-Za-zÀ-ÿ]+")


def brute_counts(docs, s):
    counts = Counter()
    for doc_id, text, *_ in docs:
        for run in _RUN.findall(text or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if s.noise and h % s.noise == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= s.min_length and n >= s.min_count}


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(docs, s):
    counts = brute_counts(docs, s)
    forms, rows = {}, []
    for w, n in counts.items():
        others = [v for v in counts if near(w, v)]
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        if best is not None and counts[best] < s.ratio * n:
            best = None
        forms[w] = best
        rows.append((w, best, n, len(others), counts[best] if best else None))
    def root(w):
        return w if forms[w] is None else root(forms[w])
    return {(w, f, root(w), n, k, m) for w, f, n, k, m in rows}


def found(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


@pytest.mark.parametrize("seed", range(2))
def test_variants_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abé") for _ in range(rng.randrange(2, 7))) for _ in range(40)]
    stems += ["a" * k for k in range(3, 9)] + ["x" * k for k in range(60, 70)] + ["y" * 30 + c + "z" * 40 for c in "abc"]
    weights = [rng.choice((1, 1, 3, 20, 150)) for _ in stems]
    docs = [(i, " ".join(rng.choices(stems, weights, k=40)) + ",ÿÀĀAbab÷x", "en", "s", 1) for i in range(60)]
    docs = [*docs, *AWKWARD, (None, None, None, None, None)]
    s = SpellingSettings(min_length=2, min_count=2, ratio=3, noise=7)
    extra = frame(spark, docs).withColumns({"word": F.lit(1), "n": F.lit(1), "_text": F.lit(1)})
    want = brute(docs, s)
    assert found(spelling_variants(extra, s)) == want
    assert any(r[2] not in (r[0], r[1]) for r in want)  # chains of forms occur


def test_production_settings(spark):
    rng = random.Random(9)
    words = ["straße", "received", "recieved", "receiveds", "langages", "language", "languages"]
    docs = [(i, " ".join(rng.choices(words, (50, 90, 2, 1, 1, 60, 30), k=300)), "en", "s", 1) for i in range(40)]
    assert found(spelling_variants(frame(spark, docs))) == brute(docs, SpellingSettings())
    assert spelling_variants(frame(spark, AWKWARD).limit(0)).count() == 0
    assert spelling_variants(frame(spark, AWKWARD[:4])).count() == 0


def test_ties_go_to_the_smaller_word(spark):
    text = "abcdefg " * 5 + "abcdefh " * 50 + "abcdefi " * 50 + "abcdefé " * 50
    got = {r.word: r for r in spelling_variants(frame(spark, [(1, text, "en", "s", 1)]), SpellingSettings(noise=0)).collect()}
    assert got["abcdefg"].form == "abcdefh" and got["abcdefg"].n_near == 3 and got["abcdefé"].form is None


def test_very_long_words(spark):
    long = "ab" * 6_000
    text = " ".join([long] * 60 + [long[:-1]] * 5 + [long + "c"] * 6 + ["c" + long[1:]] * 7)
    got = {r.word: r for r in spelling_variants(frame(spark, [(1, text, "en", "s", 1)]), SpellingSettings(noise=0)).collect()}
    assert len(got) == 4 and got[long].n_near == 3 and got[long].form is None
    assert {got[w].form for w in (long[:-1], long + "c", "c" + long[1:])} == {long}


def test_rotation_keys_agree_between_both_forms():
    for size in (62, 63, 64, 65):
        word = "".join(random.Random(size).choice("ab") for _ in range(size))
        gaps = [k for k, gap, _ in rotations(word) if gap]
        for i in range(size):
            shorter = word[:i] + word[i + 1 :]
            assert gaps[i] in {k for k, gap, _ in rotations(shorter) if not gap}


def test_joined_checksums():
    joiner, rng = CrcJoiner(), random.Random(4)
    pairs = [(rng.randbytes(rng.randrange(12)), rng.randbytes(rng.randrange(1, 64))) for _ in range(300)]
    got = joiner.join(*(np.array([zlib.crc32(p[k]) for p in pairs], dtype=np.uint32) for k in (0, 1)), np.array([len(p[1]) for p in pairs]))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in pairs]


def test_pointer_jumping_follows_long_chains(spark):
    forms = spark.createDataFrame([(i, i + 1) for i in range(37)] + [(100, 36)], "id long, form long")
    assert {r.id: r.root for r in follow(forms).collect()} == {**{i: 37 for i in range(37)}, 100: 37}
