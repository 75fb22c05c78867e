import random
import re
from collections import defaultdict

import pytest

from millrace.llm.ngram_join import JaccardJoin, block_links, jaccard_components, representatives
from tests.llm.cases import AWKWARD, frame


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if len(words) < 3:
        return frozenset([tuple(words)] if words else [])
    return frozenset(zip(words, words[1:], words[2:], strict=False))


def brute(rows):
    """(doc_id, n_shingles, component_id) by comparing all pairs of distinct sets."""
    sets = [shingles(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * shared >= 90 * (len(sets[i]) + len(sets[j]) - shared):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    lowest = defaultdict(list)
    for i, r in enumerate(rows):
        lowest[root(i)].append(r[0])
    return sorted(
        ((r[0], len(sets[i]), min((x for x in lowest[root(i)] if x is not None), default=None)) for i, r in enumerate(rows)), key=repr
    )


def near_copies(seed, groups, size, words, edits):
    rng = random.Random(seed)
    rows = []
    for _ in range(groups):
        base = [f"w{rng.randrange(4000)}" for _ in range(words)]
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.randrange(edits + 1)):
                copy[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
            if rng.random() < 0.2:
                copy = copy[: -rng.randrange(1, 9)]
            rows.append((100 + len(rows), " ".join(copy), "en", "s", 1))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("settings", [JaccardJoin(), JaccardJoin(hot_df=4, block=7), JaccardJoin(hot_df=3, block=5, universe=1, max_level=1)])
def test_components_equal_brute_force(spark, settings):
    rows = near_copies(3, 6, 18, 60, 3) + [(1000 + i, t, "en", "s", 1) for i, t in enumerate(["a b c", "A B c", "a b", "a b", "z", ""])]
    found = jaccard_components(frame(spark, rows), settings)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute(rows)


def test_awkward_rows_and_empty_table(spark):
    docs = frame(spark, AWKWARD).withColumnRenamed("lang", "node")
    assert sorted((tuple(r) for r in jaccard_components(docs).collect()), key=repr) == brute(AWKWARD)
    assert jaccard_components(docs.limit(0)).count() == 0


def test_one_row_of_each_group_stays(spark):
    rows = near_copies(5, 4, 9, 50, 2) + AWKWARD
    kept = representatives(frame(spark, rows), JaccardJoin(hot_df=4, block=4))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = sorted((r.doc_id for r in kept.collect()), key=repr)
    named = {(d, c) for d, n, c in brute(rows) if n}
    wordless = [r[0] for r in rows if not shingles(r[1])]
    assert ids == sorted([c for c in {c for _, c in named}] + wordless, key=repr)


def test_blocks_find_links_between_and_inside():
    import numpy as np

    sets = [np.arange(s, s + 40, dtype=np.uint64) for s in (0, 1, 2, 30, 31, 200)]
    want = {(i, j) for i in range(6) for j in range(i + 1, 6) if 100 * (n := len(np.intersect1d(sets[i], sets[j]))) >= 90 * (80 - n)}
    assert {tuple(p) for p in block_links(sets, None, 90).tolist()} == want
    assert {tuple(p) for p in block_links(sets[:3], sets[3:], 90).tolist()} == {p for p in want if p[0] < 3 <= p[1]}
