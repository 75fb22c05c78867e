import random
import re

from pyspark.sql import functions as F

from millrace.llm.decontamination import build_searches, contamination, contamination_digest, item_windows, occurrences
from tests.llm.cases import AWKWARD, frame

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text):
    return re.findall(WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    out = []
    for doc_id, text in docs:
        own, hit, ids = words(text), set(), set()
        for item_id, passage in items:
            w = words(passage)
            k = min(13, len(w))
            for i in range(len(w) - k + 1 if k else 0):
                for j in range(len(own) - k + 1):
                    if own[j : j + k] == w[i : i + k]:
                        hit |= set(range(j, j + k))
                        ids |= {item_id} - {None}
        out.append((doc_id, len(own), len(hit), sorted(map(str, ids)), bool(hit) and 20 * len(hit) >= len(own)))
    return sorted(out, key=repr)


def sample(seed):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "été", "a1", "B", "long-word", "x", "ß", "word"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([0, 1, 3, 12, 13, 14, 30]))) for i in range(25)] + [(3, "word x"), (None, "ß ß ß"), (99, None)]
    docs = [(i, text(rng.randrange(0, 60))) for i in range(40)]
    for i in range(40, 60):
        item = rng.choice(items)[1] or ""
        docs.append((i, f"{text(rng.randrange(30))} {item.upper()}... {text(rng.randrange(30))}"))
    return docs + [(r[0], r[1]) for r in AWKWARD], items


def rows(found):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.item_ids, r.contaminated) for r in found.collect()), key=repr)


def test_equals_brute_force_in_one_and_several_blocks(spark):
    docs, items = sample(1)
    want = brute(docs, items)
    frames = frame(spark, docs, "doc_id long, text string"), frame(spark, items, "item_id long, text string")
    assert rows(contamination(*frames)) == want
    assert rows(contamination(*frames, block_bytes=1500)) == want


def test_empty_tables_and_clashing_columns(spark):
    docs = frame(spark, AWKWARD).withColumn("n_hit", F.lit("old"))
    none = frame(spark, [], "item_id long, text string")
    found = contamination(docs, none)
    assert found.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_words", "n_hit", "item_ids", "contaminated"]
    assert {r.n_hit for r in found.collect()} == {0}
    assert contamination_digest(docs.limit(0), none).count() == 0


def test_search_finds_overlapping_and_adjacent_windows():
    windows, _ = item_windows([("1", "a b a"), ("2", "b a"), ("3", "c " * 20)])
    data = b"\x00 a b a b a c " + b"c " * 30
    want = sorted((i, n) for n, w in enumerate(windows) for i in range(len(data)) if data.startswith(w, i))
    assert sorted(occurrences(build_searches(windows), windows, data)) == want


def test_one_block_of_items_at_a_time(spark, monkeypatch):
    from millrace.llm import decontamination as D

    steps, build, stage = [], D.item_windows, D.staged
    monkeypatch.setattr(D, "item_windows", lambda *a: steps.append("build") or build(*a))
    monkeypatch.setattr(D, "staged", lambda df: steps.append("pass") or stage(df))
    docs, items = frame(spark, [(1, "a b c")], "doc_id long, text string"), frame(spark, [(i, f"w{i} x") for i in range(6)], "item_id long, text string")
    contamination(docs, items, block_bytes=150)
    assert len(steps) > 2 and steps == ["build", "pass"] * (len(steps) // 2)
