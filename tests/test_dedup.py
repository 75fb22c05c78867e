"""Duplicate evidence, components and event ids against brute force."""

import itertools
import random
import string

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.functions.text import normalize_title
from millrace.operators import dedup as D
from millrace.operators.graph import connected_components
from millrace.operators.similarity import neighbor_similarity
from dataclasses import replace
from millrace.config import DEFAULT


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def components(nodes, edges):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def edge_components(df, nodes):
    return components(nodes, [(r["a"], r["b"]) for r in df.select("a", "b").collect()])


def edited(rng, text, times):
    chars = list(text)
    for _ in range(times):
        at = rng.randrange(len(chars))
        how = rng.randrange(3)
        if how == 0:
            chars[at] = rng.choice(string.ascii_lowercase)
        elif how == 1:
            chars.insert(at, rng.choice(string.ascii_lowercase))
        elif len(chars) > 5:
            del chars[at]
    return "".join(chars)


@pytest.mark.parametrize("block_rows", [8, 4096])
def test_title_edges_are_exact(spark, block_rows):
    rng = random.Random(5)
    stems = ["".join(rng.choices("abcdeg", k=rng.choice([5, 9, 10, 11, 13, 25, 38, 42, 60]))) for _ in range(25)]
    titles = [edited(rng, rng.choice(stems), rng.randrange(0, 7)) for _ in range(120)]
    # A third of the rows: one template with small and large changes.
    titles += [edited(rng, "weeklyreleasenotesforthebigproject", rng.randrange(0, 9)) for _ in range(60)]
    titles += ["!!!", "???"]
    rows = list(enumerate(titles))
    df = spark.createDataFrame(rows, "article_id long, title string")
    norm = {r["article_id"]: r["t"] for r in df.select("article_id", normalize_title("title").alias("t")).collect()}
    want = []
    for (i, a), (j, b) in itertools.combinations(norm.items(), 2):
        if a and b and 1 - levenshtein(a, b) / max(len(a), len(b)) >= 0.9 - 1e-9:
            want.append((i, j))
    edges = D.title_edges(df, 0.9, block_rows)
    assert edge_components(edges, norm) == components(norm, want)
    touched = {n for r in edges.collect() for n in (r["a"], r["b"])}
    assert touched == {n for pair in want for n in pair}


def test_every_pair_of_similar_titles_shares_a_stored_segment():
    rng = random.Random(11)
    for threshold in (0.6, 0.8, 0.9):
        stored, looked_up = D.segment_plan(threshold)
        keep, find = {}, {}
        for rows, by in ((stored, keep), (looked_up, find)):
            for length, edits, width, i, pos in rows:
                by.setdefault(length, []).append((edits, width, i, pos))
        for _ in range(400):
            x = "".join(rng.choices("abcd", k=rng.randrange(2, 60)))
            y = edited(rng, x, rng.randrange(1, 9))
            x, y = sorted((x, y), key=len)
            if x == y or 1 - levenshtein(x, y) / len(y) < threshold - 1e-9 or not D.has_segments(len(x), threshold):
                continue
            kept = {(e, w, i, x[p : p + w]) for e, w, i, p in keep[len(x)]}
            assert kept & {(e, w, i, y[p : p + w]) for e, w, i, p in find[len(y)]}


@pytest.mark.parametrize(("threshold", "block_rows"), [(0.9, 8), (0.8, 4096)])
def test_long_title_edges_are_exact(spark, threshold, block_rows):
    rng = random.Random(23)
    words = ["".join(rng.choices("aeinorst", k=rng.randrange(2, 7))) for _ in range(40)]
    stems = ["".join(rng.choices(words, k=rng.choice([24, 30, 34, 60]))) for _ in range(8)]
    titles = [edited(rng, rng.choice(stems), rng.choice([1, 4, 10, 14, 18, 30])) for _ in range(26)]
    titles += [edited(rng, stems[0], rng.choice([2, 9, 16])) for _ in range(14)]
    df = spark.createDataFrame(list(enumerate(titles)), "article_id long, title string")
    want = [
        (i, j) for (i, a), (j, b) in itertools.combinations(enumerate(titles), 2)
        if 1 - levenshtein(a, b) / max(len(a), len(b)) >= threshold - 1e-9
    ]
    edges = D.title_edges(df, threshold, block_rows)
    assert edge_components(edges, range(len(titles))) == components(range(len(titles)), want)
    assert {n for r in edges.collect() for n in (r["a"], r["b"])} == {n for pair in want for n in pair}


def test_titles_that_share_only_frequent_segments_do_not_become_pairs(spark):
    rng = random.Random(31)
    parts = ["".join(rng.choices("aeinorst", k=rng.randrange(2, 5))) for _ in range(30)]
    texts = ["".join(rng.choices(parts, k=80))[:220] for _ in range(150)]
    near = [edited(rng, text, 9) for text in texts[:5]]
    rows = [(i, text, len(text)) for i, text in enumerate(texts + near)]
    titles = spark.createDataFrame(rows, "tid long, text string, len int")
    pairs, hubs = D.segment_candidates(titles, 0.9, 4096)
    found = {(r.a, r.b) for r in pairs.collect()}
    assert {(i, 150 + i) for i in range(5)} <= found and hubs.isEmpty()
    assert len(found) < 300  # 720 when every shared segment made a pair


def test_title_similarity_of_a_half_is_refused(spark):
    with pytest.raises(ValueError):
        D.title_edges(spark.createDataFrame([(1, "a")], "article_id long, title string"), 0.5)


@pytest.mark.parametrize("tile", [16, 2048])
def test_embedding_edges_are_exact(spark, tile):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8))
    vectors = [(centres[i % 12] + rng.normal(scale=0.35, size=8)).tolist() for i in range(150)]
    hot = rng.normal(size=8)
    vectors += [(hot + rng.normal(scale=0.02, size=8)).tolist() for _ in range(70)]  # a hot group of near copies
    vectors += [hot.tolist(), hot.tolist(), [0.0] * 8, [0.0] * 8, [1.0, 0.0], [1.0, 0.1], None]
    df = spark.createDataFrame(list(enumerate(vectors)), "article_id long, embedding array<float>")
    stored = {r["article_id"]: r["embedding"] for r in df.collect()}
    want = []
    for (i, a), (j, b) in itertools.combinations(stored.items(), 2):
        if a is None or b is None or len(a) != len(b):
            continue
        a, b = np.array(a), np.array(b)
        norms = np.linalg.norm(a) * np.linalg.norm(b)
        if norms > 0 and a @ b / norms >= 0.92 - 1e-9:
            want.append((i, j))
    edges = D.embedding_edges(df, 0.92, tile)
    assert edge_components(edges, stored) == components(stored, want)
    touched = {n for r in edges.collect() for n in (r["a"], r["b"])}
    assert touched == {n for pair in want for n in pair}


def test_components_of_chain_cliques_and_hub(spark):
    chain = [(i, i + 1) for i in range(1000)]
    left = list(itertools.combinations(range(2000, 2012), 2))
    right = list(itertools.combinations(range(3000, 3012), 2))
    hub = [(9999, n) for n in range(5000, 5400)]
    edges = chain + left + right + [(2003, 3007)] + hub
    random.Random(0).shuffle(edges)
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(df).collect()}
    nodes = {n for e in edges for n in e}
    assert got == components(nodes, edges)


def test_event_ids_follow_cluster_order(spark):
    rng = random.Random(7)
    members = [(i, i // 3, f"e{rng.randrange(14)}" if rng.random() < 0.7 else None) for i in range(90)]
    best = [(c, 3 if c != 5 else 1) for c in range(30)]
    used, want = set(), {}
    for c, size in best:
        if size < 2:
            continue
        ids = {e for _, k, e in members if k == c and e} - used
        want[c] = min(ids) if ids else None
        used.add(want[c])
    got = D.resolve_event_ids(
        spark.createDataFrame(members, "article_id long, component long, event_id string"),
        spark.createDataFrame(best, "component long, size long"),
    )
    rows = {r["component"]: r["event_id"] for r in got.collect()}
    assert rows.keys() == want.keys()
    for c, e in want.items():
        assert rows[c] == e if e else len(rows[c]) == 64


def test_blank_urls_and_stage_order(spark):
    rows = [
        (1, "", "", "alpha beta gamma one", "h1"),
        (2, "", "", "other words entirely", "h2"),
        (3, "https://x.example/a?utm_source=q", "https://x.example/a?utm_source=q", "t three", "h3"),
        (4, "https://x.example/a", "https://x.example/a", "t four unlike", "h3"),
    ]
    df = spark.createDataFrame(rows, "article_id long, canonical_url string, original_url string, title string, body_hash string")
    df = df.withColumn("embedding", F.lit(None).cast("array<float>"))
    stages = {r["article_id"]: r["stage"] for r in D.best_stage(D.duplicate_edges(df), df).collect()}
    assert stages == {3: "normalized_url", 4: "normalized_url"}


def test_neighbor_tiles_equal_whole_run(spark):
    rng = np.random.default_rng(9)
    rows = [(u, i, rng.normal(size=6).tolist()) for u, n in ((1, 90), (2, 5), (3, 1)) for i in range(n)]
    rows.append((2, 99, [1.0, 2.0]))  # another length has no neighbours
    df = spark.createDataFrame(rows, "user_id long, article_id long, embedding array<double>")
    got = {(r[0], r[1]): r[2] for r in neighbor_similarity(df, replace(DEFAULT, vector_tile_rows=16)).collect()}
    for user, n in ((1, 90), (2, 5)):
        m = np.array([v for u, _, v in rows if u == user and len(v) == 6])
        m /= np.linalg.norm(m, axis=1, keepdims=True)
        s = m @ m.T
        np.fill_diagonal(s, -1)
        for i in range(n):
            assert got[user, i] == pytest.approx(s[i].max())
    assert (3, 0) not in got and (2, 99) not in got


def test_pivots_rule_out_pairs_and_lose_no_link(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 24))
    rows = [(i, (centres[i % 40] + 0.05 * rng.normal(size=24)).astype(float).tolist()) for i in range(1200)]
    vectors = spark.createDataFrame(rows, "vid long, embedding array<float>")
    unit = np.array([r[1] for r in rows], dtype=np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    want = {(int(a), int(b)) for a, b in np.argwhere(np.triu(unit @ unit.T >= 0.98 - 1e-9, 1))}

    def compared(pivots):
        placed, hub, radius = D._placed_vectors(vectors, 0.98, 30, pivots)
        tiles = D.vector_tiles(placed, radius)
        keys = ["cell_x", "core_x", "block_x", "cell_y", "core_y", "block_y"]
        sizes = tiles.groupBy(*keys, "inside").agg(F.count_if("left").alias("l"), F.count_if(~F.col("left")).alias("r")).collect()
        return sum(s.l * (s.l - 1) // 2 if s.inside else s.l * s.r for s in sizes)

    few, many = compared(1), compared(16)
    assert many < few <= 1200 * 1199 // 2 and many < 0.3 * few
    parent = list(range(1200))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in D._cell_edges(vectors, 0.98, 30).collect():
        assert (min(r), max(r)) in want
        parent[root(r.a)] = root(r.b)
    assert all(root(a) == root(b) for a, b in want)


def test_catalog_judges_past_the_budget(spark):
    from catalog import all_queries, all_sql
    from catalog.duplicates import CFG

    names = ["unique_candidates", "dedup_decisions", "dedup_counters"]
    assert set(names) <= set(all_queries()) and not any("n <= 50" in all_sql()[n] for n in names)
    rows = [(i, i, 1, "t", "license", f"h{i}", None, None) for i in range(120)]
    schema = "article_id long, component long, position int, title string, body string, body_hash string, judged_body_hash string, has_unique_value boolean"
    got = D.judge_candidates(spark.createDataFrame(rows, schema), lambda title, body: True, CFG.dedup).collect()
    assert len(got) == 120 and all(r.how == "judged" and r.is_unique for r in got)


def test_vectors_that_nothing_separates_are_sent_to_a_bounded_number_of_parts(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=32).tolist()) for i in range(2000)]
    vectors = spark.createDataFrame(rows, "vid long, embedding array<float>")
    # 500 parts of four rows would send every vector 500 times.
    tiles, _hub = D._cell_tiles(vectors, 0.45, 4)
    assert tiles.count() <= 100 * len(rows)


def test_dense_tiles_keep_a_spanning_forest():
    rng = np.random.default_rng(6)
    points = np.concatenate([rng.normal(size=(400, 4)), np.ones(4) + 0.01 * rng.normal(size=(400, 4))])
    frame = pd.DataFrame({"vid": np.arange(800), "embedding": list(points.astype(np.float32)), "left": True, "inside": True})
    unit = points.astype(np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    want = np.argwhere(np.triu(unit @ unit.T >= 0.97 - 1e-9, 1)).tolist()
    found = D._tile_edges(0.97)(frame)
    got = list(zip(found["a"].tolist(), found["b"].tolist()))
    assert {tuple(sorted(p)) for p in got} <= set(map(tuple, want)) and len(got) < 800
    assert components(range(800), got) == components(range(800), want)


def test_parts_of_a_cell_are_bounded_and_pairs_of_parts_are_kept_once(spark):
    rng = np.random.default_rng(9)
    points = rng.normal(size=(260, 3)).tolist() + [[1.0, 2.0, 3.0]] * 90  # a third that no pivot tells apart
    rows = [(i, i % 2, i % 5 == 0, [float(np.linalg.norm(np.array(p) - c)) for c in (0.0, 1.0)], [0.0]) for i, p in enumerate(points)]
    df = spark.createDataFrame(rows, "vid long, cell int, core boolean, gaps array<double>, embedding array<float>")
    parts = D.split_cells(df.drop("embedding"), 10)
    sizes = parts.groupBy("cell", "core", "block").count().collect()
    assert sum(r["count"] for r in sizes) == len(rows) and max(r["count"] for r in sizes) <= 10
    tiles = D.vector_tiles(df.join(parts.select("vid", "block", "path"), "vid"), 0.3).collect()
    keys = ("cell_x", "core_x", "block_x", "cell_y", "core_y", "block_y")
    met = {}
    for r in tiles:
        met.setdefault(tuple(r[k] for k in keys), ([], []))[0 if r["left"] else 1].append(r["vid"])
    seen = []
    for key, (left, right) in met.items():
        inside = key[:3] == key[3:]
        seen += [frozenset(p) for p in (itertools.combinations(left, 2) if inside else itertools.product(left, right))]
    assert len(seen) == len(set(seen))
    for (i, ci, ki, gi, _), (j, cj, kj, gj, _) in itertools.combinations(rows, 2):
        if max(abs(a - b) for a, b in zip(gi, gj)) <= 0.3 and not (ci == cj and ki and kj):
            assert frozenset((i, j)) in seen
