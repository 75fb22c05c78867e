"""Exact Jaccard self-join on word shingles with adaptive multi-match prefixes, and its components.

Texts with equal shingle sets form one node.  Tokens (shingle hashes) have a global order: first a hashed
quarter of all tokens, rarest first, then the rest by hash.  For threshold t a node of n tokens has prefixes of
``n - ceil(t n) + l`` tokens, and two linked nodes share at least ``l`` tokens of their ``l``-prefixes.  Every node
takes the ``l`` with the least estimated cost (entries met in the index plus verifications), a pair the smaller one.

1. Token rows of the hashed quarter are counted; tokens of a single text can match nothing and go.  Most texts
   have only such tokens in their prefix and are finished here.
2. Tokens of at most ``hot_df`` nodes: pairs of nodes that share ``l`` prefix tokens are verified on whole sets.
3. More frequent tokens would give all pairs of a large group.  Such tokens with common nodes form families; a
   family is cut into blocks, and two blocks at a time meet in one task that multiplies their incidence matrices and
   returns a spanning forest of the links: never the pairs.  Nothing is capped, every pair of the family is compared.
4. Components of the links; each document gets the smallest doc_id of its component.

Defined cases: null or empty text and text without words have no shingles, no links and their own doc_id as
component.  Rows with equal text are one node, whatever their ids; a repeated doc_id with different texts is two nodes.
Null ids take part but never name a component (null if it has no other).  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import staged, text_slices
from millrace.llm.words import WHITE, Packed, mix, shingle_sets
from millrace.operators.graph import connected_components


@dataclass(frozen=True)
class JaccardJoin:
    """``threshold`` is a percentage; ``universe`` the part (1/u) of tokens that come first in the order."""

    words: int = 3
    threshold: int = 90
    universe: int = 4
    hot_df: int = 32
    block: int = 256
    max_level: int = 16
    verify_cost: float = 40.0

    def least_overlap(self, n):
        """Tokens that a node of ``n`` tokens must share with any partner: ceil(threshold n / 100)."""
        return (self.threshold * n + 99) // 100

    def ratio(self) -> Fraction:
        return Fraction(self.threshold, 100)


def _node_ids(sets: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(len(sets), dtype=np.uint64)
    for i, s in enumerate(sets):
        if len(s):
            out[i] = mix(mix(s).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(s)))[0]
    return out.view(np.int64)


def _signatures(settings: JaccardJoin):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in text_slices(batch, "text"):
                sets = shingle_sets(Packed(texts, WHITE), settings.words)
                yield pa.record_batch(
                    [rows.column("doc_id"), rows.column("text_key"), pa.array(_node_ids(sets)), pa.array([len(s) for s in sets], pa.int64())],
                    names=["doc_id", "text_key", "node", "n"],
                )

    return run


def _token_rows(settings: JaccardJoin):
    """(token, node, n, front, place): the tokens that a prefix of any length used can reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in text_slices(batch, "text"):
                sets = [s for s in shingle_sets(Packed(texts, WHITE), settings.words) if len(s)]
                nodes, parts = _node_ids(sets), {"token": [], "node": [], "n": [], "front": [], "place": []}
                for node, tokens in zip(nodes, sets, strict=True):
                    n = len(tokens)
                    first = tokens % np.uint64(settings.universe) == 0
                    front, need = tokens[first], n - settings.least_overlap(n) + settings.max_level
                    rest = tokens[~first][: max(0, need - len(front))]  # tokens are sorted by hash
                    parts["token"] += [front, rest]
                    parts["place"].append(np.concatenate([np.full(len(front), -1, np.int32), np.arange(len(front), len(front) + len(rest), dtype=np.int32)]))
                    size = len(front) + len(rest)
                    parts["node"].append(np.full(size, node))
                    parts["n"].append(np.full(size, n, np.int32))
                    parts["front"].append(np.full(size, len(front), np.int32))
                if sets:
                    arrays = [np.concatenate(v) for v in parts.values()]
                    arrays[0] = arrays[0].view(np.int64)
                    yield pa.record_batch([pa.array(a) for a in arrays], names=list(parts))

    return run


def _prefixes(settings: JaccardJoin):
    """Rows (node, n, front, tokens[], dfs[], places[]) of shared tokens to prefix rows with the cheapest level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                n, front = row["n"], row["front"]
                shared = sorted((d, t) for t, d, p in row["entries"] if p < 0)
                alone = front - len(shared)  # tokens of the front that no other node has: they come first
                ranked = [(alone + i, d, t) for i, (d, t) in enumerate(shared)]
                ranked += sorted((p, d, t) for t, d, p in row["entries"] if p >= 0)
                base = n - settings.least_overlap(n)
                # 1-based rank r is in the l-prefix from level l = r - base on.
                levels = [(max(1, r + 1 - base), d, t) for r, d, t in ranked]
                best, cost = 1, None
                for level in range(1, settings.max_level + 1):
                    if base + level > n:
                        break
                    met = sum(d - 1 for at, d, _ in levels if at <= level)
                    spent = met * (1 + settings.verify_cost / level)
                    if cost is None or spent < cost:
                        best, cost = level, spent
                out += [(row["node"], n, best, t, at, d) for at, d, t in levels if at <= best]
            if out:
                columns = list(zip(*out, strict=True))
                yield pa.record_batch(
                    [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64()), strict=True)],
                    names=["node", "n", "level", "token", "at", "df"],
                )

    return run


def _node_sets(settings: JaccardJoin):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in text_slices(batch, "text"):
                sets = shingle_sets(Packed(texts, WHITE), settings.words)
                yield pa.record_batch(
                    [pa.array(_node_ids(sets)), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "tokens"]
                )

    return run


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    shared = np.intersect1d(a, b, assume_unique=True).size
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def _verify(settings: JaccardJoin):
    """Partition sorted by (a, b is set): the set of ``a`` comes first, then the sets of its partners."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, own = None, None
        for batch in batches:
            found = []
            for a, b, tokens in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("tokens"), strict=True):
                tokens = np.frombuffer(tokens.as_buffer(), dtype=np.uint64)
                if b is None:
                    head, own = a, tokens.copy()
                elif a == head and _linked(own, tokens, settings.threshold):
                    found.append((a, b))
            yield pa.record_batch([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return run


def _forest(pairs: np.ndarray, size: int) -> list[tuple[int, int]]:
    parent = list(range(size))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for a, b in pairs.tolist():
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[ra] = rb
            kept.append((a, b))
    return kept


def block_links(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int) -> np.ndarray:
    """Index pairs (i, j) of linked sets between two blocks, or inside one; intersections by matrix product."""
    sets = left + (right or [])
    if len(sets) < 2:
        return np.zeros((0, 2), dtype=np.int64)
    tokens, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    common = times[column] > 1
    renumber = np.cumsum(times > 1) - 1
    column, owner, width = renumber[column[common]], owner[common], int((times > 1).sum())
    split = len(left) if right else 0
    shared = np.zeros((split or len(sets), len(sets) - split), dtype=np.float32)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    for low in range(0, width, 4096):  # columns in strips, so that memory stays bounded
        a, b = np.searchsorted(column, (low, low + 4096))
        strip = np.zeros((len(sets), min(4096, width - low)), dtype=np.float32)
        strip[owner[a:b], column[a:b] - low] = 1
        shared += strip[: split or len(sets)] @ strip[split:].T
    size = np.array([len(s) for s in sets], dtype=np.int64)
    shared = shared.astype(np.int64)
    union = size[: split or len(sets), None] + size[None, split:] - shared
    linked = 100 * shared >= percent * union
    if not split:
        linked = np.triu(linked, 1)
    pairs = np.argwhere(linked)
    pairs[:, 1] += split
    return pairs


def _block_pairs(settings: JaccardJoin):
    """Partition sorted by (family, i, j): rows of one pair of blocks are together."""

    def flush(key, nodes, blocks, sets):
        left = [k for k, b in enumerate(blocks) if b == key[1]]
        right = [k for k, b in enumerate(blocks) if b != key[1]]
        order = left + right
        pairs = block_links([sets[k] for k in left], [sets[k] for k in right] if key[1] != key[2] else None, settings.threshold)
        return [(nodes[order[a]], nodes[order[b]]) for a, b in _forest(pairs, len(order))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, nodes, blocks, sets = None, [], [], []

        def out(found):
            return pa.record_batch([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("family", "i", "j", "mine", "node")), strict=True)
            found = []
            for (family, i, j, mine, node), tokens in zip(keys, batch.column("tokens"), strict=True):
                if (family, i, j) != current:
                    if current is not None:
                        found += flush(current, nodes, blocks, sets)
                    current, nodes, blocks, sets = (family, i, j), [], [], []
                nodes.append(node)
                blocks.append(mine)
                sets.append(np.frombuffer(tokens.as_buffer(), dtype=np.uint64).copy())
            yield out(found)
        if current is not None:
            yield out(flush(current, nodes, blocks, sets))

    return run


def _families(hot: DataFrame) -> DataFrame:
    """(family, node): hot tokens of like frequency with a common node share a family, so any pair is found in one."""
    banded = hot.select("token", "node", F.floor(F.log2("df") * 2).alias("band"))
    node_mark = banded.groupBy("band", "node").agg(F.min("token").alias("mark"))
    token_mark = banded.join(node_mark, ["band", "node"]).groupBy("band", "token").agg(F.min("mark").alias("family"))
    return banded.join(token_mark, ["band", "token"]).select(F.xxhash64("band", "family").alias("family"), "node").distinct()


def shingle_documents(docs: DataFrame, settings: JaccardJoin = JaccardJoin()) -> DataFrame:
    """(doc_id, text_key, node, n) for every row of ``docs`` (doc_id, text)."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    return keyed.mapInArrow(_signatures(settings), "doc_id long, text_key long, node long, n long")


def jaccard_links(docs: DataFrame, members: DataFrame, settings: JaccardJoin = JaccardJoin()) -> DataFrame:
    """Links (a, b) between nodes; with them all linked nodes are connected, redundant links of hot groups are left out."""
    tokens = docs.select("text").mapInArrow(_token_rows(settings), "token long, node long, n int, front int, place int")
    repeated = tokens.groupBy("token").count().filter("count > 1").select("token")
    rows = staged(tokens.join(repeated, "token", "left_semi")).distinct()  # copies of a text give equal rows
    shared = rows.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    per_node = (
        rows.join(shared, "token")
        .groupBy("node", "n", "front")
        .agg(F.collect_list(F.struct("token", "df", "place")).alias("raw"))
        .select("node", "n", "front", F.transform("raw", lambda e: F.array(e.token, e.df, e.place.cast("long"))).alias("entries"))
    )
    prefix = staged(per_node.mapInArrow(_prefixes(settings), "node long, n int, level int, token long, at int, df long"))

    active = prefix.select("node").distinct()
    chosen = members.filter("n > 0").groupBy("node").agg(F.min(F.struct("doc_id", "text_key")).alias("row"))
    wanted = chosen.join(active, "node", "left_semi").select("row.*").distinct()
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    texts = keyed.join(
        wanted.withColumnsRenamed({"doc_id": "w_id", "text_key": "w_key"}),
        F.col("text_key").eqNullSafe(F.col("w_key")) & F.col("doc_id").eqNullSafe(F.col("w_id")),
        "left_semi",
    )
    sets = staged(texts.select("text").mapInArrow(_node_sets(settings), "node long, tokens binary")).dropDuplicates(["node"])
    sets = staged(sets)

    cold = prefix.filter(F.col("df") <= settings.hot_df)
    left = cold.select("token", *(F.col(c).alias(f"{c}_a") for c in ("node", "n", "level", "at")))
    right = cold.select("token", *(F.col(c).alias(f"{c}_b") for c in ("node", "n", "level", "at")))
    like = (F.col("node_a") < F.col("node_b")) & (
        100 * F.least("n_a", "n_b").cast("long") >= settings.threshold * F.greatest("n_a", "n_b").cast("long")
    )
    within = F.greatest("at_a", "at_b") <= F.least("level_a", "level_b")
    pairs = (
        left.join(right, "token")
        .filter(like & within)
        .groupBy(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
        .agg(F.count("*").alias("matches"), F.first(F.least("level_a", "level_b")).alias("need"))
        .filter("matches >= need")
        .select("a", "b")
    )
    pairs = staged(pairs)
    heads = sets.join(pairs.select(F.col("a").alias("node")).distinct(), "node", "left_semi")
    checked = (
        pairs.join(sets.withColumnRenamed("node", "b"), "b")
        .select("a", "b", "tokens")
        .union(heads.select(F.col("node").alias("a"), F.lit(None).cast("long").alias("b"), "tokens"))
        .repartition("a")
        .sortWithinPartitions("a", F.col("b").asc_nulls_first())
        .mapInArrow(_verify(settings), "a long, b long")
    )

    family = staged(_families(prefix.filter(F.col("df") > settings.hot_df)))
    blocks = family.groupBy("family").agg(F.ceil(F.count("*") / settings.block).cast("int").alias("blocks"))
    placed = (
        family.join(blocks, "family")
        .withColumn("mine", F.pmod(F.xxhash64("node", "family"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("family", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "node")
    )
    in_blocks = (
        placed.join(sets, "node")
        .repartition("family", "i", "j")
        .sortWithinPartitions("family", "i", "j")
        .mapInArrow(_block_pairs(settings), "a long, b long")
    )
    return checked.union(in_blocks)


def jaccard_components(docs: DataFrame, settings: JaccardJoin = JaccardJoin()) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per row of ``docs`` (doc_id, text)."""
    members = staged(shingle_documents(docs, settings))
    links = jaccard_links(docs, members, settings)
    roots = connected_components(links).withColumnsRenamed({"component": "root"})
    rooted = members.join(roots, "node", "left").withColumn("root", F.when(F.col("n") > 0, F.coalesce("root", "node")))
    names = rooted.filter("n > 0").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rooted.join(names, "root", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )


def representatives(docs: DataFrame, settings: JaccardJoin = JaccardJoin()) -> DataFrame:
    """Rows of ``docs``, one per component: smallest doc_id, then text.  Rows without shingles all stay."""
    members = staged(shingle_documents(docs, settings))
    links = jaccard_links(docs, members, settings)
    roots = connected_components(links).withColumnsRenamed({"component": "root"})
    rooted = members.filter("n > 0").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")).alias("row")
    kept = rooted.groupBy("root").agg(first).select(F.col("row.doc_id").alias("k_id"), F.col("row.text_key").alias("k_text"))
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    keyed = docs.withColumns({"_id": F.col("doc_id").cast("long"), "_text_key": F.xxhash64("text"), "_worded": worded})
    same = F.col("_id").eqNullSafe(F.col("k_id")) & F.col("_text_key").eqNullSafe(F.col("k_text"))
    chosen = keyed.filter("_worded").join(staged(kept), same, "left_semi").dropDuplicates(["_id", "_text_key"])
    return chosen.unionByName(keyed.filter("not _worded")).drop("_id", "_text_key", "_worded")
