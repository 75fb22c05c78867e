"""Near-duplicate clustering: exact keys, similar titles, similar vectors, components, decisions.

No stage emits all pairs of a group.  Exact keys give star edges; the similarity joins verify
candidates inside the join or inside one numpy tile and hand on only a spanning forest, which has
the same components and touches the same articles as the full pair list.  A member's penalty needs
only the strongest stage in which it has *any* partner, so pair lists are never needed.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.config import DEFAULT, Dedup, EngineConfig, MATCH_METHODS, PRIMARY_MAX_TIER, SOURCE_TIERS
from millrace.functions.text import normalize_title
from millrace.functions.urls import normalize_url
from millrace.functions.vectors import unit_rows
from millrace.functions.weights import lookup
from millrace.operators.distributed import broadcast_if_small, part_count, top_per_key
from millrace.operators.filters import alive, needs_judgement, within_age
from millrace.operators.graph import connected_components
from millrace.session import materialize

EPSILON = 1e-9
EDGES = "a long, b long"


def _star(keyed: DataFrame, stage: str) -> DataFrame:
    """Edges (a, b, stage) from each row to the smallest id that shares its key."""
    groups = keyed.groupBy("key").agg(F.min("article_id").alias("b"), F.max("article_id").alias("_top"))
    shared = groups.filter(F.col("b") < F.col("_top"))
    joined = keyed.join(shared, "key").filter(F.col("article_id") != F.col("b"))
    return joined.select(F.col("article_id").alias("a"), "b", F.lit(stage).alias("stage"))


def canonical_url_edges(articles: DataFrame) -> DataFrame:
    keyed = articles.select("article_id", F.col("canonical_url").alias("key"))
    return _star(keyed.filter(F.col("key") != ""), "canonical_url")


def normalized_url_edges(articles: DataFrame) -> DataFrame:
    urls = F.array_distinct(F.array(normalize_url("canonical_url"), normalize_url("original_url")))
    keyed = articles.select("article_id", F.explode(urls).alias("key"))
    return _star(keyed.filter(F.col("key") != ""), "normalized_url")


def body_hash_edges(articles: DataFrame) -> DataFrame:
    keyed = articles.select("article_id", F.col("body_hash").alias("key"))
    return _star(keyed.filter(F.col("key").isNotNull()), "body_hash")


# --- titles ----------------------------------------------------------------------------------


# Titles that may differ by more edits, or are longer, store rare segments found by their text instead of fixed ones.
SEGMENT_EDITS = 12
SEGMENT_LENGTH = 128


def allowed_edits(longer: int, threshold: float) -> int:
    return math.floor((1.0 - threshold) * longer + EPSILON)


def segment_class(length: int, threshold: float) -> tuple[int, int]:
    """(edits, width): the most edits to any longer partner, and the width of each of the ``edits + 1`` segments."""
    edits = allowed_edits(math.floor(length / threshold + EPSILON), threshold)
    return edits, length // (edits + 1)


def has_segments(length: int, threshold: float) -> bool:
    return 0 < segment_class(length, threshold)[0] <= SEGMENT_EDITS and length <= SEGMENT_LENGTH


def segment_plan(threshold: float) -> tuple[list[tuple], list[tuple]]:
    """Rows (len, edits, width, segment, pos) of the segments that titles of a length store, and of those they look up.

    A title stores ``edits + 1`` segments from its front.  At most ``edits`` changes leave one of them, segment i, whole
    with at most i changes before it and at most ``edits - i`` behind.  In the longer title it is moved by as much as
    those changes allow; the moves of all partner lengths with the same segments are looked up once.
    """
    stored, looked_up = [], []
    length, shortest = 1, 1
    while shortest <= SEGMENT_LENGTH and segment_class(shortest, threshold)[0] <= SEGMENT_EDITS:
        if has_segments(length, threshold):
            edits, width = segment_class(length, threshold)
            stored += [(length, edits, width, i, i * width) for i in range(edits + 1)]
        allowed = allowed_edits(length, threshold)
        classes: dict[tuple[int, int], list[int]] = {}
        for shorter in range(shortest, length + 1):
            if has_segments(shorter, threshold):
                classes.setdefault(segment_class(shorter, threshold), []).append(length - shorter)
        for (edits, width), gaps in classes.items():
            for i in range(edits + 1):
                back = min(i, edits - i - min(gaps), (allowed - min(gaps)) // 2)
                ahead = min(i, edits - i + max(gaps), (allowed + max(gaps)) // 2)
                for pos in range(max(0, i * width - back), min(length - width, i * width + ahead) + 1):
                    looked_up.append((length, edits, width, i, pos))
        length += 1
        shortest = length - allowed_edits(length, threshold)
    return stored, looked_up


def title_edges(articles: DataFrame, threshold: float = DEFAULT.dedup.title_similarity, block_rows: int = DEFAULT.title_block_rows) -> DataFrame:
    """Edges between articles whose normalised titles are at least ``threshold`` similar.  Exact.

    Equal titles collapse first.  The rest meets on segments.
    """
    keyed = articles.select("article_id", normalize_title("title").alias("key")).filter(F.length("key") > 0)
    keyed = materialize(keyed)
    equal = _star(keyed, "title")
    similar = similar_title_edges(
        keyed.groupBy(F.col("key").alias("text")).agg(F.min("article_id").alias("tid")), threshold, block_rows
    )
    # A title with a similar title is evidence for each article that carries it.
    return equal.union(similar.withColumn("stage", F.lit("title")))


def similar_title_edges(titles: DataFrame, threshold: float, block_rows: int) -> DataFrame:
    """Spanning edges (a, b) between distinct titles (tid, text) within the edit threshold (above one half)."""
    if not 0.5 < threshold <= 1.0:
        raise ValueError("title similarity must be above 0.5: below, a few edits may leave no part of a title whole")
    titles = materialize(titles.select("tid", "text", F.length("text").alias("len")))
    candidates, hubs = segment_candidates(titles, threshold, block_rows)
    texts = titles.select("tid", "text")
    matches = (
        candidates.join(texts.withColumnsRenamed({"tid": "a", "text": "text_a"}), "a")
        .join(texts.withColumnsRenamed({"tid": "b", "text": "text_b"}), "b")
        .filter(_similar("text_a", "text_b", threshold))
        .select("a", "b")
    )
    return matches.union(hubs).mapInPandas(spanning_forest, EDGES).distinct()


def _similar(x: str, y: str, threshold: float) -> Column:
    most = f"cast(floor({1.0 - threshold!r}D * greatest(length({x}), length({y})) + {EPSILON!r}D) as int)"
    return F.expr(f"levenshtein({x}, {y}, {most}) >= 0")


def fixed_segments(titles: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Stored and looked-up rows of short titles, at the places of :func:`segment_plan`; they carry marks of their whole title."""
    spark = titles.sparkSession
    fields = "len int, edits int, width int, segment int, pos int"
    # The plans depend on the threshold alone: a few thousand rows of five numbers.
    plans = [spark.createDataFrame(rows, fields) for rows in segment_plan(threshold)]
    short = titles.filter(F.col("len") <= math.floor(SEGMENT_LENGTH / threshold + 1)).mapInPandas(_whole_marks, "tid long, text string, len int, " + MARK_FIELDS)
    piece = F.substring(F.col("text"), F.col("pos") + 1, F.col("width"))
    key = F.xxhash64("edits", "width", "segment", piece)
    stored, looked_up = (short.join(F.broadcast(plan), "len").select("tid", "len", "pos", key.alias("key"), *MARKS) for plan in plans)
    asked = looked_up.groupBy("key").agg(F.count("*").alias("asked")).filter("asked > 1")
    return stored.join(asked, "key").withColumn("slack", F.lit(None).cast("int")).select(*STORED), looked_up.select(*LOOKED_UP)


def rare_width(threshold: float) -> int:
    """Width of the segments of long titles: a third more of them fit than edits can destroy, so there is a choice."""
    return 8 if threshold >= 0.92 else max(1, math.floor(0.75 * threshold / (1.0 - threshold)))


# Rows of segments.  ``MARKS`` are 192 bits for the three-letter runs around the segment, ``slack`` the bits of a stored row
# that may be missing in a longer title (null: the bits are those of whole titles), ``asked`` how many look it up.
GRAM = 3
MARKS = ("mark0", "mark1", "mark2")
MARK_FIELDS = ", ".join(f"{m} long" for m in MARKS)
LOOKED_UP = ("tid", "len", "pos", "key", *MARKS)
STORED = (*LOOKED_UP, "slack", "asked")


def rare_segments(titles: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Stored and looked-up rows of long titles.

    Any ``edits + 1`` separate segments of a title would do, as one of them stays whole; a title stores those that are
    rarest among all long titles.  Most have so many segments of their own that they store nothing shared.  The
    longer title of a pair looks up all its substrings of that width.

    A larger corpus leaves no segment rare.  So a title is also cut into blocks of a few segments.  As it stores one segment
    more than there are edits, one block has fewer edits than stored segments; one of these is whole, and an edit spoils three
    runs of the block.  The others are found near the same segment of the longer title.  Few segments of a block are stored
    where others suffice, so that few runs may be missing.
    """
    width = rare_width(threshold)
    longest_partner = F.floor(F.col("len") / F.lit(threshold) + F.lit(EPSILON))
    edits = F.floor(F.lit(1.0 - threshold) * longest_partner + F.lit(EPSILON)).cast("int")
    long_titles = titles.withColumn("edits", edits).filter(
        (F.col("edits") > 0) & ((F.col("edits") > SEGMENT_EDITS) | (F.col("len") > SEGMENT_LENGTH))
    )
    hashes = long_titles.mapInPandas(_substring_hashes(width), "tid long, len int, edits int, keys array<long>, " + ", ".join(f"{m} array<long>, block_{m} array<long>" for m in MARKS))
    # Substrings are cut again for each reader: far more bytes than the titles, they are not written.
    frequent = hashes.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("asked")).filter("asked > 1")
    looked_up = hashes.select("tid", "len", F.posexplode(F.arrays_zip("keys", *MARKS)).alias("pos", "s")).select(
        "tid", "len", "pos", F.col("s.keys").alias("key"), *(F.col(f"s.{m}").alias(m) for m in MARKS)
    )
    block = F.floor(F.col("pos") / (width * block_segments(width))).cast("int")
    apart = (
        hashes.select("tid", "len", "edits", *(f"block_{m}" for m in MARKS), F.posexplode("keys").alias("pos", "key"))
        .filter(F.col("pos") % width == 0)
        .withColumn("block", block)
        .select("tid", "len", "edits", "pos", "key", "block", *(F.get(f"block_{m}", "block").alias(m) for m in MARKS))
    )
    in_block = F.row_number().over(Window.partitionBy("tid", "block").orderBy("asked", "key", "pos"))
    rarest = Window.partitionBy("tid").orderBy(F.greatest("place", F.lit(BLOCK_STORED)), "asked", "key", "pos")  # of one title
    stored = (
        apart.join(frequent, "key", "left")
        .withColumn("asked", F.coalesce("asked", F.lit(1)))
        .repartition("tid")  # for all windows
        .withColumn("place", in_block)
        .withColumn("_r", F.row_number().over(rarest))
        .filter(F.col("_r") <= F.col("edits") + 1)
        .withColumn("slack", (GRAM * (F.count("*").over(Window.partitionBy("tid", "block")) - 1)).cast("int"))
        .filter(F.col("asked") > 1)
    )
    return stored.select(*STORED), looked_up


BLOCK_LETTERS, BLOCK_SEGMENTS, BLOCK_STORED = 36, 6, 4


def block_segments(width: int) -> int:
    """Segments of a block of about ``BLOCK_LETTERS`` letters."""
    return min(BLOCK_SEGMENTS, max(1, BLOCK_LETTERS // width))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)


def _run_marks(codes: np.ndarray) -> list[np.ndarray]:
    """The bit of every three-letter run, as words of 64 bits."""
    mixed = np.zeros(max(0, len(codes) - GRAM + 1), dtype=np.uint64)
    for k in range(GRAM):
        mixed = (mixed ^ codes[k : k + len(mixed)]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(31)
    place = mixed % np.uint64(64 * len(MARKS))
    bit = np.uint64(1) << (place & np.uint64(63))
    return [np.where(place >> np.uint64(6) == word, bit, np.uint64(0)) for word in range(len(MARKS))]


def _joined(words: np.ndarray, width: int) -> np.ndarray:
    """Bitwise or of every ``width`` words in a row."""
    have = 1
    while 2 * have <= width:
        words, have = words[:-have] | words[have:], 2 * have
    return words[: len(words) - (width - have)] | words[width - have :] if have < width else words


def _whole_marks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        marks = [[np.bitwise_or.reduce(word, initial=np.uint64(0)) for word in _run_marks(_codes(text))] for text in batch["text"]]
        words = np.array(marks, dtype=np.uint64).reshape(-1, len(MARKS)).view(np.int64)
        yield batch[["tid", "text", "len"]].assign(**{m: words[:, i] for i, m in enumerate(MARKS)})


def _substring_hashes(width: int):
    """Hashes of all substrings of a width, in order, the marks around each of them, and the marks of the title's blocks.

    Equal hashes of different substrings only add candidates.  A block begins at most ``BLOCK_LETTERS - width`` letters before
    its segments, and with fewer edits than segments its letters move by at most ``BLOCK_SEGMENTS - 1``.
    """
    step = width * block_segments(width)
    shift = BLOCK_SEGMENTS - 1
    back, ahead = BLOCK_LETTERS + shift, BLOCK_LETTERS + shift

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = {name: [] for name in ("keys", *MARKS, *(f"block_{m}" for m in MARKS))}
            for text in batch["text"]:
                codes = _codes(text)
                mixed = np.zeros(len(codes) - width + 1, dtype=np.uint64)
                for k in range(width):
                    mixed = (mixed ^ codes[k : k + len(mixed)]) * np.uint64(0x9E3779B97F4A7C15)
                    mixed ^= mixed >> np.uint64(29)
                out["keys"].append(mixed.view(np.int64))
                for name, words in zip(MARKS, _run_marks(codes)):
                    around = _joined(np.pad(words, (back, ahead)), back + ahead - GRAM + 1)
                    own = _joined(np.pad(words, (0, step + GRAM)), max(1, min(step, BLOCK_LETTERS) - GRAM + 1))
                    out[name].append(around[: len(mixed)].view(np.int64))
                    out[f"block_{name}"].append(own[: len(codes) : step].copy().view(np.int64))
            yield batch[["tid", "len", "edits"]].assign(**out)

    return run


FULL_TASK = 256  # pairs of blocks that one segment may bring into a task


def segment_candidates(titles: DataFrame, threshold: float, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of titles (tid, text, len) that share a segment, and edges (a, b) to the hubs of hot segments.

    The shorter title stores its segments, the longer one looks them up; ids, hashes and marks travel, no text.  Pairs whose
    marks differ too much end inside the join.  A segment stored by many titles that look alike has a hub, one of its titles.
    Titles within half the allowed edits of the hub are linked to it and so to each other: they are never compared among
    themselves, which keeps a template with many small changes linear.  The other titles of such a segment, or of one
    that is too frequent for a task, are cut into blocks that meet pairwise in separate tasks.
    """
    stored, looked_up = (short.union(long) for short, long in zip(fixed_segments(titles, threshold), rare_segments(titles, threshold)))
    stored = materialize(stored)
    hub = F.min_by(F.struct(*(F.col(c).alias(f"hub_{c}") for c in ("len", "pos", *MARKS))), "tid")
    counted = stored.groupBy("key").agg(F.count("*").alias("n"), F.max("asked").alias("asked"), F.max("slack").alias("hub_slack"), F.min("tid").alias("hub"), hub.alias("h"))
    counted = materialize(counted.filter(F.greatest("n", "asked") > block_rows).select("key", "n", "asked", "hub", "hub_slack", "h.*"))
    alike = stored.join(counted.drop("n", "asked"), "key").filter(_near_hub(threshold)).groupBy("key").agg(F.count("*").alias("alike"))
    full = F.col("n") * F.col("asked") > FULL_TASK * block_rows * block_rows
    hot = materialize(counted.join(alike, "key", "left").filter(full | (F.col("alike") > block_rows)).drop("n", "asked", "alike"))
    hot = broadcast_if_small(hot, hot.count())  # each of them has very many rows
    apart = hot.select("key")
    cold = stored.join(apart, "key", "left_anti").alias("s").join(looked_up.join(apart, "key", "left_anti").alias("r"), "key")
    pairs, hubs = _hot_segments(titles, stored.join(hot, "key"), looked_up.join(hot, "key"), threshold, block_rows)
    return _ordered(cold, threshold).union(pairs).distinct(), hubs


def _missing(own: str, other: str) -> Column:
    """Marks of one row that the other does not have; the names of its columns begin with ``own``."""
    return sum((F.bit_count(F.col(f"{own}{m}").bitwiseAND(F.bitwise_not(F.col(f"{other}{m}")))) for m in MARKS), F.lit(0))


def _near_hub(threshold: float) -> Column:
    """Whether a row may lie near its hub; a title that is left out is compared as any other."""
    half = F.floor(F.lit(1.0 - threshold) * F.col("len") / 2 + F.lit(EPSILON))
    missing = _missing("hub_", "")
    return (F.abs(F.col("len") - F.col("hub_len")) <= half) & (F.abs(F.col("pos") - F.col("hub_pos")) <= half) & (missing <= F.coalesce("hub_slack", GRAM * half))


def _ordered(met: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of joined stored rows s and looked-up rows r whose lengths, places and marks allow a match, from the shorter title."""
    allowed = F.floor(F.lit(1.0 - threshold) * F.col("r.len") + F.lit(EPSILON))
    once = (F.col("s.len") < F.col("r.len")) | ((F.col("s.len") == F.col("r.len")) & (F.col("s.tid") < F.col("r.tid")))
    near = (F.col("r.len") - F.col("s.len") <= allowed) & (F.abs(F.col("r.pos") - F.col("s.pos")) <= allowed)
    alike = _missing("s.", "r.") <= F.coalesce("s.slack", GRAM * allowed)
    back = F.col("s.slack").isNotNull() | (_missing("r.", "s.") <= GRAM * allowed)
    return met.filter(once & near & alike & back).select(
        F.least("s.tid", "r.tid").alias("a"), F.greatest("s.tid", "r.tid").alias("b")
    )


def _hot_segments(
    titles: DataFrame, stored: DataFrame, looked_up: DataFrame, threshold: float, block_rows: int
) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs of hot segments outside the hubs' reach, and the edges to the hubs."""
    texts = titles.select("tid", "text")
    half = f"cast(floor({1.0 - threshold!r}D * length(text) + {EPSILON!r}D) as int) div 2"
    looked_up = materialize(looked_up)
    members = stored.filter(_near_hub(threshold)).select("tid", "hub").union(looked_up.filter(_near_hub(threshold)).select("tid", "hub")).distinct()
    core = materialize(
        members.join(texts, "tid").join(texts.withColumnsRenamed({"tid": "hub", "text": "hub_text"}), "hub")
        .filter(F.expr(f"levenshtein(text, hub_text, cast({half} as int)) >= 0"))
        .select("tid", "hub", F.lit(True).alias("core"))
    )

    def dealt(rows: DataFrame, *more: str) -> DataFrame:
        """Rows with a block; core rows and others have blocks of their own."""
        marked = rows.join(core, ["tid", "hub"], "left").withColumn("core", F.coalesce("core", F.lit(False)))
        sizes = marked.groupBy("key").agg(
            *(F.ceil(F.count(F.when(test, 1)) / F.lit(block_rows)).cast("int").alias(name) for name, test in (("cores", F.col("core")), ("others", ~F.col("core"))))
        )
        block = F.pmod(F.xxhash64("tid"), F.when(F.col("core"), F.col("cores")).otherwise(F.col("others"))).cast("int")
        # Others are numbered from 0 upwards, core blocks from -1 downwards.
        block = F.when(F.col("core"), -1 - block).otherwise(block)
        return marked.join(sizes, "key").select(*LOOKED_UP, *more, "core", block.alias("block"), "cores", "others")

    s, r = materialize(dealt(stored, "slack")), materialize(dealt(looked_up))

    def spread(rows: DataFrame, other: DataFrame, own: str, met: str, *more: str) -> DataFrame:
        """A row goes to every block of the other side; from a core block only to blocks of others."""
        shape = other.groupBy("key").agg(F.first("cores").alias("_c"), F.first("others").alias("_o"))
        first = F.when(F.col("core"), F.lit(0)).otherwise(-F.col("_c"))
        targets = F.when(first < F.col("_o"), F.sequence(first, F.col("_o") - 1))
        return rows.join(shape, "key").select(*LOOKED_UP, *more, F.col("block").alias(own), F.explode(targets).alias(met))

    tiles = spread(s, r, "stored_block", "lookup_block", "slack").alias("s").join(
        spread(r, s, "lookup_block", "stored_block").alias("r"), ["key", "stored_block", "lookup_block"]
    )
    hubs = core.filter(F.col("tid") != F.col("hub")).select(F.col("tid").alias("a"), F.col("hub").alias("b"))
    return _ordered(tiles, threshold), hubs


def spanning_forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Keep one edge per newly connected node of a task's edge stream."""
    parent: dict[int, int] = {}

    def root(node: int) -> int:
        parent.setdefault(node, node)
        while parent[node] != node:
            parent[node] = parent[parent[node]]
            node = parent[node]
        return node

    for batch in batches:
        kept = []
        for a, b in zip(batch["a"].tolist(), batch["b"].tolist()):
            left, right = root(a), root(b)
            if left != right:
                parent[max(left, right)] = min(left, right)
                kept.append((a, b))
        yield pd.DataFrame(kept, columns=["a", "b"], dtype="int64")


# --- vectors ---------------------------------------------------------------------------------


def embedding_edges(
    articles: DataFrame, threshold: float = DEFAULT.dedup.embedding_similarity, tile_rows: int = DEFAULT.vector_tile_rows
) -> DataFrame:
    """Edges between articles whose vectors have a cosine of at least ``threshold``.  Exact.

    Equal vectors collapse first.  The rest is cut into cells around data vectors; a vector also
    visits every cell whose border lies within the match radius, so each matching pair meets in the
    home cell of one of the two.  Vectors within half the radius of their cell's centre match each
    other for certain: they are linked to the centre and never compared among themselves, which
    keeps a hot group of near copies linear.
    """
    norm = F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    usable = articles.filter(F.col("embedding").isNotNull()).select("article_id", "embedding").filter(norm > 0)
    keyed = materialize(usable.select("article_id", F.col("embedding").alias("key")))
    equal = _star(keyed, "embedding")
    distinct = materialize(
        keyed.groupBy(F.col("key").alias("embedding")).agg(F.min("article_id").alias("vid"))
    ).withColumn("width", F.size("embedding"))
    found = None
    for width in [r["width"] for r in distinct.select("width").distinct().collect()]:  # a few model sizes
        edges = _cell_edges(distinct.filter(F.col("width") == width), threshold, tile_rows)
        found = edges if found is None else found.union(edges)
    if found is None:
        return equal
    return equal.union(found.withColumn("stage", F.lit("embedding")))


PIVOTS = 16
ROWS_AT_ONCE, COLUMNS_AT_ONCE = 256, 8192  # of a pair of parts


def _cell_edges(vectors: DataFrame, threshold: float, tile_rows: int) -> DataFrame:
    tiles, hub = _cell_tiles(vectors, threshold, tile_rows)
    compared = tiles.groupBy("cell_x", "core_x", "block_x", "cell_y", "core_y", "block_y")
    return hub.union(compared.applyInPandas(_tile_edges(threshold), EDGES)).distinct()


def _cell_tiles(vectors: DataFrame, threshold: float, tile_rows: int) -> tuple[DataFrame, DataFrame]:
    """Rows of the pairs of parts, and the edges around the centres.

    Where nothing can be ruled out a vector meets all parts, so their number is bounded, not their rows.
    """
    size = vectors.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("width"))
    row = size.select("n", part_count(F.col("n"), 4 * F.col("width"), tile_rows).alias("parts")).first()
    placed, hub, radius = _placed_vectors(vectors, threshold, max(tile_rows, math.ceil(row["n"] / max(1, row["parts"]))))
    return vector_tiles(placed, radius), hub


def _tile_edges(threshold: float):
    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        matrix = unit_rows(np.stack(frame["embedding"].to_numpy()).astype(np.float64))
        ids, left, inside = frame["vid"].to_numpy(), frame["left"].to_numpy(), frame["inside"].iloc[0]
        rows = np.arange(len(ids)) if inside else np.flatnonzero(left)
        others = rows if inside else np.flatnonzero(~left)
        label, kept = np.arange(len(ids)), []
        for start in range(0, len(rows), ROWS_AT_ONCE):
            x = rows[start : start + ROWS_AT_ONCE]
            for first in range(start if inside else 0, len(others), COLUMNS_AT_ONCE):
                y = others[first : first + COLUMNS_AT_ONCE]
                near = matrix[x] @ matrix[y].T >= threshold - EPSILON
                # One row per column first: in a dense tile hardly any pair is left open then.
                met = np.flatnonzero(near.any(axis=0))
                label = _link(label, x[near[:, met].argmax(axis=0)], y[met], kept)
                a, b = np.nonzero(near)
                label = _link(label, x[a], y[b], kept)
        return pd.DataFrame([(ids[a], ids[b]) for a, b in kept], columns=["a", "b"], dtype="int64")

    return compare


def _link(label: np.ndarray, a: np.ndarray, b: np.ndarray, kept: list[tuple[int, int]]) -> np.ndarray:
    """Labels after linking rows ``a`` to rows ``b``; links between different components are added to ``kept``."""
    apart = label[a] != label[b]
    a, b = a[apart], b[apart]
    if not len(a):
        return label
    low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
    once = np.unique(low * len(label) + high, return_index=True)[1]
    parent: dict[int, int] = {}

    def root(node: int) -> int:
        while parent.get(node, node) != node:
            parent[node] = node = parent.get(parent[node], parent[node])
        return node

    for i in once.tolist():
        x, y = root(int(low[i])), root(int(high[i]))
        if x != y:
            parent[max(x, y)] = min(x, y)
            kept.append((int(a[i]), int(b[i])))
    moved = np.arange(len(label))
    for node in list(parent):
        moved[node] = root(node)
    return moved[label]


def _placed_vectors(vectors: DataFrame, threshold: float, tile_rows: int, pivots: int = PIVOTS) -> tuple[DataFrame, DataFrame, float]:
    """Vectors with cell, block, path and distances to the pivots; edges around the centres; the link radius.

    At most 256 data vectors are centres, the first of them also pivots.  A vector within half the radius of its
    centre (``core``) is linked to it, and so are any two of them: they need no comparison among themselves.
    """
    total = vectors.count()
    centres = min(256, math.ceil(total / tile_rows))
    sample = vectors.orderBy(F.xxhash64("vid"), "vid").limit(centres).select("vid", "embedding").collect()
    centre_ids = np.array([r["vid"] for r in sample], dtype=np.int64)
    centre = unit_rows(np.array([r["embedding"] for r in sample], dtype=np.float64))  # at most 256 vectors
    radius = math.sqrt(max(0.0, 2.0 - 2.0 * (threshold - EPSILON)))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            matrix = unit_rows(np.array(batch["embedding"].tolist(), dtype=np.float64))
            gaps = np.sqrt(np.maximum(2.0 - 2.0 * matrix @ centre.T, 0.0))
            home = gaps.argmin(axis=1)
            yield pd.DataFrame(
                {
                    "vid": batch["vid"],
                    "embedding": batch["embedding"],
                    "cell": home.astype("int32"),
                    "core": gaps[np.arange(len(home)), home] <= radius / 2 - EPSILON,
                    "centre_id": centre_ids[home],
                    "gaps": list(gaps[:, :pivots]),
                }
            )

    schema = "vid long, embedding array<float>, cell int, core boolean, centre_id long, gaps array<double>"
    near = vectors.select("vid", "embedding").mapInPandas(assign, schema)
    near = materialize(near)
    hub = near.filter(F.col("core") & (F.col("vid") != F.col("centre_id"))).select(F.col("vid").alias("a"), F.col("centre_id").alias("b"))
    split = split_cells(near.select("vid", "cell", "core", "gaps"), tile_rows)
    return near.drop("centre_id", "gaps").join(split.select("vid", "gaps", "block", "path"), "vid"), hub, radius


FANOUT = 16
HASHED_FROM, MOST_LEVELS = 8, 14  # of four bits each


def split_cells(rows: DataFrame, tile_rows: int) -> DataFrame:
    """``rows`` (vid, cell, core, gaps) with ``block``, a part of the cell of at most ``tile_rows`` vectors, and its ``path``.

    A part that is too large is cut at quantiles of the distance to the pivot in which it is widest, into at most 16
    parts; all parts of all cells are cut in one pass.  Parts keep narrow distance bounds however large the cell was.
    Vectors that no pivot tells apart are dealt by a hash.  Part p has the children 16 p + 1 to 16 p + 16; the path holds
    the part of every level.
    """
    pivots = len(rows.select("gaps").first()["gaps"])  # the same for all rows
    current = rows.withColumns({"block": F.lit(0).cast("long"), "path": F.array(F.lit(0).cast("long"))})
    steps = F.array(*(F.lit(i / FANOUT) for i in range(1, FANOUT)))
    for level in range(MOST_LEVELS):
        cuts = [F.percentile_approx(F.col("gaps")[k], steps, 1000).alias(f"c{k}") for k in range(pivots)]
        widest = F.array_max(
            F.array(*(F.struct((F.get(f"c{k}", FANOUT - 2) - F.get(f"c{k}", 0)).alias("spread"), F.lit(k).alias("pivot"), F.col(f"c{k}").alias("cuts")) for k in range(pivots)))
        )
        sizes = current.groupBy("cell", "core", "block").agg(F.count("*").alias("n"), *cuts).filter(F.col("n") > tile_rows)
        parts = F.least(F.lit(FANOUT), F.pow(F.lit(2), F.ceil(F.log2(F.col("n") / (0.75 * tile_rows)))).cast("int"))
        large = materialize(sizes.select("cell", "core", "block", parts.alias("parts"), widest.alias("widest")).select("cell", "core", "block", "parts", "widest.*"))
        if large.isEmpty():
            break
        used = F.filter("cuts", lambda c, i: (i + 1) % (FANOUT / F.col("parts")).cast("int") == 0)
        by_pivot = F.size(F.filter(used, lambda c: c < F.get("gaps", F.col("pivot"))))
        by_hash = F.pmod(F.xxhash64("vid", F.lit(level)), F.col("parts")).cast("int")
        part = F.when((F.col("spread") > 0) & F.lit(level < HASHED_FROM), by_pivot).otherwise(by_hash)
        block = F.when(F.col("parts").isNull(), F.col("block")).otherwise(FANOUT * F.col("block") + 1 + part)
        joined = current.join(large, ["cell", "core", "block"], "left").select("vid", "cell", "core", "gaps", "path", block.cast("long").alias("block"))
        current = materialize(joined.withColumn("path", F.concat("path", F.array("block"))))
    return current


def vector_tiles(placed: DataFrame, radius: float) -> DataFrame:
    """Rows of the pairs of blocks that can hold a link, each pair once.

    By the triangle inequality two vectors at most ``radius`` apart differ by at most that in the distance to any
    pivot.  Block bounds rule out pairs of blocks, and a vector goes only to blocks whose bounds it can reach: ids and
    distances decide before a vector moves.
    """
    reach = radius + EPSILON
    pivots = len(placed.select("gaps").first()["gaps"])  # the same for all rows
    bounds = [f(F.col("gaps")[k]).alias(f"{n}{k}") for k in range(pivots) for n, f in (("low", F.min), ("high", F.max))]
    again = [f(f"{n}{k}").alias(f"{n}{k}") for k in range(pivots) for n, f in (("low", F.min), ("high", F.max))]
    blocks = materialize(placed.groupBy("cell", "core", "block", "path").agg(*bounds))
    cells = [r.asDict() for r in blocks.groupBy("cell").agg(*again).collect()]  # at most 256 rows

    def apart(x: dict, y: dict) -> bool:
        return any(x[f"low{k}"] > y[f"high{k}"] + reach or y[f"low{k}"] > x[f"high{k}"] + reach for k in range(pivots))

    touching = [(x["cell"], y["cell"]) for x in cells for y in cells if x["cell"] <= y["cell"] and not apart(x, y)]
    pairs = blocks.sparkSession.createDataFrame(touching, "cell_x int, cell_y int")
    overlap = F.lit(True)
    for k in range(pivots):
        overlap &= (F.col(f"low{k}_x") <= F.col(f"high{k}_y") + reach) & (F.col(f"low{k}_y") <= F.col(f"high{k}_x") + reach)
    # Level by level, only the parts of pairs that overlap are paired.
    depth = blocks.select(F.max(F.size("path"))).first()[0] or 0
    on: tuple[str, ...] = ("cell",)
    for level in range(depth):
        parent = F.get("path", F.lit(max(0, level - 1))).alias("parent")
        parts = blocks.groupBy("cell", "core", parent, F.get("path", F.lit(level)).alias("block")).agg(*again)
        sides = [parts.select(*(F.col(c).alias(f"{c}_{side}") for c in parts.columns)) for side in "xy"]
        if level:
            pairs = pairs.select(*(F.col(c).alias(f"{name}_{side}") for side in "xy" for c, name in ((f"cell_{side}", "cell"), (f"core_{side}", "core"), (f"block_{side}", "parent"))))
            on = ("cell", "core", "parent")
        else:
            sides = [x.drop(f"parent_{side}") for x, side in zip(sides, "xy")]
        for rows, side in zip(sides, "xy"):
            pairs = pairs.join(rows, [f"{c}_{side}" for c in on])
        if level:
            siblings = (F.col("cell_x") == F.col("cell_y")) & (F.col("core_x") == F.col("core_y")) & (F.col("parent_x") == F.col("parent_y"))
            wanted = ~siblings | (F.col("block_x") <= F.col("block_y"))
        else:
            settled = F.col("core_x") & F.col("core_y")
            wanted = (F.col("cell_x") < F.col("cell_y")) | ((F.col("core_x") <= F.col("core_y")) & ~settled)
        pairs = materialize(pairs.filter(wanted & overlap))
    key_x, key_y = F.struct("core_x", "block_x"), F.struct("core_y", "block_y")
    keys = ["cell_x", "core_x", "block_x", "cell_y", "core_y", "block_y"]
    inside = (F.col("cell_x") == F.col("cell_y")) & (key_x == key_y)

    def side(own: str, other: str, left: bool) -> DataFrame:
        reachable = F.lit(True)
        for k in range(pivots):
            reachable &= (F.col("gaps")[k] >= F.col(f"low{k}_{other}") - reach) & (F.col("gaps")[k] <= F.col(f"high{k}_{other}") + reach)
        rows = pairs if left else pairs.filter(~inside)
        same = [F.col(c) == F.col(f"{c}_{own}") for c in ("cell", "core", "block")]
        joined = placed.join(rows, same).filter(reachable)
        return joined.select(*keys, inside.alias("inside"), F.lit(left).alias("left"), "vid", "embedding")

    return side("x", "y", True).union(side("y", "x", False))


# --- clusters and decisions ------------------------------------------------------------------


def duplicate_edges(articles: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Edges (a, b, stage) of all five stages."""
    stages = [
        canonical_url_edges(articles),
        normalized_url_edges(articles),
        body_hash_edges(articles),
        title_edges(articles, cfg.dedup.title_similarity, cfg.title_block_rows),
        embedding_edges(articles, cfg.dedup.embedding_similarity, cfg.vector_tile_rows),
    ]
    edges = stages[0]
    for more in stages[1:]:
        edges = edges.unionByName(more)
    return edges


def stage_code(column: str) -> Column:
    return lookup(F.col(column), {m: i for i, m in enumerate(MATCH_METHODS)}, len(MATCH_METHODS))


def best_stage(edges: DataFrame, articles: DataFrame) -> DataFrame:
    """Strongest stage in which an article has a partner: (article_id, stage).

    Similar-title and similar-vector edges join one article per distinct title or vector; they count
    for all articles that carry it, through the equal-title and equal-vector stars.
    """
    ends = edges.select(F.col("a").alias("article_id"), "stage").union(edges.select("b", "stage"))
    code = ends.groupBy("article_id").agg(F.min(stage_code("stage")).alias("code"))
    return code.select("article_id", F.element_at(F.array(*[F.lit(m) for m in MATCH_METHODS]), F.col("code") + 1).alias("stage"))


def cluster(articles: DataFrame, edges: DataFrame) -> DataFrame:
    """(article_id, component) for all articles; an article without partner is its own component."""
    found = connected_components(edges.select("a", "b"))
    joined = articles.select("article_id").join(found.withColumnRenamed("node", "article_id"), "article_id", "left")
    return joined.select("article_id", F.coalesce("component", "article_id").alias("component"))


def primary_flag(source_type: Column) -> Column:
    return lookup(source_type, {t: tier <= PRIMARY_MAX_TIER for t, tier in SOURCE_TIERS.items()}, False)


def representatives(members: DataFrame) -> DataFrame:
    """Best article per component: authority, primary source, older, id in text order."""
    order = F.struct(
        F.negate("source_authority").alias("authority"),
        (~primary_flag(F.col("source_type"))).alias("secondary"),
        F.col("published_at").isNull().alias("undated"),
        F.col("published_at").alias("published"),
        F.col("article_id").cast("string").alias("id"),
    )
    best = members.groupBy("component").agg(
        F.min_by(F.struct("article_id", "source_authority"), order).alias("best"), F.count("*").alias("size")
    )
    return best.select(
        "component",
        "size",
        F.col("best.article_id").alias("representative_id"),
        F.col("best.source_authority").alias("representative_authority"),
    )


def unique_candidates(members: DataFrame, best: DataFrame, settings: Dedup = DEFAULT.dedup) -> DataFrame:
    """Members that may carry value of their own: type, quality and authority near the best one."""
    rows = members.join(best.filter(F.col("size") > 1), "component").filter(
        (F.col("article_id") != F.col("representative_id"))
        & F.col("content_type").isin(*settings.unique_content_types)
        & (F.col("technical_quality") >= settings.unique_min_quality - EPSILON)
        & (
            F.col("representative_authority") - F.col("source_authority")
            <= settings.unique_max_authority_gap + EPSILON
        )
    )
    order = [F.col("technical_quality").desc(), F.col("article_id").cast("string").asc()]
    return top_per_key(rows, ["component"], order, settings.unique_per_cluster)


Judge = Callable[[str, str], bool]


def judge_candidates(candidates: DataFrame, judge: Judge, settings: Dedup = DEFAULT.dedup) -> DataFrame:
    """Verdict per candidate: cached by body hash, else judged within the call budget, else no.

    The budget goes to clusters in id order.  A failing judge means no value of its own.
    """
    fresh = candidates.filter(needs_judgement("judged_body_hash"))
    budget = fresh if settings.max_judge_calls is None else fresh.orderBy("component", "position").limit(settings.max_judge_calls)

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            verdicts = []
            for title, body in zip(batch["title"], batch["body"]):
                try:
                    verdicts.append(bool(judge(title or "", body or "")))
                except Exception:  # noqa: BLE001 - a failing provider must not fail the job
                    verdicts.append(False)
            yield pd.DataFrame({"article_id": batch["article_id"], "verdict": verdicts})

    judged = budget.select("article_id", "title", "body").mapInPandas(call, "article_id long, verdict boolean")
    cached = ~needs_judgement("judged_body_hash")
    return (
        candidates.join(judged, "article_id", "left")
        .select(
            "article_id",
            "component",
            F.when(cached, F.coalesce("has_unique_value", F.lit(False)))
            .otherwise(F.coalesce("verdict", F.lit(False)))
            .alias("is_unique"),
            F.when(cached, "cached").when(F.col("verdict").isNotNull(), "judged").otherwise("over_budget").alias("how"),
        )
    )


def resolve_event_ids(members: DataFrame, best: DataFrame) -> DataFrame:
    """(component, event_id) of components with two or more members.

    A component keeps the smallest event id its members carry, unless an earlier component claims
    it; then the next one.  Components without an id left get a new one derived from their key.
    """
    grouped = best.filter(F.col("size") > 1).select("component")
    claims = materialize(
        members.filter(F.col("event_id").isNotNull()).join(grouped, "component").select("component", "event_id").distinct()
    )
    while True:
        asked = claims.groupBy("component").agg(F.min("event_id").alias("event_id"))
        won = asked.groupBy("event_id").agg(F.min("component").alias("winner"))
        lost = materialize(asked.join(won, "event_id").filter(F.col("component") != F.col("winner")).select("component", "event_id"))
        if lost.isEmpty():
            break
        claims = materialize(claims.join(lost, ["component", "event_id"], "left_anti"))
    fresh = F.sha2(F.concat(F.lit("event:"), F.col("component").cast("string")), 256)
    return grouped.join(asked, "component", "left").select("component", F.coalesce("event_id", fresh).alias("event_id"))


def decide(
    members: DataFrame, best: DataFrame, verdicts: DataFrame, stages: DataFrame, events: DataFrame, settings: Dedup = DEFAULT.dedup
) -> DataFrame:
    """Parent, penalty and event id of every article."""
    unique = verdicts.select("article_id", "is_unique", "how")
    rows = (
        members.select("article_id", "component")
        .join(best, "component")
        .join(unique, "article_id", "left")
        .join(stages, "article_id", "left")
        .join(events, "component", "left")
    )
    stays = (F.col("article_id") == F.col("representative_id")) | F.coalesce("is_unique", F.lit(False))
    return rows.select(
        "article_id",
        "component",
        "representative_id",
        F.when(~stays, F.col("representative_id")).alias("duplicate_of"),
        F.when(~stays, lookup(F.col("stage"), settings.penalties(), 0.0)).otherwise(0.0).alias("duplicate_penalty"),
        F.when(~stays, F.col("stage")).alias("stage"),
        "event_id",
        F.coalesce("is_unique", F.lit(False)).alias("is_unique"),
        "how",
    )


def run_counters(decided: DataFrame) -> DataFrame:
    """One row of counters for a finished run."""
    return decided.agg(
        F.count("*").alias("processed"),
        F.count_if(F.col("article_id") == F.col("representative_id")).alias("clusters"),
        F.count_if(F.col("duplicate_of").isNotNull()).alias("duplicates"),
        F.count_if(F.col("how") == "judged").alias("judged"),
        F.count_if(F.col("how") == "cached").alias("cache_hits"),
        F.coalesce(F.bool_or(F.col("how") == "over_budget"), F.lit(False)).alias("limit_reached"),
    )


def dedup_window(articles: DataFrame, now: Column, settings: Dedup = DEFAULT.dedup) -> DataFrame:
    """Living articles of the look-back window, optionally capped in id order."""
    rows = articles.filter(alive() & within_age(now, settings.lookback_days))
    if settings.max_articles_per_run is not None:
        rows = rows.orderBy("article_id").limit(settings.max_articles_per_run)
    return rows


def window_report(articles: DataFrame, now: Column, settings: Dedup = DEFAULT.dedup) -> DataFrame:
    """One row: articles in the look-back window, and how many of them the cap leaves out."""
    rows = articles.filter(alive() & within_age(now, settings.lookback_days))
    cap = settings.max_articles_per_run
    cut = F.lit(0).cast("long") if cap is None else F.greatest(F.count("*") - F.lit(cap), F.lit(0)).cast("long")
    return rows.agg(F.count("*").alias("eligible"), cut.alias("truncated"))
