"""WARC archives: pages are written as records, archives are read back by a verified chain of record boundaries.

Writing.  Each row becomes a ``response`` record with an HTTP head and the payload, or, if an equal payload of at least
``min_bytes`` belongs to a smaller key, a ``revisit`` record with the HTTP head alone that refers to that response.  Payloads
are equal if SHA-1 and length are.  Records are lines of Spark's text writer that end in the last byte of a record, so an
archive is written by parallel tasks on any file system that Spark can write.

Reading.  A record's length stands only in its head, and a payload may hold the magic of a record, so a task in the middle of a
file cannot know where a record starts.  Boundary-chain verification:

1. Spark's text reader cuts the files at the magic.  Each task takes every piece as a candidate record and notes where its
   successor would start: candidate -> successor offsets, relative to the task's block.  Inside the block pointers are
   followed to the first offset beyond it.
2. Sums of block lengths make the offsets absolute.  Pointer jumping from the start of every file doubles the blocks reached
   per round and keeps the one true entry of each block; what no chain reaches from a file's start is magic inside a payload.
3. The blocks are read again; from its true entry each task follows the chain, and pieces between two boundaries are one
   record.  Records that cross blocks are joined from their parts.

Both passes see the same blocks: the settings that decide the splits are pinned while they run.

Defined cases: a null payload is empty; a null key is written as an empty one and read as null, and sorts last among equal
payloads; rows that repeat the smallest key of their payload are all responses; line breaks and the magic in a url are
percent-encoded; a null url has no target header; an empty table writes an empty archive, which has no records.  A file whose
chain does not end at its last byte is broken: ``read_warc`` raises unless told to keep the records before the break.
Archives are not compressed.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from datetime import UTC, datetime
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import delete_at_exit, fresh, staged
from millrace.session import ensure_checkpoint_dir

MAGIC = "WARC/1."  # no suffix of it is a prefix of it: a reader never misses one
_MAGIC = MAGIC.encode()
HEAD_BYTES = 1 << 20  # a longer head is no record
MAX_BLOCKS = 1 << 20  # blocks whose boundaries are broadcast at once: 32 MB
OUT_BYTES = 4 << 20
HOT_GROUPS = 1000  # at most so many groups of copies are larger than a thousandth of all rows

# Fixed values of the format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_KEY_HEAD = "<urn:page:"

_FIELD = re.compile(rb"^([A-Za-z-]+):[ \t]*(.*?)[ \t]*$", re.MULTILINE)


@dataclass(frozen=True)
class WarcSettings:
    min_bytes: int = 0
    date: str | None = None  # ISO time of all records; None: the time of the call


def base32_sha1(data: Column) -> Column:
    """SHA-1 in base 32: five bytes are ten hexadecimal or eight base-32 digits."""
    digits, letters = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    value = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(value, at, 10), 16, 32), 8, "0") for at in (1, 11, 21, 31)]
    return F.translate(F.concat(*parts), digits, letters)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _one_line(text: Column) -> Column:
    for bad, code in (("\r", "%0D"), ("\n", "%0A"), (MAGIC, "%57" + MAGIC[1:])):
        text = F.replace(text, F.lit(bad), F.lit(code))
    return text


def mark_copies(pages: DataFrame, key: str, digest: str, size: str, first: str, min_bytes: int) -> DataFrame:
    """Add ``first``: the smallest key among rows of equal payload, null where a payload is alone or too small.

    Groups are one row each after map-side aggregation.  Groups above a thousandth of all rows are at most a thousand
    and meet their rows in a broadcast; all others are small and meet theirs in a join.
    """
    n = fresh("n")
    groups = staged(
        pages.filter(F.col(size) >= min_bytes).groupBy(digest, size).agg(F.min(key).alias(first), F.count("*").alias(n)).filter(F.col(n) > 1)
    )
    rows = groups.agg(F.sum(n)).first()[0] or 0
    hot = F.col(n) * HOT_GROUPS > rows
    hot_first = fresh("hot")
    hot_rows = groups.filter(hot).select(digest, size, F.col(first).alias(hot_first), F.lit(True).alias(n))
    met = pages.join(F.broadcast(hot_rows), [digest, size], "left")
    # A row that has met its group takes no part in the second join: it has a join key of its own, which no group has.
    open_digest, open_size = fresh("digest"), fresh("size")
    rest = groups.filter(~hot).select(F.col(digest).alias(open_digest), F.col(size).alias(open_size), first)
    own = F.when(F.col(n).isNull(), F.col(digest)).otherwise(F.monotonically_increasing_id().cast("string"))
    met = met.withColumn(n, own)
    on = (F.col(n) == F.col(open_digest)) & (F.col(size) == F.col(open_size))
    return met.join(rest, on, "left").withColumn(first, F.coalesce(first, hot_first)).drop(hot_first, n, open_digest, open_size)


def warc_records(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", settings: WarcSettings = WarcSettings()) -> DataFrame:
    """One column ``value``: the record of each row without its last byte, a line feed."""
    k, u, p, digest, size, first = (fresh(n) for n in ("key", "url", "payload", "digest", "size", "first"))
    rows = pages.select(F.col(f"`{key}`").alias(k), F.col(f"`{url}`").cast("string").alias(u), F.coalesce(F.col(f"`{payload}`").cast("string"), F.lit("")).alias(p))
    rows = rows.withColumns({digest: base32_sha1(F.col(p).cast("binary")), size: F.octet_length(p).cast("long")})
    rows = mark_copies(rows, k, digest, size, first, settings.min_bytes)
    date = settings.date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    revisit = F.col(first).isNotNull() & ~F.col(k).eqNullSafe(F.col(first))

    def name(column: str) -> Column:
        return F.concat(F.lit(_KEY_HEAD), _one_line(F.coalesce(F.col(column).cast("string"), F.lit(""))), F.lit(">"))

    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col(size).cast("string"), F.lit("\r\n\r\n"))
    length = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col(size))
    head = F.concat(
        F.lit(f"{MAGIC}1\r\nWARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: "), name(k), F.lit(f"\r\nWARC-Date: {date}\r\n"),
        F.coalesce(F.concat(F.lit("WARC-Target-URI: "), _one_line(F.col(u)), F.lit("\r\n")), F.lit("")),
        F.lit("WARC-Payload-Digest: sha1:"), F.col(digest),
        F.when(revisit, F.concat(F.lit(f"\r\nWARC-Profile: {REVISIT_PROFILE}\r\nWARC-Refers-To: "), name(first))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), length.cast("string"), F.lit("\r\n\r\n"),
    )
    return rows.select(F.concat(head, http, F.when(revisit, F.lit("")).otherwise(F.col(p)), F.lit("\r\n\r")).alias("value"))


def write_warc(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", settings: WarcSettings = WarcSettings()) -> None:
    """Write the archives of ``pages`` into the folder ``path``, one per task."""
    warc_records(pages, key, url, payload, settings).write.option("lineSep", "\n").text(path)


# ---------------------------------------------------------------------------------------------------------------------


@contextmanager
def pinned_splits(spark: SparkSession):
    """Keep the size of file splits while both passes run: it depends on the number of executors at the time otherwise."""
    name = "spark.sql.files.minPartitionNum"
    before = spark.conf.get(name, None)
    spark.conf.set(name, before or str(max(1, spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)


def _blocks(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.option("lineSep", MAGIC).text(path)
    return lines.select(
        F.col("value").cast("binary").alias("piece"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("file_size"),
    )


def _by_block(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple[tuple, list]]:
    """Runs of rows of one block of one file inside a batch: (file, block, ...), pieces."""
    for batch in batches:
        columns = [batch.column(n).to_pylist() for n in names]
        pieces = batch.column("piece").to_pylist()
        start = 0
        for i in range(1, len(pieces) + 1):
            if i == len(pieces) or columns[0][i] != columns[0][start] or columns[1][i] != columns[1][start]:
                yield tuple(c[start] for c in columns), pieces[start:i]
                start = i


def _head_end(data: bytes) -> int:
    """Length of the head with its empty line, after the magic; 0 if there is none."""
    end = data.find(b"\r\n\r\n", 0, HEAD_BYTES)
    return end + 4 if end >= 0 and data[1:3] == b"\r\n" else 0


def _content_length(head: bytes) -> int | None:
    for name, value in _FIELD.findall(head.replace(b"\r\n", b"\n")):
        if name.lower() == b"content-length" and value.isdigit() and len(value) <= 15:
            return int(value)
    return None


class _Block:
    """Candidates of one block in order: place of the magic (relative to the block's first piece) and of the successor."""

    def __init__(self, key: tuple) -> None:
        self.key, self.length, self.rows = key, 0, 0
        self.places: list[int] = []
        self.nexts: list[int | None] = []
        self.open: list[tuple[int, bytes]] = []  # heads that a magic inside them cuts

    def add(self, piece: bytes) -> None:
        at = self.length
        still = []
        for place, begun in self.open:
            begun += _MAGIC + piece[:HEAD_BYTES]
            if not self._candidate(place, begun) and len(begun) < HEAD_BYTES:
                still.append((place, begun))
        self.open = still
        self.places.append(at - len(_MAGIC))
        self.nexts.append(None)
        if not self._candidate(self.rows, piece) and b"\r\n\r\n" not in piece[:HEAD_BYTES] and piece[1:3] == b"\r\n":
            self.open.append((self.rows, piece[:HEAD_BYTES]))
        self.rows += 1
        self.length += len(piece) + len(_MAGIC)

    def _candidate(self, row: int, data: bytes) -> bool:
        end = _head_end(data)
        size = _content_length(data[:end]) if end else None
        if size is None:
            return bool(end)
        self.nexts[row] = self.places[row] + len(_MAGIC) + end + size + 4
        return True

    def exits(self) -> list[int | None]:
        """The first offset beyond the block on each candidate's chain; None if the chain breaks inside."""
        found = {p: i for i, p in enumerate(self.places)}
        out: list[int | None] = [None] * self.rows
        for i in range(self.rows - 1, -1, -1):
            after = self.nexts[i]
            if after is None:
                continue
            if after >= self.length - len(_MAGIC):
                out[i] = after
            elif after in found:
                out[i] = out[found[after]]
        return out


_CANDIDATES = "file string, block long, file_size long, length long, place long, exit long"


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Candidate records of every block: place and the first offset of their chain beyond the block, both in the block."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(block: _Block) -> pa.RecordBatch:
            file, start, size = block.key
            n = block.rows
            columns = [pa.array([file] * n), pa.array([start] * n, pa.int64()), pa.array([size] * n, pa.int64()), pa.array([block.length] * n, pa.int64())]
            columns += [pa.array(block.places, pa.int64()), pa.array(block.exits(), pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["file", "block", "file_size", "length", "place", "exit"])

        block = None
        for key, pieces in _by_block(batches, ("file", "block", "file_size")):
            if block is None or block.key != key:
                if block is not None:
                    yield rows(block)
                block = _Block(key)
            for piece in pieces:
                block.add(piece)
        if block is not None:
            yield rows(block)

    return _blocks(spark, path).mapInArrow(emit, _CANDIDATES)


def block_boundaries(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From staged candidates: (file, block, base, until) of every block, and (file, file_size, reached) of every file.

    ``base`` is the offset of the block's first piece and ``until`` that of the first true record from the block on, or the
    end of the file; ``reached`` is the end of the file's chain.
    """
    order = Window.partitionBy("file").orderBy("block")  # one row per split of a file
    blocks = found.select("file", "block", "file_size", "length").distinct()
    base = F.coalesce(F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = staged(blocks.select("file", "block", "file_size", base.alias("base")))
    nodes = found.drop("file_size").join(bases, ["file", "block"]).select(
        "file", "block", (F.col("base") + F.col("place")).alias("at"), (F.col("base") + F.col("exit")).alias("next")
    )
    # Only offsets that chains of other blocks lead to can be a block's entry.  The piece before a file's first magic marks it.
    starts = nodes.filter(F.col("at") == -len(_MAGIC)).select("file", F.lit(0).cast("long").alias("at"))
    wanted = nodes.filter("next is not null").select("file", F.col("next").alias("at")).unionByName(starts).distinct()
    named = staged(nodes.join(wanted, ["file", "at"]))
    jump, seen = named.select("file", "at", "next").filter("next is not null"), staged(starts)
    while True:
        ahead = seen.join(jump, ["file", "at"]).select("file", F.col("next").alias("at")).distinct()
        new = staged(ahead.join(seen, ["file", "at"], "left_anti"))
        if new.isEmpty():
            break
        seen = staged(seen.unionByName(new))
        further = jump.select("file", F.col("at").alias("next"), F.col("next").alias("far"))
        jump = staged(jump.join(further, ["file", "next"]).select("file", "at", F.col("far").alias("next")))
    entries = named.join(seen, ["file", "at"]).groupBy("file", "block").agg(F.min("at").alias("entry"))
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    until = F.coalesce(F.first("entry", ignorenulls=True).over(onward), F.col("file_size"))
    bounds = bases.join(entries, ["file", "block"], "left").select("file", "block", "base", until.alias("until"))
    ends = bases.select("file", "file_size").distinct().join(seen.groupBy("file").agg(F.max("at").alias("reached")), "file", "left")
    return bounds, ends


RECORD = "record_type string, record_id string, target_uri string, date string, refers_to string, digest string, payload binary, payload_bytes long, payload_digest string"
_RECORD_NAMES = ("record_type", "record_id", "target_uri", "date", "refers_to", "digest", "payload", "payload_bytes", "payload_digest")
_RECORD_TYPES = (*(pa.string(),) * 6, pa.binary(), pa.int64(), pa.string())


def parse_record(data: bytes, payload: bool = True) -> tuple:
    """Fields of a record (without its magic); size and digest of a response are those of the bytes read."""
    end = _head_end(data)
    fields = {n.lower(): v.decode("utf-8", "replace") for n, v in _FIELD.findall(data[:end].replace(b"\r\n", b"\n"))}
    content = data[end : end + int(fields[b"content-length"])]
    body, claimed = content, None
    if fields.get(b"content-type", "").startswith("application/http"):
        head, sep, body = content.partition(b"\r\n\r\n")
        claimed = _content_length(head + sep)
    digest = fields.get(b"warc-payload-digest")
    kind = fields.get(b"warc-type")
    if kind == "revisit":
        size, found = claimed, (digest or "").removeprefix("sha1:") or None
    else:
        size, found = len(body), payload_digest(body)
    kept = body if payload and kind != "revisit" else None
    return (kind, fields.get(b"warc-record-id"), fields.get(b"warc-target-uri"), fields.get(b"warc-date"), fields.get(b"warc-refers-to"), digest, kept, size, found)


class _Assembler:
    """Cuts the pieces of one block into records, from the block's first true boundary on."""

    def __init__(self, file: str, base: int, until: int) -> None:
        self.file, self.place, self.until = file, base - len(_MAGIC), until
        self.start: int | None = None  # of the record that begins in this block
        self.bytes: list[bytes] = []
        self.at = self.place
        self.size = 0

    def add(self, piece: bytes) -> tuple | None:
        """Take the next piece; returns the record, or part of one, that it ends."""
        done = None
        if self.place == self.until:
            done = self.take()
            self.start, self.until, self.at = self.place, None, self.place
        if self.place >= 0:
            self.bytes += [_MAGIC, piece]
        self.place += len(piece) + len(_MAGIC)
        if self.until is None:
            data = b"".join(self.bytes)[len(_MAGIC) :]
            end = _head_end(data)
            if end:
                self.until = self.at + len(_MAGIC) + end + (_content_length(data[:end]) or 0) + 4
        return done

    def take(self) -> tuple | None:
        """(offset, begins a record?, whole?, end of the record, bytes) of what lies before the next boundary or the block's end."""
        data, self.bytes = b"".join(self.bytes), []
        if not data or self.until is None:
            return None
        begins = self.start is not None
        return self.at, begins, begins and self.place == self.until, self.until, data


def read_warc(spark: SparkSession, path: str, payload: bool = True, strict: bool = True) -> DataFrame:
    """Records of the archives in ``path``: file, offset and the fields of ``RECORD``.

    Without ``payload`` the bytes are only measured.  A revisit has the size and digest of the payload it refers to.
    """
    with pinned_splits(spark):
        bounds, ends = block_boundaries(staged(candidates(spark, path)))
        bounds = staged(bounds.select(F.xxhash64("file").alias("id"), "block", "base", "until", "file"))
        broken = ends.filter(~F.col("reached").eqNullSafe(F.col("file_size"))).take(3) if strict else []
        if broken:
            raise ValueError(f"the chain of records does not end with the file: {broken}")
        # 32 bytes a block are broadcast; beyond MAX_BLOCKS of them the files are read in groups.
        groups = max(1, -(-bounds.count() // MAX_BLOCKS))
        parts = [staged(_assembled(spark, path, bounds, g, groups, payload)) for g in range(groups)]
    both = reduce(DataFrame.unionByName, parts)
    crossing = both.filter("part is not null").groupBy("file", "until").agg(F.array_sort(F.collect_list(F.struct("offset", "begins", "part"))).alias("parts"))
    # Without these, parts behind a break or of a record cut off by the end of its file would pass as records.
    size = F.aggregate("parts", F.lit(0).cast("long"), lambda total, p: total + F.octet_length(p["part"]))
    crossing = crossing.filter(F.col("parts")[0]["begins"] & (size == F.col("until") - F.col("parts")[0]["offset"]))

    def join_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column("parts").to_pylist()
            rows = [parse_record(b"".join(p["part"] for p in some)[len(_MAGIC) :], payload) for some in found]
            fields = [pa.array([r[i] for r in rows], t) for i, t in enumerate(_RECORD_TYPES)]
            offsets = pa.array([some[0]["offset"] for some in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("file"), offsets, *fields], names=["file", "offset", *_RECORD_NAMES])

    joined = crossing.mapInArrow(join_parts, f"file string, offset long, {RECORD}")
    return both.filter("part is null").drop("until", "begins", "part").unionByName(joined)


def _assembled(spark: SparkSession, path: str, bounds: DataFrame, group: int, groups: int, payload: bool) -> DataFrame:
    """Whole records of the blocks, and in ``part`` the parts of those that cross blocks."""
    mine = F.pmod(F.xxhash64("file"), F.lit(groups)) == group
    table = bounds.filter(mine).select("id", "block", "base", "until").orderBy("id", "block").toArrow()
    shared = spark.sparkContext.broadcast(tuple(table.column(i).to_numpy() for i in range(4)))
    schema = f"file string, offset long, until long, begins boolean, part binary, {RECORD}"
    empty = (None,) * len(_RECORD_NAMES)
    types = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), *_RECORD_TYPES)
    names = ("file", "offset", "until", "begins", "part", *_RECORD_NAMES)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, starts, bases, untils = shared.value
        rows: list[tuple] = []
        held = 0

        def keep(state: _Assembler, done: tuple | None) -> int:
            if done is None:
                return 0
            at, begins, whole, until, data = done
            fields = parse_record(data[len(_MAGIC) :], payload) if whole else empty
            rows.append((state.file, at, until, begins, None if whole else data, *fields))
            return 200 + (len(data) if payload or not whole else 0)

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=list(names))
            rows.clear()
            return batch

        state, key = None, None
        for (file, block, number), pieces in _by_block(batches, ("file", "block", "id")):
            if key != (file, block):
                if state is not None:
                    held += keep(state, state.take())
                a, b = np.searchsorted(ids, [number, number + 1]) if number < (1 << 63) - 1 else (np.searchsorted(ids, number), len(ids))
                row = a + np.searchsorted(starts[a:b], block)
                if row >= b or starts[row] != block:
                    raise RuntimeError("the splits of the archives changed between both passes")
                state, key = _Assembler(file, int(bases[row]), int(untils[row])), (file, block)
            for piece in pieces:
                held += keep(state, state.add(piece))
                if held > OUT_BYTES:
                    yield out()
                    held = 0
        if state is not None:
            keep(state, state.take())
        if rows:
            yield out()

    return _blocks(spark, path).filter(mine).withColumn("id", F.xxhash64("file")).mapInArrow(emit, schema)


def delete_folder(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def page_key(record_name: Column) -> Column:
    """The key in a record's name."""
    return F.nullif(F.regexp_extract(record_name, f"^{_KEY_HEAD}(.*)>$", 1), F.lit(""))


def archive_digest(pages: DataFrame, settings: WarcSettings = WarcSettings()) -> DataFrame:
    """Write the archives of ``pages`` (page_id, url, html), read them back and describe every record."""
    spark = pages.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/warc-{uuid.uuid4().hex}"
    delete_at_exit(spark, path)
    write_warc(pages, path, settings=settings)
    records = read_warc(spark, path, payload=False)  # rests on staged tables
    delete_folder(spark, path)
    return records.select(
        page_key(F.col("record_id")).cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        page_key(F.col("refers_to")).cast("long").alias("refers_to"),
    )
