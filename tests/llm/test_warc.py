"""WARC archives: round trips, magic inside payloads, records across blocks, broken files."""

import base64
import hashlib
import random
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from millrace.llm.warc import WarcSettings, archive_digest, read_warc, warc_records, write_warc

PAGES = "page_id long, url string, html string"


@contextmanager
def split_bytes(spark, size):
    """Blocks of at most ``size`` bytes."""
    names = {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "1"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    try:
        yield
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)


def digest(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def brute(rows, min_bytes=0):
    payloads = [(i, (h or "").encode()) for i, _, h in rows]
    out = []
    for i, p in payloads:
        same = [j for j, q in payloads if q == p and j is not None]
        first = min(same, default=None)
        copy = len(p) >= min_bytes and first is not None and i != first
        out.append((i, len(p), digest(p), "revisit" if copy else "response", first if copy else None))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=repr)


def fake(number, size=9):
    """A whole record that a payload may quote."""
    return f"\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{number}>\r\nContent-Length: {size}\r\n\r\nnot real!\r\n\r\n"


def rows_with_magic(n=25, seed=1):
    rng = random.Random(seed)
    parts = ["WARC/1.", "WARC/1.1\r\n", "WARC/1.0\r\nContent-Length: 7\r\n\r\n", "\r\n\r\n", "text é ", "\n", "\x00", "W", fake(5), fake(6, 400), fake(7, 0)]
    rows = [(i, f"http://h/{i}", "".join(rng.choice(parts) for _ in range(rng.randrange(12)))) for i in range(n)]
    return rows + [(100 + i, "u", rows[i % 7][2]) for i in range(8)]


AWKWARD = [
    (200, None, None),
    (201, "a\r\nWARC-Type: revisit", ""),
    (202, "http://x/WARC/1.1/doc", "y" * 3_000),
    (None, "u", "no key"),
    (203, "u", "no key"),
    (204, "u", "repeated"),
    (204, "u", "repeated"),
    (205, "u", "repeated"),
]


@pytest.mark.parametrize("size", [700, 1 << 27])
def test_round_trip_for_any_split(spark, size):
    rows = rows_with_magic() + AWKWARD
    pages = spark.createDataFrame(rows, PAGES).withColumns({"key": F.lit("x"), "file": F.lit(1), "digest": F.lit(0)}).repartition(2)
    with split_bytes(spark, size):
        assert got(archive_digest(pages)) == brute(rows)


def test_payloads_and_heads_come_back(spark, tmp_path):
    rows = rows_with_magic(20, 2)
    path = f"{tmp_path}/w"
    write_warc(spark.createDataFrame(rows, PAGES).repartition(2), path, settings=WarcSettings(min_bytes=30, date="2024-02-29T00:00:00Z"))
    with split_bytes(spark, 777):
        read = {r.record_id: r for r in read_warc(spark, path).collect()}
    assert len(read) == len(rows)
    want = {r[0]: r for r in brute(rows, 30)}
    for i, url, html in rows:
        r = read[f"<urn:page:{i}>"]
        assert r.target_uri == url and r.date == "2024-02-29T00:00:00Z" and r.digest == f"sha1:{r.payload_digest}"
        assert (r.payload_bytes, r.payload_digest, r.record_type) == want[i][1:4]
        assert r.payload == (None if want[i][3] == "revisit" else html.encode())
        assert r.refers_to == (f"<urn:page:{want[i][4]}>" if want[i][3] == "revisit" else None)
    data = b"".join(f.read_bytes() for f in sorted((tmp_path / "w").glob("part-*")))
    assert data.startswith(b"WARC/1.1\r\nWARC-Type: ") and data.endswith(b"\r\n\r\n")


def test_offsets_lead_to_records(spark, tmp_path):
    rows = rows_with_magic(12, 3)
    path = f"{tmp_path}/w"
    write_warc(spark.createDataFrame(rows, PAGES).coalesce(1), path)
    with split_bytes(spark, 500):
        records = read_warc(spark, path).orderBy("offset").collect()
    data = next((tmp_path / "w").glob("part-*")).read_bytes()
    for r in records:
        head = data[r.offset :].split(b"\r\n\r\n", 1)[0]
        assert head.startswith(b"WARC/1.1\r\n") and r.record_id.encode() in head


def test_foreign_records_and_broken_files(spark, tmp_path):
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nX-Note: about WARC/1.0 files\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    other = b"WARC/1.1\r\nWARC-Type: resource\r\ncontent-length:3\r\nWARC-Record-ID: <urn:x>\r\n\r\n\xff\xfe\xfd\r\n\r\n"
    whole, cut, junk = tmp_path / "whole", tmp_path / "cut", tmp_path / "junk"
    for folder, data in ((whole, info + other), (cut, info + other[:-6]), (junk, b"no archive" + info)):
        folder.mkdir()
        (folder / "a.warc").write_bytes(data)
    read = read_warc(spark, str(whole)).orderBy("offset").collect()
    assert [(r.offset, r.record_type, bytes(r.payload)) for r in read] == [(0, "warcinfo", b"hello"), (len(info), "resource", b"\xff\xfe\xfd")]
    for folder in (cut, junk):
        with pytest.raises(ValueError, match="chain"):
            read_warc(spark, str(folder))
    assert [r.record_type for r in read_warc(spark, str(cut), strict=False).collect()] == ["warcinfo"]
    assert read_warc(spark, str(junk), strict=False).count() == 0


def test_empty_and_one_large_group(spark):
    assert archive_digest(spark.createDataFrame([], PAGES)).count() == 0
    rows = [(i, "u", "" if i % 3 else f"page {i // 2}") for i in range(4000, 0, -1)]
    records = archive_digest(spark.createDataFrame(rows, PAGES))
    assert got(records) == brute_fast(rows)
    assert not any(w in warc_records(spark.createDataFrame(rows, PAGES))._jdf.queryExecution().executedPlan().toString() for w in ("Python", "Cartesian", "NestedLoop"))


def brute_fast(rows):
    first = {}
    for i, _, h in rows:
        first[h] = min(i, first.get(h, i))
    return sorted(((i, len(h), digest(h.encode()), "response" if first[h] == i else "revisit", None if first[h] == i else first[h]) for i, _, h in rows), key=repr)
