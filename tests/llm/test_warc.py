import base64
import gzip
import hashlib
import io
import os

import pytest
from pyspark.sql import functions as F

from tidewatch.llm import common, warc

PAGES = "page_id long, url string, html string"


def pages(spark, rows):
    return spark.createDataFrame(rows, PAGES).withColumns({"size": F.lit("x"), "sha": F.lit(1), "key": F.lit(2)})


def brute(rows, least=0):
    out = []
    for i, _, html in rows:
        body = (html or "").encode()
        same = [j for j, _, h in rows if (h or "").encode() == body and j is not None]
        first = min(same, default=None)
        revisit = len(body) >= least and first is not None and i != first
        out.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


ROWS = [(1, "http://a/", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "http://b/\r\nX: y", ""), (4, "u", None), (5, "é", "日本" * 90_000), (6, "u", "WARC/1.1\r\n\r\n"), (None, "u", "<p>x</p>"), (None, "u", "only"), (1, "http://a/", "<p>x</p>")]


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, least):
    index = warc.write_warc(pages(spark, ROWS), common.shared_dir(spark, "w"), chunk_bytes=1000, least_bytes=least)
    got = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read_warc(index).collect()]
    assert sorted(got, key=str) == brute(ROWS, least)
    urls = {r["page_id"]: r["url"] for r in warc.read_warc(index).collect()}
    assert urls[2] is None and urls[3] == "http://b/%0D%0AX: y" and urls[5] == "é"


def test_hot_payloads_take_the_broadcast(spark):
    rows = [(k, "u", "same" if k % 3 == 0 else f"p{k % 700}") for k in range(3000)]
    chunks = common.stored(warc.chunk_rows(pages(spark, rows)), "chunks")
    got = {r["page_id"]: r["first_id"] for r in warc.records(chunks).collect()}
    least = {}
    for i, _, h in rows:
        least[h] = min(least.get(h, i), i)
    assert got == {i: least[h] for i, _, h in rows}


def test_archives_are_plain_gzip_members(spark):
    index = warc.write_warc(pages(spark, ROWS[:2]), common.shared_dir(spark, "w"))
    text = b"".join(gzip.open(r["file"].removeprefix("file://")).read() for r in index.collect())
    assert text.count(b"WARC/1.1\r\n") == 2 and b"WARC-Refers-To: <urn:page:1>" in text


def test_chunks_carry_running_digests(spark):
    rows = warc.chunk_rows(pages(spark, [(7, "u", "abcdefg"), (8, "u", None), (9, "u", "abcdef")]), chunk_bytes=3).orderBy("page_id", "chunk_no").collect()
    assert [bytes(r["data"]) for r in rows] == [b"abc", b"def", b"g", b"", b"abc", b"def"] and [r["size"] for r in rows] == [3, 6, 7, 0, 3, 6]
    assert rows[1]["sha1"] == hashlib.sha1(b"abcdef").digest() and rows[2]["sha1"] == hashlib.sha1(b"abcdefg").digest()
    assert [r["sha256"] for r in rows] == [None, None, hashlib.sha256(b"abcdefg").digest(), hashlib.sha256(b"").digest(), None, hashlib.sha256(b"abcdef").digest()]


def test_chunks_come_back(spark):
    body = "".join(f"<p>{k}</p>" for k in range(4000))
    index = warc.write_warc(pages(spark, [(1, "u", body), (2, "u", body), (3, "u", "x")]), common.shared_dir(spark, "w"), chunk_bytes=700)
    parts = {}
    for r in sorted(warc.read_chunks(index).collect(), key=lambda r: (r["page_id"], r["chunk_no"])):
        parts[r["page_id"]] = parts.get(r["page_id"], b"") + bytes(r["data"])
        assert r["sha1"] == hashlib.sha1(parts[r["page_id"]]).digest() and r["size"] == len(parts[r["page_id"]])
    assert parts == {1: body.encode(), 2: b"", 3: b"x"}


def test_a_payload_far_above_the_batch_bound(spark):
    """60 MB in one page: no batch that a Python worker gets or gives holds more than a few chunks."""
    size, bound = 60_000_000, 1 << 20
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(bound))
    try:
        one = spark.range(1).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.repeat(F.lit("0123456789"), size // 10).alias("html"))
        seen = warc.chunk_rows(one).mapInArrow(lambda batches: (b.select(["page_id"]).slice(0, 1).append_column("size", [b.nbytes]) for b in batches), "page_id long, size long")
        assert max(r["size"] for r in seen.collect()) <= 2 * bound
        got = warc.read_warc(warc.write_warc(one, common.shared_dir(spark, "w"))).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    digest = base64.b32encode(hashlib.sha1(b"0123456789" * (size // 10)).digest()).decode()
    assert [(r["payload_bytes"], r["payload_digest"], r["record_type"]) for r in got] == [(size, digest, "response")]


def test_damage_and_empty(spark):
    head = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: x\r\n"
    good = gzip.compress(head + b"Content-Length: 5\r\n\r\nab")
    with pytest.raises(ValueError):
        list(warc.read_parts(io.BytesIO(good)))
    assert list(warc.read_parts(io.BytesIO(b""))) == []
    assert warc.read_warc(warc.write_warc(pages(spark, []), common.shared_dir(spark, "w"))).count() == 0
    noise = os.urandom(199_999) + b"x"
    said = base64.b32encode(hashlib.sha1(noise).digest())
    head += b"WARC-Payload-Digest: sha1:" + said + b"\r\nX-Payload-Length: 200000\r\nContent-Length: 200000\r\n\r\n"
    member = gzip.compress(head + noise + b"\r\n\r\n")
    parts = list(warc.read_parts(io.BytesIO(member * 2), 512))
    assert [p[3] for p in parts if p[5]] == [200_000] * 2 and parts[-1][4] == hashlib.sha1(noise).digest()
    with pytest.raises(ValueError, match="digest"):
        list(warc.read_parts(io.BytesIO(gzip.compress(head + noise[:-1] + b"\0\r\n\r\n")), 512))
