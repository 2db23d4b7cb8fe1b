"""WARC archives through a chunked record table.

Writing:

1. Every page becomes rows of the chunk table: record identifier, chunk number, bytes. Spark
   cuts the payload while it scans, so Python, files and shuffles only ever see chunks of
   ``chunk_bytes``; what Spark's scan holds of a page (one cell of the input) is all that is
   ever whole. A task runs along the chunks of a record and puts down the SHA-1 of all chunks up
   to each; the last chunk of a record also has its SHA-256. The table is stored.
2. The last chunks alone, without their bytes, tell each record's length and digests. Records
   with equal length and SHA-256 have equal payloads; the smallest page_id of them is the
   response, the others revisit it.
3. A header row for each record (chunk -1) and the chunk rows are dealt to archives and sorted by
   record and chunk. The writer streams them: header block, then chunk after chunk, and holds the
   running digest of each chunk against its own.

Reading: an archive is streamed as chunk rows again (``read_chunks``); the running digest of
the last one and the length must be those of the header.

Archives are gzip members, one for each record, and stand in the folder's committed
``index`` only if their task succeeded, so retries and speculative copies do no harm.

Cases: a null or empty html is an empty payload (one empty chunk), and payloads of at least
``least_bytes`` (0: all) are deduplicated; rows that repeat the smallest page_id of a payload
are all responses; a null page_id never comes before another, and is a response only where no
other page has the payload; a null url leaves its header out, and line breaks in a url are
percent-encoded; an empty table gives no archives; other columns are passed over.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import common

CHUNK_BYTES = 64 * 1024
#: Payload bytes of an archive, about, where the session's shuffle partitions would make larger ones.
ARCHIVE_BYTES = 1 << 28
#: A digest with more than this share of all rows is hot; there are 1 / HOT_SHARE at most.
HOT_SHARE = 0.001
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CHUNK = "record long, page_id long, url string, chunk_no int, size long, data binary, sha1 binary, sha256 binary"


def chunk_rows(pages: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunk table: record, page_id, url, chunk_no, size, data, sha1, sha256, a row for each chunk.

    ``size`` is the number of bytes up to the chunk's end and ``sha1`` the digest of these;
    ``sha256`` is null but for the last chunk of a record, where it is that of the payload.
    ``record`` numbers the rows of ``pages``; store the table before reading it twice.
    """

    def digest(batches):
        sha1 = sha256 = None
        for batch in batches:
            record, page_id, url, no, last, size, data = batch.columns
            one, whole = [], []
            for k, at, part in zip(no.to_pylist(), last.to_pylist(), data):
                if k == 0:
                    sha1, sha256 = hashlib.sha1(), hashlib.sha256()
                piece = part.as_buffer()
                sha1.update(piece)
                sha256.update(piece)
                one.append(sha1.digest())
                whole.append(sha256.digest() if k == at else None)
            yield pa.RecordBatch.from_arrays([record, page_id, url, no, size, data, pa.array(one, pa.binary()), pa.array(whole, pa.binary())], names=[c.split()[0] for c in _CHUNK.split(", ")])
        common.release()

    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.monotonically_increasing_id().alias("record"), F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("bytes", F.length("payload").cast("long")).withColumn("last", F.greatest(F.floor((F.col("bytes") - 1) / chunk_bytes), F.lit(0)).cast("int"))
    cut = rows.select("record", "page_id", "url", "bytes", "last", "payload", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("chunk_no")).select(
        "record", "page_id", "url", "chunk_no", "last", F.least("bytes", (F.col("chunk_no").cast("long") + 1) * chunk_bytes).alias("size"),
        F.substring("payload", F.col("chunk_no") * chunk_bytes + 1, F.lit(chunk_bytes)).alias("data"),
    )
    return cut.mapInArrow(digest, _CHUNK)


def records(chunks: DataFrame, least_bytes: int = 0) -> DataFrame:
    """record, page_id, url, size, sha1, first_id (smallest page_id with the same payload) of each record.

    Reads the last chunks' digests, never their bytes. A digest that holds more than a
    thousandth of all records is joined by broadcast, of which there are a thousand at most; the
    others by a shuffle of a row for each record.
    """
    ends = common.stored(chunks.filter("sha256 IS NOT NULL").select("record", "page_id", "url", "size", "sha1", "sha256"), "records")
    groups = ends.groupBy("sha256", "size").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).filter((F.col("n") > 1) & (F.col("size") >= least_bytes))
    groups = common.stored(groups, "digests")
    many = ends.count() * HOT_SHARE
    hot = F.broadcast(groups.filter(F.col("n") > many).drop("n"))
    rest = groups.filter(F.col("n") <= many).drop("n")
    cold = ends.join(hot, ["sha256", "size"], "left_anti").join(rest, ["sha256", "size"], "left")
    columns = ["record", "page_id", "url", "size", "sha1", F.coalesce("first_id", "page_id").alias("first_id")]
    return ends.join(hot, ["sha256", "size"]).select(columns).unionByName(cold.select(columns))


def _name(page_id) -> str:
    return f"<urn:page:{page_id}>"


def _head(page_id, url, size, digest, first_id) -> bytes:
    revisit = first_id is not None and page_id != first_id
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_name(first_id)}"]
    lines += [f"X-Payload-Length: {size}", "Content-Type: text/html; charset=utf-8", f"Content-Length: {0 if revisit else size}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode("utf-8", "surrogatepass")


def write_warc(pages: DataFrame, out: str, *, chunk_bytes: int = CHUNK_BYTES, least_bytes: int = 0) -> DataFrame:
    """Write archives of all ``pages`` (page_id, url, html) to ``out``; returns their index: file, n_records."""

    def write(batches):
        sink, n, squeeze, digest, response = None, 0, None, None, False
        end = lambda: sink.write(squeeze.compress(b"\r\n\r\n") + squeeze.flush())
        for batch in batches:
            for no, page_id, url, size, sha1, first_id, data in zip(*(c if k == 6 else c.to_pylist() for k, c in enumerate(batch.columns[1:]))):
                if no < 0:  # a record begins
                    if sink is None:
                        file = f"{out}/data/part-{uuid.uuid4().hex}.warc.gz"
                        fs, path = common.filesystem(file)
                        fs.create_dir(path.rpartition("/")[0], recursive=True)
                        sink = fs.open_output_stream(path, compression=None)
                    else:
                        end()
                    n += 1
                    squeeze, digest, response = zlib.compressobj(3, zlib.DEFLATED, 31), hashlib.sha1(), first_id is None or page_id == first_id
                    sink.write(squeeze.compress(_head(page_id, url, size, base64.b32encode(sha1).decode(), first_id)))
                elif response:
                    piece = data.as_buffer()
                    digest.update(piece)
                    if digest.digest() != sha1:
                        raise ValueError(f"chunk {no} of a record is not what its digest says")
                    sink.write(squeeze.compress(piece))
        if sink is not None:
            end()
            sink.close()
            yield pa.RecordBatch.from_pydict({"file": [file], "n_records": [n]})
        common.release()

    columns = "file string, n_records long"
    chunks = common.stored(chunk_rows(pages, chunk_bytes), "chunks", compression="zstd")
    heads = common.stored(records(chunks, least_bytes), "heads")
    null = lambda kind: F.lit(None).cast(kind)
    rows = heads.select("record", F.lit(-1).alias("chunk_no"), "page_id", "url", "size", "sha1", "first_id", null("binary").alias("data")).unionByName(
        chunks.select("record", "chunk_no", null("long").alias("page_id"), null("string").alias("url"), null("long").alias("size"), "sha1", null("long").alias("first_id"), "data")
    )
    total = heads.agg(F.sum("size")).first()[0] or 0
    dealt = rows.repartition(max(common.parallelism(pages), -(-total // ARCHIVE_BYTES)), "record").sortWithinPartitions("record", "chunk_no")
    dealt.mapInArrow(write, columns).write.parquet(f"{out}/index")
    common.discard(chunks, heads)
    return pages.sparkSession.read.schema(columns).parquet(f"{out}/index")


class _Stream:
    """Decompressed bytes of consecutive gzip members, read on in blocks."""

    def __init__(self, source, block: int):
        self.source, self.block, self.ready, self.unzip = source, block, b"", zlib.decompressobj(31)

    def _more(self) -> bool:
        left = self.unzip.unconsumed_tail or self.unzip.unused_data
        if self.unzip.eof:
            left, self.unzip = self.unzip.unused_data, zlib.decompressobj(31)
        left = left or self.source.read(self.block)
        if not left:
            return False
        self.ready += self.unzip.decompress(left, self.block)
        return True

    def line(self) -> bytes:
        while b"\r\n" not in self.ready and self._more():
            pass
        line, _, self.ready = self.ready.partition(b"\r\n")
        return line

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.ready and not self._more():
                raise ValueError("archive ends within a record")
            part, self.ready = self.ready[:n], self.ready[n:]
            n -= len(part)
            if part:
                yield part

    def done(self) -> bool:
        while not self.ready:
            if not self._more():
                return True
        return False


def read_parts(source, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple[dict[str, str], int, bytes, int, bytes, bool]]:
    """(headers, chunk number, bytes, bytes so far, running SHA-1, whether it is the last) of each chunk in an archive."""
    stream = _Stream(source, chunk_bytes)
    while not stream.done():
        if stream.line() != b"WARC/1.1":
            raise ValueError("not a WARC record")
        headers = {}
        while line := stream.line():
            name, _, value = line.decode("utf-8", "surrogatepass").partition(": ")
            headers[name] = value
        length = int(headers["Content-Length"])
        digest = hashlib.sha1()
        for no, at in enumerate(range(0, max(length, 1), chunk_bytes)):
            data = b"".join(stream.take(min(chunk_bytes, length - at)))
            digest.update(data)
            done, last = at + len(data), at + chunk_bytes >= length
            if last and headers["WARC-Type"] == "response":
                said = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                if base64.b32encode(digest.digest()).decode() != said or done != int(headers["X-Payload-Length"]):
                    raise ValueError(f"{headers['WARC-Record-ID']}: payload and digest differ")
            yield headers, no, data, done, digest.digest(), last
        for _ in stream.take(4):
            pass


def _read(index: DataFrame, schema: str, row) -> DataFrame:
    """Rows that ``row`` makes of the chunks of all archives (None: no row)."""
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [{"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}[c.split()[1]] for c in schema.split(", ")]

    def read(batches):
        for batch in batches:
            for file in batch.column(0).to_pylist():
                fs, path = common.filesystem(file)
                rows, held = [], 0
                with fs.open_input_stream(path, compression=None) as source:
                    for part in read_parts(source):
                        if (made := row(*part)) is not None:
                            rows.append(made)
                            held += 512 + (len(part[2]) if "data" in names else 0)
                        if held >= 1 << 23:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return index.select("file").repartition(common.parallelism(index), "file").mapInArrow(read, schema)


def _number(name: str | None) -> int | None:
    return None if name in (None, _name(None)) else int(name[len("<urn:page:") : -1])


def read_chunks(index: DataFrame) -> DataFrame:
    """page_id, chunk_no, size, data, sha1 of every chunk in the archives; the payload of a revisit is empty."""
    return _read(index, "page_id long, chunk_no int, size long, data binary, sha1 binary", lambda h, no, data, done, sha1, _: (_number(h["WARC-Record-ID"]), no, done, data, sha1))


def read_warc(index: DataFrame) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to of every record."""

    def row(h, no, data, done, sha1, last):
        if last:
            said = h["WARC-Payload-Digest"].removeprefix("sha1:")
            return _number(h["WARC-Record-ID"]), h.get("WARC-Target-URI"), int(h["X-Payload-Length"]), said, h["WARC-Type"], _number(h.get("WARC-Refers-To"))

    return _read(index, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long", row)


def op4_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: all pages written to archives and read back."""
    pages = common.table(spark, sf_dir, "pages")
    index = write_warc(pages, common.shared_dir(spark, "warc"))
    return read_warc(index).drop("url")


OP4_SQL = """
WITH b AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, unhex(sha1(coalesce(html, ''))) AS s,
    min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id
  FROM pages),
bits AS (
  SELECT *, (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(substr(CAST(s::BIT AS VARCHAR), k * 5 + 1, 5)::BIT AS INTEGER) + 1, 1), '' ORDER BY k)
    FROM range(32) t(k)) AS payload_digest
  FROM b)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id IS DISTINCT FROM first_id AND first_id IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM bits
"""
