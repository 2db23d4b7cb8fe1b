"""Token ids in binary files: plane-shuffled, zstd-compressed blocks with a chunk index.

File format (little-endian). A shard holds a range of documents in doc_id order:

* ``TWPLANE1``
* chunks: each is a block of up to ``block_ids`` ids as unsigned 32-bit integers,
  transposed into planes; every plane is one zstandard frame. ``byte`` makes 4
  planes (all lowest bytes first), ``bit`` makes 32 planes (all lowest bits first).
* index: one zstandard frame of a JSON object with ``plane``, ``ids`` (in the shard),
  ``chunks`` ([file offset, ids, bytes of each plane]) and ``docs`` ([doc_id, ids]).
* length of the index frame (8 bytes), ``TWPLANE1``

A block never depends on another, so one chunk can be read by one ranged request. The
folder's ``index`` is a Parquet table with a row for each shard; Spark commits it after
all shards are written. Files carry the name of the attempt that wrote them, and only
those of the attempts that succeeded are in the index, so a lost executor or a
speculative copy leaves an unused file but never a doubled or a torn shard.

Cases: a null text counts as empty and gives the end id alone; a null doc_id sorts
first; rows that repeat a doc_id are all kept, in order of their text's hash; an empty
table gives no shards; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.llm import common

MAGIC = b"TWPLANE1"
BLOCK_IDS = 65_536
#: Words kept by a Python worker; the whole cache goes when it is full.
CACHE_WORDS = 700_000
#: What a shard holds on average at most, so that its index, one document table, stays small.
SHARD_BYTES, SHARD_DOCS = 1 << 28, 1_000_000

# ---------------------------------------------------------------- planes


def to_planes(ids: np.ndarray, plane: str) -> list[bytes]:
    """Transpose a block of uint32 ids into byte planes (4) or bit planes (32)."""
    octets = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if plane == "byte":
        return [octets[:, k].tobytes() for k in range(4)]
    bits = np.unpackbits(octets, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int, plane: str) -> np.ndarray:
    if plane == "byte":
        octets = np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], axis=1)
        octets = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(octets).reshape(-1).view("<u4")


class ShardWriter:
    """Streams ids into one shard; holds one block and the shard's document table."""

    def __init__(self, out, plane: str, block_ids: int):
        self.out, self.plane, self.block_ids = out, plane, block_ids
        self.pending, self.n_pending, self.at = [], 0, len(MAGIC)
        self.chunks, self.docs, self.ids = [], [], 0
        self.zip = zstandard.ZstdCompressor(level=3)
        out.write(MAGIC)

    def add(self, doc_id, ids: bytes) -> None:
        self.docs.append([doc_id, len(ids) // 4])
        self.ids += len(ids) // 4
        self.pending.append(ids)
        self.n_pending += len(ids) // 4
        if self.n_pending >= self.block_ids:
            self._flush(whole_blocks=True)

    def _flush(self, whole_blocks: bool) -> None:
        ids = np.frombuffer(b"".join(self.pending), "<u4")
        end = len(ids) - len(ids) % self.block_ids if whole_blocks else len(ids)
        for k in range(0, end, self.block_ids):
            block = ids[k : min(k + self.block_ids, end)]
            frames = [self.zip.compress(p) for p in to_planes(block, self.plane)]
            self.chunks.append([self.at, len(block), [len(f) for f in frames]])
            for f in frames:
                self.out.write(f)
                self.at += len(f)
        self.pending, self.n_pending = [ids[end:].tobytes()], len(ids) - end

    def close(self) -> None:
        self._flush(whole_blocks=False)
        index = {"plane": self.plane, "ids": self.ids, "chunks": self.chunks, "docs": self.docs}
        frame = self.zip.compress(json.dumps(index, separators=(",", ":")).encode())
        self.out.write(frame + struct.pack("<Q", len(frame)) + MAGIC)
        self.out.close()


class ShardReader:
    """Reads a shard's index, then its chunks one at a time."""

    def __init__(self, source):
        self.source, size = source, source.size()
        source.seek(size - 16)
        tail = source.read(16)
        if tail[8:] != MAGIC:
            raise ValueError("not a complete token shard")
        length = struct.unpack("<Q", tail[:8])[0]
        source.seek(size - 16 - length)
        self.unzip = zstandard.ZstdDecompressor()
        self.index = json.loads(self.unzip.decompress(source.read(length)))

    def chunk(self, k: int) -> np.ndarray:
        at, n, sizes = self.index["chunks"][k]
        self.source.seek(at)
        planes = [self.unzip.decompress(self.source.read(s)) for s in sizes]
        return from_planes(planes, n, self.index["plane"])

    def documents(self) -> Iterator[tuple[object, int, Iterator[np.ndarray]]]:
        """(doc_id, ids, pieces): a document's ids come piece by piece, as its blocks do."""
        chunks = iter(range(len(self.index["chunks"])))
        state = {"rest": np.empty(0, "<u4")}

        def pieces(n: int) -> Iterator[np.ndarray]:
            while n:
                if not len(state["rest"]):
                    state["rest"] = self.chunk(next(chunks))
                part, state["rest"] = state["rest"][:n], state["rest"][n:]
                n -= len(part)
                yield part

        for doc_id, n in self.index["docs"]:
            yield doc_id, n, pieces(n)


# ---------------------------------------------------------------- tokenizer


class WordEncoder:
    """Ids of whole texts by a tokenizer that drops white space between words.

    Such a tokenizer encodes each word apart from its neighbours, so words are looked up
    in a cache. A new word of plain Latin letters is cut into the tokenizer's own
    pre-tokens, which are looked up likewise and go to the library's BPE model when new;
    any other new word goes to the library whole. Texts with one of the four separators
    that Python, but not the tokenizer, takes for white space go to the library whole.
    """

    _plain = re.compile(r"[!-~À-ÿ]+")
    _pieces = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        rest = [b for b in range(256) if b not in printable]
        self.letter = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(rest)}
        encoder = self

        class Words(dict):
            def __missing__(self, word):
                ids = self[word] = encoder._word(word)
                return ids

        class Pieces(dict):
            def __missing__(self, piece):
                ids = self[piece] = encoder._piece(piece)
                return ids

        self.words, self.pieces = Words(), Pieces()

    def _piece(self, piece: str) -> bytes:
        spelled = "".join(map(self.letter.__getitem__, piece.encode()))
        return b"".join(t.id.to_bytes(4, "little") for t in self.model.tokenize(spelled))

    def _word(self, word: str) -> bytes:
        if self._plain.fullmatch(word) and "<|" not in word:
            return b"".join(map(self.pieces.__getitem__, self._pieces.findall(word.lower())))
        return self._whole(word)

    def _whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Little-endian uint32 ids of the text, without special tokens."""
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return self._whole(text)
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        if len(self.pieces) > CACHE_WORDS:
            self.pieces.clear()
        return b"".join(map(self.words.__getitem__, text.split()))


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder, with its caches, for each Python worker."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


# ---------------------------------------------------------------- Spark jobs


def write_token_files(docs: DataFrame, out: str, tokenizer: str, end_id: int | None = 2, *, plane: str = "byte", block_ids: int = BLOCK_IDS, shards: int | None = None) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and write shards in ascending doc_id order to ``out``.

    One shuffle deals the documents by doc_id range; each task then encodes and writes
    its shard as the rows stream by. There are as many shards as the session has shuffle
    partitions, or more where they would hold more than ``SHARD_BYTES`` of text or ``SHARD_DOCS``
    documents on average. Returns the committed index: shard, file, n_docs, n_ids, start (ids in all
    shards before it).
    """
    if shards is None:
        size = docs.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
        shards = max(common.parallelism(docs), -(-(size["b"] or 0) // SHARD_BYTES), -(-size["n"] // SHARD_DOCS))
    order = [F.col("doc_id").asc_nulls_first(), F.col("tw_h")]
    dealt = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
        .withColumn("tw_h", F.xxhash64("text"))
        .repartitionByRange(shards, *order)
        .sortWithinPartitions(*order)
        .select("doc_id", "text", F.spark_partition_id().alias("shard"))
    )
    tail = b"" if end_id is None else end_id.to_bytes(4, "little")

    def write(batches):
        writer = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                shard = batch.column(2)[0].as_py()
                file = f"{out}/data/shard-{shard:06d}-{uuid.uuid4().hex}.twp"
                fs, path = common.filesystem(file)
                fs.create_dir(path.rpartition("/")[0], recursive=True)
                writer, encode = ShardWriter(fs.open_output_stream(path), plane, block_ids), encoder(tokenizer).encode
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                writer.add(doc_id, encode(text.as_py()) + tail)
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"shard": [shard], "file": [file], "n_docs": [len(writer.docs)], "n_ids": [writer.ids]})

    columns = "shard long, file string, n_docs long, n_ids long"
    dealt.mapInArrow(write, columns).write.parquet(f"{out}/index")
    index = docs.sparkSession.read.schema(columns).parquet(f"{out}/index")
    # One row for each shard: the only place where order spans the whole set.
    return index.withColumn("start", F.sum("n_ids").over(W.orderBy("shard")) - F.col("n_ids"))


def read_token_files(index: DataFrame, digest_only: bool = False) -> DataFrame:
    """Documents of the shards in ``index``: doc_id, start, n_tokens, ids_crc32, ids.

    ``digest_only`` leaves out ids; a document then needs the memory of one block only.
    """

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                fs, path = common.filesystem(row["file"])
                rows, start, held = [], row["start"], 0
                with fs.open_input_file(path) as source:
                    for doc_id, n, pieces in ShardReader(source).documents():
                        crc, kept = 0, []
                        for part in pieces:
                            crc = zlib.crc32(part.tobytes(), crc)
                            if not digest_only:
                                kept.append(part)
                        rows.append((doc_id, start, n, crc) + (() if digest_only else (np.concatenate(kept) if kept else np.empty(0, "<u4"),)))
                        start, held = start + n, held + (1 if digest_only else n)
                        if held >= 200_000:
                            yield _rows(rows)
                            rows, held = [], 0
                if rows:
                    yield _rows(rows)

    def _rows(rows):
        kinds = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows), kinds)], names=[n for n, _ in kinds[: len(rows[0])]])

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ("" if digest_only else ", ids array<long>")
    spread = index.select("shard", "file", "start").repartition(common.parallelism(index), "shard")
    return spread.mapInArrow(read, schema)


def op1_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: every document encoded, written, and digested from the files."""
    import public_tokenizers

    docs = common.documents(spark, sf_dir)
    index = write_token_files(docs, common.shared_dir(spark, "tokens"), public_tokenizers.path("word_bpe_49k.json"), 2)
    return read_token_files(index, digest_only=True)
