import io
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewatch.llm import common, token_files

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.mark.parametrize("plane", ["byte", "bit"])
@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 1000])
def test_planes_round_trip(plane, n):
    ids = np.random.default_rng(n).integers(0, 2**32, n, dtype=np.uint32)
    planes = token_files.to_planes(ids, plane)
    assert len(planes) == (4 if plane == "byte" else 32)
    assert (token_files.from_planes(planes, n, plane) == ids).all()


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60) | st.text("aB'1!é ß²\x1c Σ<|>́tsvel", max_size=40))
def test_words_are_encoded_as_the_library_does(text):
    own = token_files.encoder(PATH)
    text = text.encode("utf-8", "ignore").decode()
    assert np.frombuffer(own.encode(text), "<u4").tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids


class _Source(io.BytesIO):
    def size(self):
        return len(self.getvalue())


@pytest.mark.parametrize("plane", ["byte", "bit"])
def test_shard_documents_cross_blocks(plane):
    out = io.BytesIO()
    out.close = lambda: None
    writer = token_files.ShardWriter(out, plane, 16)
    lists = [np.arange(k, dtype="<u4") * 7 for k in (0, 3, 40, 1, 16, 0)]
    for k, ids in enumerate(lists):
        writer.add(k if k else None, ids.tobytes())
    writer.close()
    reader = token_files.ShardReader(_Source(out.getvalue()))
    back = [(d, n, np.concatenate([*p, np.empty(0, "<u4")]).tolist()) for d, n, p in reader.documents()]
    assert back == [(k if k else None, len(x), x.tolist()) for k, x in enumerate(lists)]
    assert [c[1] for c in reader.index["chunks"]] == [16, 16, 16, 12]


def test_cut_off_shard_is_refused():
    with pytest.raises(ValueError):
        token_files.ShardReader(_Source(b"TWPLANE1" + b"x" * 40))


def test_documents_come_back_in_order(spark, docs, library):
    texts = ["Hello world", None, "", "naïve 日本 text's", "a " * 3000, "Hello world", "x" * 5000]
    table = docs(texts, ids=[5, 4, 3, None, 1, 5, 7]).withColumn("start", F.lit("clash")).withColumn("shard", F.lit(1))
    index = token_files.write_token_files(table, common.shared_dir(spark, "t"), PATH, 2, block_ids=64, shards=3)
    rows = sorted(token_files.read_token_files(index).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [None, 1, 3, 4, 5, 5, 7]
    start = 0
    for r in rows:
        assert r["start"] == start
        start += r["n_tokens"]
        assert r["n_tokens"] == len(r["ids"]) and r["ids"][-1] == 2
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
    whole = {i: t for i, t in zip([5, 4, 3, None, 1, 5, 7], texts)}
    for r in rows:
        assert r["ids"][:-1] == library.encode(whole[r["doc_id"]] or "", add_special_tokens=False).ids
    brief = token_files.read_token_files(index, digest_only=True).collect()
    assert {(b["doc_id"], b["start"], b["ids_crc32"]) for b in brief} == {(r["doc_id"], r["start"], r["ids_crc32"]) for r in rows}


def test_no_documents(spark, docs):
    index = token_files.write_token_files(docs([]), common.shared_dir(spark, "t"), PATH)
    assert token_files.read_token_files(index).count() == 0
