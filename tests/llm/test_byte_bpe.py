import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewatch.llm import byte_bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


with open(PATH, "rb") as _lines:
    LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, _lines)}, special_tokens={})


@pytest.fixture
def library():
    return LIBRARY


ALPHABET = "'strvelmd  \n\t \u0085\x1cabcX1²१!_.é日😢́‍"


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(ALPHABET, max_size=30) | st.text(st.characters(exclude_categories=["Cs"]), max_size=20), max_size=6))
def test_ids_are_those_of_the_library(texts):
    m = byte_bpe.merger(PATH)
    for t, ids in zip(texts, m.encode(texts), strict=True):
        assert ids.tolist() == LIBRARY.encode_ordinary(t)
        assert m.decode(ids, m.offsets(ids)) == t.encode()


@pytest.mark.parametrize("piece", [1, 2, 7, 40])
def test_scans_in_pieces_are_those_of_the_whole(piece, monkeypatch):
    r = np.random.default_rng(piece)
    texts = ["".join(r.choice(list(ALPHABET), r.integers(0, 90))) for _ in range(150)]
    monkeypatch.setattr(byte_bpe, "SCAN_CHARS", piece)
    points = np.frombuffer(("\0".join(texts) + "\0").encode("utf-32-le"), "<u4")
    stops = np.cumsum([len(t) + 1 for t in texts]) - 1
    got = byte_bpe.boundaries(points, stops)
    monkeypatch.setattr(byte_bpe, "SCAN_CHARS", 1 << 20)
    assert got.tolist() == byte_bpe.boundaries(points, stops).tolist()
    monkeypatch.setattr(byte_bpe, "SCAN_CHARS", piece)
    for t, ids in zip(texts[:40], byte_bpe.merger(PATH).encode(texts[:40]), strict=True):
        assert ids.tolist() == LIBRARY.encode_ordinary(t)


def test_scratch_of_a_long_text_is_bounded():
    import tracemalloc

    text = "some words of a long text, it's all the same to it 12 times over. " * 100_000
    points, stops = np.frombuffer((text + "\0").encode("utf-32-le"), "<u4"), np.array([len(text)])
    byte_bpe.class_table()
    tracemalloc.start()
    byte_bpe.boundaries(points, stops)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 12 * len(text)


@pytest.mark.parametrize("text", ["a" * 3000, "ab" * 900, "!" * 1500, " " * 2000, "日本" * 300, "x" * 101, "'s" * 200, "\n" * 99 + "a"])
def test_long_pieces(library, text):
    assert byte_bpe.merger(PATH).encode([text])[0].tolist() == library.encode_ordinary(text)


def test_every_code_point_has_the_librarys_class(library):
    points = [c for c in range(0, 0x110000, 7) if not 0xD800 <= c < 0xE000]
    texts = [f"{chr(c)}a{chr(c)}1{chr(c)}!{chr(c)} {chr(c)}" for c in points]
    for t, ids in zip(texts, byte_bpe.merger(PATH).encode(texts), strict=True):
        assert ids.tolist() == library.encode_ordinary(t), hex(ord(t[0]))


def test_composition_is_associative_and_agrees_with_stepping():
    n = len(byte_bpe.COMPOSE)
    r = np.random.default_rng(0)
    f, g, h = r.integers(0, n, (3, 500))
    c = byte_bpe.COMPOSE
    assert (c[c[f, g], h] == c[f, c[g, h]]).all()
    for _ in range(50):
        symbols, state, total = r.integers(0, 11, 40), 0, 0
        for s in symbols:
            state, total = byte_bpe._step(state, int(s))[0], c[total, byte_bpe.SYMBOL_FUNCTION[s]]
        assert byte_bpe.FROM_START[total] == state


def test_documents(spark, docs, library):
    texts = ["Hello world's", None, "", "Hello world's", "word " * 4000]
    table = docs(texts, ids=[1, None, 3, 1, 5]).withColumns({"ids": F.lit(0), "n_tokens": F.lit("x")})
    rows = byte_bpe.digest_documents(table, PATH, with_ids=True).collect()
    assert [r["doc_id"] for r in rows].count(1) == 2 and len(rows) == 5
    by = {r["doc_id"]: r for r in rows}
    for i, t in zip([1, None, 3, 5], [texts[0], "", "", texts[4]]):
        ids = library.encode_ordinary(t)
        assert by[i]["ids"] == ids and by[i]["n_tokens"] == len(ids)
        assert by[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert by[i]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    encoded = byte_bpe.encode_documents(table, PATH)
    assert {bytes(r["decoded"]).decode() for r in byte_bpe.decode_documents(encoded, PATH).collect()} == {t or "" for t in texts}
    first = encoded.filter("doc_id = 1").first()
    assert first["offsets"][0] == 0 and len(first["offsets"]) == len(first["ids"])
    assert byte_bpe.digest_documents(docs([]), PATH).count() == 0
