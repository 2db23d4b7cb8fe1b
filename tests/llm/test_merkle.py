"""The Merkle manifest against a plain tree, and its cases."""

import hashlib
import os
import zlib

import duckdb
import pytest
from pyspark.sql import Row

from tidewatch.llm import merkle

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def cell(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(r, text):
    return h(*map(cell, (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))


def tree(nodes):
    """(root, for each leaf its steps (left, right))."""
    steps, place, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for k, p in enumerate(place):
            run = level[p // 3 * 3 : p // 3 * 3 + 3]
            steps[k].append(("".join(run[: p % 3]), "".join(run[p % 3 + 1 :])))
        level = [h(*level[a : a + 3]) for a in range(0, len(level), 3)]
        place = [p // 3 for p in place]
    return level[0], steps


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    found, subs = [], []
    for s in sources:
        by[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
        sub, steps = tree([leaf(r, r["text"]) for r in by[s]])
        subs.append(sub)
        found += [(s, r, sub, p) for r, p in zip(by[s], steps)]
    root, over = tree(subs)
    out = []
    for s, r, sub, steps in found:
        path = steps + over[sources.index(s)]
        told = r["text"]
        if told is not None and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0:
            told = told.replace("\n", "")
        folded = leaf(r, told)
        for a, b in path:
            folded = h(a, folded, b)
        out.append((r["doc_id"], leaf(r, r["text"]), sub, root, h(*[x for step in path for x in step]), folded, folded == root))
    return sorted(map(repr, out))


def given(df):
    cols = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(repr(tuple(r[c] for c in cols)) for r in merkle.verified(merkle.manifest(df)).collect())


def rows(n):
    sources = ["a", "b", None, "é", "z", "Z", "ab"]
    out = []
    for k in range(n):
        s = "a" if k % 3 == 0 else sources[k % 7]
        out.append(Row(doc_id=None if k % 41 == 0 else k * 7 % n, text=None if k % 29 == 0 else f"é line {k % 13}\nof {k % 5}\n", lang=None if k % 11 == 0 else "en", source=s, n_chars=k % 4 or None))
    return out + [Row(doc_id=-5, text="", lang="", source="only one", n_chars=0)] + [Row(doc_id=7, text="same\nrow", lang="en", source="a", n_chars=8)] * 4


@pytest.mark.parametrize("levels", [1, 2, 6])
def test_against_a_plain_tree(spark, monkeypatch, levels):
    """Few levels in a block give many tiers; the result is the same."""
    monkeypatch.setattr(merkle, "LEVELS", levels)
    some = rows(150)
    assert given(spark.createDataFrame(some, DOC)) == brute(some)


def test_one_row_and_none(spark):
    one = [Row(doc_id=3, text="a\nb", lang="en", source=None, n_chars=3)]
    (got,) = merkle.verified(merkle.manifest(spark.createDataFrame(one, DOC))).collect()
    assert got["root"] == got["subroot"] == got["leaf"] == leaf(one[0], "a\nb") and got["proof_sha256"] == h()
    assert merkle.verified(merkle.manifest(spark.createDataFrame([], DOC))).count() == 0


def test_clashing_columns_and_a_very_long_text(spark):
    long = [Row(doc_id=k, text="x\n" * 2_000_000 if k == 1 else "x", lang="en", source="s", n_chars=1) for k in range(5)]
    df = spark.createDataFrame(long, DOC)
    clashing = df.selectExpr("*", "1 AS rank", "'q' AS h", "2 AS n", "3 AS block", "4 AS kids", "5 AS at", "6 AS part", "'r' AS root", "'t' AS own")
    assert given(clashing) == brute(long)


def test_tampering_is_found(spark):
    """A proof verifies its own row alone: any changed cell of a row gives another root."""
    found = merkle.manifest(spark.createDataFrame(rows(60), DOC)).collect()
    for r in found[:20]:
        for other in ("0" * 64, found[-1]["leaf"]):
            now = other
            for step in r["path"]:
                now = h(step["l"], now, step["r"])
            assert (now == r["root"]) == (other == r["leaf"])


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_twin(spark):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    cursor = c.execute(merkle.OP11_SQL)
    names = [d[0] for d in cursor.description]
    want = sorted(map(repr, cursor.fetchall()))
    assert sorted(repr(tuple(r[n] for n in names)) for r in merkle.op11_merkle(spark, SF).collect()) == want
