"""Spelling variants against brute force over all pairs, and the cases."""

import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from tidewatch.llm import spelling

SF = "/root/testdata/sf0.001"


def counted(texts, ids):
    n = Counter()
    for d, t in zip(ids, texts):
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{d}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(words):
    of = {w: [v for v in words if near(w, v)] for w in words}
    form = {}
    for w, vs in of.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, words[w], len(of[w]), words[form[w]] if form[w] else None))
    return sorted(map(repr, out))


def given(df):
    return sorted(repr(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n"))) for r in df.collect())


def variants(docs):
    words = spelling.vocabulary(docs)
    return spelling.variants(words, spelling.near_pairs(words))


def planted(seed=3):
    r = random.Random(seed)
    letters = "abcdefgéÀÿ×xyz"
    texts = []
    for _ in range(60):
        w = "".join(r.choices(letters[: r.choice([3, 14])], k=r.randint(5, 11)))
        texts += [w] * r.choice([5, 25, 130])
        for _ in range(4):
            at, c = r.randrange(len(w) + 1), r.choice(letters)
            v = r.choice([w[:at] + c + w[at:], w[:at] + w[at + 1 :], w[:at] + c + w[at + 1 :], w[:at] + w[at : at + 2][::-1] + w[at + 2 :]])
            texts += [v, v.capitalize()] * r.choice([1, 3, 5])
    r.shuffle(texts)
    return [" ".join(texts[k : k + 40]) + ", 日本 ŒUVRE_œuvre" for k in range(0, len(texts), 40)]


@pytest.mark.parametrize("tile", [3, 2048])
def test_against_all_pairs(spark, docs, monkeypatch, tile):
    monkeypatch.setattr(spelling, "TILE", tile)
    texts = planted()
    words = counted(texts, range(1, len(texts) + 1))
    want = brute(words)
    assert sum(" None, " not in w for w in want) > 20  # some have forms
    assert given(variants(docs(texts).repartition(5))) == want


def test_every_kind_of_edit_is_close_and_verified():
    r = random.Random(7)
    words = sorted({"".join(r.choices("abcé", k=r.randint(6, 9))) for _ in range(400)})
    a, b = spelling.Words(words[::2], [1] * len(words[::2])), spelling.Words(words[1::2], [1] * len(words[1::2]))
    for x, y, same in ((a, b, False), (a, a, True)):
        i, j = spelling.close(x, y, same)
        good = spelling.verified(x, y, i, j)
        got = {(x.words[p], y.words[q]) for p, q in zip(i[good], j[good])}
        assert got == {(v, w) for k, v in enumerate(x.words) for m, w in enumerate(y.words) if (not same or k < m) and near(v, w)} and got


def test_blocks_meet_exactly_those_an_edit_reaches():
    steps = spelling._steps()
    reached = {tuple(s) for s in steps} | {tuple(-np.array(s)) for s in steps}
    want = set()
    for a in range(spelling.CLASSES):
        one = np.eye(spelling.CLASSES, dtype=int)
        want |= {tuple(one[a]), tuple(-one[a])} | {tuple(one[a] - one[b]) for b in range(spelling.CLASSES)}
    assert reached == want and len(steps) == (len(reached) + 1) // 2  # each pair of blocks meets once


def test_cases(spark, docs):
    assert variants(docs([])).count() == 0
    assert variants(docs([None, "", "few words only"])).count() == 0
    run = "qwertyuiop" * 12_000  # very long runs, one of them with a letter more
    texts = [run, run + "z", None, "abcdeg abcdef", "Abcdef"] * 5
    ids = list(range(1, len(texts) + 1))
    ids[3] = None
    words = counted([t for t in texts if t != texts[3]] + [texts[3]] * 5, [k for k, t in zip(range(1, 26), texts) if t != texts[3]] + ["null", 9, 14, 19, 24])
    df = docs(texts, ids=ids).selectExpr("*", "'x' AS word", "1 AS n", "2 AS block", "3 AS tile")
    assert given(variants(df)) == brute(words) and len(words) == 4


def test_a_chain_of_forms_ends_at_its_root(spark):
    chain = ["aaaaaa", "aaaaaab", "aaaaaabb", "aaaaaabbb", "aaaaaabbbb", "aaaaaabbbbb"]
    words = {w: 5 ** (k + 1) for k, w in enumerate(chain)}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert given(spelling.variants(df, spelling.near_pairs(df))) == brute(words)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_twin(spark):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    cursor = c.execute(spelling.OP13_SQL)
    names = [d[0] for d in cursor.description]
    want = sorted(map(repr, cursor.fetchall()))
    assert sorted(repr(tuple(r[n] for n in names)) for r in spelling.op13_spelling(spark, SF).collect()) == want
