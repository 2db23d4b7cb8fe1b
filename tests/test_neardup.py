"""Near-duplicate texts against brute force: all pairs by the ratio, at borders of blocks and lengths."""

import os
import random
from datetime import datetime, timedelta
from difflib import SequenceMatcher

import numpy as np
import pytest

from tidewatch.operators import neardup

T0 = datetime(2026, 1, 1)
COLUMNS = "cluster_id string, id string, ts timestamp, raw_text string"


def edited(r, text, share):
    out = []
    for c in text:
        x = r.random()
        if x < share / 3:
            continue
        out.append(r.choice("abcdefgh ijk") if x < 2 * share / 3 else c)
        if x > 1 - share / 3:
            out.append(r.choice("lmnop"))
    return " ".join("".join(out).split())


def brute(rows):
    out = set()
    by = {}
    for c, i, t, text in sorted(rows, key=lambda r: (r[2] or datetime.min, r[1])):
        by.setdefault(c, {}).setdefault(text, i)
    for c, texts in by.items():
        items = [(i, t) for t, i in texts.items() if len(t) >= 12]
        for k, (a, x) in enumerate(items):
            out |= {(c, a, b) for b, y in items[k + 1 :] if SequenceMatcher(None, x, y).ratio() >= 0.85}
    return out


def corpus(n, seed=0):
    """Random texts, some edited forms of earlier ones about the ratio, of lengths about the least and up to 400."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghijklmnopqrst") for _ in range(r.randint(2, 8))) for _ in range(60)]
    texts = []
    for _ in range(n):
        if texts and r.random() < 0.6:
            texts.append(edited(r, r.choice(texts), r.choice([0.02, 0.1, 0.15, 0.2, 0.3])))
        else:
            texts.append(" ".join(r.choice(words) for _ in range(r.choice([2, 3, 4, 8, 12, 70]))))
    return [(r.choice(["hot", "hot", "b"]), f"r{k:05d}", T0 + timedelta(minutes=r.randint(0, 5)), t) for k, t in enumerate(texts)]


@pytest.mark.parametrize("block", [7, 1024])
def test_pairs_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rows = corpus(340) + [("lone", "x1", T0, "a text of its own here"), ("null", "n1", None, "no time is known of it"), ("null", "n2", T0, "no time is known of it!"), ("null", "n3", T0, "no time is knwn of it"), ("e", "e1", T0, None), ("e", "e2", T0, "")]
    got = [tuple(r) for r in neardup.near_duplicate_pairs(spark.createDataFrame(rows, COLUMNS)).collect()]
    want = brute([(c, i, t, (x or "").rstrip("!")) for c, i, t, x in rows])
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100


def test_the_least_that_is_shared():
    """What the bounds promise holds for texts at the ratio, however matches are scattered."""
    r = random.Random(5)
    seen = 0
    for _ in range(3000):
        a = "".join(r.choice("ab cdefg") for _ in range(r.randint(12, 60)))
        b = edited(r, a, r.choice([0.1, 0.2, 0.3]))
        if len(b) < 12 or SequenceMatcher(None, a, b).ratio() < 0.85:
            continue
        seen += 1
        for q in neardup.BUCKETS:
            x, y = neardup._gram_counts([a, b], q)
            assert np.minimum(x, y).sum() >= neardup._shared_least(np.array(len(a) + len(b)), q)
    assert seen > 500


def test_few_pairs_reach_the_ratio(spark):
    """Of the 12 million pairs of a cluster of 5,000 unlike texts few are compared, and those that are alike are found."""
    r = random.Random(1)
    words = ["".join(r.choice("etaoinshrdlucmfwypvbgk") for _ in range(r.randint(3, 9))) for _ in range(2000)]
    texts = [" ".join(r.choice(words) for _ in range(12)) for _ in range(5000)]
    rows = [("hot", f"r{k:05d}", T0 + timedelta(seconds=k), t) for k, t in enumerate(texts)]
    rows += [("hot", f"s{k:05d}", T0 + timedelta(days=1), texts[k] + " q") for k in range(0, 5000, 500)]
    seen = neardup.compared_texts(spark.createDataFrame(rows, COLUMNS)).collect()
    assert {(x["a"], x["b"]) for x in seen if x["similar"]} == {(f"r{k:05d}", f"s{k:05d}") for k in range(0, 5000, 500)}
    assert len(seen) < 5000


def test_no_texts(spark):
    assert neardup.near_duplicate_pairs(spark.createDataFrame([], COLUMNS)).count() == 0


def test_classes_over_the_corpus(spark):
    """All links from 0.8 that brute force finds: recall of the bands, classes, and the odd rows."""
    r = random.Random(9)
    words = [f"w{k}" for k in range(400)]
    texts = []
    for _ in range(700):
        if texts and r.random() < 0.7:
            t = r.choice(texts).split()
            for _ in range(r.choice([0, 1, 1, 2, 3, 6])):
                t[r.randrange(len(t))] = r.choice(words)
            texts.append(" ".join(t))
        else:
            texts.append(" ".join(r.choice(words) for _ in range(r.choice([40, 60, 120]))))
    texts += [None, "", "!!", "two words", "Two, words!", " ".join(words * 50)]
    rows = list(enumerate(texts))

    def shingles(text):
        t = neardup_words(text)
        return frozenset(tuple(t[k : k + 5]) for k in range(max(len(t) - 4, 1))) if t else frozenset()

    def neardup_words(text):
        return "".join(c if c.isalnum() or c == "_" else " " for c in (text or "").lower()).split()

    sets = [shingles(t) for t in texts]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    want = set()
    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            both = len(sets[a] & sets[b])
            if both and both / (len(sets[a]) + len(sets[b]) - both) >= 0.8:
                want.add((a, b))
                x, y = sorted((find(a), find(b)))
                root[y] = x
    members, links = neardup.near_duplicate_lsh(spark.createDataFrame(rows, "id long, text string"))
    got = {x["id"]: x["class_id"] for x in members.collect()}
    assert set(got) == set(range(len(rows)))
    linked = sum(got[a] == got[b] for a, b in want)
    assert len(want) > 300 and linked >= 0.99 * len(want)
    assert all(find(a) == find(b) for a, b in got.items())
    assert {(min(x["a"], x["b"]), max(x["a"], x["b"])) for x in links.collect()} <= want


def test_lsh_keeps_no_whole_sets(spark, monkeypatch):
    """Texts that are like no other leave a signature each; what is stored is less than the texts."""
    r = random.Random(4)
    rows = [(k, " ".join(f"{r.randrange(10**6)}" for _ in range(600))) for k in range(400)]
    written, keep = [], neardup.stored

    def counting(df, name, *rest):
        out = keep(df, name, *rest)
        written.extend(os.path.getsize(f.removeprefix("file://")) for f in out.inputFiles())
        return out

    monkeypatch.setattr(neardup, "stored", counting)
    members, links = neardup.near_duplicate_lsh(spark.createDataFrame(rows, "id long, text string"))
    assert members.filter("id = class_id").count() == 400 and links.isEmpty()
    assert sum(written) < sum(len(t) for _, t in rows) / 2


def test_copies_by_turns_meet_in_both_orders(spark):
    """The ratio is 0.83 in one order and 0.875 in the other: a copy of the earlier text after the later one links them."""
    a, b = "now here old here water", "now here old market water"
    assert SequenceMatcher(None, a, b).ratio() < 0.85 <= SequenceMatcher(None, b, a).ratio()
    rows = [("once", "a1", T0, a), ("once", "b1", T0 + timedelta(minutes=1), b)]
    rows += [("turns", "a2", T0, a), ("turns", "b2", T0 + timedelta(minutes=1), b), ("turns", "a3", T0 + timedelta(minutes=2), a.upper())]
    got = {(r["cluster_id"], r["first_id"], r["n"], tuple(r["report_ids"])) for r in neardup.group_duplicate_texts(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert got == {("once", "a1", 1, ("a1",)), ("once", "b1", 1, ("b1",)), ("turns", "a2", 3, ("a2", "a3", "b2"))}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_the_query_gives_every_group_whole(spark):
    """Each member of each cluster is in just one group, those that are like no other too."""
    from tidewatch.plans import fixtures, queries

    members = sorted((r["cluster_id"], r["id"]) for r in fixtures.members(spark, "/root/testdata/sf0.001").select("cluster_id", "id").collect())
    got = queries.QUERIES["group_duplicate_texts"](spark, "/root/testdata/sf0.001").collect()
    assert sorted((r["cluster_id"], i) for r in got for i in r["report_ids"]) == members
    assert all(r["n"] == len(r["report_ids"]) and r["first_id"] in r["report_ids"] for r in got) and any(r["n"] == 1 for r in got)
