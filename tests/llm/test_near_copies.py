"""Near copies of the pipeline's stage against brute force on planted texts."""

import random

import numpy as np

import corpus_pipeline
from tidewatch.llm import near_copies, simhash


def planted():
    r = random.Random(5)
    words = [f"w{k}" for k in range(3000)]
    line = "this very line is part of a great many of these texts and says nothing at all".split()
    texts = []
    for k in range(60):
        base = r.choices(words, k=r.randint(30, 260))
        texts.append(base + (line if k % 2 else []))
        for n in (1, 2, 4, 9):  # copies with some words changed: on both sides of 0.8
            copy = list(base)
            for at in r.sample(range(len(copy)), n):
                copy[at] = r.choice(words)
            texts.append(copy)
    hub = r.choices(words, k=200)
    for k in range(60):  # a large group around one text, by changes at different places
        copy = list(hub)
        copy[3 * k] = f"x{k}"
        texts.append(copy)
    texts += [line + [f"end{k}"] for k in range(40)] + [["short"], ["Short"], ["two", "words"], []]
    r.shuffle(texts)
    return [" ".join(t) for t in texts]


def brute(texts):
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    fps = [simhash.fingerprint(t) for t in texts]
    root = list(range(len(texts)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for b in range(len(texts)):
        for a in range(b):
            both = len(sets[a] & sets[b])
            near = both and 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both)
            if near or (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return sorted(k + 1 for k in range(len(texts)) if root[k] == k)


def test_shingle_sets_are_those_of_the_words():
    a, b = near_copies.shingle_set("A b\tc d e f g"), near_copies.shingle_set("x a B c d e f")
    assert len(a) == len(b) == 3 and len(set(a) & set(b)) == 2 and len(near_copies.shingle_set(None)) == 0
    assert list(near_copies.shingle_set("a b")) == list(near_copies.shingle_set(" A  B ")) != list(near_copies.shingle_set("ab"))
    long = " ".join(f"w{k % 7001}" for k in range(near_copies._BLOCK + 9000))  # more than a block
    assert len(near_copies.shingle_set(long)) == 7001


def test_bit_maps_bound_what_sets_share():
    r = random.Random(3)
    for _ in range(300):
        n, m, both = r.randint(1, 400), r.randint(1, 400), r.randint(0, 400)
        both = min(both, n, m)
        values = np.array([r.getrandbits(64) for _ in range(n + m - both)], np.uint64)
        a, b = np.unique(values[:n]), np.unique(values[n - both :])
        most = near_copies._most_shared(near_copies._bit_map(a), near_copies._bit_map(b), len(a), len(b))
        assert most >= len(np.intersect1d(a, b)) and most <= min(n, m)
    x, y = (np.array([r.getrandbits(64) for _ in range(1000)], np.uint64) for _ in range(2))
    assert near_copies._most_shared(near_copies._bit_map(x), near_copies._bit_map(y), 1000, 1000) < 800  # sets that share nothing are ruled out


def test_stage_drops_planted_near_copies(spark, docs, monkeypatch):
    texts = planted()
    want = brute(texts)
    kept = corpus_pipeline.near_dedup(spark, docs(texts), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == want
    # The same with a hot line in nearly every text's order, which changes the work alone.
    monkeypatch.setattr(near_copies, "SAMPLE", 1.0)
    monkeypatch.setattr(near_copies, "HOT", (3, 9))
    assert all(bits.table.any() for bits in near_copies.hot_shingles(docs(texts)))
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs(texts), "").collect()) == want


def candidates(spark, docs, monkeypatch, texts):
    """(pairs sent to verification, links) of ``near_copies.set_links``."""
    sent, verify = [], near_copies._verified

    def counting(pairs, *rest):
        sent.append(pairs.distinct().count())
        return verify(pairs, *rest)

    monkeypatch.setattr(near_copies, "_verified", counting)
    df = docs(texts)
    found = near_copies.set_links(df, near_copies.marks(df)).count()
    monkeypatch.setattr(near_copies, "_verified", verify)
    return sum(sent), found


def test_texts_of_one_template_are_no_pairs(spark, docs, monkeypatch):
    """60 shared words and 12 of their own: a similarity of 0.7, which is no link and must not cost all pairs."""
    r = random.Random(9)
    for n in (300, 900):
        template = [f"t{k}" for k in range(60)]
        texts = [" ".join(template + [f"o{r.randrange(10**6)}" for _ in range(12)]) for _ in range(n)]
        pairs, links = candidates(spark, docs, monkeypatch, texts)
        assert links == 0 and pairs <= 2 * n


def test_mixed_lengths_around_a_template(spark, docs):
    """Own parts of many lengths, on both sides of 0.8, against brute force."""
    r = random.Random(10)
    template = [f"t{k}" for k in range(60)]
    texts = [" ".join(template + [f"o{r.randrange(10**6)}" for _ in range(k % 25)]) for k in range(250)]
    assert sorted(x["doc_id"] for x in corpus_pipeline.near_dedup(spark, docs(texts), "").collect()) == brute(texts)


def test_regular_long_words_differ():
    """Words that make a polynomial hash modulo 2 ** 64 collide (Thue-Morse), alone and as many words."""
    a, b = "a", "b"
    for _ in range(11):
        a, b = a + b, b + a
    assert list(near_copies.shingle_set(a)) != list(near_copies.shingle_set(b))
    x, y = (near_copies.shingle_set(" ".join(t)) for t in (a, b))
    words = lambda t: {t[k : k + 5] for k in range(len(t) - 4)}
    assert len(x) == len(words(a)) and len(np.intersect1d(x, y)) == len(words(a) & words(b))


def test_cases(spark, docs):
    empty = docs([])
    assert near_copies.links(empty, near_copies.marks(empty)).count() == 0
    long = " ".join(f"w{k * k % 99991}" for k in range(300_000))
    texts = [None, "", " \t", long, long + " end", "a b", "A  b", long[:1000]]
    df = docs(texts, ids=[None, 1, 1, 2, 3, 4, 5, None]).selectExpr("*", "1 AS set_id", "2 AS n", "3 AS key", "4 AS fp")
    marked = near_copies.marks(df)
    assert near_copies.set_links(df, marked).count() == 1 and marked.filter("n = 0").count() == 3


def test_large_group_of_near_copies_costs_few_pairs(spark, docs, monkeypatch):
    """Copies with one to three changes of their own: all are near copies of the text they come from, most not of each other."""
    r = random.Random(11)
    hub, n = [f"h{k}" for k in range(150)], 600
    texts = [" ".join(hub)]
    for k in range(n):
        copy = list(hub)
        for j, at in enumerate(r.sample(range(5, 145), r.choice([1, 2, 3, 3, 3]))):
            copy[at] = f"c{k}x{j}"
        texts.append(" ".join(copy))
    pairs, _ = candidates(spark, docs, monkeypatch, texts)
    assert pairs <= 8 * n
    assert [x["doc_id"] for x in corpus_pipeline.near_dedup(spark, docs(texts), "").collect()] == brute(texts) == [1]
