import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import quality_model, quality_rules

GOOD = "the quick river of stone and a field with many small flowers in the morning. "


def make(n, seed=1):
    r = random.Random(seed)
    texts, y = [], []
    for k in range(n):
        words = ["".join(r.choice("aeioubcdlmnrst") for _ in range(r.randint(2, 9))) for _ in range(r.randint(30, 200))]
        words = [w if r.random() > 0.25 else r.choice(["the", "of", "and", "in"]) for w in words]
        bad = k % 3 == 0
        texts.append(" ".join(w.upper() + "!!" if bad else w for w in words) + ".")
        y.append(int(not bad))
    return texts, y


def test_held_out_accuracy_and_fold(spark, docs):
    texts, y = make(300)
    labels = spark.createDataFrame([(k + 1, v, 0) for k, v in enumerate(y)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    rows = quality_model.classify(docs(texts).withColumns({"x": F.lit(1), "y": F.lit("c"), "score": F.lit(2)}), labels).collect()
    assert len(rows) == 300
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert np.mean([r["predicted"] == y[r["doc_id"] - 1] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert quality_model.accepted(docs(texts), labels).count() == sum(r["predicted"] for r in rows)


def test_held_out_labels_do_not_matter(spark, docs):
    texts, y = make(120)
    table = docs(texts)
    score = lambda ys: {r["doc_id"]: r["score"] for r in quality_model.classify(table, spark.createDataFrame(list(enumerate(ys, 1)), "doc_id long, quality int")).collect()}
    flipped = [1 - v if zlib.crc32(str(k).encode()) % 5 == 0 else v for k, v in enumerate(y, 1)]
    assert score(y) == pytest.approx(score(flipped))


def test_moments_match_numpy(spark, docs):
    texts, y = make(60)
    model = quality_model.train(quality_model.doc_statistics(docs(texts)), spark.createDataFrame(list(enumerate(y, 1)), "doc_id long, quality int"))
    keep = [k for k in range(60) if zlib.crc32(str(k + 1).encode()) % 5]
    x = np.array([quality_model.statistics(texts[k]) for k in keep])
    assert model.centre == pytest.approx(x.mean(axis=0))
    good = x[[y[k] == 1 for k in keep]]
    assert model.parts[1][0] == pytest.approx((good.mean(axis=0) - x.mean(axis=0)) / np.where(x.std(axis=0) > 1e-6 * (1 + abs(x.mean(axis=0))), x.std(axis=0), 1.0), abs=1e-6)


def test_scores_against_brute_force(spark, docs):
    """The discriminant written out with whole covariance matrices, their inverses and determinants."""
    texts, y = make(150, seed=4)
    labels = spark.createDataFrame(list(enumerate(y, 1)), "doc_id long, quality int")
    got = {r["doc_id"]: (r["score"], r["predicted"]) for r in quality_model.classify(docs(texts), labels).collect()}
    x = np.array([quality_model.statistics(t) for t in texts])
    use = np.array([zlib.crc32(str(k + 1).encode()) % 5 != 0 for k in range(150)])
    mean, std = x[use].mean(axis=0), x[use].std(axis=0)
    z = (x - mean) / np.where(std > 1e-6 * (1 + abs(mean)), std, 1.0)
    own = {c: z[use & (np.array(y) == c)] for c in (0, 1)}
    cov = {c: np.cov(v.T, bias=True) for c, v in own.items()}
    pooled = sum(len(own[c]) * cov[c] for c in own) / use.sum()
    log = {}
    for c in own:
        s = (1 - quality_model.SHRINK_POOLED - quality_model.SHRINK_SPHERE) * cov[c] + quality_model.SHRINK_POOLED * pooled
        s = s + (quality_model.SHRINK_SPHERE * np.trace(pooled) / z.shape[1] + 1e-6) * np.eye(z.shape[1])
        d = z - own[c].mean(axis=0)
        log[c] = -0.5 * np.einsum("ni,ij,nj->n", d, np.linalg.inv(s), d) - 0.5 * np.linalg.slogdet(s)[1] + np.log(len(own[c]) / use.sum())
    want = 1 / (1 + np.exp(-np.clip(log[1] - log[0], -60, 60)))
    assert np.array([got[k + 1][0] for k in range(150)]) == pytest.approx(want, abs=1e-6)
    assert [got[k + 1][1] for k in range(150)] == [int(w >= 0.3) for w in want]


def test_edges_of_the_classifier(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = quality_model.classify(docs([None, "", "text"], ids=[1, None, 3]), none).collect()
    assert [r["score"] for r in rows] == [0.5] * 3
    assert quality_model.classify(docs([]), none).count() == 0
    assert all(np.isfinite(quality_model.statistics(t)).all() for t in (None, "", " ", "!", "a" * 100_000, "\n\n"))


def plain_counts(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    covered = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


RULE_TEXTS = [
    None, "", " \n\t", "one", GOOD * 3, "a b c d e f g h " * 2, "a b c d e f g h i a b c d e f g h", "x " * 40, "l1\nl1\n \nl1 \nl2", "é ñ ü\x0b日本\x0c# $ |x|\n", GOOD * 400,
    " ".join(str(k % 9) for k in range(60)), "THE BIG LOUD WORDS " * 9,
]


def test_rule_counts(spark, docs):
    table = docs(RULE_TEXTS).withColumns({"n_words": F.lit("x"), "tw": F.lit(1)})
    rows = {r["doc_id"]: r for r in quality_rules.judge(table, ["doc_id"]).collect()}
    for k, t in enumerate(RULE_TEXTS):
        r = rows[k + 1]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == plain_counts(t), t
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    assert quality_rules.judge(docs([]), ["doc_id"]).count() == 0


def test_repeats_are_exact_where_hashes_collide(spark, docs):
    """With hashes of one, three or all values, the counts are those of the words."""
    r = random.Random(6)
    texts = [*RULE_TEXTS, *(" ".join(r.choice("ab") for _ in range(r.randint(8, 300))) for _ in range(12))]
    for weak in (lambda w: F.lit(1).cast("long"), lambda w: F.pmod(F.xxhash64(w), F.lit(3)), F.xxhash64):
        rows = {x["doc_id"]: x["n_repeat_words"] for x in quality_rules.measures(docs(texts), ["doc_id"], weak).collect()}
        assert [rows[k + 1] for k in range(len(texts))] == [plain_counts(t)[4] for t in texts]


def test_verdicts(spark, docs):
    r = random.Random(3)
    prose = " ".join(r.choice(["the", "of", "river", "stone", "walked", "quietly", "morning", "and"]) for _ in range(80))
    marked = " ".join(w + r.choice(["###", "%%%"]) for w in prose.split())
    rows = {x["doc_id"]: x["kept"] for x in quality_rules.judge(docs([prose, marked, prose.upper()]), ["doc_id"]).collect()}
    assert rows == {1: True, 2: False, 3: False}
    own = quality_rules.judge(docs([prose]), ["doc_id"], [("long", "n_words", "n_lines", None, 100)]).first()
    assert not own["kept"]
