"""Each stage against a brute-force reading of what it must do, and the whole run."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewatch.llm import common, secrets, simhash

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def steps(spark):
    table = common.documents(spark, SF)
    out = {"": [r.asDict() for r in table.collect()]}
    for name, stage in corpus_pipeline.STAGES:
        table = common.stored(stage(spark, table, SF), "step")
        out[name] = [r.asDict() for r in table.collect()]
    return out


def test_columns_and_names(steps):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    for n in names[:-1]:
        assert set(steps[n][0]) == set(steps[""][0])


def test_quality_keeps_good_documents(spark, steps):
    kept = {r["doc_id"] for r in steps["quality classifier"]}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    good, bad = [r["doc_id"] for r in labels if r["quality"] == 1], [r["doc_id"] for r in labels if r["quality"] == 0]
    assert sum(d in kept for d in good) >= 0.95 * len(good) and sum(d in kept for d in bad) <= 0.2 * len(bad)


def test_near_dedup_against_brute_force(steps):
    """Linked: fingerprints within 2 bits, or five-word shingles with a Jaccard similarity of 0.8 or more."""
    before = {}
    for r in steps["quality classifier"]:
        words = (r["text"] or "").translate({c: c + 32 for c in range(65, 91)}).split()
        shingles = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
        before[r["doc_id"]] = simhash.fingerprint(r["text"]), shingles
    group = {}
    for d in sorted(before):
        fp, own = before[d]
        alike = lambda e: (fp ^ before[e][0]).bit_count() <= 2 or (own and 9 * len(own & before[e][1]) >= 4 * (len(own) + len(before[e][1])))  # noqa: B023, E731
        near = {group[e] for e in group if alike(e)}
        root = min([d, *near])
        group = {e: root if g in near else g for e, g in group.items()} | {d: root}
    assert sorted(r["doc_id"] for r in steps["SimHash near-dedup"]) == sorted(set(group.values()))


def test_secrets_are_gone(steps):
    assert len(steps["secret scans"]) == len(steps["SimHash near-dedup"])
    assert not any(secrets.base_findings(r["text"]) for r in steps["secret scans"])
    before = {r["doc_id"]: r["text"] for r in steps["SimHash near-dedup"]}
    clean = [r for r in steps["secret scans"] if r["text"] == before[r["doc_id"]]]
    assert len(clean) > 0.5 * len(before)


def test_mix_is_near_its_targets(steps):
    size = lambda r: len(r["text"].split())
    have, got, largest = {}, {}, {}
    for r in steps["secret scans"]:
        have[r["source"]] = have.get(r["source"], 0) + size(r)
        largest[r["source"]] = max(largest.get(r["source"], 0), size(r))
    for r in steps["mixing sources"]:
        got[r["source"]] = got.get(r["source"], 0) + size(r)
    order = sorted(have)
    weight, open_, left, target = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}, set(order), 1.5 * sum(have.values()), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level >= 2 * have[s]} or set(open_)
        for s in full:
            target[s] = min(2 * have[s], weight[s] * level)
        left -= sum(target[s] for s in full)
        open_ -= full
    for s in order:
        assert abs(got.get(s, 0) - target[s]) <= largest[s]


def test_tokens_decode_to_the_texts(steps):
    texts = sorted(hashlib.sha256(r["text"].encode()).hexdigest() for r in steps["mixing sources"])
    assert sorted(r["decoded_sha256"] for r in steps["byte-level BPE"]) == texts


def test_run_and_empty(spark, steps):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r["doc_id"], r["ids_sha256"]) for r in rows) == sorted((r["doc_id"], r["ids_sha256"]) for r in steps["byte-level BPE"])
    table = common.documents(spark, SF).filter("false")
    for _, stage in corpus_pipeline.STAGES:
        table = common.stored(stage(spark, table.withColumn("extra", F.lit(1)) if "extra" not in table.columns else table, SF), "empty")
    assert table.count() == 0


def test_nulls_repeats_and_clashing_names(spark, docs):
    r = __import__("random").Random(2)
    prose = lambda k: " ".join(r.choice(["the", "of", "river", "stone", "walked", "quietly", "morning", "and", "fields", "small"]) + r.choice(["", "", "s"]) for _ in range(k))
    texts = [None, "", " ", *(prose(r.randint(30, 120)) for _ in range(12))]
    texts += texts[3:6] + [texts[8]]
    ids = [1, 2, None, *range(4, 14), None, 14, 4, 5, 6, 77]
    sources = ["a", None, "b", *(r.choice(["a", "b", None]) for _ in range(12))]
    sources += sources[3:6] + ["a"]
    names = ["tw_fp", "tw_id", "tw_size", "tw_key", "fp", "root", "n_chars_2", "position", "h", "y"]
    table = common.stored(docs(texts, sources=sources, ids=ids).withColumns({n: F.lit(n) for n in names}), "odd")
    rows = [x.asDict() for x in table.collect()]
    size = lambda t: len((t or "").split())

    kept = [x.asDict() for x in corpus_pipeline.near_dedup(spark, table, SF).collect()]
    assert all(x in rows for x in kept) and sorted(str(x["text"] or "").strip() for x in kept) == sorted({(x["text"] or "").strip() for x in rows})
    assert {x["doc_id"] for x in kept} >= {1, 4, 5, 6} and 77 not in {x["doc_id"] for x in kept}

    clean = [x.asDict() for x in corpus_pipeline.secret_scan(spark, table, SF).collect()]
    assert sorted(map(str, clean)) == sorted(map(str, rows))

    mixed = common.stored(corpus_pipeline.mix(spark, table, SF), "odd-mix")
    got = [x.asDict() for x in mixed.collect()]
    assert set(got[0]) == set(rows[0]) and all(x in rows and size(x["text"]) for x in got)
    assert all(got.count(x) <= 2 * rows.count(x) for x in got)
    done = corpus_pipeline.encode(spark, mixed, SF).collect()
    assert sorted(x["decoded_sha256"] for x in done) == sorted(hashlib.sha256(x["text"].encode()).hexdigest() for x in got)
    odd = corpus_pipeline.encode(spark, table, SF).collect()
    assert len(odd) == len(rows) and sum(x["n_tokens"] == 0 for x in odd) == 2
