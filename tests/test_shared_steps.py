"""Steps that many queries share: rules run once for each distinct text, whatever reads the result."""

import datetime

import pytest

from tidewatch.operators import evidence, extraction, neardup
from tidewatch.plans import fixtures as X
from tidewatch.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"
T = datetime.datetime(2024, 1, 1)


@pytest.mark.parametrize("name", ["write_tables", "incident_detail", "external_verification", "incident_title", "limitations", "nearby_candidates"])
def test_rules_run_once_for_each_text(spark, monkeypatch, name):
    read, plain = [], extraction.extract_facts

    def seen(texts):
        rows = texts.count()
        read.append((rows, texts.select("raw_text").distinct().count()))
        return plain(texts)

    monkeypatch.setattr(extraction, "extract_facts", seen)
    QUERIES[name](spark, DATA)
    assert len(read) == 1
    assert read[0][0] == read[0][1] < X.reports(spark, DATA).count()


def test_facts_by_text_are_those_of_each_report(spark):
    said = ["Fire near the market, 3 families trapped", "fire near the market, 3 families trapped", "", None, "  ", "Fire near the market, 3 families trapped", None]
    table = spark.createDataFrame([(k, s) for k, s in enumerate(said)], "id long, raw_text string")
    got = extraction.extract_by_text(table)
    assert got.columns == extraction.extract_facts(table).columns
    assert sorted(got.collect(), key=lambda r: r["id"]) == sorted(extraction.extract_facts(table).collect(), key=lambda r: r["id"])


def test_copies_count_and_empty_texts_stay_apart(spark):
    texts = [("a", "Water rising at the gate now"), ("b", "water rising at the gate, now!"), ("c", "Water rising at the gate now"), ("d", ""), ("e", None), ("f", None), ("g", "!!"), ("h", "Rumour, no fire here"), ("i", "Rumour, no fire here")]
    table = spark.createDataFrame([("c1", i, T, s) for i, s in texts] + [("c2", "z", T, "Rumour, no fire here")], "cluster_id string, id string, ts timestamp, raw_text string")
    got = {(r["cluster_id"], r["first_id"], r["n"], r["norm"], tuple(r["report_ids"])) for r in neardup.group_duplicate_texts(table).collect()}
    gate, none = "water rising at the gate now", "rumour no fire here"
    assert got == {("c1", "a", 3, gate, ("a", "b", "c")), ("c1", "h", 2, none, ("h", "i")), ("c2", "z", 1, none, ("z",)), *{("c1", i, 1, "", (i,)) for i in "defg"}}
    flags = {r["cluster_id"]: (r["has_contradiction"], r["rumour_count"]) for r in evidence.denial_flags(table).collect()}
    assert flags == {"c1": (True, 2), "c2": (False, 1)}


def test_the_second_run_extracts_nothing(spark, monkeypatch):
    """The whole batch reads each distinct text once, and a run over its result none."""
    read, plain = [], extraction.extract_facts

    def seen(texts):
        read.append(sorted(r["raw_text"] for r in texts.select("raw_text").collect()))
        return plain(texts)

    monkeypatch.setattr(extraction, "extract_facts", seen)
    assert QUERIES["run_pipeline"](spark, DATA).count() > 100
    assert [t for texts in read for t in texts] == sorted(r["raw_text"] for r in X.reports(spark, DATA).select("raw_text").distinct().collect())


def test_many_components_are_matched_in_few_passes(spark):
    """Thousands of clusters that meet no other's incidents, and one chain of choices: no Python call for each."""
    import time

    from tidewatch.operators import incidents

    rows = [(f"c{k}", f"i{k}", 1) for k in range(20_000)] + [("x1", "p", 5), ("x1", "q", 5), ("x2", "p", 9), ("x2", "r", 1), ("x3", "r", 3), ("x3", "q", 2)]
    clusters = spark.createDataFrame([(c, k) for k, c in enumerate(dict.fromkeys(r[0] for r in rows))], "cluster_id string, place long")
    matched = incidents.incident_match(spark.createDataFrame(rows, "cluster_id string, incident_id string, shared long"), clusters)
    began = time.perf_counter()
    got = {(r["cluster_id"], r["incident_id"]) for r in matched.collect()}
    assert got == {(f"c{k}", f"i{k}") for k in range(20_000)} | {("x1", "p"), ("x2", "r"), ("x3", "q")}
    assert time.perf_counter() - began < 15
