import pytest
from pyspark.sql import functions as F

from tidewatch.llm import mixing


def brute_targets(sizes, weights=(3, 1, 2), budget=1.5, repeats=2):
    """Share by weight, stop at the caps, share the excess again."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target, open_, left = {}, set(order), budget * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        stopped = {s for s in open_ if weight[s] * level >= repeats * sizes[s]}
        if not stopped:
            return target | {s: weight[s] * level for s in open_}
        for s in stopped:
            target[s] = float(repeats * sizes[s])
            left -= target[s]
        open_ -= stopped
    return target


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 50, "c": 7, None: 3}, {"a": 1, "b": 1000}, {"a": 5}, {"a": 0, "b": 10}, {"a": 10, "b": 10, "c": 1000, "d": 1, "e": 4, "f": 90}])
def test_targets(spark, sizes):
    table = spark.createDataFrame(list(sizes.items()), "tw_source string, source_size long")
    got = {r["tw_source"]: r["target"] for r in mixing.targets(table).collect()}
    assert got == pytest.approx(brute_targets(sizes))


def _words(n):
    return " ".join(["w"] * n)


def test_plan(spark, docs):
    sizes, names = [10, 20, 30, 5, 0, 7, 3, 40], ["a", "a", "a", "b", "b", "c", None, "c"]
    table = docs([_words(n) if n else None for n in sizes], names).withColumns({"place": F.lit(1), "target": F.lit("x")})
    rows = mixing.curriculum(table).collect()
    assert set(table.columns) <= set(rows[0].asDict())
    want = brute_targets({"a": 60, "b": 5, "c": 47, None: 3})
    for name in ("a", "b", "c", None):
        own = [r for r in rows if r["source"] == name]
        assert sum(r["tw_taken"] for r in own) == int(want[name])
        for r in own:
            assert r["tw_taken"] <= 2 * r["tw_size"] and all(0 <= p <= 1 for p in r["tw_positions"])
    assert sorted(map(str, rows)) == sorted(map(str, mixing.curriculum(table).collect()))
    mix = mixing.mixed(table).collect()
    assert set(mix[0].asDict()) == set(table.columns)


def test_schedule_moves_sources(spark, docs):
    n = 400
    table = docs([_words(10)] * n, ["a" if k % 2 else "b" for k in range(n)])
    rows = mixing.curriculum(table, weights=(1, 1), slopes=(-0.9, 0.9), budget=1.0).collect()
    early = [p for r in rows if r["source"] == "a" for p in r["tw_positions"]]
    late = [p for r in rows if r["source"] == "b" for p in r["tw_positions"]]
    assert sum(early) / len(early) < 0.45 < 0.55 < sum(late) / len(late)


def test_edges(spark, docs):
    assert mixing.curriculum(docs([])).count() == 0
    rows = mixing.curriculum(docs([None, "", " \t"])).collect()
    assert [(r["tw_size"], r["tw_taken"], r["tw_target"]) for r in rows] == [(0, 0, 0.0)] * 3
    same = mixing.curriculum(docs(["a b", "a b"], ids=[1, 1])).collect()
    assert sum(r["tw_taken"] for r in same) == 6
    assert mixing.curriculum(docs(["a b c"], ids=[None])).first()["tw_taken"] == 4
