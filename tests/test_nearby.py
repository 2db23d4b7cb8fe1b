"""Nearby inference against brute force: dense minutes, ties, poles and the date line."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from tidewatch import constants as C
from tidewatch.operators import nearby
from tidewatch.operators.runs import runs

PIN = "id string, type string, at long, lat double, lon double, radius_m double"
START = 1_700_000_000_000_000


def far(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    x = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * C.EARTH_RADIUS_GEO_M * math.asin(math.sqrt(min(1.0, x)))


def brute(pins, moments):
    out = {}
    for kind, at in moments:
        near = [p for p in pins if p[1] == kind and abs(p[2] - at) <= nearby.WINDOW]
        if not near:
            continue
        sets = {}
        for a in near:
            group = frozenset(c[0] for c in near if far(a[3:5], c[3:5]) <= nearby.REACH)
            if len(group) >= 2:
                sets[group] = [c for c in near if c[0] in group]
        tight = []
        for group, items in sets.items():
            mid = sum(c[3] for c in items) / len(items), sum(c[4] for c in items) / len(items)
            spread = max(far(mid, c[3:5]) for c in items)
            if spread <= C.NEARBY_SPREAD_M:
                tight.append((len(group), mid, spread, max(c[5] + far(mid, c[3:5]) for c in items)))
        most = max((t[0] for t in tight), default=None)
        best = [t for t in tight if t[0] == most]
        out[kind, at] = (len(near), most, len(best) > 1 if best else None, best[0][1:] if len(best) == 1 else None)
    return out


def check(spark, pins, moments):
    want = brute(pins, moments)
    df = spark.createDataFrame(pins, PIN).repartition(5)
    got = nearby.inferred(df, spark.createDataFrame(moments, "type string, at long").distinct()).collect()
    assert {(r["type"], r["at"]) for r in got} == set(want)
    for r in got:
        k, most, tied, one = want[r["type"], r["at"]]
        assert (r["k"], r["best"]["n"] if r["best"] else None, r["tied"]) == (k, most, tied)
        if one:
            assert [r["best"]["lat"], r["best"]["lon"], r["best"]["spread"], r["best"]["reach"]] == pytest.approx([*one[0], *one[1:]], abs=1e-6)


def test_against_brute_force(spark):
    r = random.Random(3)
    pins, moments = [], []
    for c in range(14):  # places at the equator, the date line and near the poles among them
        lat, lon = [(0.0, 0.0), (10.0, 179.9999), (89.999, 20.0), (-75.0, -180.0)][c % 4] if c < 8 else (r.uniform(-60, 60), r.uniform(-170, 170))
        for _ in range(r.randint(2, 14)):
            far_ = r.choice([10, 100, 300]) / 111_000
            at = START + r.choice([0, 1, 600, 1200, 1201, 2400]) * 1_000_000 + r.choice([0, 0, 1, 333])
            pins.append((f"p{len(pins)}", r.choice("ab"), at, max(-90.0, min(90.0, lat + r.uniform(-far_, far_))), lon - r.uniform(0, far_), float(r.randint(5, 400))))
    for _ in range(120):
        moments.append((r.choice("abc"), START + r.choice([r.randint(-2400, 5000) * 1_000_000, r.randint(-1, 1), 1200_000_000 + r.randint(-1, 1)])))
    moments += [(p[1], p[2] + d) for p in pins for d in (nearby.WINDOW, -nearby.WINDOW, nearby.WINDOW + 1)]
    check(spark, pins, moments)


def test_equal_pins_and_ties(spark):
    two = [("a", "f", START, 10.0, 10.0, 5.0), ("b", "f", START, 10.0, 10.0, 5.0)]
    check(spark, two, [("f", START)])
    check(spark, two + [("c", "f", START, 20.0, 10.0, 5.0), ("d", "f", START, 20.0, 10.0001, 5.0)], [("f", START), ("g", START)])
    check(spark, two[:1], [("f", START), ("f", START + 1_200_000_001)])


def test_a_dense_minute(spark):
    """5,000 pins of a minute in one neighbourhood; two spots of it are tight for some reports."""
    r = random.Random(8)
    pins = []
    for k in range(5000):
        at = START + r.randrange(60) * 1_000_000
        if k < 40:
            lat, lon = 30.0 + r.uniform(0, 80) / 111_000, 40.0 + r.uniform(0, 80) / 111_000
        elif k < 60:
            lat, lon = 30.02 + r.uniform(0, 60) / 111_000, 40.0
        else:
            lat, lon = 30.05 + r.uniform(0, 3000) / 111_000, 40.0 + r.uniform(0, 3000) / 111_000
        pins.append((f"p{k}", "fire", at, lat, lon, 10.0))
    of = nearby.inferred(spark.createDataFrame(pins, PIN), spark.createDataFrame([("fire", START + s * 1_000_000) for s in range(0, 600)], "type string, at long"))
    got = {(x["at"] - START) // 1_000_000: x for x in of.collect()}
    assert len(got) == 600 and got[300]["k"] == 5000
    want = brute(pins, [("fire", START + 300_000_000)])["fire", START + 300_000_000]
    assert (got[300]["best"]["n"], got[300]["tied"]) == want[1:3] and got[300]["best"]["spread"] == pytest.approx(want[3][1], abs=1e-6)
    groups = nearby.tight_groups(spark.createDataFrame(pins, PIN)).count()
    assert groups < 20 * len(pins)  # not one for each two pins


def test_cover_is_exact(spark):
    """Every moment of an interval is in one node of its cover, and no other moment is."""
    r = random.Random(5)
    spans = [(START + r.randint(0, 10**8), r.choice([0, 1, 7, 2000, 10**6, 2_400_000_001])) for _ in range(60)] + [(-5 * 10**6, 10**7)]
    df = spark.createDataFrame([(a, a + n) for a, n in spans], "lo long, hi long")
    for row in df.select("lo", "hi", nearby._cover(df["lo"], df["hi"]).alias("c")).collect():
        nodes = sorted((n["start"], n["start"] + n["size"]) for n in row["c"])
        assert all(a % (b - a) == 0 for a, b in nodes) and len(nodes) < 100
        assert [b for _, b in nodes][:-1] == [a for a, _ in nodes][1:]
        assert (nodes[0][0], nodes[-1][1]) == (row["lo"], row["hi"]) if nodes else row["lo"] == row["hi"]


@pytest.mark.parametrize("size", [1, 3, 100])
def test_runs_put_groups_together(size):
    r = random.Random(size)
    keys = sorted(r.choices(["", "a", "b", None, "c"], k=40), key=lambda k: (k is not None, k or ""))
    table = pa.table({"k": pa.array(keys, pa.string()), "v": np.arange(40)})
    got = [(g["k"][0].as_py(), g["v"].to_pylist()) for g in runs(iter(table.to_batches(max_chunksize=size)), 1)]
    want = []
    for k, v in zip(keys, range(40)):
        if not want or want[-1][0] != k:
            want.append((k, []))
        want[-1][1].append(v)
    assert got == want and list(runs(iter([]), 1)) == []
    table = table.append_column("home", pa.array([v % 9 == 0 for v in range(40)]))
    got = [(g["k"][0].as_py(), g["v"].to_pylist()) for g in runs(iter(table.to_batches(max_chunksize=size)), 1, 3, "home")]
    assert got == [w for w in want if len(w[1]) >= 3 and any(v % 9 == 0 for v in w[1])]


def test_a_busy_place_gives_few_groups(spark):
    """Pins of a place that never pauses: a group for each moment at which one comes or goes, not for each pin and moment."""
    r = random.Random(4)
    pins = [(f"p{k}", "fire", START + r.randrange(10_800_000_000), 30.0 + r.randrange(3) * 5e-4, 40.0, 10.0) for k in range(700)]
    pins += [(f"q{k}", "fire", START + r.randrange(10_800_000_000), 30.0 + r.uniform(0, 4000) / 111_000, 40.0 + r.uniform(0, 4000) / 111_000, 10.0) for k in range(400)]
    check(spark, pins, [("fire", START + r.randrange(10_800_000_000)) for _ in range(25)])
    assert nearby.tight_groups(spark.createDataFrame(pins, PIN)).count() < 6 * len(pins)


def test_candidates_against_all_pairs(spark, monkeypatch):
    """Borders of the window to the microsecond, lists cut short, and pairs made in many tasks however few their bytes are."""
    from pyspark.sql import functions as F

    from tidewatch.operators import geolocation

    monkeypatch.setattr(geolocation, "LIST", 7)
    r = random.Random(12)
    times = [START + k for k in (0, 1, nearby.WINDOW - 1, nearby.WINDOW, nearby.WINDOW + 1, 2 * nearby.WINDOW, 300_000_000, 299_999_999, -1)] + [START + r.randrange(6 * nearby.WINDOW) for _ in range(60)]
    rows = [(f"r{k:04d}", r.choice(["FLOOD", "FIRE", None]), r.choice([*times, None]), r.choice(["gps", "landmark_geocode", "unresolved", "unresolved"]), r.random() < 0.9) for k in range(900)]
    rows += [(f"dense{k:03d}", "OTHER", START + r.randrange(1000), "unresolved" if k % 2 else "gps", True) for k in range(120)]
    table = spark.createDataFrame(rows, "id string, type string, us long, method string, relevant boolean")
    direct = table.select("id", "method", F.timestamp_micros("us").alias("ts"), F.struct("relevant", F.col("type").alias("disaster_type")).alias("facts"), F.lit(20.0).alias("lat"), F.xxhash64("id").cast("double").alias("lon"), F.lit(15.0).alias("radius_m"))
    made = geolocation.nearby_candidates(direct).withColumn("task", F.spark_partition_id()).collect()
    pins = [x for x in rows if x[3] != "unresolved" and x[1] and x[2] is not None]
    want = [(t[0], p[0]) for t in rows if t[3] == "unresolved" and t[4] and t[1] and t[2] is not None for p in pins if p[1] == t[1] and abs(p[2] - t[2]) <= nearby.WINDOW]
    got = sorted((x["target"], x["id"]) for x in made)
    assert got == sorted(want) and len(want) > 10_000
    lon = {x["id"]: x["lon"] for x in direct.select("id", "lon").collect()}
    assert all(lon[x["id"]] == x["lon"] for x in made)
    assert len({x["task"] for x in made}) > 3


def test_reports_are_not_shuffled_for_a_few_landmarks(spark):
    """Most reports have GPS or share a landmark: dealt by landmark, one task would get them."""
    from tidewatch.operators import extraction, geolocation

    rows = [(f"r{k}", "Water rising near Mayur Vihar, need boat" if k % 2 else "Fire and smoke near the market", 20.0 if k % 3 else None, 77.0) for k in range(300)]
    table = extraction.extract_facts(spark.createDataFrame(rows, "id string, raw_text string, gps_lat double, gps_lon double"))
    direct = geolocation.resolve_direct(table)
    assert "hashpartitioning" not in direct._jdf.queryExecution().executedPlan().toString()
    assert {r["method"]: r["count"] for r in direct.groupBy("method").count().collect()} == {"gps": 200, "landmark_geocode": 50, "unresolved": 50}
