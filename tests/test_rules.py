"""The incident rules on small inputs, with known numbers and against plain-Python oracles."""

import math
import random
from datetime import datetime, timedelta
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tidewatch import constants as C
from tidewatch.functions import geo, scoring, text
from tidewatch.operators import clustering, evidence, extraction, geolocation, incidents, neardup

T0 = datetime(2026, 9, 11, 10, 0)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def facts_of(spark, texts):
    table = spark.createDataFrame(list(enumerate(texts)), "id long, raw_text string")
    return [r["facts"] for r in extraction.extract_facts(table).orderBy("id").collect()]


# ------------------------------------------------------------ extraction


@pytest.mark.parametrize(
    "said, want",
    [
        ("RT @u: Water rising fast near Metro Pillar 42. 5 people are stuck and need a rescue boat.", ("FLOOD", "Metro Pillar 42", 5, ["rescue_boat"])),
        ("Three families trapped by fire, fire brigade please", ("FIRE", "fire", 3, ["fire_engine"])),
        ("The bridge collapsed, twelve workers trapped beside the old mill because of debris", ("COLLAPSE", "old mill", 12, [])),
        ("Gas leak outside the market, a dozen residents stranded", ("OTHER", "market", 12, [])),
        ("5 people at home, water level fine", ("FLOOD", None, None, [])),
        ("😢🙏🌧️🙏😢", None), ("Thoughts and prayers, flood", None), ("My food is late", None), ("   ", None), (None, None),
    ],
)
def test_facts(spark, said, want):
    f = facts_of(spark, [said])[0]
    if want is None:
        assert not f["relevant"] and f["claim"] is None and f["resource_demands"] == [] and f["severity"] is None
    else:
        assert (f["disaster_type"], f["landmark"], f["trapped_count"], f["resource_demands"]) == want


def test_words_are_unicode_ones(spark):
    assert one(spark, text.normalize_text(F.lit("RT: Café—été  @x http://a.b/c  NAÏVE!"))) == "café été naïve"
    assert not one(spark, text.found(F.lit("éfire"), C.HAZARD_PATTERNS["FIRE"]))
    assert one(spark, text.found(F.lit("FIRE!"), C.HAZARD_PATTERNS["FIRE"]))


def test_strict_extraction(spark):
    good = '{"relevant":true,"disaster_type":"FIRE","claim":"c","landmark":null,"trapped_count":2,"resource_demands":["a"],"access_impediment":false,"severity":3,"event_time_hint":null}'
    bad = [good.replace('"trapped_count":2', '"trapped_count":2.5'), good.replace('"claim":"c"', '"claim":7'), good.replace('["a"]', "[1]"), good.replace("true", '"true"'), good.replace('"severity":3,', ""), good[:-1], "[]", "null", "", None]
    rows = extraction.validate_extraction(spark.createDataFrame(list(enumerate([good, *bad])), "k long, json string"), F.col("json")).orderBy("k").collect()
    assert [r["extraction_failed"] for r in rows] == [False] + [True] * len(bad)
    assert rows[0]["facts"]["trapped_count"] == 2 and not any(r["facts"]["relevant"] for r in rows[1:])


# ------------------------------------------------------------ geometry


def test_haversine_degree(spark):
    assert one(spark, geo.haversine_m(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))) == pytest.approx(111_195.08, abs=0.1)
    assert one(spark, geo.unwrapped(F.lit(-179.0), F.lit(179.0))) == pytest.approx(181.0)


def distance(a, b, radius=C.EARTH_RADIUS_CLUSTER_M):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * radius * math.asin(math.sqrt(max(0.0, min(1.0, h))))


# ------------------------------------------------------------ clustering


def leader(rows):
    """The sequential rule over everything: sets of ids with centre and radius."""
    found = []
    for id_, kind, lat, lon, radius, ts in sorted(rows, key=lambda r: (r[5], r[0])):
        best, least = None, math.inf
        for c in found:
            if c["kind"] == kind and (ts - c["latest"]).total_seconds() <= 7200:
                d = distance((lat, lon), c["at"])
                if d <= 2000 and d < least:
                    best, least = c, d
        if best is None:
            best = {"kind": kind, "ids": [], "lats": 0.0, "lons": 0.0, "ref": lon, "radius": 0.0}
            found.append(best)
        best["ids"].append(id_)
        best["lats"] += lat
        best["lons"] += best["ref"] + (lon - best["ref"] + 180) % 360 - 180
        best["radius"], best["latest"], n = max(best["radius"], radius), ts, len(best["ids"])
        best["at"] = (best["lats"] / n, (best["lons"] / n + 180) % 360 - 180)
    return found


REPORT = "id string, disaster_type string, lat double, lon double, radius_m double, ts timestamp"


def check_clusters(spark, rows):
    clusters, members = clustering.cluster_reports(spark.createDataFrame(rows, REPORT))
    by = {r["cluster_id"]: r for r in clusters.collect()}
    ids = {}
    for r in members.collect():
        ids.setdefault(r["cluster_id"], set()).add(r["id"])
    want = leader(rows)
    assert [ids[f"CLU_{k:04d}"] for k in range(1, len(want) + 1)] == [set(c["ids"]) for c in want]
    for k, c in enumerate(want, 1):
        r = by[f"CLU_{k:04d}"]
        assert (r["center_lat"], r["center_lon"]) == pytest.approx(c["at"])
        assert r["uncertainty_radius_m"] == pytest.approx(max(50.0, c["radius"] / math.sqrt(len(c["ids"]))))


@pytest.mark.parametrize("where", [(28.6, 77.3, 0.05), (0.0, 179.99, 0.06), (75.0, 10.0, 0.1), (60.0, -3.0, 0.08), (85.0, 20.0, 0.2), (-75.0, 179.99, 0.1), (-85.0, -3.0, 0.2), (89.9, 0.0, 0.09)])
def test_clusters_match_the_sequential_rule(spark, where):
    r = random.Random(str(where))
    lat, lon, wide = where
    rows = [(f"r{k:03d}", r.choice(["FIRE", "FLOOD"]), lat + r.uniform(-wide, wide), (lon + r.uniform(-wide, wide) + 180) % 360 - 180, r.uniform(0, 300), T0 + timedelta(minutes=r.randint(0, 1500))) for k in range(150)]
    check_clusters(spark, rows)


def test_an_endless_stream_is_cut_by_place(spark):
    """Reports of one type without a pause, over far places and at 70 degrees: each place is a group of its own."""
    rows = [(f"r{k:04d}", "FIRE", 70.0 + 0.5 * (k % 20), 10.0 + 1.5 * (k % 7), 10.0, T0 + timedelta(minutes=k)) for k in range(1400)]
    sizes = clustering.cluster_partition(spark.createDataFrame(rows, REPORT)).groupBy("component").count().collect()
    assert len(sizes) >= 140 and max(r["count"] for r in sizes) <= 10


def test_two_hours_and_radius(spark):
    at = lambda k, s: (f"r{k}", "FIRE", 28.6, 77.3, 200.0, T0 + timedelta(seconds=s))
    check_clusters(spark, [at(1, 0), at(2, 7200)])
    check_clusters(spark, [at(1, 0), at(2, 7201)])
    clusters, _ = clustering.cluster_reports(spark.createDataFrame([at(1, 0), at(2, 7200)], REPORT))
    assert clusters.first()["uncertainty_radius_m"] == pytest.approx(200 / math.sqrt(2))


def test_bad_rows_are_named(spark):
    rows = [("a", "FIRE", 1.0, 1.0, 1.0, T0), ("a", "FIRE", 1.0, 1.0, 1.0, T0), (" ", None, 91.0, 0.0, -1.0, None), ("n", "FIRE", float("nan"), 0.0, float("inf"), T0)]
    got = [r["problems"] for r in clustering.cluster_validate(spark.createDataFrame(rows, REPORT)).orderBy("ts", "id").collect()]
    assert sorted(map(len, got)) == [1, 1, 2, 5]


# ------------------------------------------------------------ nearby inference


def test_nearby_group_and_outlier(spark):
    rows = [("a", 28.60, 77.30, 0), ("b", 28.6003, 77.3002, 5), ("far", 28.70, 77.40, 6), ("open", None, None, 4), ("late", None, None, 60)]
    table = spark.createDataFrame([(i, a, o, T0 + timedelta(minutes=m), "near the mill, flood") for i, a, o, m in rows], "id string, gps_lat double, gps_lon double, ts timestamp, raw_text string")
    direct = geolocation.resolve_direct(extraction.extract_facts(table))
    got = {r["id"]: r for r in geolocation.resolve_all(direct, direct=direct).collect()}
    assert got["open"]["method"] == "nearby_inference" and got["open"]["lat"] == pytest.approx(28.60015) and got["open"]["radius_m"] >= 150 and got["open"]["confidence"] == pytest.approx(0.25)
    assert got["late"]["method"] == "unresolved" and got["late"]["detail"] == "only_0_neighbors"
    assert got["a"]["method"] == "gps" and got["a"]["confidence"] == 0.97


def test_gazetteer_takes_the_longest_whole_words(spark):
    q = spark.createDataFrame([("mayur vihar metro gate",), ("mayur viharx",), ("old mayur vihar phase 1",)], "query string")
    got = {r["query"]: (r["radius_m"], r["detail"]) for r in geolocation.gazetteer_match(q).collect()}
    assert got == {"mayur vihar metro gate": (90.0, "gazetteer:mayur vihar metro"), "old mayur vihar phase 1": (500.0, "gazetteer:mayur vihar phase 1")}


# ------------------------------------------------------------ near-duplicates


def brute_groups(rows):
    norm = {}
    root = {i: i for i, _, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    import re

    def normal(t):
        t = re.sub(r"^\s*(?:RT|Repost|Forwarded(?:\s+update)?|Shared\s+from)\b[:\s]*", "", t, flags=re.I)
        t = re.sub(r"[^\w\s]", " ", re.sub(r"@[A-Za-z0-9_]+", "", re.sub(r"https?://\S+", "", t)).lower())
        return re.sub(r"\s+", " ", t).strip()

    order = sorted(rows, key=lambda r: (r[1], r[0]))
    norm = {i: normal(t) for i, _, t in order}
    for k, (i, _, _) in enumerate(order):
        for j, _, _ in order[k + 1 :]:
            a, b = norm[i], norm[j]
            if a and b and (a == b or (min(len(a), len(b)) >= 12 and SequenceMatcher(None, a, b).ratio() >= 0.85)):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    groups = {}
    for i in norm:
        groups.setdefault(find(i), set()).add(i)
    return sorted(map(sorted, groups.values()))


def test_duplicate_texts(spark):
    r = random.Random(4)
    words = "water rising near the metro pillar people stuck inside shop boat please help now".split()
    rows = []
    for k in range(40):
        t = [w for w in words if r.random() > r.choice([0.02, 0.1, 0.4])]
        rows.append((f"r{k:02d}", T0 + timedelta(minutes=r.randint(0, 9)), r.choice(["", "RT: ", "@u "]) + " ".join(t) + r.choice(["", "!", " http://x.y"])))
    rows += [("s1", T0, "short"), ("s2", T0, "Short!"), ("e1", T0, "!!"), ("e2", T0, "")]
    table = spark.createDataFrame([("c", *x) for x in rows], "cluster_id string, id string, ts timestamp, raw_text string")
    got = sorted(r["report_ids"] for r in neardup.group_duplicate_texts(table).collect())
    assert got == brute_groups(rows)


def test_hash_pairs_are_exact(spark):
    r = random.Random(8)
    base = [r.getrandbits(64) for _ in range(30)] + [0, 2**64 - 1]
    values = sorted({b ^ sum(1 << k for k in r.sample(range(64), r.randint(0, 7))) for b in base for _ in range(6)})
    table = spark.createDataFrame([(f"{v:016x}",) for v in values] + [("nothex",), (None,)], "phash string")
    got = {(x["a"], x["b"]) for x in neardup.phash_similarity_join(table).collect()}
    assert got == {(f"{a:016x}", f"{b:016x}") for k, a in enumerate(values) for b in values[k + 1 :] if (a ^ b).bit_count() <= 5}
    assert one(spark, neardup.hamming_duplicate(F.lit("0" * 16), F.lit("0" * 14 + "1f"))) is True
    assert one(spark, neardup.hamming_duplicate(F.lit("0" * 16), F.lit("0" * 14 + "3f"))) is False


def test_originals_come_earlier(spark):
    r = random.Random(1)
    media = [(f"r{k:02d}", T0 + timedelta(minutes=r.randint(0, 30)), f"{r.choice([0, 3, 255, 2**63]) ^ (1 << r.randint(0, 40)):016x}") for k in range(40)]
    got = {x["report_id"]: x["is_duplicate_of"] for x in neardup.media_original_link(spark.createDataFrame(media, "report_id string, ts timestamp, phash string")).collect()}
    done, want = {}, {}
    for i, t, h in sorted(media, key=lambda m: (m[1], m[0])):
        want[i] = next((f"med_{j}" for j in sorted(done) if (int(done[j], 16) ^ int(h, 16)).bit_count() <= 5), None)
        done[i] = h
    assert got == want


# ------------------------------------------------------------ evidence and scores


MEMBER = "cluster_id string, event_type string, id string, ts timestamp, source_user string, raw_text string, phash string, lat double, lon double"


def witness(spark, rows):
    table = spark.createDataFrame([("c", "FLOOD", i, T0 + timedelta(minutes=k), u, t, h, 28.6, 77.3) for k, (i, u, t, h) in enumerate(rows)], MEMBER)
    return extraction.extract_facts(table)


def test_witnesses_and_images(spark):
    zero, near, far = "0" * 16, "000000000000001f", "f" * 16
    rows = [("a", "@Neha", "flood here", zero), ("b", "rajat", "flood", near), ("c", "imran", "RT @neha flood", None), ("d", "zoe", "flood", far), ("e", " @ZOE ", "flood", None)]
    known = spark.createDataFrame([("old", "000000000000000f"), ("bad", "xyz")], "source string, phash string")
    got = evidence.corroboration_counts(witness(spark, rows), known).first()
    assert (got["total_reports"], got["independent_sources"], got["unique_images"], got["recycled_media_detected"], got["duplicate_image_groups"]) == (5, 2, 2, 2, 1)


def test_known_scores(spark):
    conf = lambda s, g, m, h, c: one(spark, scoring.confidence(*[F.lit(x) for x in (s, g, m, h, c)]))
    assert conf(5, 0.9, 1.0, 3, False) == pytest.approx(97.5) and conf(5, 0.9, 1.0, 3, True) == pytest.approx(52.5)
    assert conf(None, float("nan"), None, None, None) == 0.0
    sev = scoring.severity(F.lit("FLOOD"), F.lit(3), F.lit(True), F.array(F.lit("rescue_boat"), F.lit("medical_evac")))
    assert one(spark, sev) == pytest.approx(9.6)
    for c, s, want in ((70.0, 7.0, "CRITICAL_DISPATCH"), (69.9, 7.0, "DEPLOY_SCOUT"), (70.0, 6.9, "MONITOR"), (0.0, 1.0, "SUPPRESSED")):
        assert one(spark, scoring.action_priority(F.lit(c), F.lit(s))) == want
    with pytest.raises(Exception, match="out of range"):
        one(spark, scoring.action_priority(F.lit(101.0), F.lit(5.0)))


def test_risk(spark):
    calm = one(spark, scoring.misinformation_risk(*[F.lit(x) for x in (False, 0, 0, 5, 0, 0, 4, 0.9, 0)]))
    assert (calm["risk_score"], calm["risk_level"], calm["signals"], calm["assessment"]) == (0.0, "LOW", [], C.ASSESSMENT_NONE)
    loud = one(spark, scoring.misinformation_risk(*[F.lit(x) for x in (True, 2, 1, 10, 1, 2, 1, 0.1, 3)]))
    assert loud["risk_score"] == 1.0 and loud["risk_level"] == "HIGH" and len(loud["signals"]) == 7 and not loud["proven_false"]


def test_contradictions_by_landmark(spark):
    rows = [("a", "u1", "Sector 4 bridge has collapsed", None), ("b", "u2", "The Sector 4 bridge is fine, it has NOT collapsed", None), ("c", "u3", "no landmark, building collapsed", None)]
    got = evidence.contradiction_groups(witness(spark, rows)).collect()
    assert [(r["landmark"], r["affirming_report_ids"], r["denying_report_ids"]) for r in got] == [("Sector 4 Bridge", ["a"], ["b"])]
    assert evidence.denial_flags(witness(spark, rows)).first()["has_contradiction"]
    assert not evidence.denial_flags(witness(spark, rows[1:2])).first()["has_contradiction"]


# ------------------------------------------------------------ identity and states


def test_greedy_match(spark):
    r = random.Random(6)
    pairs = {(f"c{k}", f"INC_{r.randint(0, 14):03d}"): r.randint(1, 4) for k in range(25) for _ in range(r.randint(0, 3))}
    overlap = spark.createDataFrame([(c, i, n) for (c, i), n in pairs.items()], "cluster_id string, incident_id string, shared long")
    clusters = spark.createDataFrame([(f"c{k}", k) for k in range(25)], "cluster_id string, place long")
    got = {x["cluster_id"]: x["incident_id"] for x in incidents.incident_match(overlap, clusters).collect()}
    taken, want = set(), {}
    for k in range(25):
        for (_, i), n in sorted(((p, n) for p, n in pairs.items() if p[0] == f"c{k}"), key=lambda x: (-x[1], x[0][1])):
            if i not in taken:
                taken.add(i)
                want[f"c{k}"] = i
                break
    assert got == want


def test_states_only_rise(spark):
    have = spark.createDataFrame([("A", None), ("B", "DISPATCHED")], "id string, responder_state string")
    said = [("A", "ACKNOWLEDGED"), ("A", "ACKNOWLEDGED"), ("A", "RESOLVED"), ("A", "DISPATCHED"), ("A", "LOST"), ("B", "ACKNOWLEDGED"), ("B", "RESOLVED"), ("X", "RESOLVED")]
    table = spark.createDataFrame([(k, i, s, T0 + timedelta(minutes=k)) for k, (i, s) in enumerate(said)], "command_id long, incident_id string, state string, ts timestamp")
    got = [x["outcome"] for x in incidents.responder_transition(table, have).orderBy("command_id").collect()]
    assert got == ["accepted", "no_op", "accepted", "conflict", "unknown_state", "conflict", "accepted", "not_found"]
