"""Streams give all that the batch gives, the last rows and sessions included."""

import os

import pytest
from pyspark.sql import functions as F

from tidewatch.plans import fixtures, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_replay_is_in_order_of_time(spark):
    rows = spark.range(1000).select(F.timestamp_seconds((F.col("id") * 7919) % 1000).alias("ts"))
    stream = queries._as_stream(spark, rows)
    seen = []
    stream.writeStream.foreachBatch(lambda b, _: seen.append(b.agg(F.min("ts"), F.max("ts"), F.count("*")).first())).trigger(availableNow=True).start().awaitTermination()
    assert len(seen) == 2 and sum(s[2] for s in seen) == 1000 and seen[0][1] < seen[1][0]


def test_all_sessions_are_given(spark):
    at = fixtures.inactivity(fixtures.located(spark, SF)).groupBy("disaster_type", F.unix_micros("session").alias("s")).agg(F.count("*").alias("n"))
    got = queries.QUERIES["stream_sessions"](spark, SF).select("disaster_type", "first_ts", "n")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, at.collect()))


def test_all_located_reports_are_clustered(spark):
    batch = {r["id"]: r["cluster_id"] for r in queries.QUERIES["cluster_reports"](spark, SF).collect()}
    stream = {r["id"]: r["first_id"] for r in queries.QUERIES["stream_leader_cluster"](spark, SF).collect()}
    assert set(stream) == set(batch)
    assert len({(stream[i], batch[i]) for i in batch}) == len(set(stream.values())) == len(set(batch.values()))


def test_late_reports_are_given_as_late(spark, tmp_path):
    """Each file a micro-batch: the third brings a report from before the watermark and one from after it."""
    from tidewatch.streaming.incidents import stream_leader_cluster

    shape = "id string, disaster_type string, lat double, lon double, radius_m double, ts timestamp"
    files = [[("a", 0), ("b", 300)], [("c", 7200)], [("late", 100), ("d", 7300)], [("end", 90_000)], [("after", 180_000)]]
    for rows in files:
        made = spark.createDataFrame([(i, "FLOOD", 20.0, 77.0, 10.0, 1_700_000_000 + s) for i, s in rows], shape.replace("ts timestamp", "s long"))
        made.withColumn("ts", F.timestamp_seconds("s")).drop("s").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        got = queries._run(spark, stream_leader_cluster(stream, "1 minute")).collect()
    finally:
        spark.conf.set(key, before)
    assert {r["id"]: r["first_id"] for r in got if not r["late"]} == {"a": "a", "b": "a", "c": "a", "d": "a", "end": "end"}
    assert [(r["id"], r["first_id"]) for r in got if r["late"]] == [("late", None)]


def test_ingest_gives_the_incidents_of_the_batch(spark):
    """After the last micro-batch: the incidents of all reports at once."""
    from tidewatch.plans.incident_pipeline import run_pipeline

    batch = run_pipeline(fixtures.reports(spark, SF).drop("event_id"), fixtures.known_hashes(spark, SF), F.lit("2026-01-01").cast("timestamp")).incidents
    stream = queries.QUERIES["stream_ingest"](spark, SF)
    want = sorted(map(tuple, batch.select(*stream.columns).collect()))
    assert sorted(map(tuple, stream.collect())) == want and len(want) > 100


def test_no_query_replaces_another():
    """A second definition under a name once took the place of the streamed ``stream_ingest``."""
    import inspect

    assert "stream_incidents" in inspect.getsource(queries.QUERIES["stream_ingest"])
    with pytest.raises(ValueError, match="stream_ingest"):

        @queries.query()
        def stream_ingest(spark, d): ...


class _List(list):
    """A list state that counts how many rows are read."""

    read = 0

    def get(self):
        self.read += len(self)
        return iter(list(self))

    def put(self, rows):
        self[:] = rows

    appendList = list.extend  # noqa: N815


class _Handle:
    def __init__(self):
        self.lists, self.value, self.timers = {}, None, set()

    def getListState(self, name, _):
        return self.lists.setdefault(name, _List())

    def getValueState(self, *_):
        return self

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None

    def registerTimer(self, at):
        self.timers.add(at)


def test_waiting_reports_are_read_once():
    """A micro-batch in many pieces: the waiting reports are read once when the watermark moves, not once for each piece."""
    from types import SimpleNamespace

    import pandas as pd

    from tidewatch.streaming.incidents import LeaderClusters

    handle, taken = _Handle(), LeaderClusters()
    taken.init(handle)
    pieces = [pd.DataFrame({"id": [f"r{p:02}{k}" for k in range(5)], "at": [100.0 + p + 20 * k for k in range(5)], "lat": 20.0, "lon": 77.0, "radius_m": 5.0}) for p in range(20)]
    assert not list(taken.handleInputRows("FLOOD", iter(pieces), SimpleNamespace(getCurrentWatermarkInMs=lambda: 0)))
    out, mark = [], SimpleNamespace(getCurrentWatermarkInMs=lambda: 150_000)
    while due := sorted(t for t in handle.timers if t <= 150_000):
        handle.timers.discard(due[0])
        out += [i for frame in taken.handleExpiredTimer("FLOOD", mark, due[0]) for i in frame["id"]]
    assert len(out) == 50 == len(set(out)) and handle.lists["pending"].read == 100
    assert handle.timers == {150_001} and len(handle.lists["pending"]) == 50


class _Map(dict):
    """A map state that knows the largest value it held."""

    largest = 0

    def getValue(self, key):  # noqa: N802
        return self.get(key)

    def updateValue(self, key, value):  # noqa: N802
        self[key], self.largest = value, max(self.largest, len(value[0]))

    def removeKey(self, key):  # noqa: N802
        del self[key]


def _led(processor, handle, batches, mark_after):
    """Each micro-batch, in pieces of 50 rows, under the watermark that the one before it left; ids in the order given."""
    from types import SimpleNamespace

    out, mark = [], 0
    processor.init(handle)
    for frame, after in zip(batches, mark_after):
        at = SimpleNamespace(getCurrentWatermarkInMs=lambda m=mark: m * 1000)
        pieces = (frame.iloc[k : k + 50] for k in range(0, len(frame), 50))
        out += [r for f in processor.handleInputRows("FLOOD", pieces, at) for r in f.itertuples(index=False, name=None)]
        mark, at = after, SimpleNamespace(getCurrentWatermarkInMs=lambda m=after: m * 1000)
        while due := sorted(t for t in handle.timers if t <= mark * 1000):
            handle.timers.discard(due[0])
            out += [r for f in processor.handleExpiredTimer("FLOOD", at, due[0]) for r in f.itertuples(index=False, name=None)]
    return [r[:5] if not r[5] else (r[0], "late") for r in out]


def test_waiting_reports_are_sorted_runs(monkeypatch):
    """Runs in state, merged a piece at a time, give what one list of all waiting reports gives; no value holds more than a piece."""
    import random

    import pandas as pd

    from tidewatch.streaming import incidents

    r, k, batches, marks = random.Random(6), 0, [], []
    for batch in range(6):
        rows = [(f"r{k + j:05d}", batch * 5000.0 + r.choice([-3000, 0, 0]) + r.randrange(5000), 20 + r.randrange(40) / 200, 77 + r.randrange(40) / 200, 5.0) for j in range(700)]
        k += len(rows)
        batches.append(pd.DataFrame(rows, columns=["id", "at", "lat", "lon", "radius_m"]))
        marks.append(batch * 5000 + 3500)
    batches.append(batches[0].iloc[:0])
    marks.append(10**6)
    want = _led(incidents.LeaderClusters(), _Handle(), batches, marks)
    monkeypatch.setattr(incidents, "RUN_ROWS", 120)
    monkeypatch.setattr(incidents, "PIECE_ROWS", 16)
    monkeypatch.setattr(incidents, "OUT_ROWS", 30)
    handle, pieces = _Handle(), _Map()
    handle.getMapState = lambda *_: pieces
    got = _led(incidents.SortedLeaderClusters(), handle, batches, marks)
    assert sorted(got) == sorted(want) and [x for x in got if x[1] != "late"] == [x for x in want if x[1] != "late"]
    assert len(got) == k and any(x[1] == "late" for x in got) and not pieces and not handle.lists["runs"]
    assert 0 < pieces.largest < 3000


def test_open_clusters_by_latitude():
    """Against a pass over all clusters: the nearest within reach, the earlier one on ties, also as centres move between bands."""
    import random

    from tidewatch import constants as C
    from tidewatch.operators import clustering

    r, at, mine, plain = random.Random(8), 0.0, clustering.Leaders(), []
    for k in range(6000):
        at += r.choice([0, 1, 30, 300])
        lat, lon = r.choice([-0.02, 0.0, 0.04, 20.0, 89.98, -89.99]) + r.randrange(-30, 30) / 1000, r.choice([77.0, 179.99, -179.99]) + r.randrange(-9, 9) / 1000
        lat = max(-90.0, min(90.0, lat))
        best, least = None, float("inf")
        for x in plain:
            if at - x.latest <= C.CLUSTER_WINDOW_S and (d := clustering._distance(lat, lon, x.lat, x.lon)) <= C.CLUSTER_DISTANCE_M and d < least:
                best, least = x, d
        if best is None:
            plain.append(best := clustering.Leader(lon))
        best.add(at, f"r{k}", lat, lon, 5.0)
        got = mine.assign(at, f"r{k}", lat, lon, 5.0)
        assert (got.first_id, got.n, got.lat, got.lon) == (best.first_id, best.n, best.lat, best.lon)
    assert len(plain) > 100 and len(mine.open()) < len(plain)
