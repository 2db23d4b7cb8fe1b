"""Micro-batches that derive only what they touch give what the whole batch gives, after each of them."""

import os

import pytest
from pyspark.sql import functions as F

from tidewatch.plans import fixtures
from tidewatch.plans.incident_pipeline import run_pipeline
from tidewatch.sources.reports import newest_snapshot, read_snapshot
from tidewatch.sources.storage import shared_dir, stored
from tidewatch.streaming import ingest

SF = "/root/testdata/sf0.001"
NOW = "2026-01-01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def _rows(df):
    return sorted(map(repr, df.select(*sorted(c for c in df.columns if c != "updated_at")).collect()))


def test_each_micro_batch_gives_what_the_whole_batch_gives(spark):
    """Batches out of order: half of all, late reports among them, then a few that fill gaps, one of which comes again."""
    now, known = F.lit(NOW).cast("timestamp"), fixtures.known_hashes(spark, SF)
    reports = fixtures.reports(spark, SF).drop("event_id")
    # Ten places and five days, so that groups are large, join and are joined by late reports.
    day = F.timestamp_seconds(1_700_000_000 + F.pmod(F.xxhash64("id"), F.lit(5 * 86_400)))
    spot = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(10))
    part = F.pmod(F.xxhash64("id", F.lit(2)), F.lit(20))
    reports = reports.withColumns({"ts": day, "gps_lat": F.when(F.col("gps_lat").isNotNull(), 20 + spot * 0.03), "gps_lon": F.when(F.col("gps_lon").isNotNull(), F.lit(77.0))})
    reports = stored(reports.withColumn("batch", F.when(part < 10, 0).when(part < 19, 1).otherwise(2)), "reports")
    n, root, old = reports.count(), shared_dir(spark, "ingest"), (None, None)
    for k in range(3):
        batch = reports.filter(F.col("batch") == k).drop("batch")
        # The third batch brings reports that are there already.
        batch = batch if k < 2 else batch.unionByName(reports.filter("batch = 1").drop("batch").limit(5))
        at = ingest.ingest_batch(batch, k, root, known, now)
        whole = run_pipeline(reports.filter(F.col("batch") <= k).drop("batch"), known, now, *old)
        old = stored(whole.incidents, "whole"), stored(whole.links, "whole-links")
        assert _rows(read_snapshot(spark, at, "incidents")) == _rows(old[0])
        assert _rows(read_snapshot(spark, at, "links")) == _rows(old[1])
        cost = read_snapshot(spark, at, "progress").first()
        assert cost["new"] == reports.filter(F.col("batch") == k).count() and cost["reports"] == reports.filter(F.col("batch") <= k).count()
    assert cost["reports"] == n and old[0].count() > 20
    assert cost["new"] < cost["touched"] < n
    assert ingest.ingest_batch(batch, 2, root, known, now) == at


def test_a_small_batch_touches_few_reports_and_survives_a_failure(spark, monkeypatch):
    now, known = F.lit(NOW).cast("timestamp"), fixtures.known_hashes(spark, SF)
    reports = stored(fixtures.reports(spark, SF).drop("event_id"), "reports")
    late = F.pmod(F.xxhash64("id"), F.lit(50)) == 0
    root = shared_dir(spark, "ingest")
    first = ingest.ingest_batch(reports.filter(~late), 0, root, known, now)
    before = {r["id"]: r["updated_at"] for r in read_snapshot(spark, first, "incidents").collect()}

    derive, calls = ingest.derive, []

    def fails_once(*args, **more):
        calls.append(1)
        if len(calls) == 1:
            raise OSError("lost")
        return derive(*args, **more)

    monkeypatch.setattr(ingest, "derive", fails_once)
    with pytest.raises(OSError):
        ingest.ingest_batch(reports.filter(late), 1, root, known, F.lit("2026-01-02").cast("timestamp"))
    at = ingest.ingest_batch(reports.filter(late), 1, root, known, F.lit("2026-01-02").cast("timestamp"))
    cost = read_snapshot(spark, at, "progress").first()
    assert 0 < cost["touched"] < 0.1 * cost["reports"]
    # The rest is as it was, its time of change too.
    after = {r["id"]: r["updated_at"] for r in read_snapshot(spark, at, "incidents").collect()}
    changed = [i for i in after if after[i] != before.get(i)]
    assert 0 < len(changed) < 0.1 * len(after) and set(before) <= set(after)
    # A batch without reports changes nothing.
    empty = ingest.ingest_batch(reports.limit(0), 2, root, known, now)
    assert _rows(read_snapshot(spark, empty, "incidents")) == _rows(read_snapshot(spark, at, "incidents"))


def test_reports_that_cannot_be_clustered_fail_the_batch(spark):
    root, known = shared_dir(spark, "ingest"), fixtures.known_hashes(spark, SF)
    reports = fixtures.reports(spark, SF).drop("event_id").filter("gps_lat IS NOT NULL").withColumn("ts", F.lit(None).cast("timestamp"))
    with pytest.raises(ValueError, match="timestamp is missing"):
        ingest.ingest_batch(reports, 0, root, known, F.lit(NOW).cast("timestamp"))
    with pytest.raises(ValueError, match="unique"):
        ingest.ingest_batch(reports.unionByName(reports), 0, root, known, F.lit(NOW).cast("timestamp"))
    assert newest_snapshot(spark, f"{root}/snapshots") is None
