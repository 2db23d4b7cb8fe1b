"""The registered queries: SQL twins, the driver's contract, streams against batch, a second run."""

import os
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidewatch.plans import fixtures, queries

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def engine():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for name in os.listdir(SF):
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if v is not None and type(v).__name__ == "Decimal":
        return round(float(v), 6)
    return v


SAMPLE = ["extract_facts", "validate_extraction", "geocode_hits_filter", "resolve_all", "cluster_partition", "corroboration_counts", "list_incidents", "responder_transition", "social_posts_to_reports", "geo_agreement", "load_reports", "load_known_hashes", "schema_evolve", "write_tables", "stream_sessions", "image_evidence", "media_original_link", "recycled_media", "score_cluster"]


@pytest.mark.parametrize("name", SAMPLE)
def test_sql_twin(spark, engine, name):
    got = entry.queries()[name](spark, SF)
    cursor = engine.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(got.columns) == sorted(columns)
    want = sorted(repr([plain(v) for _, v in sorted(zip(columns, row))]) for row in cursor.fetchall())
    assert sorted(repr([plain(r[c]) for c in sorted(columns)]) for r in got.collect()) == want


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_imports_without_the_training_part(tmp_path):
    """The rest must work where the llm folder and the corpus pipeline are gone."""
    for name in os.listdir(ROOT):
        if name not in ("corpus_pipeline.py", "tidewatch", ".git", "tests"):
            os.symlink(f"{ROOT}/{name}", tmp_path / name)
    os.mkdir(tmp_path / "tidewatch")
    for name in os.listdir(f"{ROOT}/tidewatch"):
        if name != "llm":
            os.symlink(f"{ROOT}/tidewatch/{name}", tmp_path / "tidewatch" / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'list_incidents' in q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert e.oracle_sql()"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})


def test_stream_sessions_are_the_batch_ones(spark):
    batch = queries.QUERIES["inactivity_sessions"](spark, SF).join(fixtures.located(spark, SF).select("id", "disaster_type"), "id").groupBy("disaster_type", "session").agg(F.count("*").alias("n"))
    want = {(r["disaster_type"], r["session"]): r["n"] for r in batch.collect()}
    got = {(r["disaster_type"], r["first_ts"]): r["n"] for r in queries.QUERIES["stream_sessions"](spark, SF).collect()}
    assert got == want


def test_stream_clusters_are_the_batch_ones(spark):
    batch = {r["id"]: r["cluster_id"] for r in queries.QUERIES["cluster_reports"](spark, SF).collect()}
    stream = {r["id"]: r["first_id"] for r in queries.QUERIES["stream_leader_cluster"](spark, SF).collect()}
    assert set(stream) == set(batch)
    heads = {}
    for i, head in stream.items():
        assert heads.setdefault(head, batch[i]) == batch[i]


def test_a_run_takes_what_services_answered(spark):
    from tidewatch.operators import extraction
    from tidewatch.plans.incident_pipeline import run_pipeline

    base = fixtures.reports(spark, SF).filter("event_id < 200").drop("event_id")
    known, now = fixtures.known_hashes(spark, SF), F.lit("2026-01-01").cast("timestamp")
    shown = base.filter("phash IS NOT NULL").select("phash").distinct()
    analyses = extraction.validate_image_analysis(shown, F.lit('{"analyzed":true,"supports_text_claim":false,"confidence":50}'))
    hits = extraction.extract_facts(base).select("facts.landmark", F.col("facts.disaster_type").alias("event_type")).filter("landmark IS NOT NULL").distinct().withColumn("hits", F.lit(2))
    results = spark.createDataFrame([("nowhere", 20.0, 77.0, 26, "amenity", ["20", "20.001", "77", "77.001"])], "query string, lat double, lon double, place_rank int, category string, boundingbox array<string>")
    seen = []
    done = run_pipeline(base, known, now, extractor=lambda r: seen.append(1) or extraction.extract_facts(r), results=results, analyses=analyses, hits=hits)
    rows = done.incidents.select("evidence").collect()
    assert seen and any(r["evidence"]["external_verification_hits"] == 2 for r in rows)
    listed = [a for r in rows for a in r["evidence"]["image_analyses"]]
    assert any(a["analysis"]["analyzed"] and a["analysis"]["supports_text_claim"] is False for a in listed)
    with pytest.raises(ValueError, match="unique"):
        run_pipeline(base.unionByName(base.limit(1)), known, now)
    timeless = base.withColumn("ts", F.when(F.rand(0) > 2, F.col("ts"))).filter("gps_lat IS NOT NULL")
    with pytest.raises(ValueError, match="timestamp is missing"):
        run_pipeline(timeless, known, now)


def test_second_run_changes_no_incident(spark):
    from tidewatch.plans.incident_pipeline import run_pipeline
    from tidewatch.sources.storage import stored

    base = stored(fixtures.reports(spark, SF).filter("event_id < 300").drop("event_id"), "r")
    known, now = fixtures.known_hashes(spark, SF), F.lit("2026-01-01").cast("timestamp")
    first = run_pipeline(base, known, now)
    old, links = stored(first.incidents, "i"), stored(first.links, "l")
    again = run_pipeline(base, known, now, old, links)
    assert sorted(map(str, again.incidents.collect())) == sorted(map(str, old.collect()))
    assert sorted(map(str, again.links.collect())) == sorted(map(str, links.collect()))
    located = first.links.count()
    assert first.report_incident.filter("incident_id IS NOT NULL").count() == located <= 300
