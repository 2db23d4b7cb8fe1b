"""The whole batch: reports to incidents, links and media, on top of an earlier snapshot."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import clustering, evidence, extraction, geolocation, incidents, neardup
from tidewatch.sources.storage import stored


@dataclass
class Tables:
    """What a run gives; each is stored or cheap to compute again."""

    reports: DataFrame
    incidents: DataFrame
    links: DataFrame
    media: DataFrame
    report_incident: DataFrame
    assigned: DataFrame


def incident_rows(scored: DataFrame, assigned: DataFrame) -> DataFrame:
    return scored.join(assigned, "cluster_id").withColumnRenamed("incident_id", "id").drop("cluster_id")


def check_ids(reports: DataFrame) -> None:
    """Fail where an id is missing or not a report's own: joins on it would multiply or lose rows."""
    bad = reports.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1 OR id IS NULL OR trim(id) = ''").orderBy("id").limit(5).collect()
    if bad:
        raise ValueError("report ids must be there and unique: " + ", ".join(f"{r['id']!r} ({r['n']} rows)" for r in bad))


def derive(flat: DataFrame, known: DataFrame, now: Column, old_incidents: DataFrame | None = None, old_links: DataFrame | None = None, *, analyses: DataFrame | None = None, hits: DataFrame | None = None):
    """(incidents, links, assigned, members): what located reports make of an earlier snapshot.

    ``flat``: reports with facts, pins and disaster_type, and maybe the component of ``cluster_partition``. They may be
    a part of all, if it holds every group of reports whole that it touches: the rest of the snapshot stays.
    """
    spark = flat.sparkSession
    clustering.check_reports(flat)
    clusters, member_ids = clustering.cluster_reports(flat)
    members = member_ids.join(flat, "id").withColumn("event_type", F.col("disaster_type"))
    members = stored(evidence.image_analysis_join(members, analyses) if analyses is not None else members, "members")
    scored = stored(evidence.score_cluster(members, clusters.select("cluster_id", "event_type", "center_lat", "center_lon", "uncertainty_radius_m"), known, hits), "scored")
    if old_links is None:
        old_links = spark.createDataFrame([], "incident_id string, report_id string, distance_m double, time_delta_s double")
    overlap = stored(incidents.incident_overlap(members, old_links), "overlap")
    matched = stored(incidents.incident_match(overlap, clusters), "matched")
    fields = incident_rows(scored.limit(0), matched.limit(0)).withColumns({"responder_state": F.lit(None).cast("string"), "updated_at": F.lit(None).cast("timestamp")})
    old = old_incidents if old_incidents is not None else spark.createDataFrame([], fields.schema)
    assigned = stored(matched.unionByName(incidents.incident_new_ids(clusters, matched, old)), "assigned")
    snapshot = incidents.incident_upsert(old.select(*fields.columns), incident_rows(scored, assigned), now)
    distances = clustering.member_distance(members, clusters).join(assigned, "cluster_id").select("incident_id", F.col("id").alias("report_id"), "distance_m", "time_delta_s")
    return snapshot, incidents.link_upsert(old_links, distances), assigned, member_ids


def run_pipeline(
    reports: DataFrame, known: DataFrame, now: Column, old_incidents: DataFrame | None = None, old_links: DataFrame | None = None, cache: DataFrame | None = None, *,
    extractor: Callable[[DataFrame], DataFrame] | None = None, results: DataFrame | None = None, analyses: DataFrame | None = None, hits: DataFrame | None = None,
) -> Tables:
    """``reports``: id, source_user, raw_text, media_url, phash, ts, gps_lat, gps_lon and maybe facts.

    Facts that reports have are kept, so a run over an earlier one's ``reports`` extracts nothing anew.
    ``extractor`` adds facts in the place of the rules (as ``extraction.extract_by_text`` does). The
    other tables are what services have answered: ``results`` of a geocoder
    (``geocode_hits_filter``), ``analyses`` of images (``image_analysis_join``), ``hits`` of a feed
    (``external_verification``). Without one, incidents say that there was no such answer.
    """
    check_ids(reports)
    extract = extractor or extraction.extract_by_text
    facts = extraction.extract_missing(reports, extract).drop("extracted_now") if "facts" in reports.columns else extract(reports)
    facts = stored(facts, "facts")
    direct = stored(geolocation.resolve_direct(extraction.relevant_reports(facts), cache, results), "direct")
    located = stored(geolocation.resolve_all(direct, direct=direct).filter("lat IS NOT NULL"), "located")
    incidents_now, links, assigned, member_ids = derive(located.withColumn("disaster_type", F.col("facts.disaster_type")), known, now, old_incidents, old_links, analyses=analyses, hits=hits)
    media = neardup.media_original_link(facts.select(F.col("id").alias("report_id"), "ts", "phash")).withColumn("id", F.concat(F.lit("med_"), F.col("report_id")))
    return Tables(facts, incidents_now, links, media, incidents.report_incident(facts, member_ids, assigned), assigned)
