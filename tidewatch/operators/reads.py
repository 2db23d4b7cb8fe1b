"""Read queries over incidents, links, reports and media."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def list_incidents(incidents: DataFrame, status: str = "active", limit: int | None = None) -> DataFrame:
    """Most severe first; ``active`` leaves resolved ones out, ``resolved`` the others, ``all`` none."""
    resolved = F.col("responder_state") == "RESOLVED"
    rows = {"active": incidents.filter(~resolved), "resolved": incidents.filter(resolved), "all": incidents}[status]
    rows = rows.orderBy(F.desc("severity_score"), "id")
    return rows if limit is None else rows.limit(limit)


def incident_updates(incidents: DataFrame, since: Column) -> DataFrame:
    return incidents.filter(F.col("updated_at") >= since).orderBy(F.desc("updated_at"), "id")


def incident_detail(incidents: DataFrame, links: DataFrame, reports: DataFrame) -> DataFrame:
    """Incidents with their linked reports, sorted by report id."""
    linked = links.join(reports.select(F.col("id").alias("report_id"), "source_user", "raw_text", "ts"), "report_id")
    nested = linked.groupBy("incident_id").agg(F.sort_array(F.collect_list(F.struct("report_id", "source_user", "raw_text", "ts", "distance_m", "time_delta_s"))).alias("reports"))
    return incidents.join(nested, incidents["id"] == nested["incident_id"], "left").drop("incident_id")


def incident_evidence(links: DataFrame, reports: DataFrame, media: DataFrame) -> DataFrame:
    """A row for each linked report, with its media if it has any."""
    linked = links.join(reports.select(F.col("id").alias("report_id"), "source_user", "raw_text"), "report_id")
    return linked.join(media.select("report_id", "phash", "is_duplicate_of"), "report_id", "left")


def map_incidents(incidents: DataFrame) -> DataFrame:
    return incidents.filter("responder_state <> 'RESOLVED'").select("id", "center_lat", "center_lon", "uncertainty_radius_m", "action_priority")


def incident_search(incidents: DataFrame, search: str = "", tab: str = "all") -> DataFrame:
    """Substring of title, id or type without regard to case, and one of the tabs."""
    tabs = {
        "critical": F.col("action_priority") == "CRITICAL_DISPATCH",
        "developing": F.col("verification_status") == "DEVELOPING",
        "monitor": F.col("action_priority") == "MONITOR",
        "resolved": F.col("responder_state") == "RESOLVED",
    }
    needle = search.strip().lower()
    rows = incidents
    if needle:
        rows = rows.filter(F.lower("title").contains(needle) | F.lower("id").contains(needle) | F.lower("event_type").contains(needle))
    return rows.filter(tabs[tab]) if tab in tabs else rows


def incident_facets(incidents: DataFrame) -> DataFrame:
    """One row of counts for tabs, summary and map."""
    open_, is_ = F.col("responder_state") != "RESOLVED", lambda c, v: F.col(c) == v
    return incidents.agg(
        F.count("*").alias("n_all"),
        F.count_if(is_("action_priority", "CRITICAL_DISPATCH")).alias("critical"),
        F.count_if(is_("verification_status", "DEVELOPING")).alias("developing"),
        F.count_if(is_("action_priority", "MONITOR")).alias("monitor"),
        F.count_if(~open_).alias("resolved"),
        F.count_if(open_).alias("active"),
        F.count_if(is_("verification_status", "CONTRADICTED")).alias("contradicted"),
        *[F.count_if(open_ & is_("action_priority", p)).alias(f"open_{p.lower()}") for p in ("CRITICAL_DISPATCH", "DEPLOY_SCOUT", "MONITOR", "SUPPRESSED")],
    )
