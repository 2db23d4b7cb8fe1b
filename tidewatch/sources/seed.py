"""A demonstration incident with three reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

INCIDENT_ID = "INC_042"

# Id, author, people trapped, lat, lon, minutes after 2026-09-11 08:30 UTC, metres from the centre, text.
REPORTS = [
    ("demo_rep_0001", "demo_citizen_01", 6, 28.6084, 77.2951, 0, 0.0, "Floodwater near Metro Pillar 42. Six people are stranded inside a ground-floor shop and need a rescue boat."),
    ("demo_rep_0002", "demo_citizen_02", 4, 28.6081, 77.2954, 2, 31.0, "Four people are stuck by Metro Pillar 42. Water is rising; they need life jackets."),
    ("demo_rep_0003", "demo_citizen_03", 5, 28.6086, 77.2949, 4, 31.0, "Five people are waiting for rescue near Mayur Vihar metro. They need a boat and first aid."),
]


def seed_reports(spark: SparkSession) -> DataFrame:
    start = "2026-09-11 08:30:00"
    rows = spark.createDataFrame([(i, u, t, a, o, m, d, x) for i, u, t, a, o, m, d, x in REPORTS], "id string, source_user string, trapped int, gps_lat double, gps_lon double, minutes int, distance_m double, raw_text string")
    return rows.withColumn("ts", F.timestamp_add("MINUTE", F.col("minutes"), F.lit(start).cast("timestamp"))).drop("minutes")


def seed_incident(incidents: DataFrame) -> DataFrame:
    """``incidents`` with the demonstration incident, if none has its id.

    ``incidents`` has at least id, event_type, title, center_lat, center_lon,
    uncertainty_radius_m, severity_score, confidence_score, verification_status,
    action_priority and responder_state.
    """
    values = {
        "id": INCIDENT_ID, "event_type": "FLOOD", "title": "DEMO: People stranded near Metro Pillar 42", "center_lat": 28.6084, "center_lon": 77.2951, "uncertainty_radius_m": 150.0,
        "severity_score": 8.5, "confidence_score": 88.0, "verification_status": "CORROBORATED", "action_priority": "CRITICAL_DISPATCH", "responder_state": "UNACKNOWLEDGED",
    }
    demo = incidents.sparkSession.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    fresh = demo.join(incidents.select("id"), "id", "left_anti")
    return incidents.unionByName(fresh.select(*values), allowMissingColumns=True)
