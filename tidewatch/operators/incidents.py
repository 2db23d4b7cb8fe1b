"""Incident identity over runs, upserts of incidents and links, and responder states."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch import constants as C
from tidewatch.functions import geo
from tidewatch.operators.components import connected_components
from tidewatch.sources.storage import ranked


def incident_overlap(members: DataFrame, links: DataFrame) -> DataFrame:
    """cluster_id, incident_id, shared: reports that a new cluster and a stored incident share."""
    met = members.select("cluster_id", F.col("id").alias("report_id")).join(links.select("incident_id", "report_id"), "report_id")
    return met.groupBy("cluster_id", "incident_id").agg(F.count("*").alias("shared"))


def _greedy(batches):
    """Clusters in order; each takes its largest overlap that no earlier one took, then the smaller id.

    Rows (root, cluster_id, incident_id) are sorted by root, place, shared (largest first) and incident_id.
    """
    names, out = ["cluster_id", "incident_id"], []

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], names=names)

    root, taken, done = None, set(), None
    for rows in batches:
        for key, cluster, incident in zip(*(rows.column(k).to_pylist() for k in range(3))):
            if key != root:
                root, taken, done = key, set(), None
            if cluster != done and incident not in taken:
                taken.add(incident)
                done = cluster
                out.append((cluster, incident))
        if len(out) >= 10_000:
            yield batch()
            out = []
    if out:
        yield batch()


def incident_match(overlap: DataFrame, clusters: DataFrame) -> DataFrame:
    """cluster_id, incident_id: stored incidents that new clusters continue.

    Choices only meet through shared incidents, so connected components are matched apart, many in one pass.
    """
    edges = overlap.select(F.concat(F.lit("c|"), F.col("cluster_id")).alias("a"), F.concat(F.lit("i|"), F.col("incident_id")).alias("b"))
    roots = connected_components(edges)
    keyed = overlap.join(clusters.select("cluster_id", "place"), "cluster_id").withColumn("node", F.concat(F.lit("c|"), F.col("cluster_id"))).join(roots, "node").drop("node")
    order = [F.col("root"), F.col("place"), F.col("shared").desc(), F.col("incident_id")]
    dealt = keyed.repartition("root").sortWithinPartitions(*order).select("root", "cluster_id", "incident_id")
    return dealt.mapInArrow(_greedy, "cluster_id string, incident_id string")


def incident_new_ids(clusters: DataFrame, matched: DataFrame, incidents: DataFrame) -> DataFrame:
    """cluster_id, incident_id of clusters without a match: the next free numbers, in cluster order."""
    number = F.regexp_extract("id", "^INC_([0-9]+)$", 1).try_cast("long")
    highest = incidents.agg(F.max(number).alias("m")).first()["m"] or 0
    fresh = ranked(clusters.select("cluster_id", "place").join(matched.select("cluster_id"), "cluster_id", "left_anti"), [F.col("place"), F.col("cluster_id")], "n")
    text = (F.col("n") + F.lit(highest)).cast("string")
    return fresh.select("cluster_id", F.concat(F.lit("INC_"), F.lpad(text, F.greatest(F.lit(3), F.length(text)), F.lit("0"))).alias("incident_id"))


def merge_timeline(stored: Column, derived: Column) -> Column:
    """Responders' entries stay, the others are derived anew; sorted by time and event."""
    kept = F.filter(F.coalesce(stored, F.array().cast("array<struct<time:string,event:string>>")), lambda e: e["event"].startswith(C.RESPONDER_PREFIX))
    return F.array_sort(F.concat(derived, kept))


def incident_upsert(old: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """The next snapshot: recomputed incidents replaced, responder state kept, others untouched.

    ``new`` has the columns of ``old`` but responder_state and updated_at.
    """
    fields = [c for c in old.columns if c not in ("id", "responder_state", "updated_at", "timeline")]
    o, n = old.alias("o"), new.alias("n")
    met = o.join(n, F.col("o.id") == F.col("n.id"), "full_outer")
    is_new = F.col("n.id").isNotNull()
    picked = [F.when(is_new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in fields]
    timeline = F.when(is_new, merge_timeline(F.col("o.timeline"), F.col("n.timeline"))).otherwise(F.col("o.timeline"))
    columns = {"responder_state": F.coalesce("o.responder_state", F.lit(C.RESPONDER_ORDER[0])), "updated_at": F.when(is_new, now).otherwise(F.col("o.updated_at")), "timeline": timeline}
    return met.select(F.coalesce("n.id", "o.id").alias("id"), *picked, *[v.alias(k) for k, v in columns.items()]).select(*old.columns)


def link_upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Links of recomputed incidents are replaced; those of others remain."""
    redone = new.select("incident_id").distinct()
    return old.join(redone, "incident_id", "left_anti").select(*new.columns).unionByName(new)


def report_incident(reports: DataFrame, members: DataFrame, assigned: DataFrame) -> DataFrame:
    """id, incident_id of every report of the run; null for noise and for reports without a place."""
    own = members.join(assigned, "cluster_id").select("id", "incident_id")
    return reports.select("id").join(own, "id", "left")


def validate_incidents(incidents: DataFrame) -> DataFrame:
    """rule, violations: how many incident rows break each rule."""
    def outside(c, low, high):
        return ~F.coalesce(F.col(c).between(low, high), F.lit(False))

    rules = {
        "center": ~geo.valid_coordinates(F.col("center_lat"), F.col("center_lon")),
        "uncertainty_radius_m": outside("uncertainty_radius_m", 0.0, float("inf")),
        "severity_score": outside("severity_score", 0.0, 10.0),
        "confidence_score": outside("confidence_score", 0.0, 100.0),
        "verification_status": ~F.col("verification_status").isin("CORROBORATED", "DEVELOPING", "CONTRADICTED"),
        "action_priority": ~F.col("action_priority").isin("CRITICAL_DISPATCH", "DEPLOY_SCOUT", "MONITOR", "SUPPRESSED"),
        "responder_state": ~F.col("responder_state").isin(C.RESPONDER_ORDER),
    }
    counts = incidents.agg(*[F.count_if(F.coalesce(v, F.lit(True))).alias(k) for k, v in rules.items()])
    return counts.unpivot([], list(rules), "rule", "violations")


def responder_transition(commands: DataFrame, incidents: DataFrame) -> DataFrame:
    """Outcome of each command (command_id, incident_id, state, ts): accepted, no_op, conflict, unknown_state or not_found.

    A state is only ever raised, so the state before a command is the highest known one so
    far: a running maximum by incident. Skipping forward is allowed.
    """
    order = F.array(*map(F.lit, C.RESPONDER_ORDER))
    rank = F.nullif(F.array_position(order, F.col("state")), F.lit(0))
    have = incidents.select(F.col("id").alias("incident_id"), F.array_position(order, F.coalesce("responder_state", F.lit(C.RESPONDER_ORDER[0]))).alias("base"))
    met = commands.withColumn("rank", rank).join(have, "incident_id", "left")
    before = W.partitionBy("incident_id").orderBy("ts", "command_id").rowsBetween(W.unboundedPreceding, -1)
    met = met.withColumn("current", F.greatest("base", F.coalesce(F.max("rank").over(before), F.lit(1))))
    outcome = F.when(F.col("rank").isNull(), "unknown_state").when(F.col("base").isNull(), "not_found").when(F.col("rank") < F.col("current"), "conflict").when(F.col("rank") == F.col("current"), "no_op").otherwise("accepted")
    event = F.when(outcome == "accepted", F.concat(F.lit(f"{C.RESPONDER_PREFIX} state changed to "), F.col("state")))
    return met.select("command_id", "incident_id", "state", "ts", outcome.alias("outcome"), event.alias("event"))
