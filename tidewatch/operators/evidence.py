"""What the reports of a cluster prove together, and the incident that follows from them.

``members`` is a row for each report of a cluster: cluster_id, event_type, id, ts,
source_user, raw_text, phash, lat, lon, and ``facts``. Member order is (ts, id). A cluster may
hold any share of all reports, so everything is counted by partial aggregation; lists of ids
are gathered only where they are the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch import constants as C
from tidewatch.functions import geo, scoring, text
from tidewatch.operators import neardup
from tidewatch.operators.components import connected_components
from tidewatch.operators.extraction import failed_analysis
from tidewatch.sources.storage import stored

_POS = F.struct


def report_identities(reports: DataFrame) -> DataFrame:
    """id, identity: the author and, for a repost, the origin it names."""
    who = F.array_distinct(F.filter(F.array(text.author(F.col("source_user")), text.repost_origin(F.col("raw_text"))), lambda x: x.isNotNull()))
    return reports.select("id", F.explode(who).alias("identity"))


def independent_sources(members: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """cluster_id, independent_sources: witnesses joined by identities or near-duplicate images (``image_groups``, if there).

    The graph is of identities and image groups, not of reports: a report links the two or
    three it has, so an author with a third of all reports is one node.
    """
    who = F.filter(F.array(text.author(F.col("source_user")), text.repost_origin(F.col("raw_text"))), lambda x: x.isNotNull())
    images = (images if images is not None else neardup.image_groups(members)).withColumnRenamed("root", "image")
    # Rules run on what differs: copies of one author's text and image are one row before, not after them.
    said = members.select("cluster_id", "source_user", "raw_text", "phash").distinct()
    marked = said.select("cluster_id", F.transform(who, lambda w: F.concat_ws("|", F.col("cluster_id"), F.lit("u"), w)).alias("who"), F.when(neardup.valid_hash(F.col("phash")), F.lower("phash")).alias("phash"))
    keyed = marked.distinct().join(images, ["cluster_id", "phash"], "left").select("cluster_id", F.array_distinct(F.concat("who", F.filter(F.array(F.concat(F.lit("i|"), F.col("image"))), lambda x: x.isNotNull()))).alias("keys"))
    keyed = stored(keyed.distinct(), "witness-keys")
    edges = keyed.select(F.col("keys")[0].alias("a"), F.explode("keys").alias("b")).filter("a <> b")
    roots = connected_components(edges)
    nodes = keyed.select("cluster_id", F.col("keys")[0].alias("node")).distinct().join(roots, "node", "left")
    return nodes.groupBy("cluster_id").agg(F.count_distinct(F.coalesce("root", "node")).alias("independent_sources"))


def recycled(members: DataFrame, known: DataFrame) -> DataFrame:
    """phash, is_old: the images of members that are known from before; stored."""
    return stored(neardup.recycled_media(members, known).select("phash", F.lit(True).alias("is_old")), "recycled")


def corroboration_counts(members: DataFrame, known: DataFrame, old: DataFrame | None = None) -> DataFrame:
    """cluster_id, total_reports, independent_sources, unique_images, recycled_media_detected, duplicate_image_groups.

    Media without a hash counts for nothing; recycled counts reports, not images.
    """
    old = recycled(members, known) if old is None else old
    images = stored(neardup.image_groups(members), "image-groups")
    flagged = members.withColumn("phash", F.lower("phash")).join(old, "phash", "left")
    totals = flagged.groupBy("cluster_id").agg(F.count("*").alias("total_reports"), F.count_if(F.col("is_old")).alias("recycled_media_detected"))
    out = totals.join(independent_sources(members, images), "cluster_id").join(neardup.duplicate_image_groups(members, images), "cluster_id", "left")
    return out.fillna(0, ["unique_images", "duplicate_image_groups"])


def denial_flags(members: DataFrame) -> DataFrame:
    """cluster_id, has_contradiction, rumour_count."""
    # Copies of a text are counted before the rules run.
    texts = members.groupBy("cluster_id", "raw_text").agg(F.count("*").alias("n"))
    denies, rumour = text.found(F.col("raw_text"), C.DENIAL), text.found(F.col("raw_text"), C.RUMOUR)
    return texts.groupBy("cluster_id").agg((F.bool_or(denies) & (F.sum("n") >= 2)).alias("has_contradiction"), F.sum(F.when(rumour, F.col("n")).otherwise(0)).alias("rumour_count"))


def contradiction_groups(members: DataFrame) -> DataFrame:
    """cluster_id, landmark, event_type, affirming_report_ids, denying_report_ids: landmarks with both sides."""
    denies = text.found(F.col("raw_text"), C.DENIAL)
    sides = members.select("cluster_id", F.col("facts.landmark").alias("landmark"), F.col("facts.disaster_type").alias("type"), "ts", "id", denies.alias("denies"))
    grouped = sides.groupBy("cluster_id", "landmark").agg(
        F.min_by("type", _POS("ts", "id")).alias("event_type"),
        F.array_sort(F.collect_list(F.when(~F.col("denies"), F.col("id")))).alias("affirming_report_ids"),
        F.array_sort(F.collect_list(F.when(F.col("denies"), F.col("id")))).alias("denying_report_ids"),
    )
    return grouped.filter((F.size("affirming_report_ids") > 0) & (F.size("denying_report_ids") > 0))


def image_analysis_join(media: DataFrame, analyses: DataFrame) -> DataFrame:
    """Add ``analysis`` by phash: one analysis for each image; a missing one is not analysed.

    The first stored one counts, by ``stored_at`` where there is such a column; what is left open falls to the smaller
    phash as written and then to the smaller analysis as JSON, so every run takes the same.
    """
    order = [F.col(c) for c in ("stored_at",) if c in analyses.columns] + [F.col("phash"), F.to_json("analysis")]
    once = analyses.groupBy(F.lower("phash").alias("phash")).agg(F.min_by("analysis", F.struct(*order)).alias("analysis"))
    met = media.withColumn("phash", F.lower("phash")).join(once, "phash", "left")
    return met.withColumn("analysis", F.when(F.col("phash").isNotNull(), F.coalesce("analysis", failed_analysis("no vision provider configured"))))


def image_evidence(members: DataFrame, known: DataFrame, old: DataFrame | None = None) -> DataFrame:
    """cluster_id, mismatches, analyzed_unique, n_analyses, image_analyses from members with ``analysis``.

    Each image counts once, by its first member; a recycled one is no mismatch. image_analyses
    are the analyses themselves, with the report they are of and their phash, in order of reports.
    """
    old = recycled(members, known) if old is None else old
    shown = members.filter(F.col("analysis").isNotNull()).withColumn("phash", F.lower("phash"))
    first = F.min_by(F.struct("id", "phash", "analysis"), _POS("ts", "id"))
    once = shown.groupBy("cluster_id", F.coalesce("phash", "id").alias("image")).agg(first.alias("m"), F.min(_POS("ts", "id")).alias("pos")).select("cluster_id", "m.*", "pos")
    met = once.join(old, "phash", "left")
    against = F.col("analysis.analyzed") & F.col("is_old").isNull() & ~F.coalesce(F.col("analysis.supports_text_claim"), F.lit(True))
    listed = F.sort_array(F.collect_list(F.struct("pos", F.struct(F.col("id").alias("report_id"), "phash", "analysis").alias("a"))))
    return met.groupBy("cluster_id").agg(
        F.count_if(against).alias("mismatches"), F.count_if(F.col("analysis.analyzed")).alias("analyzed_unique"), F.count("*").alias("n_analyses"), F.transform(listed, lambda x: x["a"]).alias("image_analyses")
    )


def geo_agreement(members: DataFrame, clusters: DataFrame) -> DataFrame:
    """cluster_id, geo_agreement: mean closeness to the centre, 1 at it, 0 from 500 m."""
    met = members.select("cluster_id", "lat", "lon").join(clusters.select("cluster_id", "center_lat", "center_lon"), "cluster_id")
    d = geo.haversine_m(F.col("lat"), F.col("lon"), F.col("center_lat"), F.col("center_lon"))
    # Summed in millionths, so that the order of rows can't change the sum.
    near = F.bround(F.greatest(F.lit(0.0), 1 - d / C.GEO_AGREEMENT_SCALE_M) * 1_000_000, 0).cast("long")
    return met.groupBy("cluster_id").agg(F.bround(F.sum(near) / F.count("*") / 1_000_000, 4).alias("geo_agreement"))


def top_landmark(members: DataFrame) -> DataFrame:
    """cluster_id, landmark: the commonest, the one seen first on ties."""
    said = members.filter(F.coalesce(F.col("facts.landmark"), F.lit("")) != "").groupBy("cluster_id", F.col("facts.landmark").alias("landmark")).agg(F.count("*").alias("n"), F.min(_POS("ts", "id")).alias("first"))
    return said.groupBy("cluster_id").agg(F.min_by("landmark", _POS(-F.col("n"), F.col("first"))).alias("landmark"))


def external_verification(clusters: DataFrame, hits: DataFrame) -> DataFrame:
    """Add ``external_hits`` (0 to 3) from a feed's answers (event_type, landmark, hits); null: no answer."""
    answers = hits.filter("hits >= 0").groupBy("event_type", "landmark").agg(F.max("hits").alias("hits"))
    return clusters.join(answers, ["event_type", "landmark"], "left").withColumn("external_hits", F.when(F.col("hits").isNotNull(), F.least(F.col("hits"), F.lit(3))).cast("int")).drop("hits")


def victim_totals(members: DataFrame) -> DataFrame:
    """cluster_id, estimated_trapped_total (the largest count), confirmed_by_sources (reports that give one)."""
    n = F.col("facts.trapped_count")
    return members.groupBy("cluster_id").agg(F.coalesce(F.max(n), F.lit(0)).alias("estimated_trapped_total"), F.count(n).alias("confirmed_by_sources"))


def priority_resources(members: DataFrame) -> DataFrame:
    """cluster_id, priority_resources: urgent ones in their order, then by demand, then by name."""
    asked = members.select("cluster_id", F.explode("facts.resource_demands").alias("r")).select("cluster_id", F.lower(F.trim("r")).alias("r")).filter("r <> ''").groupBy("cluster_id", "r").agg(F.count("*").alias("n"))
    place = F.array_position(F.array(*map(F.lit, C.URGENT_ORDER)), F.col("r"))
    key = F.struct(F.when(place > 0, place).otherwise(len(C.URGENT_ORDER) + 1).alias("p"), (-F.col("n")).alias("n"), "r")
    return asked.groupBy("cluster_id").agg(F.transform(F.sort_array(F.collect_list(key)), lambda x: x["r"]).alias("priority_resources"))


def cluster_severity(members: DataFrame) -> DataFrame:
    f = F.col("facts")
    level = scoring.severity(f["disaster_type"], f["trapped_count"], f["access_impediment"], f["resource_demands"])
    return members.groupBy("cluster_id").agg(F.max(level).alias("severity"))


def title(event_type: Column, landmark: Column, trapped: Column) -> Column:
    label = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in C.HAZARD_LABELS.items() for x in p]), event_type), F.initcap(event_type))
    where = F.when(landmark.isNotNull(), F.concat(label, F.lit(" near "), landmark)).otherwise(F.concat(label, F.lit(" reported")))
    return F.when(trapped > 0, F.concat(where, F.lit(": "), trapped.cast("string"), F.lit(" people reported trapped"))).otherwise(where)


def isoformat(ts: Column) -> Column:
    """UTC time as ISO 8601 with offset; microseconds only if there are any."""
    return F.concat(F.when(F.unix_micros(ts) % 1_000_000 == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")), F.lit("+00:00"))


def report_times(members: DataFrame) -> DataFrame:
    """cluster_id, first_ts, third_ts (null if fewer than 3), last_ts, without gathering all times."""
    times = members.groupBy("cluster_id").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"))
    counts = members.groupBy("cluster_id", "ts").agg(F.count("*").alias("n"))
    from pyspark.sql import Window as W

    before = F.sum("n").over(W.partitionBy("cluster_id").orderBy("ts"))
    third = counts.withColumn("upto", before).filter(F.col("upto") >= C.CORROBORATION_MIN_SOURCES).groupBy("cluster_id").agg(F.min("ts").alias("third_ts"))
    return times.join(third, "cluster_id", "left").drop("n")


def derived_timeline(first: Column, third: Column, last: Column, sources: Column, total: Column, contradiction: Column, recycled: Column, priority: Column) -> Column:
    """Entries (time, event) that follow from the evidence, in order of telling."""
    say = lambda *p: F.concat(*[x.cast("string") if isinstance(x, Column) else F.lit(x) for x in p])
    entry = lambda ts, event: F.struct(isoformat(ts).alias("time"), event.alias("event"))
    entries = [
        entry(first, F.lit("First citizen report received")),
        F.when(third.isNotNull(), entry(third, say(sources, " independent sources; ", total, " reports linked"))),
        F.when(contradiction, entry(last, F.lit("Conflicting report detected in cluster"))),
        F.when(recycled > 0, entry(last, say(recycled, " reports carry recycled media"))),
        entry(last, say("Action priority set to ", priority)),
    ]
    return F.filter(F.array(*entries), lambda e: e.isNotNull())


def limitations(hits: Column, n_analyses: Column, n_failed: Column) -> Column:
    notes = [
        F.lit(C.NOTE_SOURCES),
        F.when(hits.isNull(), C.NOTE_EXTERNAL),
        F.when(n_analyses == 0, C.NOTE_NO_IMAGES).when(n_failed > 0, C.NOTE_SOME_IMAGES),
    ]
    return F.filter(F.array(*notes), lambda n: n.isNotNull())


def build_evidence(members: DataFrame, clusters: DataFrame, known: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """clusters (cluster_id, event_type, center_lat, center_lon) with ``evidence`` and the columns it is made of."""
    if "analysis" not in members.columns:
        members = members.withColumn("analysis", F.lit(None).cast(failed_schema()))
    old = recycled(members, known)
    parts = clusters.join(corroboration_counts(members, known, old), "cluster_id").join(denial_flags(members), "cluster_id").join(geo_agreement(members, clusters), "cluster_id")
    parts = parts.join(image_evidence(members, known, old), "cluster_id", "left").join(top_landmark(members), "cluster_id", "left")
    texts = neardup.group_duplicate_texts(members).groupBy("cluster_id").agg(F.count_if(F.col("n") > 1).alias("duplicate_text_groups"))
    sides = contradiction_groups(members).groupBy("cluster_id").agg(
        F.sort_array(F.collect_list(F.struct("event_type", "landmark", "affirming_report_ids", "denying_report_ids"))).alias("contradiction_groups")
    )
    parts = parts.join(texts, "cluster_id", "left").join(sides, "cluster_id", "left").fillna(0, ["mismatches", "analyzed_unique", "n_analyses", "duplicate_text_groups"])
    parts = external_verification(parts, hits) if hits is not None else parts.withColumn("external_hits", F.lit(None).cast("int"))
    c = F.col
    none = F.array().cast("array<struct<event_type:string,landmark:string,affirming_report_ids:array<string>,denying_report_ids:array<string>>>")
    parts = parts.withColumn("contradiction_groups", F.coalesce("contradiction_groups", none)).withColumn("fresh_media_ratio", scoring.fresh_media_ratio(c("unique_images"), c("recycled_media_detected"), c("mismatches")))
    signals = (c("independent_sources"), c("geo_agreement"), c("fresh_media_ratio"), c("external_hits"), c("has_contradiction"))
    risk = scoring.misinformation_risk(
        c("has_contradiction"), F.size("contradiction_groups"), c("recycled_media_detected"), c("total_reports"), c("mismatches"), c("duplicate_text_groups"), c("independent_sources"), c("geo_agreement"), c("rumour_count")
    )
    evidence = F.struct(
        "total_reports", "independent_sources", "unique_images", "recycled_media_detected", "geo_agreement", "fresh_media_ratio",
        c("external_hits").alias("external_verification_hits"), "has_contradiction", "duplicate_image_groups", "duplicate_text_groups", "contradiction_groups",
        F.coalesce("image_analyses", F.array().cast(parts.schema["image_analyses"].dataType)).alias("image_analyses"), risk.alias("misinformation"), scoring.confidence_breakdown(*signals).alias("confidence_breakdown"),
        limitations(c("external_hits"), c("n_analyses"), c("n_analyses") - c("analyzed_unique")).alias("limitations"),
    )
    return parts.withColumn("evidence", evidence).withColumn("confidence", scoring.confidence(*signals))


def failed_schema() -> str:
    from tidewatch.operators.extraction import ANALYSIS

    return ANALYSIS


def score_cluster(members: DataFrame, clusters: DataFrame, known: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """All derived fields of the incident of each cluster."""
    clusters = clusters.select("cluster_id", "event_type", "center_lat", "center_lon", "uncertainty_radius_m")
    parts = build_evidence(members, clusters, known, hits).join(cluster_severity(members), "cluster_id").join(victim_totals(members), "cluster_id")
    parts = parts.join(priority_resources(members), "cluster_id", "left").join(report_times(members), "cluster_id")
    c = F.col
    parts = parts.withColumn("action_priority", scoring.action_priority(c("confidence"), c("severity")))
    needs = F.struct("estimated_trapped_total", "confirmed_by_sources", F.coalesce("priority_resources", F.array().cast("array<string>")).alias("priority_resources"))
    return parts.select(
        "cluster_id", "event_type", title(c("event_type"), c("landmark"), c("estimated_trapped_total")).alias("title"), "center_lat", "center_lon", "uncertainty_radius_m",
        F.bround("severity", 2).alias("severity_score"), F.bround("confidence", 2).alias("confidence_score"),
        scoring.verification_status(c("has_contradiction"), c("independent_sources"), c("confidence")).alias("verification_status"), "action_priority",
        "evidence", needs.alias("aggregated_needs"),
        derived_timeline(c("first_ts"), c("third_ts"), c("last_ts"), c("independent_sources"), c("total_reports"), c("has_contradiction"), c("recycled_media_detected"), c("action_priority")).alias("timeline"),
    )
