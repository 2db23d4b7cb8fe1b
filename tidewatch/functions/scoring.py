"""Scores, risk and their explanations as native column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch import constants as C


def number(x: Column) -> Column:
    """Null, NaN and infinite signals count as zero."""
    x = x.cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def source_score(independent_sources: Column) -> Column:
    """Through (0, 0), (1, 25), (3, 60), (5, 100)."""
    n = clamp(number(independent_sources), 0.0, 5.0)
    return F.when(n <= 1, 25.0 * n).when(n <= 3, 25.0 + (n - 1.0) * 17.5).otherwise(60.0 + (n - 3.0) * 20.0)


def _parts(sources: Column, geo: Column, media: Column, hits: Column, contradiction: Column):
    return (
        source_score(sources),
        100.0 * clamp(number(geo), 0.0, 1.0),
        100.0 * clamp(number(media), 0.0, 1.0),
        100.0 * clamp(number(hits), 0.0, 3.0) / 3.0,
        F.when(F.coalesce(contradiction, F.lit(False)), C.CONTRADICTION_PENALTY).otherwise(0.0),
    )


def confidence(sources: Column, geo: Column, media: Column, hits: Column, contradiction: Column) -> Column:
    s, g, m, e, penalty = _parts(sources, geo, media, hits, contradiction)
    return clamp(0.30 * s + 0.25 * g + 0.20 * m + 0.25 * e - penalty, 0.0, 100.0)


def confidence_breakdown(sources: Column, geo: Column, media: Column, hits: Column, contradiction: Column) -> Column:
    s, g, m, e, penalty = _parts(sources, geo, media, hits, contradiction)
    return F.struct(
        F.bround(s, 2).alias("source_score"),
        F.bround(g, 2).alias("geo_score"),
        F.bround(m, 2).alias("media_score"),
        F.bround(e, 2).alias("external_score"),
        F.bround(penalty, 2).alias("contradiction_penalty"),
        F.lit(0.0).alias("misinformation_penalty"),
        F.bround(confidence(sources, geo, media, hits, contradiction), 2).alias("final_confidence"),
    )


def severity(disaster_type: Column, trapped: Column, access: Column, resources: Column) -> Column:
    """1 to 10 from one report's facts."""
    kind = F.upper(F.trim(F.coalesce(disaster_type, F.lit(""))))
    hazard = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in C.HAZARD_WEIGHTS.items() for x in p]), kind), F.lit(0.0))
    people = F.greatest(F.lit(0.0), number(trapped))
    names = F.array_distinct(F.transform(F.filter(F.coalesce(resources, F.array().cast("array<string>")), lambda r: F.trim(r) != ""), lambda r: F.lower(F.trim(r))))
    supplies = F.aggregate(names, F.lit(0.0), lambda a, r: a + F.when(r.isin(C.URGENT_FOR_SEVERITY), 1.0).otherwise(0.25))
    score = 1.0 + hazard + F.when(people > 0, 2.0 + F.least(F.lit(2.0), 0.2 * people)).otherwise(0.0)
    score = score + F.when(F.coalesce(access, F.lit(False)), 2.0).otherwise(0.0) + F.least(F.lit(2.0), supplies)
    return clamp(score, 1.0, 10.0)


def action_priority(conf: Column, sev: Column) -> Column:
    """The 2 x 2 of severity and confidence; scores out of range raise."""
    ok = conf.between(0.0, 100.0) & sev.between(1.0, 10.0) & ~F.isnan(conf) & ~F.isnan(sev)
    sure = conf >= C.PRIORITY_CONFIDENCE
    return (
        F.when(~F.coalesce(ok, F.lit(False)), F.raise_error(F.lit("confidence or severity out of range")).cast("string"))
        .when(sev >= C.PRIORITY_SEVERITY, F.when(sure, "CRITICAL_DISPATCH").otherwise("DEPLOY_SCOUT"))
        .otherwise(F.when(sure, "MONITOR").otherwise("SUPPRESSED"))
    )


def verification_status(contradiction: Column, sources: Column, conf: Column) -> Column:
    sure = (sources >= C.CORROBORATION_MIN_SOURCES) & (conf >= C.CORROBORATION_MIN_CONFIDENCE)
    return F.when(contradiction, "CONTRADICTED").when(sure, "CORROBORATED").otherwise("DEVELOPING")


def fresh_media_ratio(unique_images: Column, recycled: Column, mismatches: Column) -> Column:
    fresh = F.greatest(F.lit(0), unique_images - recycled - mismatches)
    return F.when(unique_images > 0, F.bround(fresh / F.nullif(unique_images, F.lit(0)), 4)).otherwise(0.0)


def percent(x: Column) -> Column:
    return F.concat(F.bround(x * 100, 0).cast("long").cast("string"), F.lit("%"))


def misinformation_risk(
    contradiction: Column, contradiction_groups: Column, recycled: Column, total: Column, mismatches: Column,
    duplicate_groups: Column, sources: Column, geo: Column, rumours: Column,
) -> Column:
    """Weighted signals, level and texts. Never says that a claim is false."""
    say = lambda *parts: F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])
    signals = [
        ("contradiction", contradiction | (contradiction_groups > 0), say(F.greatest(contradiction_groups, F.lit(1)), " contradicting claim group(s) detected")),
        ("recycled_media", (recycled > 0) & (total > 0), say(recycled, " report(s) carry recycled/old media")),
        ("image_text_mismatch", mismatches > 0, say(mismatches, " image(s) appear to conflict with their own report text")),
        ("duplicate_concentration", (total > 0) & (duplicate_groups > 0) & (duplicate_groups * 2 <= total), say(total, " reports concentrate into only ", duplicate_groups, " distinct text origin(s)")),
        ("low_independent_ratio", (total >= 3) & (sources > 0) & (sources / F.nullif(total, F.lit(0)) < 0.4), say("independent sources (", sources, ") are a small share of total reports (", total, ")")),
        ("weak_geo_agreement", geo < 0.4, say("weak geographic agreement (", percent(geo), ")")),
        ("labeled_rumour", rumours > 0, say(rumours, " report(s) explicitly label another claim as rumour/unverified")),
    ]
    score = F.lit(0.0)
    for name, fired, _ in signals:
        score = score + F.when(F.coalesce(fired, F.lit(False)), C.RISK_WEIGHTS[name]).otherwise(0.0)
    score = clamp(score, 0.0, 1.0)
    texts = F.filter(F.array(*[F.when(fired, text) for _, fired, text in signals]), lambda t: t.isNotNull())
    level = F.when(score >= C.RISK_HIGH, "HIGH").when(score >= C.RISK_MEDIUM, "MEDIUM").otherwise("LOW")
    assessment = F.when(F.size(texts) == 0, C.ASSESSMENT_NONE).otherwise(
        F.concat(F.initcap(level), F.lit(" misinformation risk from "), F.size(texts).cast("string"), F.lit(" signal(s): "), F.array_join(texts, "; "), F.lit(C.ASSESSMENT_TAIL))
    )
    return F.struct(
        F.bround(score, 4).alias("risk_score"), level.alias("risk_level"), texts.alias("signals"), contradiction_groups.alias("contradiction_groups"),
        mismatches.alias("image_text_mismatches"), recycled.alias("recycled_media_reports"), duplicate_groups.alias("duplicate_claim_groups"),
        assessment.alias("assessment"), F.lit(False).alias("proven_false"),
    )
