"""Facts from report texts, and strict validation of facts and analyses made elsewhere."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch import constants as C
from tidewatch.functions import scoring, text
from tidewatch.sources.storage import stored

FACTS = (
    "struct<relevant:boolean,disaster_type:string,claim:string,landmark:string,trapped_count:int,"
    "resource_demands:array<string>,access_impediment:boolean,severity:int,event_time_hint:string>"
)
ANALYSIS = (
    "struct<analyzed:boolean,contains_disaster_evidence:boolean,disaster_type:string,visible_damage:array<string>,"
    "visible_people_at_risk:boolean,access_blocked:boolean,severity:int,supports_text_claim:boolean,concerns:array<string>,"
    "confidence:double,provider:string>"
)
NO_ANALYSIS = "image analysis failed; result unavailable"

# Types a field may have in strict JSON.
_KINDS = {
    "boolean": ["BOOLEAN"], "string": ["STRING"], "int": ["BIGINT"], "double": ["BIGINT", "DOUBLE", "DECIMAL"], "list": ["ARRAY<STRING>", "ARRAY<VOID>"],
}
# (kind, may be null) of each field; those of the facts are all required.
_FACT_FIELDS = {
    "relevant": ("boolean", False), "disaster_type": ("string", True), "claim": ("string", True), "landmark": ("string", True), "trapped_count": ("int", True),
    "resource_demands": ("list", False), "access_impediment": ("boolean", False), "severity": ("int", True), "event_time_hint": ("string", True),
}
_ANALYSIS_FIELDS = {
    "analyzed": ("boolean", False), "contains_disaster_evidence": ("boolean", True), "disaster_type": ("string", True), "visible_damage": ("list", False),
    "visible_people_at_risk": ("boolean", True), "access_blocked": ("boolean", True), "severity": ("int", True), "supports_text_claim": ("boolean", True),
    "concerns": ("list", False), "confidence": ("double", True), "provider": ("string", False),
}


def empty_facts() -> Column:
    """Facts of a report that says nothing: irrelevant, everything cleared."""
    fields = "false AS relevant, CAST(null AS string) AS disaster_type, CAST(null AS string) AS claim, CAST(null AS string) AS landmark, CAST(null AS int) AS trapped_count"
    return F.expr(f"struct({fields}, CAST(array() AS array<string>) AS resource_demands, false AS access_impediment, CAST(null AS int) AS severity, CAST(null AS string) AS event_time_hint)")


def extract_facts(reports: DataFrame) -> DataFrame:
    """Add ``facts`` from ``raw_text`` by keyword rules: one projection of native expressions."""
    claim = text.strip(text.strip_repost_prefix(F.coalesce(F.col("raw_text"), F.lit(""))))
    staged = reports.withColumn("tw_claim", claim).withColumns({
        "tw_hazard": text.detect_hazard(F.col("tw_claim")),
        "tw_trapped": text.detect_trapped(F.col("tw_claim")),
        "tw_needs": text.detect_resources(F.col("tw_claim")),
        "tw_access": text.detect_access(F.col("tw_claim")),
    })
    level = scoring.severity(F.col("tw_hazard"), F.col("tw_trapped"), F.col("tw_access"), F.col("tw_needs"))
    facts = F.struct(
        F.lit(True).alias("relevant"),
        F.col("tw_hazard").alias("disaster_type"),
        F.col("tw_claim").alias("claim"),
        text.detect_landmark(F.col("tw_claim")).alias("landmark"),
        F.col("tw_trapped").alias("trapped_count"),
        F.col("tw_needs").alias("resource_demands"),
        F.col("tw_access").alias("access_impediment"),
        scoring.clamp(F.bround(level, 0), 1.0, 10.0).cast("int").alias("severity"),
        text.detect_time_hint(F.col("tw_claim")).alias("event_time_hint"),
    )
    relevant = ~text.is_noise(F.col("tw_claim")) & F.col("tw_hazard").isNotNull()
    done = staged.withColumn("facts", F.when(relevant, facts).otherwise(empty_facts()))
    return done.drop("tw_claim", "tw_hazard", "tw_trapped", "tw_needs", "tw_access")


def extract_by_text(reports: DataFrame) -> DataFrame:
    """``extract_facts`` where reports repeat texts, as reposts do: each distinct text is read once, and all its reports get what it says.

    The facts of texts are stored, so whatever reads the result twice does not run the rules again. A null text says what an empty
    one does.
    """
    said = F.coalesce(F.col("raw_text"), F.lit(""))
    # A number of its own: by bytes alone few tasks would get all the work.
    parts = int(reports.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = reports.select(said.alias("raw_text")).distinct().repartition(parts)
    facts = stored(extract_facts(texts).select(F.col("raw_text").alias("tw_text"), "facts"), "text-facts")
    return reports.join(facts, said == F.col("tw_text")).drop("tw_text")


def _strict(json: Column, fields: dict[str, tuple[str, bool]], required: list[str]) -> Column:
    """Whether a JSON text is an object of just these fields with just these types."""
    value = F.try_parse_json(json)
    keys = F.json_object_keys(json)
    known = (F.size(F.array_except(keys, F.array(*map(F.lit, fields)))) == 0) & (F.size(F.array_distinct(keys)) == F.size(keys))
    every = F.size(F.array_except(F.array(*map(F.lit, required)), keys)) == 0 if required else F.lit(True)
    valid = value.isNotNull() & keys.isNotNull() & known & every
    for name, (kind, nullable) in fields.items():
        said = F.schema_of_variant(F.try_variant_get(value, f"$.{name}", "variant"))
        allowed = [*_KINDS[kind], *(["VOID"] if nullable else [])]
        right = F.regexp_replace(said, r"^DECIMAL.*", "DECIMAL").isin(allowed)
        valid = valid & F.coalesce(right | ~F.array_contains(keys, name), F.lit(False))
    return F.coalesce(valid, F.lit(False))


def validate_extraction(reports: DataFrame, json: Column) -> DataFrame:
    """Add ``facts`` from a model's JSON, and ``extraction_failed`` where it had to be replaced.

    Strict: no other keys, none missing, no type turned into another. What breaks a rule,
    and a blank or missing text, gives empty facts; an irrelevant report's facts are cleared.
    """
    given = F.from_json(json, FACTS)
    rules = (
        (given["trapped_count"].isNull() | (given["trapped_count"] >= 0))
        & (given["severity"].isNull() | given["severity"].between(1, 10))
        & (given["disaster_type"].isNull() | given["disaster_type"].isin(C.HAZARDS))
        & (~given["relevant"] | (given["disaster_type"].isNotNull() & (F.trim(F.coalesce(given["claim"], F.lit(""))) != "") & given["severity"].isNotNull()))
    )
    valid = _strict(json, _FACT_FIELDS, list(_FACT_FIELDS)) & F.coalesce(rules, F.lit(False))
    return reports.withColumn("tw_ok", valid).withColumns({
        "facts": F.when(F.col("tw_ok") & given["relevant"], given).otherwise(empty_facts()),
        "extraction_failed": ~F.col("tw_ok"),
    }).drop("tw_ok")


def failed_analysis(concern: str = NO_ANALYSIS) -> Column:
    return F.from_json(F.lit('{"analyzed":false,"visible_damage":[],"concerns":["%s"],"provider":"unavailable"}' % concern), ANALYSIS)


def validate_image_analysis(images: DataFrame, json: Column) -> DataFrame:
    """Add ``analysis`` from a model's JSON on an image; what breaks a rule is not analysed."""
    given = F.from_json(json, ANALYSIS)
    none = F.array().cast("array<string>")
    filled = given.withField("visible_damage", F.coalesce(given["visible_damage"], none)).withField("concerns", F.coalesce(given["concerns"], none)).withField("provider", F.coalesce(given["provider"], F.lit("unavailable")))
    rules = (
        (given["severity"].isNull() | given["severity"].between(1, 10))
        & (given["confidence"].isNull() | given["confidence"].between(0.0, 100.0))
        & (given["disaster_type"].isNull() | given["disaster_type"].isin(C.HAZARDS))
    )
    valid = _strict(json, _ANALYSIS_FIELDS, ["analyzed"]) & F.coalesce(rules, F.lit(False))
    return images.withColumn("analysis", F.when(valid, filled).otherwise(failed_analysis()))


def fact_access(json: Column, key: str, flat: Column) -> Column:
    """A fact from the nested JSON if the key is there, also as null, else from the flat column."""
    return F.when(F.array_contains(F.coalesce(F.json_object_keys(json), F.array().cast("array<string>")), key), F.get_json_object(json, f"$.{key}")).otherwise(flat)


def extract_missing(reports: DataFrame, extractor: Callable[[DataFrame], DataFrame] = extract_facts) -> DataFrame:
    """Keep stored ``facts`` that say whether the report is relevant; extract only the others."""
    has = F.coalesce(F.col("facts.relevant").isNotNull(), F.lit(False))
    kept = reports.filter(has).withColumn("extracted_now", F.lit(False))
    fresh = extractor(reports.filter(~has).drop("facts")).withColumn("extracted_now", F.lit(True))
    return kept.unionByName(fresh.select(*kept.columns))


def relevant_reports(reports: DataFrame) -> DataFrame:
    return reports.filter(F.col("facts.relevant"))
