"""Registered queries over the incident rules, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch import constants as C
from tidewatch.functions import display, geo, scoring, text
from tidewatch.operators import clustering, evidence, extraction, geolocation, incidents, neardup, reads
from tidewatch.operators.components import connected_components
from tidewatch.plans import fixtures as X
from tidewatch.sources import reports as intake
from tidewatch.sources.storage import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, names: tuple[str, ...] = (), recursive: bool = False):
    """Register a function under its name, with the SQL that must give the same rows."""

    def register(fn):
        if fn.__name__ in QUERIES:
            raise ValueError(f"a query named {fn.__name__} is registered already")
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = X.sql(list(names), sql, recursive)
        return fn

    return register


def us(column: str, name: str | None = None):
    return F.unix_micros(column).alias(name or column)


# ------------------------------------------------------------ intake


@query("""
SELECT made, CASE WHEN made THEN NULL ELSE id END AS id, source_user, ts FROM (
  SELECT *, row_number() OVER (PARTITION BY made, id ORDER BY event_id) AS n FROM (
    SELECT event_id % 13 = 0 AS made, CASE WHEN event_id % 13 = 0 THEN CAST(event_id AS VARCHAR) WHEN event_id % 10 = 9 THEN 'rep_' || lpad(CAST(event_id - 1 AS VARCHAR), 8, '0') ELSE id END AS id,
      CASE WHEN event_id % 13 = 0 THEN 'same' ELSE source_user END AS source_user, CASE WHEN event_id % 13 = 0 THEN 0 ELSE epoch_us(ts) END AS ts, event_id FROM reports))
WHERE n = 1 AND (made OR id NOT IN (SELECT id FROM reports WHERE event_id % 3 = 0))
""", ("reports",))  # fmt: skip
def load_reports(spark, d):
    """Every 13th report comes without an id and all these are alike; every 10th repeats the id before it."""
    base, k = X.reports(spark, d), F.col("event_id")
    alike = k % 13 == 0
    doubled = F.when(alike, None).when(k % 10 == 9, F.concat(F.lit("rep_"), F.lpad((k - 1).cast("string"), 8, "0"))).otherwise(F.col("id"))
    same = {"source_user": "same", "raw_text": "the same text", "media_url": None, "gps_lat": None, "gps_lon": None}
    incoming = base.withColumns({"id": doubled, "timestamp": F.when(alike, "1970-01-01T00:00:00").otherwise(F.col("ts").cast("string"))} | {c: F.when(alike, v).otherwise(F.col(c)) for c, v in same.items()})
    out = intake.load_reports(incoming, base.filter("event_id % 3 = 0"), F.lit("2026-01-01").cast("timestamp"), k)
    made = F.col("id").rlike("^rep_[0-9a-f]{32}$")
    return out.select(made.alias("made"), F.when(~made, F.col("id")).alias("id"), "source_user", us("ts"))


@query("""
WITH m AS (SELECT id, CASE WHEN event_id % 7 = 0 THEN '  ' ELSE source_user END AS u, CASE WHEN event_id % 11 = 0 THEN '' ELSE raw_text END AS t, gps_lat + CASE WHEN event_id % 13 = 0 THEN 100 ELSE 0 END AS a, gps_lon * CASE WHEN event_id % 17 = 0 THEN -3 ELSE 1 END AS o FROM reports)
SELECT id, array_to_string(list_filter([CASE WHEN trim(u) = '' THEN 'source_user' END, CASE WHEN trim(t) = '' THEN 'raw_text' END, CASE WHEN abs(a) > 90 THEN 'gps_lat' END, CASE WHEN abs(o) > 180 THEN 'gps_lon' END], lambda r: r IS NOT NULL), ',') AS reasons FROM m
""", ("reports",))  # fmt: skip
def validate_reports(spark, d):
    k = F.col("event_id")
    changed = X.reports(spark, d).withColumns({
        "source_user": F.when(k % 7 == 0, "  ").otherwise(F.col("source_user")), "raw_text": F.when(k % 11 == 0, "").otherwise(F.col("raw_text")),
        "gps_lat": F.col("gps_lat") + F.when(k % 13 == 0, 100).otherwise(0), "gps_lon": F.col("gps_lon") * F.when(k % 17 == 0, -3).otherwise(1),
    })
    return intake.validate_reports(changed).select("id", F.array_join("reasons", ",").alias("reasons"))


@query("""
WITH p AS (SELECT 'p' || CAST(CASE WHEN event_id % 10 = 9 THEN event_id - 1 ELSE event_id END AS VARCHAR) AS id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE source_user END AS author, CASE WHEN event_id % 13 = 0 THEN '' ELSE raw_text END AS title, '' AS selftext, epoch_us(ts) AS made, event_id,
  CASE WHEN event_id % 4 = 0 THEN media_url ELSE 'https://x.example/' || reports.id END AS url, CASE WHEN event_id % 6 = 0 THEN 'https://p.example/' || reports.id || '.png' END AS preview FROM reports),
q AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY made DESC, title) AS n FROM p WHERE regexp_matches(lower(title), 'flood|collapsed|trapped') AND made >= (SELECT quantile_disc(epoch_us(ts), 0.25) FROM reports))
SELECT id, 'reddit_u_' || coalesce(author, 'reddit_deleted_user') AS source_user, trim(title) AS raw_text, CASE WHEN regexp_matches(url, '\\.(jpg|jpeg|png|webp)$') THEN url ELSE preview END AS media_url, made AS ts
FROM q WHERE n = 1 AND trim(title) <> '' AND id NOT IN (SELECT 'p' || CAST(event_id AS VARCHAR) FROM reports WHERE event_id % 8 = 0)
""".replace("\\\\", "\\"), ("reports",))  # fmt: skip
def social_posts_to_reports(spark, d):
    k, base = F.col("event_id"), X.reports(spark, d)
    posts = base.select(
        F.concat(F.lit("p"), F.when(k % 10 == 9, k - 1).otherwise(k).cast("string")).alias("id"), F.when(k % 11 != 0, F.col("source_user")).alias("author"), F.when(k % 13 == 0, "").otherwise(F.col("raw_text")).alias("title"), F.lit("").alias("selftext"),
        (F.unix_micros("ts") / 1_000_000).alias("created_utc"), F.when(k % 4 == 0, F.col("media_url")).otherwise(F.concat(F.lit("https://x.example/"), "id")).alias("url"),
        F.struct(F.when(k % 6 == 0, F.array(F.struct(F.struct(F.concat(F.lit("https://p.example/"), "id", F.lit(".png")).alias("url")).alias("source")))).alias("images")).alias("preview"),
    )
    since = base.agg(F.expr("percentile_disc(0.25) WITHIN GROUP (ORDER BY unix_micros(ts))").alias("s")).first()["s"] or 0
    seen = base.filter("event_id % 8 = 0").select(F.concat(F.lit("p"), k.cast("string")).alias("id"))
    return intake.social_posts_to_reports(posts, seen, ["flood", "collapsed", "trapped"], F.lit(since / 1_000_000)).withColumn("ts", F.unix_micros("ts"))


@query("SELECT DISTINCT id FROM reports WHERE event_id % 2 = 0 OR event_id % 3 = 0 ORDER BY id DESC LIMIT 5000", ("reports",))
def seen_ids_update(spark, d):
    base = X.reports(spark, d)
    return intake.seen_ids_update(base.filter("event_id % 2 = 0"), base.filter("event_id % 3 = 0"))


@query("""
SELECT id, CASE event_id % 4 WHEN 0 THEN epoch_us(date_trunc('second', ts)) WHEN 1 THEN epoch_us(date_trunc('second', ts)) WHEN 2 THEN epoch_us(date_trunc('second', ts)) - 19800000000 END AS utc FROM reports
""", ("reports",))  # fmt: skip
def normalize_timestamp(spark, d):
    k, iso = F.col("event_id") % 4, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    said = F.when(k == 0, iso).when(k == 1, F.concat(iso, F.lit("Z"))).when(k == 2, F.concat(iso, F.lit("+05:30"))).otherwise("soon")
    return X.reports(spark, d).select("id", F.unix_micros(intake.normalize_timestamp(said)).alias("utc"))


@query("SELECT DISTINCT 'archive_' || phash AS source, phash FROM reports WHERE phash IS NOT NULL", ("reports",))
def load_known_hashes(spark, d):
    """A registry of all images, written as JSON files of some thousand images each and loaded again."""
    from tidewatch.sources.storage import shared_dir, stored

    path = shared_dir(spark, "registry")
    shown = stored(X.reports(spark, d).filter("phash IS NOT NULL").select(F.concat(F.lit("archive_"), "phash").alias("source"), "phash").distinct(), "shown")
    part = F.pmod(F.xxhash64("source"), F.lit(shown.count() // 2000 + 1)).alias("part")
    rows = shown.groupBy(part).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("source", "phash")))).alias("value"))
    rows.write.partitionBy("part").text(path)  # a part is one row, so a file is one object
    return intake.load_known_hashes(spark, path)


@query("SELECT id, epoch_us(ts) AS ts, CAST(0 AS INTEGER) AS external_hits, false AS has_contradiction FROM reports", ("reports",))
def schema_evolve(spark, d):
    """Old rows without the later columns, read with their defaults."""
    old = X.reports(spark, d).select("id", "ts")
    return intake.schema_evolve(old, {"id": "string", "ts": "timestamp", "external_hits": "int", "has_contradiction": "boolean"}, {"external_hits": F.lit(0), "has_contradiction": F.lit(False)}).withColumn("ts", F.unix_micros("ts"))


# ------------------------------------------------------------ extraction


@query("SELECT id, claim FROM claims", ("claims",))
def strip_repost_prefix(spark, d):
    return X.reports(spark, d).select("id", text.strip(text.strip_repost_prefix(F.col("raw_text"))).alias("claim"))


@query("SELECT id, noise FROM found", ("found",))
def noise_filter(spark, d):
    return X.reports(spark, d).select("id", text.is_noise(text.strip(text.strip_repost_prefix(F.col("raw_text")))).alias("noise"))


def _claimed(spark, d, column, name):
    return X.reports(spark, d).withColumn("claim", text.strip(text.strip_repost_prefix(F.col("raw_text")))).select("id", column(F.col("claim")).alias(name))


@query("SELECT id, hazard FROM found", ("found",))
def detect_hazard(spark, d):
    return _claimed(spark, d, text.detect_hazard, "hazard")


@query("SELECT id, CAST(trapped AS INTEGER) AS trapped FROM found", ("found",))
def detect_trapped(spark, d):
    return _claimed(spark, d, text.detect_trapped, "trapped")


@query("SELECT id, landed AS landmark FROM landed", ("landed",))
def detect_landmark(spark, d):
    return _claimed(spark, d, text.detect_landmark, "landmark")


@query("SELECT id, array_to_string(needs, ',') AS resources FROM found", ("found",))
def detect_resources(spark, d):
    return _claimed(spark, d, lambda c: F.array_join(text.detect_resources(c), ","), "resources")


@query("SELECT id, access FROM found", ("found",))
def detect_access(spark, d):
    return _claimed(spark, d, text.detect_access, "access")


@query("SELECT id, hint FROM found", ("found",))
def detect_time_hint(spark, d):
    return _claimed(spark, d, text.detect_time_hint, "hint")


_FACTS_SQL = """SELECT id, relevant, disaster_type, claim, landmark, CAST(trapped_count AS INTEGER) AS trapped_count, array_to_string(resource_demands, ',') AS resources, access_impediment,
  CASE WHEN relevant THEN CAST(round_even(raw_severity, 0) AS INTEGER) END AS severity, event_time_hint FROM scored_facts"""


def _flat_facts(df):
    f = F.col("facts")
    return df.select("id", *[f[c].alias(c) for c in ("relevant", "disaster_type", "claim", "landmark", "trapped_count")], F.array_join(f["resource_demands"], ",").alias("resources"), *[f[c].alias(c) for c in ("access_impediment", "severity", "event_time_hint")])


@query(_FACTS_SQL, ("scored_facts",))
def extract_facts(spark, d):
    return _flat_facts(X.facts(spark, d))


@query("""
SELECT event_id, event_id % 10 NOT IN (0, 1, 5) AS failed, event_id % 10 IN (0, 5) AS relevant, CASE event_id % 10 WHEN 0 THEN 'FLOOD' WHEN 5 THEN 'FIRE' END AS disaster_type,
  CAST(CASE event_id % 10 WHEN 0 THEN event_id WHEN 5 THEN 0 END AS INTEGER) AS trapped_count, CAST(CASE event_id % 10 WHEN 0 THEN 4 WHEN 5 THEN 10 END AS INTEGER) AS severity,
  CASE event_id % 10 WHEN 0 THEN 'rope' WHEN 5 THEN 'boat,rope' ELSE '' END AS resources
FROM model_json
""", ("model_json",))  # fmt: skip
def validate_extraction(spark, d):
    done = extraction.validate_extraction(X.derived(spark, d, X.MODEL_JSON), F.col("json"))
    f = F.col("facts")
    return done.select("event_id", F.col("extraction_failed").alias("failed"), f["relevant"].alias("relevant"), f["disaster_type"].alias("disaster_type"), f["trapped_count"].alias("trapped_count"), f["severity"].alias("severity"), F.array_join(f["resource_demands"], ",").alias("resources"))


@query("""
SELECT event_id, event_id % 6 IN (0, 1) AS analyzed, CASE event_id % 6 WHEN 0 THEN true WHEN 1 THEN false END AS supports, CAST(CASE event_id % 6 WHEN 0 THEN 80.0 WHEN 1 THEN 55.5 END AS DOUBLE) AS confidence,
  CASE event_id % 6 WHEN 5 THEN 'blurred' WHEN 0 THEN '' WHEN 1 THEN '' ELSE 'image analysis failed; result unavailable' END AS concerns
FROM analysis_json
""", ("analysis_json",))  # fmt: skip
def validate_image_analysis(spark, d):
    done = extraction.validate_image_analysis(X.derived(spark, d, X.ANALYSIS_JSON), F.col("json"))
    a = F.col("analysis")
    return done.select("event_id", a["analyzed"].alias("analyzed"), a["supports_text_claim"].alias("supports"), a["confidence"].alias("confidence"), F.array_join(a["concerns"], ",").alias("concerns"))


@query("""
SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'FIRE' WHEN 1 THEN NULL ELSE 'flat' END AS kind FROM events
""")  # fmt: skip
def fact_access(spark, d):
    k = F.col("event_id") % 3
    json = F.when(k == 0, '{"disaster_type":"FIRE"}').when(k == 1, '{"disaster_type":null}').otherwise('{"other":1}')
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", extraction.fact_access(json, "disaster_type", F.lit("flat")).alias("kind"))


@query("""SELECT id, CASE WHEN event_id % 2 = 0 THEN false ELSE relevant END AS relevant, event_id % 2 = 1 AS extracted_now FROM facts""", ("facts",))
def extract_missing(spark, d):
    base = X.reports(spark, d).withColumn("facts", F.when(F.col("event_id") % 2 == 0, extraction.empty_facts()))
    return extraction.extract_missing(base).select("id", F.col("facts.relevant").alias("relevant"), "extracted_now")


@query("SELECT count(*) AS total, count(*) FILTER (WHERE relevant) AS relevant, count(*) FILTER (WHERE relevant AND gps_lat IS NOT NULL) AS with_gps, count(phash) AS hashed FROM facts", ("facts",))
def relevant_reports(spark, d):
    base = X.facts(spark, d)
    on = F.col("facts.relevant")
    return base.agg(F.count("*").alias("total"), F.count_if(on).alias("relevant"), F.count_if(on & F.col("gps_lat").isNotNull()).alias("with_gps"), F.count("phash").alias("hashed"))


@query("""
SELECT event_id, trim(CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN '[Flood] ' ELSE '[Flood] [Fire] ' END || CASE WHEN event_id % 4 > 0 THEN '[' || CAST(event_id % 4 AS VARCHAR) || ' people in danger] ' ELSE '' END || CASE WHEN event_id % 5 > 0 THEN 'water ' ELSE '' END || CASE WHEN event_id % 7 > 0 THEN 'Near pier.' ELSE '' END) AS raw_text FROM events
""")  # fmt: skip
def compose_report_text(spark, d):
    k = F.col("event_id")
    tags = F.when(k % 3 == 0, F.array().cast("array<string>")).when(k % 3 == 1, F.array(F.lit("Flood"))).otherwise(F.array(F.lit("Flood"), F.lit("Fire")))
    danger = F.when(k % 4 > 0, (k % 4).cast("string")).otherwise("None")
    out = text.compose_report_text(tags, danger, F.when(k % 5 > 0, " water ").otherwise("  "), F.when(k % 7 > 0, " pier ").otherwise(""))
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", out.alias("raw_text"))


# ------------------------------------------------------------ geolocation


@query(f"SELECT id, round({X.haversine('lat', 'lon', '20.0', '77.0', C.EARTH_RADIUS_CLUSTER_M)}, 3) AS metres, round({X.haversine('lat', 'lon', '20.0', '77.0', C.EARTH_RADIUS_GEO_M)}, 3) AS metres_geo FROM located", ("located",))
def haversine_m(spark, d):
    at = (F.col("lat"), F.col("lon"), F.lit(20.0), F.lit(77.0))
    return X.located(spark, d).select("id", F.round(geo.haversine_m(*at), 3).alias("metres"), F.round(geo.haversine_m(*at, C.EARTH_RADIUS_GEO_M), 3).alias("metres_geo"))


@query("SELECT id, coalesce(abs(gps_lat * CASE WHEN event_id % 7 = 0 THEN 9 ELSE 1 END) <= 90 AND abs(gps_lon) <= 180, false) AS ok FROM reports", ("reports",))
def valid_coordinates(spark, d):
    lat = F.col("gps_lat") * F.when(F.col("event_id") % 7 == 0, 9).otherwise(1)
    return X.reports(spark, d).select("id", geo.valid_coordinates(lat, F.col("gps_lon")).alias("ok"))


@query("SELECT id, CASE WHEN relevant AND gps_lat IS NOT NULL THEN gps_lat END AS lat, CASE WHEN relevant AND gps_lat IS NOT NULL THEN 15.0::DOUBLE END AS radius_m, CASE WHEN relevant AND gps_lat IS NOT NULL THEN 0.97::DOUBLE END AS confidence FROM facts", ("facts",))
def gps_resolve(spark, d):
    return geolocation.gps_resolve(X.facts(spark, d)).select("id", "lat", "radius_m", "confidence")


_PLACES = ", ".join(f"('{n}', {a}::DOUBLE, {o}::DOUBLE, {r}::DOUBLE, {k})" for k, (n, a, o, r) in enumerate(C.GAZETTEER))
_GAZETTEER = f"""q AS (SELECT DISTINCT trim(regexp_replace(lower(landmark), '\\s+', ' ', 'g')) AS query FROM facts WHERE landmark IS NOT NULL),
g AS (SELECT * FROM (VALUES {_PLACES}) AS t(needle, lat, lon, radius_m, pos)),
hit AS (SELECT query, lat, lon, radius_m, 'gazetteer:' || needle AS detail, row_number() OVER (PARTITION BY query ORDER BY length(needle) DESC, pos) AS n FROM q JOIN g ON regexp_matches(query, '(^|\\W)' || needle || '($|\\W)'))"""


@query(f"WITH {_GAZETTEER} SELECT query, lat, lon, radius_m, detail FROM hit WHERE n = 1", ("facts",))
def gazetteer_match(spark, d):
    landmarks = X.facts(spark, d).filter("facts.landmark IS NOT NULL").select(geolocation.normalize_landmark(F.col("facts.landmark")).alias("query"))
    return geolocation.gazetteer_match(landmarks)


_BANDS = "CASE " + " ".join(f"WHEN place_rank >= {r} THEN {m}" for r, m in C.PLACE_RANK_RADII) + " END"
_FLOORS = "CASE category " + " ".join(f"WHEN '{c}' THEN {m}" for c, m in C.CLASS_FLOORS.items()) + " ELSE 0.0 END"
_GEOCODED = f"""raw AS (SELECT *, greatest(CAST({_BANDS} AS DOUBLE), CAST({_FLOORS} AS DOUBLE), {X.haversine('lat_min', 'lon_min', 'lat_max', 'lon_max', C.EARTH_RADIUS_GEO_M)} / 2) AS r, {_BANDS} AS base FROM geocoder),
pins AS (SELECT query, lat, lon, CASE WHEN base IS NOT NULL AND r <= 1500 AND abs(lat) <= 90 THEN r END AS radius_m, category, place_rank FROM raw)"""


def _geocoder(spark, d):
    return X.derived(spark, d, X.GEOCODER).withColumn("boundingbox", F.array(*[F.col(c).cast("string") for c in ("lat_min", "lat_max", "lon_min", "lon_max")]))


@query(f"WITH {_GEOCODED} SELECT query, CASE WHEN radius_m IS NOT NULL THEN lat END AS lat, round(radius_m, 3) AS radius_m, CASE WHEN radius_m IS NOT NULL THEN 'nominatim:class=' || category || ',rank=' || place_rank END AS detail FROM pins", ("geocoder",))
def geocode_hits_filter(spark, d):
    return geolocation.geocode_hits_filter(_geocoder(spark, d)).select("query", "lat", F.round("radius_m", 3).alias("radius_m"), "detail")


@query(f"""
WITH {_GAZETTEER},
c AS (SELECT DISTINCT query, query LIKE '%pillar%' AS is_hit, 28.5::DOUBLE AS lat, CASE WHEN query LIKE '%42' THEN 40.0::DOUBLE ELSE 9999.0::DOUBLE END AS radius_m FROM q WHERE query LIKE '%pillar%' OR query LIKE '%bridge%'),
k AS (SELECT * FROM c WHERE NOT is_hit OR radius_m <= 1500)
SELECT q.query, CASE WHEN k.query IS NOT NULL THEN CASE WHEN k.is_hit THEN k.lat END ELSE hit.lat END AS lat, CASE WHEN k.query IS NOT NULL THEN CASE WHEN k.is_hit THEN k.radius_m END ELSE hit.radius_m END AS radius_m
FROM q LEFT JOIN k ON q.query = k.query LEFT JOIN hit ON q.query = hit.query AND hit.n = 1
""", ("facts",))  # fmt: skip
def geocode_cache_lookup(spark, d):
    landmarks = X.facts(spark, d).filter("facts.landmark IS NOT NULL").select(F.col("facts.landmark").alias("landmark"))
    q = landmarks.select(geolocation.normalize_landmark(F.col("landmark")).alias("query")).distinct()
    cache = q.filter("query LIKE '%pillar%' OR query LIKE '%bridge%'").select("query", F.col("query").contains("pillar").alias("is_hit"), F.lit(28.5).alias("lat"), F.lit(77.0).alias("lon"), F.when(F.col("query").endswith("42"), 40.0).otherwise(9999.0).alias("radius_m"), F.lit("cached").alias("detail"))
    return geolocation.geocode_cache_lookup(landmarks, cache).select("query", "lat", "radius_m")


@query("SELECT event_id, CASE WHEN r <= 40 THEN 0.85 WHEN r <= 100 THEN 0.7 WHEN r <= 300 THEN 0.55 WHEN r <= 800 THEN 0.4 ELSE 0.25 END::DOUBLE AS confidence FROM (SELECT event_id, event_id % 1000 AS r FROM events)")
def landmark_confidence(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", geo.landmark_confidence(F.col("event_id") % 1000).alias("confidence"))


# Resolved by gazetteer or GPS, as the first pass has it.
_DIRECT = f"""{_GAZETTEER},
direct AS (SELECT f.*, CASE WHEN gps_lat IS NOT NULL THEN gps_lat ELSE hit.lat END AS lat, CASE WHEN gps_lat IS NOT NULL THEN gps_lon ELSE hit.lon END AS lon,
    CASE WHEN gps_lat IS NOT NULL THEN 15.0::DOUBLE ELSE hit.radius_m END AS radius_m
  FROM facts f LEFT JOIN hit ON f.gps_lat IS NULL AND hit.n = 1 AND hit.query = trim(regexp_replace(lower(f.landmark), '\\s+', ' ', 'g')) WHERE f.relevant),
near AS (SELECT t.id AS target, c.id, c.lat, c.lon, c.radius_m FROM direct t JOIN direct c ON t.lat IS NULL AND c.lat IS NOT NULL AND t.disaster_type = c.disaster_type AND abs(epoch_us(t.ts) - epoch_us(c.ts)) <= 1200000000)"""


def _direct(spark, d):
    return geolocation.resolve_direct(extraction.relevant_reports(X.facts_by_text(spark, d)))


@query(f"WITH {_DIRECT} SELECT target, id, lat, lon, radius_m FROM near", ("facts",))
def nearby_candidates(spark, d):
    return geolocation.nearby_candidates(stored(_direct(spark, d), "direct"))


_R = C.EARTH_RADIUS_GEO_M
_INFER = f"""{_DIRECT},
around AS (SELECT a.target, a.id AS anchor, c.id, c.lat, c.lon, c.radius_m FROM near a JOIN near c ON a.target = c.target AND {X.haversine('a.lat', 'a.lon', 'c.lat', 'c.lon', _R)} <= 240),
sets AS (SELECT target, anchor, string_agg(id, ',' ORDER BY id) AS ids, count(*) AS n, avg(lat) AS clat, avg(lon) AS clon FROM around GROUP BY target, anchor HAVING count(*) >= 2),
measured AS (SELECT s.target, s.ids, s.n, any_value(s.clat) AS clat, any_value(s.clon) AS clon, max({X.haversine('a.lat', 'a.lon', 's.clat', 's.clon', _R)}) AS spread, max(a.radius_m + {X.haversine('a.lat', 'a.lon', 's.clat', 's.clon', _R)}) AS reach
  FROM sets s JOIN around a ON a.target = s.target AND a.anchor = s.anchor GROUP BY s.target, s.anchor, s.ids, s.n),
tight AS (SELECT target, ids, any_value(n) AS n, any_value(clat) AS clat, any_value(clon) AS clon, any_value(spread) AS spread, any_value(reach) AS reach FROM measured WHERE spread <= 120 GROUP BY target, ids),
most AS (SELECT *, max(n) OVER (PARTITION BY target) AS most FROM tight),
best AS (SELECT target, count(*) AS ties, any_value(n) AS n, any_value(clat) AS clat, any_value(clon) AS clon, any_value(spread) AS spread, any_value(reach) AS reach FROM most WHERE n = most GROUP BY target),
counts AS (SELECT target, count(*) AS k FROM near GROUP BY target),
inferred AS (SELECT c.target AS id, CASE WHEN ties = 1 THEN clat END AS lat, CASE WHEN ties = 1 THEN clon END AS lon, CASE WHEN ties = 1 THEN greatest(150.0, spread * 1.5 + 60.0, reach) END AS radius_m,
    CASE WHEN ties = 1 THEN greatest(0.15, least(0.45, 0.15 + 0.05 * n)) END AS confidence, CASE WHEN ties = 1 THEN 'nearby_inference' ELSE 'unresolved' END AS method,
    CASE WHEN k < 2 THEN 'only_' || k || '_neighbors' WHEN ties IS NULL THEN 'no_tight_neighbor_group' WHEN ties > 1 THEN 'ambiguous_neighbor_groups' ELSE 'nearby' END AS detail
  FROM counts c LEFT JOIN best b ON c.target = b.target)"""


def _near(column):
    return F.when(F.col(column).startswith("nearby"), "nearby").otherwise(F.col(column)).alias(column)


@query(f"WITH {_INFER} SELECT id, round(lat, 6) AS lat, round(lon, 6) AS lon, round(radius_m, 3) AS radius_m, round(confidence, 4)::DOUBLE AS confidence, method, detail FROM inferred", ("facts",))
def nearby_inference(spark, d):
    out = geolocation.nearby_inference(stored(_direct(spark, d), "direct"))
    return out.select("id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), F.round("radius_m", 3).alias("radius_m"), F.round("confidence", 4).alias("confidence"), "method", _near("detail"))


_RESOLVED = f"""{_INFER},
resolved AS (SELECT d.id, coalesce(d.lat, i.lat) AS lat, coalesce(d.lon, i.lon) AS lon, coalesce(d.radius_m, i.radius_m) AS radius_m,
  CASE WHEN d.gps_lat IS NOT NULL THEN 'gps' WHEN d.lat IS NOT NULL THEN 'landmark_geocode' ELSE coalesce(i.method, 'unresolved') END AS method,
  CASE WHEN d.gps_lat IS NOT NULL THEN 0.97 WHEN d.lat IS NOT NULL THEN CASE WHEN d.radius_m <= 100 THEN 0.7 WHEN d.radius_m <= 300 THEN 0.55 WHEN d.radius_m <= 800 THEN 0.4 ELSE 0.25 END ELSE coalesce(i.confidence, 0.0) END AS confidence
  FROM direct d LEFT JOIN inferred i ON d.id = i.id)"""


@query(f"WITH {_RESOLVED} SELECT id, round(lat, 6) AS lat, round(lon, 6) AS lon, round(radius_m, 3) AS radius_m, method, round(confidence, 4)::DOUBLE AS confidence FROM resolved", ("facts",))
def resolve_all(spark, d):
    direct = stored(_direct(spark, d), "direct")
    return geolocation.resolve_all(direct, direct=direct).select("id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), F.round("radius_m", 3).alias("radius_m"), "method", F.round("confidence", 4).alias("confidence"))


@query(f"WITH {_RESOLVED} SELECT method, count(*) AS n, round(avg(confidence), 4)::DOUBLE AS mean_confidence FROM resolved GROUP BY method", ("facts",))
def resolution_summary(spark, d):
    direct = stored(_direct(spark, d), "direct")
    return geolocation.resolution_summary(geolocation.resolve_all(direct, direct=direct))


# ------------------------------------------------------------ clustering


@query("""
SELECT id, array_to_string(list_filter([CASE WHEN event_id % 7 = 0 THEN 'disaster_type must be a nonempty string' END, CASE WHEN event_id % 11 = 0 THEN 'coordinates are non-finite or out of range' END, CASE WHEN event_id % 13 = 0 THEN 'uncertainty must be finite and nonnegative' END], lambda x: x IS NOT NULL), ';') AS problems FROM located
""", ("located",))  # fmt: skip
def cluster_validate(spark, d):
    k = F.col("event_id")
    bad = X.located(spark, d).withColumns({"disaster_type": F.when(k % 7 != 0, F.col("disaster_type")), "lat": F.when(k % 11 == 0, float("nan")).otherwise(F.col("lat")), "radius_m": F.when(k % 13 == 0, -1.0).otherwise(F.col("radius_m"))})
    return clustering.cluster_validate(bad).select("id", F.array_join("problems", ";").alias("problems"))


@query("SELECT id, epoch_us(session) AS session FROM sessions", ("sessions",))
def inactivity_sessions(spark, d):
    return clustering.inactivity_sessions(X.located(spark, d)).select("id", us("session"))


@query("""
WITH placed AS (SELECT id, disaster_type, epoch_us(ts) // 7200000000 AS slot, CAST(floor(lat / 0.04) AS BIGINT) AS r, CAST(floor((lon + 180) / 0.08) AS BIGINT) AS c FROM located),
cells AS (SELECT disaster_type, slot, r, c, min(id) AS least FROM placed GROUP BY ALL),
edges AS (SELECT a.least AS a, b.least AS b FROM cells a JOIN cells b ON a.disaster_type = b.disaster_type AND abs(a.slot - b.slot) <= 1 AND abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1),
reach AS (SELECT least AS node, least AS seen FROM cells UNION SELECT reach.node, edges.b FROM reach JOIN edges ON reach.seen = edges.a),
roots AS (SELECT node, min(seen) AS root FROM reach GROUP BY node)
SELECT p.id, root AS component FROM placed p JOIN cells x USING (disaster_type, slot, r, c) JOIN roots ON roots.node = x.least
""", ("located",), recursive=True)  # fmt: skip
def cluster_partition(spark, d):
    return clustering.cluster_partition(X.located(spark, d)).select("id", "component")


@query()
def cluster_reports(spark, d):
    clusters, members = clustering.cluster_reports(X.located(spark, d))
    return members.join(clusters, "cluster_id").select("id", "cluster_id", "event_type", "center_lat", "center_lon", "uncertainty_radius_m", "n")


_CENTRES = """centres AS (SELECT cluster_id, any_value(event_type) AS event_type, avg(lat) AS center_lat, avg(lon) AS center_lon, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, greatest(50.0, max(radius_m) / sqrt(count(*))) AS uncertainty_radius_m FROM members GROUP BY cluster_id)"""


@query(f"WITH {_CENTRES} SELECT cluster_id, round(center_lat, 7) AS center_lat, round(center_lon, 7) AS center_lon, uncertainty_radius_m, n, epoch_us(first_ts) AS first_ts, epoch_us(last_ts) AS last_ts FROM centres", ("members",))
def cluster_centroids(spark, d):
    return clustering.cluster_centroids(X.members(spark, d)).withColumns({"center_lat": F.round("center_lat", 7), "center_lon": F.round("center_lon", 7), "first_ts": F.unix_micros("first_ts"), "last_ts": F.unix_micros("last_ts")})


_FAR = X.haversine("lat", "lon", "center_lat", "center_lon", C.EARTH_RADIUS_CLUSTER_M)


@query(f"WITH {_CENTRES} SELECT m.cluster_id, m.id, round({_FAR}, 2) AS distance_m, round_even((epoch_us(ts) - epoch_us(first_ts)) / 1000000, 2) AS time_delta_s FROM members m JOIN centres c ON m.cluster_id = c.cluster_id", ("members",))
def member_distance(spark, d):
    m = X.members(spark, d)
    return clustering.member_distance(m, clustering.cluster_centroids(m))


# ------------------------------------------------------------ near-duplicates


_NORM = f"trim(regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(raw_text, {X._p(C.NORMALIZE_PREFIX)}, ''), {X._p(C.URL)}, '', 'g'), {X._p(C.MENTION)}, '', 'g')), '[^\\w\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(f"SELECT id, {_NORM} AS norm FROM reports", ("reports",))
def normalize_text(spark, d):
    return X.reports(spark, d).select("id", text.normalize_text(F.col("raw_text")).alias("norm"))


@query(f"SELECT cluster_id, {_NORM} AS norm, count(*) AS n, min(id) AS first_id FROM members GROUP BY ALL", ("members",))
def exact_text_groups(spark, d):
    return neardup.exact_text_groups(X.members(spark, d))


@query()
def near_duplicate_pairs(spark, d):
    return neardup.near_duplicate_pairs(X.members(spark, d))


@query()
def near_duplicate_lsh(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    return neardup.near_duplicate_lsh(docs)[0]


@query()
def group_duplicate_texts(spark, d):
    """All groups, those of one report too, with the ids of their members."""
    return neardup.group_duplicate_texts(X.members(spark, d))


@query("""
WITH h AS (SELECT DISTINCT phash FROM reports WHERE phash IS NOT NULL),
edges AS (SELECT x.phash AS a, y.phash AS b FROM h x JOIN h y ON x.phash <> y.phash AND bit_count(xor(('0x' || x.phash)::UBIGINT, ('0x' || y.phash)::UBIGINT)) <= 5),
reach AS (SELECT phash AS node, phash AS seen FROM h WHERE phash IN (SELECT a FROM edges) UNION SELECT reach.node, edges.b FROM reach JOIN edges ON reach.seen = edges.a)
SELECT node, min(seen) AS root FROM reach GROUP BY node
""", ("reports",), recursive=True)  # fmt: skip
def connected_components_(spark, d):
    return connected_components(neardup.phash_similarity_join(X.reports(spark, d)))


QUERIES["connected_components"] = QUERIES.pop("connected_components_")
ORACLES["connected_components"] = ORACLES.pop("connected_components_")

_BITS = "bit_count(xor(('0x' || {a})::UBIGINT, ('0x' || {b})::UBIGINT))"


@query(f"SELECT id, {_BITS.format(a='phash', b='other')} <= 5 AS is_duplicate FROM (SELECT id, phash, substr(md5('img' || CAST(event_id % 51 AS VARCHAR)), 1, 15) || '0' AS other FROM reports WHERE phash IS NOT NULL)", ("reports",))
def hamming_duplicate(spark, d):
    other = F.concat(F.substring(F.md5(F.concat(F.lit("img"), (F.col("event_id") % 51).cast("string")).cast("binary")), 1, 15), F.lit("0"))
    return X.reports(spark, d).filter("phash IS NOT NULL").select("id", neardup.hamming_duplicate(F.col("phash"), other).alias("is_duplicate"))


@query(f"WITH h AS (SELECT DISTINCT phash FROM reports WHERE phash IS NOT NULL) SELECT x.phash AS a, y.phash AS b FROM h x JOIN h y ON x.phash < y.phash AND {_BITS.format(a='x.phash', b='y.phash')} <= 5", ("reports",))
def phash_similarity_join(spark, d):
    return neardup.phash_similarity_join(X.reports(spark, d))


@query(f"""
WITH m AS (SELECT id AS report_id, phash, ts FROM reports WHERE phash IS NOT NULL),
h AS (SELECT DISTINCT phash FROM m),
near AS (SELECT x.phash AS a, y.phash AS b FROM h x JOIN h y ON {_BITS.format(a='x.phash', b='y.phash')} <= 5),
w AS (SELECT a, report_id, ts FROM near JOIN m ON m.phash = near.b),
r AS (SELECT a, report_id, ts, min(report_id) OVER (PARTITION BY a ORDER BY ts, report_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS first FROM w)
SELECT m.report_id, m.phash, 'med_' || r.first AS is_duplicate_of FROM m JOIN r ON r.a = m.phash AND r.report_id = m.report_id
""", ("reports",))  # fmt: skip
def media_original_link(spark, d):
    return neardup.media_original_link(X.reports(spark, d).select(F.col("id").alias("report_id"), "phash", "ts"))


@query(f"WITH h AS (SELECT DISTINCT phash FROM reports WHERE phash IS NOT NULL) SELECT h.phash, min(source) AS matched_source FROM h JOIN known k ON {_BITS.format(a='h.phash', b='k.phash')} <= 5 GROUP BY h.phash", ("reports", "known"))
def recycled_media(spark, d):
    return neardup.recycled_media(X.reports(spark, d), X.known_hashes(spark, d))


_IMAGES = f"""shown AS (SELECT cluster_id, id, phash FROM members WHERE phash IS NOT NULL),
h AS (SELECT DISTINCT cluster_id, phash FROM shown),
ie AS (SELECT x.cluster_id, x.phash AS a, y.phash AS b FROM h x JOIN h y ON x.cluster_id = y.cluster_id AND {_BITS.format(a='x.phash', b='y.phash')} <= 5),
ir AS (SELECT cluster_id, phash AS node, phash AS seen FROM h UNION SELECT ir.cluster_id, ir.node, ie.b FROM ir JOIN ie ON ie.cluster_id = ir.cluster_id AND ie.a = ir.seen),
images AS (SELECT cluster_id, node AS phash, min(seen) AS root FROM ir GROUP BY cluster_id, node),
image_sizes AS (SELECT s.cluster_id, root, count(*) AS n FROM shown s JOIN images i ON s.cluster_id = i.cluster_id AND s.phash = i.phash GROUP BY s.cluster_id, root),
image_counts AS (SELECT cluster_id, count(*) AS unique_images, count(*) FILTER (WHERE n > 1) AS duplicate_image_groups FROM image_sizes GROUP BY cluster_id)"""


@query(f"WITH {_IMAGES} SELECT cluster_id, unique_images, duplicate_image_groups FROM image_counts", ("members",), recursive=True)
def duplicate_image_groups(spark, d):
    return neardup.duplicate_image_groups(X.members(spark, d))


# ------------------------------------------------------------ evidence


_WHO = f"lower(regexp_replace(trim(source_user), '^@', '')) AS author, nullif(lower(regexp_replace(regexp_extract(raw_text, {X._p(C.REPOST_ORIGIN)}, 1), '^@', '')), '') AS origin"


@query(f"WITH w AS (SELECT id, {_WHO} FROM reports) SELECT id, author AS identity FROM w UNION SELECT id, origin FROM w WHERE origin IS NOT NULL", ("reports",))
def report_identities(spark, d):
    return evidence.report_identities(X.reports(spark, d))


_SOURCES = f"""{_IMAGES},
w AS (SELECT m.cluster_id, m.id, {_WHO.replace('source_user', 'm.source_user').replace('raw_text', 'm.raw_text')}, i.root FROM members m LEFT JOIN images i ON m.cluster_id = i.cluster_id AND m.phash = i.phash),
k AS (SELECT cluster_id, id, 'u' || author AS k FROM w UNION SELECT cluster_id, id, 'u' || origin FROM w WHERE origin IS NOT NULL UNION SELECT cluster_id, id, 'i' || root FROM w WHERE root IS NOT NULL),
we AS (SELECT DISTINCT x.cluster_id, x.k AS a, y.k AS b FROM k x JOIN k y ON x.cluster_id = y.cluster_id AND x.id = y.id),
wr AS (SELECT DISTINCT cluster_id, k AS node, k AS seen FROM k UNION SELECT wr.cluster_id, wr.node, we.b FROM wr JOIN we ON we.cluster_id = wr.cluster_id AND we.a = wr.seen),
sources AS (SELECT cluster_id, count(DISTINCT root) AS independent_sources FROM (SELECT cluster_id, node, min(seen) AS root FROM wr GROUP BY cluster_id, node) GROUP BY cluster_id)"""


@query(f"WITH {_SOURCES} SELECT * FROM sources", ("members",), recursive=True)
def independent_sources(spark, d):
    return evidence.independent_sources(X.members(spark, d))


_COUNTS = f"""{_SOURCES},
old AS (SELECT DISTINCT m.phash FROM members m JOIN known k ON {_BITS.format(a='m.phash', b='k.phash')} <= 5 WHERE m.phash IS NOT NULL),
corroboration AS (SELECT t.cluster_id, total_reports, independent_sources, coalesce(unique_images, 0) AS unique_images, recycled_media_detected, coalesce(duplicate_image_groups, 0) AS duplicate_image_groups
  FROM (SELECT cluster_id, count(*) AS total_reports, count(*) FILTER (WHERE phash IN (SELECT phash FROM old)) AS recycled_media_detected FROM members GROUP BY cluster_id) t
  JOIN sources s ON t.cluster_id = s.cluster_id LEFT JOIN image_counts i ON t.cluster_id = i.cluster_id)"""


@query(f"WITH {_COUNTS} SELECT * FROM corroboration", ("members", "known"), recursive=True)
def corroboration_counts(spark, d):
    return evidence.corroboration_counts(X.members(spark, d), X.known_hashes(spark, d))


_DENIES = f"regexp_matches(raw_text, {X._p(C.DENIAL)})"


@query(f"SELECT cluster_id, bool_or({_DENIES}) AND count(*) >= 2 AS has_contradiction FROM members GROUP BY cluster_id", ("members",))
def has_contradiction(spark, d):
    return evidence.denial_flags(X.members(spark, d)).select("cluster_id", "has_contradiction")


@query(f"SELECT cluster_id, count(*) FILTER (WHERE regexp_matches(raw_text, {X._p(C.RUMOUR)})) AS rumour_count FROM members GROUP BY cluster_id", ("members",))
def rumour_count(spark, d):
    return evidence.denial_flags(X.members(spark, d)).select("cluster_id", "rumour_count")


@query(f"""SELECT cluster_id, landmark, arg_min(disaster_type, id) AS event_type, string_agg(id, ',' ORDER BY id) FILTER (WHERE NOT {_DENIES}) AS affirming, string_agg(id, ',' ORDER BY id) FILTER (WHERE {_DENIES}) AS denying
FROM members GROUP BY cluster_id, landmark HAVING affirming IS NOT NULL AND denying IS NOT NULL""", ("members",))  # fmt: skip
def contradiction_groups(spark, d):
    return evidence.contradiction_groups(X.members(spark, d)).select("cluster_id", "landmark", "event_type", F.array_join("affirming_report_ids", ",").alias("affirming"), F.array_join("denying_report_ids", ",").alias("denying"))


def _analysed(spark, d):
    """Members with the analysis of their image: by the image's number."""
    m = X.members(spark, d)
    analyses = m.filter("phash IS NOT NULL").select("phash", "event_id").groupBy("phash").agg(F.min(F.col("event_id") % 50).alias("event_id"))
    done = extraction.validate_image_analysis(analyses.join(X.derived(spark, d, X.ANALYSIS_JSON), "event_id"), F.col("json"))
    return evidence.image_analysis_join(m, done.filter("event_id % 5 <> 1"))


_ANALYSED = """an AS (SELECT phash, min(event_id % 50) AS k FROM members WHERE phash IS NOT NULL GROUP BY phash),
analysed AS (SELECT m.cluster_id, m.id, m.ts, m.phash, an.k, an.k % 5 <> 1 AND an.k % 6 IN (0, 1) AS analyzed, an.k % 5 <> 1 AND an.k % 6 = 1 AS against FROM members m JOIN an ON m.phash = an.phash)"""


@query(f"""WITH {_ANALYSED}, old AS (SELECT DISTINCT m.phash FROM members m JOIN known k ON {_BITS.format(a='m.phash', b='k.phash')} <= 5 WHERE m.phash IS NOT NULL),
once AS (SELECT cluster_id, phash, bool_or(analyzed) AS analyzed, bool_or(against) AS against, first(id ORDER BY ts, id) AS first_id, min(ts) AS first_ts FROM analysed GROUP BY cluster_id, phash)
SELECT cluster_id, count(*) FILTER (WHERE against AND phash NOT IN (SELECT phash FROM old)) AS mismatches, count(*) FILTER (WHERE analyzed) AS analyzed_unique, count(*) AS n_analyses,
  string_agg(first_id || CASE WHEN analyzed THEN '+' ELSE '-' END, ',' ORDER BY first_ts, first_id) AS image_analyses FROM once GROUP BY cluster_id""", ("members", "known"))  # fmt: skip
def image_evidence(spark, d):
    said = F.transform("image_analyses", lambda a: F.concat(a["report_id"], F.when(a["analysis"]["analyzed"], "+").otherwise("-")))
    return evidence.image_evidence(stored(_analysed(spark, d), "analysed"), X.known_hashes(spark, d)).withColumn("image_analyses", F.array_join(said, ","))


@query(f"WITH {_ANALYSED} SELECT id, analyzed FROM analysed", ("members",))
def image_analysis_join(spark, d):
    return _analysed(spark, d).filter("phash IS NOT NULL").select("id", F.col("analysis.analyzed").alias("analyzed"))


_AGREE = f"round_even(sum(CAST(round_even(greatest(0.0, 1 - {_FAR} / 500.0) * 1000000, 0) AS BIGINT)) / count(*) / 1000000, 4)"


@query(f"WITH {_CENTRES} SELECT m.cluster_id, {_AGREE} AS geo_agreement FROM members m JOIN centres c ON m.cluster_id = c.cluster_id GROUP BY m.cluster_id", ("members",))
def geo_agreement(spark, d):
    m = X.members(spark, d)
    return evidence.geo_agreement(m, clustering.cluster_centroids(m))


@query(f"WITH {_COUNTS} SELECT cluster_id, CASE WHEN unique_images > 0 THEN round_even(greatest(0, unique_images - recycled_media_detected) / unique_images, 4) ELSE 0.0 END::DOUBLE AS fresh_media_ratio FROM corroboration", ("members", "known"), recursive=True)
def fresh_media_ratio(spark, d):
    counts = evidence.corroboration_counts(X.members(spark, d), X.known_hashes(spark, d))
    return counts.select("cluster_id", scoring.fresh_media_ratio(F.col("unique_images"), F.col("recycled_media_detected"), F.lit(0)).alias("fresh_media_ratio"))


_TOP = """top AS (SELECT cluster_id, landmark FROM (SELECT cluster_id, landmark, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, first_ts, first_id) AS k FROM (
  SELECT cluster_id, landmark, count(*) AS n, min(ts) AS first_ts, arg_min(id, struct_pack(ts := ts, id := id)) AS first_id FROM members WHERE landmark IS NOT NULL GROUP BY cluster_id, landmark)) WHERE k = 1)"""


@query(f"WITH {_TOP} SELECT * FROM top", ("members",))
def top_landmark(spark, d):
    return evidence.top_landmark(X.members(spark, d))


def _feed(m):
    """Answers of a verification feed by type and landmark."""
    asked = m.filter("facts.landmark IS NOT NULL").select("event_type", F.col("facts.landmark").alias("landmark")).distinct()
    return asked.select("event_type", "landmark", (F.length("landmark") % 6 - 1).cast("int").alias("hits"))


_EXTERNAL = f"""{_TOP}, kinds AS (SELECT DISTINCT cluster_id, event_type FROM members),
external AS (SELECT k.cluster_id, landmark, CASE WHEN length(landmark) % 6 - 1 >= 0 THEN CAST(least(3, length(landmark) % 6 - 1) AS INTEGER) END AS external_hits FROM kinds k LEFT JOIN top t ON k.cluster_id = t.cluster_id)"""


@query(f"WITH {_EXTERNAL} SELECT cluster_id, external_hits FROM external", ("members",))
def external_verification(spark, d):
    m = X.members(spark, d)
    asked = m.select("cluster_id", "event_type").distinct().join(evidence.top_landmark(m), "cluster_id", "left")
    return evidence.external_verification(asked, _feed(m)).select("cluster_id", "external_hits")


@query(f"""WITH {_ANALYSED}, n AS (SELECT cluster_id, count(DISTINCT phash) AS k, count(DISTINCT phash) FILTER (WHERE NOT analyzed) AS bad FROM analysed GROUP BY cluster_id), ids AS (SELECT DISTINCT cluster_id FROM members)
SELECT ids.cluster_id, array_to_string(list_filter(['{C.NOTE_SOURCES}', '{C.NOTE_EXTERNAL}', CASE WHEN coalesce(k, 0) = 0 THEN '{C.NOTE_NO_IMAGES.replace("'", "''")}' WHEN bad > 0 THEN '{C.NOTE_SOME_IMAGES}' END], lambda x: x IS NOT NULL), chr(10)) AS notes FROM ids LEFT JOIN n ON ids.cluster_id = n.cluster_id""", ("members",))  # fmt: skip
def limitations(spark, d):
    m = stored(_analysed(spark, d), "analysed")
    shown = evidence.image_evidence(m, X.known_hashes(spark, d))
    met = m.select("cluster_id").distinct().join(shown, "cluster_id", "left").fillna(0)
    return met.select("cluster_id", F.array_join(evidence.limitations(F.lit(None).cast("int"), F.col("n_analyses"), F.col("n_analyses") - F.col("analyzed_unique")), "\n").alias("notes"))


def _centred(m):
    kinds = m.groupBy("cluster_id").agg(F.min("event_type").alias("event_type"))
    return stored(clustering.cluster_centroids(m).join(kinds, "cluster_id"), "centres")


@query()
def build_evidence(spark, d):
    m = stored(_analysed(spark, d), "analysed")
    return evidence.build_evidence(m, _centred(m), X.known_hashes(spark, d), _feed(m)).select("cluster_id", "evidence.*")


# ------------------------------------------------------------ scoring


_SIGNALS = "SELECT event_id, event_id % 8 AS s, (event_id % 11) / 10.0 AS g, (event_id % 5) / 4.0 AS m, CASE WHEN event_id % 6 < 5 THEN event_id % 6 END AS h, event_id % 3 = 0 AS c FROM events"
_SOURCE = "CAST(CASE WHEN least(5, s) <= 1 THEN 25.0 * least(5, s) WHEN least(5, s) <= 3 THEN 25.0 + (least(5, s) - 1) * 17.5 ELSE 60.0 + (least(5, s) - 3) * 20.0 END AS DOUBLE)"
_CONFIDENCE = f"greatest(0.0, least(100.0, 0.30::DOUBLE * {_SOURCE} + 0.25::DOUBLE * (100.0::DOUBLE * g::DOUBLE) + 0.20::DOUBLE * (100.0::DOUBLE * m::DOUBLE) + 0.25::DOUBLE * (100.0::DOUBLE * least(3.0, coalesce(h, 0))::DOUBLE / 3.0::DOUBLE) - CASE WHEN c THEN 45.0 ELSE 0.0 END::DOUBLE))"


def _signals(spark, d):
    k = F.col("event_id")
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", (k % 8).alias("s"), ((k % 11) / 10.0).alias("g"), ((k % 5) / 4.0).alias("m"), F.when(k % 6 < 5, k % 6).alias("h"), (k % 3 == 0).alias("c"))


def _five():
    return tuple(F.col(c) for c in "sgmhc")


@query(f"WITH x AS ({_SIGNALS}) SELECT event_id, {_SOURCE} AS score FROM x")
def source_score(spark, d):
    return _signals(spark, d).select("event_id", scoring.source_score(F.col("s")).alias("score"))


@query(f"WITH x AS ({_SIGNALS}) SELECT event_id, round({_CONFIDENCE}, 6) AS confidence FROM x")
def confidence(spark, d):
    return _signals(spark, d).select("event_id", F.round(scoring.confidence(*_five()), 6).alias("confidence"))


@query(f"WITH x AS ({_SIGNALS}) SELECT event_id, round_even({_SOURCE}, 2)::DOUBLE AS source_score, round_even(100.0 * g, 2)::DOUBLE AS geo_score, round_even(100.0 * m, 2)::DOUBLE AS media_score, CASE WHEN c THEN 45.0 ELSE 0.0 END::DOUBLE AS contradiction_penalty, 0.0::DOUBLE AS misinformation_penalty FROM x")
def confidence_breakdown(spark, d):
    b = scoring.confidence_breakdown(*_five())
    return _signals(spark, d).select("event_id", *[b[c].alias(c) for c in ("source_score", "geo_score", "media_score", "contradiction_penalty", "misinformation_penalty")])


@query("SELECT id, raw_severity AS severity FROM scored_facts", ("scored_facts",))
def severity(spark, d):
    f = F.col("facts")
    return X.facts(spark, d).select("id", scoring.severity(f["disaster_type"], f["trapped_count"], f["access_impediment"], f["resource_demands"]).alias("severity"))


@query("SELECT cluster_id, max(raw_severity) AS severity FROM members GROUP BY cluster_id", ("members",))
def cluster_severity(spark, d):
    return evidence.cluster_severity(X.members(spark, d))


_PRIORITY = "CASE WHEN {s} >= 7 THEN CASE WHEN {c} >= 70 THEN 'CRITICAL_DISPATCH' ELSE 'DEPLOY_SCOUT' END ELSE CASE WHEN {c} >= 70 THEN 'MONITOR' ELSE 'SUPPRESSED' END END"


@query(f"SELECT event_id, {_PRIORITY.format(s='(1 + event_id % 10)', c='(event_id % 101)')} AS priority FROM events")
def action_priority(spark, d):
    k = F.col("event_id")
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", scoring.action_priority((k % 101).cast("double"), (1 + k % 10).cast("double")).alias("priority"))


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'CONTRADICTED' WHEN event_id % 7 >= 3 AND event_id % 101 >= 70 THEN 'CORROBORATED' ELSE 'DEVELOPING' END AS status FROM events")
def verification_status(spark, d):
    k = F.col("event_id")
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", scoring.verification_status(k % 5 == 0, k % 7, (k % 101).cast("double")).alias("status"))


@query("SELECT cluster_id, CAST(coalesce(max(trapped_count), 0) AS INTEGER) AS estimated_trapped_total, count(trapped_count) AS confirmed_by_sources FROM members GROUP BY cluster_id", ("members",))
def victim_totals(spark, d):
    return evidence.victim_totals(X.members(spark, d))


_PLACE = "CASE r " + " ".join(f"WHEN '{u}' THEN {k}" for k, u in enumerate(C.URGENT_ORDER)) + " ELSE 5 END"


@query(f"WITH a AS (SELECT cluster_id, r, count(*) AS n FROM (SELECT cluster_id, unnest(resource_demands) AS r FROM members) GROUP BY ALL) SELECT cluster_id, string_agg(r, ',' ORDER BY {_PLACE}, -n, r) AS resources FROM a GROUP BY cluster_id", ("members",))
def priority_resources(spark, d):
    return evidence.priority_resources(X.members(spark, d)).select("cluster_id", F.array_join("priority_resources", ",").alias("resources"))


_TITLED = f"""{_TOP}, v AS (SELECT cluster_id, any_value(event_type) AS event_type, coalesce(max(trapped_count), 0) AS trapped FROM members GROUP BY cluster_id),
titled AS (SELECT v.cluster_id, CASE event_type {' '.join(f"WHEN '{k}' THEN '{x}'" for k, x in C.HAZARD_LABELS.items())} END || CASE WHEN landmark IS NOT NULL THEN ' near ' || landmark ELSE ' reported' END || CASE WHEN trapped > 0 THEN ': ' || trapped || ' people reported trapped' ELSE '' END AS title FROM v LEFT JOIN top ON v.cluster_id = top.cluster_id)"""


@query(f"WITH {_TITLED} SELECT * FROM titled", ("members",))
def incident_title(spark, d):
    m = X.members(spark, d)
    met = m.groupBy("cluster_id").agg(F.min("event_type").alias("event_type")).join(evidence.victim_totals(m), "cluster_id").join(evidence.top_landmark(m), "cluster_id", "left")
    return met.select("cluster_id", evidence.title(F.col("event_type"), F.col("landmark"), F.col("estimated_trapped_total")).alias("title"))


_ISO = "CASE WHEN epoch_us({t}) % 1000000 = 0 THEN strftime({t}, '%Y-%m-%dT%H:%M:%S') ELSE strftime({t}, '%Y-%m-%dT%H:%M:%S.%f') END || '+00:00'"


@query(f"""WITH t AS (SELECT cluster_id, list_sort(list(ts)) AS l, bool_or({_DENIES}) AND count(*) >= 2 AS c, count(*) AS n FROM members GROUP BY cluster_id)
SELECT cluster_id, array_to_string(list_filter([{_ISO.format(t='l[1]')} || ' First citizen report received', CASE WHEN n >= 3 THEN {_ISO.format(t='l[3]')} || ' 2 independent sources; ' || n || ' reports linked' END,
  CASE WHEN c THEN {_ISO.format(t='l[-1]')} || ' Conflicting report detected in cluster' END, {_ISO.format(t='l[-1]')} || ' 1 reports carry recycled media', {_ISO.format(t='l[-1]')} || ' Action priority set to MONITOR'], lambda x: x IS NOT NULL), chr(10)) AS timeline FROM t""", ("members",))  # fmt: skip
def derived_timeline(spark, d):
    m = X.members(spark, d)
    met = evidence.report_times(m).join(evidence.denial_flags(m), "cluster_id").join(m.groupBy("cluster_id").agg(F.count("*").alias("n")), "cluster_id")
    line = evidence.derived_timeline(F.col("first_ts"), F.col("third_ts"), F.col("last_ts"), F.lit(2), F.col("n"), F.col("has_contradiction"), F.lit(1), F.lit("MONITOR"))
    return met.select("cluster_id", F.array_join(F.transform(line, lambda e: F.concat_ws(" ", e["time"], e["event"])), "\n").alias("timeline"))


@query("""
WITH x AS (SELECT event_id, event_id % 3 = 0 AS c, event_id % 2 AS cg, event_id % 4 AS r, event_id % 9 AS t, event_id % 5 // 4 AS mm, event_id % 7 // 3 AS dg, event_id % 6 AS s, (event_id % 11) / 10.0 AS g, event_id % 13 // 10 AS ru FROM events),
w AS (SELECT *, CASE WHEN c OR cg > 0 THEN 0.35 ELSE 0 END + CASE WHEN r > 0 AND t > 0 THEN 0.20 ELSE 0 END + CASE WHEN mm > 0 THEN 0.15 ELSE 0 END + CASE WHEN t > 0 AND dg > 0 AND dg * 2 <= t THEN 0.15 ELSE 0 END
  + CASE WHEN t >= 3 AND s > 0 AND s / nullif(t, 0) < 0.4 THEN 0.10 ELSE 0 END + CASE WHEN g < 0.4 THEN 0.10 ELSE 0 END + CASE WHEN ru > 0 THEN 0.15 ELSE 0 END AS score FROM x)
SELECT event_id, round(least(1.0, score), 4)::DOUBLE AS risk_score,
  len(list_filter([c OR cg > 0, r > 0 AND t > 0, mm > 0, t > 0 AND dg > 0 AND dg * 2 <= t, t >= 3 AND s > 0 AND s / nullif(t, 0) < 0.4, g < 0.4, ru > 0], lambda b: b))::INTEGER AS n_signals FROM w
""")  # fmt: skip
def misinformation_risk(spark, d):
    k = F.col("event_id")
    fl = lambda a, b: F.floor(k % a / b).cast("int")
    risk = scoring.misinformation_risk(k % 3 == 0, (k % 2).cast("int"), (k % 4).cast("int"), (k % 9).cast("int"), fl(5, 4), fl(7, 3), (k % 6).cast("int"), (k % 11) / 10.0, fl(13, 10))
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", risk.alias("r")).select("event_id", F.col("r.risk_score").alias("risk_score"), F.size("r.signals").alias("n_signals"))


def _scored(spark, d):
    m = X.members(spark, d)
    return evidence.score_cluster(m, _centred(m), X.known_hashes(spark, d), _feed(m))


_JUDGED = f"""{_COUNTS}, {_CENTRES}, {_TITLED},
agree AS (SELECT m.cluster_id, {_AGREE} AS g FROM members m JOIN centres c ON m.cluster_id = c.cluster_id GROUP BY m.cluster_id),
sev AS (SELECT cluster_id, max(raw_severity) AS severity, bool_or({_DENIES}) AND count(*) >= 2 AS c, CAST(coalesce(max(trapped_count), 0) AS INTEGER) AS estimated_trapped_total, count(trapped_count) AS confirmed_by_sources FROM members GROUP BY cluster_id),
signals AS (SELECT x.*, x.independent_sources AS s, a.g, sev.*, t.title, o.landmark,
  CASE WHEN unique_images > 0 THEN round_even(greatest(0, unique_images - recycled_media_detected) / unique_images, 4) ELSE 0.0 END::DOUBLE AS m,
  CASE WHEN length(o.landmark) % 6 - 1 >= 0 THEN CAST(least(3, length(o.landmark) % 6 - 1) AS INTEGER) END AS h
  FROM corroboration x JOIN agree a ON a.cluster_id = x.cluster_id JOIN sev ON sev.cluster_id = x.cluster_id JOIN titled t ON t.cluster_id = x.cluster_id LEFT JOIN top o ON o.cluster_id = x.cluster_id),
judged AS (SELECT *, {_CONFIDENCE} AS sure, CAST(CAST(sure AS VARCHAR) AS DECIMAL(30, 18)) * 100 AS hundredths FROM signals)"""
#: Two digits, halves to the even one, of the number as it is written: the confidence often is a half or nearly one.
_HALF_EVEN = "((floor(hundredths)::BIGINT + CASE WHEN hundredths - floor(hundredths) > 0.5 OR (hundredths - floor(hundredths) = 0.5 AND floor(hundredths)::BIGINT % 2 = 1) THEN 1 ELSE 0 END) / 100.0)"


@query(f"""WITH {_JUDGED}
SELECT j.cluster_id, c.event_type, title, round(c.center_lat, 7) AS center_lat, round(c.center_lon, 7) AS center_lon, c.uncertainty_radius_m, round_even(severity, 2) AS severity_score, {_HALF_EVEN} AS confidence_score,
  CASE WHEN j.c THEN 'CONTRADICTED' WHEN s >= 3 AND sure >= 70 THEN 'CORROBORATED' ELSE 'DEVELOPING' END AS verification_status, {_PRIORITY.format(s='severity', c='sure')} AS action_priority,
  total_reports, independent_sources, unique_images, recycled_media_detected, duplicate_image_groups, g AS geo_agreement, m AS fresh_media_ratio, h AS external_verification_hits, j.c AS has_contradiction,
  estimated_trapped_total, confirmed_by_sources FROM judged j JOIN centres c ON c.cluster_id = j.cluster_id""", ("members", "known"), recursive=True)  # fmt: skip
def score_cluster(spark, d):
    """All fields but lists and texts, which have queries of their own."""
    counts = ["total_reports", "independent_sources", "unique_images", "recycled_media_detected", "duplicate_image_groups", "geo_agreement", "fresh_media_ratio", "external_verification_hits", "has_contradiction"]
    return _scored(spark, d).select(
        "cluster_id", "event_type", "title", F.round("center_lat", 7).alias("center_lat"), F.round("center_lon", 7).alias("center_lon"), "uncertainty_radius_m", "severity_score", "confidence_score",
        "verification_status", "action_priority", *[f"evidence.{c}" for c in counts], "aggregated_needs.estimated_trapped_total", "aggregated_needs.confirmed_by_sources",
    )


# ------------------------------------------------------------ incidents


def _incidents(m):
    """A snapshot of incidents: one for each cluster of members, with a state by its size."""
    met = clustering.cluster_centroids(m).join(evidence.cluster_severity(m), "cluster_id").join(evidence.victim_totals(m), "cluster_id").join(evidence.denial_flags(m), "cluster_id").join(evidence.top_landmark(m), "cluster_id", "left")
    met = met.join(m.groupBy("cluster_id").agg(F.min("event_type").alias("event_type")), "cluster_id")
    sure = F.least(F.lit(100.0), F.col("n") * 10.0)
    return met.select(
        F.concat(F.lit("INC_"), "cluster_id").alias("id"), "event_type", evidence.title(F.col("event_type"), F.col("landmark"), F.col("estimated_trapped_total")).alias("title"),
        F.round("center_lat", 7).alias("center_lat"), F.round("center_lon", 7).alias("center_lon"), "uncertainty_radius_m", F.bround("severity", 2).alias("severity_score"), sure.alias("confidence_score"),
        scoring.verification_status(F.col("has_contradiction"), F.col("n"), sure).alias("verification_status"), scoring.action_priority(sure, F.col("severity")).alias("action_priority"),
        F.element_at(F.array(*map(F.lit, C.RESPONDER_ORDER)), (F.col("n") % 4 + 1).cast("int")).alias("responder_state"), F.col("last_ts").alias("updated_at"), "n",
    )


_STATES = "['UNACKNOWLEDGED', 'ACKNOWLEDGED', 'DISPATCHED', 'RESOLVED']"
_INCIDENTS = f"""{_TITLED}, {_CENTRES},
sev AS (SELECT cluster_id, max(raw_severity) AS severity, bool_or({_DENIES}) AND count(*) >= 2 AS denied FROM members GROUP BY cluster_id),
incidents AS (SELECT 'INC_' || c.cluster_id AS id, c.event_type, title, round(center_lat, 7) AS center_lat, round(center_lon, 7) AS center_lon, uncertainty_radius_m, round_even(severity, 2) AS severity_score, least(100.0, n * 10.0)::DOUBLE AS confidence_score,
  CASE WHEN denied THEN 'CONTRADICTED' WHEN n >= 3 AND least(100, n * 10) >= 70 THEN 'CORROBORATED' ELSE 'DEVELOPING' END AS verification_status, {_PRIORITY.format(s='severity', c='least(100, n * 10)')} AS action_priority,
  {_STATES}[n % 4 + 1] AS responder_state, last_ts AS updated_at, n FROM centres c JOIN titled t ON c.cluster_id = t.cluster_id JOIN sev ON sev.cluster_id = c.cluster_id),
links AS (SELECT 'INC_' || m.cluster_id AS incident_id, m.id AS report_id, round({_FAR}, 2) AS distance_m, round_even((epoch_us(ts) - epoch_us(first_ts)) / 1000000, 2) AS time_delta_s, m.session FROM members m JOIN centres c ON m.cluster_id = c.cluster_id)"""


def _links(m):
    far = clustering.member_distance(m, clustering.cluster_centroids(m))
    return far.select(F.concat(F.lit("INC_"), "cluster_id").alias("incident_id"), F.col("id").alias("report_id"), "distance_m", "time_delta_s")


@query("SELECT cluster_id, 'OLD_' || disaster_type || CAST(event_id % 7 AS VARCHAR) AS incident_id, count(*) AS shared FROM members WHERE event_id % 3 <> 0 GROUP BY ALL", ("members",))
def incident_overlap(spark, d):
    m = X.members(spark, d)
    links = m.filter("event_id % 3 <> 0").select(F.concat(F.lit("OLD_"), "disaster_type", (F.col("event_id") % 7).cast("string")).alias("incident_id"), F.col("id").alias("report_id"))
    return incidents.incident_overlap(m, links)


def _clusters_in_order(m):
    from tidewatch.sources.storage import ranked

    heads = m.groupBy("cluster_id").agg(F.min(F.struct("ts", "id")).alias("first"), F.count("*").alias("n"))
    return ranked(heads, [F.col("first.ts"), F.col("first.id")], "place")


@query()
def incident_match(spark, d):
    m = X.members(spark, d)
    links = m.filter("event_id % 3 <> 0").select(F.concat(F.lit("OLD_"), "disaster_type", F.floor(F.unix_micros("session") / 7.2e9).cast("long").cast("string")).alias("incident_id"), F.col("id").alias("report_id"))
    return incidents.incident_match(stored(incidents.incident_overlap(m, links), "overlap"), _clusters_in_order(m))


@query("""
WITH h AS (SELECT cluster_id, count(*) AS n, min(ts) AS t, arg_min(id, struct_pack(ts := ts, id := id)) AS i FROM members GROUP BY cluster_id),
r AS (SELECT cluster_id, row_number() OVER (ORDER BY t, i) + (SELECT max(event_id % 50) FROM members) AS k FROM h WHERE n % 2 = 1)
SELECT cluster_id, 'INC_' || CASE WHEN k < 1000 THEN lpad(CAST(k AS VARCHAR), 3, '0') ELSE CAST(k AS VARCHAR) END AS incident_id FROM r
""", ("members",))  # fmt: skip
def incident_new_ids(spark, d):
    m = X.members(spark, d)
    placed = stored(_clusters_in_order(m), "placed")
    old = m.select(F.concat(F.lit("INC_"), F.lpad((F.col("event_id") % 50).cast("string"), 3, "0")).alias("id"))
    return incidents.incident_new_ids(placed, placed.filter("n % 2 = 0"), old)


@query("""
SELECT id, array_to_string(list_sort(['1 Responder state changed to ACKNOWLEDGED', CAST(event_id % 3 AS VARCHAR) || ' First citizen report received']), ';') AS timeline FROM reports
""", ("reports",))  # fmt: skip
def merge_timeline(spark, d):
    entry = lambda t, e: F.struct(t.alias("time"), F.lit(e).alias("event"))
    old = F.array(entry(F.lit("1"), "Responder state changed to ACKNOWLEDGED"), entry(F.lit("0"), "Action priority set to MONITOR"))
    new = F.array(entry((F.col("event_id") % 3).cast("string"), "First citizen report received"))
    return X.reports(spark, d).select("id", F.array_join(F.transform(incidents.merge_timeline(old, new), lambda e: F.concat_ws(" ", e["time"], e["event"])), ";").alias("timeline"))


@query(f"""
WITH {_INCIDENTS}
SELECT id, CASE WHEN n % 3 = 0 THEN 1.5 ELSE severity_score END::DOUBLE AS severity_score, CASE WHEN n % 5 = 0 THEN 'UNACKNOWLEDGED' ELSE responder_state END AS responder_state,
  CASE WHEN n % 3 = 0 OR n % 5 = 0 THEN 0 ELSE epoch_us(updated_at) END AS updated_at FROM incidents WHERE n % 5 <> 0 OR n % 3 = 0
""", ("members",))  # fmt: skip
def incident_upsert(spark, d):
    base = stored(_incidents(X.members(spark, d)).withColumn("timeline", F.array().cast("array<struct<time:string,event:string>>")), "incidents")
    new = base.filter("n % 3 = 0").withColumn("severity_score", F.lit(1.5)).drop("responder_state", "updated_at")
    out = incidents.incident_upsert(base.filter("n % 5 <> 0"), new, F.lit("1970-01-01").cast("timestamp"))
    return out.select("id", "severity_score", "responder_state", us("updated_at"))


@query(f"""
WITH {_INCIDENTS}, k AS (SELECT l.*, n FROM links l JOIN incidents i ON l.incident_id = i.id)
SELECT incident_id, report_id, distance_m FROM k WHERE n % 3 <> 0 UNION ALL SELECT incident_id, report_id, 7.0 FROM k WHERE n % 3 = 0 AND time_delta_s = 0
""", ("members",))  # fmt: skip
def link_upsert(spark, d):
    links = stored(_links(X.members(spark, d)), "links")
    sizes = links.groupBy("incident_id").agg(F.count("*").alias("n"))
    new = links.join(sizes.filter("n % 3 = 0"), "incident_id").filter("time_delta_s = 0").withColumn("distance_m", F.lit(7.0)).drop("n")
    return incidents.link_upsert(links, new).select("incident_id", "report_id", "distance_m")


@query("SELECT r.id, 'INC_' || cluster_id AS incident_id FROM reports r LEFT JOIN members m ON r.id = m.id", ("reports", "members"))
def report_incident(spark, d):
    m = X.members(spark, d)
    assigned = m.select("cluster_id").distinct().withColumn("incident_id", F.concat(F.lit("INC_"), "cluster_id"))
    return incidents.report_incident(X.reports(spark, d), m, assigned)


@query(f"""
WITH {_INCIDENTS}
SELECT 'center' AS rule, count(*) FILTER (WHERE n % 4 = 1) AS violations FROM incidents UNION ALL SELECT 'severity_score', count(*) FILTER (WHERE n % 6 = 1) FROM incidents
UNION ALL SELECT 'responder_state', count(*) FILTER (WHERE responder_state = 'RESOLVED') FROM incidents UNION ALL SELECT unnest(['uncertainty_radius_m', 'confidence_score', 'verification_status', 'action_priority']), 0
""", ("members",))  # fmt: skip
def validate_incidents(spark, d):
    n = F.col("n")
    bad = _incidents(X.members(spark, d)).withColumns({"center_lat": F.when(n % 4 == 1, 91.0).otherwise(F.col("center_lat")), "severity_score": F.when(n % 6 == 1, 10.5).otherwise(F.col("severity_score")), "responder_state": F.when(F.col("responder_state") == "RESOLVED", "GONE").otherwise(F.col("responder_state"))})
    return incidents.validate_incidents(bad)


@query(f"""
WITH c AS (SELECT event_id AS command_id, user_id % 50 AS u, ['UNACKNOWLEDGED', 'ACKNOWLEDGED', 'DISPATCHED', 'RESOLVED', 'LOST'][event_id % 5 + 1] AS state, ts FROM events),
r AS (SELECT *, nullif(list_position({_STATES}, state), 0) AS rank, CASE WHEN u < 40 THEN u % 4 + 1 END AS base FROM c),
w AS (SELECT *, greatest(base, coalesce(max(rank) OVER (PARTITION BY u ORDER BY ts, command_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1)) AS cur FROM r)
SELECT command_id, CASE WHEN rank IS NULL THEN 'unknown_state' WHEN base IS NULL THEN 'not_found' WHEN rank < cur THEN 'conflict' WHEN rank = cur THEN 'no_op' ELSE 'accepted' END AS outcome FROM w
""")  # fmt: skip
def responder_transition(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    order = F.array(*map(F.lit, [*C.RESPONDER_ORDER, "LOST"]))
    commands = e.select(F.col("event_id").alias("command_id"), (F.col("user_id") % 50).cast("string").alias("incident_id"), F.element_at(order, (F.col("event_id") % 5 + 1).cast("int")).alias("state"), F.col("ts").cast("timestamp").alias("ts"))
    have = e.select((F.col("user_id") % 50).alias("u")).distinct().filter("u < 40").select(F.col("u").cast("string").alias("id"), F.element_at(order, (F.col("u") % 4 + 1).cast("int")).alias("responder_state"))
    return incidents.responder_transition(commands, have).select("command_id", "outcome")


@query()
def run_pipeline(spark, d):
    """The whole batch, and a second run over its result: the same incidents, none created, and nothing extracted that has facts."""
    from tidewatch.plans.incident_pipeline import run_pipeline as run

    base, known = stored(X.reports(spark, d).drop("event_id"), "reports"), X.known_hashes(spark, d)
    first = run(base, known, F.lit("2026-01-01").cast("timestamp"))
    again = run(first.reports, known, F.lit("2026-01-02").cast("timestamp"), stored(first.incidents, "incidents"), stored(first.links, "links"))
    return again.incidents.select("id", "event_type", "title", "severity_score", "confidence_score", "verification_status", "action_priority", "responder_state")


@query(f"WITH {_INCIDENTS} SELECT incident_id, count(*) AS n_links, any_value(title) AS title FROM links JOIN incidents ON incidents.id = links.incident_id GROUP BY incident_id", ("members",))
def write_tables(spark, d):
    """A snapshot of incidents and links, written, published and read back as the newest one."""
    from tidewatch.sources.storage import shared_dir

    m, root = X.members(spark, d), shared_dir(spark, "snapshot")
    intake.commit_snapshot(spark, root, lambda base: {"incidents": _incidents(m), "links": _links(m)})
    at = intake.newest_snapshot(spark, root)
    return intake.read_snapshot(spark, at, "links").groupBy("incident_id").agg(F.count("*").alias("n_links")).join(intake.read_snapshot(spark, at, "incidents").select(F.col("id").alias("incident_id"), "title"), "incident_id")


@query()
def seed_incident(spark, d):
    from tidewatch.sources.seed import seed_incident as seed

    return seed(_incidents(X.members(spark, d))).select("id", "event_type", "title", "severity_score", "responder_state")


# ------------------------------------------------------------ reads


_LISTED = "id, event_type, title, severity_score, confidence_score, verification_status, action_priority, responder_state"


@query(f"WITH {_INCIDENTS} SELECT {_LISTED} FROM incidents WHERE responder_state <> 'RESOLVED'", ("members",))
def list_incidents(spark, d):
    return reads.list_incidents(_incidents(X.members(spark, d))).select(*_LISTED.split(", "))


@query(f"WITH {_INCIDENTS} SELECT id, epoch_us(updated_at) AS updated_at FROM incidents WHERE updated_at >= (SELECT quantile_disc(ts, 0.5) FROM reports)", ("members", "reports"))
def incident_updates(spark, d):
    since = X.reports(spark, d).agg(F.expr("timestamp_micros(CAST(percentile_disc(0.5) WITHIN GROUP (ORDER BY unix_micros(ts)) AS BIGINT))").alias("s")).first()["s"]
    return reads.incident_updates(_incidents(X.members(spark, d)), F.lit(since)).select("id", us("updated_at"))


@query(f"WITH {_INCIDENTS} SELECT i.id, severity_score, string_agg(l.report_id, ',' ORDER BY l.report_id) AS reports FROM incidents i LEFT JOIN links l ON l.incident_id = i.id GROUP BY i.id, severity_score", ("members",))
def incident_detail(spark, d):
    m = X.members(spark, d)
    out = reads.incident_detail(_incidents(m), _links(m), X.reports(spark, d))
    return out.select("id", "severity_score", F.array_join(F.transform("reports", lambda r: r["report_id"]), ",").alias("reports"))


@query(f"WITH {_INCIDENTS} SELECT l.incident_id, l.report_id, r.source_user, r.phash FROM links l JOIN reports r ON r.id = l.report_id", ("members",))
def incident_evidence(spark, d):
    base = X.reports(spark, d)
    media = base.filter("phash IS NOT NULL").select(F.col("id").alias("report_id"), "phash", F.lit(None).cast("string").alias("is_duplicate_of"))
    return reads.incident_evidence(_links(X.members(spark, d)), base, media).select("incident_id", "report_id", "source_user", "phash")


@query(f"WITH {_INCIDENTS} SELECT id, center_lat, center_lon, uncertainty_radius_m, action_priority FROM incidents WHERE responder_state <> 'RESOLVED'", ("members",))
def map_incidents(spark, d):
    return reads.map_incidents(_incidents(X.members(spark, d)))


@query(f"WITH {_INCIDENTS} SELECT id, title FROM incidents WHERE (contains(lower(title), 'bridge') OR contains(lower(id), 'bridge') OR contains(lower(event_type), 'bridge')) AND verification_status = 'DEVELOPING'", ("members",))
def incident_search(spark, d):
    return reads.incident_search(_incidents(X.members(spark, d)), " Bridge ", "developing").select("id", "title")


@query(f"""WITH {_INCIDENTS} SELECT count(*) AS n_all, count(*) FILTER (WHERE action_priority = 'CRITICAL_DISPATCH') AS critical, count(*) FILTER (WHERE verification_status = 'DEVELOPING') AS developing, count(*) FILTER (WHERE action_priority = 'MONITOR') AS monitor,
  count(*) FILTER (WHERE responder_state = 'RESOLVED') AS resolved, count(*) FILTER (WHERE responder_state <> 'RESOLVED') AS active, count(*) FILTER (WHERE verification_status = 'CONTRADICTED') AS contradicted,
  {', '.join(f"count(*) FILTER (WHERE responder_state <> 'RESOLVED' AND action_priority = '{p}') AS open_{p.lower()}" for p in ('CRITICAL_DISPATCH', 'DEPLOY_SCOUT', 'MONITOR', 'SUPPRESSED'))} FROM incidents""", ("members",))  # fmt: skip
def incident_facets(spark, d):
    return reads.incident_facets(_incidents(X.members(spark, d)))


@query("""
WITH x AS (SELECT event_id, event_id % 3 = 0 AS c, (event_id % 11) / 10.0 AS g, (event_id % 5) / 4.0 AS m, event_id % 101 AS s FROM events)
SELECT event_id, CASE WHEN s >= 70 THEN 'green' WHEN s >= 40 THEN 'amber' ELSE 'critical' END AS tone, CASE WHEN c THEN 'cancel' WHEN g >= 0.7 AND m >= 0.5 THEN 'verified' WHEN g < 0.4 THEN 'warning' ELSE 'check_circle' END AS icon,
  CASE WHEN c THEN 'Contradiction detected in cluster' ELSE CASE WHEN g >= 0.7 THEN 'Strong geo agreement' WHEN g >= 0.4 THEN 'Moderate geo agreement' ELSE 'Weak geo agreement' END || ' · ' || CASE WHEN m >= 0.5 THEN 'Fresh media verified' ELSE 'No fresh media' END || ' · No contradiction detected' END AS line FROM x
""")  # fmt: skip
def evidence_line(spark, d):
    k = F.col("event_id")
    line = display.evidence_line(k % 3 == 0, (k % 11) / 10.0, (k % 5) / 4.0)
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", display.confidence_tone(k % 101).alias("tone"), line.alias("l")).select("event_id", "tone", F.col("l.icon").alias("icon"), F.col("l.text").alias("line"))


@query("""
WITH x AS (SELECT id, event_id, CAST(floor((epoch_us(TIMESTAMP '2024-06-01') - epoch_us(ts)) / 60000000 + 0.5) AS BIGINT) AS mi FROM reports),
y AS (SELECT *, CAST(floor(mi / 60 + 0.5) AS BIGINT) AS h FROM x), z AS (SELECT *, CAST(floor(h / 24 + 0.5) AS BIGINT) AS dd, event_id * 7 % 5000 AS m FROM y)
SELECT id, CASE WHEN mi < 1 THEN 'just now' WHEN mi < 60 THEN mi || ' min ago' WHEN h < 24 THEN h || ' hr ago' ELSE dd || ' day' || CASE WHEN dd = 1 THEN '' ELSE 's' END || ' ago' END AS age,
  CASE WHEN m < 1000 THEN m || 'm' ELSE CAST(floor(m / 100 + 0.5) AS BIGINT) // 10 || '.' || CAST(floor(m / 100 + 0.5) AS BIGINT) % 10 || 'km' END AS far, (event_id % 101) || '%' AS share, 'Rescue Boat' AS label FROM z
""", ("reports",))  # fmt: skip
def display_formats(spark, d):
    k = F.col("event_id")
    return X.reports(spark, d).select("id", display.relative_time(F.col("ts"), F.lit("2024-06-01").cast("timestamp")).alias("age"), display.distance(k * 7 % 5000).alias("far"), display.percent((k % 101) / 100).alias("share"), display.title_resource(F.lit("rescue_boat")).alias("label"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'ACKNOWLEDGED' WHEN 1 THEN 'DISPATCHED' WHEN 2 THEN 'RESOLVED' END AS next_state FROM events")
def next_action(spark, d):
    state = F.element_at(F.array(*map(F.lit, C.RESPONDER_ORDER)), (F.col("event_id") % 4 + 1).cast("int"))
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", display.next_action(state, 2).alias("next_state"))


# ------------------------------------------------------------ photos


def _photos(spark, d):
    """Grey pictures of the embeddings, written as PNG files to the shared folder; gives the folder."""
    import struct
    import zlib

    import numpy as np
    import pyarrow as pa
    import pyarrow.fs as pafs

    from tidewatch.sources.storage import shared_dir

    root = shared_dir(spark, "photos")

    def png(grey) -> bytes:
        chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
        rows = b"".join(b"\0" + r.tobytes() for r in grey)
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", grey.shape[1], grey.shape[0], 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")

    def write(batches):
        fs, at = pafs.FileSystem.from_uri(root)
        fs.create_dir(at, recursive=True)
        for batch in batches:
            for r in batch.to_pylist():
                e = np.nan_to_num(np.asarray(r["embedding"] or [0.0], np.float64))
                v = np.bincount(np.arange(len(e)) % 64, weights=e, minlength=64)  # all components, 64 of them to a picture
                grey = np.kron(np.clip((v - v.min()) / max(float(np.ptp(v)), 1e-9) * 255, 0, 255).reshape(8, 8), np.ones((8, 8))).astype(np.uint8)
                kind, body = {0: ("gif", png(grey)), 1: ("png", b"broken"), 2: ("jpg", b"")}.get(r["vec_id"] % 20, ("png", png(grey)))
                with fs.open_output_stream(f"{at}/v{r['vec_id']:08d}.{kind}") as out:
                    out.write(body)
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding").mapInArrow(write, "n long").agg(F.sum("n")).collect()
    return root


@query("""SELECT 'v' || lpad(CAST(vec_id AS VARCHAR), 8, '0') || CASE vec_id % 20 WHEN 0 THEN '.gif' WHEN 2 THEN '.jpg' ELSE '.png' END AS name, CASE vec_id % 20 WHEN 0 THEN 'unsupported type' WHEN 1 THEN 'undecodable' WHEN 2 THEN 'empty file' END AS reason FROM embeddings""")
def media_manifest(spark, d):
    from tidewatch.sources.media import media_manifest as manifest

    return manifest(spark, _photos(spark, d)).select("name", "reason")


@query()
def phash_images(spark, d):
    from tidewatch.sources.media import phash_images as hashes

    return hashes(spark, _photos(spark, d))


# ------------------------------------------------------------ streams


def _as_stream(spark, df, files: int = 2, end: dict | None = None):
    """The rows as a file stream, oldest first, in ``files`` micro-batches.

    The source takes files by modification time, so what belongs to a batch is written when all before is
    there, by parallel tasks: a file for every thousand rows up to one for each core, as many in each batch. ``end`` gives the columns of a last row, a day after all others in a file of its
    own, which moves the watermark past them; its own result stays open, so it is never given.
    """
    from tidewatch.sources.storage import shared_dir, stored

    path, rows = shared_dir(spark, "stream"), stored(df, "replay")
    cuts = rows.agg(F.percentile_approx(F.unix_micros("ts"), [k / files for k in range(1, files)], 10_000).alias("c")).first()["c"] or []
    at, bounds = F.coalesce(F.unix_micros("ts"), F.lit(-(1 << 63))), [None, *cuts, None]
    each = max(1, min(spark.sparkContext.defaultParallelism, rows.count() // (1000 * files)))
    for low, high in zip(bounds, bounds[1:]):
        part = rows if low is None else rows.filter(at >= low)
        (part if high is None else part.filter(at < high)).repartition(each).write.mode("append").parquet(path)
    if end is not None:
        last = rows.filter("ts IS NOT NULL").orderBy(F.desc("ts")).limit(1)
        last.withColumns({"ts": F.col("ts") + F.expr("INTERVAL 1 DAY")} | {k: F.lit(v) for k, v in end.items()}).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", each).parquet(path)


def _run(spark, out, mode="append"):
    """All there is now through the query, into files; a micro-batch commits as a whole."""
    from tidewatch.sources.storage import shared_dir

    path = shared_dir(spark, "sink")
    q = out.writeStream.outputMode(mode).option("checkpointLocation", shared_dir(spark, "progress")).option("path", path).format("parquet").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(path)


@query("SELECT DISTINCT id FROM reports", ("reports",))
def stream_dedup(spark, d):
    from tidewatch.streaming.incidents import stream_dedup as dedup

    base = X.reports(spark, d).select("id", "ts")
    return _run(spark, dedup(_as_stream(spark, base.unionByName(base.filter("id LIKE '%7'"))), "400 days")).select("id")


@query("SELECT id, disaster_type, landmark FROM facts WHERE relevant", ("facts",))
def stream_extract(spark, d):
    from tidewatch.streaming.incidents import stream_extract as extract

    return _run(spark, extract(_as_stream(spark, X.reports(spark, d)))).select("id", F.col("facts.disaster_type").alias("disaster_type"), F.col("facts.landmark").alias("landmark"))


@query("SELECT disaster_type, epoch_us(session) AS first_ts, epoch_us(max(ts)) AS last_ts, count(*) AS n FROM sessions GROUP BY disaster_type, session", ("sessions",))
def stream_sessions(spark, d):
    from tidewatch.streaming.incidents import stream_sessions as sessions

    out = _run(spark, sessions(_as_stream(spark, X.located(spark, d).select("disaster_type", "ts"), end={"disaster_type": "END"}), "1 minute")).filter("disaster_type <> 'END'")
    return out.select("disaster_type", us("first_ts"), us("last_ts"), "n")


@query()
def stream_leader_cluster(spark, d):
    from tidewatch.streaming.incidents import stream_leader_cluster as leader

    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        located = X.located(spark, d).select("id", "disaster_type", "lat", "lon", "radius_m", "ts")
        return _run(spark, leader(_as_stream(spark, located, end={"disaster_type": "END", "id": "END"}), "1 minute")).filter("id <> 'END'")
    finally:
        spark.conf.set(key, before)


@query()
def stream_ingest(spark, d):
    """Two micro-batches; the second derives only what it touches."""
    from tidewatch.sources.reports import newest_snapshot, read_snapshot
    from tidewatch.sources.storage import shared_dir
    from tidewatch.streaming.ingest import stream_incidents

    root = shared_dir(spark, "ingest")
    reports = _as_stream(spark, X.reports(spark, d).drop("event_id"))
    stream_incidents(reports, root, X.known_hashes(spark, d), F.lit("2026-01-01").cast("timestamp"), shared_dir(spark, "progress")).awaitTermination()
    return read_snapshot(spark, newest_snapshot(spark, f"{root}/snapshots"), "incidents").select("id", "event_type", "title", "severity_score")


@query(f"WITH {_INCIDENTS} SELECT id, epoch_us(updated_at) AS updated_at FROM incidents WHERE updated_at >= TIMESTAMP '2024-01-15'", ("members",))
def stream_incident_updates(spark, d):
    from tidewatch.streaming.incidents import stream_incident_updates as updates

    feed = _incidents(X.members(spark, d)).select("id", "updated_at", F.col("updated_at").alias("ts"))
    return _run(spark, updates(_as_stream(spark, feed), "2024-01-15 00:00:00")).select("id", us("updated_at"))
