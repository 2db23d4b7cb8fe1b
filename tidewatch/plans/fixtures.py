"""Reports and what follows from them, derived from the events table, and the same as SQL.

``WITH`` holds common table expressions in the dialect of an outside engine, by name and in
order of need; ``sql(names, body)`` puts those that a query needs before it. Patterns are the
library's own, in a syntax that both engines read (the derived texts are ASCII).
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch import constants as C
from tidewatch.operators import clustering, extraction, geolocation
from tidewatch.sources.storage import spread, stored

REPORTS = """
SELECT event_id, 'rep_' || lpad(CAST(event_id AS STRING), 8, '0') AS id,
 CASE WHEN event_id % 2 = 0 THEN '@U' ELSE 'u' END || CAST(user_id % 60 AS STRING) AS source_user,
 replace(replace(body, '{n}', CAST(1 + event_id % 9 AS STRING)), '{u}', CAST(event_id % 60 AS STRING)) AS raw_text,
 CASE WHEN event_id % 4 = 0 THEN 'media/i' || CAST(event_id % 50 AS STRING) || '.jpg' END AS media_url,
 CASE WHEN event_id % 4 = 0 THEN substr(md5('img' || CAST(event_id % 50 AS STRING)), 1, 15)
   || CASE event_id % 3 WHEN 0 THEN '0' WHEN 1 THEN '1' ELSE '3' END END AS phash,
 CAST(ts AS TIMESTAMP) AS ts,
 CASE WHEN event_id % 5 < 3 THEN 2.0e1 + (user_id % 37) * 1.0e-1 + (event_id % 11) * 2.0e-4 END AS gps_lat,
 CASE WHEN event_id % 5 < 3 THEN 7.7e1 + (event_id % 13) * 2.0e-4 END AS gps_lon
FROM events
JOIN (SELECT * FROM (VALUES
 (0,'Water rising fast near Metro Pillar 42. {n} people are stuck inside a shop and need a rescue boat.'),
 (1,'RT @u{u}: Water rising fast near Metro Pillar 42. {n} people are stuck inside a shop and need a rescue boat.'),
 (2,'Serious flooding beside Pillar 42, water almost waist deep, need life jackets and ropes right now.'),
 (3,'Sector 4 bridge has collapsed on one side, road blocked, {n} workers trapped, ambulance needed.'),
 (4,'The Sector 4 bridge is fine, it has NOT collapsed, road is only waterlogged.'),
 (5,'Fire and smoke near the market, {n} families trapped, fire brigade please.'),
 (6,'Thoughts and prayers for everyone affected.'),
 (7,'My food delivery is late again.'),
 (8,'Flooding by the school gate. Children cannot cross the road.'),
 (9,'Gas leak outside Mayur Vihar metro station, residents stranded since morning.'),
 (10,'Rumour about flooding near Mayur Vihar Phase 1, unverified claim.'),
 (11,'Forwarded: Sector 4 bridge has collapsed on one side, road blocked. Source @u{u}')
) AS v(t_id, body)) AS t ON t_id = event_id % 12
"""

#: A model's JSON answers, sound and broken ones, from a report's number.
MODEL_JSON = """
SELECT event_id, CASE event_id % 10
 WHEN 0 THEN replace('{"relevant":true,"disaster_type":"FLOOD","claim":"c{n}","landmark":null,"trapped_count":{n},"resource_demands":["rope"],"access_impediment":false,"severity":4,"event_time_hint":null}', '{n}', CAST(event_id AS STRING))
 WHEN 1 THEN '{"relevant":false,"disaster_type":"FIRE","claim":"x","landmark":"y","trapped_count":3,"resource_demands":[],"access_impediment":true,"severity":9,"event_time_hint":"now"}'
 WHEN 2 THEN '{"relevant":true,"disaster_type":"FLOOD","claim":"c","landmark":null,"trapped_count":"3","resource_demands":[],"access_impediment":false,"severity":4,"event_time_hint":null}'
 WHEN 3 THEN '{"relevant":true,"disaster_type":"STORM","claim":"c","landmark":null,"trapped_count":3,"resource_demands":[],"access_impediment":false,"severity":4,"event_time_hint":null}'
 WHEN 4 THEN '{"relevant":true,"disaster_type":"FIRE","claim":"  ","landmark":null,"trapped_count":3,"resource_demands":[],"access_impediment":false,"severity":4,"event_time_hint":null}'
 WHEN 5 THEN '{"relevant":true,"disaster_type":"FIRE","claim":"c","landmark":"Pier {n}","trapped_count":0,"resource_demands":["boat","rope"],"access_impediment":true,"severity":10,"event_time_hint":"today"}'
 WHEN 6 THEN '{"relevant":true,"disaster_type":"FIRE","claim":"c","landmark":null,"trapped_count":0,"resource_demands":[],"access_impediment":true,"severity":11,"event_time_hint":null}'
 WHEN 7 THEN 'not json'
 WHEN 8 THEN '{"relevant":true,"disaster_type":"FIRE","claim":"c","landmark":null,"trapped_count":-1,"resource_demands":[],"access_impediment":true,"severity":1,"event_time_hint":null}'
 ELSE '{"relevant":true,"disaster_type":"FIRE","claim":"c","extra":1}' END AS json
FROM events
"""

ANALYSIS_JSON = """
SELECT event_id, CASE event_id % 6
 WHEN 0 THEN '{"analyzed":true,"disaster_type":"FLOOD","severity":5,"supports_text_claim":true,"confidence":80,"provider":"p"}'
 WHEN 1 THEN '{"analyzed":true,"supports_text_claim":false,"visible_damage":["wall"],"confidence":55.5}'
 WHEN 2 THEN '{"analyzed":true,"severity":12}'
 WHEN 3 THEN '{"analyzed":true,"confidence":101}'
 WHEN 4 THEN '{"analyzed":"yes"}'
 ELSE '{"analyzed":false,"concerns":["blurred"]}' END AS json
FROM events
"""

#: Rows that a geocoder could have answered.
GEOCODER = """
SELECT 'place ' || CAST(event_id AS STRING) AS query, 2.0e1 + (event_id % 100) * 1.0e-1 + CASE WHEN event_id % 17 = 0 THEN 100 ELSE 0 END AS lat, 7.7e1 + (event_id % 7) * 1.0e-1 AS lon,
 CAST(10 + event_id % 21 AS INT) AS place_rank,
 CASE event_id % 7 WHEN 0 THEN 'railway' WHEN 1 THEN 'highway' WHEN 2 THEN 'bridge' WHEN 3 THEN 'amenity' WHEN 4 THEN 'shop' WHEN 5 THEN 'building' ELSE 'place' END AS category,
 2.0e1 AS lat_min, 2.0e1 + (event_id % 40) * 1.0e-3 AS lat_max, 7.7e1 AS lon_min, 7.7e1 + (event_id % 3) * 1.0e-3 AS lon_max
FROM events
"""


def derived(spark: SparkSession, sf_dir: str, query: str) -> DataFrame:
    """One of the statements above over the events table."""
    view = f"tw_events_{zlib.crc32(sf_dir.encode())}"
    spread(spark.read.parquet(f"{sf_dir}/events.parquet")).createOrReplaceTempView(view)
    return spark.sql(query.replace("FROM events", f"FROM {view}"))


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, REPORTS)


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract_facts(reports(spark, sf_dir))


def facts_by_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, for what builds on facts: rules run once for each distinct text."""
    return extraction.extract_by_text(reports(spark, sf_dir))


def located(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relevant reports with GPS, flat: disaster_type, lat, lon, radius_m."""
    pinned = geolocation.gps_resolve(extraction.relevant_reports(facts_by_text(spark, sf_dir))).filter("lat IS NOT NULL")
    return pinned.withColumn("disaster_type", F.col("facts.disaster_type"))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of clusters by type, tenth of a degree and inactivity session; stored."""
    at = inactivity(located(spark, sf_dir))
    spot = F.floor((F.col("lat") - 20.0) * 10 + 0.01).cast("long")
    name = F.concat_ws("|", "disaster_type", spot.cast("string"), F.floor(F.unix_micros("session") / 1_000_000).cast("string"))
    return stored(at.withColumns({"cluster_id": name, "event_type": F.col("disaster_type")}), "members")


def inactivity(df: DataFrame) -> DataFrame:
    return clustering.inactivity_sessions(df)


def known_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of the images count as known from before: the least hash of each."""
    shown = reports(spark, sf_dir).filter("event_id % 50 IN (8, 16) AND phash IS NOT NULL")
    return shown.groupBy(F.concat(F.lit("archive_"), (F.col("event_id") % 50).cast("string")).alias("source")).agg(F.min("phash").alias("phash"))


# ------------------------------------------------------------ the same as SQL


def _p(pattern: str) -> str:
    return "'(?i)" + pattern.replace("'", "''") + "'"


def _words(column: str) -> str:
    return f"array_to_string(list_transform(string_split(lower(regexp_replace({column}, '\\s+', ' ', 'g')), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"


def _title(k: int) -> str:
    return f"nullif(regexp_extract(claim, {_p(C.NAMED_LANDMARKS[k])}, 1), '')"


_hazard = "CASE " + " ".join(f"WHEN regexp_matches(claim, {_p(C.HAZARD_PATTERNS[h])}) THEN '{h}'" for h in C.HAZARDS) + " END"
_numbers = "CASE lower(t) " + " ".join(f"WHEN '{w}' THEN {n}" for w, n in C.NUMBER_WORDS.items()) + " ELSE try_cast(t AS INTEGER) END"
_needs = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(claim, {_p(p)}) THEN '{n}' END" for n, p in C.RESOURCE_PATTERNS.items()) + "], lambda r: r IS NOT NULL)"
_urgent = ", ".join(f"'{u}'" for u in C.URGENT_FOR_SEVERITY)
_stops = ", ".join(f"'{s}'" for s in C.STOP_LANDMARKS)

SEVERITY = f"""CAST(greatest(1.0, least(10.0, 1.0 + CASE disaster_type WHEN 'FLOOD' THEN 2.0 WHEN 'FIRE' THEN 3.0 WHEN 'COLLAPSE' THEN 3.0 WHEN 'OTHER' THEN 1.0 ELSE 0.0 END
  + CASE WHEN trapped_count > 0 THEN 2.0 + least(2.0, 0.2 * trapped_count) ELSE 0.0 END + CASE WHEN access_impediment THEN 2.0 ELSE 0.0 END
  + least(2.0, len(list_filter(resource_demands, lambda r: r IN ({_urgent}))) * 1.0 + len(list_filter(resource_demands, lambda r: r NOT IN ({_urgent}))) * 0.25))) AS DOUBLE)"""


def haversine(lat1: str, lon1: str, lat2: str, lon2: str, radius: float) -> str:
    a = f"power(sin((radians({lat2}) - radians({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * power(sin(radians({lon2} - {lon1}) / 2), 2)"
    return f"(2 * {radius} * asin(sqrt(greatest(0.0, least(1.0, {a})))))"


WITH: dict[str, str] = {
    "reports": REPORTS,
    "claims": f"SELECT *, trim(regexp_replace(raw_text, {_p(C.REPOST_PREFIX)}, '')) AS claim FROM reports",
    "found": f"""SELECT *, {_hazard} AS hazard,
  CASE WHEN regexp_matches(claim, {_p(C.TRAPPED_VERBS)}) THEN list_max(list_transform(regexp_extract_all(claim, {_p(C.TRAPPED_COUNT)}, 1), lambda t: {_numbers})) END AS trapped,
  {_needs} AS needs, regexp_matches(claim, {_p(C.ACCESS_IMPEDIMENT)}) AS access, nullif(regexp_extract(claim, {_p(C.TIME_HINT)}, 0), '') AS hint,
  regexp_matches(claim, {_p(C.NOISE)}) AS noise,
  coalesce({_words(_title(0))}, {_words(_title(1))}, {_words(_title(2))}) AS named,
  regexp_replace(array_to_string(list_filter(regexp_split_to_array(regexp_split_to_array(nullif(regexp_extract(claim, {_p(C.PREPOSITION_LANDMARK)}, 1), ''), {_p(C.CLAUSE_WORD)})[1], '\\s+'), lambda w: w <> '')[1:4], ' '), '^[ .,;:-]+|[ .,;:-]+$', '', 'g') AS cut
FROM claims""",
    "landed": f"SELECT *, coalesce(named, CASE WHEN length(cut) >= 3 AND lower(cut) NOT IN ({_stops}) THEN cut END) AS landed FROM found",
    "facts": """SELECT event_id, id, source_user, raw_text, media_url, phash, ts, gps_lat, gps_lon, NOT noise AND hazard IS NOT NULL AS relevant,
  CASE WHEN relevant THEN hazard END AS disaster_type, CASE WHEN relevant THEN claim END AS claim, CASE WHEN relevant THEN landed END AS landmark,
  CASE WHEN relevant THEN trapped END AS trapped_count, CASE WHEN relevant THEN needs ELSE CAST([] AS VARCHAR[]) END AS resource_demands,
  relevant AND access AS access_impediment, CASE WHEN relevant THEN hint END AS event_time_hint FROM landed""",
    "scored_facts": f"SELECT *, {SEVERITY} AS raw_severity FROM facts",
    "located": "SELECT *, gps_lat AS lat, gps_lon AS lon, 15.0::DOUBLE AS radius_m FROM scored_facts WHERE relevant AND gps_lat IS NOT NULL",
    "paused": "SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 7200000000 THEN ts END AS starts FROM located WINDOW w AS (PARTITION BY disaster_type ORDER BY ts)",
    "sessions": "SELECT * EXCLUDE (starts), max(starts) OVER (PARTITION BY disaster_type ORDER BY ts) AS session FROM paused",
    "members": "SELECT *, disaster_type AS event_type, disaster_type || '|' || CAST(CAST(floor((lat - 20.0) * 10 + 0.01) AS BIGINT) AS VARCHAR) || '|' || CAST(CAST(floor(epoch_us(session) / 1000000) AS BIGINT) AS VARCHAR) AS cluster_id FROM sessions",
    "known": "SELECT 'archive_' || CAST(event_id % 50 AS VARCHAR) AS source, min(phash) AS phash FROM reports WHERE event_id % 50 IN (8, 16) AND phash IS NOT NULL GROUP BY 1",
    "model_json": MODEL_JSON,
    "analysis_json": ANALYSIS_JSON,
    "geocoder": GEOCODER,
}
_NEEDS = {
    "claims": ["reports"], "found": ["claims"], "landed": ["found"], "facts": ["landed"], "scored_facts": ["facts"], "located": ["scored_facts"], "paused": ["located"],
    "sessions": ["paused"], "members": ["sessions"], "known": ["reports"],
}


def sql(names: list[str], body: str, recursive: bool = False) -> str:
    """``body`` after the named expressions and all that they need."""
    order: list[str] = []

    def need(name: str) -> None:
        for n in _NEEDS.get(name, []):
            need(n)
        if name not in order:
            order.append(name)

    for name in names:
        need(name)
    body = body.strip()
    if not order:
        return body.replace("WITH ", "WITH RECURSIVE ", 1) if recursive else body
    with_ = ",\n".join(f"{n} AS ({WITH[n].strip()})" for n in order)
    more = body.startswith("WITH ")
    return f"WITH {'RECURSIVE ' if recursive else ''}{with_}{',' if more else ''}\n{body[5:] if more else body}"
