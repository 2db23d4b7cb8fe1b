"""Where a report is: its own GPS, its landmark, or reports nearby in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch import constants as C
from tidewatch.functions import geo
from tidewatch.operators import nearby
from tidewatch.sources.storage import stored

_PIN = ["lat", "lon", "radius_m", "method", "confidence", "detail"]


def normalize_landmark(landmark: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(landmark), "\\s+", " "))


def gazetteer(spark: SparkSession) -> DataFrame:
    """The list of real places: needle, lat, lon, radius_m, pos. A few rows, fixed."""
    rows = [(n, a, o, r, k) for k, (n, a, o, r) in enumerate(C.GAZETTEER)]
    return spark.createDataFrame(rows, "needle string, lat double, lon double, radius_m double, pos int")


def gps_resolve(reports: DataFrame) -> DataFrame:
    """Add lat, lon, radius_m, method, confidence, detail for relevant reports with valid GPS."""
    ok = F.coalesce(F.col("facts.relevant"), F.lit(True)) & geo.valid_coordinates(F.col("gps_lat"), F.col("gps_lon"))
    values = {"lat": F.col("gps_lat"), "lon": F.col("gps_lon"), "radius_m": F.lit(C.GPS_RADIUS_M), "method": F.lit("gps"), "confidence": F.lit(C.GPS_CONFIDENCE), "detail": F.lit("device_gps")}
    return reports.withColumns({k: F.when(ok, v) for k, v in values.items()})


def gazetteer_match(landmarks: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """query with lat, lon, radius_m, detail of the longest needle it holds as whole words.

    ``landmarks`` has distinct normalised ``query`` rows. The list of places is a fixed
    handful, so it is broadcast; needles are compared as plain words, not as a regex per row.
    """
    places = F.broadcast(places if places is not None else gazetteer(landmarks.sparkSession))
    whole = F.concat(F.lit(r"(?<![\p{L}\p{N}_])\Q"), F.col("needle"), F.lit(r"\E(?![\p{L}\p{N}_])"))
    met = landmarks.select("query").distinct().join(places, F.regexp_like(F.col("query"), whole))
    hit = F.max_by(F.struct("lat", "lon", "radius_m", F.concat(F.lit("gazetteer:"), F.col("needle")).alias("detail")), F.struct(F.length("needle"), -F.col("pos"))).alias("hit")
    return met.groupBy("query").agg(hit).select("query", "hit.*")


def geocode_hits_filter(results: DataFrame) -> DataFrame:
    """Interpret geocoder rows (query, lat, lon, place_rank, category, boundingbox): a pin or null.

    Too coarse a rank, an invalid place or a radius over the limit gives no pin.
    """
    box = [F.get("boundingbox", F.lit(k)).try_cast("double") for k in range(4)]
    sound = geo.valid_coordinates(box[0], box[2]) & geo.valid_coordinates(box[1], box[3]) & (box[0] <= box[1]) & (box[2] <= box[3]) & (F.size("boundingbox") == 4)
    half = F.when(sound, geo.haversine_m(box[0], box[2], box[1], box[3], C.EARTH_RADIUS_GEO_M) / 2).otherwise(0.0)
    floors = F.create_map(*[F.lit(x) for p in C.CLASS_FLOORS.items() for x in p])
    floor = F.coalesce(F.try_element_at(floors, F.col("category")), F.lit(0.0))
    base = geo.place_rank_radius(F.col("place_rank"))
    radius = F.greatest(F.greatest(base, floor), F.coalesce(half, F.lit(0.0)))
    usable = base.isNotNull() & (radius <= C.MAX_LANDMARK_RADIUS_M) & geo.valid_coordinates(F.col("lat"), F.col("lon"))
    detail = F.concat(F.lit("nominatim:class="), F.col("category"), F.lit(",rank="), F.col("place_rank").cast("string"))
    return results.select("query", *[F.when(usable, v).alias(n) for n, v in (("lat", F.col("lat")), ("lon", F.col("lon")), ("radius_m", radius), ("detail", detail))])


def geocode_cache_lookup(landmarks: DataFrame, cache: DataFrame | None = None, results: DataFrame | None = None) -> DataFrame:
    """Resolve distinct landmarks: cache (also cached misses), then gazetteer, then geocoder rows.

    ``cache`` has query, is_hit, lat, lon, radius_m, detail; a damaged hit is ignored.
    """
    queries = landmarks.select(normalize_landmark(F.col("landmark")).alias("query")).filter("query <> ''").distinct()
    columns = ["lat", "lon", "radius_m", "detail"]
    found = queries.join(gazetteer_match(queries).select("query", F.struct(*columns).alias("g")), "query", "left")
    if results is not None:
        pins = geocode_hits_filter(results).filter("lat IS NOT NULL").groupBy("query").agg(F.first(F.struct(*columns)).alias("n"))
        found = found.join(pins, "query", "left")
    else:
        found = found.withColumn("n", F.lit(None).cast(found.schema["g"].dataType))
    if cache is not None:
        sound = geo.valid_coordinates(F.col("lat"), F.col("lon")) & F.col("radius_m").between(0.0, C.MAX_LANDMARK_RADIUS_M) & F.col("detail").isNotNull()
        known = cache.filter(~F.col("is_hit") | F.coalesce(sound, F.lit(False))).select("query", F.lit(True).alias("known"), F.when(F.col("is_hit"), F.struct(*columns)).alias("c"))
        found = found.join(known, "query", "left")
        pin = F.when(F.col("known"), F.col("c")).otherwise(F.coalesce("g", "n"))
    else:
        pin = F.coalesce("g", "n")
    return found.select("query", pin.alias("pin")).select("query", "pin.*")


def resolve_direct(reports: DataFrame, cache: DataFrame | None = None, results: DataFrame | None = None) -> DataFrame:
    """First pass: GPS, else landmark; pins null where neither is there."""
    with_gps = gps_resolve(reports)
    landmark = normalize_landmark(F.col("facts.landmark"))
    need = with_gps.filter(F.col("lat").isNull() & F.col("facts.relevant"))
    pins = geocode_cache_lookup(need.select(F.col("facts.landmark").alias("landmark")), cache, results).filter("lat IS NOT NULL")
    # Stored, so that their size is known: few pins need no shuffle of reports, most of which share a few landmarks or have no need of one.
    pins = stored(pins.select("query", *[F.col(c).alias(f"p_{c}") for c in ("lat", "lon", "radius_m", "detail")]), "pins")
    key = F.when(F.col("lat").isNull() & F.col("facts.relevant"), landmark)
    met = with_gps.withColumn("tw_query", key).join(pins, F.col("tw_query") == F.col("query"), "left").drop("tw_query", "query")
    pinned = F.col("p_lat").isNotNull()
    none = F.when(~F.coalesce(F.col("facts.relevant"), F.lit(True)), "irrelevant_report").otherwise("no_gps_no_landmark_match")
    return met.withColumns({
        "method": F.when(F.col("lat").isNotNull(), "gps").when(pinned, "landmark_geocode").otherwise("unresolved"),
        "confidence": F.when(F.col("lat").isNotNull(), F.col("confidence")).when(pinned, geo.landmark_confidence(F.col("p_radius_m"))).otherwise(0.0),
        "detail": F.coalesce("detail", "p_detail", none),
        "radius_m": F.coalesce("radius_m", "p_radius_m"),
        "lat": F.coalesce("lat", "p_lat"),
        "lon": F.coalesce("lon", "p_lon"),
    }).drop("p_lat", "p_lon", "p_radius_m", "p_detail")


#: Reports without a pin that are one row while pairs with pins are made.
LIST = 1024


def nearby_candidates(direct: DataFrame) -> DataFrame:
    """(target, id, lat, lon, radius_m): direct pins of the same type within 20 minutes.

    A band join as an equi-join: pins fall in buckets of 5 minutes, and targets of one bucket are lists of about ``LIST``, which
    look in the nine buckets that they may reach. A pin meets whole lists, so pairs are made by a loop over a list and not by a
    look-up for each.
    """
    width, parts = C.NEARBY_WINDOW_S * 1_000_000, int(direct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = F.unix_micros("ts")
    bucket = F.floor(at / (width // 4)).cast("long")
    pins = direct.filter(F.col("method").isin("gps", "landmark_geocode")).select(
        "id", "lat", "lon", "radius_m", F.col("facts.disaster_type").alias("type"), at.alias("at"), bucket.alias("bucket")
    )
    targets = direct.filter((F.col("method") == "unresolved") & F.col("facts.relevant") & F.col("facts.disaster_type").isNotNull() & F.col("ts").isNotNull()).select(
        F.col("id").alias("target"), F.col("facts.disaster_type").alias("type"), at.alias("t_at"), bucket.alias("bucket")
    )
    sizes = targets.groupBy("type", "bucket").agg(F.ceil(F.count("*") / LIST).cast("long").alias("lists"))
    dealt = targets.join(sizes, ["type", "bucket"]).withColumn("list", F.pmod(F.xxhash64("target"), F.col("lists")))
    lists = dealt.groupBy("type", "bucket", "list").agg(F.collect_list(F.struct("target", "t_at")).alias("targets"))
    sent = lists.select("type", F.explode(F.sequence(F.col("bucket") - 4, F.col("bucket") + 4)).alias("bucket"), "targets")
    # A number of their own: by bytes alone few tasks would get all the pairs.
    met = pins.repartition(parts, "type", "bucket").hint("merge").join(sent.repartition(parts, "type", "bucket"), ["type", "bucket"])
    near = met.select("id", "lat", "lon", "radius_m", "at", F.inline("targets")).filter((F.abs(F.col("at") - F.col("t_at")) <= width) & (F.col("id") != F.col("target")))
    return near.select("target", "id", "lat", "lon", "radius_m")


def nearby_inference(direct: DataFrame) -> DataFrame:
    """id and the inferred pin, or the reason why there is none, for each unresolved relevant report with candidates.

    Reports of one type and moment have the same candidates, so they are one; see ``nearby`` for how a
    moment's largest tight group is found.
    """
    at = F.unix_micros("ts").alias("at")
    kind = F.col("facts.disaster_type").alias("type")
    pins = direct.filter(F.col("method").isin("gps", "landmark_geocode")).select("id", kind, at, "lat", "lon", "radius_m")
    targets = direct.filter((F.col("method") == "unresolved") & F.col("facts.relevant") & F.col("facts.disaster_type").isNotNull() & F.col("ts").isNotNull()).select("id", kind, at)
    of = nearby.inferred(pins, targets.select("type", "at").distinct())
    one = F.col("best")
    reason = F.when(F.col("k") < C.NEARBY_MIN_SAMPLES, F.concat(F.lit("only_"), F.col("k").cast("string"), F.lit("_neighbors"))).when(one.isNull(), "no_tight_neighbor_group").when(F.col("tied"), "ambiguous_neighbor_groups")
    radius = F.greatest(F.lit(150.0), one["spread"] * 1.5 + 60.0, one["reach"])
    sure = F.greatest(F.lit(0.15), F.least(F.lit(0.45), 0.15 + 0.05 * one["n"]))
    said = F.concat(F.lit("nearby:n="), one["n"].cast("string"), F.lit(",spread="), F.bround(one["spread"], 0).cast("long").cast("string"), F.lit("m"))
    ok = reason.isNull()
    values = {"lat": one["lat"], "lon": one["lon"], "radius_m": radius, "confidence": sure}
    return targets.join(of, ["type", "at"]).select(
        "id", *[F.when(ok, v).alias(k) for k, v in values.items()],
        F.when(ok, "nearby_inference").otherwise("unresolved").alias("method"), F.when(ok, said).otherwise(reason).alias("detail"),
    )


def resolve_all(reports: DataFrame, cache: DataFrame | None = None, results: DataFrame | None = None, direct: DataFrame | None = None) -> DataFrame:
    """Both passes for every report: lat, lon, radius_m, method, confidence, detail. Inference never builds on inference."""
    direct = direct if direct is not None else resolve_direct(reports, cache, results)
    inferred = nearby_inference(direct).select("id", *[F.col(c).alias(f"i_{c}") for c in _PIN])
    met = direct.join(inferred, "id", "left")
    none = F.when(F.col("detail") == "irrelevant_report", F.col("detail")).when(F.col("facts.disaster_type").isNull() | F.col("ts").isNull(), "no_disaster_type_or_timestamp").otherwise("only_0_neighbors")
    open_ = F.col("method") == "unresolved"
    return met.withColumns({
        "detail": F.when(open_, F.coalesce("i_detail", none)).otherwise(F.col("detail")),
        "confidence": F.when(open_, F.coalesce("i_confidence", F.lit(0.0))).otherwise(F.col("confidence")),
        "lat": F.coalesce("lat", "i_lat"), "lon": F.coalesce("lon", "i_lon"), "radius_m": F.coalesce("radius_m", "i_radius_m"),
        "method": F.when(open_, F.coalesce("i_method", F.lit("unresolved"))).otherwise(F.col("method")),
    }).drop(*[f"i_{c}" for c in _PIN])


def resolution_summary(resolved: DataFrame) -> DataFrame:
    return resolved.groupBy("method").agg(F.count("*").alias("n"), F.bround(F.avg("confidence"), 4).alias("mean_confidence"))
