"""Incidents kept up to date by micro-batches: only what a batch touches is derived again.

A report touches others in two ways. Its pin may place unlocated reports of its type within 20 minutes, and its cell of time
and place may join, or stand beside, groups of ``cluster_partition``. A cluster never leaves its group, and a stored incident
that keeps its cluster has links to just the members of that; so clusters, scores and incident numbers of untouched groups
come out as they are stored, and the result is that of ``run_pipeline`` on all reports, on top of the batch before.

Stored below ``root``: ``facts/batch=n``, the reports of batch n with their facts, written once; and snapshots of ``pins`` (every
relevant report's pin and group), ``incidents``, ``links`` and ``progress`` (the last batch and what it cost). A batch derives
what it touches, but writes the slim tables of the snapshot whole: a scan and a copy without a sort.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidewatch import constants as C
from tidewatch.operators import clustering, extraction, geolocation
from tidewatch.plans.incident_pipeline import check_ids, derive
from tidewatch.sources.reports import commit_snapshot, newest_snapshot, read_snapshot
from tidewatch.sources.storage import stored
from tidewatch.streaming.incidents import stream_ingest

_PIN = ["lat", "lon", "radius_m", "method", "confidence", "detail"]
_ROW = ["id", "disaster_type", "ts", *_PIN]
_PINS = "id string, disaster_type string, ts timestamp, lat double, lon double, radius_m double, method string, confidence double, detail string, component string"


def _around(rows: DataFrame) -> DataFrame:
    """disaster_type, bucket: the 20 minutes of each row and those beside them, distinct."""
    own = F.array(*[_bucket() + k for k in (-1, 0, 1)])
    return rows.filter("disaster_type IS NOT NULL AND ts IS NOT NULL").select("disaster_type", F.explode(own).alias("bucket")).distinct()


def _bucket() -> Column:
    return F.floor(F.unix_micros("ts") / (C.NEARBY_WINDOW_S * 1_000_000)).cast("long")


def _placed(direct: DataFrame, pins: DataFrame) -> DataFrame:
    """Pins that are new or not what they were: the columns of a pin, its group before, and ``moved`` (its place or trust changed).

    ``direct``: new reports after the first pass. Unlocated reports near a new pin in time are inferred anew, from all pins near them.
    """
    sure = F.col("method").isin("gps", "landmark_geocode")
    found = direct.filter(sure)
    before = F.struct(*_PIN, "component").alias("before")
    again = pins.filter(~sure).withColumn("bucket", _bucket()).join(_around(found), ["disaster_type", "bucket"], "left_semi")
    again = again.select("id", "disaster_type", "ts", before).withColumns({"method": F.lit("unresolved"), "confidence": F.lit(0.0), "detail": F.lit("no_gps_no_landmark_match")})
    again = stored(again.withColumns({k: F.lit(None).cast("double") for k in ("lat", "lon", "radius_m")}).select(*_ROW, "before", F.lit(True).alias("own")), "again")
    none = F.lit(None).cast(again.schema["before"].dataType).alias("before")
    open_ = again.select(*_ROW).unionByName(direct.filter(~sure).select(*_ROW))
    beside = pins.filter(sure).withColumn("bucket", _bucket()).join(_around(open_), ["disaster_type", "bucket"], "left_semi")
    rows = again.unionByName(direct.select(*_ROW, none, F.lit(True).alias("own"))).unionByName(beside.select(*_ROW, none, F.lit(False).alias("own")))
    rows = stored(rows.withColumn("facts", F.struct(F.lit(True).alias("relevant"), "disaster_type")), "inferred-from")
    done = geolocation.resolve_all(rows, direct=rows).filter("own")
    same = [F.col(k).eqNullSafe(F.col(f"before.{k}")) for k in _PIN]
    differs, located = ~reduce(and_, same), F.col("lat").isNotNull() | F.col("before.lat").isNotNull()
    return stored(done.filter(F.col("before").isNull() | differs).select(*_ROW, F.col("before.component").alias("component"), located.alias("moved")), "placed")


def ingest_batch(
    new: DataFrame, number: int, root: str, known: DataFrame, now: Column, *, extractor: Callable[[DataFrame], DataFrame] | None = None, cache: DataFrame | None = None,
    results: DataFrame | None = None, analyses: DataFrame | None = None, hits: DataFrame | None = None, keep: int = 3,
) -> str:
    """Take micro-batch ``number`` of reports (as ``run_pipeline``'s) into the state below ``root``; the newest snapshot's folder.

    Reports may come in any order of time. A batch that comes again, whole or after a failure, changes nothing twice; batches come in
    order of their numbers, from one query. Ids that an earlier batch brought are passed over. Missing or repeated ids in a batch, and located
    reports that can't be clustered, fail as in ``run_pipeline``, and leave the snapshot as it was. The services' tables are used for what the batch touches: a pin by landmark stays as it was found, and an analysis that comes later shows when its
    cluster is touched next. Media links are not kept: ``media_original_link`` gives them from ``read_reports``.
    """
    spark = new.sparkSession
    at = newest_snapshot(spark, f"{root}/snapshots")
    if at and read_snapshot(spark, at, "progress").first()["batch"] >= number:
        return at
    extract = extractor or extraction.extract_facts
    fresh = new
    if at:
        fresh = new.join(spark.read.schema("id string, batch long").parquet(f"{root}/facts").filter(F.col("batch") < number).select("id"), "id", "left_anti").select(*new.columns)
    fresh = stored(fresh, "fresh")
    check_ids(fresh)
    facts = extraction.extract_missing(fresh, extract).drop("extracted_now") if "facts" in new.columns else extract(fresh)
    facts.write.mode("overwrite").parquet(f"{root}/facts/batch={number}")
    reports = read_reports(spark, root, facts.schema).filter(F.col("batch") <= number)
    direct = geolocation.resolve_direct(extraction.relevant_reports(reports.filter(F.col("batch") == number)), cache, results)
    direct = stored(direct.withColumn("disaster_type", F.col("facts.disaster_type")).select(*_ROW), "direct")
    clustering.check_reports(direct.filter("lat IS NOT NULL"))

    def change(at: str | None) -> dict[str, DataFrame]:
        pins = read_snapshot(spark, at, "pins") if at else spark.createDataFrame([], _PINS)
        old, links = (read_snapshot(spark, at, "incidents"), read_snapshot(spark, at, "links")) if at else (None, None)
        placed = _placed(direct, pins)
        moved = placed.filter("moved")
        groups = clustering.touched_components(pins.filter("lat IS NOT NULL"), moved.filter("lat IS NOT NULL"))
        groups = stored(groups.unionByName(moved.filter("component IS NOT NULL").select("component")).distinct(), "groups")
        kept = pins.join(placed.select("id"), "id", "left_anti")
        touched = kept.join(groups, "component", "left_semi").select(*_ROW).unionByName(moved.filter("lat IS NOT NULL").select(*_ROW))
        parted = stored(clustering.cluster_partition(touched), "parted")
        rest = kept.join(groups, "component", "left_anti").unionByName(placed.filter("lat IS NULL").withColumn("component", F.lit(None).cast("string")).select(*_ROW, "component"))
        cost = parted.agg(F.count("*").alias("touched"), F.min("ts").alias("first"), F.max("ts").alias("last")).first()
        tables = {"pins": rest.select(*_ROW, "component").unionByName(parted.select(*_ROW, "component"))}
        if at and not cost["touched"]:
            tables |= {"incidents": old, "links": links}
        else:
            # Their span of time prunes the files of reports.
            span = reports.filter(F.col("ts").between(F.lit(cost["first"]), F.lit(cost["last"]))) if cost["touched"] else reports.limit(0)
            flat = stored(span.drop("batch").join(parted.drop("ts"), "id"), "flat")
            tables["incidents"], tables["links"], _, _ = derive(flat, known, now, old, links, analyses=analyses, hits=hits)
        count = reports.agg(F.count_if(F.col("batch") == number).alias("new"), F.count("*").alias("reports"))
        tables["progress"] = count.select(F.lit(number).cast("long").alias("batch"), "new", F.lit(cost["touched"]).cast("long").alias("touched"), "reports")
        return tables

    return commit_snapshot(spark, f"{root}/snapshots", change, keep)


def read_reports(spark, root: str, schema: StructType) -> DataFrame:
    """All reports taken in, with facts and the batch they came with; ``schema`` is that of reports with facts."""
    return spark.read.schema(StructType([*schema.fields, StructField("batch", LongType())])).parquet(f"{root}/facts")


def stream_incidents(reports: DataFrame, root: str, known: DataFrame, now: Column, checkpoint: str, **services):
    """Start a query that keeps the incidents below ``root`` up to date; ``services`` as for ``ingest_batch``."""
    return stream_ingest(reports, lambda batch, number: ingest_batch(batch, number, root, known, now, **services), checkpoint)
