"""Report intake: files, validation, social posts, known hashes, snapshots."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch import constants as C
from tidewatch.functions import text
from tidewatch.sources.storage import claim, contents, names, remove

REPORT = "id string, source_user string, raw_text string, media_url string, timestamp string, gps_lat double, gps_lon double"


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of reports with an explicit schema."""
    return spark.read.schema(REPORT).json(path, multiLine=True)


def normalize_timestamp(value: Column) -> Column:
    """ISO 8601 text to a UTC time; without an offset it is UTC; null if it can't be read."""
    return F.try_to_timestamp(value)


def load_reports(incoming: DataFrame, stored: DataFrame, now: Column, order: Column | None = None) -> DataFrame:
    """Rows of ``incoming`` to insert: ids not stored yet, the first of each id in ``order``.

    A missing or blank id is made from the row's content and its place in ``order``, so that equal reports
    stay apart and a second run over the same input makes the same ids. Without an ``order`` equal
    rows are counted and numbered instead: their ids do not hang on how the input is split, and only
    which row of a given id is first is then up to the input's files. A missing time is ``now``.
    """
    fields = ("source_user", "raw_text", "media_url", "timestamp", "gps_lat", "gps_lon")
    has_id = F.coalesce(text.strip(F.col("id")), F.lit("")) != ""

    def made(place: str) -> Column:
        content = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (*fields, place)])
        return F.concat(F.lit("rep_"), F.substring(F.sha2(content, 256), 1, 32))

    if order is not None:
        named = incoming.withColumn("tw_place", order).withColumn("id", F.when(has_id, F.col("id")).otherwise(made("tw_place")))
    else:
        # Copies of a row come out of its count, in steps, so that no row holds all their numbers.
        counted = incoming.filter(~has_id).groupBy(*fields).agg(F.count("*").alias("tw_n"))
        steps = counted.withColumn("tw_step", F.explode(F.sequence(F.lit(0), F.col("tw_n") - 1, F.lit(10_000).cast("long"))))
        copies = steps.withColumn("tw_place", F.explode(F.sequence("tw_step", F.least(F.col("tw_step") + 9_999, F.col("tw_n") - 1))))
        given = incoming.filter(has_id).withColumn("tw_place", F.monotonically_increasing_id())
        named = given.select("id", *fields, "tw_place").unionByName(copies.select(made("tw_place").alias("id"), *fields, "tw_place"))
    once = named.groupBy("id").agg(F.min_by(F.struct(*fields), "tw_place").alias("row")).select("id", "row.*").join(stored.select("id"), "id", "left_anti")
    return once.withColumn("ts", F.coalesce(normalize_timestamp(F.col("timestamp")), now)).select("id", "source_user", "raw_text", "media_url", "ts", "gps_lat", "gps_lon")


def validate_reports(reports: DataFrame) -> DataFrame:
    """Add ``reasons``, why a report is not accepted (empty: accepted)."""
    def blank(c):
        return F.coalesce(text.strip(F.col(c)), F.lit("")) == ""

    def outside(c, most):
        return F.col(c).isNotNull() & (F.isnan(c) | (F.abs(F.col(c)) > most))

    checks = {"source_user": blank("source_user"), "raw_text": blank("raw_text"), "gps_lat": outside("gps_lat", 90.0), "gps_lon": outside("gps_lon", 180.0)}
    return reports.withColumn("reasons", F.filter(F.array(*[F.when(c, n) for n, c in checks.items()]), lambda r: r.isNotNull()))


def image_url(url: Column, preview: Column) -> Column:
    """A direct link to an image, else the first preview image."""
    direct = F.lower(url).rlike("\\.(" + "|".join(C.MEDIA_EXTENSIONS) + ")$")
    return F.when(direct, url).otherwise(F.get(preview["images"], F.lit(0))["source"]["url"])


def social_posts_to_reports(posts: DataFrame, seen: DataFrame, keywords: list[str], since: Column) -> DataFrame:
    """Posts that name a keyword, are recent and new, as reports; each id once, empty texts not."""
    body = text.strip(F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("selftext", F.lit(""))))
    wanted = F.lower(F.concat_ws(" ", "title", "selftext")).rlike("|".join("\\Q" + k.lower().replace("\\E", "") + "\\E" for k in keywords))
    newest = F.row_number().over(W.partitionBy("id").orderBy(F.desc("created_utc"), "title"))
    recent = posts.filter(wanted & (F.col("created_utc") >= since)).withColumn("tw_n", newest).filter("tw_n = 1")
    picked = recent.withColumn("raw_text", body).filter("raw_text <> ''").join(seen.select("id"), "id", "left_anti")
    return picked.select(
        "id", F.concat(F.lit("reddit_u_"), F.coalesce("author", F.lit("reddit_deleted_user"))).alias("source_user"), "raw_text",
        image_url(F.col("url"), F.col("preview")).alias("media_url"), F.timestamp_micros((F.col("created_utc") * 1_000_000).cast("long")).alias("ts"),
    )


def seen_ids_update(seen: DataFrame, new: DataFrame, keep: int = C.SEEN_IDS_KEPT) -> DataFrame:
    """Ids seen so far, the last ``keep`` of them in the order of their characters."""
    return seen.select("id").union(new.select("id")).distinct().orderBy(F.desc("id")).limit(keep)


def load_known_hashes(spark: SparkSession, path: str) -> DataFrame:
    """source, phash of a JSON object; other values are dropped, a malformed or missing file is empty."""
    files = spark.read.option("ignoreMissingFiles", True).text(path, wholetext=True)
    entries = files.select(F.explode(F.from_json("value", "map<string,string>")).alias("source", "phash"))
    return entries.filter(F.col("phash").isNotNull())


# ------------------------------------------------------------ snapshots


def write_snapshot(tables: dict[str, DataFrame], root: str, version: int) -> str:
    """Write each table to ``root/v=version/name`` and publish the version, for one writer that numbers versions itself."""
    spark = next(iter(tables.values())).sparkSession
    if version in _versions(spark, root):
        raise ValueError(f"version {version} is published already")
    at = _write_tables(tables, f"{root}/v={version}")
    if not claim(spark, _entry(root, version), f"v={version}"):
        raise ValueError(f"version {version} is published already")
    return at


def _write_tables(tables: dict[str, DataFrame], at: str) -> str:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{at}/{name}")
    return at


def _entry(root: str, version: int) -> str:
    """The file that publishes a version: it names the folder of its tables."""
    return f"{root}/ready/{version:012d}"


def _versions(spark: SparkSession, root: str) -> list[int]:
    return sorted(int(n) for n in names(spark, f"{root}/ready") if n.isdigit())


def commit_snapshot(spark: SparkSession, root: str, change: Callable[[str | None], dict[str, DataFrame]], keep: int = 3, attempts: int = 20) -> str:
    """Publish what ``change`` makes of the newest snapshot as the next version; the folder of it.

    Any number of writers may do so at once. ``change`` gets the newest snapshot's folder (none: None) and
    gives the tables. They are written to a folder of the writer's own, and then the next number is claimed; one writer
    gets it. The others discard what they wrote and begin again on the winner's snapshot, so no
    change is lost. A writer that dies leaves a folder that nothing names. Versions beyond the
    newest ``keep`` are removed; who reads longer than ``keep`` commits take must keep more.
    """
    if keep < 1:
        raise ValueError("the newest version stays")
    for _ in range(attempts):
        base = max(_versions(spark, root), default=0)
        folder = f"v={base + 1}-{uuid.uuid4().hex}"
        _write_tables(change(_folder(spark, root, base) if base else None), f"{root}/{folder}")
        if claim(spark, _entry(root, base + 1), folder):
            for old in _versions(spark, root)[:-keep]:
                at = _folder(spark, root, old)
                remove(spark, _entry(root, old))
                remove(spark, at)
            return f"{root}/{folder}"
        remove(spark, f"{root}/{folder}")
    raise RuntimeError(f"others were first {attempts} times")


def _folder(spark: SparkSession, root: str, version: int) -> str:
    return f"{root}/{contents(spark, _entry(root, version))}"


def newest_snapshot(spark: SparkSession, root: str) -> str | None:
    """The folder of the newest version that is published; none: None. Folders that no version names are passed over."""
    versions = _versions(spark, root)
    return _folder(spark, root, versions[-1]) if versions else None


def read_snapshot(spark: SparkSession, at: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{at}/{name}")


def schema_evolve(df: DataFrame, target: dict[str, str], defaults: dict[str, Column] | None = None) -> DataFrame:
    """Give ``df`` every column of ``target`` (name to type): missing ones null, nulls by their default."""
    defaults = defaults or {}
    out = []
    for name, kind in target.items():
        value = F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)
        out.append((F.coalesce(value, defaults[name].cast(kind)) if name in defaults else value).alias(name))
    return df.select(*out)

