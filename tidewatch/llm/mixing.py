"""Mixing sources to target weights by a time-varying curriculum, in SQL functions only.

Targets. Sources share a budget by weight; none gets more than ``max_repeats`` times its
size, and what it can't use is shared again among the others. That fixed point has a
closed form: with the sources in order of (cap / weight), the level each would get if all
before it stop at their caps tells whether it stops too.

Curriculum. Each source has a schedule, the rate at which it is drawn at time t of the
training run (0 to 1): 1 + slope * (2t - 1), the integral of which is
t * (1 - slope) + slope * t * t. A source's documents stand in a pseudo-random order (MD5
of the id) and are passed over again for repeats. A copy covers a stretch of the source's
cumulative demand; the schedule's inverse at the stretch's middle is its position in the
run. Sorting by position deals documents to the run by range.

The cumulative sums never gather a source: order keys fall in ``buckets`` by their first
hexadecimal digits, bucket totals are summed over the few buckets of a source, and a window
over each bucket's rows does the rest. Only the table of sources (a row for each) is in
one task.

The last copy taken of a source is cut to the words its target leaves, so that a source's
words are its target rounded down.

Cases: a null or blank text has size 0 and nothing of it is taken; a null source comes last
in the order of sources; a null doc_id comes first in its source's order; repeated rows
each count as a document; where all sizes are 0 all targets are 0; an empty table gives an
empty result; columns not named here are passed through by ``curriculum``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.llm import common

WEIGHTS, BUDGET, MAX_REPEATS = (3, 1, 2), 1.5, 2
#: Slopes of the schedules, repeating like the weights: early, late and even sources.
SLOPES = (-0.5, 0.5, 0.0)
#: Hexadecimal digits of the order key that make a bucket.
BUCKET_DIGITS = 3


def size_of(text: Column) -> Column:
    return F.size(common.word_array(text.cast("string"))).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """tw_source, source_size, target and place (rank of the source) from (tw_source, tw_size) sums.

    ``sizes`` has one row for each source.
    """
    by_name = W.orderBy(F.col("tw_source").asc_nulls_last())
    cycle = F.array(*[F.lit(w) for w in weights])
    placed = (
        sizes.withColumn("place", F.row_number().over(by_name) - 1)
        .withColumn("tw_w", F.element_at(cycle, (F.col("place") % len(weights) + 1).cast("int")))
        .withColumn("tw_cap", F.col("source_size") * max_repeats)
    )
    # Sources by the level at which they reach their cap; ties in order of name.
    by_level = W.orderBy(F.col("tw_cap") / F.col("tw_w"), "place")
    everything = W.partitionBy()
    before = by_level.rowsBetween(W.unboundedPreceding, -1)
    rest = by_level.rowsBetween(W.currentRow, W.unboundedFollowing)
    levelled = placed.select(
        "*",
        F.coalesce(F.sum("tw_cap").over(before), F.lit(0)).alias("tw_before"),
        F.sum("tw_w").over(rest).alias("tw_rest"),
        (F.sum("source_size").over(everything) * F.lit(budget)).alias("tw_budget"),
    ).withColumn("tw_level", (F.col("tw_budget") - F.col("tw_before")) / F.col("tw_rest"))
    stops = F.col("tw_cap").cast("double") <= F.col("tw_level") * F.col("tw_w")
    # The first source that does not stop sets the level of all that follow it.
    level = F.min(F.when(~stops, F.struct(F.col("tw_cap") / F.col("tw_w"), F.col("place"), F.col("tw_level").alias("level")))).over(everything)["level"]
    target = F.when(stops, F.col("tw_cap").cast("double")).otherwise(level * F.col("tw_w"))
    return levelled.select("tw_source", "source_size", target.alias("target"), "place")


def curriculum(docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET, max_repeats: int = MAX_REPEATS, slopes=SLOPES) -> DataFrame:
    """All columns of ``docs`` (doc_id, text, source ...) with the plan of each document.

    Names that begin with tw_ are the plan's own; ``docs`` must have none such. Added: tw_size, tw_source_size, tw_target, tw_taken, and tw_positions, the positions
    (0 to 1) of its copies in the run.
    """
    marked = docs.withColumns({
        "tw_size": size_of(F.col("text")),
        "tw_source": F.col("source").cast("string"),
        "tw_key": F.md5(F.col("doc_id").cast("string").cast("binary")),
    }).withColumn("tw_bucket", F.coalesce(F.substring("tw_key", 1, BUCKET_DIGITS), F.lit("")))
    buckets = common.stored(marked.groupBy("tw_source", "tw_bucket").agg(F.sum("tw_size").alias("tw_sum")), "buckets")
    shares = targets(buckets.groupBy("tw_source").agg(F.sum("tw_sum").alias("source_size")), weights, budget, max_repeats)
    running = W.partitionBy("tw_source").orderBy("tw_bucket").rowsBetween(W.unboundedPreceding, -1)
    begins = buckets.withColumn("tw_begin", F.coalesce(F.sum("tw_sum").over(running), F.lit(0))).drop("tw_sum")
    plan = begins.alias("b").join(shares.alias("s"), F.col("b.tw_source").eqNullSafe(F.col("s.tw_source"))).select(
        F.col("b.tw_source").alias("tw_s"), F.col("tw_bucket").alias("tw_b"), "tw_begin", F.col("source_size").alias("tw_source_size"), F.col("target").alias("tw_target"), F.col("place").alias("tw_place")
    )
    inside = W.partitionBy("tw_source", "tw_bucket").orderBy(F.col("tw_key").asc_nulls_first(), "tw_size").rowsBetween(W.unboundedPreceding, -1)
    placed = marked.withColumn("tw_inside", F.coalesce(F.sum("tw_size").over(inside), F.lit(0)))
    met = placed.join(plan, F.col("tw_source").eqNullSafe(F.col("tw_s")) & (F.col("tw_bucket") == F.col("tw_b")))
    first = F.col("tw_begin") + F.col("tw_inside")
    demand = F.floor("tw_target")
    taken = [F.greatest(F.lit(0), F.least(F.col("tw_size"), demand - first - k * F.col("tw_source_size"))).cast("long") for k in range(max_repeats)]
    slope = F.element_at(F.array(*[F.lit(s) for s in slopes]), (F.col("tw_place") % len(slopes) + 1).cast("int"))

    def position(k: int) -> Column:
        u = (first + k * F.col("tw_source_size") + taken[k] / 2) / F.nullif(demand, F.lit(0))
        root = (F.sqrt((1 - slope) * (1 - slope) + 4 * slope * u) - (1 - slope)) / F.nullif(2 * slope, F.lit(0.0))
        return F.when(taken[k] > 0, F.when(slope == 0, u).otherwise(root))

    kept = F.filter(F.array(*[position(k) for k in range(max_repeats)]), lambda p: p.isNotNull())
    return met.withColumns({"tw_taken": sum(taken[1:], taken[0]), "tw_positions": kept}).select(
        *[F.col(f"`{c}`") for c in docs.columns], "tw_size", "tw_source_size", "tw_target", "tw_taken", "tw_positions"
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: a row for each copy, columns of ``docs`` only, sorted by position.

    A copy is a whole document; of a cut one (the last of its source) the whole is given
    if at least half of it is taken.
    """
    docs, as_before = common.aside(docs)
    plan = curriculum(docs, **options)
    half = F.when(F.col("tw_size") > 0, F.floor(F.col("tw_taken") / F.col("tw_size") + 0.5).cast("int")).otherwise(0)
    copies = plan.withColumn("tw_copies", F.slice("tw_positions", F.lit(1), half)).withColumn("tw_position", F.explode("tw_copies"))
    return as_before(copies.orderBy("tw_position", "doc_id").select(*[F.col(f"`{c}`") for c in docs.columns]))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: what the mix takes of every document, in order of first position."""
    docs = common.documents(spark, sf_dir).select("doc_id", "text", "source")
    plan = curriculum(docs).select(
        "doc_id",
        F.col("tw_size").alias("size"),
        F.col("tw_source_size").alias("source_size"),
        F.col("tw_target").alias("target"),
        F.col("tw_taken").alias("taken"),
        F.get("tw_positions", F.lit(0)).alias("position"),
        F.get("tw_positions", F.lit(1)).alias("repeat_position"),
    )
    return plan.orderBy("position", "doc_id")


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5(CAST(doc_id AS VARCHAR)) AS k,
    len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS size
  FROM documents),
s AS (
  SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1 AS place
  FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][place % 3 + 1] AS w, source_size * 2 AS cap FROM s),
l AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 - coalesce(sum(cap) OVER (ORDER BY CAST(cap AS DOUBLE) / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY CAST(cap AS DOUBLE) / w, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w),
t AS (
  SELECT source, source_size, [-0.5, 0.5, 0.0][place % 3 + 1]::DOUBLE AS slope,
    CASE WHEN cap <= level * w THEN CAST(cap AS DOUBLE)
      ELSE (SELECT level FROM l WHERE NOT cap <= level * w ORDER BY CAST(cap AS DOUBLE) / w, place LIMIT 1) * w END AS target
  FROM l),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.slope, floor(t.target) AS demand,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k NULLS FIRST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (
  SELECT *, greatest(0, least(size, demand - a)) AS t0, greatest(0, least(size, demand - a - source_size)) AS t1 FROM p),
u AS (
  SELECT *, (a + t0 / 2) / nullif(demand, 0) AS u0, (a + source_size + t1 / 2) / nullif(demand, 0) AS u1 FROM c),
q AS (
  SELECT *,
    CASE WHEN t0 > 0 THEN CASE WHEN slope = 0 THEN u0 ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * u0) - (1 - slope)) / nullif(2 * slope, 0) END END AS p0,
    CASE WHEN t1 > 0 THEN CASE WHEN slope = 0 THEN u1 ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * u1) - (1 - slope)) / nullif(2 * slope, 0) END END AS p1
  FROM u)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target, CAST(t0 + t1 AS BIGINT) AS taken, p0 AS position, p1 AS repeat_position
FROM q
"""
