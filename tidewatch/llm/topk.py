"""Exact top-k inner-product search by distributed histogram selection.

Components are turned into whole numbers, so scores are whole numbers and can be counted.
Everything is scored, in cells of a grid: queries and candidates are dealt to rows and
columns, and a cell scores its queries against its candidates as a matrix product.

1. Each query's scores lie within its norm times the largest candidate norm. That range
   is cut into 256 bins; the cells count scores by bin, the counts are summed over cells,
   and the bin that holds the k-th highest score becomes the next range. Rounds go on until
   bins are one score wide: then the k-th value is known.
2. A last pass keeps scores above the k-th value and, of those equal to it, what is needed
   with the smallest ids. A cell gives its own first k at most, which loses none: others
   in the same cell come before what it leaves out.

A cell never holds a matrix of more than ``TILE`` scores at a time, and gives at most 256
counts or k rows for each of its queries, however many candidates tie.

Cases: vectors that are null, empty or hold null or non-finite components take no part;
vectors of different lengths are never scored with each other; fewer than k candidates: all
are given; a null id takes no part; rows that repeat an id are candidates each, and as
queries share one list (of their smallest vector); an empty
table gives an empty result; other columns are passed over. Sums beyond 64 bits are held at
the largest or smallest long.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.llm import common

BINS = 256
#: Rows of a grid row and column, and scores held at once.
QUERIES_EACH, CANDIDATES_EACH, TILE = 2_048, 8_192, 1 << 22
#: At least so many columns, so that small inputs use all cores too.
LEAST_COLUMNS = 24
_LONG = 2**63 - 1


def whole_numbers(vector: Column, scale: float) -> Column:
    """floor(scale * x) of every component as double; null if any is null or not finite."""
    usable = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    scaled = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("double"))
    return F.when(vector.isNotNull() & (F.size(vector) > 0) & ~usable, scaled)


def _matrix(column, dim: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact int64 products: in single or double precision where the bound allows, else in Python integers."""
    bound = q.shape[1] * float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0))
    if bound < 2**24:
        return (q.astype(np.float32) @ c.astype(np.float32).T).astype(np.int64)
    if bound < 2**53:
        return (q @ c.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    exact = whole(q).dot(whole(c).T)
    return np.vectorize(lambda s: max(-_LONG - 1, min(_LONG, s)), otypes=[np.int64])(exact)


def _tiles(q, c):
    """(first query, its scores against a run of candidates, that run's start)."""
    wide = min(len(c), CANDIDATES_EACH) or 1
    tall = max(1, TILE // wide)
    for i in range(0, len(q), tall):
        for j in range(0, len(c), wide):
            yield i, _scores(q[i : i + tall], c[j : j + wide]), j


def _histogram(key, left: pa.Table, right: pa.Table) -> pa.Table:
    """Counts of scores by bin, of each query of the cell."""
    dim = key[0].as_py()
    ids = left["vec_id"].to_numpy()
    low, high, width = (left[c].to_numpy() for c in ("low", "high", "width"))
    counts = np.zeros((len(ids), BINS), np.int64)
    if len(right):
        q, c, other = _matrix(left["v"], dim), _matrix(right["v"], dim), right["vec_id"].to_numpy()
        for i, s, j in _tiles(q, c):
            n = len(s)
            bins = (s - low[i : i + n, None]) // width[i : i + n, None]
            inside = (bins >= 0) & (s < high[i : i + n, None]) & (ids[i : i + n, None] != other[None, j : j + s.shape[1]])
            flat = (bins + np.arange(n)[:, None] * BINS)[inside]
            counts[i : i + n] += np.bincount(flat, minlength=n * BINS).reshape(n, BINS)
    row, bin_ = np.nonzero(counts)
    return pa.table({"vec_id": ids[row], "bin": bin_.astype(np.int32), "n": counts[row, bin_]})


def _first(key, left: pa.Table, right: pa.Table) -> pa.Table:
    """The cell's own first k of each query among scores that reach the k-th value."""
    dim = key[0].as_py()
    ids, low, need = left["vec_id"].to_numpy(), left["low"].to_numpy(), left["k"].to_numpy()
    out = ([], [], [])
    if len(right):
        q, c, other = _matrix(left["v"], dim), _matrix(right["v"], dim), right["vec_id"].to_numpy()
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for i, s, j in _tiles(q, c):
            own = other[j : j + s.shape[1]]
            reach = (s >= low[i : i + len(s), None]) & (ids[i : i + len(s), None] != own[None, :])
            for r in np.flatnonzero(reach.any(axis=1)):
                at = np.flatnonzero(reach[r])
                a, b = best.get(i + r, (np.empty(0, np.int64),) * 2)
                a, b = np.append(a, s[r, at]), np.append(b, own[at])
                keep = np.lexsort((b, -a))[: need[i + r]]
                best[i + r] = (a[keep], b[keep])
        for r, (a, b) in best.items():
            out[0].append(np.full(len(a), ids[r]))
            out[1].append(b)
            out[2].append(a)
    cat = [np.concatenate(x) if x else np.empty(0, np.int64) for x in out]
    return pa.table({"query_id": cat[0], "vec_id": cat[1], "score": cat[2]})


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0) -> DataFrame:
    """query_id, rank, vec_id, score of the k best other rows for each row where ``is_query``.

    ``vectors`` has vec_id and embedding. Higher scores first, ties to the smaller vec_id.
    """
    spark = vectors.sparkSession
    usable = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), whole_numbers(F.col("embedding"), scale).alias("v"), is_query.alias("q"))
    usable = common.stored(usable.filter("v IS NOT NULL AND vec_id IS NOT NULL").withColumn("dim", F.size("v")), "vectors")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    size = usable.agg(F.count("*").alias("n"), F.count_if("q").alias("nq"), F.max(norm).alias("norm")).first()
    across = max(LEAST_COLUMNS, math.ceil(size["n"] / CANDIDATES_EACH))
    down = max(1, math.ceil(size["nq"] / QUERIES_EACH))
    # Rows are dealt by their place in the stored files, evenly whatever the ids are.
    place = F.monotonically_increasing_id()
    candidates = usable.withColumn("col", F.pmod(F.xxhash64(place), F.lit(across))).select("dim", "vec_id", "v", "col", F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("row"))
    reach = F.ceil(F.least(norm * F.lit(size["norm"] or 0.0), F.lit(float(2**61)))).cast("long") + 1
    queries = usable.filter("q").groupBy("vec_id").agg(F.min_by("v", F.to_json("v")).alias("v"))
    queries = common.stored(queries.select(
        F.size("v").alias("dim"), "vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(down)).cast("int").alias("row"),
        (-reach).alias("low"), (reach + 1).alias("high"), F.ceil((2 * reach + 1) / BINS).cast("long").alias("width"), F.lit(k).cast("long").alias("k"), F.lit(False).alias("done"),
    ), "queries")

    def cells(side: DataFrame) -> DataFrame:
        return side.withColumn("col", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(across - 1).cast("long"))))

    def joined(state: DataFrame, fn, schema: str) -> DataFrame:
        left = cells(state.select("dim", "row", "vec_id", "v", "low", "high", "width", "k")).groupBy("dim", "row", "col")
        return left.cogroup(candidates.groupBy("dim", "row", "col")).applyInArrow(fn, schema)

    state = queries
    for _ in range(64):
        counts = joined(state.filter("NOT done"), _histogram, "vec_id long, bin int, n long").groupBy("vec_id", "bin").agg(F.sum("n").alias("n"))
        from_top = W.partitionBy("vec_id").orderBy(F.desc("bin")).rowsBetween(W.unboundedPreceding, W.currentRow)
        summed = counts.withColumn("reached", F.sum("n").over(from_top))
        # k counts the places still open within the range; the bin that fills them is next.
        hit = summed.join(state.select("vec_id", "k"), "vec_id").groupBy("vec_id").agg(
            F.min(F.when(F.col("reached") >= F.col("k"), F.struct("reached", "bin", "n"))).alias("hit")
        )
        # Fewer than k scores in all: every one is taken. A bin one score wide: found.
        stays = F.col("done") | F.col("hit").isNull()
        bottom = F.col("low") + F.col("hit.bin") * F.col("width")
        narrowed = state.join(hit, "vec_id", "left").select(
            "dim", "vec_id", "v", "row",
            F.when(stays, F.col("low")).otherwise(bottom).alias("low"),
            F.when(stays, F.col("high")).otherwise(F.least("high", bottom + F.col("width"))).alias("high"),
            F.when(stays, F.col("width")).otherwise(F.ceil(F.col("width") / BINS)).cast("long").alias("width"),
            F.when(stays, F.col("k")).otherwise(F.col("k") - (F.col("hit.reached") - F.col("hit.n"))).alias("k"),
            (stays | (F.col("width") == 1)).alias("done"),
        )
        state = common.stored(narrowed, "ranges")
        if not state.filter("NOT done").limit(1).count():
            break
    final = joined(state.withColumn("k", F.lit(k).cast("long")), _first, "query_id long, vec_id long, score long")
    ranked = final.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: 20 best for every vec_id divisible by 20, against all rows."""
    vectors = common.table(spark, sf_dir, "embeddings")
    return top_k(vectors, F.coalesce(F.col("vec_id") % 20 == 0, F.lit(False)))


OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
