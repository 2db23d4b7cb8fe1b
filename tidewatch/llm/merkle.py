"""Merkle manifest of a dataset by nested-struct rollup, in SQL functions only.

A leaf is the digest of a row. Leaves of a source ascend by doc_id; every ``FAN`` consecutive
nodes become their digest until one is left, the source's subroot, and the subroots become
the root of the dataset in the same way.

Ranks. Leaves are dealt by range of (source, doc_id, leaf) and sorted there, so that a row's
place is its partition and its number in it. Only the counts of each partition and source are
summed up. No source is in one task, however large it is.

Rollup. The base-``FAN`` digits of a rank say where its leaf hangs. Blocks of ``FAN ** LEVELS``
ranks are dealt by (source, block). There one digit after the other is grouped away, from the
lowest, and each group nests the structs of its children; Spark needs no further shuffle for that.
The roots of blocks are the leaves of the next tier, which has a ``FAN ** LEVELS``-th of the rows.

Proofs. A block that has the path from its root to the dataset's root is unrolled: each level
is transformed to what stands left and right of each child and exploded. Leaves meet no join;
what is joined is a row for each block, with the path that the tier above has found for it.

Cases: null cells are ``-`` in a leaf; a null source is a source, the first; a null doc_id comes
first in its source and is never tampered with; rows of one doc_id stand in order of their leaves,
and rows that repeat a whole row are leaves of their own; one leaf is its own subroot, and one
subroot the root; very long texts are only hashed, in the scan; an empty table gives an empty
result; other columns, whatever their names, are passed over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.llm import common

#: Children of a node, and levels that a block rolls up: 729 leaves.
FAN, LEVELS = 3, 6
#: Columns of a row that its leaf covers, in this order.
COVERED = ("doc_id", "source", "lang", "n_chars", "text")


def cell(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def digest(*inputs: Column) -> Column:
    return F.sha2(F.concat(*inputs), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """source, doc_id, leaf, forged (the leaf without the text's line ends, null where the row is left alone)."""
    of = {c: F.col(c) for c in COVERED}
    told = {**of, "text": F.translate(F.col("text").cast("string"), "\n", "")}
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    leaf = digest(*[cell(of[c]) for c in COVERED])
    return docs.select(
        F.col("source").cast("string").alias("source"),
        F.col("doc_id").cast("long").alias("doc_id"),
        leaf.alias("leaf"),
        F.when(tampered, digest(*[cell(told[c]) for c in COVERED])).alias("forged"),
    )


def ranked(nodes: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``nodes`` with rank (from 0) and n (rows) in their group, nulls first; no group is in one task."""
    keys = [F.col(c).asc_nulls_first() for c in (group, *order)]
    dealt = common.stored(nodes.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftrightunsigned("at", 33).alias("part")
    held = dealt.groupBy(part, group).agg(F.min("at").alias("start"), F.count("*").alias("held"))
    whole = W.partitionBy(group)
    before = F.coalesce(F.sum("held").over(whole.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = held.select(F.col("part").alias("p"), F.col(group).alias("g"), (before - F.col("start")).alias("shift"), F.sum("held").over(whole).alias("n"))
    met = dealt.withColumn("part", part).join(starts, (F.col("part") == F.col("p")) & F.col(group).eqNullSafe(F.col("g")))
    return met.select(*nodes.columns, (F.col("at") + F.col("shift")).alias("rank"), "n")


def _width(level: int) -> Column:
    """Nodes that a group of n leaves has at a level."""
    return F.ceil(F.col("n") / F.lit(FAN**level))


def rolled(nodes: DataFrame, group: str) -> DataFrame:
    """Blocks of nodes (group, rank, n, h and a struct of all that a leaf carries, own): group, block, n, h, kids; stored.

    ``kids`` nests the levels of the block; n is how many leaves the group has in this tier.
    """
    size = FAN**LEVELS
    digits = [(F.floor(F.col("rank") / FAN**k) % FAN).cast("int").alias(f"d{k}") for k in range(LEVELS)]
    now = nodes.select(group, F.floor(F.col("rank") / size).alias("block"), *digits, "n", "h", F.col("own").alias("kids"))
    now = now.repartition(group, "block")
    for k in range(LEVELS):
        rest = [f"d{j}" for j in range(k + 1, LEVELS)]
        kids = F.sort_array(F.collect_list(F.struct(F.col(f"d{k}").alias("digit"), "h", "kids")))
        joined = F.concat_ws("", F.transform("kids", lambda x: x["h"]))
        h = F.when(_width(k) > 1, F.sha2(joined, 256)).otherwise(F.col("kids")[0]["h"])
        now = now.groupBy(group, "block", *rest, "n").agg(kids.alias("kids")).select(group, "block", *rest, "n", h.alias("h"), "kids")
    return common.stored(now, "blocks")


def unrolled(blocks: DataFrame, group: str) -> DataFrame:
    """own.* of every leaf of the blocks (with path and root of their own), path and root.

    ``path`` is an array of (l, r): what stands left and right of the node, from the leaf to the root.
    """
    now = blocks
    for k in reversed(range(LEVELS)):
        side = lambda test: F.concat_ws("", F.transform(F.filter("kids", test), lambda x: x["h"]))
        step = lambda x: F.struct(side(lambda y: y["digit"] < x["digit"]).alias("l"), side(lambda y: y["digit"] > x["digit"]).alias("r"))  # noqa: E731,B023
        child = F.explode(F.transform("kids", lambda x: F.struct(step(x).alias("step"), x["kids"].alias("kids"))))  # noqa: B023
        now = now.select(group, "n", "root", "path", child.alias("c"))
        path = F.when(_width(k) > 1, F.concat(F.array("c.step"), "path")).otherwise(F.col("path"))
        now = now.select(group, "n", "root", path.alias("path"), F.col("c.kids").alias("kids"))
    return now.select(group, "kids.*", "path", "root")


def _tiers(nodes: DataFrame, group: str) -> list[DataFrame]:
    """Stored blocks of each tier; the last has one block for each group."""
    tiers = [rolled(nodes, group)]
    most = tiers[0].agg(F.max("n")).first()[0] or 0
    while most > (size := FAN**LEVELS):
        above = tiers[-1].select(group, F.col("block").alias("rank"), F.ceil(F.col("n") / size).alias("n"), "h", F.struct("block").alias("own"))
        tiers.append(rolled(above, group))
        most = -(-most // size)
    return tiers


def _proofs(tiers: list[DataFrame], group: str, paths: DataFrame) -> DataFrame:
    """own.*, path, root of all leaves from the paths (g, path, root) of the groups' own roots."""
    found = None
    for blocks in reversed(tiers):
        above = paths if found is None else found.select(F.col(group).alias("g"), F.col("block").alias("b"), "path", "root")
        same = F.col(group).eqNullSafe(F.col("g"))
        met = blocks.join(above, same if found is None else same & (F.col("block") == F.col("b")))
        found = unrolled(met.select(group, "n", "path", "root", "kids"), group)
    return found


def manifest(docs: DataFrame) -> DataFrame:
    """source, doc_id, leaf, forged, subroot, path, root of every row of ``docs``."""
    hashed = common.stored(leaves(docs), "leaves")
    placed = ranked(hashed, "source", ["doc_id", "leaf"])
    own = F.struct("doc_id", "leaf", "forged")
    tiers = _tiers(placed.select("source", "rank", "n", F.col("leaf").alias("h"), own.alias("own")), "source")
    subroots = tiers[-1].select(F.lit(0).alias("all"), "source", F.col("h").alias("subroot"))
    top = ranked(subroots, "all", ["source"])
    over = _tiers(top.select("all", "rank", "n", F.col("subroot").alias("h"), F.struct("source", "subroot").alias("own")), "all")
    start = over[-1].select(F.col("all").alias("g"), F.array().cast("array<struct<l:string,r:string>>").alias("path"), F.col("h").alias("root"))
    named = common.stored(_proofs(over, "all", start), "subroots")
    of = _proofs(tiers, "source", named.select(F.col("source").alias("g"), "path", "root"))
    found = of.join(named.select(F.col("source").alias("g"), "subroot"), F.col("source").eqNullSafe(F.col("g")))
    return found.select("source", "doc_id", "leaf", "forged", "subroot", "path", "root")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its path give."""
    return F.aggregate(path, leaf, lambda h, step: F.sha2(F.concat(step["l"], h, step["r"]), 256))


def verified(found: DataFrame) -> DataFrame:
    """A manifest's rows with proof_sha256, folded_root (of the forged leaf where there is one) and verified."""
    siblings = F.concat_ws("", F.transform("path", lambda s: F.concat(s["l"], s["r"])))
    folded = found.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), fold(F.coalesce("forged", "leaf"), F.col("path")).alias("folded_root"))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: the proof of every document, and whether the tampered one still gives the root."""
    return verified(manifest(common.documents(spark, sf_dir)))


OP11_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, lang, n_chars, text,
    list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
      lambda c: list_transform([0, 1, 2, 3, 4, 5, 6, 7], lambda k: ((ascii(c) >> k) & 1)::BIGINT)))),
      lambda a, b: xor(a >> 1, 3988292384::BIGINT * (xor(a, b) & 1))) AS c
  FROM documents),
f AS (
  SELECT doc_id, source, c & 1 AS keeps,
    CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id END
      || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END
      || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END
      || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars END AS head,
    text, replace(text, chr(10), '') AS told
  FROM d),
leaf AS (
  SELECT doc_id, source, sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,
    CASE WHEN keeps = 1 THEN sha256(head || CASE WHEN told IS NULL THEN '-' ELSE strlen(told) || ':' || told END) END AS forged
  FROM f),
r AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank, count(*) OVER (PARTITION BY source) AS n FROM leaf),
up AS (
  SELECT source, 0 AS level, rank, n, leaf AS h FROM r
  UNION ALL
  SELECT source, level + 1, rank // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY rank)) FROM up WHERE n > 1 GROUP BY source, level, rank // 3, n),
sub AS (
  SELECT source, h AS subroot, row_number() OVER (ORDER BY source COLLATE "C" NULLS FIRST) - 1 AS rank, count(*) OVER () AS n FROM up WHERE n = 1),
top AS (
  SELECT 0 AS level, rank, n, subroot AS h FROM sub
  UNION ALL
  SELECT level + 1, rank // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY rank)) FROM top WHERE n > 1 GROUP BY level, rank // 3, n),
steps AS (
  SELECT r.source, r.rank, up.level,
    coalesce(string_agg(up.h, '' ORDER BY up.rank) FILTER (up.rank < r.rank // (3 ** up.level)::BIGINT), '') || '|'
      || coalesce(string_agg(up.h, '' ORDER BY up.rank) FILTER (up.rank > r.rank // (3 ** up.level)::BIGINT), '') AS step
  FROM r JOIN up ON r.source IS NOT DISTINCT FROM up.source AND up.n > 1 AND up.rank // 3 = r.rank // (3 ** (up.level + 1))::BIGINT
  GROUP BY r.source, r.rank, up.level),
path AS (SELECT source, rank, list(step ORDER BY level) AS steps FROM steps GROUP BY source, rank),
top_steps AS (
  SELECT sub.source, top.level,
    coalesce(string_agg(top.h, '' ORDER BY top.rank) FILTER (top.rank < sub.rank // (3 ** top.level)::BIGINT), '') || '|'
      || coalesce(string_agg(top.h, '' ORDER BY top.rank) FILTER (top.rank > sub.rank // (3 ** top.level)::BIGINT), '') AS step
  FROM sub JOIN top ON top.n > 1 AND top.rank // 3 = sub.rank // (3 ** (top.level + 1))::BIGINT
  GROUP BY sub.source, top.level),
top_path AS (SELECT source, list(step ORDER BY level) AS steps FROM top_steps GROUP BY source),
p AS (
  SELECT r.doc_id, r.leaf, coalesce(r.forged, r.leaf) AS used, sub.subroot, (SELECT h FROM top WHERE n = 1) AS root,
    list_concat(coalesce(path.steps, []), coalesce(top_path.steps, [])) AS steps
  FROM r JOIN sub ON r.source IS NOT DISTINCT FROM sub.source
    LEFT JOIN path ON r.source IS NOT DISTINCT FROM path.source AND r.rank = path.rank
    LEFT JOIN top_path ON r.source IS NOT DISTINCT FROM top_path.source),
g AS (
  SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(steps, ''), '|', '')) AS proof_sha256,
    list_reduce(list_prepend(used, steps), lambda h, s: sha256(split_part(s, '|', 1) || h || split_part(s, '|', 2))) AS folded_root
  FROM p)
SELECT *, folded_root = root AS verified FROM g
"""
