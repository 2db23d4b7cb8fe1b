"""Near-duplicate report texts and images."""

from __future__ import annotations

from difflib import SequenceMatcher
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch import constants as C
from tidewatch.functions import text
from tidewatch.operators.components import connected_components
from tidewatch.operators.runs import runs
from tidewatch.sources.storage import discard, stored

# ------------------------------------------------------------ texts


def exact_text_groups(members: DataFrame) -> DataFrame:
    """cluster_id, norm, n, first_id: reports of a cluster with the same normalised text."""
    normed = members.withColumn("norm", text.normalize_text(F.col("raw_text"))).filter("norm <> ''")
    return normed.groupBy("cluster_id", "norm").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


#: Texts of a block; a cluster's texts of about one length are dealt to blocks, and blocks meet in pairs.
BLOCK = 1024
BLOCK_CHARS = 4_000_000
#: Buckets of the counts of characters, pairs and triples of characters. Texts in one bucket by chance share more, never less.
BUCKETS = {1: 256, 2: 1024, 3: 1024}


def _gram_counts(texts: list[str], q: int) -> np.ndarray:
    """A row for each text: how many of its q-grams fall in each bucket."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.array([len(t) for t in texts])
    mixed = np.zeros(max(len(codes) - q + 1, 0), np.uint64)
    for k in range(q):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + len(mixed)]
    if q > 1:
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)
    row = np.repeat(np.arange(len(texts)), sizes)
    whole = row[: len(mixed)] == row[q - 1 : q - 1 + len(mixed)]
    at = row[: len(mixed)][whole] * BUCKETS[q] + (mixed[whole] % np.uint64(BUCKETS[q])).astype(np.int64)
    return np.bincount(at, minlength=len(texts) * BUCKETS[q]).reshape(len(texts), BUCKETS[q]).astype(np.float32)


def _shared_least(total: np.ndarray, q: int) -> np.ndarray:
    """How many q-grams two texts of ``total`` characters have in common if their ratio is reached.

    A ratio r matches M >= r * total / 2 characters in blocks. Between two blocks at least one
    character is unmatched, so there are at most total - 2 * M + 1 of them, and each of them has
    q - 1 fewer q-grams than characters.
    """
    matched = np.ceil(C.NEAR_DUPLICATE_RATIO * total / 2 - 1e-9)
    return matched - (q - 1) * (total - 2 * matched + 1)


def _compared_blocks(batches, by_turns: bool = False):
    """Pairs of texts of two blocks that the count filter leaves, with the verdict of the ratio; ``by_turns``: see ``compared_texts``."""
    names = ["cluster_id", "a", "b", "similar"]
    for run in runs(batches, 5, least=2):
        side = run.column("side").to_numpy()
        texts, ids, times, last_ids, last_times = (run.column(n).to_pylist() for n in ("norm", "id", "at", "last_id", "last_at"))
        left = np.flatnonzero(side == 0)
        right = left if not run.column("cross")[0].as_py() and run.column("i")[0].as_py() == run.column("j")[0].as_py() else np.flatnonzero(side == 1)
        if not len(left) or not len(right):
            continue
        counts = {q: _gram_counts(texts, q) for q in BUCKETS}
        sizes = np.array([len(t) for t in texts], np.float64)
        total = sizes[left][:, None] + sizes[right][None, :]
        # A product of counts is no less than the smaller of them.
        near = (counts[3][left] @ counts[3][right].T >= _shared_least(total, 3)) & (2 * np.minimum(sizes[left][:, None], sizes[right][None, :]) >= C.NEAR_DUPLICATE_RATIO * total - 1e-9)
        x, y = np.nonzero(near)
        x, y = left[x], right[y]
        if right is left:
            x, y = x[x < y], y[x < y]
        for q, rows in counts.items():
            least = _shared_least(sizes[x] + sizes[y], q)
            both = [np.minimum(rows[x[k : k + 4096]], rows[y[k : k + 4096]]).sum(axis=1) for k in range(0, len(x), 4096)]
            kept = np.concatenate(both) >= least if both else np.zeros(0, bool)
            x, y = x[kept], y[kept]
        # The ratio is not symmetric: the earlier text is the first. What it knows of the second serves all that meet it.
        pairs = sorted(((u, v) if (times[u], ids[u]) < (times[v], ids[v]) else (v, u) for u, v in zip(x.tolist(), y.tolist())), key=lambda p: p[1])
        matcher, last, out = SequenceMatcher(), None, []
        for u, v in pairs:
            if v != last:
                matcher.set_seq2(texts[v])
                last = v
            matcher.set_seq1(texts[u])
            out.append(matcher.ratio() >= C.NEAR_DUPLICATE_RATIO)
        # A copy of the first text that comes after the second one meets it in the other order.
        turned = [k for k, (u, v) in enumerate(pairs) if by_turns and not out[k] and (last_times[u], last_ids[u]) > (times[v], ids[v])]
        for k in sorted(turned, key=lambda k: pairs[k][0]):
            u, v = pairs[k]
            if u != last:
                matcher.set_seq2(texts[u])
                last = u
            matcher.set_seq1(texts[v])
            out[k] = matcher.ratio() >= C.NEAR_DUPLICATE_RATIO
        if out:
            columns = [run.column("cluster_id").slice(0, 1).combine_chunks().take(pa.array([0] * len(out))), pa.array([ids[u] for u, _ in pairs]), pa.array([ids[v] for _, v in pairs]), pa.array(out)]
            yield pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], names=names)


def compared_texts(members: DataFrame, by_turns: bool = False) -> DataFrame:
    """cluster_id, a, b, similar: the pairs that ``near_duplicate_pairs`` holds against the ratio, and what it says.

    ``by_turns``: the ratio depends on the order, so where copies of two texts come by turns a pair is alike if it is in either order.

    Texts of a cluster whose lengths allow the ratio fall in one step of a geometric scale or in two
    neighbouring ones. Each step is dealt to blocks of about ``BLOCK`` texts (fewer, if long) and each pair of
    blocks is a unit of work of bounded size, so a hot cluster is spread over all tasks. In it one matrix
    product of triple counts bounds what all its pairs share, the exact smaller counts of
    characters, pairs and triples follow, and only what passes is compared. No pair that reaches the ratio is lost.
    """
    # Copies as written are one text before the rules run.
    written = members.groupBy("cluster_id", "raw_text").agg(F.min(F.struct("ts", "id")).alias("pos"), F.max(F.struct("ts", "id")).alias("last"))
    normed = written.withColumn("norm", text.normalize_text(F.col("raw_text"))).filter(F.length("norm") >= C.MIN_TEXT_LENGTH)
    step = F.floor(F.log(F.length("norm").cast("double")) / F.log(F.lit(2 / C.NEAR_DUPLICATE_RATIO - 1))).cast("long")
    texts = stored(normed.groupBy("cluster_id", "norm").agg(F.min("pos").alias("pos"), F.max("last").alias("last")).withColumn("step", step), "texts")
    sized = texts.groupBy("cluster_id", "step").agg(F.count("*").alias("n"), F.sum(F.length("norm")).alias("chars"))
    blocks = stored(sized.select("cluster_id", "step", "n", F.ceil(F.greatest(F.col("n") / BLOCK, F.col("chars") / BLOCK_CHARS)).cast("long").alias("blocks")), "text-blocks")
    above = blocks.select("cluster_id", (F.col("step") - 1).alias("step"), F.col("blocks").alias("above"))
    below = blocks.select("cluster_id", (F.col("step") + 1).alias("step"), F.col("blocks").alias("below"))
    around = blocks.join(above, ["cluster_id", "step"], "left").join(below, ["cluster_id", "step"], "left").filter("n > 1 OR above IS NOT NULL OR below IS NOT NULL")
    placed = texts.join(around, ["cluster_id", "step"]).withColumn("mine", F.pmod(F.xxhash64("norm"), F.col("blocks")))

    def meets(cross: bool, side: int, first: Column, last: Column) -> Column:
        """A key for each block from ``first`` to ``last`` that a text's own meets on that side; none where there is no last."""
        pair = lambda o: (F.col("mine"), o) if side == 0 else (o, F.col("mine"))
        low = F.col("step") - 1 if cross and side else F.col("step")
        key = lambda o: F.struct(low.alias("low"), F.lit(cross).alias("cross"), pair(o)[0].alias("i"), pair(o)[1].alias("j"), F.lit(side).alias("side"))
        return F.when(first <= last, F.transform(F.sequence(first, last), key)).otherwise(F.array())

    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    keys = F.concat(
        meets(False, 0, F.col("mine"), F.col("blocks") - one), meets(False, 1, zero, F.col("mine") - one),
        meets(True, 0, zero, F.col("above") - one), meets(True, 1, zero, F.col("below") - one),
    )
    at = lambda pos: F.coalesce(F.unix_micros(f"{pos}.ts"), F.lit(-(1 << 63)))
    rest = [F.col("pos.id").alias("id"), at("pos").alias("at"), F.col("last.id").alias("last_id"), at("last").alias("last_at"), "norm"]
    dealt = placed.select("cluster_id", F.explode(keys).alias("k"), *rest).select("cluster_id", "k.low", "k.cross", "k.i", "k.j", "k.side", "id", "at", "last_id", "last_at", "norm")
    key = ["cluster_id", "low", "cross", "i", "j"]
    # A number of its own: by bytes alone few tasks would get all the work.
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = members.schema["cluster_id"].dataType.simpleString()
    return dealt.repartition(parts, *key).sortWithinPartitions(*key).mapInArrow(lambda batches: _compared_blocks(batches, by_turns), f"cluster_id {kind}, a string, b string, similar boolean")


def near_duplicate_pairs(members: DataFrame) -> DataFrame:
    """cluster_id, a, b: distinct normalised texts of a cluster that are near-duplicates, earlier first.

    Copies are one text, known by its first member in order of (ts, id), so groups of copies
    make no pairs. Lossless bounds on length and on shared q-grams come before the ratio (``compared_texts``).
    """
    return compared_texts(members).filter("similar").select("cluster_id", "a", "b")


def group_duplicate_texts(members: DataFrame) -> DataFrame:
    """cluster_id, first_id, n, norm: transitive groups of duplicate texts, single ones too.

    first_id is the group's first member, norm its text; ``report_ids`` are all, sorted. Two texts are alike if any
    report of one and a later report of the other are.
    """
    # Reports of a cluster with one text as written are one row for the rules.
    said = members.select("cluster_id", F.coalesce("raw_text", F.lit("")).alias("said"), "id", "ts")
    written = said.groupBy("cluster_id", "said").agg(F.min(F.struct("ts", "id")).alias("pos"))
    texts = stored(written.withColumn("norm", text.normalize_text(F.col("said"))), "written")
    full = texts.filter("norm <> ''")
    heads = full.groupBy("cluster_id", "norm").agg(F.min("pos").alias("pos")).withColumn("head", F.col("pos.id"))
    roots = connected_components(compared_texts(members, by_turns=True).filter("similar").select("a", "b")).withColumnRenamed("node", "head")
    placed = heads.join(roots, "head", "left").select("cluster_id", "norm", F.coalesce("root", "head").alias("root"), F.struct("pos", "norm").alias("first"))
    # Reports are many rows in few bytes of Parquet, by which they would be broadcast.
    met = said.hint("merge").join(full.select("cluster_id", "said", "norm").join(placed, ["cluster_id", "norm"]), ["cluster_id", "said"])
    # Counted apart from the list, so that who needs no list makes none; ids are made distinct before they are gathered.
    once = met.groupBy("cluster_id", "root", "id").agg(F.min("first").alias("first"))
    out = once.groupBy("cluster_id", "root").agg(F.min("first").alias("first"), F.count("id").alias("n"), F.sort_array(F.collect_list("id")).alias("report_ids"))
    out = out.select("cluster_id", F.col("first.pos.id").alias("first_id"), "n", F.col("first.norm").alias("norm"), "report_ids")
    # An empty text is like no other, so each of its reports is a group of its own.
    empty = said.join(texts.filter("norm = ''").select("cluster_id", "said"), ["cluster_id", "said"], "left_semi").select("cluster_id", "id").distinct()
    return out.unionByName(empty.select("cluster_id", F.col("id").alias("first_id"), F.lit(1).cast("long").alias("n"), F.lit("").alias("norm"), F.array("id").alias("report_ids")))


def _band_keys(bands: int, rows: int):
    """A column function from a set of hashes to one key for each band of its min-hash signature."""

    @F.pandas_udf("array<long>")
    def keys(sets: pd.Series) -> pd.Series:
        r = np.random.default_rng(0)
        a, b = (r.integers(1, 1 << 63, bands * rows, dtype=np.uint64) | np.uint64(1) for _ in range(2))
        out = []
        for s in sets:
            x = np.asarray(s, np.int64).view(np.uint64)
            least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
            for k in range(0, len(x), 4096):
                mixed = x[k : k + 4096, None] * a + b
                mixed = (mixed ^ (mixed >> np.uint64(31))) * a
                least = np.minimum(least, mixed.min(axis=0))
            folded = least.reshape(bands, rows)
            key = folded[:, 0].copy()
            for k in range(1, rows):
                key = key * np.uint64(0x9E3779B97F4A7C15) ^ folded[:, k]
            out.append(key.view(np.int64))
        return pd.Series(out, dtype="object")

    return keys


def _shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """id, s: sorted distinct hashes of the word shingles of each text of ``docs`` (id, text) that has words."""
    tokens = F.filter(F.split(text.normalize_text(F.col("text")), " "), lambda w: w != "")
    n = F.size("w") - (words - 1)
    shingles = F.array_distinct(F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.slice("w", i, words)))).otherwise(F.array(F.xxhash64("w"))))
    return docs.select("id", tokens.alias("w")).filter(F.size("w") > 0).select("id", F.sort_array(shingles).alias("s"))


def _jaccard(pairs: DataFrame, docs: DataFrame, words: int, threshold: float) -> DataFrame:
    """a, b, jaccard of those pairs of documents whose sets reach the threshold, stored.

    Sets are made again from the texts of these pairs alone, and no others travel.
    """
    pairs = stored(pairs, "bucket-pairs")
    wanted = stored(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "wanted")
    sets = stored(_shingle_sets(docs.join(wanted, "id", "left_semi"), words), "shingles")
    met = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    found = stored(met.withColumn("jaccard", both / (F.size("sa") + F.size("sb") - both)).filter(F.col("jaccard") >= threshold).select("a", "b", "jaccard").distinct(), "alike")
    discard(pairs, wanted, sets)
    return found


def near_duplicate_lsh(docs: DataFrame, bands: int = 20, rows: int = 5, words: int = 5, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(members, links): near-duplicate classes over the whole corpus by banded min-hash of word shingles.

    members: id, class_id (the smallest id of the class) of every row of ``docs`` (id, text); a
    text without words is like no other. links: a, b, jaccard of representatives of equal
    shingle sets, from which the classes follow.

    Each band of a set's signature is a key, and sets that share a key are candidates. Every set
    is first verified against the smallest of each of its buckets; what these links connect
    needs no other pair. Buckets that still hold different classes then give all pairs between
    those, so no candidate is lost: recall is that of the bands (at 0.8, 1 - (1 - 0.8 ** 5) ** 20, over 0.999).
    """
    # A set is known by 128 bits of it and its bands; whole sets are not kept.
    digest = F.unhex(F.md5(F.concat_ws(",", F.col("s").cast("array<string>"))))
    every = stored(_shingle_sets(docs, words).select("id", digest.alias("set"), _band_keys(bands, rows)(F.col("s")).alias("keys")), "signatures")
    sets = stored(every.groupBy("set").agg(F.min("id").alias("id"), F.any_value("keys").alias("keys")), "sets")
    keyed = sets.select("id", F.posexplode("keys").alias("band", "key"))
    heads = keyed.groupBy("band", "key").agg(F.min("id").alias("head"), F.count("*").alias("n")).filter("n > 1")
    met = stored(keyed.join(heads, ["band", "key"]).select("band", "key", "head", "id"), "buckets")
    star = _jaccard(met.filter("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct(), docs, words, threshold)
    placed = met.join(connected_components(star.select("a", "b")).withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    placed = stored(placed, "placed")
    open_ = placed.groupBy("band", "key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("band", "key")
    # A bucket's smallest set has been compared with all of it.
    left = stored(placed.filter("id <> head").join(open_, ["band", "key"]).select("band", "key", "id", "root"), "open")
    other = left.select("band", "key", F.col("id").alias("b"), F.col("root").alias("root_b"))
    pairs = left.withColumnRenamed("id", "a").join(other, ["band", "key"]).filter((F.col("a") < F.col("b")) & (F.col("root") != F.col("root_b"))).select("a", "b").distinct()
    links = stored(star.unionByName(_jaccard(pairs, docs, words, threshold)), "links")
    roots = connected_components(links.select("a", "b")).withColumnRenamed("node", "id")
    named = sets.select("set", "id").join(roots, "id", "left").select("set", F.coalesce("root", "id").alias("class_id"))
    members = docs.select("id").join(stored(every.select("id", "set").join(named, "set").select("id", "class_id"), "named"), "id", "left")
    return members.select("id", F.coalesce("class_id", "id").alias("class_id")), links


# ------------------------------------------------------------ images


def valid_hash(phash: Column) -> Column:
    return F.coalesce(phash.rlike("^[0-9a-fA-F]{16}$"), F.lit(False))


def hash_bits(phash: Column) -> Column:
    """16 hexadecimal characters as 64 bits in a long."""
    return F.shiftleft(F.conv(F.substring(phash, 1, 8), 16, 10).cast("long"), 32).bitwiseOR(F.conv(F.substring(phash, 9, 8), 16, 10).cast("long"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(hash_bits(a).bitwiseXOR(hash_bits(b)))


def hamming_duplicate(a: Column, b: Column, threshold: int = C.HAMMING_THRESHOLD) -> Column:
    """Within ``threshold`` bits; null where a hash is not one."""
    return F.when(valid_hash(a) & valid_hash(b), hamming(a, b) <= threshold)


def _keyed(df: DataFrame, name: str, threshold: int) -> DataFrame:
    """``df`` with the keys (k.which, k.value) of a hash: any three of its bytes.

    Hashes within ``threshold`` bits (5 at most) share at least three of their eight bytes, so such
    a pair has a key in common; a key has 2 ** 24 values for each choice of three.
    """
    if not 0 <= threshold <= 5:
        raise ValueError("keys of three bytes reach 5 bits at most")
    at = [F.shiftrightunsigned("bits", 8 * k).bitwiseAND(F.lit(255)) for k in range(8)]
    keys = [F.struct(F.lit(n).alias("which"), at[a].bitwiseOR(F.shiftleft(at[b], 8)).bitwiseOR(F.shiftleft(at[c], 16)).alias("value")) for n, (a, b, c) in enumerate(combinations(range(8), 3))]
    return df.withColumn("bits", hash_bits(F.col(name))).withColumn("k", F.explode(F.array(*keys))).select("*", "k.which", "k.value").drop("k")


def phash_similarity_join(hashes: DataFrame, threshold: int = C.HAMMING_THRESHOLD) -> DataFrame:
    """a, b (a < b): all pairs of distinct hashes within ``threshold`` bits.

    Exact, by ``_keyed``. ``hashes`` has phash; copies are one hash, so a photo that is everywhere
    makes one row.
    """
    distinct = stored(hashes.filter(valid_hash(F.col("phash"))).select(F.lower("phash").alias("phash")).distinct(), "hashes")
    keyed = _keyed(distinct, "phash", threshold)
    other = keyed.select("which", "value", F.col("phash").alias("b"), F.col("bits").alias("bits_b"))
    near = keyed.join(other, ["which", "value"]).filter((F.col("phash") < F.col("b")) & (F.bit_count(F.col("bits").bitwiseXOR(F.col("bits_b"))) <= threshold))
    return near.select(F.col("phash").alias("a"), "b").distinct()


def media_original_link(media: DataFrame) -> DataFrame:
    """report_id, is_duplicate_of: media of the smallest report among earlier near-duplicates.

    ``media`` has report_id, phash, ts; earlier means in order of (ts, report_id). Hours are summed
    up first, by partial aggregation, so a photo that is everywhere is a row for each hour; a report
    takes the smallest of the hours before its own. In its own hour it looks only at the steps of each near hash's
    running smallest report: whatever else there is comes after a smaller one.
    """
    rank = F.struct("ts", "report_id")
    hour = F.floor(F.unix_micros("ts") / 3_600_000_000).cast("long")
    lower = stored(media.filter(valid_hash(F.col("phash"))).select("report_id", "ts", F.lower("phash").alias("phash"), hour.alias("hour")), "media")
    pairs = stored(phash_similarity_join(lower), "hash-pairs")
    near = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(lower.select(F.col("phash").alias("a"), F.col("phash").alias("b")).distinct())
    hourly = stored(lower.groupBy("phash", "hour").agg(F.min("report_id").alias("least")), "hourly")
    earlier = W.partitionBy("phash").orderBy("hour").rowsBetween(W.unboundedPreceding, -1)
    own = hourly.select("phash", "hour", F.min("least").over(earlier).alias("before"))
    low = lower.join(own, ["phash", "hour"]).filter(F.col("before").isNull() | (F.col("report_id") < F.col("before")))
    within = F.min("report_id").over(W.partitionBy("phash", "hour").orderBy("ts", "report_id").rowsBetween(W.unboundedPreceding, -1))
    steps = low.withColumn("within", within).filter(F.col("within").isNull() | (F.col("report_id") < F.col("within")))
    around = near.join(hourly.withColumnRenamed("phash", "b"), "b").groupBy(F.col("a").alias("phash"), "hour").agg(F.min("least").alias("least"))
    before = around.select("phash", "hour", F.min("least").over(earlier).alias("before"))
    shown = near.join(steps.select(F.col("phash").alias("b"), "hour", rank.alias("step")), "b").select(F.col("a").alias("phash"), "hour", "step")
    same = lower.join(shown, ["phash", "hour"]).filter(F.col("step") < rank).groupBy("report_id").agg(F.min("step.report_id").alias("same"))
    met = lower.join(before, ["phash", "hour"]).join(same, "report_id", "left")
    return met.select("report_id", "phash", F.concat(F.lit("med_"), F.least("before", "same")).alias("is_duplicate_of"))


def recycled_media(hashes: DataFrame, known: DataFrame) -> DataFrame:
    """phash, matched_source: the first known source, in order, within the threshold.

    Distinct hashes meet the registry on equal bands, as in ``phash_similarity_join``.
    """
    base = stored(hashes.filter(valid_hash(F.col("phash"))).select(F.lower("phash").alias("phash")).distinct(), "hashes")
    registry = known.filter(valid_hash(F.col("phash"))).select("source", F.lower("phash").alias("known"))
    met = _keyed(base, "phash", C.HAMMING_THRESHOLD).drop("bits").join(_keyed(registry, "known", C.HAMMING_THRESHOLD).drop("bits"), ["which", "value"])
    return met.filter(hamming(F.col("phash"), F.col("known")) <= C.HAMMING_THRESHOLD).groupBy("phash").agg(F.min("source").alias("matched_source"))


def image_groups(members: DataFrame) -> DataFrame:
    """cluster_id, phash, root: distinct images of each cluster and the group they belong to.

    Near hashes link only through images of the same cluster.
    """
    images = members.filter(valid_hash(F.col("phash"))).select("cluster_id", F.lower("phash").alias("phash")).distinct()
    pairs = phash_similarity_join(images)
    links = pairs.join(images.withColumnRenamed("phash", "a"), "a").join(images.withColumnRenamed("phash", "b"), ["b", "cluster_id"])
    node = lambda c: F.concat_ws("|", "cluster_id", c)
    roots = connected_components(links.select(node("a").alias("a"), node("b").alias("b")))
    return images.withColumn("node", node("phash")).join(roots, "node", "left").select("cluster_id", "phash", F.coalesce("root", "node").alias("root"))


def duplicate_image_groups(members: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """cluster_id, unique_images, duplicate_image_groups (groups that 2 or more reports show); ``images``: ``image_groups`` if there."""
    shown = members.filter(valid_hash(F.col("phash"))).select("cluster_id", F.lower("phash").alias("phash"), "id")
    sizes = shown.join(images if images is not None else image_groups(members), ["cluster_id", "phash"]).groupBy("cluster_id", "root").agg(F.count("*").alias("n"))
    return sizes.groupBy("cluster_id").agg(F.count("*").alias("unique_images"), F.count_if(F.col("n") > 1).alias("duplicate_image_groups"))
