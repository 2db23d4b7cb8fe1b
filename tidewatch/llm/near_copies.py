"""Near copies by the exact Jaccard similarity of word shingles, found by a prefix join.

A text is its set of hashed shingles of five words; two texts are near copies from a
similarity of 4/5. Two such sets of n and m shingles share ceil(4 (n + m) / 9) of them at least, so
one of the first n + 1 less that many of the one is among the first m + 1 less that many of the other, whatever
the order of shingles, as long as all sets have the same (prefix filter). With two places more they share three of
these (``MEET``), and what shares fewer is no pair. Nothing is lost:

* The order is by how many of a sample of the documents have a shingle, in ``HOT`` steps, then by hash. Common
  lines are thus in a prefix only where a text is little else. The sample changes the work,
  never the result. Tasks get it as tables of bits of a fixed size.
* The entry of a shingle at place p of a set of n serves sets of up to (5 n - 9 (p - 2)) / 4 shingles alone. Of a posting
  only entries stay that serve another and are served. A template that many texts share, each with too much
  of its own for 4/5, stands behind what is their own in each, where its entries serve none: such texts meet nowhere.
* Equal sets are one, whatever their number.
* Each set is first verified against ``FIRST`` of all offered with which it shares most, and ``FIRST`` most central ones: each posting
  offers the ``HEADS`` most central of its sets, of whose shingles the most are in postings. In a group of
  copies with changes of their own these are the least changed, which are near copies of more of the group than copies
  taken by chance. What these links connect needs no further pair; in postings that still hold members of different components
  the entries meet those of the sizes they serve. A group of near copies costs a star. Texts that share what is
  in many, are made of little else and are no near copies cost their pairs.
* Candidates pass an upper bound on what they share, by bit maps of 2 to 4 bits for each
  shingle: a bit that one map has and the other has not is a shingle that they don't share. Only what
  is left is verified on whole sets of 64-bit hashes, made again from the texts of candidates alone.

Cases: a null, empty or blank text has no shingles and is a near copy of none; fewer than five words are one shingle;
a null doc_id, repeated rows and other columns don't matter here; texts are hashed whole in blocks, however
long they or their words are; an empty table gives no links.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from tidewatch.llm import common, simhash
from tidewatch.operators.components import connected_components

WORDS = 5
#: Share of documents that are sampled for hot shingles, and texts in it from which one is hot, hotter, hottest.
SAMPLE, HOT = 0.1, (8, 64, 512)
#: Shingles hashed at once, and bits (2 to the power of) of the largest table of hot shingles or candidates that goes to tasks.
_BLOCK, _TABLE = 1 << 16, 26
#: Prefix entries that a task packs at once.
_PACK = 1 << 19
#: Postings in which two near copies meet at least, if their sets differ: such sets share four shingles or more.
MEET = 3
#: Sets that each posting offers. Of those offered each set is verified against so many that share most with it, and so many most
#: central ones, before any pairs of a posting are made.
HEADS, FIRST = 8, 3
#: Ratio of the sizes that are one step of a posting's scale of sizes.
SIZE_STEP = 1.04
#: Bytes from which a word is hashed by itself.
_LONG = 512

_random = np.random.default_rng(42)
_VALUES = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + _random.integers(0, 2, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grown(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64, ``n`` or more."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(2 * n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; fewer words than five are one shingle, no words none.

    Words are those of ``simhash.fingerprint``. All words are hashed by one running sum that is polynomial in
    their bytes (long ones by XXH64: there, regular strings could collide), mixed, and mixed again by fives.
    """
    words = (text or "").encode("utf-8", "surrogatepass").translate(simhash._ASCII_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    parts, width, before = [], min(WORDS, len(words)), np.empty(0, np.uint64)
    for at in range(0, len(words), _BLOCK):
        h = np.concatenate([before, _word_hashes(words[at : at + _BLOCK])])
        n = len(h) - width + 1
        if n > 0:
            mixed = np.zeros(n, np.uint64)
            for k in range(width):
                mixed = _mix((mixed ^ h[k : k + n]) * np.uint64(_BASE))
            parts.append(np.unique(mixed))
        before = h[max(0, n) :]
    return np.unique(np.concatenate(parts))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _word_hashes(words: list[bytes]) -> np.ndarray:
    short = [w if len(w) < _LONG else b"" for w in words]
    sizes = np.fromiter(map(len, short), np.int64, len(short))
    line = np.frombuffer(b"".join(short), np.uint8)
    ends = np.cumsum(sizes)
    up, down = _grown(len(line) + 1)
    total = np.append(np.uint64(0), np.cumsum(_VALUES[line] * up[: len(line)]))
    h = _mix((total[ends] - total[ends - sizes]) * down[ends - sizes] + sizes.astype(np.uint64) * np.uint64(_BASE))
    for k in np.flatnonzero(sizes == 0):  # words are never empty
        h[k] = xxhash.xxh64_intdigest(words[k], simhash.SEED)
    return h


class Bits:
    """A set of longs by their leading bits: has all that are in it, and a few others."""

    def __init__(self, table: np.ndarray, lead: int):
        self.table, self.lead = table, lead

    @classmethod
    def of(cls, longs: DataFrame) -> "Bits":
        """Of the column ``id``; the table is summed up in tasks and has ``2 ** _TABLE`` bits at most."""
        lead = int(np.clip(np.ceil(np.log2(16 * max(1, longs.count()))), 12, _TABLE))
        slot = F.shiftrightunsigned("id", 64 - lead)
        words = longs.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(id, {64 - lead}) & 63 AS int))")).alias("bits"))
        table = np.zeros(1 << (lead - 6), np.uint64)
        said = words.toArrow()
        table[said["word"].to_numpy()] = said["bits"].to_numpy().view(np.uint64)
        return cls(table, lead)

    def has(self, values: np.ndarray) -> np.ndarray:
        slot = values >> np.uint64(64 - self.lead)
        return (self.table[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)


def _longest(n):
    """How many shingles of a set of n are in its longest prefix."""
    return np.minimum(n, n - (4 * n + 4) // 5 + MEET)


def _prefix(s: np.ndarray, hot: list[Bits]) -> np.ndarray:
    """The shingles of which two near copies share ``MEET``: the first in the common order."""
    heat = np.zeros(len(s), np.int8)
    for bits in hot:
        heat += bits.has(s)
    s = s[np.argsort(heat, kind="stable")]
    return s[: _longest(len(s))] if len(s) else s


def _set_id(s: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(s.tobytes(), simhash.SEED)


def _longs(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def hot_shingles(docs: DataFrame) -> list[Bits]:
    """The shingles that many sampled texts have, by steps of ``HOT``."""

    def each(batches):
        for batch in batches:
            for text in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(text.as_py()).view(np.int64))], names=["id"])

    keys = docs.sample(SAMPLE, 42).select(F.col("text").cast("string")).mapInArrow(each, "id long")
    found = common.stored(keys.groupBy("id").count().filter(F.col("count") >= HOT[0]), "hot")
    return [Bits.of(found.filter(F.col("count") >= n).select("id")) for n in HOT]


def _bit_map(s: np.ndarray) -> bytes:
    """A bit for each value of the lowest bits of the hashes: a power of two of them, twice as many as hashes at least."""
    m = max(64, 1 << int(2 * len(s) - 1).bit_length()) if len(s) else 64
    bits = np.zeros(m, np.uint8)
    bits[(s & np.uint64(m - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def _most_shared(a: bytes, b: bytes, n: int, m: int) -> int:
    """An upper bound on how many of their n and m shingles two sets share."""
    x, y = int.from_bytes(a, "little"), int.from_bytes(b, "little")
    p, q = 8 * len(a), 8 * len(b)
    while p > q:
        p //= 2
        x = x & ((1 << p) - 1) | x >> p
    while q > p:
        q //= 2
        y = y & ((1 << q) - 1) | y >> q
    return min(n - (x & ~y).bit_count(), m - (y & ~x).bit_count())


@F.pandas_udf(BooleanType())
def _may_share(a: pd.Series, b: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
    """False where the bit maps rule out that sets of n and m shingles are near copies."""
    return pd.Series([9 * _most_shared(*row) >= 4 * (row[2] + row[3]) for row in zip(a, b, n, m)], dtype=bool)


@F.pandas_udf(BooleanType())
def _near(a: pd.Series, b: pd.Series) -> pd.Series:
    out = []
    for x, y in zip(a, b):
        x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        out.append(9 * len(np.intersect1d(x, y, assume_unique=True)) >= 4 * (len(x) + len(y)))
    return pd.Series(out, dtype=bool)


def marks(docs: DataFrame) -> DataFrame:
    """doc_id, fp (as ``simhash.fingerprints``), set_id, n (shingles), bits (their bit map); stored."""

    def each(batches):
        for batch in batches:
            texts = [t.as_py() for t in batch.column(1)]
            sets = [shingle_set(t) for t in texts]
            columns = [batch.column(0), _longs([simhash.fingerprint(t) for t in texts]), _longs([_set_id(s) for s in sets])]
            columns += [pa.array([len(s) for s in sets], pa.int64()), pa.array([_bit_map(s) for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "fp", "set_id", "n", "bits"])
        common.release()

    found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return common.stored(found.mapInArrow(each, "doc_id long, fp long, set_id long, n long, bits binary"), "marks", compression="zstd")


def _postings(docs: DataFrame) -> DataFrame:
    """key, id, n, most: the sets of each shingle that is in the prefix of two or more that serve each other, stored.

    An entry serves sets of up to ``most`` shingles. Entries go through one shuffle in packs, with their
    places in 256ths of the prefix, rounded down; those that serve none end there.
    """
    hot, width = hot_shingles(docs), common.parallelism(docs)
    parts = 8 * width

    def packs(held):
        ids, ns = np.array(list(held), np.uint64), np.array([n for n, _ in held.values()], np.uint32)
        keys, sizes = np.concatenate([p for _, p in held.values()]), np.array([len(p) for _, p in held.values()])
        owner = np.repeat(np.arange(len(ids)), sizes)
        place = ((np.arange(len(keys)) - np.repeat(np.cumsum(sizes) - sizes, sizes)) * 256 // np.repeat(sizes, sizes)).astype(np.uint8)
        part = ((keys * np.uint64(_BASE)) >> np.uint64(33)).astype(np.int64) % parts
        order = np.argsort(part, kind="stable")
        bounds, rows = np.searchsorted(part[order], np.arange(parts + 1)), []
        for k in np.flatnonzero(np.diff(bounds)):
            at = order[bounds[k] : bounds[k + 1]]
            mine, local = np.unique(owner[at], return_inverse=True)
            rows.append((int(k), keys[at].tobytes(), place[at].tobytes(), local.astype(np.uint16).tobytes(), ids[mine].tobytes(), ns[mine].tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n else pa.int64()) for n, c in enumerate(zip(*rows))], names=["part", "keys", "places", "owner", "ids", "ns"])

    def deal(batches):
        held, size = {}, 0
        for batch in batches:
            for text in batch.column(0):
                s = shingle_set(text.as_py())
                if len(s) and (id_ := _set_id(s)) not in held:
                    held[id_] = (len(s), _prefix(s, hot))
                    size += len(held[id_][1])
                    if size >= _PACK or len(held) >= 60_000:
                        yield packs(held)
                        held, size = {}, 0
        if held:
            yield packs(held)
        common.release()

    def meet(batches):
        keys, places, owner, ids, ns, base = [], [], [], [], [], 0
        for batch in batches:
            for k, p, o, i, n in zip(*(batch.column(c).to_pylist() for c in range(1, 6))):
                keys.append(np.frombuffer(k, np.uint64))
                places.append(np.frombuffer(p, np.uint8))
                owner.append(np.frombuffer(o, np.uint16).astype(np.int32) + np.int32(base))
                ids.append(np.frombuffer(i, np.uint64))
                ns.append(np.frombuffer(n, np.uint32))
                base += len(ids[-1])
        if keys:
            keys, places, owner, ids, ns = (np.concatenate(x) for x in (keys, places, owner, ids, ns))
            _, back, times = np.unique(keys, return_inverse=True, return_counts=True)
            often = times[back] > 1
            keys, places, owner = keys[often], places[often], owner[often]
            del back
            order = np.lexsort((ids[owner], keys))
            keys, places, owner = keys[order], places[order].astype(np.int64), owner[order]
            id_ = ids[owner]
            fresh = np.append(True, (keys[1:] != keys[:-1]) | (id_[1:] != id_[:-1])) if len(keys) else np.zeros(0, bool)
            keys, places, id_, n = keys[fresh], places[fresh], id_[fresh], ns[owner[fresh]].astype(np.int64)
            most = (5 * n - 9 * (places * _longest(n) // 256 - MEET + 1)) // 4
            for _ in range(3):
                at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
                if not len(at):
                    break
                held = np.diff(np.append(at, len(keys)))
                stay = (most >= np.repeat(np.minimum.reduceat(n, at), held)) & (n <= np.repeat(np.maximum.reduceat(most, at), held)) & np.repeat(held > 1, held)
                if stay.all():
                    break
                keys, id_, n, most = keys[stay], id_[stay], n[stay], most[stay]
            keys, id_ = keys.view(np.int64), id_.view(np.int64)
            for at in range(0, len(keys), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(c[at : at + (1 << 16)]) for c in (keys, id_, n, most)], names=["key", "id", "n", "most"])
        common.release()

    dealt = docs.select(F.col("text").cast("string")).mapInArrow(deal, "part long, keys binary, places binary, owner binary, ids binary, ns binary")
    return common.stored(dealt.repartition(width, "part").mapInArrow(meet, "key long, id long, n long, most long"), "postings")


def _sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id, s: the whole sets of the ids (and a few others)."""
    wanted = Bits.of(ids)

    def each(batches):
        for batch in batches:
            found = {}
            for text in batch.column(0):
                id_ = _set_id(s := shingle_set(text.as_py()))
                if id_ not in found and wanted.has(np.array([id_], np.uint64))[0]:
                    found[id_] = s.tobytes()
            if found:
                yield pa.RecordBatch.from_arrays([_longs(list(found)), pa.array(list(found.values()), pa.binary())], names=["id", "s"])
        common.release()

    return docs.select(F.col("text").cast("string")).mapInArrow(each, "id long, s binary")


def _verified(pairs: DataFrame, docs: DataFrame, maps: DataFrame) -> DataFrame:
    """Those of the pairs (a, b, with their sizes n, m) that are near copies, stored.

    The sets of ``a`` go to ``b``'s place once each; copies of a set are put together there.
    """
    by = lambda name, side: maps.select(F.col("id").alias(name), F.col("bits").alias(side))
    sized = pairs.filter((F.col("a") < F.col("b")) & (5 * F.least("n", "m") >= 4 * F.greatest("n", "m"))).select("a", "b", "n", "m").distinct()
    may = common.stored(sized.join(by("a", "ka"), "a").join(by("b", "kb"), "b").filter(_may_share("ka", "kb", "n", "m")).select("a", "b"), "candidates")
    sets = common.stored(_sets(docs, may.select(F.explode(F.array("a", "b")).alias("id")).distinct()).groupBy("id").agg(F.first("s").alias("s")), "sets")
    met = may.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    near = common.stored(met.filter(_near("sa", "sb")).select("a", "b"), "near")
    common.discard(may, sets)
    return near


def set_links(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """Pairs (a, b) of set ids, all near copies, that connect all near copies."""
    met = _postings(docs)
    maps = marked.filter("n > 0").select(F.col("set_id").alias("id"), "bits")
    maps = common.stored(maps.groupBy("id").agg(F.first("bits").alias("bits")), "maps", compression="zstd")
    # The fewer shingles a set has to itself, the more others are near it.
    central = met.join(met.groupBy("id").agg(F.count("*").alias("met")), "id").withColumn("met", F.col("met") / F.col("n"))
    place = F.row_number().over(W.partitionBy("key").orderBy(F.desc("met"), F.xxhash64("id")))
    offer = F.struct(F.col("id").alias("head"), F.col("n").alias("size"), F.col("most").alias("serves"), "met")
    heads = central.withColumn("place", place).filter(F.col("place") <= HEADS).groupBy("key").agg(F.collect_list(offer).alias("offers"))
    serves = F.filter("offers", lambda o: (o["head"] != F.col("id")) & (o["size"] <= F.col("most")) & (F.col("n") <= o["serves"]))
    star = met.join(heads, "key").select("id", "n", F.explode(serves).alias("o")).select("id", "n", "o.*")
    # A few pairs for each set at first, those with most in common; whatever they leave open is among the rest.
    shared = star.groupBy("id", "n", "head", "size", "met").agg(F.count("*").alias("keys")).filter(F.col("keys") >= MEET)
    by = lambda *order: F.row_number().over(W.partitionBy("id").orderBy(*order, F.xxhash64("head")))
    best = shared.withColumn("alike", by(F.desc("keys"))).withColumn("middle", by(F.desc("met"))).filter(F.least("alike", "middle") <= FIRST)
    low = F.col("id") < F.col("head")
    best = best.select(F.least("id", "head").alias("a"), F.greatest("id", "head").alias("b"), F.when(low, F.col("n")).otherwise(F.col("size")).alias("n"), F.when(low, F.col("size")).otherwise(F.col("n")).alias("m"))
    first = _verified(best, docs, maps)
    roots = connected_components(first)
    placed = met.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    placed = common.stored(placed, "placed")
    open_ = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("key")
    left = common.stored(placed.join(open_, "key"), "open")
    # Of two sets the smaller one looks among the sizes it serves, by steps of a geometric scale.
    scale = lambda n: F.floor(F.log(F.col(n).cast("double")) / F.log(F.lit(SIZE_STEP))).cast("int")
    leads = left.filter("most >= n").select("key", F.col("id").alias("a"), "n", "most", "root", F.explode(F.sequence(scale("n") - 1, scale("most") + 1)).alias("step"))
    other = left.select("key", scale("n").alias("step"), F.col("id").alias("b"), F.col("n").alias("m"), F.col("most").alias("serves"), F.col("root").alias("root_b"))
    serves = F.col("m").between(F.col("n"), F.col("most")) & (F.col("n") <= F.col("serves")) & (F.col("root") != F.col("root_b")) & ((F.col("n") < F.col("m")) | (F.col("a") < F.col("b")))
    # A posting that two components share is open, so none in which a pair meets is missing here.
    rest = leads.join(other, ["key", "step"]).filter(serves).groupBy("a", "b", "n", "m").agg(F.count("*").alias("keys")).filter(F.col("keys") >= MEET)
    rest = rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(F.col("a") < F.col("b"), F.col("n")).otherwise(F.col("m")).alias("n"), F.when(F.col("a") < F.col("b"), F.col("m")).otherwise(F.col("n")).alias("m"))
    near = common.stored(first.unionByName(_verified(rest, docs, maps)), "near")
    common.discard(met, maps, placed, left)
    return near


def links(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """Pairs (a, b) of fingerprints whose texts are near copies, or have equal shingle sets; stored."""
    owners = common.stored(marked.filter("n > 0").select(F.col("set_id").alias("id"), "fp").distinct(), "owners")
    first = owners.groupBy("id").agg(F.min("fp").alias("least"))
    copies = owners.join(first, "id").filter("fp <> least").select(F.col("least").alias("a"), F.col("fp").alias("b"))
    near = set_links(docs, marked).join(first.select(F.col("id").alias("a"), F.col("least").alias("fa")), "a").join(first.select(F.col("id").alias("b"), F.col("least").alias("fb")), "b")
    return common.stored(copies.unionByName(near.select(F.col("fa").alias("a"), F.col("fb").alias("b"))).filter("a <> b").distinct(), "links")
