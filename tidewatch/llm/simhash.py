"""SimHash near-duplicates by an inverted index of fingerprint bytes at their positions.

Fingerprints of 64 bits link when 2 bits or fewer differ. Two such fingerprints share at
least 6 of their 8 positional bytes. A posting of one positional byte would hold a 256th of
all fingerprints, so an entry of the index is four positional bytes together. Of the 70 sets
of four positions, 14 are taken such that every three positions lie in exactly one: those
whose numbers have an exclusive or of 0. Two fingerprints that share 8, 7, 6, 5 positional
bytes then meet in 14, 7, 3, 1 entries, and with fewer in 1 at most. So the tally of shared
entries says how many positional bytes a pair shares, and a linked pair reaches 3.

* Fingerprints are made distinct before anything is paired: a group of copies is one
  entry, whatever its size.
* Postings of up to ``posting`` fingerprints emit their pairs. Spark tallies the entries that
  each pair shares; pairs below the guaranteed 3 are dropped, the rest is verified bit by bit.
* A larger posting is never paired. Its fingerprints are keyed by themselves and their 64
  one-bit changes instead: two fingerprints within 2 bits share such a key, and all that
  share one are within 2 bits of each other. Such a key has at most 65 members and gives
  them a star of links, which is exact and linear in the posting. A linked pair either meets
  in some larger posting, and then both take this way, or in small ones alone, where its
  tally is whole: ``posting`` changes the work, never the result.

Components come from ``operators.components``.

Cases: null, empty or blank texts have fingerprint zero and link like any other; fewer
than three words make one shingle of the whole sequence; a null doc_id is a document but
never a component's id unless no other is there; repeated rows are all kept; an empty
table gives an empty result; other columns are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tidewatch.llm import common
from tidewatch.operators.components import connected_components

SHINGLE_WORDS, SEED, MAX_BITS = 3, 42, 2
#: A posting with more fingerprints takes the way of one-bit changes.
POSTING = 64
#: Entries of the index: every three of the eight positions are in exactly one.
ENTRIES = [e for e in combinations(range(8), 4) if e[0] ^ e[1] ^ e[2] ^ e[3] == 0]
#: Entries that two linked fingerprints share at least.
SHARED_ENTRIES = min(sum(not touched & set(e) for e in ENTRIES) for touched in map(set, combinations(range(8), MAX_BITS)))

_ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BLANK_TO_SPACE = bytes(32 if 9 <= b <= 13 else b for b in range(256))
#: Shingles hashed before their bits are tallied: bounds memory for long texts.
_TALLY = 1 << 14


def fingerprint(text: str | None, words_each: int = SHINGLE_WORDS) -> int:
    """Majority bits of the XXH64 (seed 42) of the text's word shingles, repeats counted."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(_ASCII_LOWER).translate(_BLANK_TO_SPACE)
    words = [w for w in raw.split(b" ") if w]
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= words_each:
        return xxhash.xxh64_intdigest(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    firsts, lasts = starts[: len(words) - words_each + 1].tolist(), ends[words_each - 1 :].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(firsts), _TALLY):
        hashes = np.array([digest(line[a:b], SEED) for a, b in zip(firsts[at : at + _TALLY], lasts[at : at + _TALLY])], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    set_bits = ones * 2 > len(firsts)
    return int(np.packbits(set_bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a signed long). Narrow: no shuffle."""

    def hashed(batches):
        for batch in batches:
            values = np.array([fingerprint(t.as_py()) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.int64())], names=["doc_id", "fp"])
        common.release()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(hashed, "doc_id long, fp long")


def _entries(fp):
    """The positional bytes of each entry and its number, as one long each."""
    at = [F.shiftrightunsigned(fp, 8 * k).bitwiseAND(F.lit(255)) for k in range(8)]

    def entry(n: int, places: tuple[int, ...]):
        key = F.lit(n << 32)
        for k, place in enumerate(places):
            key = key.bitwiseOR(F.shiftleft(at[place], 8 * k))
        return key.cast("long")

    return F.array(*[entry(n, places) for n, places in enumerate(ENTRIES)])


def _postings(distinct: DataFrame) -> DataFrame:
    """fp, key, n: the entries that two fingerprints or more share, with how many; stored."""
    index = distinct.select("fp", F.explode(_entries(F.col("fp"))).alias("key"))
    sizes = index.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    return common.stored(index.join(sizes, "key"), "postings")


def tallies(met: DataFrame, posting: int = POSTING) -> DataFrame:
    """a, b, shared: how many postings of up to ``posting`` fingerprints each pair has in common."""
    return (
        met.filter(F.col("n") <= posting)
        .groupBy("key")
        .agg(F.sort_array(F.collect_list("fp")).alias("fps"))
        .select(F.col("fps"), F.posexplode("fps").alias("at", "a"))
        .select("a", F.explode(F.slice("fps", F.col("at") + 2, F.lit(posting))).alias("b"))
        .groupBy("a", "b")
        .agg(F.count("*").alias("shared"))
    )


def links(distinct: DataFrame, posting: int = POSTING) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints (column fp) that connect all within 2 bits.

    Every linked pair is either given or joined by a path of given pairs; no pair that is
    further apart is given.
    """
    met = _postings(distinct)
    enough = tallies(met, posting).filter(F.col("shared") >= SHARED_ENTRIES).select("a", "b")
    verified = enough.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS)
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << k if k < 63 else -(1 << 63)).cast("long") for k in range(64)])
    crowded = met.filter(F.col("n") > posting).select("fp").distinct()
    stars = (
        crowded.select("fp", F.explode(flips).alias("flip"))
        .select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("key"))
        .groupBy("key")
        .agg(F.min("fp").alias("a"), F.collect_set("fp").alias("fps"))  # 65 at most
        .filter(F.size("fps") > 1)
        .select("a", F.explode("fps").alias("b"))
        .filter("a <> b")
    )
    return verified.unionByName(stars).distinct()


def _rooted(hashed: DataFrame, posting: int, more: DataFrame | None = None) -> DataFrame:
    """fp, first_id (smallest doc_id with it), root (fingerprint naming its component), stored."""
    distinct = common.stored(hashed.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    found = links(distinct.select("fp"), posting)
    member = common.stored(connected_components(found if more is None else found.unionByName(more)), "components")
    rooted = distinct.join(member.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    return common.stored(rooted, "rooted")


def near_duplicates(docs: DataFrame, posting: int = POSTING) -> DataFrame:
    """doc_id, fp, root (fingerprint naming the component), component_id, one row per document.

    component_id is the smallest doc_id of the component.
    """
    hashed = common.stored(fingerprints(docs), "fingerprints")
    rooted = _rooted(hashed, posting)
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = common.stored(rooted.join(least, "root").select("fp", "root", "component_id"), "named")
    # Both sides are read from files, so Spark can split the partition of a hot fingerprint.
    return hashed.join(named, "fp").select("doc_id", "fp", "root", "component_id")


@F.pandas_udf(LongType())
def _fingerprint(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64), dtype="int64")
    common.release()


def representatives(docs: DataFrame, posting: int = POSTING, hashed: DataFrame | None = None, more: DataFrame | None = None) -> DataFrame:
    """Rows of ``docs``, all columns, that stand for their component: one for each.

    The document with the smallest doc_id stays; of rows that repeat it, one. ``hashed`` are the
    stored ``fingerprints`` where the caller has them, ``more`` further links (a, b) of fingerprints.

    Rows are found by doc_id. Only those whose doc_id is not theirs alone (a null one too) are
    told apart by the fingerprint of their text, and only they are made distinct.
    """
    hashed = common.stored(fingerprints(docs), "fingerprints") if hashed is None else hashed
    rooted = _rooted(hashed, posting, more)
    first = F.min(F.struct(F.col("first_id").isNull().alias("no_id"), "first_id", "fp")).alias("least")
    keepers = common.stored(rooted.groupBy("root").agg(first).select(F.col("least.first_id").alias("tw_id"), F.col("least.fp").alias("tw_kept")), "keepers")
    again = hashed.groupBy(F.col("doc_id").alias("tw_id")).agg(F.count("*").alias("tw_n")).filter("tw_n > 1 OR tw_id IS NULL").select("tw_id")
    again = common.stored(again, "repeated")
    docs, as_before = common.aside(docs)
    own = F.col("doc_id").cast("long").eqNullSafe(F.col("tw_id"))
    alone = docs.join(keepers.join(again, keepers["tw_id"].eqNullSafe(again["tw_id"]), "left_anti"), own, "left_semi")
    marked = docs.join(again, own, "left_semi").withColumn("tw_fp", _fingerprint(F.col("text").cast("string")))
    told = marked.join(keepers, (F.col("tw_fp") == F.col("tw_kept")) & own, "left_semi").dropDuplicates(["doc_id", "tw_fp"])
    return as_before(alone.unionByName(told.drop("tw_fp")))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: fingerprint and component of every document."""
    found = near_duplicates(common.documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
