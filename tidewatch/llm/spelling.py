"""Spelling variants by blocked Gram matrices of letter counts.

One inserted, deleted or replaced letter changes the vector of a word's letter counts by one at
one or two places, so the squared distance of two near words' vectors is 2 at most. Squared
distances of two blocks of words all come from one matrix product. Pairs that pass it (anagrams,
say) are verified letter by letter.

Blocks. Lengths of near words differ by one at most, so only blocks of adjacent lengths can hold near
words. A block is finer than a length: it also fixes how many letters fall in each of ``CLASSES`` classes
(by code point). The edit moves these sums by one in one class, or by one in each of two, so a block
meets itself, the longer blocks with one more letter in a class, and of those with one letter
moved between two classes one of each two that face each other. That is all, and each pair of words meets once.

Tiles. A block is cut into tiles of up to ``TILE`` words and ``TILE_CHARS`` letters by hash, however large
it is. A tile is one packed row. It is sent to the tiles it has to meet; there the tile that stays
is first and the others stream by, a matrix product for every ``TILE`` words, so a task holds two tiles and
their product. Words, counts and links never go to one task.

Forms. A word's form is its near word with the largest count, if that is ``RATIO`` times its own or more.
Counts grow along forms, so these chains end; they are followed by doubling.

Cases: a null text has no words and a null doc_id counts as ``null`` where the doc_id's digits would stand;
rows that repeat count each; a run that the deletion leaves too short is gone; very long texts and
runs are read whole; where all counts tie the smaller word is the near word named; an empty table gives an
empty result; other columns are passed over.
"""

from __future__ import annotations

import re
import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import common

#: Fewest code points and occurrences of a word, and how much larger the count of its form is.
LEAST_CHARS, LEAST_TIMES, RATIO = 6, 5, 5
#: Runs whose hash this divides lose a letter.
EVERY = 199
#: Classes of letters that tell blocks of one length apart.
CLASSES = 4
#: Words and letters of a tile.
TILE, TILE_CHARS = 2048, 1 << 18
#: Distinct words that a task counts before it hands them on, and letters compared at once in verifying.
_HELD, _LETTERS = 200_000, 1 << 22

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_RUN = re.compile(rb"[a-z\xc0-\xff]{%d,}" % LEAST_CHARS)


def words_of(doc_id: int | None, text: str | None) -> list[bytes]:
    """The text's runs of at least ``LEAST_CHARS`` letters as Latin-1, in lower case, some with a letter less.

    All letters are Latin-1; what is not becomes a question mark, which ends a run as well.
    """
    runs = _RUN.findall((text or "").encode("latin-1", "replace").translate(_LOWER))
    crc, seed, hashes, out = zlib.crc32, zlib.crc32(f"{'null' if doc_id is None else doc_id}:".encode()), {}, []
    for run in runs:
        h = hashes.get(run)
        if h is None:
            h = hashes[run] = crc(run if run.isascii() else run.decode("latin-1").encode(), seed)
        if h % EVERY == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < LEAST_CHARS:
                continue
        out.append(run)
    return out


def vocabulary(docs: DataFrame, least: int = LEAST_TIMES) -> DataFrame:
    """word, n of all words with ``least`` occurrences or more; counted in the scan before they are shuffled."""

    def count(batches):
        held: dict[bytes, int] = {}

        def flush():
            batch = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held]), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return batch

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for w in words_of(doc_id, text.as_py()):
                    held[w] = held.get(w, 0) + 1
                if len(held) >= _HELD:
                    yield flush()
        if held:
            yield flush()
        common.release()

    found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def _class_sums(word):
    """How many letters of a word fall in each class of code points."""
    letters = F.transform(F.split(word, ""), lambda c: F.pmod(F.ascii(c), F.lit(CLASSES)))
    return [F.size(F.filter(letters, lambda c: c == k)) for k in range(CLASSES)]  # noqa: B023


def _steps() -> list[tuple[int, ...]]:
    """From a block's sums to those of the blocks it meets, itself first."""
    unit = np.eye(CLASSES, dtype=int)
    return [tuple(map(int, s)) for s in [unit[0] * 0, *unit, *(unit[a] - unit[b] for a, b in combinations(range(CLASSES), 2))]]


def tiles(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The packed tiles (block, tile, chars, words, ns) and how many each block has (block, cut); both stored."""
    sums = F.array(*[s.cast("int") for s in _class_sums(F.col("word"))])
    placed = common.stored(words.select("word", "n", sums.alias("block"), F.length("word").alias("chars")), "placed")
    most = F.greatest(F.lit(1), F.least(F.lit(TILE), F.floor(F.lit(TILE_CHARS) / F.col("chars"))))
    cuts = common.stored(placed.groupBy("block").agg(F.first("chars").alias("chars"), F.count("*").alias("held")).select("block", F.ceil(F.col("held") / most).alias("cut")), "cuts")
    # A row of cuts has a tile of its block to each of its words: no group is larger than that.
    dealt = placed.join(cuts, "block").withColumn("tile", F.pmod(F.xxhash64("word"), "cut"))
    packed = dealt.groupBy("block", "tile").agg(F.first("chars").alias("chars"), F.collect_list(F.struct("word", "n")).alias("w"))
    return common.stored(packed.select("block", "tile", "chars", F.col("w.word").alias("words"), F.col("w.n").alias("ns")), "tiles"), cuts


class Words:
    """Words as rows of a matrix of letter counts, with squared lengths so that one product gives distances."""

    def __init__(self, words: list[str], ns: list[int]):
        raw = [w.encode("latin-1") for w in words]
        self.words, self.ns = words, ns
        self.sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        self.flat = np.frombuffer(b"".join(raw), np.uint8)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def counts(self, letters: np.ndarray, kind: type) -> np.ndarray:
        owner = np.repeat(np.arange(len(self.sizes)), self.sizes)
        cells = np.bincount(owner * len(letters) + np.searchsorted(letters, self.flat), minlength=len(self.sizes) * len(letters))
        return cells.reshape(len(self.sizes), len(letters)).astype(kind)

    def letter(self, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.flat[self.starts[rows][:, None] + at]


def close(a: Words, b: Words, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a and b whose letter counts are within a squared distance of 2; in one tile, each pair once."""
    letters = np.unique(np.concatenate([a.flat, b.flat]))
    kind = np.float32 if max(a.sizes.max(), b.sizes.max()) < 2000 else np.float64  # sums of squares stay exact
    x, y = a.counts(letters, kind), b.counts(letters, kind)
    gram = x @ y.T
    gram -= (x * x).sum(1)[:, None] / 2
    gram -= (y * y).sum(1)[None, :] / 2
    i, j = np.nonzero(gram >= -1)
    return (i[i < j], j[i < j]) if same else (i, j)


def verified(a: Words, b: Words, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the pairs differ by one inserted, deleted or replaced letter."""
    out, most = np.zeros(len(i), bool), int(max(a.sizes.max(), b.sizes.max()))
    some = max(1, _LETTERS // most)
    for k in range(0, len(i), some):
        p, q = i[k : k + some], j[k : k + some]
        m, n = a.sizes[p], b.sizes[q]
        short = np.minimum(m, n)
        step = np.arange(int(short.max()))
        inside = step[None, :] < short[:, None]
        ahead = np.where(inside, step, 0)
        differ = (a.letter(p, ahead) != b.letter(q, ahead)) & inside
        back = lambda size: np.where(inside, size[:, None] - 1 - step, 0)
        behind = (a.letter(p, back(m)) != b.letter(q, back(n))) & inside
        first = np.where(differ.any(1), differ.argmax(1), short)  # equal letters in front, and at the end
        last = np.where(behind.any(1), behind.argmax(1), short)
        out[k : k + some] = np.where(m == n, differ.sum(1) == 1, (abs(m - n) == 1) & (first + last >= short))
    return out


def near_pairs(words: DataFrame) -> DataFrame:
    """a, n_a, b, n_b: each pair of near words (word, n) once; stored."""
    packed, cuts = tiles(words)
    # What a tile is sent to: the tiles of the blocks that meet its block.
    moves = F.explode(F.array(*[F.struct(F.lit(k).alias("move"), F.array(*[F.col("block")[c] - s[c] for c in range(CLASSES)]).alias("home")) for k, s in enumerate(_steps())]))
    to = packed.select("*", moves.alias("m")).select("*", "m.*").drop("m").filter(F.forall("home", lambda s: s >= 0))
    met = to.join(cuts.select(F.col("block").alias("home"), F.col("cut").alias("cuts")), "home")
    # Of two tiles of one block the smaller one stays.
    first = F.when(F.col("move") == 0, F.col("tile")).otherwise(F.col("cuts") - 1)
    sent = met.select("home", F.explode(F.sequence(F.lit(0).cast("long"), first)).alias("stays"), F.when(F.col("move") == 0, F.col("tile")).otherwise(-1).alias("own"), "words", "ns")
    stays = (F.col("own") == F.col("stays")).alias("is_home")
    dealt = sent.select("home", "stays", stays, "words", "ns").repartition("home", "stays").sortWithinPartitions("home", "stays", F.desc("is_home"))

    def meet(batches):
        here, held, place = None, [], None

        def pairs(other: Words, same: bool):
            i, j = close(here, other, same)
            good = verified(here, other, i, j)
            i, j = i[good].tolist(), j[good].tolist()
            if i:
                columns = [[here.words[k] for k in i], [here.ns[k] for k in i], [other.words[k] for k in j], [other.ns[k] for k in j]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "n_a", "b", "n_b"])

        def flush():
            if held:
                yield from pairs(Words(*(sum((h[k] for h in held), []) for k in (0, 1))), False)
                held.clear()

        for batch in batches:
            homes, stays, first, words, ns = (c.to_pylist() for c in batch.columns)
            for h, t, is_home, w, n in zip(homes, stays, first, words, ns):
                if is_home:
                    yield from flush()
                    here, place = Words(w, n), (h, t)
                    yield from pairs(here, True)
                elif place == (h, t):  # else the tile has no words of its own
                    held.append((w, n))
                    if sum(len(x[0]) for x in held) >= TILE or sum(map(len, w)) >= TILE_CHARS:
                        yield from flush()
        yield from flush()
        common.release()

    return common.stored(dealt.mapInArrow(meet, "a string, n_a long, b string, n_b long"), "near-words")


def variants(words: DataFrame, pairs: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of all ``words`` (word, n) from their near ``pairs``."""
    both = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("m")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("m"))))
    best = pairs.select(both.alias("x")).select("x.*").groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("best"))
    of = words.join(best, "word", "left").withColumn("has", F.coalesce(-F.col("best.m") >= ratio * F.col("n"), F.lit(False)))
    form = lambda c: F.when(F.col("has"), c)
    named = common.stored(of.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form(F.col("best.near")).alias("form"), form(-F.col("best.m")).alias("form_n")), "forms")
    jump = named.filter("form IS NOT NULL").select("word", F.col("form").alias("to"))
    while True:  # each round doubles how far a jump goes
        seen = Observation()
        on = jump.select(F.col("word").alias("to"), F.col("to").alias("further"))
        now = common.stored(jump.join(on, "to", "left").select("word", F.coalesce("further", "to").alias("to"), "further").observe(seen, F.count("further").alias("moved")), "roots")
        jump = now.select("word", "to")
        if not seen.get["moved"]:
            break
    roots = named.join(jump, "word", "left")
    return roots.select("word", "form", F.coalesce("to", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: every frequent word of the documents with its form and root."""
    words = common.stored(vocabulary(common.documents(spark, sf_dir)), "words")
    return variants(words, near_pairs(words))


OP13_SQL = r"""
WITH RECURSIVE runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents),
d AS (SELECT doc_id, run, count(*) AS times FROM runs WHERE length(run) >= 6 GROUP BY doc_id, run),
h AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(regexp_extract_all(hex(encode(doc_id || ':' || run)), '..'),
      lambda x: list_transform([0, 1, 2, 3, 4, 5, 6, 7], lambda k: ((('0x' || x)::INTEGER >> k) & 1)::BIGINT)))),
      lambda a, b: xor(a >> 1, 3988292384::BIGINT * (xor(a, b) & 1))), 4294967295::BIGINT) AS h
  FROM d),
w AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::INTEGER) || substr(run, (h % length(run))::INTEGER + 2) ELSE run END AS word, times FROM h),
v AS (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM w WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5),
cut AS (SELECT word, n, substr(word, 1, k - 1) AS l, substr(word, k + 1) AS r FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS k FROM v)),
e AS (
  SELECT a.word, b.word AS near, b.n AS m FROM cut a JOIN cut b ON a.l = b.l AND a.r = b.r AND a.word <> b.word
  UNION SELECT a.word, v.word, v.n FROM cut a JOIN v ON a.l || a.r = v.word
  UNION SELECT v.word, a.word, a.n FROM cut a JOIN v ON a.l || a.r = v.word),
best AS (SELECT word, count(*) AS n_near, min({'m': -m, 'near': near}) AS best FROM e GROUP BY word),
f AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.m >= 5 * n THEN best.near END AS form, CASE WHEN -best.m >= 5 * n THEN -best.m END AS form_n
  FROM v LEFT JOIN best ON v.word = best.word),
c AS (
  SELECT word, word AS now FROM f
  UNION ALL SELECT c.word, f.form FROM c JOIN f ON c.now = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.now AS root, f.n, f.n_near, f.form_n
FROM f JOIN c ON f.word = c.word JOIN f AS last ON c.now = last.word WHERE last.form IS NULL
"""
