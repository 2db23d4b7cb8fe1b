"""Quality classifier: regularised quadratic discriminant over document statistics.

Each text gives a vector of transformed statistics (logarithms and log-odds of lengths,
ratios and repetition). Spark sums counts, vectors and outer products by class over all
labelled rows outside the held-out fold; from these the driver makes class means and class
covariances, shrunk towards the pooled and the spherical one, and their Cholesky factors. A
score is the logistic function of the difference of the two Mahalanobis log-densities with
log priors. Training reads every labelled row and gathers a few hundred numbers.

The held-out fold is crc32(doc_id as text) mod 5 = 0. Labels, language, source and doc_id
never enter a score.

Cases: a null or blank text has the statistics of an empty one and is scored like any
other; a null doc_id counts as the empty text in the fold rule and is never labelled;
several labels of one document: the highest counts; where a class has fewer than two
labelled rows, every score is the smoothed share of label 1; repeated rows are all scored;
an empty table gives an empty result; other columns are passed over.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import common

FOLDS, ACCEPT = 5, 0.3
#: Shares of the pooled and of the spherical covariance in a class's covariance.
SHRINK_POOLED, SHRINK_SPHERE = 0.05, 0.05

_SYMBOLS = "#*$%&|<>"
_PUNCTUATION = ".,;:?"
_LOUD = "!"

# The commonest function words of English, French, Spanish and German.
_FUNCTION_WORDS = frozenset(
    "a an and are as at be by for from have he in is it not of on or that the this to was were with "
    "au aux ce dans de des du elle en est et il la le les ne pas par pour que qui sur un une "
    "al con del el ella es esta las lo los más no para pero por se sin su sus una uno y "
    "aber als auch auf das dem den der des die ein eine für im ist mit nicht sich sie und von zu".split()
)

NAMES = (
    "words", "word_length", "word_length_spread", "symbols", "loud", "punctuation", "capitals", "digits",
    "function_words", "distinct_words", "commonest_word", "distinct_pairs", "repeated_lines", "line_words", "letters", "symbol_words",
)


def _odds(part: float, whole: float) -> float:
    """Smoothed log-odds of a share."""
    return float(np.log((part + 0.5) / (max(whole - part, 0) + 0.5)))


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of one whole text, in the order of ``NAMES``."""
    text = text or ""
    words = text.split()
    n, chars = len(words), sum(map(len, words))
    lengths = np.fromiter(map(len, words), np.float64, n) if n else np.zeros(1)
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    ends = sum(w[-1] in "#*$%&|<>!" for w in words)
    upper = sum(map(str.isupper, words))
    return [
        float(np.log1p(n)),
        float(np.log1p(lengths.mean())),
        float(np.log1p(lengths.std())),
        _odds(sum(map(text.count, _SYMBOLS)), chars),
        _odds(sum(map(text.count, _LOUD)), chars),
        _odds(sum(map(text.count, _PUNCTUATION)), chars),
        _odds(upper, n),
        _odds(sum(map(text.count, "0123456789")), chars),
        _odds(sum(counts[w] for w in _FUNCTION_WORDS if w in counts), n),
        _odds(len(counts), n),
        _odds(max(counts.values(), default=0), n),
        _odds(len(set(zip(words, words[1:]))), max(n - 1, 0)),
        _odds(len(lines) - len(set(lines)), len(lines)),
        float(np.log1p(n / max(len(lines), 1))),
        _odds(sum(map(str.isalpha, words)), n),
        _odds(ends, n),
    ]


def doc_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, x array<double>: the statistics of every text. Narrow: no shuffle."""

    def each(batches):
        for batch in batches:
            rows = [statistics(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "x"])
        common.release()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(each, "doc_id long, x array<double>")


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


class Model:
    """Two Gaussians with cached inverse Cholesky factors."""

    def __init__(self, moments: dict[int, tuple[float, np.ndarray, np.ndarray]]):
        n0, n1 = (moments.get(c, (0.0,))[0] for c in (0, 1))
        self.share = (n1 + 1) / (n0 + n1 + 2)
        self.ready = n0 >= 2 and n1 >= 2
        if not self.ready:
            return
        n, total, square = (sum(moments[c][k] for c in (0, 1)) for k in range(3))
        self.centre = total / n
        spread = np.sqrt(np.maximum(np.diag(square) / n - self.centre**2, 0))
        # Below this a spread is what rounding leaves of a constant.
        self.scale = np.where(spread > 1e-6 * (1 + np.abs(self.centre)), spread, 1.0)
        classes = {}
        for c in (0, 1):
            count, s, q = moments[c]
            mean = s / count
            cov = (q / count - np.outer(mean, mean)) / np.outer(self.scale, self.scale)
            level, turn = np.linalg.eigh((cov + cov.T) / 2)
            classes[c] = (count, (mean - self.centre) / self.scale, (turn * np.maximum(level, 0)) @ turn.T)
        pooled = sum(k * cov for k, _, cov in classes.values()) / n
        self.parts = []
        for c in (0, 1):
            count, mean, cov = classes[c]
            cov = (1 - SHRINK_POOLED - SHRINK_SPHERE) * cov + SHRINK_POOLED * pooled
            cov = cov + (SHRINK_SPHERE * np.trace(pooled) / len(mean) + 1e-6) * np.eye(len(mean))
            factor = np.linalg.cholesky(cov)
            self.parts.append((mean, np.linalg.inv(factor), -np.log(np.diag(factor)).sum() + np.log(count / n)))

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of statistics."""
        if not self.ready:
            return np.full(len(x), self.share)
        z = (x - self.centre) / self.scale
        log = [constant - 0.5 * (((z - mean) @ inverse.T) ** 2).sum(axis=1) for mean, inverse, constant in self.parts]
        return 1 / (1 + np.exp(-np.clip(log[1] - log[0], -60, 60)))


def train(stats: DataFrame, labels: DataFrame) -> Model:
    """Fit on every labelled row outside the held-out fold. ``stats`` comes from ``doc_statistics``."""
    d = len(NAMES)
    marks = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("y"))
    rows = stats.filter(~held_out(F.col("doc_id"))).join(marks, "doc_id").select("y", "x")

    def partial(batches):
        sums = {}
        for batch in batches:
            y = batch.column(0).to_numpy(zero_copy_only=False)
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            for c in np.unique(y):
                own = np.column_stack([np.ones((y == c).sum()), x[y == c]])
                sums[int(c)] = sums.get(int(c), 0) + own.T @ own
        for c, m in sums.items():
            at = np.arange(m.size)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m.size, c)), pa.array(at), pa.array(m.reshape(-1))], names=["y", "at", "v"])

    # Whole numbers of 2 ** -40 add up the same in any order of tasks.
    unit = float(1 << 40)
    summed = rows.mapInArrow(partial, "y long, at long, v double").groupBy("y", "at").agg((F.sum((F.col("v") * unit).cast("decimal(38,0)")).cast("double") / unit).alias("v"))
    moments: dict[int, np.ndarray] = {}
    for r in summed.collect():  # 2 * (d + 1)^2 numbers
        moments.setdefault(r["y"], np.zeros((d + 1) ** 2))[r["at"]] = r["v"]
    grids = {c: m.reshape(d + 1, d + 1) for c, m in moments.items()}
    return Model({c: (g[0, 0], g[0, 1:], g[1:, 1:]) for c, g in grids.items()})


def scorer(model: Model):
    """A column function from a text to its score."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            x = np.array([statistics(t) for t in texts], np.float64).reshape(-1, len(NAMES))
            yield pd.Series(model.scores(x), dtype="float64")
        common.release()

    return score


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    stats = common.stored(doc_statistics(docs), "statistics")
    model = train(stats, labels)

    def each(batches):
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(x), pa.float64())], names=["doc_id", "score"])

    scored = stats.mapInArrow(each, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs``, all columns, that the classifier accepts."""
    model = train(doc_statistics(docs), labels)
    return docs.filter(scorer(model)(F.col("text").cast("string")) >= ACCEPT)


def op7_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: a quality score of every whole text."""
    return classify(common.documents(spark, sf_dir), common.table(spark, sf_dir, "labels"))
