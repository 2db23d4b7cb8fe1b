"""Quality rules: a threshold table compiled into one Spark projection.

``measures`` turns a text column into counts with built-in functions only. ``RULES`` is a
table of (name, numerator, denominator, least, most) over these counts, the bounds in
hundredths so that every comparison is one of whole numbers. ``verdict`` compiles any such
table into one boolean expression. Nothing is shuffled and no user function is called, so
a text of any length is judged where it is read.

Cases: a null, empty or blank text has no words, so it fails the base rule; a null doc_id
and repeated rows are judged as they are; an empty table gives an empty result; other
columns are passed over.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import common

WINDOW = 8
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30

# The commonest function words of English, French, Spanish and German.
STOP_WORDS = """
a an and are as at be by for from have he in is it not of on or that the this to was were with
au aux ce dans de des du elle en est et il la le les ne pas par pour que qui sur un une
al con del el ella es esta las lo los más no para pero por se sin su sus una uno y
aber als auch auf das dem den der des die ein eine für im ist mit nicht sich sie und von zu
""".split()

#: (name, numerator, denominator, least and most percent of the denominator; None: open).
RULES: list[tuple[str, str, str, int | None, int | None]] = [
    ("mean_word_length", "word_chars", "n_words", 200, 1500),
    ("symbols", "n_symbols", "n_words", None, 10),
    ("stop_words", "n_stop_words", "n_words", 1, None),
    ("duplicate_lines", "n_dup_lines", "n_lines", None, 50),
    ("ellipsis_lines", "n_ellipsis_lines", "n_lines", None, 30),
    ("bullet_lines", "n_bullet_lines", "n_lines", None, 90),
    ("capitals", "n_capitals", "word_chars", None, 50),
    ("words_with_letters", "n_letter_words", "n_words", 70, None),
]


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def measures(docs: DataFrame, keep: list[str], window_hash: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """``keep`` columns of ``docs`` and the counts of its text, each a long.

    Windows of words are sorted by ``window_hash``. Neighbours of one hash are compared by their
    words; a text where some differ has its windows sorted by hash and words, so counts are exact.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words, lines = F.col("tw_words"), F.col("tw_lines")
    base = docs.select(*keep, text.alias("tw_text")).withColumns({
        "tw_words": common.word_array(F.col("tw_text")),
        "tw_lines": F.filter(F.split("tw_text", "\n"), lambda x: x.rlike("[^ \\t-\\r]")),
    })
    n_windows = F.size(words) - (WINDOW - 1)
    hashes = F.when(n_windows > 1, F.transform(F.sequence(F.lit(1), n_windows), lambda i: window_hash(F.slice(words, i, WINDOW))))
    hashed = base.withColumn("tw_hashes", hashes)
    places = F.transform("tw_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    repeats = F.size(F.array_distinct("tw_hashes")) < F.size("tw_hashes")
    sorted_ = hashed.withColumn("tw_sorted", F.when(repeats, F.sort_array(places)))
    window = lambda e: F.slice(words, e["i"] + 1, WINDOW)
    other = lambda e, i: (F.get("tw_sorted", i - 1)["h"] == e["h"]) & (window(F.get("tw_sorted", i - 1)) != window(e))
    collide = F.size(F.filter("tw_sorted", other)) > 0
    worded = F.when(collide, F.sort_array(F.transform("tw_sorted", lambda e: F.struct(e["h"].alias("h"), window(e).alias("w"), e["i"].alias("i")))))
    sorted_ = sorted_.withColumn("tw_worded", worded)
    met = F.filter("tw_sorted", lambda e, i: (F.get("tw_sorted", i - 1)["h"] == e["h"]) | (F.get("tw_sorted", i + 1)["h"] == e["h"]))
    same = F.filter("tw_worded", lambda e, i: (F.get("tw_worded", i - 1)["w"] == e["w"]) | (F.get("tw_worded", i + 1)["w"] == e["w"]))
    starts = F.sort_array(F.when(F.col("tw_worded").isNull(), F.transform(met, lambda e: e["i"])).otherwise(F.transform(same, lambda e: e["i"])))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, x: F.struct((x + WINDOW).alias("end"), (a["n"] + x + WINDOW - F.greatest(a["end"], x)).alias("n")),
        lambda a: a["n"],
    )
    plain = F.col("tw_text")
    counts = {
        "n_words": F.size(words),
        "word_chars": _without(plain, common.BLANKS),
        "n_symbols": F.length(plain) - _without(plain, SYMBOLS),
        "n_lines": F.size(lines),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": F.coalesce(covered, F.lit(0)),
        "n_stop_words": F.size(F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS))),
        "n_ellipsis_lines": F.size(F.filter(lines, lambda x: x.rlike("(\\.\\.\\.|…)[ \\t-\\r]*$"))),
        "n_bullet_lines": F.size(F.filter(lines, lambda x: x.rlike("^[ \\t-\\r]*[-*•]"))),
        "n_capitals": F.length(plain) - F.length(F.regexp_replace(plain, "\\p{Lu}+", "")),
        "n_letter_words": F.size(F.filter(words, lambda w: w.rlike("\\p{L}"))),
    }
    return sorted_.select(*keep, *[c.cast("long").alias(n) for n, c in counts.items()])


def verdict(rules: list[tuple[str, str, str, int | None, int | None]] = RULES) -> Column:
    """One boolean expression over the columns of ``measures``: true if no rule is broken."""
    passed = F.lit(True)
    for _, top, bottom, least, most in rules:
        if least is not None:
            passed = passed & (F.col(top) * 100 >= F.col(bottom) * least)
        if most is not None:
            passed = passed & (F.col(top) * 100 <= F.col(bottom) * most)
    return passed


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)


def judge(docs: DataFrame, keep: list[str], rules=RULES) -> DataFrame:
    """``keep`` columns, the counts, base_failed and kept for every row of ``docs``."""
    return measures(docs, keep).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: counts and verdict of every whole text."""
    judged = judge(common.documents(spark, sf_dir).select("doc_id", "text"), ["doc_id"])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql_rules() -> str:
    parts = []
    for _, top, bottom, least, most in RULES:
        if least is not None:
            parts.append(f"{top} * 100 >= {bottom} * {least}")
        if most is not None:
            parts.append(f"{top} * 100 <= {bottom} * {most}")
    return " AND ".join(parts)


_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)

OP8_SQL = f"""
WITH base AS (
  SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t,
    list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
  FROM documents),
words AS (SELECT r, unnest(w) AS word, unnest(range(len(w))) AS i FROM base),
windows AS (
  SELECT r, i, list(word) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS win FROM words),
twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS c FROM windows WHERE len(win) = {WINDOW}) WHERE c > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, range({WINDOW}) AS s(k) GROUP BY r),
counts AS (
  SELECT doc_id, len(w) AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
    length(t) - length(translate(t, '{SYMBOLS}', '')) AS n_symbols, len(l) AS n_lines,
    len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
    len(list_filter(w, lambda x: lower(x) IN ({_STOPS}))) AS n_stop_words,
    len(list_filter(l, lambda x: regexp_matches(x, '(\\.\\.\\.|…)[\\x20\\x09-\\x0D]*$'))) AS n_ellipsis_lines,
    len(list_filter(l, lambda x: regexp_matches(x, '^[\\x20\\x09-\\x0D]*[-*•]'))) AS n_bullet_lines,
    length(t) - length(regexp_replace(t, '\\p{{Lu}}', '', 'g')) AS n_capitals,
    len(list_filter(w, lambda x: regexp_matches(x, '\\p{{L}}'))) AS n_letter_words
  FROM base LEFT JOIN covered USING (r)),
judged AS (
  SELECT *, n_words < {MIN_WORDS} OR n_repeat_words * 100 > n_words * {MAX_REPEAT_PERCENT} AS base_failed FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {_sql_rules()} AS kept
FROM judged
"""
