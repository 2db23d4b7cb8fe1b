"""Column functions over report texts. All are native expressions, no user functions.

Word characters, boundaries and spaces are Unicode classes spelt out, because Java's own
classes are ASCII ones.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch import constants as C

_WORD = r"\p{L}\p{N}_"
_SPACE = r"\p{IsWhite_Space}\x1c-\x1f"


def java(pattern: str, flags: str = "iud") -> str:
    """A pattern of ``constants`` as a Java regex with Unicode classes; ``d``: only \\n ends a line."""
    out, k, inside = [], 0, False
    while k < len(pattern):
        two = pattern[k : k + 2]
        if two in (r"\w", r"\s") and inside:
            out.append(_WORD if two == r"\w" else _SPACE)
        elif two in (r"\w", r"\W", r"\s", r"\S"):
            out.append({r"\w": f"[{_WORD}]", r"\W": f"[^{_WORD}]", r"\s": f"[{_SPACE}]", r"\S": f"[^{_SPACE}]"}[two])
        elif two == r"\b":
            # The patterns have word characters on the inner side, so one look is enough, and
            # a look behind first leaves only the beginnings of words to try.
            opens = pattern[k + 2 : k + 3].isalnum() or pattern[k + 2 : k + 3] in ("(", "\\")
            out.append(f"(?<![{_WORD}])" if opens else f"(?![{_WORD}])")
        elif two[0] == "\\":
            out.append(two)
        else:
            inside = (inside or two[0] == "[") and two[0] != "]"
            out.append(two[0])
            k -= 1
        k += 2
    return f"(?{flags})" + "".join(out)


def found(text: Column, pattern: str) -> Column:
    """Whether the pattern occurs in the text; a null text has no match."""
    return F.coalesce(text.rlike(java(pattern)), F.lit(False))


def first_match(text: Column, pattern: str, group: int = 0) -> Column:
    """The first match, null if none."""
    return F.nullif(F.regexp_extract(text, java(pattern), group), F.lit(""))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, java(r"^\s+|\s+$", "d"), "")


def one_spaced(text: Column) -> Column:
    return strip(F.regexp_replace(text, java(r"\s+", "d"), " "))


def strip_repost_prefix(text: Column) -> Column:
    return F.regexp_replace(text, java(C.REPOST_PREFIX), "")


def is_noise(text: Column) -> Column:
    """Nothing but marks, or words of sympathy at the start; blank and null too."""
    text = F.coalesce(text, F.lit(""))
    return text.rlike(java(C.NOISE))


def detect_hazard(text: Column) -> Column:
    """The first hazard in order that the text names; null if none."""
    chain = reduce(lambda c, h: c.when(found(text, C.HAZARD_PATTERNS[h]), h), C.HAZARDS[1:], F.when(found(text, C.HAZARD_PATTERNS[C.HAZARDS[0]]), C.HAZARDS[0]))
    return chain.otherwise(F.lit(None).cast("string"))


def detect_trapped(text: Column) -> Column:
    """Largest count of people, if the text says that someone is trapped; else null."""
    words = F.create_map(*[F.lit(x) for pair in C.NUMBER_WORDS.items() for x in pair])
    tokens = F.regexp_extract_all(text, F.lit(java(C.TRAPPED_COUNT)), F.lit(1))
    counts = F.transform(tokens, lambda t: F.coalesce(F.try_element_at(words, F.lower(t)), t.try_cast("int")))
    return F.when(found(text, C.TRAPPED_VERBS), F.array_max(counts))


def detect_landmark(text: Column) -> Column:
    """A named landmark, else the name after a preposition, cut at the first clause word."""
    named = [F.initcap(one_spaced(first_match(text, p, 1))) for p in C.NAMED_LANDMARKS]
    after = first_match(text, C.PREPOSITION_LANDMARK, 1)
    words = F.filter(F.split(F.get(F.split(after, java(C.CLAUSE_WORD)), F.lit(0)), java(r"\s+", "d")), lambda w: w != "")
    name = F.regexp_replace(F.array_join(F.slice(words, 1, 4), " "), "^[ .,;:-]+|[ .,;:-]+$", "")
    usable = (F.length(name) >= 3) & ~F.lower(name).isin(C.STOP_LANDMARKS)
    return F.coalesce(*named, F.when(usable, name))


def detect_resources(text: Column) -> Column:
    return F.filter(F.array(*[F.when(found(text, p), n) for n, p in C.RESOURCE_PATTERNS.items()]), lambda r: r.isNotNull())


def detect_access(text: Column) -> Column:
    return found(text, C.ACCESS_IMPEDIMENT)


def detect_time_hint(text: Column) -> Column:
    return first_match(text, C.TIME_HINT)


def normalize_text(text: Column) -> Column:
    """Text for comparison: no repost prefix, links, mentions, marks; lower case, single spaces."""
    text = F.regexp_replace(F.coalesce(text, F.lit("")), java(C.NORMALIZE_PREFIX), "")
    for pattern in (C.URL, C.MENTION):
        text = F.regexp_replace(text, java(pattern), "")
    return one_spaced(F.regexp_replace(F.lower(text), f"[^{_WORD}{_SPACE}]", " "))


def author(source_user: Column) -> Column:
    """Author for comparison: trimmed, one leading @ off, lower case."""
    return F.lower(F.regexp_replace(strip(source_user), "^@", ""))


def repost_origin(text: Column) -> Column:
    """The author whom a repost names as its origin; null if none."""
    return F.lower(F.regexp_replace(first_match(text, C.REPOST_ORIGIN, 1), "^@", ""))


def compose_report_text(tags: Column, danger: Column, description: Column, landmark: Column) -> Column:
    """Text of a report form; parts that are blank are left out."""
    blank = F.lit(None).cast("string")
    return F.concat_ws(
        " ",
        F.transform(tags, lambda t: F.concat(F.lit("["), t, F.lit("]"))),
        F.when(danger != "None", F.concat(F.lit("["), danger, F.lit(" people in danger]"))).otherwise(blank),
        F.nullif(F.trim(description), F.lit("")),
        F.when(F.trim(landmark) != "", F.concat(F.lit("Near "), F.trim(landmark), F.lit("."))).otherwise(blank),
    )
