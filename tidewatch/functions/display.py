"""What the incident views show, as native column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Next responder action of each state: label, icon and the state it leads to.
NEXT_ACTION = {
    "UNACKNOWLEDGED": ("Acknowledge Incident", "assignment_turned_in", "ACKNOWLEDGED"),
    "ACKNOWLEDGED": ("Dispatch Responders", "send", "DISPATCHED"),
    "DISPATCHED": ("Resolve Incident", "task_alt", "RESOLVED"),
}


def _half_up(x: Column) -> Column:
    """Nearest whole number, halves up, also below zero."""
    return F.floor(x + 0.5).cast("long")


def relative_time(ts: Column, now: Column) -> Column:
    minutes = _half_up((F.unix_micros(now) - F.unix_micros(ts)) / 60_000_000)
    hours, text = _half_up(minutes / 60), lambda n, s: F.concat(n.cast("string"), F.lit(s))
    days = _half_up(hours / 24)
    return (
        F.when(minutes < 1, "just now")
        .when(minutes < 60, text(minutes, " min ago"))
        .when(hours < 24, text(hours, " hr ago"))
        .otherwise(F.concat(text(days, " day"), F.when(days == 1, "").otherwise("s"), F.lit(" ago")))
    )


def distance(metres: Column) -> Column:
    tenths = _half_up(metres / 100)
    return F.when(metres < 1000, F.concat(_half_up(metres).cast("string"), F.lit("m"))).otherwise(
        F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit("km"))
    )


def percent(x: Column) -> Column:
    return F.concat(_half_up(x * 100).cast("string"), F.lit("%"))


def title_resource(name: Column) -> Column:
    return F.array_join(F.transform(F.split(name, "_"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1_000_000))), " ")


def confidence_tone(score: Column) -> Column:
    return F.when(score >= 70, "green").when(score >= 40, "amber").otherwise("critical")


def evidence_line(contradiction: Column, geo: Column, media: Column) -> Column:
    clauses = F.concat_ws(
        " · ",
        F.when(geo >= 0.7, "Strong geo agreement").when(geo >= 0.4, "Moderate geo agreement").otherwise("Weak geo agreement"),
        F.when(media >= 0.5, "Fresh media verified").otherwise("No fresh media"),
        F.lit("No contradiction detected"),
    )
    icon = F.when((geo >= 0.7) & (media >= 0.5), "verified").when(geo < 0.4, "warning").otherwise("check_circle")
    return F.when(contradiction, F.struct(F.lit("cancel").alias("icon"), F.lit("Contradiction detected in cluster").alias("text"))).otherwise(
        F.struct(icon.alias("icon"), clauses.alias("text"))
    )


def next_action(state: Column, part: int) -> Column:
    """Part 0: label, 1: icon, 2: state; null for a state without one."""
    return F.try_element_at(F.create_map(*[F.lit(x) for s, a in NEXT_ACTION.items() for x in (s, a[part])]), state)
