"""Pins of unresolved reports from direct pins nearby in time, without listing a report's candidates.

The candidates of a report are all direct pins of its type within ``NEARBY_WINDOW_S``. Around each
stand those within twice the allowed spread, and the one largest such group that is tight enough
gives its centroid.

* Pins fall in cells of space (cubes around the globe, so no pole and no date line is special) and of report times, and
  each pin is sent to the cells that it may reach. A task gets the pins of one cell and its surroundings.
* In a cell, pins of one place are one, with a number that changes as the window slides. Numbers of neighbours at all steps
  are one matrix product. A tight group is in reach of each of its pins, so a pin is passed over where one of its neighbours
  has fewer neighbours than it: what is left is tested, the largest first. Only the largest tight group of each step
  leaves the task (and one more where it is tied), as an interval of report times: at most two rows for each moment at which a
  pin enters or leaves.
* Groups and reports of a type meet in spans of 80 minutes, in order of time; a heap holds the groups that have begun. Numbers of
  candidates are differences of running counts.

What is in one task is a cell (the pins of a type within about two kilometres and two hours, by blocks of half a
kilometre), then the groups of a type in one span.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch import constants as C
from tidewatch.operators.runs import runs
from tidewatch.sources.storage import stored

#: Microseconds on each side of a report, and metres between neighbours.
WINDOW, REACH = C.NEARBY_WINDOW_S * 1_000_000, 2 * C.NEARBY_SPREAD_M
#: Edges of a cell in metres and microseconds.
CELL_M, CELL_T = 8.0 * REACH, 4 * WINDOW
#: Microseconds of the nodes of ``_cover``, each a multiple of the one before: fifths up to 1/64 s, then halves up to 2048 s.
LEVELS = [5**k for k in range(6)] + [5**6 * 2**k for k in range(18)]

_CELL = ["type", "cx", "cy", "cz", "ct"]


def _cover(lo: Column, hi: Column) -> Column:
    """Nodes (size, start) that make up the moments from lo up to but not including hi."""
    up = lambda x, s: x + F.pmod(-x, s)
    down = lambda x, s: x - F.pmod(x, s)

    def between(a: Column, b: Column, s: Column) -> Column:
        return F.when(a < b, F.sequence(a, b - s, s)).otherwise(F.array().cast("array<long>"))

    def of(level: Column) -> Column:
        s, p = level["size"], level["above"]
        a, b, inner_a, inner_b = up(lo, s), down(hi, s), up(lo, p), down(hi, p)
        starts = F.when(inner_a < inner_b, F.concat(between(a, inner_a, s), between(inner_b, b, s))).otherwise(between(a, b, s))
        return F.transform(starts, lambda x: F.struct(s.alias("size"), x.alias("start")))

    sizes = [F.struct(F.lit(s).cast("long").alias("size"), F.lit(p).cast("long").alias("above")) for s, p in zip(LEVELS, [*LEVELS[1:], 1 << 60])]
    return F.flatten(F.transform(F.array(*sizes), of))


def _far(lat1, lon1, lat2, lon2):
    """Metres between places in radians."""
    a = np.sin((lat2 - lat1) / 2) ** 2 + np.cos(lat1) * np.cos(lat2) * np.sin((lon2 - lon1) / 2) ** 2
    return 2 * C.EARTH_RADIUS_GEO_M * np.arcsin(np.sqrt(np.clip(a, 0.0, 1.0)))


def _far_from(lat, lon):
    """Metres between all pairs of places in radians."""
    return _far(lat[:, None], lon[:, None], lat[None, :], lon[None, :])


def _globe(lat, lon) -> np.ndarray:
    return C.EARTH_RADIUS_GEO_M * np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)], axis=-1)


def _blocks(xyz: np.ndarray, home: np.ndarray):
    """(places of a block and its surroundings, which of them are its own): few places are one block."""
    if len(xyz) <= 256:
        yield np.arange(len(xyz)), home
        return
    cut = np.floor(xyz / (2.0 * REACH)).astype(np.int64)
    for corner in np.unique(cut[home], axis=0):
        low, high = corner * (2.0 * REACH), (corner + 1) * (2.0 * REACH)
        near = np.flatnonzero(((xyz >= low - REACH - 1.0) & (xyz < high + REACH + 1.0)).all(axis=1))
        yield near, home[near] & (cut[near] == corner).all(axis=1)


def tight_in_cell(at, lat, lon, radius, one, two, home, begin, end):
    """The largest tight group of a cell as arrays (lo, hi, n, one, two, lat, lon, spread, reach), for the report times from lo up to hi, all in begin to end.

    Where another group is as large, it stands there too. ``one`` and ``two`` are hashes of pins, the sums of which
    name a set. Pins of one place and radius are one place with a number that changes over time.
    """
    spots, place = np.unique(np.stack([lat, lon, radius], axis=1), axis=0, return_inverse=True)
    place = place.reshape(-1)
    own = np.zeros(len(spots), bool)
    own[place[home]] = True
    xyz = _globe(np.radians(spots[:, 0]), np.radians(spots[:, 1]))
    for near, mine in _blocks(xyz, own):
        to = np.full(len(spots), -1)
        to[near] = np.arange(len(near))
        pins = np.flatnonzero(to[place] >= 0)
        p, q = np.radians(spots[near, 0]), np.radians(spots[near, 1])
        far = _far_from(p, q)
        links, wide = far <= REACH, far <= REACH + 0.01
        yield from _over_time(at[pins], to[place[pins]], one[pins], two[pins], spots[near], xyz[near] - xyz[near[0]], xyz[near[0]], links, wide, mine, begin, end)


def _over_time(at, place, one, two, spots, xyz, origin, links, wide, mine, begin, end):
    """``tight_in_cell`` for one block, by halves of the time where the table of times and places is large."""
    alive = (at + WINDOW >= begin) & (at - WINDOW < end)
    if np.count_nonzero(alive) < C.NEARBY_MIN_SAMPLES:
        return
    at, place, one, two = at[alive], place[alive], one[alive], two[alive]
    marks = np.unique(np.concatenate([at - WINDOW, at + WINDOW + 1, [begin]]))
    marks = marks[(marks >= begin) & (marks < end)]
    used = np.unique(place)
    if len(marks) > 64 and len(marks) * len(used) > 500_000:
        middle = int(marks[len(marks) // 2])
        for a, b in ((begin, middle), (middle, end)):
            yield from _over_time(at, place, one, two, spots, xyz, origin, links, wide, mine, a, b)
        return
    if not mine[used].any():
        return
    place = np.searchsorted(used, place)
    yield from _largest_of(at, place, one, two, spots[used], xyz[used], origin, links[np.ix_(used, used)], wide[np.ix_(used, used)], np.flatnonzero(mine[used]), marks, end)


def _largest_of(at, place, one, two, spots, xyz, origin, links, wide, mine, marks, end):
    steps, places = len(marks), len(spots)
    enter = np.searchsorted(marks, np.maximum(at - WINDOW, marks[0])) * places + place
    leave = np.searchsorted(marks, at + WINDOW + 1) * places + place

    def running(v):
        change = np.zeros((steps + 1) * places, np.int64)
        np.add.at(change, enter, v)
        np.subtract.at(change, leave, v)
        return change.reshape(steps + 1, places)[:-1].cumsum(axis=0)

    count = running(1)
    live = count > 0
    same = bool((links == wide).all())
    about = count.astype(np.float32) @ wide.astype(np.float32)  # counts below 2^24 are exact
    n = about[:, mine] if same else count.astype(np.float32) @ links[:, mine].astype(np.float32)
    open_ = live[:, mine] & (n >= C.NEARBY_MIN_SAMPLES)
    # A tight group is in reach of each of its pins: so no pin of it has fewer neighbours than the group has pins.
    rows = np.arange(steps)
    left = np.where(live, about, np.inf)
    for _ in range(8):
        least = left.argmin(axis=1)
        m = left[rows, least]
        if not np.isfinite(m).any():
            break
        open_ &= ~(links[least][:, mine] & (n > m[:, None]))
        left[links[least]] = np.inf
    score = np.where(open_, n, 0)
    rows = rows[score.max(axis=1) > 0]
    if not len(rows):
        return
    sums = running(one), running(two)
    lat, lon, radius = spots.T
    p, q = np.radians(lat), np.radians(lon)
    size = (xyz**2).sum(axis=1)
    # First and second group found at each step: n, one, two, then lat, lon, spread, reach.
    names, values = np.zeros((2, steps, 3), np.int64), np.zeros((2, steps, 4))
    while len(rows):
        at_ = score[rows].argmax(axis=1)
        most = score[rows, at_]
        rest = (most > 0) & (most >= names[0, rows, 0])
        rows, at_ = rows[rest], at_[rest]
        if not len(rows):
            break
        score[rows, at_] = 0
        inside = live[rows] & links[mine[at_]]
        weight = np.where(inside, count[rows], 0)
        total = weight.sum(axis=1)
        mid = (weight @ lat) / total, (weight @ lon) / total
        c = _globe(np.radians(mid[0]), np.radians(mid[1])) - origin
        chord = np.where(inside, (c**2).sum(axis=1)[:, None] + size[None, :] - 2 * (c @ xyz.T), 0).max(axis=1)
        k = np.flatnonzero(chord <= (C.NEARBY_SPREAD_M + 0.1) ** 2)
        if not len(k):
            continue
        far = _far(np.radians(mid[0][k])[:, None], np.radians(mid[1][k])[:, None], p[None, :], q[None, :])
        spread = np.where(inside[k], far, 0).max(axis=1)
        good = spread <= C.NEARBY_SPREAD_M
        k, far, spread = k[good], far[good], spread[good]
        if not len(k):
            continue
        step, members = rows[k], inside[k]
        named = np.stack([total[k], *(np.where(members, s[step], 0).sum(axis=1) for s in sums)], axis=1)
        found = np.stack([mid[0][k], mid[1][k], spread, np.where(members, far + radius[None, :], 0).max(axis=1)], axis=1)
        new = names[0, step, 0] == 0
        names[0, step[new]], values[0, step[new]] = named[new], found[new]
        tied = ~new & (named != names[0, step]).any(axis=1)
        names[1, step[tied]], values[1, step[tied]] = named[tied], found[tied]
        if same:  # pins of a tight group that have as many neighbours have just these
            gone = score[step]
            gone[members[:, mine] & (gone == named[:, :1])] = 0
            score[step] = gone
        rows = rows[names[1, rows, 0] == 0]
    stop = np.append(marks[1:], end)
    for name, value in zip(names, values):
        held = np.flatnonzero(name[:, 0])
        if not len(held):
            continue
        # Steps that follow each other with the same set are one.
        cut = np.flatnonzero(np.concatenate([[True], (np.diff(held) > 1) | (name[held[1:]] != name[held[:-1]]).any(axis=1)]))
        first, last = held[cut], held[np.append(cut[1:], len(held)) - 1]
        yield marks[first], stop[last], *name[first].T, *value[first].T


_GROUP = "lo long, hi long, n long, one long, two long, lat double, lon double, spread double, reach double"


def tight_groups(pins: DataFrame) -> DataFrame:
    """type, lo, hi, n, one, two, lat, lon, spread, reach from direct pins (id, type, at, lat, lon, radius_m): the largest of each cell at each moment."""
    turn, slope = F.radians("lon"), F.radians("lat")
    sent = pins.filter("type IS NOT NULL AND at IS NOT NULL").select(
        "type", "at", "lat", "lon", "radius_m", F.xxhash64("id").alias("one"), F.xxhash64("id", F.lit(1)).alias("two"),
        (C.EARTH_RADIUS_GEO_M * F.cos(slope) * F.cos(turn)).alias("x"), (C.EARTH_RADIUS_GEO_M * F.cos(slope) * F.sin(turn)).alias("y"), (C.EARTH_RADIUS_GEO_M * F.sin(slope)).alias("z"),
    )
    home = F.lit(True)
    for axis in "xyz":
        cut = lambda v: F.floor(v / CELL_M).cast("long")
        home = home & (F.col(f"c{axis}") == cut(F.col(axis)))
        sent = sent.withColumn(f"c{axis}", F.explode(F.sequence(cut(F.col(axis) - REACH - 1.0), cut(F.col(axis) + REACH + 1.0))))
    sent = sent.withColumn("ct", F.explode(F.sequence(_span(F.col("at") - WINDOW), _span(F.col("at") + WINDOW))))
    columns = ["at", "lat", "lon", "radius_m", "one", "two"]
    sent = sent.select(*_CELL, *columns, home.alias("home"))
    schema = f"type string, {_GROUP}"

    def found(batches):
        kinds = [pa.int64()] * 5 + [pa.float64()] * 4
        names = [c.split()[0] for c in schema.split(", ")]
        held, size = [], 0

        def batch():
            columns = [pa.array(np.concatenate(v), k) for v, k in zip(zip(*(h[1] for h in held)), kinds)]
            kind = pa.chunked_array([pa.array([h[0]] * len(h[1][0]), pa.string()) for h in held]).combine_chunks()
            return pa.RecordBatch.from_arrays([kind, *columns], names=names)

        for group in runs(batches, len(_CELL), C.NEARBY_MIN_SAMPLES, "home"):
            values = [group.column(c).to_numpy() for c in (*columns, "home")]
            kind, begin = group.column("type")[0].as_py(), group.column("ct")[0].as_py() * CELL_T
            for rows in tight_in_cell(*values, begin, begin + CELL_T):
                held.append((kind, rows))
                size += len(rows[0])
                if size >= 10_000:
                    yield batch()
                    held, size = [], 0
        if held:
            yield batch()

    # A number of its own: by bytes alone few tasks would get all the work.
    parts = int(pins.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = sent.repartition(parts, *_CELL).sortWithinPartitions(*_CELL)
    return dealt.mapInArrow(found, schema)


def _span(at: Column) -> Column:
    return F.floor(at / F.lit(CELL_T)).cast("long")


_BEST = "type string, at long, n long, one long, two long, lat double, lon double, spread double, reach double, tied boolean"


def _at_moments(groups: DataFrame, moments: DataFrame) -> DataFrame:
    """type, at, the largest group at each moment that has one, and whether another is as large.

    Groups and moments of a type and span of time pass in order of time; a heap holds the groups that have begun.
    """
    fields = [c.split()[0] for c in _GROUP.split(", ")]
    looks = moments.select("type", _span(F.col("at")).alias("span"), F.col("at").alias("lo"), F.lit(True).alias("look"), *[F.lit(0).cast(c.split()[1]).alias(c.split()[0]) for c in _GROUP.split(", ")[1:]])
    both = groups.select("type", _span(F.col("lo")).alias("span"), "lo", F.lit(False).alias("look"), *fields[1:]).unionByName(looks)
    names = [c.split()[0] for c in _BEST.split(", ")]
    kinds = [pa.string(), *[pa.int64()] * 4, *[pa.float64()] * 4, pa.bool_()]

    def swept(batches):
        out = []
        for rows in runs(batches, 2, 2, "look"):
            kind = rows.column("type")[0].as_py()
            values = [rows.column(c).to_pylist() for c in fields[1:]]
            heap: list = []
            for k, (lo, look, hi, n, one, two) in enumerate(zip(rows.column("lo").to_pylist(), rows.column("look").to_pylist(), *values[:4])):
                if not look:
                    heapq.heappush(heap, (-n, one, two, hi, k))
                    continue
                while heap and heap[0][3] <= lo:
                    heapq.heappop(heap)
                if heap:
                    best = heap[0]
                    tied, passed = _another(heap, lo)
                    out.append((kind, lo, *(v[best[4]] for v in values[1:]), tied))
                    if passed > 64:
                        heap = [g for g in heap if g[3] > lo]
                        heapq.heapify(heap)
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    parts = int(moments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return both.repartition(parts, "type", "span").sortWithinPartitions("type", "span", "lo", "look").mapInArrow(swept, _BEST)


def _another(heap: list, at: int) -> tuple[bool, int]:
    """Whether a group that lasts is as large as the first of the heap and not the same, and how many were passed over."""
    top, todo, passed = heap[0], [1, 2], 0
    while todo:
        k = todo.pop()
        if k < len(heap) and heap[k][0] == top[0]:
            if heap[k][3] > at and heap[k][1:3] != top[1:3]:
                return True, passed
            passed += 1
            todo += [2 * k + 1, 2 * k + 2]
    return False, passed


def _candidates(pins: DataFrame, moments: DataFrame) -> DataFrame:
    """type, at, k: how many pins are within the window of each moment; those without any are left out."""
    end = lambda shift, kind: moments.select("type", (F.col("at") + shift).alias("place"), F.lit(kind).alias("kind"), F.lit(0).alias("pin"), "at")
    marks = pins.select("type", F.col("at").alias("place"), F.lit(1).alias("kind"), F.lit(1).alias("pin"), F.lit(None).cast("long").alias("at"))
    marks = marks.unionByName(end(-WINDOW, 0)).unionByName(end(WINDOW, 2))
    dealt = stored(marks.repartitionByRange("type", "place", "kind").withColumn("part", F.spark_partition_id()), "nearby-marks")
    held = dealt.groupBy("type", "part").agg(F.sum("pin").alias("held"))
    before = F.sum("held").over(W.partitionBy("type").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    held = held.select("type", "part", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.sum("pin").over(W.partitionBy("type", "part").orderBy("place", "kind").rowsBetween(W.unboundedPreceding, W.currentRow))
    ends = dealt.withColumn("inside", inside).filter("kind <> 1").join(held, ["type", "part"])
    seen = F.col("inside") + F.col("before")
    return ends.groupBy("type", "at").agg(F.sum(F.when(F.col("kind") == 2, seen).otherwise(-seen)).alias("k")).filter("k > 0")


def inferred(pins: DataFrame, moments: DataFrame) -> DataFrame:
    """type, at, k (candidates), best (largest tight group, null if none) and tied (another one is as large) for each moment.

    ``pins`` has id, type, at (microseconds), lat, lon, radius_m; ``moments`` distinct type, at. Moments without candidates are left out.
    """
    k = _candidates(pins.filter("type IS NOT NULL AND at IS NOT NULL"), moments)
    best = F.struct("n", "one", "two", "lat", "lon", "spread", "reach").alias("best")
    top = _at_moments(tight_groups(pins), moments).select("type", "at", best, "tied")
    return k.join(top, ["type", "at"], "left")
