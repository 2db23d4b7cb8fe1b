"""The incident rules on streams of reports (id, source_user, raw_text, ts, gps_lat, gps_lon)."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, BooleanType, DoubleType, LongType, StringType, StructField, StructType

from tidewatch import constants as C
from tidewatch.operators import clustering
from tidewatch.operators.extraction import extract_facts


def stream_dedup(reports: DataFrame, delay: str = "2 hours") -> DataFrame:
    """Each id once, as long as its copies come within the delay."""
    return reports.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["id"])


def stream_extract(reports: DataFrame) -> DataFrame:
    """Relevant reports with their facts: the batch expressions, stateless."""
    return extract_facts(reports).filter(F.col("facts.relevant"))


def stream_sessions(reports: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Inactivity sessions of each type: start, end, n. ``reports`` has disaster_type and ts."""
    gap = F.session_window("ts", f"{C.CLUSTER_WINDOW_S} seconds")
    out = reports.withWatermark("ts", delay).groupBy("disaster_type", gap.alias("s")).agg(F.count("*").alias("n"), F.max("ts").alias("last_ts"))
    return out.select("disaster_type", F.col("s.start").alias("first_ts"), "last_ts", "n")


def stream_ingest(reports: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str):
    """Start a query that gives each micro-batch to ``handle``; ``ingest.stream_incidents`` has one that keeps incidents up to date.

    A batch may come again after a failure; ``handle`` gets its number and must be idempotent.
    """
    return reports.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_incident_updates(snapshots: DataFrame, since: str) -> DataFrame:
    """Change feed: rows of newly written snapshot files that were updated at or after ``since``."""
    return snapshots.filter(F.col("updated_at") >= F.lit(since).cast("timestamp"))


OUTPUT = StructType([
    StructField("id", StringType()), StructField("first_id", StringType()), StructField("center_lat", DoubleType()),
    StructField("center_lon", DoubleType()), StructField("n", LongType()), StructField("late", BooleanType()),
])
_REPORT = ["at", "id", "lat", "lon", "radius_m"]
_PENDING = StructType([StructField(n, StringType() if n == "id" else DoubleType()) for n in _REPORT])
_FIRST = StructType([StructField("at", DoubleType())])
_LEADER = StructType(
    [StructField(n, DoubleType()) for n in ("lat_sum", "lon_sum", "reference", "radius", "latest", "first")] + [StructField("first_id", StringType()), StructField("n", LongType())]
)
_PIECE = StructType([StructField("piece", LongType())])
_ROWS = StructType([StructField("rows", BinaryType())])
_RUN = StructType([StructField(n, LongType()) for n in ("piece", "end", "skip")] + [StructField("first", DoubleType())])
#: Waiting reports of a key that are sorted at once, and those that are read at once of such a run. Results of a batch.
RUN_ROWS, PIECE_ROWS, OUT_ROWS = 200_000, 2_000, 10_000


class LeaderClusters(StatefulProcessor):
    """Leader clustering of one key: reports wait in state until the watermark has passed them.

    They are then taken in order of time and id, so disorder within the watermark gives the
    batch result. One that comes when the watermark has passed it is given back at once, marked late. Live clusters are sums and counts; one whose two hours are over is dropped.
    All rows of a micro-batch are added at once and set one timer; a timer that finds nothing to take leaves the waiting reports unread, so
    each micro-batch reads them once. Here they are one list, read whole: for keys of which few wait; see ``SortedLeaderClusters``.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.leaders = handle.getListState("leaders", _LEADER)
        self.first = handle.getValueState("first", _FIRST)
        self._init(handle)

    def _init(self, handle: StatefulProcessorHandle) -> None:
        self.pending = handle.getListState("pending", _PENDING)

    def _wait(self, frames: Iterator[pd.DataFrame]) -> None:
        """Add reports to those that wait."""
        for group in frames:
            self.pending.appendList([tuple(r) for r in group.itertuples(index=False)])

    def _ready(self, mark: float, rest: list[float]) -> Iterator[tuple]:
        """Waiting reports from before ``mark`` in order, taken away; when all are read, ``rest`` has the first time of those left, if any."""
        waiting = sorted(tuple(r) for r in self.pending.get())
        left = [r for r in waiting if r[0] >= mark]
        yield from waiting[: len(waiting) - len(left)]
        self.pending.put(left) if left else self.pending.clear()
        rest += [r[0] for r in left[:1]]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        late, least, missed = timerValues.getCurrentWatermarkInMs() / 1000, [], []

        def fresh():
            for group in rows:
                new = group.loc[group["at"] >= late, _REPORT]
                missed.extend(group.loc[group["at"] < late, "id"])
                if len(new):
                    least[:] = [min([float(new["at"].min()), *least])]
                    yield new

        self._wait(fresh())
        before = self.first.get()
        if least and (before is None or least[0] < before[0]):
            self.first.update((least[0],))
            self.handle.registerTimer(int(least[0] * 1000) + 1)
        for k in range(0, len(missed), OUT_ROWS):
            yield pd.DataFrame([(i, None, None, None, None, True) for i in missed[k : k + OUT_ROWS]], columns=[f.name for f in OUTPUT.fields])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark, first = timerValues.getCurrentWatermarkInMs() / 1000, self.first.get()
        if first is None or first[0] >= mark:
            return
        begun = []
        for s in self.leaders.get():
            x = clustering.Leader(s[2])
            x.lat_sum, x.lon_sum, x.reference, x.radius, x.latest, x.first, x.first_id, x.n = s
            x.lat, x.lon = x.lat_sum / x.n, (x.lon_sum / x.n + 180.0) % 360.0 - 180.0
            begun.append(x)
        leaders, rest, out, at = clustering.Leaders(begun), [], [], None
        for at, id_, lat, lon, radius in self._ready(mark, rest):
            x = leaders.assign(at, id_, lat, lon, radius)
            out.append((id_, x.first_id, x.lat, x.lon, x.n, False))
            if len(out) >= OUT_ROWS:
                yield pd.DataFrame(out, columns=[f.name for f in OUTPUT.fields])
                out = []
        if at is not None:
            leaders.forget(at)
        kept = [(x.lat_sum, x.lon_sum, x.reference, x.radius, x.latest, x.first, x.first_id, x.n) for x in leaders.open()]
        self.leaders.put(kept) if kept else self.leaders.clear()
        if rest:
            self.first.update((rest[0],))
            self.handle.registerTimer(int(rest[0] * 1000) + 1)
        else:
            self.first.clear()
        if out:
            yield pd.DataFrame(out, columns=[f.name for f in OUTPUT.fields])

    def close(self) -> None:
        pass


class SortedLeaderClusters(LeaderClusters):
    """The same where any number of reports of a key wait: neither a task nor one value of the state ever holds them all.

    Each ``RUN_ROWS`` of a micro-batch are sorted and kept as a run of pieces of ``PIECE_ROWS``, and runs are merged as they are read, a piece of each at a time.
    """

    def _init(self, handle: StatefulProcessorHandle) -> None:
        self.pieces = handle.getMapState("pieces", _PIECE, _ROWS)
        self.runs = handle.getListState("runs", _RUN)

    def _wait(self, frames: Iterator[pd.DataFrame]) -> None:
        runs = [tuple(r) for r in self.runs.get()]
        before, held, n = len(runs), [], 0
        for group in frames:
            held.append(group)
            n += len(group)
            if n >= RUN_ROWS:
                runs.append(self._run(held, max((r[1] for r in runs), default=0)))
                held, n = [], 0
        if held:
            runs.append(self._run(held, max((r[1] for r in runs), default=0)))
        if len(runs) > before:
            self.runs.put(runs)

    def _run(self, frames: list[pd.DataFrame], begin: int) -> tuple:
        whole = pa.Table.from_pandas(pd.concat(frames, ignore_index=True), preserve_index=False).sort_by([("at", "ascending"), ("id", "ascending")])
        end = begin
        for k in range(0, whole.num_rows, PIECE_ROWS):
            sink = pa.BufferOutputStream()
            piece = whole.slice(k, PIECE_ROWS).combine_chunks()
            with pa.ipc.new_stream(sink, piece.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
                out.write_table(piece)
            self.pieces.updateValue((end,), (sink.getvalue().to_pybytes(),))
            end += 1
        return begin, end, 0, whole.column("at")[0].as_py()

    def _ready(self, mark: float, rest: list[float]) -> Iterator[tuple]:
        kept = [tuple(r) for r in self.runs.get()]
        opened, kept = [r for r in kept if r[3] < mark], [r for r in kept if r[3] >= mark]

        def rows(run):
            piece, end, skip, _ = run
            while piece < end:
                table = pa.ipc.open_stream(bytes(self.pieces.getValue((piece,))[0])).read_all()
                columns = [table.column(c).to_pylist() for c in _REPORT]
                for k in range(skip, table.num_rows):
                    if columns[0][k] >= mark:
                        kept.append((piece, end, k, columns[0][k]))
                        return
                    yield tuple(c[k] for c in columns)
                self.pieces.removeKey((piece,))
                piece, skip = piece + 1, 0

        yield from heapq.merge(*map(rows, opened))
        self.runs.put(kept) if kept else self.runs.clear()
        rest += [min(r[3] for r in kept)] if kept else []


def stream_leader_cluster(located: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """id, first_id (naming the cluster), centre and size at joining, for each report in its turn; late ones with nulls and ``late``.

    ``located`` has id, disaster_type, lat, lon, radius_m, ts. Needs the RocksDB state store.
    Keyed by type, which is exact; waiting reports are sorted runs in state (``SortedLeaderClusters``). Where types are too few keys, ``ingest.stream_incidents`` works by groups of
    time and place, and takes late reports in.
    """
    timed = located.withWatermark("ts", delay).withColumn("at", F.unix_micros("ts") / 1_000_000)
    # Without its event time column Spark leaves it to the processor what to do with late rows.
    timed = timed.select("id", "disaster_type", "lat", "lon", "radius_m", "at")
    return timed.groupBy("disaster_type").transformWithStateInPandas(SortedLeaderClusters(), OUTPUT, "Append", "EventTime")
