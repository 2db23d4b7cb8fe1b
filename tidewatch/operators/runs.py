"""Runs of equal keys in a stream of sorted Arrow batches: many small groups in one Python pass."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def runs(batches: Iterator[pa.RecordBatch], keys: int, least: int = 1, marked: str | None = None) -> Iterator[pa.Table]:
    """Each run of rows that agree in the first ``keys`` columns, whole, however batches cut it.

    The rows of a key must follow each other; a run that spans batches is put together. Passed over are
    runs of fewer than ``least`` rows, and those that have the boolean column ``marked`` true nowhere.
    """

    def wanted(table: pa.Table) -> bool:
        return table.num_rows >= least and (marked is None or bool(pc.any(table.column(marked)).as_py()))

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cuts = np.flatnonzero(_changes(batch, keys)) + 1
        bounds = [0, *cuts.tolist(), batch.num_rows]
        if held and any(held[-1].column(k)[-1].as_py() != batch.column(k)[0].as_py() for k in range(keys)):
            if wanted(whole := pa.Table.from_batches(held)):
                yield whole
            held = []
        inside = np.diff(bounds[:-1]) >= least
        if marked is not None and len(inside):
            inside &= np.logical_or.reduceat(batch.column(marked).to_numpy(zero_copy_only=False), bounds[:-1])[:-1]
        if held and len(inside):
            if wanted(whole := pa.Table.from_batches([*held, batch.slice(0, bounds[1])])):
                yield whole
            held, inside[0] = [], False
        for k in np.flatnonzero(inside).tolist():
            yield pa.Table.from_batches([batch.slice(bounds[k], bounds[k + 1] - bounds[k])])
        held.append(batch.slice(bounds[-2]))
    if held and wanted(whole := pa.Table.from_batches(held)):
        yield whole


def _changes(batch: pa.RecordBatch, keys: int) -> np.ndarray:
    """Whether a row's key differs from that of the row before, from the second row on."""
    out = np.zeros(batch.num_rows - 1, bool)
    for k in range(keys):
        codes = batch.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy()
        out |= codes[1:] != codes[:-1]
    return out
