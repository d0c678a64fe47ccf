"""Rows of a sorted partition in stretches that hold whole keys, for functions over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame


def dealt(df: DataFrame, keys: Sequence[str], within: Sequence[str]) -> DataFrame:
    """df dealt by keys over as many parts as shuffles have, sorted by keys and within them. The number is given, so that adaptive execution does not put parts of few bytes together, which cost Python time."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, *keys).sortWithinPartitions(*keys, *within)


def whole(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[dict[str, pa.Array], np.ndarray]]:
    """(columns, bounds) of rows that are sorted by keys: the rows of a key come together, the k-th key's from bounds[k] to bounds[k + 1]. What is held is a batch and the rows of one key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        starts = _starts(batch, keys)
        if held and all(held[-1].column(k)[held[-1].num_rows - 1] == batch.column(k)[0] for k in keys):
            starts = starts[1:]
        if not len(starts):
            held.append(batch)
            continue
        cut = int(starts[-1])
        if held or cut:
            yield _joined([*held, batch.slice(0, cut)], keys)
        held = [batch.slice(cut)]
    if held:
        yield _joined(held, keys)


def _starts(batch: pa.RecordBatch, keys: Sequence[str]) -> np.ndarray:
    """Where a key begins."""
    new = np.zeros(batch.num_rows, bool)
    new[0] = True
    for k in keys:
        c = batch.column(k)
        new[1:] |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def _joined(batches: list[pa.RecordBatch], keys: Sequence[str]) -> tuple[dict[str, pa.Array], np.ndarray]:
    rows = pa.concat_batches(batches)
    return dict(zip(rows.schema.names, rows.columns, strict=True)), np.append(_starts(rows, keys), rows.num_rows)
