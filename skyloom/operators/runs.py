"""Sorted Arrow batches cut at group borders."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def borders(t: pa.Table, keys: tuple[str, ...]) -> np.ndarray:
    """True where a row begins another group than the row before it (rows sorted by non-null numeric keys)."""
    new = np.zeros(len(t), bool)
    for k in keys:
        v = t.column(k).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return new


def complete_runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Tables of whole groups, from a partition sorted by ``keys``; at most one group is held over from batch to batch."""
    held: list[pa.Table] = []
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        new = borders(t, keys)
        last = int(np.nonzero(new)[0][-1]) if new.any() else 0
        if not last and held and all(held[0].column(k)[0].as_py() == t.column(k)[0].as_py() for k in keys):
            held.append(t)
            continue
        whole = [*held, t.slice(0, last)] if last else held
        held = [t.slice(last)]
        if whole:
            yield pa.concat_tables(whole).combine_chunks()
    if held:
        yield pa.concat_tables(held).combine_chunks()
