"""Percentiles of very large numeric columns with multiplicative rank error, mergeable over partitions and days.

A sketch is a stack of relative compactors. Level ``h`` holds items of weight ``2 ** h``; a full level is sorted and its
items farthest from the protected tail are halved into the next level, so that the tail is compacted least and, while
few items have passed, not at all. The rank error at rank ``r`` (counted from the protected tail) is a multiple of ``r``,
not of ``n``. Two sketches merge level by level, whatever their origin (partitions, days, earlier merges).

A percentile is asked of the sketch whose protected tail is nearer: every group has a low and a high one.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from skyloom.session import shuffle_width

#: Section size: the relative standard error of a rank is below 1 / SECTION for any number of items up to 2 ** 60.
SECTION = 32
#: Sections of a fresh level.
SECTIONS = 3
#: Stated error: a percentile's rank, counted from the nearer end, is right within this share of itself.
RANK_ERROR = 0.03
#: Rows that a task sketches at a time, and groups that it holds from one such lot to the next (some 80 kB each at most).
BUFFER, MAX_KEYS = 200_000, 2_000


def at_rank(v: np.ndarray, upto: np.ndarray, p: float) -> float:
    """Of sorted items and the weight up to each, the one of rank ``ceil(p n)`` (at least 1)."""
    total = int(upto[-1])
    return float(v[np.searchsorted(upto, min(max(1, math.ceil(p * total)), total))])


class RelativeSketch:
    """Relative-error quantile sketch. ``high`` protects the largest items, else the smallest."""

    def __init__(self, high: bool, section: int = SECTION, seed: int = 0):
        self.high, self.section, self.n = high, section, 0
        self.seed = seed
        self.levels: list[np.ndarray] = [np.empty(0)]
        self.turns: list[int] = [0]

    def _room(self, h: int) -> int:
        """Capacity of a level: it grows with the logarithm of the compactions that it has made."""
        return 2 * self.section * (SECTIONS + max(0, math.ceil(math.log2(self.turns[h] + 1))))

    def update(self, values: np.ndarray) -> None:
        self.n += len(values)
        sign = -1.0 if self.high else 1.0
        self.levels[0] = np.concatenate([self.levels[0], sign * values])
        self._settle()

    def merge(self, other: RelativeSketch) -> None:
        if (other.high, other.section) != (self.high, self.section):
            raise ValueError("sketches of another kind")
        self.n += other.n
        while len(self.levels) < len(other.levels):
            self.levels.append(np.empty(0))
            self.turns.append(0)
        for h, v in enumerate(other.levels):
            self.levels[h] = np.concatenate([self.levels[h], v])
            self.turns[h] |= other.turns[h]
        self._settle()

    def _settle(self) -> None:
        h = 0
        while h < len(self.levels):
            while len(self.levels[h]) > self._room(h):
                self._compact(h)
            h += 1

    def _compact(self, h: int) -> None:
        if h + 1 == len(self.levels):
            self.levels.append(np.empty(0))
            self.turns.append(0)
        v = np.sort(self.levels[h], kind="stable")
        ones = ((self.turns[h] + 1) & ~self.turns[h]).bit_length() - 1  # trailing ones of the number of turns
        room = self._room(h)
        cut = max(room // 2, room - (1 + ones) * self.section)
        cut += (len(v) - cut) % 2
        tail = v[cut:]
        self.levels[h + 1] = np.concatenate([self.levels[h + 1], tail[self._coin(h) :: 2]])
        self.levels[h] = v[:cut]
        self.turns[h] += 1

    def _coin(self, h: int) -> int:
        """A fair bit that depends on nothing but the seed and the compactions so far."""
        return zlib.crc32(struct.pack("<IIqq", self.seed & 0xFFFFFFFF, h, self.turns[h], self.n)) >> 13 & 1

    def weighted(self) -> tuple[np.ndarray, np.ndarray]:
        """Items in ascending order of the value, and their weights."""
        v = np.concatenate(self.levels)
        w = np.concatenate([np.full(len(x), 1 << h, np.int64) for h, x in enumerate(self.levels)])
        o = np.argsort(v, kind="stable")
        v, w = v[o], w[o]
        return (-v[::-1], w[::-1]) if self.high else (v, w)

    def quantile(self, p: float) -> float:
        """An item whose rank is near ``ceil(p n)`` (at least 1), counted from the protected tail."""
        v, w = self.weighted()
        return at_rank(v, np.cumsum(w), p) if len(v) else math.nan

    def dump(self) -> bytes:
        head = struct.pack("<?iqi", self.high, self.section, self.n, len(self.levels))
        sizes = struct.pack(f"<{2 * len(self.levels)}q", *[x for v, t in zip(self.levels, self.turns) for x in (len(v), t)])
        return head + sizes + np.concatenate(self.levels).astype("<f8").tobytes()

    @classmethod
    def load(cls, data: bytes, seed: int = 0) -> RelativeSketch:
        high, section, n, k = struct.unpack_from("<?iqi", data)
        at = struct.calcsize("<?iqi")
        sizes = struct.unpack_from(f"<{2 * k}q", data, at)
        out = cls(high, section, seed)
        out.n, out.turns = n, list(sizes[1::2])
        items = np.frombuffer(data, "<f8", offset=at + 16 * k)
        out.levels = [x.copy() for x in np.split(items, np.cumsum(sizes[::2])[:-1])]
        return out


def _seed(k: tuple, side: int) -> int:
    return zlib.crc32(repr((k, side)).encode())


class Pair:
    """Both sketches of a group; while it has few values, these themselves."""

    __slots__ = ("key", "section", "raw", "n", "low", "high")

    def __init__(self, key: tuple, section: int):
        self.key, self.section = key, section
        self.raw: list[np.ndarray] = []
        self.n = 0
        self.low: RelativeSketch | None = None
        self.high: RelativeSketch | None = None

    def _compacted(self) -> None:
        if self.low is None:
            self.low, self.high = (RelativeSketch(h, self.section, _seed(self.key, int(h))) for h in (False, True))
            if self.raw:
                v = np.concatenate(self.raw)
                self.low.update(v)
                self.high.update(v)
                self.raw = []

    def values(self, v: np.ndarray) -> None:
        self.n += len(v)
        if self.low is None:
            self.raw.append(v)
            if self.n > 2 * SECTIONS * self.section:
                self._compacted()
        else:
            self.low.update(v)
            self.high.update(v)

    def merge(self, low: bytes, high: bytes | None) -> None:
        if high is None:
            self.values(np.frombuffer(low, "<f8"))
            return
        self._compacted()
        for s, data in ((self.low, low), (self.high, high)):
            s.merge(RelativeSketch.load(data))
        self.n = self.low.n

    def row(self) -> tuple:
        if self.low is None:
            return (*self.key, self.n, np.concatenate(self.raw).astype("<f8").tobytes(), None)
        return (*self.key, self.n, self.low.dump(), self.high.dump())


def _runs(t: pa.Table, keys: list[str]) -> Iterator[tuple[tuple, np.ndarray]]:
    """Keys (null equals null) and the positions of their rows."""
    code, cols = np.zeros(len(t), np.int64), []
    for k in keys:
        d = pa.concat_arrays(t.column(k).chunks).dictionary_encode("encode")
        cols.append((d.indices.to_numpy(), d.dictionary.to_pylist()))
        code = np.unique(code * len(cols[-1][1]) + cols[-1][0], return_inverse=True)[1]
    order = np.argsort(code, kind="stable")
    code = code[order]
    at = [0, *(np.nonzero(code[1:] != code[:-1])[0] + 1), len(code)]
    for i, j in zip(at[:-1], at[1:]):
        yield tuple(names[where[order[i]]] for where, names in cols), order[i:j]


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _collected(keys: list[str], schema: pa.Schema, section: int, of_values: bool):
    """Rows of a task in any order in, pairs out: one per key and task, or more where the task has many keys (then all are handed on and forgotten)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Pair] = {}
        waiting: list[pa.RecordBatch] = []

        def pair_of(k: tuple) -> Pair:
            if k not in held:
                held[k] = Pair(k, section)
            return held[k]

        def take() -> None:
            t = pa.Table.from_batches(waiting)
            waiting.clear()
            if of_values:
                v = t.column("value").to_numpy()
                for k, at in _runs(t, keys):
                    pair_of(k).values(v[at])
            else:
                low, high = t.column("low").to_pylist(), t.column("high").to_pylist()
                for k, at in _runs(t, keys):
                    for i in at:
                        pair_of(k).merge(low[i], high[i])

        def handed() -> Iterator[pa.RecordBatch]:
            rows = []
            for p in held.values():
                rows.append(p.row())
                if len(rows) == 512:
                    yield _table(rows, schema)
                    rows = []
            if rows:
                yield _table(rows, schema)
            held.clear()

        for b in batches:
            if b.num_rows:
                waiting.append(b)
            if sum(x.num_rows for x in waiting) >= (BUFFER if of_values else BUFFER // 64):
                take()
                if len(held) > MAX_KEYS:
                    yield from handed()
        if waiting:
            take()
        yield from handed()

    return run


def _folded(keys: list[str], schema: pa.Schema, section: int):
    """Pairs sorted by key in, one per key out; a task holds one pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for b in batches:
            for *k, low, high in zip(*[b.column(c).to_pylist() for c in (*keys, "low", "high")]):
                if now is None or now.key != tuple(k):
                    if now is not None:
                        rows.append(now.row())
                    now = Pair(tuple(k), section)
                now.merge(low, high)
                if len(rows) == 512:
                    yield _table(rows, schema)
                    rows = []
        if now is not None:
            yield _table([*rows, now.row()], schema)

    return run


def _schemas(df: DataFrame, keys: list[str]) -> tuple[str, pa.Schema]:
    kinds = {f.name: f.dataType for f in df.schema.fields}
    ddl = ", ".join(f"`{k}` {kinds[k].simpleString()}" for k in keys) + ", n long, low binary, high binary"
    return ddl, pa.schema([*[(k, to_arrow_type(kinds[k])) for k in keys], ("n", pa.int64()), ("low", pa.binary()), ("high", pa.binary())])


def _one_per_key(pairs: DataFrame, keys: list[str], section: int) -> DataFrame:
    ddl, schema = _schemas(pairs, keys)
    return pairs.repartition(shuffle_width(pairs.sparkSession), *keys).sortWithinPartitions(*keys).mapInArrow(_folded(keys, schema, section), ddl)


def build_sketches(df: DataFrame, keys: list[str], section: int = SECTION) -> DataFrame:
    """``(keys, n, low, high)`` of the column ``value``: one row per combination of keys.

    Null and NaN values are left out; null keys are a group of their own; no rows give no sketches. Every task sketches its
    rows where they are, whatever their keys, so a hot key, or one value that repeats, is spread as the rows are and only
    sketches are shuffled. A group of few values is kept exactly: ``low`` then holds the values and ``high`` is null.
    """
    rows = df.select(*keys, F.col("value").cast("double").alias("value")).filter(F.col("value").isNotNull() & ~F.isnan("value"))
    ddl, schema = _schemas(rows, keys)
    return _one_per_key(rows.mapInArrow(_collected(keys, schema, section, True), ddl), keys, section)


def merge_sketches(sketches: DataFrame, keys: list[str], section: int = SECTION) -> DataFrame:
    """Sketches with equal ``keys`` made one: first within each task, then by key. Other columns are dropped. ``section`` must be the one they were built with."""
    ddl, schema = _schemas(sketches, keys)
    return _one_per_key(sketches.select(*keys, "n", "low", "high").mapInArrow(_collected(keys, schema, section, False), ddl), keys, section)


def measurement(c: Column, placeholders: list[float], low: float, high: float) -> Column:
    """The value if it is finite, in ``(low, high]`` and no placeholder; else null."""
    ok = c.isNotNull() & ~F.isnan(c) & (c > low) & (c <= high) & ~c.isin(placeholders)
    return F.when(ok, c)


def percentiles(sketches: DataFrame, keys: list[str], ps: list[float]) -> DataFrame:
    """``(keys, p, value, value_lo, value_hi, n)``: percentiles by the sketch whose protected tail is nearer, and the values between which the exact one lies by the stated error."""
    kinds = {f.name: f.dataType for f in sketches.schema.fields}
    ddl = ", ".join(f"`{k}` {kinds[k].simpleString()}" for k in keys) + ", p double, value double, value_lo double, value_hi double, n long"
    schema = pa.schema([*[(k, to_arrow_type(kinds[k])) for k in keys], *[(c, pa.float64()) for c in ("p", "value", "value_lo", "value_hi")], ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for *k, n, low, high in zip(*[b.column(c).to_pylist() for c in (*keys, "n", "low", "high")]):
                if high is None:
                    v = np.sort(np.frombuffer(low, "<f8"))
                    ends = [(v, np.arange(1, n + 1))] * 2
                else:
                    ends = [(v, np.cumsum(w)) for v, w in (RelativeSketch.load(x).weighted() for x in (low, high))]
                for p in ps:
                    side, tail = (0, p) if p <= 0.5 else (1, 1.0 - p)
                    near, far = tail * (1 - RANK_ERROR), tail * (1 + RANK_ERROR)
                    lo, hi = (near, far) if side == 0 else (1.0 - far, 1.0 - near)
                    rows.append((*k, p, *[at_rank(*ends[side], q) for q in (p, lo, hi)], n))
            if rows:
                yield _table(rows, schema)

    return sketches.select(*keys, "n", "low", "high").mapInArrow(run, ddl)
