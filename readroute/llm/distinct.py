"""Distinct counts over huge identifier sets with a known error bound.

A sketch is an array of m registers. Register j holds the least of the
exponential values that the items' hashes take under hash function j; so
repeats change nothing, the sketch of a union is the elementwise minimum, and
for n different items each register is exponential with rate n. The registers'
sum is then gamma distributed with shape m and rate n: (m - 1) / sum estimates
n without bias and with a relative standard error of 1 / sqrt(m - 2), and
quantiles of the gamma distribution bound n with a stated confidence.

Inside a partition items are collected per key; keys with many become registers
before anything is shuffled, the others travel as bare hashes, which fit less
space than a sketch. Only one more fold per key follows, streaming over rows
sorted by key.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readroute.session import col

_STATE = "key string, h long, registers binary"
_SEEDS_STEP = 0x9E3779B97F4A7C15


def _seeds(m: int) -> np.ndarray:
    return np.arange(1, m + 1, dtype=np.uint64) * np.uint64(_SEEDS_STEP)


def registers_of(hashes: np.ndarray, m: int, block: int = 256) -> np.ndarray:
    """Registers of a set of 64-bit hashes: minima of m exponential values."""
    least = np.full(m, np.iinfo(np.uint64).max, np.uint64)
    seeds = _seeds(m)
    for a in range(0, len(hashes), block):
        x = hashes[a : a + block, None] ^ seeds[None, :]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        np.minimum(least, x.min(axis=0), out=least)
    return -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) if len(hashes) else np.full(m, np.inf)


class _Folder:
    """Sketches of the keys met, in bounded memory."""

    def __init__(self, m: int, most_pending: int, most_dense: int):
        self.m, self.most_pending, self.most_dense = m, most_pending, most_dense
        self.dense: dict = {}
        self.pending: dict = {}
        self.held = 0

    def add(self, batch: pa.RecordBatch) -> None:
        key, h, registers = batch.columns
        names = key.dictionary_encode("encode")
        codes = names.indices.to_numpy(zero_copy_only=False)
        names = names.dictionary.to_pylist()
        bare = h.is_valid().to_numpy(zero_copy_only=False)
        at = np.flatnonzero(bare)
        hashes = h.take(pa.array(at)).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        order = np.argsort(codes[at], kind="stable")
        sorted_codes = codes[at][order]
        for part in np.split(order, np.flatnonzero(np.diff(sorted_codes)) + 1) if len(order) else []:
            self.pending.setdefault(names[codes[at[part[0]]]], []).append(hashes[part])
        self.held += len(at)
        for i in np.flatnonzero(~bare):
            raw = registers[int(i)].as_py()
            if raw is not None:
                self._fold(names[codes[i]], np.frombuffer(raw, np.float64))

    def _fold(self, name, values: np.ndarray) -> None:
        have = self.dense.get(name)
        self.dense[name] = values if have is None else np.minimum(have, values)

    def settle(self, least: int) -> list[tuple]:
        """Turns pending items of keys with ``least`` or more into registers;
        returns the others' as rows."""
        rows = []
        for name, chunks in self.pending.items():
            items = np.unique(np.concatenate(chunks))
            if len(items) >= least:
                self._fold(name, registers_of(items, self.m))
            else:
                rows += [(name, x, None) for x in items.view(np.int64).tolist()]
        self.pending, self.held = {}, 0
        return rows

    def full(self) -> bool:
        return self.held >= self.most_pending or len(self.dense) > self.most_dense

    def take_dense(self) -> list[tuple]:
        rows = [(name, None, r.tobytes()) for name, r in self.dense.items()]
        self.dense = {}
        return rows


def _batches(rows: list[tuple], step: int) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(rows), step):
        k, h, r = zip(*rows[a : a + step])
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.string()), pa.array(h, pa.int64()), pa.array(r, pa.binary())], names=["key", "h", "registers"])


def _near(m: int, most_pending: int = 1 << 18, most_dense: int = 1024):
    """The fold before the shuffle: hot keys to registers, others as they are."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = _Folder(m, most_pending, most_dense)
        for batch in batches:
            f.add(batch)
            if f.full():
                yield from _batches(f.settle(m), 10_000)
                if len(f.dense) > most_dense:
                    yield from _batches(f.take_dense(), 256)
        yield from _batches(f.settle(m), 10_000)
        yield from _batches(f.take_dense(), 256)

    return fold


def _last(m: int, most_pending: int = 1 << 18):
    """The fold after it, over rows sorted by key: one sketch a key."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, last = _Folder(m, most_pending, 1 << 62), None
        for batch in batches:
            if not batch.num_rows:
                continue
            f.add(batch)
            last = batch.column(0)[batch.num_rows - 1].as_py()
            if f.held >= most_pending or len(f.pending) + len(f.dense) > 512:
                f.settle(1)
                open_one = f.dense.pop(last)  # its rows may go on in the next batch
                yield from _batches(f.take_dense(), 256)
                f.dense[last] = open_one
        f.settle(1)
        yield from _batches(f.take_dense(), 256)

    return fold


def _folded(state: DataFrame, m: int) -> DataFrame:
    near = state.mapInArrow(_near(m), _STATE)
    by_key = near.repartition("key").sortWithinPartitions("key")
    return by_key.mapInArrow(_last(m), _STATE)


def _named(folded: DataFrame, shape: T.StructType) -> DataFrame:
    groups = F.from_json("key", shape)
    return folded.select(*[groups[f.name].alias(f.name) for f in shape], "registers")


def _key(df: DataFrame, groups: Sequence[str]) -> F.Column:
    return F.to_json(F.struct(*[col(g).alias(g) for g in groups]), {"ignoreNullFields": "false"})


def _shape(df: DataFrame, groups: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(g, df.schema[g].dataType) for g in groups])


def sketch(df: DataFrame, groups: Sequence[str], item: str, m: int = 2048) -> DataFrame:
    """(groups..., registers): the mergeable sketch of ``item`` per group.

    Null items are not counted; a null group is a group like any other; groups
    without an item do not appear. ``m`` sets the error: 1 / sqrt(m - 2).
    """
    cells = df.filter(col(item).isNotNull()).select(_key(df, groups).alias("key"), F.xxhash64(col(item)).alias("h"), F.lit(None).cast("binary").alias("registers"))
    return _named(_folded(cells, m), _shape(df, groups))


def merge(sketches: DataFrame, groups: Sequence[str], m: int = 2048) -> DataFrame:
    """Sketches of the unions over ``groups``, from sketches of finer parts."""
    cells = sketches.select(_key(sketches, groups).alias("key"), F.lit(None).cast("long").alias("h"), "registers")
    return _named(_folded(cells, m), _shape(sketches, groups))


def _gamma_quantile(shape: int, p: float) -> float:
    """Wilson and Hilferty's approximation, good to 1e-4 for shapes over 100."""
    z = NormalDist().inv_cdf(p)
    return shape * (1 - 1 / (9 * shape) + z / (3 * math.sqrt(shape))) ** 3


def estimate(sketches: DataFrame, m: int = 2048, confidence: float = 0.99) -> DataFrame:
    """The sketches' groups with ``estimate``, ``low`` and ``high``: the true
    count lies between the latter two with the given confidence."""
    if m < 64 or not 0 < confidence < 1:
        raise ValueError("m must be 64 or more, the confidence between 0 and 1")
    lo, hi = (_gamma_quantile(m, p) for p in ((1 - confidence) / 2, (1 + confidence) / 2))
    groups = [c for c in sketches.columns if c != "registers"]

    @F.pandas_udf("double")
    def total(registers):
        return registers.map(lambda r: float(np.frombuffer(r, np.float64).sum()))

    return sketches.withColumn("__s", total("registers")).select(*[col(g) for g in groups], (F.lit(m - 1) / F.col("__s")).alias("estimate"), (F.lit(lo) / F.col("__s")).alias("low"), (F.lit(hi) / F.col("__s")).alias("high"))
