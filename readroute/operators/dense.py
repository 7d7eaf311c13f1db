"""Per-key totals that hot keys cannot slow down.

Rows are never shuffled by key. Every input split (equal shares of the input,
whatever keys they hold) encodes its keys in a dictionary of its own and adds
each batch into dense arrays indexed by the codes, with ``bincount`` and
scatter reductions. What leaves a split is one entry per key it met, in blocks
of arrays; these blocks are then summed by a distributed reduction. A key that
holds a third of all rows costs every split the same as its share of rows, and
the reduction sees it at most once per split and flush.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readroute.session import col

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)


class _Dense:
    """Dense accumulator arrays of one split."""

    def __init__(self, whole: Sequence[bool]):
        self.whole = whole
        self.codes: dict = {}
        self.rows = np.zeros(0, np.int64)
        self.seen = [np.zeros(0, np.int64) for _ in whole]
        self.sums = [np.zeros(0, np.int64 if w else np.float64) for w in whole]
        self.lows = [np.zeros(0, np.int64 if w else np.float64) for w in whole]
        self.highs = [np.zeros(0, np.int64 if w else np.float64) for w in whole]

    def _bounds(self, w: bool) -> tuple:
        return (np.iinfo(np.int64).max, np.iinfo(np.int64).min) if w else (np.inf, -np.inf)

    def _grow(self) -> None:
        have, want = len(self.rows), len(self.codes)
        if want <= have:
            return
        more = max(want, 2 * have) - have
        self.rows = np.pad(self.rows, (0, more))
        for i, w in enumerate(self.whole):
            low, high = self._bounds(w)
            self.seen[i] = np.pad(self.seen[i], (0, more))
            self.sums[i] = np.pad(self.sums[i], (0, more))
            self.lows[i] = np.pad(self.lows[i], (0, more), constant_values=low)
            self.highs[i] = np.pad(self.highs[i], (0, more), constant_values=high)

    def add(self, keys: Sequence[pa.Array], values: Sequence[pa.Array]) -> None:
        combined, parts = np.zeros(len(keys[0]), np.int64), []
        for k in keys:
            local = k.dictionary_encode("encode")
            parts.append(local.dictionary.to_pylist())
            combined = combined * len(parts[-1]) + local.indices.to_numpy(zero_copy_only=False)
        met, inverse = np.unique(combined, return_inverse=True)
        names = []
        for part in reversed(parts):
            names.append([part[i] for i in met % len(part)])
            met = met // len(part)
        lookup = np.fromiter((self.codes.setdefault(k, len(self.codes)) for k in zip(*reversed(names))), np.int64, len(names[0]))
        self._grow()
        # Reduced over the batch's own keys first, then added where those stand.
        size = len(met)
        self.rows[lookup] += np.bincount(inverse, minlength=size)
        for i, v in enumerate(values):
            there = pc.is_valid(v)
            if not self.whole[i]:
                v = pc.cast(v, pa.float64())
                there = pc.fill_null(pc.invert(pc.is_nan(v)), False)
            at = inverse[there.to_numpy(zero_copy_only=False)]
            x = pc.cast(v.filter(there), pa.int64() if self.whole[i] else pa.float64()).to_numpy(zero_copy_only=False)
            total, (low, high) = np.zeros(size, x.dtype), (np.full(size, b, x.dtype) for b in self._bounds(self.whole[i]))
            np.add.at(total, at, x)
            np.minimum.at(low, at, x)
            np.maximum.at(high, at, x)
            self.seen[i][lookup] += np.bincount(at, minlength=size)
            self.sums[i][lookup] += total
            self.lows[i][lookup] = np.minimum(self.lows[i][lookup], low)
            self.highs[i][lookup] = np.maximum(self.highs[i][lookup], high)

    def blocks(self, schema: pa.Schema, block: int) -> Iterator[pa.RecordBatch]:
        keys = list(self.codes)
        for a in range(0, len(keys), block):
            b = min(a + block, len(keys))
            out = [*[pa.array(x, schema.field(i).type) for i, x in enumerate(zip(*keys[a:b]))], pa.array(self.rows[a:b])]
            for i in range(len(self.whole)):
                none = self.seen[i][a:b] == 0
                out.append(pa.array(self.seen[i][a:b]))
                out += [pa.array(x[i][a:b], mask=none) for x in (self.sums, self.lows, self.highs)]
            yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(out, schema)], schema=schema)


def dense_totals(df: DataFrame, key: str | Sequence[str], values: Sequence[str] = (), max_keys: int = 1 << 18, block: int = 1 << 14) -> DataFrame:
    """Row count and count, sum, minimum and maximum of each value, per key.

    ``key`` is one column or several. Returns ``key..., n_rows`` and for each value column ``v`` the columns
    ``v_n, v_sum, v_min, v_max``. Null keys form a group of their own. Null
    values (and NaN) are left out of ``v_n`` and of the others, which are null
    for a key without any value. Booleans count as 0 and 1, whole numbers are
    summed in 64 bits, others as doubles. Without rows the result is empty.
    Other columns of ``df``, whatever their names, are not read.

    ``max_keys`` bounds a split's dictionary: once it is reached the arrays are
    handed on and started anew, so memory does not grow with the number of
    keys, and no row is lost by it. ``block`` is the length of the array blocks.
    """
    keys = [key] if isinstance(key, str) else list(key)
    values = list(values)
    width = len(keys)
    if not 1 <= width <= 4:
        raise ValueError("one to four key columns")  # their codes are packed into 64 bits
    kinds = [df.schema[v].dataType for v in values]
    whole = [isinstance(k, _WHOLE) for k in kinds]
    fields = [*[T.StructField(f"k{i}", df.schema[k].dataType) for i, k in enumerate(keys)], T.StructField("n", T.LongType())]
    for i, w in enumerate(whole):
        number = T.LongType() if w else T.DoubleType()
        fields += [T.StructField(f"c{i}", T.LongType()), T.StructField(f"s{i}", number), T.StructField(f"l{i}", number), T.StructField(f"h{i}", number)]

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense, schema = _Dense(whole), None
        for batch in batches:
            if schema is None:
                schema = pa.schema([*[(f"k{i}", batch.schema.field(i).type) for i in range(width)], ("n", pa.int64())] + [x for i, w in enumerate(whole) for x in ((f"c{i}", pa.int64()), *((f"{y}{i}", pa.int64() if w else pa.float64()) for y in "slh"))])
            dense.add(batch.columns[:width], batch.columns[width:])
            if len(dense.codes) > max_keys:
                yield from dense.blocks(schema, block)
                dense = _Dense(whole)
        if schema is not None:
            yield from dense.blocks(schema, block)

    cells = df.select(*[col(k).alias(f"k{i}") for i, k in enumerate(keys)], *[(col(v).cast("long") if w else col(v).cast("double")).alias(f"v{i}") for i, (v, w) in enumerate(zip(values, whole))])
    parts = cells.mapInArrow(reduce, T.StructType(fields))
    totals = [F.sum("n").alias("n_rows")]
    for i, v in enumerate(values):
        totals += [F.sum(f"c{i}").alias(f"{v}_n"), F.sum(f"s{i}").alias(f"{v}_sum"), F.min(f"l{i}").alias(f"{v}_min"), F.max(f"h{i}").alias(f"{v}_max")]
    return parts.groupBy(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)]).agg(*totals)
