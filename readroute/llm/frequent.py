"""Most frequent items by lossy counting in bounded memory.

Every partition counts its rows in buckets of ``ceil(1 / error)`` rows. An item
met first in bucket b enters with the undercount b - 1 it may have at most; at
the end of each bucket the items whose count and undercount together do not
exceed the bucket's number are pruned. So a partition of N rows keeps
O(log(error * N) / error) items, however many different ones there are.

Summaries of partitions are merged by adding counts and undercounts, where a
partition without the item counts with the undercount it may have hidden. Every
reported item therefore comes with an interval that holds its true count, and
an item above ``error * N`` is never missing.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from decimal import Decimal

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readroute.session import col, cut

SUMMARY = "grp string, item string, n long, delta long, rows long, hidden long"


class LossyCounter:
    """Lossy counting of one stream; ``add`` takes any number of items."""

    def __init__(self, error: float):
        self.width = math.ceil(1 / error)
        self.rows = 0
        self.entries: dict = {}

    def add(self, items: pa.Array) -> None:
        at = 0
        while at < len(items):
            step = min(self.width - self.rows % self.width, len(items) - at)
            bucket = self.rows // self.width + 1
            counted = pc.value_counts(items.slice(at, step))
            for item, n in zip(counted.field(0).to_pylist(), counted.field(1).to_pylist()):
                entry = self.entries.get(item)
                if entry is None:
                    self.entries[item] = [n, bucket - 1]
                else:
                    entry[0] += n
            at += step
            self.rows += step
            if self.rows % self.width == 0:
                self.entries = {k: e for k, e in self.entries.items() if e[0] + e[1] > bucket}

    @property
    def hidden(self) -> int:
        """The most an item without an entry can have occurred."""
        return self.rows // self.width


def summarize(df: DataFrame, item: str, groups: Sequence[str] = (), error: float = 1e-4) -> DataFrame:
    """Mergeable summaries: one row per partition, group and kept item.

    ``groups`` must have few combinations (assays, tables), as each has its own
    counter. Null items are not counted. A row with a null item carries, per
    partition and group, the counted rows and the undercount of absent items.
    """
    grp = F.to_json(F.struct(*[col(g).alias(g) for g in groups]), {"ignoreNullFields": "false"}) if groups else F.lit("{}")
    cells = df.filter(col(item).isNotNull()).select(grp.alias("grp"), col(item).cast("string").alias("item"))

    def count(batches):
        counters: dict[str, LossyCounter] = {}
        for batch in batches:
            keys = batch.column(0).dictionary_encode()
            for code, name in enumerate(keys.dictionary.to_pylist()):
                items = batch.column(1)
                if len(keys.dictionary) > 1:
                    items = items.filter(pc.equal(keys.indices, code))
                counters.setdefault(name, LossyCounter(error)).add(items)
        for name, c in counters.items():
            rows = [(name, None, 0, 0, c.rows, c.hidden)] + [(name, k, n, d, 0, c.hidden) for k, (n, d) in c.entries.items()]
            for a in range(0, len(rows), 10_000):
                cols = list(zip(*rows[a : a + 10_000]))
                kinds = [pa.string(), pa.string()] + [pa.int64()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, kinds)], names=["grp", "item", "n", "delta", "rows", "hidden"])

    # Written once: the passes that follow must not count anew.
    return cut(cells.mapInArrow(count, SUMMARY))


def intervals(summaries: DataFrame) -> DataFrame:
    """grp, item, low, high, total: the true count lies in [low, high].

    Takes the union of any summaries. ``total`` is the group's counted rows.
    """
    totals = summaries.filter("item is null").groupBy(F.col("grp").alias("tg")).agg(F.sum("rows").alias("total"), F.sum("hidden").alias("all_hidden"))
    items = summaries.filter("item is not null").groupBy("grp", "item").agg(F.sum("n").alias("low"), F.sum("delta").alias("d"), F.sum("hidden").alias("h"))
    joined = items.join(F.broadcast(totals), F.col("grp") == F.col("tg"))
    return joined.select("grp", "item", "low", (F.col("low") + F.col("d") + F.col("all_hidden") - F.col("h")).alias("high"), "total")


def frequent_items(df: DataFrame, item: str, groups: Sequence[str] = (), support: float = 0.005, error: float | None = None) -> DataFrame:
    """Items that may hold ``support`` of their group's non-null rows or more.

    Returns ``groups..., item, low, high, total``; groups keep their types, null
    ones are groups like others, items are strings. No item at or above the
    support is missing; items whose interval straddles it are included. With
    ``error`` (a twentieth of the support by default) as the bound of the
    undercount, fewer than ``1 / (support - error)`` items a group can result.
    An empty table gives no rows.
    """
    error = error or support / 20
    if not 0 < error < support <= 1:
        raise ValueError("0 < error < support <= 1 must hold")
    kept = intervals(summarize(df, item, groups, error)).filter(F.col("high") >= F.col("total") * F.lit(Decimal(str(support))))
    shape = T.StructType([T.StructField(g, df.schema[g].dataType) for g in groups])
    names = F.from_json("grp", shape)
    return kept.select(*[names[g].alias(g) for g in groups], F.col("item").alias(item), "low", "high", "total")


def exactly(df: DataFrame, candidates: DataFrame, item: str, groups: Sequence[str], support: float) -> DataFrame:
    """The candidates with their exact counts, those below ``support`` left out.

    The candidates are few by construction (see :func:`frequent_items`), so the
    second pass is a broadcast join and a count; no row is shuffled by item.
    """
    keys = [*groups, item]
    few = candidates.select(*[col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("total").alias("__total"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & col(k).cast(few.schema[f"__k{i}"].dataType).eqNullSafe(F.col(f"__k{i}"))
    exact = df.join(F.broadcast(few), same).groupBy(*[F.col(f"__k{i}").alias(k) for i, k in enumerate(keys)]).agg(F.count(F.lit(1)).alias("__n"), F.first("__total").alias("__total"))
    exact = exact.filter(F.col("__n") >= F.col("__total") * F.lit(Decimal(str(support))))
    return exact.select(*[col(k) for k in keys], F.col("__n").alias("n"), F.col("__total").alias("total"))
