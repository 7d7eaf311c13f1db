"""Exact percentiles of very large numeric columns, from mergeable partials.

A partial result is a table of (group, value, n): how often each value occurs.
Partials of separate files or days are merged by adding the counts, so nothing
is lost by splitting the input, and the error of every percentile is 0.

To finish, the partial is range-partitioned and sorted by (group, value) as a
whole. Each partition counts the rows of every group it holds (a handful of
numbers, as a group's share of a partition is contiguous); running sums of
these counts over the partitions give the offset at which each partition enters
each group. Target positions then fall into known partitions, where running
counts locate the two neighbouring order statistics, which are interpolated.
A group holding most rows spreads over many partitions like any other.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readroute.session import col, cut

GROUP, VALUE, COUNT = "g", "value", "n"


def partial(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """(struct of ``groups`` as g, value double, n): mergeable by :func:`merge`.

    Null and NaN values are left out; null group columns are a group like any
    other. An empty table gives an empty partial.
    """
    number = col(value).cast("double")
    return (
        df.filter(number.isNotNull() & ~F.isnan(number))
        .groupBy(F.struct(*[col(g).alias(g) for g in groups]).alias(GROUP), number.alias(VALUE))
        .agg(F.count(F.lit(1)).alias(COUNT))
    )


def merge(*partials: DataFrame) -> DataFrame:
    out = partials[0]
    for p in partials[1:]:
        out = out.unionByName(p)
    return out.groupBy(GROUP, VALUE).agg(F.sum(COUNT).alias(COUNT))


def _running_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to each row the group's running count within the sorted partition."""
    last, carry = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        n = batch.column(2).to_numpy()
        mark = batch.column(3).to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], mark[1:] != mark[:-1]]))
        cum = np.cumsum(n)
        before = cum[starts] - n[starts]
        if last == mark[0]:
            before[0] -= carry
        cum = cum - np.repeat(before, np.diff(np.append(starts, len(n))))
        last, carry = mark[-1], int(cum[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cum)], names=[*batch.schema.names, "running"])


def percentiles(parts: DataFrame, probs: Sequence[float], partitions: int | None = None) -> DataFrame:
    """One row per group: its columns, ``n_values`` and ``p<100*q>`` per q.

    Percentiles are continuous: at rank ``(n - 1) * q`` counted from 0, linear
    between the two order statistics around it. A group of one value has that
    value everywhere. Groups without a value do not appear.
    """
    for q in probs:
        if not 0 <= q <= 1:
            raise ValueError(f"{q} is no probability")
    spark = parts.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    part, running, offset, total = "part", "running", "offset", "total"
    mark = F.xxhash64(GROUP).alias("mark")
    laid = parts.repartitionByRange(partitions, GROUP, VALUE).sortWithinPartitions(GROUP, VALUE)
    laid = laid.select(GROUP, VALUE, COUNT, mark, F.spark_partition_id().alias(part))
    shape = T.StructType([*laid.schema.fields, T.StructField(running, T.LongType())])
    # The order is written out once: every pass below must see the same bounds.
    ordered = cut(laid.mapInArrow(_running_counts, shape)).drop("mark")
    counts = ordered.groupBy(GROUP, part).agg(F.max(running).alias("held"))
    by_part = Window.partitionBy(GROUP).orderBy(part)
    offsets = counts.select(
        F.col(GROUP).alias("og"),
        F.col(part).alias("op"),
        "held",
        (F.sum("held").over(by_part.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("held")).alias(offset),
        F.sum("held").over(Window.partitionBy(GROUP)).alias(total),
    )
    # Partitions that hold no target position need no second look.
    targets = F.array(*[x for q in probs for x in (F.floor((F.col(total) - 1) * F.lit(float(q))), F.ceil((F.col(total) - 1) * F.lit(float(q))))])
    wanted = offsets.filter(F.exists(targets, lambda t: (t >= F.col(offset)) & (t < F.col(offset) + F.col("held"))))
    spots = ordered.join(wanted, F.col(GROUP).eqNullSafe(F.col("og")) & (F.col(part) == F.col("op")))
    first = F.col(offset) + F.col(running) - F.col(COUNT)
    last = F.col(offset) + F.col(running) - 1
    picks = []
    for i, q in enumerate(probs):
        at = (F.col(total) - 1) * F.lit(float(q))
        for name, target in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            picks.append(F.max(F.when((target >= first) & (target <= last), F.col(VALUE))).alias(f"{name}{i}"))
    found = spots.groupBy("og").agg(F.first(total).alias(total), *picks)
    out = [F.col("og.*"), F.col(total).alias("n_values")]
    for i, q in enumerate(probs):
        at = (F.col(total) - 1) * F.lit(float(q))
        out.append((F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * (at - F.floor(at))).alias(f"p{np.format_float_positional(100 * q, trim='-').replace('.', '_')}"))
    return found.select(*out)
