"""Consolidating pairwise matches into groups (connected components).

Each round gives every record the smallest label among itself and its
neighbours, follows these pointers to their roots by pointer jumping (each jump
doubles the distance covered, until none changes), and replaces the ends of all
links by their roots. Links that became loops or repeats vanish, and at least
half of the labels of every unfinished group with them, so the number of rounds
is logarithmic in the largest group. Every jump and round is written to a table
in the shared checkpoint folder.

A record with very many links would make one join task carry them all. Keys
holding more than their share of a join's rows are counted first; there can
only be few, and their labels are broadcast while all other keys are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readroute.session import Scratch, col, cut


def _lookup(rows: DataFrame, total: int, key: str, labels: DataFrame, out: str, hot: tuple[int, int]) -> DataFrame:
    """``rows``, ``total`` of them, with the label of ``key`` as ``out``; labels
    are (node, root).

    ``hot`` is (share, floor): keys with more than 1/share of the rows and
    more than ``floor`` of them, fewer than ``share`` keys, take their labels
    from a broadcast. The label of a missing key is the key itself.
    """
    share, floor = hot
    labels = labels.select(F.col("node").alias("__k"), F.col("root").alias("__r"))
    if total <= floor:  # then no key is hot
        plain = rows.join(labels, F.col(key) == F.col("__k"), "left")
        return plain.withColumn(out, F.coalesce("__r", key)).drop("__k", "__r")
    hot = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > max(total // share, floor)).select(F.col(key).alias("node"))
    few = labels.join(F.broadcast(hot), F.col("__k") == F.col("node")).select(F.col("__k").alias("__h"), F.col("__r").alias("__hr"))
    marked = rows.join(F.broadcast(few), F.col(key) == F.col("__h"), "left")
    cold = marked.filter("__h is null").drop("__h", "__hr").join(labels, F.col(key) == F.col("__k"), "left")
    cold = cold.withColumn(out, F.coalesce("__r", key)).drop("__k", "__r")
    warm = marked.filter("__h is not null").withColumn(out, F.col("__hr")).drop("__h", "__hr")
    return cold.unionByName(warm)


def connected_components(pairs: DataFrame, left: str, right: str, hot_share: int = 256, hot_floor: int = 100_000, max_rounds: int = 64) -> DataFrame:
    """(node, component) of every record linked to at least one other record.

    ``component`` is the smallest id of the group. Pairs with a null end and
    records paired with themselves link nothing; repeats and orientation do not
    matter; without links the result is empty. Ids may be of any ordered type;
    other columns of ``pairs`` are ignored. Every round halves the unfinished
    labels at least, so ``max_rounds`` suffices for groups of 2^64 records.
    """
    with Scratch(pairs.sparkSession) as scratch:
        labels = _labels(pairs, col(left), col(right), scratch, (hot_share, hot_floor), max_rounds)
        return cut(labels.select("node", F.col("root").alias("component")))


def _labels(pairs: DataFrame, a: Column, b: Column, scratch: Scratch, hot: tuple[int, int], max_rounds: int) -> DataFrame:
    links = pairs.filter(a.isNotNull() & b.isNotNull() & (a != b))
    # What has to be known of a table is counted while it is written.
    links, seen = scratch.counted(links.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct())
    labels, n_labels = None, 0
    for _ in range(max_rounds):
        if not seen["n"]:
            return links.select(F.col("u").alias("node"), F.col("u").alias("root")) if labels is None else labels
        both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        roots = both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m"))
        roots, held = scratch.counted(roots.select("node", F.least("node", "m").alias("root")))
        while True:
            jumped, got = scratch.counted(_lookup(roots, held["n"], "root", roots, "far", hot), moved=F.count_if(F.col("far") != F.col("root")))
            roots = jumped.select("node", F.col("far").alias("root"))
            if not got["moved"]:
                break
        at_u = _lookup(links, seen["n"], "u", roots, "ru", hot)
        if seen["n"] > hot[1]:  # its hot keys are looked for in a pass of their own
            at_u = scratch.write(at_u)
        ends = _lookup(at_u, seen["n"], "v", roots, "rv", hot).filter("ru <> rv")
        links, seen = scratch.counted(ends.select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct())
        if labels is None:
            labels, n_labels = roots, held["n"]
        else:
            labels = scratch.write(_lookup(labels, n_labels, "root", roots, "far", hot).select("node", F.col("far").alias("root")))
    raise RuntimeError(f"labels still change after {max_rounds} rounds")
