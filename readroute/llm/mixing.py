"""Mixing sources to target shares of the total size, with capped repeats.

Nothing is sorted. Every document has a 60-bit key from the hash of its id.
Tokens are summed by source and key bucket (4096 buckets a level); for each mix
and source the bucket is found in which the budget is used up, and only that
bucket is split again, level by level, until it holds one key. What results is
one threshold a mix and source: a document is used when its key lies below it.
The selection is a filter against a table of the size of the targets.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readroute.session import col, cut

BITS, LEVEL_BITS = 60, 12
#: Mixes times sources at most: each has a histogram on the driver.
MOST_TARGETS = 10_000

PLAN = "mix string, source string, target_share double, max_repeats int, source_tokens long, wanted_tokens double, whole_repeats int, threshold long"


def sized(docs: DataFrame, doc_id: str, source: str, size: str) -> DataFrame:
    """(doc_id, source, size, key), written once for the passes that follow."""
    key = F.shiftrightunsigned(F.xxhash64(col(doc_id)), 64 - BITS)
    return cut(docs.select(col(doc_id).alias("doc_id"), col(source).alias("source"), F.coalesce(col(size).cast("long"), F.lit(0)).alias("size"), key.alias("key")))


def plan(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """For each mix and source of ``targets``: how often every document is used
    (``whole_repeats``), and below which key once more (``threshold``).

    A mix's total is the largest at which no source exceeds its repeats: the
    least of ``max_repeats * tokens / share`` over its sources that have any
    tokens. Sources without tokens cannot take part; theirs is reported as 0.
    Targets repeated for a mix and source add up, with the larger cap; shares
    that are null, or not above 0, and caps below 1 want nothing.
    """
    spark = rows.sparkSession
    wanted = (
        targets.filter("mix is not null and source is not null")
        .groupBy("mix", "source")
        .agg(F.sum(F.when(F.col("target_share") > 0, F.col("target_share")).otherwise(0.0)).alias("share"), F.max(F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0))).alias("cap"))
        .limit(MOST_TARGETS + 1)
        .collect()
    )
    if len(wanted) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} targets; plan the mixes in parts")
    names = spark.createDataFrame([(s,) for s in {w.source for w in wanted}], "source string")
    mine = rows.join(F.broadcast(names), "source")
    tokens = {r.source: r.n for r in mine.groupBy("source").agg(F.sum("size").alias("n")).collect()}
    total: dict[str, float] = {}
    for w in wanted:
        if w.share > 0 and tokens.get(w.source):
            total[w.mix] = min(total.get(w.mix, math.inf), w.cap * tokens[w.source] / w.share)
    out, open_ = {}, {}
    for w in wanted:
        have = tokens.get(w.source, 0)
        want = w.share * total.get(w.mix, 0.0) if have else 0.0
        whole = min(int(want // have), w.cap) if have else 0
        rest = want - whole * have if whole < w.cap else 0.0
        out[w.mix, w.source] = [w.share, w.cap, have, want, whole, 0]
        if rest > 0:
            open_[w.mix, w.source] = (0, rest)
    level = 0
    while open_ and level * LEVEL_BITS < BITS:
        level += 1
        open_ = _refine(spark, mine, open_, level, out)
    table = [(mix, source, *v) for (mix, source), v in out.items()]
    return spark.createDataFrame(table, PLAN)


def _refine(spark, mine: DataFrame, open_: dict, level: int, out: dict) -> dict:
    """Splits the boundary bucket of every open threshold once more."""
    shift = BITS - LEVEL_BITS * level
    prefixes = spark.createDataFrame(sorted({(s, p) for (_, s), (p, _) in open_.items()}), "source string, prefix long")
    bucket = F.shiftrightunsigned("key", shift)
    inside = mine.join(F.broadcast(prefixes), ["source"]).filter(F.shiftrightunsigned("key", shift + LEVEL_BITS) == F.col("prefix"))
    # At most 4096 rows a target: its histogram, not its documents.
    histogram: dict = {}
    for r in inside.groupBy("source", "prefix", bucket.alias("bucket")).agg(F.sum("size").alias("n"), (F.min("key") < F.max("key")).alias("many")).collect():
        histogram.setdefault((r.source, r.prefix), []).append((r.bucket, r.n, r.many))
    left = {}
    for (mix, source), (prefix, budget) in open_.items():
        threshold = prefix << (shift + LEVEL_BITS)
        for b, n, many in sorted(histogram.get((source, prefix), [])):
            if n <= budget:
                budget -= n
                threshold = (b + 1) << shift
            elif many:
                left[mix, source] = (b, budget)
                break
            else:
                # The last one is used if that comes nearer to the budget.
                threshold = (b + 1 if n - budget < budget else b) << shift
                break
        out[mix, source][5] = threshold
    return left


def select(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """(mix, doc_id, source, size, repeats) of every document a mix uses."""
    used = rows.join(F.broadcast(plans.select("mix", "source", "whole_repeats", "threshold")), "source")
    used = used.withColumn("repeats", F.col("whole_repeats") + (F.col("key") < F.col("threshold")).cast("int"))
    return used.filter("repeats > 0").select("mix", "doc_id", "source", "size", "repeats")


def shares(selection: DataFrame, plans: DataFrame) -> DataFrame:
    """The share of each source really reached, those of absent sources too."""
    used = selection.groupBy("mix", "source").agg(F.sum(F.col("size") * F.col("repeats")).alias("used_tokens"), F.count(F.lit(1)).alias("n_docs"), F.max("repeats").alias("most_repeats"))
    joined = plans.select("mix", "source", "target_share", "max_repeats", "source_tokens").join(used, ["mix", "source"], "left").na.fill(0, ["used_tokens", "n_docs", "most_repeats"])
    totals = joined.groupBy("mix").agg(F.sum("used_tokens").alias("mix_tokens"))
    return joined.join(totals, "mix").withColumn("actual_share", F.when(F.col("mix_tokens") > 0, F.col("used_tokens") / F.col("mix_tokens")).otherwise(0.0))
