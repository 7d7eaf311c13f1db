"""Queries of the problems tagged llm, and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readroute.llm import bpe, canonical, components, distinct, frequent, mixing, percentiles, toxicity
from readroute.session import cut, load

#: Buckets through which p7_counts joins its groups with each other.
_BUCKETS = 64
PROBS = (0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def _lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "bam_summary").select("barcode", "length", F.to_date("run_at").cast("string").alias("run_day"))


def _rounded(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, "n_values", *[F.round(c, 6).alias(c) for c in df.columns if c not in (*keys, "n_values")])


def p2_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Barcodes, cell groups and run days from one pass over the rows.

    The partial of (barcode, run day) is made once; the coarser ones merge it.
    """
    fine = cut(percentiles.partial(_lengths(spark, sf_dir), ["barcode", "run_day"], "length"))
    lookup = load(spark, sf_dir, "barcode_lookup").select("barcode", "grp")

    def named(kind: str, name: F.Column, rows: DataFrame) -> DataFrame:
        return rows.select(F.struct(F.lit(kind).alias("kind"), name.alias("name")).alias("g"), "value", "n")

    grouped = fine.withColumn("barcode", F.col("g.barcode")).join(lookup, "barcode")
    parts = percentiles.merge(named("barcode", F.col("g.barcode"), fine), named("day", F.col("g.run_day"), fine), named("group", F.col("grp"), grouped))
    return _rounded(percentiles.percentiles(parts, PROBS), "kind", "name")


def p2_barcode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(percentiles.percentiles(percentiles.partial(_lengths(spark, sf_dir), ["barcode"], "length"), PROBS), "barcode")


def p2_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cell groups, merged from the partials of the run days."""
    lookup = load(spark, sf_dir, "barcode_lookup").select("barcode", "grp")
    parts = percentiles.partial(_lengths(spark, sf_dir).join(lookup, "barcode"), ["grp", "run_day"], "length")
    merged = parts.groupBy(F.struct(F.col("g.grp").alias("grp")).alias("g"), "value").agg(F.sum("n").alias("n"))
    return _rounded(percentiles.percentiles(merged, PROBS), "grp")


def p2_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(percentiles.percentiles(percentiles.partial(_lengths(spark, sf_dir), ["run_day"], "length"), PROBS), "run_day")


def _raw_barcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    gex = load(spark, sf_dir, "gex_tags").select(F.lit("gex").alias("assay"), "cr")
    return gex.unionByName(load(spark, sf_dir, "atac_tags").select(F.lit("atac").alias("assay"), "cr"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _raw_barcodes(spark, sf_dir)
    candidates = frequent.frequent_items(rows, "cr", ["assay"], 0.005)
    return frequent.exactly(rows, candidates, "cr", ["assay"], 0.005).select("assay", "cr")


def p3_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequent.frequent_items(_raw_barcodes(spark, sf_dir), "cr", ["assay"], 0.005)


def p3_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per assay, how many intervals miss the exact count, and how many items
    at or above the support have none."""
    rows = _raw_barcodes(spark, sf_dir)
    exact = rows.filter("cr is not null").groupBy("assay", "cr").agg(F.count(F.lit(1)).alias("n"))
    held = exact.join(frequent.frequent_items(rows, "cr", ["assay"], 0.005), ["assay", "cr"], "left")
    totals = exact.groupBy("assay").agg(F.sum("n").alias("all_rows"))
    missed = held.join(totals, "assay").withColumn("heavy", F.col("n") >= 0.005 * F.col("all_rows"))
    return missed.groupBy("assay").agg(F.count_if(~F.col("n").between(F.col("low"), F.col("high"))).alias("outside"), F.count_if(F.col("heavy") & F.col("low").isNull()).alias("missing"))


def _canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for assay in ("gex", "atac"):
        tags = load(spark, sf_dir, f"{assay}_tags").select("row_id", "cr")
        found = canonical.to_canonical(tags, "cr", load(spark, sf_dir, f"whitelist_{assay}"), "barcode", keep=("row_id",))
        found = found.withColumn("assay", F.lit(assay))
        out = found if out is None else out.unionByName(found)
    return out


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _canonical(spark, sf_dir).filter("entry is not null").select("assay", "row_id", F.col("entry").alias("barcode"))


def p4_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values without one closest entry, by how many entries were as close."""
    return _canonical(spark, sf_dir).filter("entry is null").groupBy("assay", "cr", "ties", "suggestion").agg(F.count(F.lit(1)).alias("n_rows"))


def p4_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many entries are closest to each row's value, 0 where none is near."""
    return _canonical(spark, sf_dir).select("assay", "row_id", "ties", "distance")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = components.connected_components(load(spark, sf_dir, "umi_pairs"), "left_id", "right_id")
    rows = load(spark, sf_dir, "gex_tags").select("row_id")
    return rows.join(groups, F.col("row_id") == F.col("node")).select("row_id", F.col("component").alias("group_id"))


def _partners(groups: DataFrame) -> DataFrame:
    """Every group with the name of every other: ``name, registers, partner``.

    The names are joined with themselves through a key, each in one of its
    buckets on one side and in all on the other. Groups without a name have no
    partner.
    """
    groups = groups.filter("name is not null")
    bucket = F.pmod(F.xxhash64("name"), F.lit(_BUCKETS)).cast("int")
    dealt = groups.select(F.col("name").alias("partner"), bucket.alias("bucket"))
    named = groups.select("name", F.explode(F.sequence(F.lit(0), F.lit(_BUCKETS - 1))).alias("bucket"))
    return groups.join(named.join(dealt, "bucket").drop("bucket").filter("name <> partner"), "name")


def p7_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different ub per run day, cb, cell group, pair of groups, and in all groups."""
    return distinct.estimate(_sketches(spark, sf_dir))


def p7_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact counts of days, cb and groups, and whether they lie within the
    interval of p7_counts at a confidence that lets no row miss by chance."""
    tags = load(spark, sf_dir, "gex_tags").select("cb", "ub", F.to_date("run_at").cast("string").alias("run_day")).filter("ub is not null")
    lookup = load(spark, sf_dir, "barcode_lookup").select(F.col("barcode").alias("cb"), "grp")
    kinds = [(tags, "run_day", "day"), (tags, "cb", "cb"), (tags.join(lookup, "cb"), "grp", "group")]
    exact = None
    for rows, name, kind in kinds:
        one = rows.filter(f"{name} is not null").groupBy(F.lit(kind).alias("kind"), F.col(name).alias("name")).agg(F.countDistinct("ub").alias("n_exact"))
        exact = one if exact is None else exact.unionByName(one)
    bounds = distinct.estimate(_sketches(spark, sf_dir), confidence=1 - 1e-9)
    return exact.join(bounds, ["kind", "name"], "left").select("kind", "name", "n_exact", F.coalesce(F.col("n_exact").between(F.col("low"), F.col("high")), F.lit(False)).alias("within"))


def _sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass makes the sketches of days and cb; all others are merged from them."""
    tags = load(spark, sf_dir, "gex_tags").select("cb", "ub", F.to_date("run_at").cast("string").alias("run_day"))
    parts = F.array(F.struct(F.lit("day").alias("kind"), F.col("run_day").alias("name")), F.struct(F.lit("cb").alias("kind"), F.col("cb").alias("name")))
    keyed = tags.select("ub", F.inline(parts)).filter("name is not null")
    fine = cut(distinct.sketch(keyed, ["kind", "name"], "ub"))
    lookup = load(spark, sf_dir, "barcode_lookup").select(F.col("barcode").alias("name"), "grp")
    in_groups = fine.filter("kind = 'cb'").join(lookup, "name").select(F.lit("group").alias("kind"), F.col("grp").alias("name"), "registers")
    groups = cut(distinct.merge(in_groups, ["kind", "name"]))
    pairs = _partners(groups).select(F.lit("union").alias("kind"), F.concat_ws("+", F.least("name", "partner"), F.greatest("name", "partner")).alias("name"), "registers")
    whole = groups.select(F.lit("union").alias("kind"), F.lit("all groups").alias("name"), "registers")
    unions = distinct.merge(pairs.unionByName(whole), ["kind", "name"])
    return fine.unionByName(groups).unionByName(unions)


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(load(spark, sf_dir, "documents").select("doc_id", "text"), "text")


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", "text")
    rows = mixing.sized(bpe.count_tokens(docs, "text"), "doc_id", "source", "n_tokens")
    return rows, mixing.plan(rows, load(spark, sf_dir, "mix_targets"))


def p9_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.select(*_mixed(spark, sf_dir)).withColumnRenamed("size", "n_tokens")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, plans = _mixed(spark, sf_dir)
    return mixing.shares(mixing.select(rows, plans), plans)


def p9_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per mix and source: whether it has documents, whether its share of the
    tokens is the target's among such sources to within the largest document,
    and whether no document is used more often than allowed."""
    rows, plans = _mixed(spark, sf_dir)
    got = mixing.shares(mixing.select(rows, plans), plans)
    largest = rows.groupBy("source").agg(F.max("size").alias("largest"), F.lit(True).alias("there"))
    present = got.join(largest, "source", "left").withColumn("present", F.col("source_tokens") > 0)
    wanted = present.filter("present").groupBy("mix").agg(F.sum("target_share").alias("share_present"))
    joined = present.join(wanted, "mix", "left")
    off = F.abs(F.col("used_tokens") - F.col("mix_tokens") * F.col("target_share") / F.col("share_present"))
    biggest = F.max("largest").over(Window.partitionBy("mix"))
    return joined.select("mix", "source", "present", (~F.col("present") | (off <= 2 * biggest)).alias("share_kept"), (F.col("most_repeats") <= F.col("max_repeats")).alias("repeats_kept"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score(docs, "text").filter(F.col("score") >= toxicity.CASE).select("doc_id")


def p10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(load(spark, sf_dir, "documents").select("doc_id", "source", "text"), "text")


def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.rates(p10_scores(spark, sf_dir), "source")


QUERIES = {f.__name__: f for f in (p2_percentiles, p2_barcode, p2_group, p2_day, p3_found, p3_intervals, p3_bounds, p4_found, p4_unmatched, p4_ties, p6_found, p7_counts, p7_coverage, p8_ids, p9_selection, p9_shares, p9_checks, p10_found, p10_scores, p10_rates)}


_DAYS = "(SELECT CAST(CAST(run_at AS DATE) AS VARCHAR) AS run_day, length FROM bam_summary)"


def _percentile_sql(key: str, source: str, by: str | None = None) -> str:
    cols = ", ".join(f"round(quantile_cont(CAST(length AS DOUBLE), {q}), 6) AS p{round(100 * q)}" for q in PROBS)
    return f"SELECT {key}, count(length) AS n_values, {cols} FROM {source} WHERE length IS NOT NULL GROUP BY {by or key}"


_CANONICAL_SQL = """
WITH t AS (SELECT 'gex' AS assay, row_id, cr FROM gex_tags UNION ALL SELECT 'atac', row_id, cr FROM atac_tags),
wl AS (SELECT 'gex' AS assay, barcode FROM whitelist_gex UNION ALL SELECT 'atac', barcode FROM whitelist_atac),
odd AS (SELECT * FROM t WHERE cr IS NOT NULL AND NOT EXISTS (SELECT 1 FROM wl WHERE wl.assay = t.assay AND wl.barcode = t.cr)),
words AS (SELECT DISTINCT assay, cr, upper(regexp_replace(cr, '[^A-Za-z]', '', 'g')) AS w FROM odd),
near AS (SELECT words.assay, cr, barcode, levenshtein(w, barcode) AS d FROM words JOIN wl ON wl.assay = words.assay AND length(w) BETWEEN 14 AND 18 WHERE levenshtein(w, barcode) <= 2),
best AS (SELECT assay, cr, min(barcode) AS barcode FROM (SELECT *, min(d) OVER (PARTITION BY assay, cr) AS m FROM near) WHERE d = m GROUP BY assay, cr HAVING count(*) = 1)
"""

ORACLES = {
    "p6_found": """
WITH RECURSIVE e AS (SELECT left_id AS u, right_id AS v FROM umi_pairs WHERE left_id <> right_id
                     UNION SELECT right_id, left_id FROM umi_pairs WHERE left_id <> right_id),
reach(u, v) AS (SELECT u, v FROM e UNION SELECT r.u, e.v FROM reach r JOIN e ON e.u = r.v)
SELECT row_id, least(row_id, min(v)) AS group_id FROM gex_tags JOIN reach ON u = row_id GROUP BY row_id""",
    "p4_found": _CANONICAL_SQL + "SELECT odd.assay, odd.row_id, best.barcode FROM odd JOIN best ON best.assay = odd.assay AND best.cr = odd.cr",
    "p4_ties": _CANONICAL_SQL + """, every AS (SELECT assay, cr, count(*) AS ties, min(d) AS distance FROM (SELECT *, min(d) OVER (PARTITION BY assay, cr) AS m FROM near) WHERE d = m GROUP BY assay, cr)
SELECT odd.assay, odd.row_id, CAST(coalesce(ties, 0) AS INTEGER) AS ties, CAST(distance AS INTEGER) AS distance FROM odd LEFT JOIN every ON every.assay = odd.assay AND every.cr = odd.cr""",
    "p3_bounds": "SELECT assay, CAST(0 AS BIGINT) AS outside, CAST(0 AS BIGINT) AS missing FROM (VALUES ('gex'), ('atac')) t(assay)",
    "p7_coverage": """
WITH t AS (SELECT cb, ub, CAST(CAST(run_at AS DATE) AS VARCHAR) AS run_day FROM gex_tags WHERE ub IS NOT NULL)
SELECT 'day' AS kind, run_day AS name, count(DISTINCT ub) AS n_exact, true AS within FROM t WHERE run_day IS NOT NULL GROUP BY run_day
UNION ALL SELECT 'cb', cb, count(DISTINCT ub), true FROM t WHERE cb IS NOT NULL GROUP BY cb
UNION ALL SELECT 'group', grp, count(DISTINCT ub), true FROM t JOIN barcode_lookup ON barcode = cb WHERE grp IS NOT NULL GROUP BY grp""",
    "p9_checks": """
SELECT DISTINCT mix, m.source, EXISTS (SELECT 1 FROM documents d WHERE d.source = m.source AND d.text <> '') AS present, true AS share_kept, true AS repeats_kept
FROM mix_targets m WHERE mix IS NOT NULL AND m.source IS NOT NULL""",
    "p2_percentiles": " UNION ALL ".join(
        _percentile_sql(f"'{kind}' AS kind, {name} AS name", source, name)
        for kind, name, source in (("barcode", "barcode", "bam_summary"), ("group", "grp", "bam_summary JOIN barcode_lookup USING (barcode)"), ("day", "run_day", _DAYS))
    ),
    "p2_barcode": _percentile_sql("barcode", "bam_summary"),
    "p2_group": _percentile_sql("grp", "bam_summary JOIN barcode_lookup USING (barcode)"),
    "p2_day": _percentile_sql("run_day", _DAYS),
    "p3_found": """
WITH t AS (SELECT 'gex' AS assay, cr FROM gex_tags UNION ALL SELECT 'atac', cr FROM atac_tags)
SELECT assay, cr FROM t WHERE cr IS NOT NULL GROUP BY assay, cr
HAVING count(*) >= 0.005 * (SELECT count(u.cr) FROM t u WHERE u.assay = t.assay)""",
}
