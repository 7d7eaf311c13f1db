"""Queries of the general problems (1 and 5) and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readroute.operators.dense import dense_totals
from readroute.operators.rejects import load_lines
from readroute.session import load


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_lines(load(spark, sf_dir, "fastq_lines").select("raw_id", "raw_line"), "raw_line")[1].select("raw_id")


def p1_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rejected = load_lines(load(spark, sf_dir, "fastq_lines").select("raw_id", "raw_line"), "raw_line")[1]
    return rejected.select("raw_id", "reason")


def p1_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid = load_lines(load(spark, sf_dir, "fastq_lines"), "raw_line")[0]
    return valid.select("raw_id", F.col("record.rec_pos").cast("long").alias("rec_pos"), "record.header", "record.seq", "record.qual")


def p5_barcode_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per barcode and run day, from which other periods are summed."""
    rows = load(spark, sf_dir, "bam_summary").select("barcode", F.to_date("run_at").cast("string").alias("run_day"), "length", "is_mapped")
    return dense_totals(rows, ["barcode", "run_day"], ["length", "is_mapped"]).select("barcode", "run_day", "n_rows", "length_n", "length_sum", "length_min", "length_max", F.col("is_mapped_sum").alias("n_mapped"))


def p5_barcode_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense_totals(load(spark, sf_dir, "bam_summary"), "barcode", ["length", "is_mapped"]).select("barcode", "n_rows", "length_n", "length_sum", "length_min", "length_max", "is_mapped_n", F.col("is_mapped_sum").alias("n_mapped"))


def p5_cb_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = load(spark, sf_dir, "gex_tags").select("cb", F.col("ub").isNotNull().alias("has_ub"), F.length("ur").alias("umi_length"))
    return dense_totals(tags, "cb", ["has_ub", "umi_length"]).select("cb", "n_rows", F.col("has_ub_sum").alias("n_ub"), "umi_length_n", "umi_length_sum", "umi_length_min", "umi_length_max")


QUERIES = {f.__name__: f for f in (p1_found, p1_reasons, p1_records, p5_barcode_days, p5_barcode_totals, p5_cb_totals)}

# A field in DuckDB's syntax; blanks are those of Unicode.
_BLANK = r"\t-\r \x85\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_POS = r"[0-9]{1,18}"
_SEQ = r"[ACGTNacgtn]+"
_WHOLE = rf'(?s)(?:"({_POS})"|({_POS})),(?:"(@(?:[^{_BLANK}"]|"")(?:[^"]|"")*)"|(@[^{_BLANK}",][^",]*)),(?:"({_SEQ})"|({_SEQ})),(?:"((?:[!#-~]|"")+)"|([!#-+\--~]+))'

_PARSED = f"""
WITH lines AS (SELECT raw_id, regexp_replace(raw_line, '\\r\\z', '') AS t FROM fastq_lines),
parsed AS (
  SELECT raw_id, t, coalesce(regexp_full_match(t, '{_WHOLE}'), false) AS fits,
         regexp_extract(t, '{_WHOLE}', ['q1', 'rec_pos', 'q2', 'header', 'q3', 'seq', 'q4', 'qual']) AS g
  FROM lines),
records AS (
  SELECT raw_id, fits, g.q1 || g.rec_pos AS rec_pos, replace(g.q2, '""', '"') || g.header AS header,
         g.q3 || g.seq AS seq, replace(g.q4, '""', '"') || g.qual AS qual
  FROM parsed)
"""


def _reasons() -> str:
    """The ladder of prefixes in SQL: per field its shape, then its value."""
    names = ("rec_pos", "header", "seq", "qual")
    values = (_POS, rf'@[^{_BLANK}",][^",]*', _SEQ, r"[!#-+\--~]+")
    quoted = (_POS, rf'@(?:[^{_BLANK}"]|"")(?:[^"]|"")*', _SEQ, r'(?:[!#-~]|"")+')
    any_field = r'(?:"(?:[^"]|"")*"|[^",]*)'
    fields = [f'(?:"(?:{q})"|(?:{v}))' for v, q in zip(values, quoted)]
    out = "CASE WHEN t IS NULL THEN 'null_line' WHEN fits THEN 'qual_length'"
    for i, name in enumerate(names, 1):
        if i > 1:
            out += rf" WHEN regexp_matches(t, '(?s)\A{','.join([any_field] * (i - 1))}\z') THEN 'missing:{name}'"
        out += rf" WHEN NOT regexp_matches(t, '(?s)\A{','.join([any_field] * i)}(?:,|\z)') THEN 'quoting:{name}'"
        out += rf" WHEN NOT regexp_matches(t, '(?s)\A{','.join(fields[:i])}(?:,|\z)') THEN 'value:{name}'"
    return out + " ELSE 'extra_fields' END"


ORACLES = {
    "p1_reasons": _PARSED.replace("SELECT raw_id, fits, g.q1", "SELECT raw_id, t, fits, g.q1")
    + f"SELECT raw_id, {_reasons()} AS reason FROM records WHERE t IS NULL OR NOT (fits AND length(seq) = length(qual))",
    "p1_found": _PARSED + "SELECT raw_id FROM records WHERE NOT (fits AND length(seq) = length(qual))",
    "p1_records": _PARSED + "SELECT raw_id, CAST(rec_pos AS BIGINT) AS rec_pos, header, seq, qual FROM records WHERE fits AND length(seq) = length(qual)",
    "p5_barcode_days": """
SELECT barcode, CAST(CAST(run_at AS DATE) AS VARCHAR) AS run_day, count(*) AS n_rows, count(length) AS length_n,
       CAST(sum(length) AS BIGINT) AS length_sum, CAST(min(length) AS BIGINT) AS length_min,
       CAST(max(length) AS BIGINT) AS length_max, CAST(sum(CAST(is_mapped AS BIGINT)) AS BIGINT) AS n_mapped
FROM bam_summary GROUP BY ALL""",
    "p5_barcode_totals": """
SELECT barcode, count(*) AS n_rows, count(length) AS length_n, CAST(sum(length) AS BIGINT) AS length_sum,
       CAST(min(length) AS BIGINT) AS length_min, CAST(max(length) AS BIGINT) AS length_max,
       count(is_mapped) AS is_mapped_n, CAST(sum(CAST(is_mapped AS BIGINT)) AS BIGINT) AS n_mapped
FROM bam_summary GROUP BY barcode""",
    "p5_cb_totals": """
SELECT cb, count(*) AS n_rows, count(ub) AS n_ub, count(ur) AS umi_length_n, CAST(sum(length(ur)) AS BIGINT) AS umi_length_sum,
       CAST(min(length(ur)) AS BIGINT) AS umi_length_min, CAST(max(length(ur)) AS BIGINT) AS umi_length_max
FROM gex_tags GROUP BY cb""",
}
