"""The public entry points: splitting reads, splitting and summarising BAM,
rewriting SAM comments."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import repeat

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readroute.functions import seq as fn
from readroute.operators import routing, split
from readroute.operators.anchors import Options
from readroute.operators.barcodes import BarcodeContext
from readroute.sources.bam import bam_header, read_bam, write_bam_groups
from readroute.sources.dispatch import format_of, write_reads
from readroute.sources.fastq import read_fastq, write_fastq
from readroute.sources.files import expand, write_files

ROUTES = ("atac", "gex", "other", "technical")


def split_reads(
    spark: SparkSession,
    inputs: str | Sequence[str],
    atac: str | Sequence[str],
    gex: str | Sequence[str],
    other: str | Sequence[str],
    technical: str | Sequence[str] | None = None,
    *,
    context: BarcodeContext,
    keep_runoff: bool = False,
    only_valid: bool = False,
    n_records: int | None = None,
) -> list:
    """Splits FASTQ files into ATAC, GEX, other and, if asked, technical ones.

    One path each, or lists of them (the shortest ends all). Outputs named
    ``.fastq``, ``.fastq.gz`` or ``.bam`` become single files, written in parts
    and joined; any other name becomes a folder of FASTQ parts. All inputs are
    one scan, and each read is searched once. Returns the counts [ATAC, GEX,
    other] of written reads, per file for lists.
    """
    single = isinstance(inputs, str)
    listed = lambda x: repeat(None) if x is None else [x] if isinstance(x, str) else x
    jobs = list(zip(listed(inputs), listed(atac), listed(gex), listed(other), listed(technical)))
    for job in jobs:
        if job[0].endswith(".bam"):
            raise ValueError(f"reads are split from FASTQ, not from {job[0]}")
    if not jobs:
        return []
    # An input may be a folder, and may be named more than once.
    named = [(path, k) for k, job in enumerate(jobs) for path in sorted(expand(job[0]))]
    owners = spark.createDataFrame(named or [("", 0)], "path string, job int")
    reads = read_fastq(spark, sorted({p for p, _ in named}), n_records=n_records).join(F.broadcast(owners), "path")
    routed = routing.demux(reads, context, Options(keep_runoff=keep_runoff), only_valid)
    made = routing.records(routed, technical is not None).select("job", "path", "rec_pos", "route", "header", "seq", "qual", "tags")
    n = {(r.job, r.route): r.n for r in made.groupBy("job", "route").agg(F.count(F.lit(1)).alias("n")).collect()}
    grouped = made.withColumn("to", F.concat_ws("/", F.col("job").cast("string"), "route"))
    files = {f"{k}/{route}": path for k, (_, *outs) in enumerate(jobs) for route, path in zip(ROUTES, outs) if path is not None}
    for kind, suffixes in (("fastq", (".fastq", ".fastq.gz")), ("bam", (".bam",))):
        own = {g: p for g, p in files.items() if p.endswith(suffixes)}
        if own:
            write_reads(grouped, own, "to", ("path", "rec_pos"), kind)
    for g, path in files.items():
        if not path.endswith((".fastq", ".fastq.gz", ".bam")):
            write_fastq(grouped.filter(F.col("to") == g), path)
    result = [[n.get((k, r), 0) for r in ROUTES[:3]] for k in range(len(jobs))]
    return result[0] if single else result


def summarize_bam(spark: SparkSession, path: str, barcode_tag: str = "CB", missing_ok: bool = False) -> DataFrame:
    return split.summarize(read_bam(spark, path, ["flag", "seq", "tags"]), barcode_tag, missing_ok)


def split_bam(
    spark: SparkSession,
    path: str,
    lookup: Mapping[str, str] | DataFrame,
    out_path: str | None = None,
    output_files: Mapping[str, str] | None = None,
    out_prefix: str = "",
    barcode_tag: str = "CB",
) -> dict[str, int]:
    """Splits a BAM file by barcode group; returns the reads written to each.

    Unmapped reads, those without the tag, and unknown barcodes are left out.
    Every group gets a file with the source's header, in the source's order.
    """
    format_of(path, "bam")
    table = lookup if isinstance(lookup, DataFrame) else spark.createDataFrame(list(lookup.items()), "barcode string, grp string")
    groups = [r.grp for r in table.select("grp").distinct().collect()]
    paths = split.output_paths(groups, out_path, output_files, out_prefix)
    text, refs = bam_header(path)
    rows = read_bam(spark, path).withColumn("barcode", split.first_tag(F.col("tags"), barcode_tag)).withColumn("is_mapped", F.col("flag").bitwiseAND(split.UNMAPPED) == 0)
    chosen = split.split_rows(rows, table).persist()
    try:
        write_bam_groups(chosen, paths, text, refs)
        return {r.grp: r.n for r in split.split_counts(chosen, table).collect()}
    finally:
        chosen.unpersist()


def sam_comments_to_tags(spark: SparkSession, sam_file: str, output: str, comment_prefix=fn.SAM_COMMENTS, tag_prefix=fn.SAM_TAGS, token_bound: bool = False) -> None:
    """Rewrites a SAM file's comments as tags; lines keep their order."""
    line = fn.sam_line(F.col("value"), comment_prefix, tag_prefix, token_bound)
    lines = spark.read.text(sam_file).select(F.monotonically_increasing_id().alias("at"), line.alias("value"))
    if output.endswith(".sam"):
        write_files(lines.withColumn("to", F.lit("0")), {"0": output}, "to", ("at",), lambda r: (r["value"] + "\n").encode("utf-8"), bytes)
        return
    lines.sortWithinPartitions("at").select("value").write.mode("overwrite").text(output)
