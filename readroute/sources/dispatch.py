"""Choosing readers and writers by a file's name."""

from __future__ import annotations

import gzip

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readroute.functions import seq as fn
from readroute.sources.bam import read_bam, write_bam_groups
from readroute.sources.fastq import read_fastq
from readroute.sources.files import write_files

# Suffixes and the formats they stand for.
SUFFIXES = {".bam": "bam", ".fastq.gz": "fastq", ".fastq": "fastq"}


def format_of(name: str | None, file_format: str | None = None) -> str:
    """``fastq`` or ``bam``; ValueError for any other suffix or format."""
    if file_format is None:
        for suffix, kind in SUFFIXES.items():
            if name and name.endswith(suffix):
                return kind
        raise ValueError(f"unknown file format: {name}")
    if file_format not in SUFFIXES.values():
        raise ValueError(f"unknown file format: {file_format}")
    return file_format


def open_reads(spark: SparkSession, name: str, file_format: str | None = None) -> DataFrame:
    return read_bam(spark, name) if format_of(name, file_format) == "bam" else read_fastq(spark, name)


def writer_for(name: str | None = None, file_format: str | None = None):
    """``write(df, path, order=())`` of the format: ``df`` has ``header, seq,
    qual``, and may have ``tags`` for BAM; rows are written as one file in the
    order of the columns named."""
    kind = format_of(name, file_format)
    return lambda df, path, order=(): write_reads(df.withColumn("__to", F.lit("0")), {"0": path}, "__to", order, kind)


def write_reads(df: DataFrame, paths: dict[str, str], group: str, order: tuple[str, ...] = (), file_format: str = "fastq") -> None:
    """Writes each group's reads to its file, all of one format."""
    zipped = [p.endswith(".gz") for p in paths.values()]
    if file_format == "bam":
        write_bam_groups(df.select(group, *order, *unaligned(df)), paths, group=group, order=order)
        return
    lines = df.select(group, *order, fn.fastq_record(F.col("header"), F.col("seq"), F.col("qual")).alias("__record"))
    for pack, own in ((bytes, [p for p, z in zip(paths, zipped) if not z]), (gzip.compress, [p for p, z in zip(paths, zipped) if z])):
        if own:
            write_files(lines, {p: paths[p] for p in own}, group, order, lambda r: (r["__record"] + "\n").encode("utf-8"), pack)


def unaligned(df: DataFrame) -> list[Column]:
    """The columns of unaligned BAM records of reads."""
    name = F.regexp_replace(F.coalesce(fn.control_id(F.col("header")), F.lit("*")), "^@", "")
    kind = "array<struct<k:string,type:string,v:string>>"
    tags = F.transform(F.filter("tags", lambda t: t["v"].isNotNull()), lambda t: F.struct(t["k"].alias("k"), F.lit("Z").alias("type"), t["v"].alias("v"))) if "tags" in df.columns else F.array().cast(kind)
    return [
        name.alias("name"), F.lit(4).alias("flag"), F.lit(-1).alias("ref_id"), F.lit(-1).alias("pos"), F.lit(0).alias("mapq"), F.lit("*").alias("cigar"),
        F.lit(-1).alias("next_ref"), F.lit(-1).alias("next_pos"), F.lit(0).alias("tlen"), F.col("seq"), fn.scores(F.col("qual")).alias("qual"), tags.alias("tags"),
    ]
