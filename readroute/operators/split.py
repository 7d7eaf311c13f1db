"""Splitting aligned reads by barcode group, and summarising them."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readroute.session import col

UNMAPPED = 4


def first_tag(tags: Column, name: str) -> Column:
    found = F.filter(tags, lambda t: t["k"] == name)
    return F.when(F.size(found) > 0, found[0]["v"])


def summarize(bam: DataFrame, tag: str = "CB", missing_ok: bool = False, length: str | None = None) -> DataFrame:
    """(barcode, length, is_mapped) of every read. A read without the tag
    fails the query unless ``missing_ok``, which gives it a null barcode.
    ``length`` names a column of lengths for reads without ``seq``."""
    value = first_tag(F.col("tags"), tag)
    if not missing_ok:
        value = F.coalesce(value, F.raise_error(F.lit(f"a read has no tag {tag}")).cast("string"))
    return bam.select(value.alias("barcode"), (F.length("seq").cast("int") if length is None else col(length)).alias("length"), (F.col("flag").bitwiseAND(UNMAPPED) == 0).alias("is_mapped"))


def split_rows(rows: DataFrame, lookup: DataFrame, barcode: str = "barcode", mapped: str = "is_mapped") -> DataFrame:
    """The mapped rows whose barcode is in the lookup (``barcode, grp``), with
    their group. Unmapped rows, null and unknown barcodes are left out."""
    groups = lookup.select(F.col("barcode").alias("__b"), "grp")
    return rows.filter(col(mapped)).join(groups, col(barcode) == F.col("__b")).drop("__b")


def split_counts(split: DataFrame, lookup: DataFrame) -> DataFrame:
    """(grp, n) for every group of the lookup, 0 where nothing was written."""
    n = split.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    return lookup.select("grp").distinct().join(n, "grp", "left").select("grp", F.coalesce("n", F.lit(0)).alias("n"))


def output_paths(groups: Iterable[str], out_path: str | None = None, output_files: Mapping[str, str] | None = None, prefix: str = "") -> dict[str, str]:
    """Where each group goes. Given files must name exactly the groups."""
    groups = set(groups)
    if output_files is None:
        if out_path is None:
            raise ValueError("either out_path or output_files is needed")
        return {g: f"{out_path.rstrip('/')}/{prefix}{g}_bam.bam" for g in groups}
    odd = groups ^ set(output_files)
    if odd:
        raise ValueError(f"Non-overlapping output_files and lookup groups: {sorted(odd)}")
    return dict(output_files)


def differing_groups(lookup: DataFrame, outputs: DataFrame) -> DataFrame:
    """Groups named on one side only (the check of :func:`output_paths`)."""
    a, b = lookup.select("grp").distinct(), outputs.select("grp").distinct()
    return a.exceptAll(b).unionByName(b.exceptAll(a))
