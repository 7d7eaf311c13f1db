"""From reads to routed, tagged and cut records, and their counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from readroute.functions import seq as fn
from readroute.operators import barcodes
from readroute.operators.anchors import Options, anchors
from readroute.session import cut


def atac_tags(bc: Column, bcq: Column, cb: Column) -> Column:
    return fn.tag_array([("CB", cb), ("CR", bc), ("CY", bcq)])


def gex_tags(bc: Column, bcq: Column, umi: Column, umiq: Column, cb: Column) -> Column:
    """UMIs are not corrected: UB repeats UR."""
    return fn.tag_array([("CB", cb), ("CR", bc), ("CY", bcq), ("UB", umi), ("UR", umi), ("UY", umiq)])


def tag(found: DataFrame, context: barcodes.BarcodeContext) -> DataFrame:
    """Adds ``cb``, ``tags`` and ``valid`` to anchored reads.

    Barcodes are corrected against their own assay's list; ATAC ones are then
    translated to the expression assay's. ``valid`` is whether there is a
    corrected barcode; reads of the route ``other`` have no tags. The anchored
    reads are written to the shared folder first: the search is the costly
    part, and the correction needs both their barcodes and the reads again.
    """
    found = cut(found)
    listed = lambda lists, route: lists.select(F.lit(route).alias("route"), "barcode")
    both = listed(context.atac, "atac").unionByName(listed(context.gex, "gex"))
    own = barcodes.corrections(found.select("route", "bc"), "bc", both, by=("route",), out="own")
    moved = context.translation.select(F.lit("atac").alias("route"), F.col("barcode").alias("own"), "translated")
    table = own.join(moved, ["route", "own"], "left").select("route", "bc", "n_rows", F.coalesce("translated", "own").alias("cb"))
    fixed = barcodes.attach(found, table, ("route", "bc"), "cb")
    tags = F.when(F.col("route") == "atac", atac_tags(F.col("bc"), F.col("bcq"), F.col("cb"))).when(F.col("route") == "gex", gex_tags(F.col("bc"), F.col("bcq"), F.col("umi"), F.col("umiq"), F.col("cb")))
    return fixed.withColumn("tags", tags).withColumn("valid", F.col("cb").isNotNull())


def valid_only(routed: DataFrame) -> DataFrame:
    """Without the anchored reads that have no valid barcode."""
    return routed.filter((F.col("route") == "other") | F.col("valid"))


def demux(reads: DataFrame, context: barcodes.BarcodeContext, options: Options = Options(), only_valid: bool = False, spread: int | None = None) -> DataFrame:
    """Routes, cuts and tags reads (``header, seq, qual`` and any others).

    ATAC is tried first, then GEX; what neither fits goes to ``other`` whole.
    With ``only_valid``, anchored reads without a valid barcode are dropped,
    not retried or sent elsewhere. Adds the anchor columns, ``cb``, ``tags``,
    ``valid``. Every read is searched once.
    """
    routed = tag(anchors(reads, options=options, spread=spread), context)
    return valid_only(routed) if only_valid else routed


def records(routed: DataFrame, technical: bool = False) -> DataFrame:
    """The output records: ``route, header, seq, qual`` and the input's others.

    The genomic part is cut out; with ``technical`` each ATAC read gives a
    second record of the route ``technical`` with what was cut around. It is
    the same pass: both come of one explode.
    """
    seq, qual, a, b = F.col("seq"), F.col("qual"), F.col("cut_start"), F.col("cut_end")
    anchored = F.col("route") != "other"
    main = F.struct(
        F.col("route"),
        F.when(anchored, fn.tagged_header(F.col("header"), F.col("tags"))).otherwise(F.col("header")).alias("header"),
        F.when(anchored, fn.cut(seq, a, b)).otherwise(seq).alias("seq"),
        F.when(anchored, fn.cut(qual, a, b)).otherwise(qual).alias("qual"),
    )
    rest = [c for c in routed.columns if c not in ("route", "header", "seq", "qual")]
    if not technical:
        return routed.select(*rest, main.alias("__r")).select(*rest, "__r.*")
    extra = F.struct(F.lit("technical").alias("route"), fn.tagged_header(F.col("header"), F.col("tags")).alias("header"), fn.remainder(seq, a, b).alias("seq"), fn.remainder(qual, a, b).alias("qual"))
    many = F.when(F.col("route") == "atac", F.array(main, extra)).otherwise(F.array(main))
    return routed.select(*rest, F.explode(many).alias("__r")).select(*rest, "__r.*")


def counts(routed: DataFrame, by: str = "file_id") -> DataFrame:
    """(by, atac, gex, other): written records, without technical ones."""
    n = lambda route: F.count_if(F.col("route") == route).alias(route)
    return routed.groupBy(by).agg(n("atac"), n("gex"), n("other"))


def observed(frame: DataFrame, name: str = "routes") -> tuple[DataFrame, Observation]:
    """``frame`` with counts by route gathered while it is written."""
    watch = Observation(name)
    n = lambda route: F.count_if(F.col("route") == route).alias(route)
    return frame.observe(watch, n("atac"), n("gex"), n("other")), watch
