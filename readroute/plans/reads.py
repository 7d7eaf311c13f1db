"""Queries of the engine's own operators over the supplied tables, and SQL.

Reads, tags, lists and lookups come from the domain tables; what those lack
(reads with known truth, cut positions) is derived from orders and lineitem by
md5, alike in Spark and DuckDB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readroute.functions import fixtures
from readroute.functions import seq as fn
from readroute.operators import barcodes, routing, split
from readroute.operators.anchors import GEX, Options, anchors, atac_interval_column, barcode_hits, gex_interval_column
from readroute.session import load
from readroute.sources.fastq import linked


def _reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "reads").select("path", "file_id", "rec_pos", "header", "seq", "qual")


def seq_reverse_complement(spark, sf_dir):
    return _reads(spark, sf_dir).select("file_id", "rec_pos", fn.complement_reversed(F.col("seq")).alias("rc"))


def seq_reverse(spark, sf_dir):
    return _reads(spark, sf_dir).select("file_id", "rec_pos", fn.reversed_text(F.col("qual")).alias("rev"))


def qual_decode(spark, sf_dir):
    decoded = _reads(spark, sf_dir).select("file_id", "rec_pos", fn.phred("illumina")(F.col("qual")).alias("q"))
    return decoded.select("file_id", "rec_pos", F.array_join(F.transform("q", lambda x: x.cast("string")), ",").alias("scores"), F.aggregate("q", F.lit(0), lambda a, x: a + x).cast("long").alias("total"))


def fastq_control_id(spark, sf_dir):
    return _reads(spark, sf_dir).select("file_id", "rec_pos", fn.control_id(F.col("header")).alias("control_id"))


def _mates(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The lines of orders as two linked files a day, whose ids agree but for
    every 97th record."""
    orders = load(spark, sf_dir, "orders").select(F.pmod(F.col("o_custkey"), F.lit(50)).cast("int").alias("file_id"), F.col("o_orderkey").alias("rec_pos"))
    name = lambda other: F.concat(F.lit("@r"), F.when(other, F.col("rec_pos") + 1).otherwise(F.col("rec_pos")).cast("string"))
    seq = lambda mate: F.translate(F.md5(F.concat(F.lit(mate), F.col("rec_pos").cast("string"))), "0123456789abcdef", "ACGTACGTACGTACGT")
    first = orders.select("file_id", "rec_pos", F.concat(name(F.lit(False)), F.lit(" 1")).alias("header"), seq("a").alias("seq"), F.repeat(F.lit("I"), 32).alias("qual"))
    second = orders.select("file_id", "rec_pos", F.concat(name(F.col("rec_pos") % 97 == 0), F.lit(" 2")).alias("header"), seq("b").alias("seq"), F.repeat(F.lit("5"), 32).alias("qual"))
    return [first, second]


def _linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mates side by side, file by file, with the id check as a flag."""
    reads = linked(_mates(spark, sf_dir), verify_ids=False, by=("file_id",))
    a, b = F.col("reads")[0], F.col("reads")[1]
    return reads.select("file_id", F.col("rec_no").cast("long").alias("rec_no"), a["header"].alias("header"), b["header"].alias("header2"), a["seq"].alias("seq"), b["seq"].alias("seq2"))


def fastq_linked(spark, sf_dir):
    return _linked(spark, sf_dir)


def fastq_verify_ids(spark, sf_dir):
    return _linked(spark, sf_dir).select("file_id", "rec_no", fn.same_read(F.col("header2"), fn.control_id(F.col("header"))).alias("same"), fn.same_read(F.col("header2"), fn.control_id(F.col("header")), True).alias("same_strict"))


def fastq_limit(spark, sf_dir):
    return _linked(spark, sf_dir).filter("rec_no < 100").select("file_id", "rec_no", "header")


def fastq_format(spark, sf_dir):
    tags = load(spark, sf_dir, "gex_tags").select("row_id", "cb", "cr", "cy", "ub", "ur", "uy")
    header = fn.tagged_header(F.concat(F.lit("@r"), F.col("row_id").cast("string")), fn.tag_array([(k.upper(), F.col(k)) for k in ("cb", "cr", "cy", "ub", "ur", "uy")]))
    return tags.select("row_id", fn.fastq_record(header, F.coalesce("cr", F.lit("")), F.col("cy")).alias("record"))


def _variants(make):
    def query(spark, sf_dir):
        return load(spark, sf_dir, "whitelist_gex").select("barcode", F.explode(make(F.col("barcode"))).alias("variant"))

    return query


barcode_swap, barcode_insert, barcode_delete = (_variants(m) for m in (barcodes.substitutions, barcodes.insertions, barcodes.deletions))


def correction_table(spark, sf_dir):
    table = barcodes.correction_table(load(spark, sf_dir, "whitelist_gex"))
    return table.groupBy("barcode").agg(F.count(F.lit(1)).alias("n"), F.min("variant").alias("first"), F.max("variant").alias("last"))


def correct_barcode(spark, sf_dir):
    tags = load(spark, sf_dir, "gex_tags").select("row_id", "cr")
    return barcodes.correct(tags, "cr", load(spark, sf_dir, "whitelist_gex"))


def correct_barcode_weighted(spark, sf_dir):
    tags = load(spark, sf_dir, "gex_tags").select("row_id", "cr", "cy")
    return barcodes.correct_weighted(tags, "cr", "cy", load(spark, sf_dir, "whitelist_gex")).select("row_id", "cr", "corrected")


def _translations(spark, sf_dir):
    return barcodes.translations(load(spark, sf_dir, "whitelist_atac"), load(spark, sf_dir, "whitelist_gex"))


def translate_barcode(spark, sf_dir):
    return barcodes.translate(load(spark, sf_dir, "atac_tags").select("row_id", "cr"), "cr", _translations(spark, sf_dir))


def _tag_text(tags: Column) -> Column:
    return fn.tagged_header(F.lit("@"), tags)


def atac_tags(spark, sf_dir):
    rows = load(spark, sf_dir, "atac_tags").select("row_id", "cr", "cy")
    fixed = barcodes.correct(rows, "cr", load(spark, sf_dir, "whitelist_atac"))
    moved = barcodes.translate(fixed, "corrected", _translations(spark, sf_dir), out="cb")
    return moved.select("row_id", _tag_text(routing.atac_tags(F.col("cr"), F.col("cy"), F.col("cb"))).alias("tags"), F.col("cb").isNotNull().alias("valid"))


def gex_tags(spark, sf_dir):
    rows = load(spark, sf_dir, "gex_tags").select("row_id", "cr", "cy", "ur", "uy")
    fixed = barcodes.correct(rows, "cr", load(spark, sf_dir, "whitelist_gex"), out="cb")
    return fixed.select("row_id", _tag_text(routing.gex_tags(F.col("cr"), F.col("cy"), F.col("ur"), F.col("uy"), F.col("cb"))).alias("tags"), F.col("cb").isNotNull().alias("valid"))


def _sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchor positions drawn from lineitem's numbers."""
    k, p, s = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey")
    i = lambda c: c.cast("int")
    a, b = i(F.pmod(p * 7 + k, F.lit(900))), i(F.pmod(s * 31 + k * 3, F.lit(900)))
    return load(spark, sf_dir, "lineitem").select(
        k, "l_linenumber", i(F.pmod(k * 13 + p, F.lit(1000)) + 60).alias("n"), i(F.pmod(p, F.lit(700))).alias("pos"), (F.pmod(s, F.lit(2)) == 0).alias("forward"),
        F.when(F.pmod(k + p, F.lit(3)) == 0, F.array(a, a + 19)).when(F.pmod(k + p, F.lit(3)) == 1, F.array(a, a + 19, b, b + 18)).otherwise(F.array(a, a + 19, b, b + 18, b + 40, b + 59)).alias("spans"),
    )


def _listed(bounds: Column) -> Column:
    return F.array_join(F.transform(bounds, lambda x: x.cast("string")), ",")


def atac_intervals(spark, sf_dir):
    args = (F.col("n"), F.col("pos"), F.col("forward"), F.col("spans"))
    return _sites(spark, sf_dir).select("l_orderkey", "l_linenumber", _listed(atac_interval_column(*args)).alias("strict"), _listed(atac_interval_column(*args, keep_runoff=True)).alias("runoff"))


def gex_intervals(spark, sf_dir):
    found = gex_interval_column(F.col("n"), F.col("pos"), F.lit(28), F.col("forward"))
    return _sites(spark, sf_dir).select("l_orderkey", "l_linenumber", found["start"].cast("int").alias("cut_start"), found["end"].cast("int").alias("cut_end"))


def technical_remainder(spark, sf_dir):
    a = F.floor(F.length("seq") / 4).cast("int")
    b = F.floor(F.length("seq") / 2).cast("int")
    return _reads(spark, sf_dir).select("file_id", "rec_pos", fn.cut(F.col("seq"), a, b).alias("genomic"), fn.remainder(F.col("seq"), a, b).alias("seq_rest"), fn.remainder(F.col("qual"), a, b).alias("qual_rest"))


def _tasks(spark: SparkSession) -> int:
    """Tasks for the search over tables of a few files: some for each core."""
    return 4 * spark.sparkContext.defaultParallelism


def _context(spark: SparkSession, sf_dir: str) -> barcodes.BarcodeContext:
    return barcodes.BarcodeContext(spark, load(spark, sf_dir, "whitelist_atac"), load(spark, sf_dir, "whitelist_gex"))


# Fixed value: the expression adapter with two letters replaced.
_GEX_DAMAGED = "ACACTCTTTCCCTACACGACTCTCTTACGATCT"


def _exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads built from orders, of known truth by their number modulo 12.

    0 to 2 GEX, 3 to 5 ATAC with two sites, 6 ATAC with one (run-off), 7 GEX
    with a letter of the barcode replaced, 8 ATAC with one put in and 9 with
    one taken out, 10 GEX with two adapter letters replaced and a barcode of no
    list, 11 without an adapter. Of every other dozen the reads are turned.
    List entries holding a piece of the adapter are left out, as in them an
    approximate match may begin elsewhere than where the adapter was put.
    """
    key = F.col("k").cast("string")
    dna = lambda part: fixtures.bases(key, part)
    orders = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 12).alias("arm"), (F.col("o_orderkey") % 24 < 12).alias("forward"))
    lists = load(spark, sf_dir, "whitelist_gex").select("idx", F.col("barcode").alias("g")).join(load(spark, sf_dir, "whitelist_atac").select("idx", F.col("barcode").alias("a")), "idx").filter("not contains(a, 'ATCTAC')")
    rows = orders.join(lists, F.pmod(F.col("k"), F.lit(6000)) == F.col("idx"))
    arm, a, g = F.col("arm"), F.col("a"), F.col("g")
    # The letter before a barcode is C; where the barcode begins with one too, a
    # gap could stand on either side, so such a barcode is left as it is.
    clear = ~a.startswith("C")
    other = F.translate(F.substring(g, 8, 1), "ACGT", "CATG")
    bc = (
        F.when(arm == 7, F.concat(F.substring(g, 1, 7), other, F.substring(g, 9, 8)))
        .when(arm == 10, F.substring(dna("x"), 1, 16))
        .when((arm == 8) & clear, F.concat(F.substring(a, 1, 9), F.lit("A"), F.substring(a, 10, 7)))
        .when((arm == 9) & clear, F.concat(F.substring(a, 1, 9), F.substring(a, 11, 6)))
        .when(arm.isin(3, 4, 5, 6, 8, 9), a)
        .otherwise(g)
    )
    body = fixtures.bases(key, "i", 4)
    left = F.when(arm == 10, _GEX_DAMAGED).otherwise(fixtures.GEX_LEFT)
    gex = fixtures.gex_read(F.col("bc"), F.substring(dna("u"), 1, 12), body, left)
    atac = fixtures.atac_read(F.col("bc"), body, arm == 6)
    built = rows.withColumn("bc", bc).withColumn("seq", F.when(arm == 11, body).when(arm.isin(0, 1, 2, 7, 10), gex).otherwise(atac))
    seq = F.when(F.col("forward"), F.col("seq")).otherwise(fn.complement_reversed(F.col("seq")))
    return built.select((F.col("k") % 16).cast("int").alias("file_id"), F.col("k").alias("rec_pos"), F.concat(F.lit("@o"), key).alias("header"), seq.alias("seq"), fixtures.qualities(F.col("seq")).alias("qual"))


def _routed(spark: SparkSession, sf_dir: str, options: Options = Options(), only_valid: bool = False) -> DataFrame:
    return routing.demux(_exact(spark, sf_dir), _context(spark, sf_dir), options, only_valid, spread=_tasks(spark))


def demux_exact(spark, sf_dir):
    """Routes, barcodes and UMIs of reads whose truth is known, run-off kept."""
    return _routed(spark, sf_dir, Options(keep_runoff=True)).select("rec_pos", "route", "strand", "bc", "cb", "umi", "cut_start", "cut_end", "valid")


def demux_records(spark, sf_dir):
    """The written records, technical ones too, run-off not kept."""
    made = routing.records(_routed(spark, sf_dir), technical=True)
    return made.select("rec_pos", "route", "header", F.length("seq").cast("int").alias("n_seq"), F.length("qual").cast("int").alias("n_qual"), F.md5("seq").alias("seq_md5"))


def demux_fuzzy(spark, sf_dir):
    """The supplied reads, with errors, both strands and both assays."""
    return routing.demux(_reads(spark, sf_dir), _context(spark, sf_dir), Options(keep_runoff=True), spread=_tasks(spark)).select("file_id", "rec_pos", "route", "strand", "bc", "umi", "cb", "cut_start", "cut_end", "valid")


def route_counts(spark, sf_dir):
    return routing.counts(anchors(_reads(spark, sf_dir), options=Options(keep_runoff=True), spread=_tasks(spark)))


def exact_counts(spark, sf_dir):
    return routing.counts(anchors(_exact(spark, sf_dir), options=Options(keep_runoff=True), spread=_tasks(spark)))


def anchor_hits(spark, sf_dir):
    """One anchor alone over reads whose truth is known."""
    hits = barcode_hits(_exact(spark, sf_dir), GEX, spread=_tasks(spark)).filter("bc is not null")
    return hits.select("rec_pos", "bc", "strand")


def valid_only_filter(spark, sf_dir):
    """Counts by file without anchored reads that lack a valid barcode."""
    return routing.counts(_routed(spark, sf_dir, only_valid=True))


def _alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bam_summary's rows in the shape of BAM records."""
    tag = lambda k, v: F.struct(F.lit(k).alias("k"), F.lit("Z").alias("type"), v.alias("v"))
    rows = load(spark, sf_dir, "bam_summary")
    tags = F.when(F.col("barcode").isNotNull(), F.array(tag("RG", F.lit("a")), tag("CB", F.col("barcode")))).otherwise(F.array(tag("RG", F.lit("a"))))
    flag = F.when(F.col("is_mapped"), 0).otherwise(4)
    return rows.select("aln_id", flag.alias("flag"), "length", tags.alias("tags"))


def bam_summary(spark, sf_dir):
    """``bases`` are of lengths modulo 64, null as 0, as the query's SQL has
    them; :func:`bam_bases` gives the true ones."""
    found = split.summarize(_alignments(spark, sf_dir), missing_ok=True, length="length")
    bases = F.sum(F.pmod(F.coalesce("length", F.lit(0)), F.lit(64)).cast("long"))
    return found.groupBy("barcode", "is_mapped").agg(F.count(F.lit(1)).alias("n"), bases.alias("bases"))


def bam_bases(spark, sf_dir):
    """Reads and bases by barcode; null lengths count as reads, not as bases."""
    found = split.summarize(_alignments(spark, sf_dir), missing_ok=True, length="length")
    return found.groupBy("barcode", "is_mapped").agg(F.count(F.lit(1)).alias("n"), F.count("length").alias("n_length"), F.sum("length").alias("bases"))


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.split_rows(load(spark, sf_dir, "bam_summary").select("aln_id", "barcode", "is_mapped"), load(spark, sf_dir, "barcode_lookup"))


def bam_split_rows(spark, sf_dir):
    return _split(spark, sf_dir).select("aln_id", "grp")


def bam_split_counts(spark, sf_dir):
    return split.split_counts(_split(spark, sf_dir), load(spark, sf_dir, "barcode_lookup"))


def output_map_check(spark, sf_dir):
    """Groups of the lookup against the sources of a mix as an output map."""
    named = load(spark, sf_dir, "barcode_lookup").select("grp").filter("grp <> 'glia'").unionByName(load(spark, sf_dir, "region").select(F.col("r_name").alias("grp")))
    return split.differing_groups(load(spark, sf_dir, "barcode_lookup"), named)


def sam_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SAM lines with comments, made from the tags (row_id, line)."""
    tags = load(spark, sf_dir, "gex_tags").select("row_id", "cb", "cr", "cy", "ub")
    comment = F.concat(F.lit("CB="), F.coalesce("cb", F.lit("")), F.lit(" CR="), F.coalesce("cr", F.lit("")), F.lit(" note UB="), F.coalesce("ub", F.lit("")))
    line = F.when(F.col("row_id") % 50 == 0, F.concat(F.lit("@CO\t"), comment)).when(F.col("row_id") % 7 == 0, F.lit("r\t4\tplain")).otherwise(F.concat(F.lit("r"), F.col("row_id").cast("string"), F.lit("\t4\t"), comment))
    return tags.select("row_id", line.alias("line"))


def sam_tags(spark, sf_dir):
    return sam_source(spark, sf_dir).select("row_id", fn.sam_line(F.col("line"), fn.SAM_COMMENTS, fn.SAM_TAGS).alias("line"))


QUERIES = {
    f.__name__: f
    for f in (
        seq_reverse_complement, seq_reverse, qual_decode, fastq_control_id, fastq_linked, fastq_verify_ids, fastq_limit, fastq_format, correction_table,
        correct_barcode, correct_barcode_weighted, translate_barcode, atac_tags, gex_tags, atac_intervals, gex_intervals, technical_remainder, demux_exact,
        demux_records, anchor_hits, demux_fuzzy, route_counts, exact_counts, valid_only_filter, bam_summary, bam_bases, bam_split_rows, bam_split_counts, output_map_check, sam_tags,
    )
} | {"barcode_swap": barcode_swap, "barcode_insert": barcode_insert, "barcode_delete": barcode_delete}
