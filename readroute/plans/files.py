"""Queries over files: written from the tables, read back, and their SQL.

Each writes to a folder of its own beside the checkpoints and deletes it when
its result is kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readroute import api
from readroute.functions import seq as fn
from readroute.operators import split
from readroute.operators.anchors import Options
from readroute.operators.barcodes import read_whitelist
from readroute.plans import reads, reads_sql
from readroute.session import Scratch, cut, load
from readroute.sources import dispatch
from readroute.sources.bam import RECORD, read_bam, write_bam_groups
from readroute.sources.fastq import read_fastq, write_fastq
from readroute.streaming.routes import write_routes


def _in_folder(query: Callable[[SparkSession, str, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with Scratch(spark) as scratch:
            return cut(query(spark, sf_dir, scratch.root))

    run.__name__, run.__doc__ = query.__name__, query.__doc__
    return run


@_in_folder
def fastq_round_trip(spark, sf_dir, folder):
    """A folder of gzipped parts, read back with scores."""
    mates = reads._mates(spark, sf_dir)[0]
    write_fastq(mates, f"{folder}/parts", compress=True)
    back = read_fastq(spark, f"{folder}/parts/part-*", phred="illumina")
    return back.select("header", "seq", F.aggregate("qual", F.lit(0), lambda a, x: a + x).cast("long").alias("total"))


@_in_folder
def fastq_one_file(spark, sf_dir, folder):
    """One plain file, read back in ranges, its first records and their order."""
    mates = reads._mates(spark, sf_dir)[1]
    dispatch.writer_for("reads.fastq")(mates, f"{folder}/reads.fastq", order=("rec_pos",))
    return dispatch.open_reads(spark, f"{folder}/reads.fastq").select(F.lit("all").alias("kind"), "header", "seq").unionByName(
        read_fastq(spark, f"{folder}/reads.fastq", n_records=100, splitbytes=1 << 16).select(F.lit("first").alias("kind"), "header", "seq")
    )


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bam_summary's rows as reads with tags."""
    rows = load(spark, sf_dir, "bam_summary").select("aln_id", "barcode", "length", "is_mapped")
    tags = F.array(F.struct(F.lit("RG").alias("k"), F.lit("Z").alias("type"), F.lit("a").alias("v")), F.struct(F.lit("CB").alias("k"), F.lit("Z").alias("type"), F.col("barcode").alias("v")))
    seq = F.translate(F.substring(F.md5(F.col("aln_id").cast("string")), 1, 20), "0123456789abcdef", "ACGTACGTACGTACGT")
    named = rows.select("*", F.concat(F.lit("@a"), "aln_id").alias("header"), seq.alias("seq"), F.repeat(F.lit("I"), 20).alias("qual"))
    flag = F.when(F.col("is_mapped"), 0).otherwise(4).alias("flag")
    shaped = [flag if n == "flag" else c for n, c in zip(RECORD, dispatch.unaligned(named)[:-1])]
    return named.select("aln_id", F.lit("all").alias("grp"), *shaped, tags.alias("tags"))


@_in_folder
def bam_round_trip(spark, sf_dir, folder):
    """One BAM file of all alignments, read back in ranges and summarised."""
    path = f"{folder}/all.bam"
    write_bam_groups(_tagged(spark, sf_dir), {"all": path}, order=("aln_id",))
    back = read_bam(spark, path, ["name", "flag", "seq", "tags"], splitbytes=1 << 17)
    return back.select("name", "flag", "seq", split.first_tag(F.col("tags"), "CB").alias("barcode"), F.size("tags").alias("n_tags"))


@_in_folder
def bam_split_files(spark, sf_dir, folder):
    """The alignments split to a file a group, and what each file holds."""
    path = f"{folder}/in.bam"
    write_bam_groups(_tagged(spark, sf_dir), {"all": path}, order=("aln_id",))
    lookup = load(spark, sf_dir, "barcode_lookup").select("barcode", "grp")
    counts = api.split_bam(spark, path, lookup, folder)
    found = None
    for g, n in sorted(counts.items()):
        held = read_bam(spark, f"{folder}/{g}_bam.bam", ["name"]).agg(F.count(F.lit(1)).alias("n_held"), F.min("name").alias("first_name"))
        one = held.select(F.lit(g).alias("grp"), F.lit(n).cast("long").alias("n"), "n_held", "first_name")
        found = one if found is None else found.unionByName(one)
    return found


@_in_folder
def bam_file_summary(spark, sf_dir, folder):
    path = f"{folder}/in.bam"
    write_bam_groups(_tagged(spark, sf_dir), {"all": path}, order=("aln_id",))
    return api.summarize_bam(spark, path, missing_ok=True).groupBy("barcode", "length", "is_mapped").agg(F.count(F.lit(1)).alias("n"))


@_in_folder
def whitelist_file(spark, sf_dir, folder):
    """A list written as a file of one column, numbered by its lines."""
    rows = load(spark, sf_dir, "whitelist_gex")
    rows.orderBy("idx").coalesce(1).select("barcode").write.text(f"{folder}/list")
    return read_whitelist(spark, f"{folder}/list").select("idx", "barcode")


@_in_folder
def sam_file_tags(spark, sf_dir, folder):
    """A SAM file's comments rewritten as tags, file to file."""
    lines = reads.sam_source(spark, sf_dir).withColumn("line", F.regexp_replace("line", r"[\r\n]", " "))
    lines.orderBy("row_id").select("line").write.text(f"{folder}/in")
    api.sam_comments_to_tags(spark, f"{folder}/in", f"{folder}/out")
    return spark.read.text(f"{folder}/out").select(F.col("value").alias("line"))


@_in_folder
def split_reads_files(spark, sf_dir, folder):
    """The public splitter over a file for each file_id: what it counts and
    what the files it writes hold."""
    made = reads._exact(spark, sf_dir).withColumn("to", F.col("file_id").cast("string"))
    inputs = {str(k): f"{folder}/in{k}.fastq" for k in range(16)}
    dispatch.write_reads(made, inputs, "to", ("rec_pos",))
    files = [inputs[str(k)] for k in range(16)]
    outs = {r: [f"{folder}/{r}{k}.{s}" for k in range(16)] for r, s in (("atac", "bam"), ("gex", "fastq.gz"), ("other", "fastq"), ("technical", "fastq"))}
    counts = api.split_reads(spark, files, outs["atac"], outs["gex"], outs["other"], outs["technical"], context=reads._context(spark, sf_dir), keep_runoff=True)
    told = spark.createDataFrame([(k, *n) for k, n in enumerate(counts)], "file_id int, atac long, gex long, other long")
    named = F.regexp_extract("path", r"/[a-z]+(\d+)\.[a-z.]+$", 1).cast("int").alias("file_id")
    held = read_bam(spark, outs["atac"], ["name", "path"]).select(named, F.lit("atac").alias("route"), F.length("name").alias("n"))
    for r in ("gex", "other", "technical"):
        held = held.unionByName(read_fastq(spark, outs[r]).select(named, F.lit(r).alias("route"), F.length("seq").alias("n")))
    kinds = held.groupBy("file_id").agg(*[F.count_if(F.col("route") == r).alias(f"held_{r}") for r in outs])
    return told.join(kinds, "file_id", "left")


@_in_folder
def stream_records(spark, sf_dir, folder):
    """The splitter over a stream of the same reads, in batches of a few files."""
    reads._exact(spark, sf_dir).select("header", "seq", "qual").repartition(4).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema("header string, seq string, qual string").option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")
    query = write_routes(stream, reads._context(spark, sf_dir), f"{folder}/out", f"{folder}/state", Options(keep_runoff=True), technical=True, spread=reads._tasks(spark))
    query.processAllAvailable()
    query.stop()
    return spark.read.parquet(f"{folder}/out").groupBy("route").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("seq")).alias("letters"))


QUERIES = {f.__name__: f for f in (fastq_round_trip, fastq_one_file, bam_round_trip, bam_split_files, bam_file_summary, whitelist_file, sam_file_tags, split_reads_files, stream_records)}

_NAME, _SEQ = "'a' || aln_id", reads_sql.DNA.replace("md5({})", "left(md5({}), 20)").format("aln_id::VARCHAR")
_ONE = reads_sql._MATES.split("linked AS")[0].rstrip().rstrip(",")

ORACLES = {
    "fastq_round_trip": _ONE + " SELECT header, seq, CAST(32 * 40 AS BIGINT) AS total FROM a",
    "fastq_one_file": _ONE + """ SELECT 'all' AS kind, header2 AS header, seq2 AS seq FROM b
UNION ALL SELECT * FROM (SELECT 'first', header2, seq2 FROM b ORDER BY rec_pos LIMIT 100)""",
    "bam_round_trip": f"SELECT {_NAME} AS name, CAST(CASE WHEN is_mapped THEN 0 ELSE 4 END AS INTEGER) AS flag, {_SEQ} AS seq, barcode, CAST(1 + (barcode IS NOT NULL)::INTEGER AS INTEGER) AS n_tags FROM bam_summary",
    "bam_split_files": f"""
SELECT g.grp, count(aln_id) AS n, count(aln_id) AS n_held, min({_NAME}) AS first_name FROM (SELECT DISTINCT grp FROM barcode_lookup) g
LEFT JOIN (SELECT aln_id, grp FROM bam_summary JOIN barcode_lookup USING (barcode) WHERE is_mapped) s ON s.grp = g.grp GROUP BY g.grp""",
    "bam_file_summary": "SELECT barcode, CAST(20 AS INTEGER) AS length, coalesce(is_mapped, false) AS is_mapped, count(*) AS n FROM bam_summary GROUP BY 1, 3",
    "whitelist_file": "SELECT row_number() OVER (ORDER BY idx) - 1 AS idx, barcode FROM whitelist_gex",
    "sam_file_tags": "SELECT line FROM (" + reads_sql.ORACLES["sam_tags"].replace("regexp_replace(raw,", "regexp_replace(regexp_replace(raw, '[\\r\\n]', ' ', 'g'),") + ")",
    "split_reads_files": reads_sql._TWO_LISTS + """
SELECT CAST(k % 16 AS INTEGER) AS file_id, count(*) FILTER (kind = 'atac') AS atac, count(*) FILTER (kind = 'gex') AS gex, count(*) FILTER (kind = 'other') AS other,
       count(*) FILTER (kind = 'atac') AS held_atac, count(*) FILTER (kind = 'gex') AS held_gex, count(*) FILTER (kind = 'other') AS held_other, count(*) FILTER (kind = 'atac') AS held_technical
FROM e GROUP BY k % 16""",
    "stream_records": reads_sql._TWO_LISTS + """
SELECT kind AS route, count(*) AS n, CAST(sum(CASE kind WHEN 'other' THEN n ELSE cut_end - cut_start END) AS BIGINT) AS letters FROM e GROUP BY kind
UNION ALL SELECT 'technical', count(*), CAST(sum(n - cut_end + cut_start + 4) AS BIGINT) FROM e WHERE kind = 'atac'""",
}
