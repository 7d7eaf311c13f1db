"""Reading and writing FASTQ files, plain or gzipped.

Plain files are read in byte ranges: each range starts at the first record that
begins in it, found by the shape of four lines. A gzipped file has one reader.
``rec_pos`` is the record's byte offset in the (unpacked) file, so it keeps the
order of the file without counting; ``rec_no`` is numbered only on request.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from readroute.functions import seq as fn
from readroute.session import fresh
from readroute.sources.files import expand, open_in, size_of

SCHEMA = "path string, file_id int, rec_pos bigint, header string, seq string, qual string"


class _Range(InputPartition):
    def __init__(self, path: str, file_id: int, start: int, end: int | None):
        self.path, self.file_id, self.start, self.end = path, file_id, start, end


def _strip(line: bytes) -> str:
    return line.decode("utf-8", "replace").strip()


def _sync(f, start: int) -> int:
    """The offset of the first record that begins at ``start`` or later."""
    if start == 0:
        return 0
    f.seek(start - 1)
    f.readline()
    at = f.tell()
    window = [(at, f.readline())]
    shape = lambda i: window[i][1].strip().startswith(b"@") and window[i + 2][1].strip().startswith(b"+")
    while window[0][1]:
        while len(window) < 7:
            window.append((f.tell(), f.readline()))
        # Lengths may differ, as in records(). A quality beginning with "@" has
        # the shape only before a sequence beginning with "+"; then the next line
        # has it too, and the record after this one decides.
        if shape(0) and (not shape(1) or shape(4)):
            return window[0][0]
        window.pop(0)
    return window[0][0]


def records(f, start: int = 0, end: int | None = None) -> Iterator[tuple[int, str, str, str]]:
    """(offset, header, seq, qual) of the records that begin in [start, end).

    Records have four lines, so a quality may begin with ``@`` or ``+``. Blank
    lines between records are skipped, an incomplete last record is dropped,
    and so are lines until the next header where the shape is broken.
    """
    at = _sync(f, start)
    f.seek(at)
    while end is None or at < end:
        line = f.readline()
        if not line:
            return
        if not line.strip().startswith(b"@"):
            at += len(line)
            continue
        seq, plus, qual = f.readline(), f.readline(), f.readline()
        if not qual:
            return
        if not plus.strip().startswith(b"+"):
            at += len(line)
            f.seek(at)
            continue
        yield at, _strip(line), _strip(seq), _strip(qual)
        at += len(line) + len(seq) + len(plus) + len(qual)


class FastqReader(DataSourceReader):
    def __init__(self, options):
        self.paths = sorted(expand(options["path"]))
        self.split = int(options.get("splitbytes", 64 << 20))
        self.batch = int(options.get("batchsize", 4096))
        #: Records at most of each range, as no file gives more than these.
        self.most = int(options["mostrecords"]) if "mostrecords" in options else None

    def partitions(self):
        out = []
        for k, path in enumerate(self.paths):
            if path.endswith(".gz"):
                out.append(_Range(path, k, 0, None))
            else:
                size = size_of(path)
                out += [_Range(path, k, a, min(a + self.split, size)) for a in range(0, max(size, 1), self.split)]
        return out or [_Range("", 0, 0, 0)]

    def read(self, part):
        if not part.path:
            return
        names = ["path", "file_id", "rec_pos", "header", "seq", "qual"]
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string()]
        with open_in(part.path) as raw, (gzip.open(raw, "rb") if part.path.endswith(".gz") else raw) as f:
            rows: list[tuple] = []
            for r in islice(records(f, part.start, part.end), self.most):
                rows.append((part.path, part.file_id, *r))
                if len(rows) == self.batch:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)


class FastqSource(DataSource):
    @classmethod
    def name(cls):
        return "fastq"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return FastqReader(self.options)


def read_fastq(spark: SparkSession, path: str | list[str], phred: str = "raw", n_records: int | None = None, **options) -> DataFrame:
    """Records of FASTQ files, one row each, keyed by (file_id, rec_pos).

    ``phred`` is ``raw`` (the string) or ``illumina`` (an array of scores).
    ``n_records`` keeps the first records of every file; 0 keeps none. Of no
    range of a file are more than these read.
    """
    quality = fn.phred(phred)
    spark.dataSource.register(FastqSource)
    paths = path if isinstance(path, str) else ",".join(path)
    reader = spark.read.format("fastq").options(**{k: str(v) for k, v in options.items()})
    if n_records is not None:
        reader = reader.option("mostrecords", str(n_records))
    df = reader.load(paths)
    if n_records is not None:
        df = numbered(df).filter(F.col("rec_no") < n_records).drop("rec_no")
    return df.withColumn("qual", quality(F.col("qual")))


#: Records about that :func:`numbered` sorts together.
_TOGETHER = 100_000


def numbered(df: DataFrame) -> DataFrame:
    """Adds ``rec_no``, the record's number in its file, from 0 in the order of
    ``rec_pos``; equal positions are numbered in any order.

    Files may be huge, so no task numbers a whole one: positions fall into
    stretches that hold some records each, a stretch is numbered by itself and
    shifted by the counts of those before. Counting reads the positions alone;
    the records are shuffled once, to their stretch.
    """
    by_file = df.groupBy("file_id").agg(F.count(F.lit(1)).alias("n"), F.max("rec_pos").alias("m"))
    size = by_file.agg(F.sum("n").alias("n"), F.sum(F.coalesce("m", F.lit(0)) + 1).alias("span")).first()
    shift = max(0, ((_TOGETHER * (size.span or 1)) // (size.n or 1)).bit_length() - 1)
    f, p, n, before = (fresh(x, df) for x in ("file", "stretch", "held", "before"))
    stretch = F.shiftright("rec_pos", shift)
    held = df.groupBy(F.col("file_id").alias(f), stretch.alias(p)).agg(F.count(F.lit(1)).alias(n))
    # Few rows: one for each stretch.
    starts = held.select(f, p, (F.sum(n).over(Window.partitionBy(f).orderBy(p)) - F.col(n)).alias(before))
    at = fresh("at", df)
    inside = F.row_number().over(Window.partitionBy("file_id", at).orderBy("rec_pos")) - 1
    placed = df.withColumn(at, stretch).withColumn("rec_no", inside)
    placed = placed.join(starts, F.col("file_id").eqNullSafe(F.col(f)) & F.col(at).eqNullSafe(F.col(p)))
    return placed.withColumn("rec_no", F.col("rec_no") + F.col(before)).drop(at, f, p, before)


def linked(files: list[DataFrame], verify_ids: bool = True, strict_ids: bool = False, n_records: int | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Records of linked files side by side: (rec_no, reads array of structs).

    The n-th records of all files form a row; the shortest file ends it. Frames
    of several files are linked file by file with ``by=("file_id",)``. With
    ``verify_ids`` a mate whose header does not begin with the previous file's
    id fails the query (``strict_ids``: does not have that very id).
    """
    out = None
    for k, f in enumerate(files):
        one = numbered(f).select(*by, "rec_no", F.struct("header", "seq", "qual").alias(f"r{k}"))
        out = one if out is None else out.join(one, [*by, "rec_no"])
    if n_records is not None:
        out = out.filter(F.col("rec_no") < n_records)
    if verify_ids:
        for k in range(1, len(files)):
            ok = fn.same_read(F.col(f"r{k}.header"), fn.control_id(F.col(f"r{k - 1}.header")), strict_ids)
            message = F.concat(F.lit("ID mismatch at record "), F.col("rec_no").cast("string"))
            out = out.withColumn(f"r{k}", F.when(F.coalesce(ok, F.lit(False)), F.col(f"r{k}")).otherwise(F.raise_error(message)))
    return out.select(*by, "rec_no", F.array(*[F.col(f"r{k}") for k in range(len(files))]).alias("reads"))


def write_fastq(df: DataFrame, path: str, compress: bool = False, partition_by: tuple[str, ...] = ()) -> None:
    """Writes ``header, seq, qual`` as a folder of FASTQ text, in the order of
    ``partition_by``'s folders and of ``rec_pos`` where there is one."""
    order = [*partition_by, *(["rec_pos"] if "rec_pos" in df.columns else [])]
    lines = (df.sortWithinPartitions(*order) if order else df).select(*partition_by, fn.fastq_record(F.col("header"), F.col("seq"), F.col("qual")).alias("value"))
    writer = lines.write.mode("overwrite").option("compression", "gzip" if compress else "none")
    (writer.partitionBy(*partition_by) if partition_by else writer).text(path)
