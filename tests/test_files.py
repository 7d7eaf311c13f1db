import gzip
import random

import pytest
from pyspark.sql import functions as F

from readroute import api
from readroute.functions import seq as fn
from readroute.operators import split
from readroute.operators.barcodes import BarcodeContext
from readroute.sources import bam, dispatch, fastq

BC = ["ACGTACGTACGTACGT", "TTGCATGCAAGCTAGC"]


def record(i, seq, qual=None):
    return f"@r{i} x\n{seq}\n+\n{'I' * len(seq) if qual is None else qual}\n"


def test_fastq_ranges_give_every_record_once(spark, tmp_path):
    rng = random.Random(1)
    qual = lambda n: "".join(rng.choice("@+!~I") for _ in range(n))
    text = "".join(record(i, "ACGT" * (1 + i % 9), qual(4 * (1 + i % 9))) for i in range(300))
    (tmp_path / "a.fastq").write_text(text)
    with gzip.open(tmp_path / "b.fastq.gz", "wt") as f:
        f.write(text)
    want = [x.split("\n") for x in text[:-1].split("\n@r")]
    for name, split_bytes in (("a.fastq", 257), ("a.fastq", 1 << 20), ("b.fastq.gz", 257)):
        df = fastq.read_fastq(spark, str(tmp_path / name), splitbytes=split_bytes)
        rows = df.orderBy("rec_pos").collect()
        assert [r.header for r in rows] == [f"@r{i} x" for i in range(300)]
        assert [r.qual for r in rows] == [w[3] for w in want]
    assert fastq.read_fastq(spark, str(tmp_path)).count() == 600


def test_fastq_ranges_of_unequal_lengths(spark, tmp_path):
    rng = random.Random(2)
    text = "".join(record(i, "ACGT" * rng.randrange(9), "".join(rng.choice("@+!~I") for _ in range(40))) + "\n" * (i % 7 == 0) for i in range(300))
    (tmp_path / "a.fastq").write_text(text + "@last\nACGT\n+\n")
    whole = [r.header for r in fastq.read_fastq(spark, str(tmp_path / "a.fastq")).orderBy("rec_pos").collect()]
    assert whole == [f"@r{i} x" for i in range(300)]
    for split_bytes in (31, 257, 5000):
        rows = list(fastq.FastqReader({"path": str(tmp_path / "a.fastq"), "splitbytes": split_bytes}).partitions())
        with open(tmp_path / "a.fastq", "rb") as f:
            assert [r[1] for part in rows for r in fastq.records(f, part.start, part.end)] == whole
    assert fastq.read_fastq(spark, str(tmp_path / "a.fastq"), splitbytes=2000).count() == 300


def test_fastq_options_and_broken_files(spark, tmp_path):
    (tmp_path / "a.fastq").write_text(record(1, "AC") + "\n" + record(2, "GT", "@!") + "@r3\nACGT\n+\n")
    (tmp_path / "empty.fastq").write_text("")
    df = fastq.read_fastq(spark, str(tmp_path / "a.fastq"), phred="illumina")
    assert [list(r.qual) for r in df.orderBy("rec_pos").collect()] == [[40, 40], [31, 0]]
    assert fastq.read_fastq(spark, str(tmp_path / "empty.fastq")).count() == 0
    assert fastq.read_fastq(spark, str(tmp_path / "a.fastq"), n_records=1).count() == 1
    assert fastq.read_fastq(spark, str(tmp_path / "a.fastq"), n_records=0).count() == 0
    with pytest.raises(ValueError):
        fastq.read_fastq(spark, "x", phred="solexa")
    with pytest.raises(ValueError):
        dispatch.format_of("x.txt")
    assert dispatch.format_of("x.fastq.gz") == "fastq" and dispatch.format_of("x", "bam") == "bam"


def test_linked_files(spark, tmp_path):
    for name, ids in (("a", [1, 2, 3]), ("b", [1, 2]), ("c", [1, 5])):
        (tmp_path / f"{name}.fastq").write_text("".join(record(i, "ACGT") for i in ids))
    read = lambda n: fastq.read_fastq(spark, str(tmp_path / f"{n}.fastq"))
    got = fastq.linked([read("a"), read("b")]).orderBy("rec_no").collect()
    assert [[x.header for x in r.reads] for r in got] == [["@r1 x"] * 2, ["@r2 x"] * 2]
    assert fastq.linked([read("a"), read("c")], verify_ids=False).count() == 2
    assert fastq.linked([read("a"), read("b")], n_records=1).count() == 1
    with pytest.raises(Exception, match="ID mismatch"):
        fastq.linked([read("a"), read("c")]).collect()


def test_column_functions(spark):
    row = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert row(fn.complement_reversed(F.lit("ATGCNCGTA"))) == "TACGNGCAT"
    assert row(fn.scores(F.lit("!I~"))) == [0, 40, 93] and row(fn.scores(F.lit(""))) == []
    assert row(fn.control_id(F.lit("@read1 description"))) == "@read1" and row(fn.control_id(F.lit(""))) is None
    assert row(fn.same_read(F.lit("@r10"), F.lit("@r1"))) and not row(fn.same_read(F.lit("@r10"), F.lit("@r1"), True))
    assert row(fn.remainder(F.lit("abcdef"), F.lit(2), F.lit(4))) == "ab----ef"
    assert row(fn.tagged_header(F.lit("@r"), fn.tag_array([("CB", F.lit("x")), ("CR", F.lit(None).cast("string")), ("CY", F.lit(""))]))) == "@r CB=x CY="


def test_made_up_reads(spark):
    from readroute.functions import fixtures as fx

    row = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert row(fx.bases(F.lit("k"))) == row(fx.bases(F.lit("k"))) != row(fx.bases(F.lit("l"))) and len(row(fx.bases(F.lit("k"), "b", 3))) == 96
    assert row(fx.qualities(F.lit("ACGTAC"), "I", [(1, 3, "A"), (5, 9, "B"), (8, 9, "C")])) == "IAAIIB"
    assert row(fx.gex_read(F.lit("B"), F.lit("U"), F.lit("x"))) == fx.GEX_LEFT + "BU" + fx.GEX_TAIL + "x"
    assert row(fx.atac_read(F.lit("B"), F.lit("x"))).endswith(fx.SITE + "x" + fx.SITE_BACK)
    assert row(fx.atac_read(F.lit("B"), F.lit("x"), True)).endswith(fx.SITE + "x")


def test_sam_lines(spark, tmp_path):
    lines = ["@HD\tVN:1", "r\t4\tCB=AC UB=GT", "r\t4\tnothing", "r\t4\tUB= CB=", "r\t4\tXCB=1 CB=2", "  r\t4\tCB=9 tail  ", ""]
    want = ["@HD\tVN:1", "r\t4\tCB:Z:AC\tUB:Z:GT\tCB=AC UB=GT", "r\t4\tnothing", "r\t4\tCB:Z:\tUB:Z:\tUB= CB=", "r\t4\tCB:Z:1\tXCB=1 CB=2", "r\t4\tCB:Z:9\tCB=9 tail", ""]
    (tmp_path / "in.sam").write_text("\n".join(lines) + "\n")
    api.sam_comments_to_tags(spark, str(tmp_path / "in.sam"), str(tmp_path / "out.sam"))
    assert (tmp_path / "out.sam").read_text().split("\n")[:-1] == want
    api.sam_comments_to_tags(spark, str(tmp_path / "in.sam"), str(tmp_path / "own.sam"), "CB=", "XX:Z:", token_bound=True)
    assert (tmp_path / "own.sam").read_text().split("\n")[4] == "r\t4\tXX:Z:2\tXCB=1 CB=2"
    with pytest.raises(AssertionError):
        api.sam_comments_to_tags(spark, "missing", "missing", ["CB="], [])


def aligned(name, flag=0, **tags):
    return {"name": name, "flag": flag, "ref_id": 0 if not flag else -1, "pos": 10, "mapq": 60, "cigar": "3M1I", "next_ref": -1, "next_pos": -1, "tlen": 0, "seq": "ACGTN"[: 4 + len(name) % 2], "qual": None, "tags": [{"k": k, "type": "Z", "v": v} for k, v in tags.items()]}


def test_bam_round_trip_and_split(spark, tmp_path):
    rows = [aligned("a", CB="AAAA"), aligned("b", CB="BBBB"), aligned("c", CB="AAAA"), aligned("d", 4, CB="CCCC"), aligned("ee", CB="DDDD"), aligned("f", XX="1")]
    rows[0]["qual"] = [0, 40, 93, 2, 1]
    rows[1]["tags"] += [{"k": "NM", "type": "i", "v": "-7"}, {"k": "AC", "type": "A", "v": "q"}, {"k": "FL", "type": "f", "v": "1.5"}, {"k": "BB", "type": "B", "v": "s,1,-2"}]
    path = str(tmp_path / "in.bam")
    assert bam.write_bam_file(path, rows, "@HD\tVN:1.6\n@SQ\tSN:c\tLN:99\n", [("c", 99)]) == 6
    assert bam.bam_header(path) == ("@HD\tVN:1.6\n@SQ\tSN:c\tLN:99\n", [("c", 99)])
    back = bam.read_bam(spark, path).orderBy("rec_no").collect()
    for r, want in zip(back, rows):
        got = r.asDict(recursive=True)
        assert {k: got[k] for k in want} == want
    lookup = {"AAAA": "group1", "BBBB": "group2", "CCCC": "group3"}
    counts = api.split_bam(spark, path, lookup, str(tmp_path), out_prefix="p_")
    assert counts == {"group1": 2, "group2": 1, "group3": 0}
    names = lambda g: [r.name for r in bam.read_bam(spark, str(tmp_path / f"p_{g}_bam.bam")).orderBy("rec_no").collect()]
    assert (names("group1"), names("group2"), names("group3")) == (["a", "c"], ["b"], [])
    assert api.split_bam(spark, path, {"1": "g"}, output_files={"g": str(tmp_path / "g.bam")}, barcode_tag="XX") == {"g": 1}
    summary = api.summarize_bam(spark, path, missing_ok=True).collect()
    assert sorted((r.barcode or "", r.length, r.is_mapped) for r in summary)[0] == ("", 5, True)
    with pytest.raises(Exception, match="no tag CB"):
        api.summarize_bam(spark, path).collect()
    for wrong in ({"output_files": {"other": "x"}}, {}):
        with pytest.raises(ValueError):
            api.split_bam(spark, path, lookup, **wrong)
    assert split.output_paths(["a"], "/o/", prefix="x") == {"a": "/o/xa_bam.bam"}


def test_large_bam_spans_blocks(spark, tmp_path):
    """Ranges of any size give every record once and in order."""
    rng = random.Random(5)
    rows = [aligned(f"read{i}", CB=BC[i % 2], XX="".join(rng.choice("ACGT") for _ in range(rng.choice([5, 90, 4000])))) for i in range(3000)]
    rows[700]["seq"] = "".join(rng.choice("ACGT") for _ in range(200_000))
    path = str(tmp_path / "l.bam")
    bam.write_bam_file(path, rows, "@HD\tVN:1.6\n" + "".join(f"@SQ\tSN:chromosome{i}{rng.random()}\tLN:9\n" for i in range(6000)), [(f"chromosome{i}", 9) for i in range(6000)])
    df = bam.read_bam(spark, path, ["name", "tags"])
    assert df.columns == ["name", "tags"] and df.count() == 3000
    for size in (3_000, 20_000, 70_000, 1 << 30):
        df = bam.read_bam(spark, path, ["name", "rec_no"], splitbytes=size)
        if size > 20_000:
            assert [r.name for r in df.orderBy("rec_no").collect()] == [r["name"] for r in rows], size
        reader = bam.BamReader({"path": path, "splitbytes": size}, df.schema)
        found = [(r["name"], r["rec_no"]) for part in reader.partitions() for r in reader.records(part)]
        assert [n for n, _ in found] == [r["name"] for r in rows] and found == sorted(found, key=lambda x: x[1])
    with open(path, "rb") as f:
        cut = f.read()[:-200]
    (tmp_path / "cut.bam").write_bytes(cut)
    with pytest.raises(Exception):
        bam.read_bam(spark, str(tmp_path / "cut.bam")).collect()


def test_writers_take_the_same_arguments(spark, tmp_path):
    rows = [(i, f"@r{i}", "ACGT"[: 1 + i % 4], "IIII"[: 1 + i % 4]) for i in range(500)]
    df = spark.createDataFrame(rows, "n int, header string, seq string, qual string").repartition(7)
    for name in ("w.fastq", "w.fastq.gz", "w.bam"):
        path = str(tmp_path / name)
        dispatch.writer_for(path)(df, path, order=("n",))
        got = dispatch.open_reads(spark, path).orderBy("rec_no" if name.endswith("bam") else "rec_pos")
        assert [r.seq for r in got.collect()] == [r[2] for r in rows], name
    assert sorted(p.name for p in tmp_path.iterdir()) == ["w.bam", "w.fastq", "w.fastq.gz"]


def test_numbering_of_uneven_positions(spark):
    rng = random.Random(3)
    rows = [(f, p) for f in (0, 1, None) for p in rng.sample(range(10**9), 400)] + [(0, 5)] * 3
    got = fastq.numbered(spark.createDataFrame(rows, "file_id int, rec_pos bigint")).collect()
    for f in (0, 1, None):
        mine = sorted((r.rec_no, r.rec_pos) for r in got if r.file_id == f)
        assert [n for n, _ in mine] == list(range(len(mine))) and [p for _, p in mine] == sorted(p for g, p in rows if g == f)
    empty = spark.createDataFrame([], "file_id int, rec_pos bigint")
    assert fastq.numbered(empty).count() == 0


def test_split_reads_end_to_end(spark, tmp_path):
    rng = random.Random(4)
    body = lambda: "".join(rng.choice("ACGT") for _ in range(120))
    atac = "AATGATACGGCGACCACCGAGATCTACAC" + BC[0] + "CGCGTCTGTCGTCGGCAGCGTCAGATGTGTATAAGAGACAG" + body() + "CTGTCTCTTATACACATCT"
    gex = "ACACTCTTTCCCTACACGACGCTCTTCCGATCT" + BC[1] + "ATGCATGCATGC" + "T" * 22 + body()
    odd = gex.replace(BC[1], "G" * 16)
    (tmp_path / "in.fastq").write_text(record(0, atac) + record(1, gex) + record(2, body()) + record(3, odd))
    (tmp_path / "none.fastq").write_text("")
    wl = spark.createDataFrame([(0, BC[0]), (1, BC[1])], "idx bigint, barcode string")
    moved = spark.createDataFrame([(0, "C" * 16), (1, BC[1])], "idx bigint, barcode string")
    context = BarcodeContext(spark, wl, moved)
    out = [str(tmp_path / f"{n}.fastq") for n in ("atac", "gex", "other", "tech")]
    assert api.split_reads(spark, str(tmp_path / "in.fastq"), *out, context=context) == [1, 2, 1]
    lines = open(out[0]).read().split("\n")
    assert lines[0] == f"@r0 x CB={'C' * 16} CR={BC[0]} CY={'I' * 16}" and len(lines[1]) == 120
    assert "----" in open(out[3]).read().split("\n")[1]
    assert api.split_reads(spark, str(tmp_path / "in.fastq"), *out[:3], context=context, only_valid=True) == [1, 1, 1]
    files = [str(tmp_path / "in.fastq"), str(tmp_path / "none.fastq")]
    outs = [[str(tmp_path / f"{n}{i}.{s}") for i in range(2)] for n, s in (("a", "bam"), ("g", "fastq.gz"), ("o", "fastq"))]
    assert api.split_reads(spark, files, *outs, context=context) == [[1, 2, 1], [0, 0, 0]]
    assert bam.read_bam(spark, outs[0][0]).first().name == "r0"
    assert gzip.open(outs[1][0], "rt").read().startswith("@r1 x CB=")
    with pytest.raises(ValueError):
        api.split_reads(spark, "x.bam", *out[:3], context=context)


def test_stream(spark, tmp_path):
    from readroute.streaming.routes import write_routes

    (tmp_path / "in").mkdir()
    seq = "ACACTCTTTCCCTACACGACGCTCTTCCGATCT" + BC[1] + "ATGCATGCATGC" + "T" * 22 + "ACGT" * 30
    spark.createDataFrame([("@a", seq, "I" * len(seq)), ("@b", "ACGT", "IIII")], "header string, seq string, qual string").write.parquet(str(tmp_path / "in/1"))
    reads = spark.readStream.schema("header string, seq string, qual string").parquet(str(tmp_path / "in/*"))
    wl = spark.createDataFrame([(0, BC[0]), (1, BC[1])], "idx bigint, barcode string")
    query = write_routes(reads, BarcodeContext(spark, wl, wl), str(tmp_path / "out"), str(tmp_path / "state"))
    query.processAllAvailable()
    query.stop()
    assert {(r.header[:2], r.route) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("@a", "gex"), ("@b", "other")}


def test_stream_of_one_file_is_searched_by_many_tasks(spark, tmp_path, monkeypatch):
    from readroute.plans import files
    from readroute.plans import reads as plans
    from readroute.streaming.routes import write_routes

    spark.createDataFrame([(f"@{i}", "ACGT" * 9, "IIII" * 9) for i in range(60)], "header string, seq string, qual string").coalesce(1).write.parquet(str(tmp_path / "in/1"))
    wl = spark.createDataFrame([(0, BC[0]), (1, BC[1])], "idx bigint, barcode string")
    reads = spark.readStream.schema("header string, seq string, qual string").parquet(str(tmp_path / "in/*"))
    query = write_routes(reads, BarcodeContext(spark, wl, wl), str(tmp_path / "out"), str(tmp_path / "state"), spread=6)
    query.processAllAvailable()
    query.stop()
    made = spark.read.parquet(str(tmp_path / "out"))
    assert made.count() == 60 and len(made.inputFiles()) == 6
    # The query over two files a batch deals them out too.
    told = {}
    monkeypatch.setattr(files, "write_routes", lambda *a, **kw: told.update(kw) or write_routes(*a, **kw))
    files.stream_records(spark, "/root/testdata/sf0.001")
    assert told["spread"] == plans._tasks(spark) > 2
