"""BAM files: BGZF blocks, records, and a Spark source and writer for them.

Written against the public SAM/BAM specification. A file is read in ranges of
its compressed bytes: a range begins with the first block in it, and with the
first record of that block, found by its fields and those of the records that
follow. Every record belongs to the range in which the block it starts in lies.
"""

from __future__ import annotations

import gzip
import io
import struct
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from readroute.sources.files import expand, located, open_in, size_of, write_files

TAG = "struct<k:string,type:string,v:string>"
SCHEMA = (
    "name string, flag int, ref_id int, pos int, mapq int, cigar string, next_ref int, next_pos int, tlen int,"
    f" seq string, qual array<int>, tags array<{TAG}>, path string, rec_no bigint"
)

#: The fields of a record before its tags.
RECORD = ("name", "flag", "ref_id", "pos", "mapq", "cigar", "next_ref", "next_pos", "tlen", "seq", "qual")

# Fixed values of the format.
_MAGIC = b"BAM\x01"
_BASES = "=ACMGRSVTWYHKDBN"
_CIGAR = "MIDNSHP=X"
_NUMBERS = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}
_EOF = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
_BLOCK = 0xFF00
#: A header for unaligned reads, which name no reference.
UNALIGNED = "@HD\tVN:1.6\tSO:unknown\n"


def _tags(raw: bytes) -> list[dict]:
    out, at = [], 0
    while at < len(raw):
        key, kind = raw[at : at + 2].decode(), chr(raw[at + 2])
        at += 3
        if kind in "ZH":
            end = raw.index(0, at)
            value, at = raw[at:end].decode("utf-8", "replace"), end + 1
        elif kind == "A":
            value, at = chr(raw[at]), at + 1
        elif kind == "B":
            code = _NUMBERS[chr(raw[at])]
            (n,) = struct.unpack_from("<i", raw, at + 1)
            value = ",".join([chr(raw[at]), *map(str, struct.unpack_from(f"<{n}{code}", raw, at + 5))])
            at += 5 + n * struct.calcsize(code)
        else:
            code = _NUMBERS[kind]
            (number,) = struct.unpack_from("<" + code, raw, at)
            value, at = str(number), at + struct.calcsize(code)
            kind = "f" if kind == "f" else "i"
        out.append({"k": key, "type": kind, "v": value})
    return out


def _tag_bytes(tag) -> bytes:
    key, kind, value = tag["k"].encode(), tag["type"], tag["v"]
    if kind in "ZH":
        return key + kind.encode() + value.encode() + b"\0"
    if kind == "A":
        return key + b"A" + value.encode()[:1]
    if kind == "f":
        return key + b"f" + struct.pack("<f", float(value))
    if kind == "B":
        code, *numbers = value.split(",")
        cast = float if code == "f" else int
        return key + b"B" + code.encode() + struct.pack(f"<i{len(numbers)}{_NUMBERS[code]}", len(numbers), *map(cast, numbers))
    return key + b"i" + struct.pack("<i", int(value))


def read_header(f) -> tuple[str, list[tuple[str, int]]]:
    """(text, references as (name, length)); leaves ``f`` at the records."""
    if f.read(4) != _MAGIC:
        raise ValueError("no BAM file")
    (n,) = struct.unpack("<i", f.read(4))
    text = f.read(n).rstrip(b"\0").decode()
    (n,) = struct.unpack("<i", f.read(4))
    refs = []
    for _ in range(n):
        (size,) = struct.unpack("<i", f.read(4))
        name = f.read(size)[:-1].decode()
        refs.append((name, struct.unpack("<i", f.read(4))[0]))
    return text, refs


def read_records(f) -> Iterator[dict]:
    while size := f.read(4):
        yield unpack(f.read(struct.unpack("<i", size)[0]))


def unpack(raw: bytes) -> dict:
    """A record of its bytes, without the leading size."""
    ref, pos, l_name, mapq, _, n_cigar, flag, l_seq, next_ref, next_pos, tlen = struct.unpack_from("<iiBBHHHiiii", raw)
    at = 32
    name = raw[at : at + l_name - 1].decode("utf-8", "replace")
    at += l_name
    cigar = "".join(f"{c >> 4}{_CIGAR[c & 15]}" for c in struct.unpack_from(f"<{n_cigar}I", raw, at)) or "*"
    at += 4 * n_cigar
    packed = raw[at : at + (l_seq + 1) // 2]
    seq = "".join(_BASES[b >> 4] + _BASES[b & 15] for b in packed)[:l_seq]
    at += (l_seq + 1) // 2
    qual = raw[at : at + l_seq]
    none = l_seq == 0 or qual[0] == 255
    return {
        "name": name, "flag": flag, "ref_id": ref, "pos": pos, "mapq": mapq, "cigar": cigar, "next_ref": next_ref, "next_pos": next_pos,
        "tlen": tlen, "seq": seq, "qual": None if none else list(qual), "tags": _tags(raw[at + l_seq :]),
    }


class Blocks:
    """The unpacked bytes of a file's blocks from an offset on, with the block
    each byte comes from."""

    def __init__(self, f, at: int):
        self.f, self.next = f, at
        self.data = bytearray()
        #: (place in ``data`` where the block's bytes begin, the block's offset)
        self.marks: list[tuple[int, int]] = []
        self.at = 0

    def _more(self) -> bool:
        block = read_block(self.f, self.next)
        if block is None:
            return False
        packed, size = block
        self.marks.append((len(self.data), self.next))
        self.next += size
        self.data += packed
        return True

    def have(self, n: int) -> bool:
        """Whether ``n`` bytes follow the present place."""
        while len(self.data) < self.at + n:
            if not self._more():
                return False
        return True

    def where(self) -> tuple[int, int]:
        """The present byte's block, and its place in it."""
        self.have(1)
        while len(self.marks) > 1 and self.marks[1][0] <= self.at:
            self.marks.pop(0)
        begin, block = self.marks[0] if self.marks else (self.at, self.next)
        return block, self.at - begin

    def take(self, n: int) -> bytes:
        out = bytes(self.data[self.at : self.at + n])
        self.at += n
        if self.at > 1 << 22:
            self.where()
            gone = self.marks[0][0] if self.marks else self.at
            del self.data[:gone]
            self.at -= gone
            self.marks = [(b - gone, o) for b, o in self.marks]
        return out

    def peek(self, ahead: int, n: int) -> bytes:
        return bytes(self.data[self.at + ahead : self.at + ahead + n]) if self.have(ahead + n) else b""


def read_block(f, at: int) -> tuple[bytes, int] | None:
    """(unpacked bytes, packed size) of the block at an offset, None at the end."""
    f.seek(at)
    head = f.read(12)
    if len(head) < 12:
        return None
    if head[:4] != b"\x1f\x8b\x08\x04":
        raise ValueError(f"no block at {at}")
    (extra,) = struct.unpack_from("<H", head, 10)
    fields, k, size = f.read(extra), 0, None
    while k + 4 <= len(fields):
        (n,) = struct.unpack_from("<H", fields, k + 2)
        if fields[k : k + 2] == b"BC" and n == 2:
            size = struct.unpack_from("<H", fields, k + 4)[0] + 1
        k += 4 + n
    if size is None:
        raise ValueError(f"the block at {at} does not say its size")
    body = f.read(size - 12 - extra)
    data = zlib.decompress(body[:-8], -15)
    if zlib.crc32(data) != struct.unpack_from("<I", body, len(body) - 8)[0]:
        raise ValueError(f"the block at {at} is damaged")
    return data, size


def first_block(f, start: int, end: int) -> int | None:
    """The offset of the first block that begins in [start, end)."""
    f.seek(start)
    data = f.read(end - start + 18)
    at = -1
    while (at := data.find(b"\x1f\x8b\x08\x04", at + 1)) >= 0 and at < end - start:
        try:
            if read_block(f, start + at) is not None:
                return start + at
        except (ValueError, zlib.error, struct.error, IndexError):
            continue
    return None


def _like_a_record(b: Blocks, ahead: int, n_refs: int) -> int | None:
    """The size of the record that may begin ``ahead`` bytes on, None if none does."""
    raw = b.peek(ahead, 36)
    if len(raw) < 36:
        return None
    size, ref, pos, l_name, _, _, n_cigar, _, l_seq, next_ref, next_pos, _ = struct.unpack("<iiiBBHHHiiii", raw)
    least = 32 + l_name + 4 * n_cigar + (l_seq + 1) // 2 + l_seq
    if not (-1 <= ref < n_refs and -1 <= next_ref < n_refs and pos >= -1 and next_pos >= -1 and l_name > 0 and 0 <= l_seq and least <= size <= 1 << 28):
        return None
    name = b.peek(ahead + 36, l_name)
    return 4 + size if name[-1:] == b"\0" and all(33 <= c <= 126 for c in name[:-1]) else None


def find_record(b: Blocks, n_refs: int, chain: int = 8) -> bool:
    """Moves to the first record: one that others follow, or the file's end."""
    ahead = 0
    while b.have(ahead + 36):
        at, many = ahead, 0
        while many < chain and (size := _like_a_record(b, at, n_refs)) is not None:
            at, many = at + size, many + 1
        # Fewer only where the last of them ends the file.
        if many == chain or (many and not b.have(at + 1) and b.have(at)):
            b.at += ahead
            return True
        ahead += 1
    return False


def _span_of(cigar: str) -> tuple[list[int], int]:
    ops, number, span = [], "", 0
    for c in "" if cigar in ("*", None) else cigar:
        if c.isdigit():
            number += c
        else:
            ops.append(int(number) << 4 | _CIGAR.index(c))
            span += int(number) * (c in "MDN=X")
            number = ""
    return ops, span


def _bin(start: int, end: int) -> int:
    """The indexing bin of [start, end), by the specification's scheme."""
    end -= 1
    for shift, base in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        if start >> shift == end >> shift:
            return base + (start >> shift)
    return 0


def record_bytes(r) -> bytes:
    seq = r["seq"] or ""
    ops, span = _span_of(r["cigar"])
    name = (r["name"] or "*").encode() + b"\0"
    codes = [_BASES.index(c) if c in _BASES else 15 for c in seq.upper()] + [0] * (len(seq) % 2)
    qual = bytes(r["qual"]) if r["qual"] else b"\xff" * len(seq)
    qual = qual[: len(seq)].ljust(len(seq), b"\xff")
    pos = -1 if r["pos"] is None else r["pos"]
    bin_ = _bin(pos, pos + max(span, 1)) if pos >= 0 else 4680
    opt = lambda k, d: d if r[k] is None else r[k]
    body = struct.pack("<iiBBHHHiiii", opt("ref_id", -1), pos, len(name), opt("mapq", 0), bin_, len(ops), opt("flag", 0), len(seq), opt("next_ref", -1), opt("next_pos", -1), opt("tlen", 0))
    body += name + struct.pack(f"<{len(ops)}I", *ops) + bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2])) + qual
    body += b"".join(_tag_bytes(t) for t in r["tags"] or [] if t["v"] is not None)
    return struct.pack("<i", len(body)) + body


def header_bytes(text: str, refs: Iterable[tuple[str, int]] = ()) -> bytes:
    refs, raw = list(refs), text.encode()
    out = _MAGIC + struct.pack("<i", len(raw)) + raw + struct.pack("<i", len(refs))
    for name, length in refs:
        out += struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", length)
    return out


class BgzfWriter:
    """Writes bytes as BGZF: gzip members that carry their own size."""

    def __init__(self, f):
        self.f, self.held = f, bytearray()

    def write(self, data: bytes) -> None:
        self.held += data
        while len(self.held) >= _BLOCK:
            self._block(bytes(self.held[:_BLOCK]))
            del self.held[:_BLOCK]

    def _block(self, data: bytes) -> None:
        packer = zlib.compressobj(6, zlib.DEFLATED, -15)
        packed = packer.compress(data) + packer.flush()
        self.f.write(b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(packed) + 25) + packed + struct.pack("<II", zlib.crc32(data), len(data)))

    def flush(self) -> None:
        if self.held:
            self._block(bytes(self.held))
            self.held.clear()

    def close(self) -> None:
        self.flush()
        self.f.write(_EOF)
        self.f.close()


def bgzf(data: bytes) -> bytes:
    """Bytes as blocks, without the mark of a file's end."""
    out = io.BytesIO()
    writer = BgzfWriter(out)
    writer.write(data)
    writer.flush()
    return out.getvalue()


def write_bam_file(path: str, rows: Iterable, text: str = UNALIGNED, refs: Iterable[tuple[str, int]] = ()) -> int:
    fs, inside = located(path)
    out, n = BgzfWriter(fs.open_output_stream(inside)), 0
    out.write(header_bytes(text, refs))
    # Records begin with a block of their own, so the header can be replaced.
    out.flush()
    for r in rows:
        out.write(record_bytes(r))
        n += 1
    out.close()
    return n


class _Range(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class BamReader(DataSourceReader):
    def __init__(self, options, schema):
        self.paths = sorted(expand(options["path"], (".bam",)))
        self.split = int(options.get("splitbytes", 64 << 20))
        self.names = [f.name for f in schema.fields]

    def partitions(self):
        return [_Range(p, a, min(a + self.split, size)) for p in self.paths for size in [size_of(p)] for a in range(0, max(size, 1), self.split)]

    def records(self, part) -> Iterator[dict]:
        """Records of the blocks that begin in the range."""
        with open_in(part.path) as f:
            f.seek(0)
            with gzip.open(f, "rb") as whole:
                _, refs = read_header(whole)
                begun = whole.tell()
            if part.start == 0:
                b = Blocks(f, 0)
                b.have(begun)
                b.at = begun
            else:
                first = first_block(f, part.start, part.end)
                if first is None:
                    return
                b = Blocks(f, first)
                # The header may reach into the range; records come behind it.
                skip = _header_left(f, begun, first)
                if skip:
                    if not b.have(skip):
                        return
                    b.at = skip
                elif not find_record(b, len(refs)):
                    return
            while b.have(4):
                block, inside = b.where()
                if block >= part.end:
                    return
                (size,) = struct.unpack("<i", b.peek(0, 4))
                if not b.have(4 + size):
                    raise ValueError(f"{part.path} ends within a record")
                b.take(4)
                yield unpack(b.take(size)) | {"path": part.path, "rec_no": block << 16 | inside}

    def read(self, part):
        tag = pa.struct([("k", pa.string()), ("type", pa.string()), ("v", pa.string())])
        kinds = {"name": pa.string(), "cigar": pa.string(), "seq": pa.string(), "path": pa.string(), "rec_no": pa.int64(), "qual": pa.list_(pa.int32()), "tags": pa.list_(tag)}
        kept = pa.schema([(n, kinds.get(n, pa.int32())) for n in self.names])
        rows: list[dict] = []
        for r in self.records(part):
            rows.append(r)
            if len(rows) == 2048:
                yield pa.RecordBatch.from_pylist(rows, schema=kept)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=kept)


def _header_left(f, header: int, at: int) -> int:
    """How many of the header's bytes lie in the blocks from offset ``at`` on."""
    b = Blocks(f, 0)
    while b.next < at and len(b.data) < header and b._more():
        pass
    return max(0, header - len(b.data))


class BamSource(DataSource):
    @classmethod
    def name(cls):
        return "bam"

    def schema(self):
        columns = self.options.get("columns")
        if not columns:
            return SCHEMA
        kinds = {x.strip().split(" ")[0]: x.strip() for x in SCHEMA.replace("struct<k:string,type:string,v:string>", "STRUCT").split(",")}
        return ", ".join(kinds[c.strip()] for c in columns.split(",")).replace("STRUCT", TAG)

    def reader(self, schema):
        return BamReader(self.options, schema)


def read_bam(spark: SparkSession, path: str | list[str], columns: list[str] | None = None, **options) -> DataFrame:
    """Records of BAM files; ``columns`` limits what is sent to the JVM.
    ``rec_no`` is the record's virtual offset, which rises in file order."""
    spark.dataSource.register(BamSource)
    reader = spark.read.format("bam").options(**{k: str(v) for k, v in options.items()})
    if columns:
        reader = reader.option("columns", ",".join(columns))
    return reader.load(path if isinstance(path, str) else ",".join(path))


def bam_header(path: str) -> tuple[str, list[tuple[str, int]]]:
    with open_in(path) as raw, gzip.open(raw, "rb") as f:
        return read_header(f)


def write_bam_groups(df: DataFrame, paths: dict[str, str], text: str = UNALIGNED, refs: Iterable[tuple[str, int]] = (), group: str = "grp", order: tuple[str, ...] = ("path", "rec_no")) -> None:
    """Writes each group's records to its file, in order; every group of
    ``paths`` gets a file, with only the header where it has no record."""
    write_files(df, paths, group, order, record_bytes, bgzf, bgzf(header_bytes(text, refs)), _EOF)
