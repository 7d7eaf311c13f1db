"""Files by path or URI, and single files written by many tasks.

A path without a scheme is local; a URI names any filesystem Arrow knows. One
file of a format whose pieces concatenate (text, gzip members, BGZF blocks) is
written in parts beside its target by all tasks, then joined by copying bytes.
"""

from __future__ import annotations

import fnmatch
import io
import os
import uuid
from collections.abc import Callable, Iterable

import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def located(path: str) -> tuple[pafs.FileSystem, str]:
    """The filesystem of a path, and the path in it."""
    if "://" in path and not path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), os.path.abspath(_plain(path))


def _plain(path: str) -> str:
    """A local path without its scheme."""
    return path.removeprefix("file://").removeprefix("file:")


def open_in(path: str) -> io.BufferedReader:
    fs, inside = located(path)
    return io.BufferedReader(fs.open_input_file(inside), 1 << 20)


def size_of(path: str) -> int:
    fs, inside = located(path)
    return fs.get_file_info(inside).size


def expand(path: str, suffixes: tuple[str, ...] = (".fastq", ".fastq.gz")) -> list[str]:
    """The files of a path, folder, pattern or comma-separated list of them."""
    out: list[str] = []
    for one in path.split(","):
        fs, inside = located(one)
        head = one[: len(one) - len(inside)] if one.endswith(inside) and not isinstance(fs, pafs.LocalFileSystem) else ""
        pattern = any(c in inside for c in "*?[")
        if pattern:
            base = inside[: min(inside.find(c) for c in "*?[" if c in inside)].rpartition("/")[0] or "/"
            found = fs.get_file_info(pafs.FileSelector(base, allow_not_found=True, recursive=True))
            out += [head + f.path for f in found if f.is_file and fnmatch.fnmatchcase(f.path, inside) and f.path.count("/") == inside.count("/")]
        elif fs.get_file_info(inside).type == pafs.FileType.Directory:
            out += [head + f.path for f in fs.get_file_info(pafs.FileSelector(inside)) if f.is_file and f.path.endswith(suffixes)]
        else:
            out.append(_plain(one))
    return out


def write_files(df: DataFrame, paths: dict[str, str], group: str, order: Iterable[str], encode: Callable, pack: Callable[[bytes], bytes], begin: bytes = b"", end: bytes = b"", batch: int = 1 << 20) -> None:
    """Writes each group's rows to its file, in order; every group of ``paths``
    gets one, with only ``begin`` and ``end`` where it has no row.

    ``encode`` makes bytes of a row, ``pack`` a piece of the file of bytes. The
    rows are laid out by range, so a group of most rows is written by many
    tasks. A task run again replaces its own parts.
    """
    spark, names = df.sparkSession, sorted(paths)
    token = uuid.uuid4().hex[:12]
    ids = spark.createDataFrame([(g, i) for i, g in enumerate(names)], f"`{group}` string, __file int")
    rows = df.join(F.broadcast(ids), group)
    rows = rows.repartitionByRange("__file", *order).sortWithinPartitions("__file", *order)
    folder = lambda i: f"{paths[names[i]]}.parts-{token}"

    def write(part) -> None:
        context, out, now, held = TaskContext.get(), None, None, bytearray()
        number, attempt = context.partitionId(), context.taskAttemptId()

        def close():
            fs, base = located(folder(now))
            if held:
                out.write(pack(bytes(held)))
                held.clear()
            out.close()
            fs.move(f"{base}/.{number:08d}-{attempt}", f"{base}/{number:08d}")

        for r in part:
            if r["__file"] != now:
                if out:
                    close()
                now = r["__file"]
                fs, base = located(folder(now))
                fs.create_dir(base, recursive=True)
                out = fs.open_output_stream(f"{base}/.{number:08d}-{attempt}")
            held += encode(r)
            if len(held) >= batch:
                out.write(pack(bytes(held)))
                held.clear()
        if out:
            close()

    def join(part) -> None:
        for r in part:
            fs, base = located(folder(r["__file"]))
            _, target = located(paths[names[r["__file"]]])
            fs.create_dir(target.rpartition("/")[0] or "/", recursive=True)
            parts = sorted(f.path for f in fs.get_file_info(pafs.FileSelector(base, allow_not_found=True)) if not f.base_name.startswith("."))
            with fs.open_output_stream(target + ".joined-" + token) as whole:
                whole.write(begin)
                for p in parts:
                    with fs.open_input_stream(p) as piece:
                        while data := piece.read(8 << 20):
                            whole.write(data)
                whole.write(end)
            fs.move(target + ".joined-" + token, target)
            if parts:
                fs.delete_dir(base)

    rows.foreachPartition(write)
    ids.repartition(max(len(names), 1), "__file").foreachPartition(join)
