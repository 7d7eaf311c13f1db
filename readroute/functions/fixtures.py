"""Columns of made-up reads of known truth, for tests and examples.

Everything follows from a key, so the same rows come out in every run and engine.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The adapters around the barcodes of both assays, and the site.
GEX_LEFT, GEX_TAIL = "ACACTCTTTCCCTACACGACGCTCTTCCGATCT", "TTTTTTTTTTTT"
ATAC_LEFT, ATAC_RIGHT = "AATGATACGGCGACCACCGAGATCTACAC", "CGCGTCTGTCGTCGGCAGCGTC"
SITE, SITE_BACK = "AGATGTGTATAAGAGACAG", "CTGTCTCTTATACACATCT"


def bases(key: Column, part: str = "", pieces: int = 1) -> Column:
    """32 letters of ACGT for each of ``pieces``, drawn from the key's text."""
    one = lambda name: F.translate(F.md5(F.concat(F.lit(name), key)), "0123456789abcdef", "ACGTACGTACGTACGT")
    return one(part) if pieces == 1 else F.concat(*[one(f"{part}{i}") for i in range(pieces)])


def qualities(seq: Column, mark: str = "I", spans: Sequence[tuple[int, int, str]] = ()) -> Column:
    """A quality string as long as ``seq``: ``mark`` throughout, but for each
    (start, end, letter) that letter from start up to end."""
    out = F.repeat(F.lit(mark), F.length(seq))
    for a, b, letter in spans:
        stop = F.least(F.lit(b), F.length(seq))
        n = F.greatest(stop - a, F.lit(0))
        out = F.when(n > 0, F.concat(F.substring(out, F.lit(1), F.lit(a)), F.repeat(F.lit(letter), n), F.substring(out, stop + 1, F.length(seq)))).otherwise(out)
    return out


def gex_read(barcode: Column, umi: Column, body: Column, left: str | Column = GEX_LEFT) -> Column:
    """An expression read; its genomic part begins behind the UMI."""
    return F.concat(left if isinstance(left, Column) else F.lit(left), barcode, umi, F.lit(GEX_TAIL), body)


def atac_read(barcode: Column, body: Column, runs_off: Column | bool = False) -> Column:
    """A chromatin read; the second site is missing where it runs off."""
    end = F.when(runs_off if isinstance(runs_off, Column) else F.lit(runs_off), "").otherwise(SITE_BACK)
    return F.concat(F.lit(ATAC_LEFT), barcode, F.lit(ATAC_RIGHT + SITE), body, end)
