import random

import pytest
from pyspark.sql import functions as F

from readroute.operators import barcodes as B


def variants(b):
    swap = {b[:i] + c + b[i + 1 :] for i in range(len(b)) for c in B.LETTERS if c != b[i]}
    add = {b[:i] + c + b[i:] for i in range(len(b) + 1) for c in B.LETTERS}
    drop = {b[:i] + b[i + 1 :] for i in range(len(b))}
    return swap, add, drop


def table(entries):
    counts = {}
    for e in entries:
        for group in variants(e):
            for v in group:
                counts.setdefault(v, []).append(e)
    return {v: es[0] for v, es in counts.items() if len(es) == 1} | {e: e for e in entries}


LISTS = [[], ["ACGT"], ["AAAA", "CCAA"], ["ACGT", "ACTT"], ["AAAA", "AAAA"], ["AAA", "AAAA"], ["A"], ["ACGT", None, "N"], ["XYZ", "XYN"]]


@pytest.mark.parametrize("entries", LISTS)
def test_table_and_join_agree_with_the_rule(spark, entries):
    known = [e for e in entries if e is not None]
    expected = table(known)
    wl = spark.createDataFrame([(e,) for e in entries], "barcode string")
    assert {r.variant: r.barcode for r in B.correction_table(wl).collect()} == expected
    rng = random.Random(len(entries))
    asked = {None, "", "ACGT", "AAAT", "CAAA", "AC?T", "XY", "XYA", "xACGT"} | set(rng.sample(sorted(expected), min(60, len(expected))))
    asked |= {"".join(rng.choice("ACGTNX") for _ in range(rng.randrange(6))) for _ in range(60)}
    df = spark.createDataFrame([(a, 1) for a in asked for _ in range(2)], "bc string, `bc_key` int")
    got = B.correct(df, "bc", wl).collect()
    assert len(got) == 2 * len(asked)
    for r in got:
        assert r.corrected == expected.get(r.bc), r.bc


def test_variant_functions(spark):
    for b in ("A", "ACGT", "AANA", ""):
        row = spark.range(1).select(*[f(F.lit(b)).alias(str(i)) for i, f in enumerate((B.substitutions, B.insertions, B.deletions))]).first()
        for got, want in zip(row, variants(b)):
            assert sorted(got) == sorted(want)


def weighted(bc, qual, entries, max_dist, gap):
    if bc is None:
        return None
    if bc in entries:
        return bc
    if qual is None or len(qual) != len(bc):
        return None
    w = [max((ord(c) - 33 - 15) / 15, 0) + 1 for c in qual]
    scored = sorted((sum(x for x, a, b in zip(w, bc, e) if a != b), i, sum(a != b for a, b in zip(bc, e))) for i, e in enumerate(entries) if len(e) == len(bc))
    if not scored or scored[0][2] > max_dist:
        return None
    return entries[scored[0][1]] if len(scored) == 1 or scored[0][0] < scored[1][0] - gap else None


@pytest.mark.parametrize("seed", [2, 3])
def test_weighted_nearest(spark, seed):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    entries = [word(8) for _ in range(40)] + [word(6)] * 2
    rows = [(rng.choice([None, word(8), word(6), word(5), entries[0]]), rng.choice([None, "I" * 8, "#5I#5I#5", "555555", "~~~~~~~~", "~#~#~#"])) for _ in range(250)]
    rows += [(e[:3] + "A" + e[4:], "#5I#5I#5") for e in entries]
    df = spark.createDataFrame(rows, "bc string, q string")
    wl = spark.createDataFrame([(e,) for e in entries], "barcode string")
    for r in B.correct_weighted(df, "bc", "q", wl).collect():
        assert r.corrected == weighted(r.bc, r.q, entries, 2, 0.5), r


def test_long_tables_are_attached_without_a_hot_key(spark):
    keys = ["hot"] * 400 + [f"k{i}" for i in range(200)] + [None, "odd"]
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "`a.b` string, n int")
    rows = [(k, f"to {k}", keys.count(k)) for k in set(keys) if k and k != "odd"]
    table = spark.createDataFrame(rows, "`a.b` string, v string, n_rows long")
    for bound in (0, 1000):
        got = B.attach(df, table, ("a.b",), "v", max_broadcast=bound, hot_share=4).collect()
        assert sorted((r["a.b"] or "", r.n, r.v or "") for r in got) == sorted((k or "", i, f"to {k}" if k and k != "odd" else "") for i, k in enumerate(keys))


def test_translation(spark):
    atac = spark.createDataFrame([(0, "A"), (1, "B"), (2, "A"), (3, "C"), (9, "D")], "idx bigint, barcode string")
    gex = spark.createDataFrame([(0, "x"), (1, "y"), (2, "z"), (3, None)], "idx bigint, barcode string")
    df = spark.createDataFrame([("A",), ("B",), ("C",), ("D",), (None,), ("Q",)], "bc string")
    got = {r.bc: r.translated for r in B.translate(df, "bc", B.translations(atac, gex)).collect()}
    assert got == {"A": "z", "B": "y", "C": "C", "D": "D", None: None, "Q": "Q"}


def test_whitelist_file_and_context(spark, tmp_path):
    names = [f"{i:04d}" for i in range(250)]
    (tmp_path / "list.txt").write_text("\n".join(names) + "\n")
    got = B.read_whitelist(spark, str(tmp_path / "list.txt")).orderBy("idx").collect()
    assert [(r.idx, r.barcode) for r in got] == list(enumerate(names))
    assert B.BarcodeContext(spark, str(tmp_path / "list.txt"), str(tmp_path / "list.txt"), test=True).gex.count() == 100
