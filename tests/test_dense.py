import math
import random

import pytest

from readroute.operators.dense import dense_totals


def expected(rows, width):
    out = {}
    for *key, v in rows:
        s = out.setdefault(tuple(key), [0, []])
        s[0] += 1
        if v is not None and v == v:
            s[1].append(v)
    return {k: (n, len(x), sum(x) if x else None, min(x) if x else None, max(x) if x else None) for k, (n, x) in out.items()}


@pytest.mark.parametrize("max_keys", [1 << 18, 3])
def test_totals_with_a_hot_key(spark, max_keys):
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", "hot", "a", "b", None, ""]), rng.choice([None, -5, 0, 7, 2**40])) for _ in range(3000)]
    df = spark.createDataFrame(rows, "k string, v bigint").repartition(7)
    got = {(r.k,): (r.n_rows, r.v_n, r.v_sum, r.v_min, r.v_max) for r in dense_totals(df, "k", ["v"], max_keys=max_keys, block=2).collect()}
    assert got == expected(rows, 1)


def test_doubles_and_two_keys(spark):
    rows = [("a", 1, 1.5), ("a", 1, float("nan")), ("a", None, None), ("b", 1, -2.0), ("a", 1, 2.0)]
    df = spark.createDataFrame(rows, "k string, d int, v double")
    got = {(r.k, r.d): (r.n_rows, r.v_n, r.v_sum, r.v_min, r.v_max) for r in dense_totals(df, ["k", "d"], ["v"]).collect()}
    assert got == expected(rows, 2)
    assert math.isclose(got["a", 1][2], 3.5)


def test_empty_names_and_booleans(spark):
    df = spark.createDataFrame([(1, True, 9), (1, None, 9), (2, False, 9)], "n_rows int, `a.b` boolean, k int")
    got = {r[0]: tuple(r)[1:] for r in dense_totals(df.withColumnRenamed("n_rows", "key"), "key", ["a.b"]).collect()}
    assert got == {1: (2, 1, 1, 1, 1), 2: (1, 1, 0, 0, 0)}
    assert dense_totals(df.limit(0), "k").count() == 0
    with pytest.raises(ValueError):
        dense_totals(df, [])
