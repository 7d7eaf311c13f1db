import math
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

pytest.importorskip("readroute.llm.queries")

from readroute.llm import canonical, components, distinct, frequent, mixing, percentiles


# --- percentiles


def test_percentiles_are_exact_and_mergeable(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 6 + ["a", "b", None]), rng.choice([None, float("nan"), -3.5, 0.0, 7.0, float(rng.randrange(1000))]), d) for d in range(3) for _ in range(700)]
    rows += [("one", 4.0, 0), ("none", None, 0)]
    df = spark.createDataFrame(rows, "k string, v double, day int")
    probs = [0, 0.1, 0.5, 0.999, 1]
    parts = [percentiles.partial(df.filter(F.col("day") == d), ["k"], "v") for d in range(3)]
    got = {r.k: tuple(r)[1:] for r in percentiles.percentiles(percentiles.merge(*parts), probs, partitions=5).collect()}
    want = {}
    for k in {r[0] for r in rows}:
        values = [v for n, v, _ in rows if n == k and v is not None and v == v]
        if values:
            want[k] = (len(values), *np.quantile(values, probs))
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k]), k


def test_percentiles_of_nothing_and_bad_arguments(spark):
    df = spark.createDataFrame([(1, 2, 3)], "g int, n int, value int")
    parts = percentiles.partial(df.limit(0), ["g"], "value")
    assert percentiles.percentiles(parts, [0.5]).count() == 0
    assert [tuple(r) for r in percentiles.percentiles(percentiles.partial(df, ["g", "n"], "value"), [0.5]).collect()] == [(1, 2, 1, 3.0)]
    with pytest.raises(ValueError):
        percentiles.percentiles(parts, [1.5])


# --- frequent items


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 12), max_size=400), st.sampled_from([0.5, 0.1, 0.03]), st.integers(1, 90))
def test_lossy_counter_keeps_its_promise(items, error, step):
    import pyarrow as pa

    counter = frequent.LossyCounter(error)
    for a in range(0, len(items), step):
        counter.add(pa.array(items[a : a + step]))
    for item, n in Counter(items).items():
        low, delta = counter.entries.get(item, (0, counter.hidden))
        assert low <= n <= low + delta


def test_frequent_items(spark):
    rng = random.Random(2)
    rows = [(g, rng.choice(["top"] * 30 + ["", "second", None] + [f"x{rng.randrange(10**6)}" for _ in range(70)])) for g in ("a", "b") for _ in range(6000)]
    df = spark.createDataFrame(rows, "g string, item string").repartition(5)
    got = frequent.frequent_items(df, "item", ["g"], 0.005).collect()
    exact = Counter(r for r in rows if r[1] is not None)
    totals = Counter(g for g, i in rows if i is not None)
    heavy = {r for r, n in exact.items() if n >= 0.005 * totals[r[0]]}
    assert heavy <= {(r.g, r.item) for r in got}
    for r in got:
        assert r.low <= exact[r.g, r.item] <= r.high and r.total == totals[r.g]
    kept = frequent.exactly(df, frequent.frequent_items(df, "item", ["g"], 0.005), "item", ["g"], 0.005)
    assert {(r.g, r.item) for r in kept.collect()} == heavy
    assert frequent.frequent_items(df.limit(0), "item", ["g"]).count() == 0
    with pytest.raises(ValueError):
        frequent.frequent_items(df, "item", support=0.1, error=0.2)


def test_groups_of_any_name_type_and_null(spark):
    rows = [(None, 1, "a")] * 50 + [("x", 2, "b")] * 30 + [("x", 2, f"r{i}") for i in range(20)]
    df = spark.createDataFrame(rows, "`a.b` string, n int, item string")
    few = frequent.frequent_items(df, "item", ["a.b", "n"], 0.2)
    assert dict(few.dtypes)["n"] == "int"
    assert {tuple(r)[:3] for r in few.collect()} == {(None, 1, "a"), ("x", 2, "b")}
    assert {tuple(r) for r in frequent.exactly(df, few, "item", ["a.b", "n"], 0.2).collect()} == {(None, 1, "a", 50, 50), ("x", 2, "b", 30, 50)}


# --- free values to a reference list


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("bound", [1 << 28, 0])
def test_canonical_against_brute_force(spark, bound):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    entries = [word(rng.choice([5, 6, 6, 7])) for _ in range(120)] + ["NAME", "NAMED"]
    values = [None, "", "-", "name!", "N-A.M E", "x" * 400, "NAMED2", entries[0], entries[0].lower(), "ſtraße"]
    for e in entries:
        for _ in range(2):
            w = list(e)
            for _ in range(rng.randrange(4)):
                i = rng.randrange(len(w)) if w else 0
                w[i : i + rng.randrange(2)] = rng.choice(["A", "C", "", "N", "GT"])
            values.append("".join(w))
    rows = [(i, v) for i, v in enumerate(values * 2)]
    df = spark.createDataFrame(rows, "id int, city string")
    ref = spark.createDataFrame([(e,) for e in entries + [None, entries[1]]], "name string")
    got = {r.id: r for r in canonical.to_canonical(df, "city", ref, "name", keep=("id",), max_broadcast_bytes=bound).collect()}
    assert got.keys() == {i for i, v in rows if v is not None and v not in entries}
    for i, r in got.items():
        letters = "".join(c for c in rows[i][1] if c.isascii() and c.isalpha()).upper()
        ranked = sorted((edits(letters, e), e) for e in set(entries))
        near = [e for d, e in ranked if d == ranked[0][0] and d <= 2]
        assert r.ties == len(near), (rows[i], near)
        assert r.entry == (near[0] if len(near) == 1 else None), rows[i]
        assert r.suggestion in (near or [None])
    with pytest.raises(ValueError):
        canonical.to_canonical(df.withColumnRenamed("id", "ties"), "city", ref, "name", keep=("ties",))


@pytest.mark.parametrize("bound", [1 << 28, 0])
def test_suggestions_follow_weight_then_frequency(spark, bound):
    df = spark.createDataFrame([("ACGTAA",)] * 2 + [("ACGTAC",)] * 5 + [("ACGTAG",), ("GGCATT",), ("GGCCAT",)], "v string")
    ref = spark.createDataFrame([("ACGTAA",), ("ACGTAC",), ("GGACTT",), ("GGCAAT",)], "v string")
    got = {r.v: (r.entry, r.ties, r.suggestion) for r in canonical.to_canonical(df, "v", ref, "v", max_broadcast_bytes=bound).collect()}
    assert got["ACGTAG"] == (None, 2, "ACGTAC")
    assert got["GGCATT"] == ("GGCAAT", 1, "GGCAAT") and got["GGCCAT"] == ("GGCAAT", 1, "GGCAAT")


@pytest.mark.parametrize("bound", [1 << 28, 0])
def test_entries_that_share_their_letters_all_tie(spark, bound):
    ref = spark.createDataFrame([("ACGTACGT",), ("acgtacgt",), ("ACGTACGG",), ("tt-tt",), ("TTTT",), ("GGGGG",)], "v string")
    df = spark.createDataFrame([("ACGTACGA",), ("TTTTA",), ("GGGGA",), ("",), (None,)], "v string")
    got = {r.v: (r.entry, r.distance, r.ties, r.suggestion) for r in canonical.to_canonical(df, "v", ref, "v", max_broadcast_bytes=bound).collect()}
    assert got == {"ACGTACGA": (None, 1, 3, "ACGTACGG"), "TTTTA": (None, 1, 2, "TTTT"), "GGGGA": ("GGGGG", 1, 1, "GGGGG"), "": (None, None, 0, None)}


def test_canonical_with_an_empty_list(spark):
    df = spark.createDataFrame([("a",), (None,)], "v string")
    got = canonical.to_canonical(df, "v", df.filter("v is null"), "v").collect()
    assert [(r.v, r.entry, r.ties) for r in got] == [("a", None, 0)]


def test_weighted_distance():
    assert canonical.weighted_damerau("ACGT", "CAGT") == 0.5
    assert canonical.weighted_damerau("ACGT", "ANGT") == 0.5
    assert canonical.weighted_damerau("", "AB") == 2


# --- components


def by_union(pairs):
    root = {}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            root.setdefault(a, a)
            root.setdefault(b, b)
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {x: find(x) for x in root}


def test_components(spark):
    rng = random.Random(5)
    chain = list(range(1000, 1080))
    rng.shuffle(chain)
    cases = [
        [(i, i + 1) for i in range(40)] + [(7, None), (None, 3), (9, 9), (3, 2)],
        [(5, k) for k in range(100, 400)] + list(zip(chain, chain[1:])) + [(1, 2), (2, 1)],
        [(rng.randrange(300), rng.randrange(300)) for _ in range(200)],
    ]
    for pairs in cases:
        floor = rng.choice([10, 1000])
        df = spark.createDataFrame([(a, b, 0) for a, b in pairs], "a bigint, b bigint, node int")
        got = {r.node: r.component for r in components.connected_components(df, "a", "b", hot_share=4, hot_floor=floor).collect()}
        assert got == by_union(pairs)


def test_components_without_links_and_of_names(spark):
    df = spark.createDataFrame([(1, 1), (None, 2)], "a bigint, b bigint")
    assert components.connected_components(df, "a", "b").count() == 0
    named = spark.createDataFrame([("x", "b"), ("b", "a")], "a string, b string")
    assert {r.node: r.component for r in components.connected_components(named, "a", "b").collect()} == {"x": "a", "b": "a", "a": "a"}


# --- distinct counts


def test_distinct_counts_are_within_their_bounds(spark):
    rows = [(g, f"u{i % n}") for g, n in (("small", 3), ("mid", 400), ("big", 6000)) for i in range(2 * n)]
    rows += [("big", None), (None, "u1")] + [("other", f"v{i}") for i in range(500)]
    df = spark.createDataFrame(rows, "g string, item string").repartition(6)
    sketches = distinct.sketch(df, ["g"], "item", m=1024)
    truth = {g: len({i for h, i in rows if h == g and i is not None}) for g in {r[0] for r in rows}}
    got = {r.g: r for r in distinct.estimate(sketches, m=1024, confidence=0.9999).collect()}
    assert got.keys() == truth.keys()
    for g, n in truth.items():
        assert got[g].low <= n <= got[g].high and abs(got[g].estimate / n - 1) < 0.15
    # A union's sketch is merged from the parts', and equals the direct one.
    both = distinct.merge(sketches.withColumn("g", F.lit("all")), ["g"], m=1024)
    direct = distinct.sketch(df.withColumn("g", F.lit("all")), ["g"], "item", m=1024)
    assert bytes(both.first().registers) == bytes(direct.first().registers)
    assert distinct.sketch(df.limit(0), ["g"], "item").count() == 0


def test_estimate_is_unbiased_and_its_interval_honest():
    m, n, errors, inside = 256, 500, [], 0
    lo, hi = distinct._gamma_quantile(m, 0.025), distinct._gamma_quantile(m, 0.975)
    for seed in range(120):
        s = distinct.registers_of(np.random.default_rng(seed).integers(0, 2**63, n).astype(np.uint64), m).sum()
        errors.append((m - 1) / s / n - 1)
        inside += lo / s <= n <= hi / s
    assert abs(np.mean(errors)) < 4 / math.sqrt(m) / math.sqrt(120)
    assert np.std(errors) == pytest.approx(1 / math.sqrt(m - 2), rel=0.3)
    assert inside >= 105


# --- mixing


def test_mixing_reaches_its_shares(spark):
    rng = random.Random(6)
    docs = [(f"d{i}", rng.choice(["big"] * 8 + ["mid"] * 3 + ["tiny"]), rng.randrange(0, 900)) for i in range(6000)]
    docs += [("dup", "mid", 10)] * 3 + [("n", None, 5), ("z", "tiny", None)]
    targets = [("m", "big", 0.5, 1), ("m", "mid", 0.3, 2), ("m", "tiny", 0.2, 3), ("n", "mid", 0.9, 1), ("n", "gone", 0.1, 5), ("o", "gone", 1.0, 1), ("p", "big", None, 1), ("p", "mid", 1.0, 0)]
    rows = mixing.sized(spark.createDataFrame(docs, "id string, src string, n int"), "id", "src", "n")
    plans = mixing.plan(rows, spark.createDataFrame(targets, "mix string, source string, target_share double, max_repeats int"))
    chosen = mixing.select(rows, plans)
    got = {(r.mix, r.source): r for r in mixing.shares(chosen, plans).collect()}
    assert set(got) == {(m, s) for m, s, *_ in targets}
    for m, s, share, cap in targets[:3]:
        assert got[m, s].actual_share == pytest.approx(share, abs=0.002)
        assert got[m, s].most_repeats <= cap
    # The scarcest source is used to its cap, so the mix is as large as can be.
    assert got["m", "tiny"].used_tokens == 3 * got["m", "tiny"].source_tokens
    assert got["n", "gone"].used_tokens == 0 and got["n", "mid"].actual_share == 1.0
    assert got["o", "gone"].actual_share == 0 and got["p", "big"].used_tokens == 0
    assert all(r.repeats >= 1 for r in chosen.collect())
