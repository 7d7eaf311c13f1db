"""Mapping free-entered values to the closest entries of a reference list.

Symmetric deletes: two strings within edit distance k have a common string
among those made from either by deleting at most k letters. The deletes of the
reference entries are hashed into two sorted arrays (hash, entry), about 12
bytes a delete, which are broadcast. Observed values are normalised, their
deletes hashed in bulk and looked up; only the entries hit are measured. A
reference list whose table would exceed the broadcast bound goes another way:
deletes of both sides are joined as a table.

Distances are plain Levenshtein; for suggestions among equally close entries a
weighted Damerau-Levenshtein distance and the entries' frequency decide.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readroute.session import col, map_arrow

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def letters_only(values: pa.Array) -> pa.Array:
    """The letters A to Z of each value, upper-cased; everything else goes."""
    return pc.utf8_upper(pc.replace_substring_regex(values, "[^A-Za-z]", ""))


def _matrix(words: list[str], n: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("ascii"), np.uint8).reshape(len(words), n)


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n - 1, 0), _BASE)]), dtype=np.uint64)


def delete_hashes(words: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all strings made by deleting at most ``k`` (0 to 2) letters.

    All words have one length n. Returns a (words x deletes) matrix of hashes;
    the hash of a string is a polynomial whose parts can be cut out of prefix
    sums, so no string is built.
    """
    n = len(words[0])
    codes = _matrix(words, n).astype(np.uint64) if n else np.zeros((len(words), 0), np.uint64)
    sums = np.zeros((len(words), n + 1), np.uint64)
    np.cumsum(codes * _powers(max(n, 1))[:n], axis=1, out=sums[:, 1:])
    out = [sums[:, n]]
    lengths = [n]
    if k >= 1:
        for i in range(n):
            out.append(sums[:, i] + (sums[:, n] - sums[:, i + 1]) * _BASE_INVERSE)
            lengths.append(n - 1)
    if k >= 2:
        twice = np.uint64(pow(int(_BASE_INVERSE), 2, 1 << 64))
        for i in range(n):
            head = sums[:, i]
            for j in range(i + 1, n):
                out.append(head + (sums[:, j] - sums[:, i + 1]) * _BASE_INVERSE + (sums[:, n] - sums[:, j + 1]) * twice)
                lengths.append(n - 2)
    hashed = np.stack(out, axis=1) + np.array(lengths, np.uint64)[None, :] * _MIX
    hashed ^= hashed >> np.uint64(29)
    return hashed * _MIX


def levenshtein(a: list[str], b: list[str]) -> np.ndarray:
    """Edit distances of the pairs (a[i], b[i]), all at once."""
    if not a:
        return np.zeros(0, np.int64)
    la, lb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    n, m = int(la.max()), int(lb.max())
    pad = lambda words, w, c: np.frombuffer("".join(x.ljust(w, c) for x in words).encode("ascii"), np.uint8).reshape(len(words), w)
    A, B = pad(a, n, "\x01") if n else None, pad(b, m, "\x02") if m else None
    row = np.tile(np.arange(m + 1), (len(a), 1))
    out = np.where(la == 0, lb, 0)
    pick = np.arange(len(a))
    for i in range(1, n + 1):
        new = np.empty_like(row)
        new[:, 0] = i
        for j in range(1, m + 1):
            new[:, j] = np.minimum(np.minimum(row[:, j], new[:, j - 1]) + 1, row[:, j - 1] + (A[:, i - 1] != B[:, j - 1]))
        row = new
        done = la == i
        out[done] = row[pick[done], lb[done]]
    return out


def weighted_damerau(a: str, b: str, swap: float = 0.5) -> float:
    """Edit distance in which swapping two neighbouring letters costs ``swap``
    and putting N for a letter, or a letter for N, half an edit."""
    prev2: list[float] = []
    prev = [float(j) for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        row = [float(i)]
        for j, y in enumerate(b, 1):
            cost = 0.0 if x == y else 0.5 if "N" in (x, y) else 1.0
            best = min(prev[j] + 1, row[j - 1] + 1, prev[j - 1] + cost)
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y and x != y:
                best = min(best, prev2[j - 2] + swap)
            row.append(best)
        prev2, prev = prev, row
    return prev[-1]


class DeleteTable:
    """The reference entries by the hashes of their deletes."""

    def __init__(self, entries: list[str], k: int):
        self.entries, self.k = entries, k
        hashes, owners = [], []
        lengths = np.array([len(e) for e in entries])
        self.shortest, self.longest = (int(lengths.min()), int(lengths.max())) if entries else (1, 0)
        for n in np.unique(lengths):
            own = np.flatnonzero(lengths == n)
            h = delete_hashes([entries[i] for i in own], k)
            hashes.append(h.ravel())
            owners.append(np.repeat(own.astype(np.int32), h.shape[1]))
        every = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(every, kind="stable")
        self.hashes = every[order]
        self.owners = (np.concatenate(owners) if owners else np.zeros(0, np.int32))[order]

    def candidates(self, words: list[str], step: int = 4096) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (word, entry) that share a delete; a superset of those within k."""
        lengths = np.array([len(w) for w in words])
        left, right = [], []
        for n in np.unique(lengths):
            if not self.shortest - self.k <= n <= self.longest + self.k:
                continue
            own = np.flatnonzero(lengths == n)
            for a in range(0, len(own), step):
                ids = own[a : a + step]
                h = delete_hashes([words[i] for i in ids], self.k)
                lo = np.searchsorted(self.hashes, h.ravel(), "left")
                count = np.searchsorted(self.hashes, h.ravel(), "right") - lo
                hit = np.flatnonzero(count)
                lo, count = lo[hit], count[hit]
                spread = np.repeat(lo - np.cumsum(count) + count, count) + np.arange(count.sum())
                pairs = np.repeat(ids[hit // h.shape[1]], count).astype(np.int64) * len(self.entries) + self.owners[spread]
                pairs = np.unique(pairs)
                left.append(pairs // len(self.entries))
                right.append(pairs % len(self.entries))
        none = np.zeros(0, np.int64)
        return (np.concatenate(left), np.concatenate(right)) if left else (none, none)

    def closest(self, words: list[str], owners: list[list[str]], often: dict[str, int]) -> list[tuple]:
        """For each word: (entry, distance, ties, suggestion).

        ``owners`` are the entries as they stand of each of the table's, which
        may share their letters; all of them tie. ``often`` says how often each
        occurs.
        """
        left, right = self.candidates(words)
        d = levenshtein([words[i] for i in left], [self.entries[j] for j in right])
        near = pd.DataFrame({"w": left, "e": right, "d": d})
        near = near[near.d <= self.k]
        best = near[near.d == near.groupby("w").d.transform("min")]
        out: list[tuple] = [(None, None, 0, None)] * len(words)
        for w, d, e in zip(best.w, best.d, best.e):
            have = out[w]
            held = owners[e] if have[3] is None else [*have[3], *owners[e]]
            out[w] = (None, int(d), len(held), held)
        for w, (_, d, ties, held) in enumerate(out):
            if ties == 1:
                out[w] = (held[0], d, 1, held[0])
            elif ties:
                rank = lambda r: (weighted_damerau(words[w], _letters(r)), -often.get(r, 0), r)
                out[w] = (None, d, ties, min(held, key=rank))
        return out


def _letters(value: str) -> str:
    return "".join(c for c in value if c.isascii() and c.isalpha()).upper()


def deletes_per_entry(n: int, k: int) -> int:
    return 1 + (n if k >= 1 else 0) + (n * (n - 1) // 2 if k >= 2 else 0)


#: One table a Python worker: tasks that follow in it find it made.
_TABLES: dict[tuple, tuple] = {}


def _table(key: tuple, shared) -> tuple[DeleteTable, list[list[str]], dict]:
    if key not in _TABLES:
        while len(_TABLES) > 1:
            _TABLES.pop(next(iter(_TABLES)))
        raw = shared.value
        by_letters: dict[str, list[str]] = {}
        for c, r in zip(letters_only(pa.array(raw, pa.string())).to_pylist(), raw):
            by_letters.setdefault(c, []).append(r)
        _TABLES[key] = (DeleteTable(list(by_letters), key[1]), list(by_letters.values()), {})
    return _TABLES[key]


RESULT = "entry string, distance int, ties int, suggestion string"


def to_canonical(df: DataFrame, value: str, reference: DataFrame, entry: str, k: int = 2, max_broadcast_bytes: int = 256 << 20, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every row of ``df`` whose value is not null and no entry as it stands.

    Returns ``keep..., value, entry, distance, ties, suggestion``: ``entry`` is
    the one closest entry within ``k`` (at most 2) edits, null where none is
    that near or several are as close. ``ties`` counts the closest entries (0:
    unmatched), ``suggestion`` names the likeliest of them by weighted distance
    and by how often the entry itself occurs in ``df``'s values.

    The comparison sees the letters A to Z only, upper-cased; a value without
    letters, and one longer than any entry by more than ``k``, is unmatched.
    Null and repeated entries of the reference count once; entries are compared
    by their letters too, and two with the same letters tie. With an empty
    reference everything is unmatched. Values are whole, however long.
    """
    if not 0 <= k <= 2:
        raise ValueError("k must be 0, 1 or 2")
    if {c.lower() for c in (value, *keep)} & {"entry", "distance", "ties", "suggestion", "__value", "__known"}:
        raise ValueError("the kept columns have a name of the result; rename them first")
    spark = df.sparkSession
    entries = reference.filter(col(entry).isNotNull()).select(col(entry).alias("entry")).distinct()
    shape = entries.agg(F.count("entry").alias("n"), F.coalesce(F.max(F.length("entry")), F.lit(0)).alias("longest")).first()
    rows = df.filter(col(value).isNotNull()).select(*[col(c) for c in keep], col(value).alias("__value"))
    if shape.n * deletes_per_entry(shape.longest, k) * 24 > max_broadcast_bytes:
        return _by_join(rows, entries, k, keep).withColumnRenamed("__value", value)
    known = F.broadcast(entries.select(F.col("entry").alias("__known")))
    odd = rows.join(known, F.col("__value") == F.col("__known"), "left_anti")
    shared = spark.sparkContext.broadcast(sorted(r.entry for r in entries.toLocalIterator()))
    # How often each entry itself occurs: at most one number an entry.
    often = rows.join(known, F.col("__value") == F.col("__known")).groupBy("__known").agg(F.count(F.lit(1)).alias("n"))
    counts = spark.sparkContext.broadcast({r[0]: r[1] for r in often.toLocalIterator()})
    where = odd.schema.names.index("__value")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in odd.schema)

    key = (str(uuid.uuid4()), k)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, owners, seen = _table(key, shared)
        for batch in batches:
            words = letters_only(batch.column(where)).dictionary_encode()
            new = [w for w in words.dictionary.to_pylist() if w not in seen]
            if len(seen) > 500_000:
                seen.clear()
                new = words.dictionary.to_pylist()
            if new:
                seen.update(zip(new, table.closest(new, owners, counts.value)))
            found = [seen[w] for w in words.dictionary.to_pylist()]
            at = words.indices
            out = [pa.array([f[i] for f in found], t).take(at) for i, t in enumerate((pa.string(), pa.int32(), pa.int32(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *out], names=[*batch.schema.names, "entry", "distance", "ties", "suggestion"])

    return map_arrow(odd, match, f"{fields}, {RESULT}").withColumnRenamed("__value", value)


@F.pandas_udf(T.DoubleType())
def _weights(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([weighted_damerau(x, y) for x, y in zip(a, b)], dtype=float)


def _by_join(rows: DataFrame, entries: DataFrame, k: int, keep: tuple[str, ...]) -> DataFrame:
    """The same for a reference too large to broadcast: deletes meet in a join.

    Only distinct odd values take part, so a hot value costs one row. A value
    outside the entries' lengths generates no deletes.
    """
    letters = lambda c: F.upper(F.regexp_replace(c, "[^A-Za-z]", ""))
    odd = rows.join(entries, rows["__value"] == F.col("entry"), "left_anti")
    span = entries.select(F.length(letters(F.col("entry"))).alias("n")).agg(F.max("n").alias("hi"))
    values = odd.select("__value").distinct().withColumn("w", letters(F.col("__value")))
    words = values.select("w").distinct().join(F.broadcast(span), F.length("w") <= F.col("hi") + k).select("w")
    refs = entries.withColumn("e", letters(F.col("entry")))

    def cuts(name: str) -> F.Column:
        once = lambda s: F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))
        level = F.array(F.col(name))
        out = level
        for _ in range(k):
            level = F.array_distinct(F.flatten(F.transform(level, lambda s: F.when(F.length(s) > 0, once(s)).otherwise(F.array(F.lit(""))))))
            out = F.concat(out, level)
        return F.explode(F.array_distinct(out))

    pairs = words.withColumn("c", cuts("w")).join(refs.withColumn("c", cuts("e")), "c").select("w", "e", "entry").distinct()
    near = pairs.withColumn("d", F.levenshtein("w", "e")).filter(F.col("d") <= k)
    # A word has few entries this near, so its window is small.
    mine = Window.partitionBy("w")
    best = near.withColumn("m", F.min("d").over(mine)).filter("d = m").withColumn("ties", F.count(F.lit(1)).over(mine).cast("int"))
    one = best.filter("ties = 1").select("w", F.col("d").cast("int").alias("distance"), "ties", F.col("entry").alias("suggestion"), "entry")
    # Only where several tie are they weighed.
    often = rows.groupBy(F.col("__value").alias("o")).agg(F.count(F.lit(1)).alias("often"))
    tied = best.filter("ties > 1").join(often, F.col("entry") == F.col("o"), "left").withColumn("weight", _weights("w", "e"))
    likeliest = F.min(F.struct("weight", -F.coalesce("often", F.lit(0)), "entry"))
    tied = tied.groupBy("w").agg(F.first("d").cast("int").alias("distance"), F.first("ties").alias("ties"), likeliest["entry"].alias("suggestion"))
    closest = one.unionByName(tied.withColumn("entry", F.lit(None).cast("string")))
    by_value = values.join(closest, "w", "left").select(F.col("__value").alias("__v"), "entry", "distance", F.coalesce("ties", F.lit(0)).alias("ties"), "suggestion")
    return odd.join(by_value, F.col("__value") == F.col("__v")).select(*[col(c) for c in keep], "__value", "entry", "distance", "ties", "suggestion")
