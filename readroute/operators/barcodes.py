"""Correcting barcodes against a whitelist and translating them.

The table of all one-edit variants of a whitelist is never needed: it has some
150 rows a barcode. Instead the distinct observed barcodes that are not on the
list generate their own neighbours, which are joined to the list; a barcode is
corrected when exactly one list entry is a neighbour.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readroute.session import col, cut, fresh

# The letters an error may put into a barcode.
LETTERS = "ATGCN"

#: Stands for any one letter; no barcode holds it.
MASK = "\x01"


def _positions(text: Column) -> Column:
    return F.when(F.length(text) > 0, F.sequence(F.lit(1), F.length(text))).otherwise(F.array().cast("array<int>"))


def _with(text: Column, at: Column, new: Column | str, skip: int) -> Column:
    head = F.substring(text, F.lit(1), at - 1)
    tail = F.substring(text, at + skip, F.length(text))
    return F.concat(head, F.lit(new) if isinstance(new, str) else new, tail)


def substitutions(text: Column) -> Column:
    """All different strings with one letter replaced by another of ATGCN."""
    each = F.flatten(F.transform(_positions(text), lambda i: F.array(*[F.when(F.substring(text, i, F.lit(1)) != c, _with(text, i, c, 1)) for c in LETTERS])))
    return F.array_distinct(F.filter(each, lambda v: v.isNotNull()))


def insertions(text: Column) -> Column:
    """All different strings with one letter of ATGCN put in."""
    places = F.sequence(F.lit(1), F.length(text) + 1)
    return F.array_distinct(F.flatten(F.transform(places, lambda i: F.array(*[_with(text, i, c, 0) for c in LETTERS]))))


def deletions(text: Column) -> Column:
    """All different strings with one letter taken out."""
    return F.array_distinct(F.transform(_positions(text), lambda i: _with(text, i, "", 1)))


def correction_table(whitelist: DataFrame, barcode: str = "barcode") -> DataFrame:
    """(variant, barcode): the literal table, for small lists and for checking.

    A variant is kept when exactly one row of the list generates it, so the
    variants of a repeated entry are all ambiguous; each entry maps to itself.
    Null entries are ignored.
    """
    entries = whitelist.filter(col(barcode).isNotNull()).select(col(barcode).alias("barcode"))
    made = entries.select("barcode", F.explode(F.concat(substitutions(F.col("barcode")), insertions(F.col("barcode")), deletions(F.col("barcode")))).alias("variant"))
    single = made.groupBy("variant").agg(F.count(F.lit(1)).alias("n"), F.first("barcode").alias("barcode")).filter("n = 1")
    known = entries.distinct()
    other = single.join(known.select(F.col("barcode").alias("known")), F.col("variant") == F.col("known"), "left_anti")
    return other.select("variant", "barcode").unionByName(known.select(F.col("barcode").alias("variant"), "barcode"))


def _sources(text: Column) -> Column:
    """The list entries that could have become ``text`` by one edit: an edit
    puts in letters of ATGCN only, and may take out any letter."""
    of_list = F.array(*[F.lit(c) for c in LETTERS])
    inserted = F.filter(_positions(text), lambda i: F.array_contains(of_list, F.substring(text, i, F.lit(1))))
    without = F.transform(inserted, lambda i: _with(text, i, "", 1))
    # What a letter of the text replaced is unknown, so it becomes a wildcard.
    masked = F.transform(inserted, lambda i: _with(text, i, MASK, 1))
    longer = F.transform(F.sequence(F.lit(1), F.length(text) + 1), lambda i: _with(text, i, MASK, 0))
    return F.array_distinct(F.concat(without, masked, longer))


def corrections(df: DataFrame, barcode: str, whitelist: DataFrame, entry: str = "barcode", by: tuple[str, ...] = (), out: str = "corrected") -> DataFrame:
    """(``by``..., ``barcode``, ``n_rows``, ``out``) of the different barcodes
    of ``df`` that are on the list or within one edit of exactly one row of it.

    ``by`` names columns of both frames that must agree, as where several lists
    stand in one. Only different barcodes and their neighbours are shuffled.
    """
    keys = [*by, "key"]
    listed = whitelist.filter(col(entry).isNotNull()).groupBy(*[col(c).alias(c) for c in by], col(entry).alias("entry")).agg(F.count(F.lit(1)).alias("times"))
    # Each entry answers to itself, and to itself with one letter masked.
    names = F.concat(F.array(F.col("entry")), F.transform(_positions(F.col("entry")), lambda i: _with(F.col("entry"), i, MASK, 1)))
    answers = listed.select(*[col(c) for c in by], "entry", "times", F.explode(F.array_distinct(names)).alias("name"))
    seen = df.filter(col(barcode).isNotNull()).groupBy(*[col(c).alias(c) for c in by], col(barcode).alias("key")).agg(F.count(F.lit(1)).alias("n_rows"))
    known = listed.select(*[col(c) for c in by], F.col("entry").alias("key"))
    same = seen.join(known, keys, "left_semi").withColumn(out, F.col("key"))
    odd = seen.join(known, keys, "left_anti").select(*keys, "n_rows", F.explode(_sources(F.col("key"))).alias("name"))
    met = odd.join(answers, [*by, "name"]).filter(F.col("entry") != F.col("key")).select(*keys, "n_rows", "entry", "times").distinct()
    one = met.groupBy(*keys).agg(F.first("n_rows").alias("n_rows"), F.sum("times").alias("n"), F.first("entry").alias(out)).filter("n = 1").drop("n")
    return same.unionByName(one).withColumnRenamed("key", barcode)


def attach(df: DataFrame, table: DataFrame, keys: tuple[str, ...], out: str, n_rows: str = "n_rows", max_broadcast: int = 500_000, hot_share: int = 256) -> DataFrame:
    """``df`` with the column ``out`` of ``table``, which has a row a key; null
    where it has none. ``n_rows`` is how many rows of ``df`` a key of it holds.

    A table of up to ``max_broadcast`` rows is broadcast. Of a longer one only
    the keys holding more than ``1 / hot_share`` of the rows are, fewer than
    ``hot_share``, and the rest is joined by key, in which none is hot.
    """
    table = cut(table)
    held = table.agg(F.count(F.lit(1)).alias("keys"), F.sum(n_rows).alias("rows")).first()
    if held["keys"] <= max_broadcast:
        return _attached(df, F.broadcast(table), keys, out)
    hot = F.col(n_rows) > held["rows"] // hot_share
    mark = fresh("hot", df)
    few = table.filter(hot).select(*[col(k) for k in keys], F.lit(True).alias(mark), col(out))
    marked = _attached(_attached(df, F.broadcast(few), keys, mark), F.broadcast(few), keys, out)
    rest = _attached(marked.filter(col(mark).isNull()).drop(out), table.filter(~hot), keys, out)
    return marked.filter(col(mark)).drop(mark).unionByName(rest.drop(mark))


def _attached(df: DataFrame, table: DataFrame, keys: tuple[str, ...], out: str) -> DataFrame:
    names = [fresh(f"to_{i}", df) for i in range(len(keys))]
    value = fresh("to_value", df)
    right = table.select(*[col(k).alias(n) for k, n in zip(keys, names)], col(out).alias(value))
    same = None
    for k, n in zip(keys, names):
        same = (col(k) == F.col(n)) if same is None else same & (col(k) == F.col(n))
    return df.join(right, same, "left").withColumn(out, F.col(value)).drop(*names, value)


def correct(df: DataFrame, barcode: str, whitelist: DataFrame, entry: str = "barcode", out: str = "corrected") -> DataFrame:
    """``df`` with the corrected barcode in ``out``, null where there is none.

    Entries of the list stay as they are; others take the one list row within
    one edit, if there is exactly one (a repeated entry counts each time). Null
    barcodes, and all others against an empty list, give null. Rows, repeats
    and other columns stay; an existing column ``out`` raises ``ValueError``.
    ``df`` is read twice: for its different barcodes, and to attach them.
    """
    if out.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"the input has a column {out!r} already; pass another name")
    value = fresh("fixed", df)
    table = corrections(df.select(col(barcode).alias("barcode")), "barcode", whitelist, entry, out=value)
    return attach(df, table.withColumnRenamed("barcode", barcode), (barcode,), value).withColumnRenamed(value, out)


def _piece(text: Column, i: Column, parts: int) -> Column:
    """The i-th (from 0) of ``parts`` pieces of a text, of about one size."""
    n = F.length(text)
    begin, end = F.floor(i * n / parts).cast("int"), F.floor((i + 1) * n / parts).cast("int")
    return F.substring(text, begin + 1, end - begin)


def _within(pairs: DataFrame, entries: DataFrame, radius: int, b: str, q: str) -> DataFrame:
    """(b, q, entry, times, weight, mismatches) of all entries of a barcode's
    length with at most ``radius`` mismatches. Of radius + 1 pieces one at least
    must be the same, so only those that share one meet."""
    numbers = F.sequence(F.lit(0), F.lit(radius))
    cut_up = lambda text: F.transform(numbers, lambda i: F.struct(F.length(text).alias("n"), i.alias("i"), _piece(text, i, radius + 1).alias("s")))
    mine = pairs.select(b, q, F.explode(cut_up(F.col(b))).alias("piece"))
    listed = entries.select("entry", "times", F.explode(cut_up(F.col("entry"))).alias("piece"))
    met = mine.join(listed, "piece").select(b, q, "entry", "times").distinct()
    at = F.sequence(F.lit(1), F.length(b))
    letter = lambda c, i: F.substring(F.col(c), i, F.lit(1))
    differs = lambda i: letter(b, i) != letter("entry", i)
    cost = lambda i: F.greatest((F.ascii(letter(q, i)) - 48) / F.lit(15.0), F.lit(0.0)) + 1
    found = met.withColumn("mismatches", F.size(F.filter(at, differs))).filter(F.col("mismatches") <= radius)
    return found.withColumn("weight", F.aggregate(at, F.lit(0.0), lambda total, i: total + F.when(differs(i), cost(i)).otherwise(0.0)))


def correct_weighted(df: DataFrame, barcode: str, quality: str, whitelist: DataFrame, entry: str = "barcode", max_dist: int = 2, min_weight_dist: float = 0.5, out: str = "corrected") -> DataFrame:
    """``df`` with the list's entry nearest by quality-weighted mismatches.

    A mismatch at a base of score Q weighs ``1 + max((Q - 15) / 15, 0)``. The
    nearest entry of the barcode's length is taken if it has at most
    ``max_dist`` mismatches and the second nearest is farther by more than
    ``min_weight_dist`` (a repeated entry is its own second). Entries of the
    list stay; null barcodes, those whose quality is null or of another length,
    and those no entry fits give null.

    The distinct (barcode, quality) pairs meet the entries that share a piece
    with them. As a mismatch weighs 1 at least, a rival within the distance of
    the nearest weighs, and so differs, by no more than that; only pairs whose
    nearest is far enough for such a rival to differ by more than ``max_dist``
    are looked up again, in wider and wider classes.
    """
    if out.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"the input has a column {out!r} already; pass another name")
    b, q, fixed = fresh("bc_b", df), fresh("bc_q", df), fresh("bc_fixed", df)
    entries = whitelist.filter(col(entry).isNotNull()).groupBy(col(entry).alias("entry")).agg(F.count(F.lit(1)).alias("times"))
    seen = df.filter(col(barcode).isNotNull()).groupBy(col(barcode).alias(b), F.coalesce(col(quality), F.lit("")).alias(q)).agg(F.count(F.lit(1)).alias("n_rows"))
    known = entries.select(F.col("entry").alias(b))
    table = seen.join(known, b, "left_semi").withColumn(fixed, F.col(b))
    odd = seen.join(known, b, "left_anti").filter((F.length(b) == F.length(q)) & (F.length(b) > 0)).drop("n_rows")
    near = cut(_within(odd, entries, max_dist, b, q))
    first = near.groupBy(b, q).agg(F.floor(F.min("weight") + min_weight_dist).cast("int").alias("reach"))
    rivals, low = near.join(first.filter(F.col("reach") <= max_dist), [b, q], "left_semi"), max_dist
    # A base of the highest score there is weighs 6.2.
    most = int(6.2 * max_dist + min_weight_dist) + 1
    for high in [*(r for r in (4, 7) if max_dist < r < most), most]:
        wider = first.filter((F.col("reach") > low) & (F.col("reach") <= high)).select(b, q)
        rivals, low = rivals.unionByName(_within(wider, entries, high, b, q)), high
    place = F.row_number().over(Window.partitionBy(b, q).orderBy("weight", "entry"))
    two = rivals.withColumn("place", place).filter("place <= 2").groupBy(b, q)
    of = lambda c, k: F.max(F.when(F.col("place") == k, F.col(c)))
    two = two.agg(of("entry", 1).alias(fixed), of("times", 1).alias("times"), of("mismatches", 1).alias("mismatches"), of("weight", 1).alias("one"), of("weight", 2).alias("two"))
    clear = (F.col("mismatches") <= max_dist) & (F.col("times") == 1) & (F.col("two").isNull() | (F.col("one") < F.col("two") - min_weight_dist))
    table = table.unionByName(two.filter(clear).select(b, q, fixed).join(seen, [b, q]))
    asked = df.withColumn(q, F.coalesce(col(quality), F.lit("")))
    return attach(asked, table.withColumnRenamed(b, barcode), (barcode, q), fixed).withColumnRenamed(fixed, out).drop(q)


def translations(source: DataFrame, target: DataFrame) -> DataFrame:
    """(barcode, translated): entries of equal ``idx``; of a barcode listed
    more than once the last counts, and unpaired ones have none."""
    pairs = source.select("idx", "barcode").join(target.select("idx", F.col("barcode").alias("t")), "idx")
    return pairs.filter("barcode is not null").groupBy("barcode").agg(F.max_by("t", "idx").alias("translated"))


def translate(df: DataFrame, barcode: str, table: DataFrame, out: str = "translated") -> DataFrame:
    """``df`` with the translation of ``barcode``, itself where there is none."""
    if out.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"the input has a column {out!r} already; pass another name")
    k, t = fresh("tr_key", df), fresh("tr_to", df)
    known = table.select(F.col("barcode").alias(k), F.col("translated").alias(t))
    return df.join(known, col(barcode) == F.col(k), "left").withColumn(out, F.coalesce(t, col(barcode))).drop(k, t)


class BarcodeContext:
    """The whitelists of both assays and the translation between them.

    The lists are parameters: frames with ``idx`` and ``barcode``, or paths of
    headerless one-column text files, gzipped or not, in which the line number
    is the index. ``test`` keeps the first 100 entries.
    """

    def __init__(self, spark, atac, gex, test: bool = False):
        self.atac = self._load(spark, atac, test)
        self.gex = self._load(spark, gex, test)
        self.translation = translations(self.atac, self.gex)

    @staticmethod
    def _load(spark, source, test: bool) -> DataFrame:
        if isinstance(source, str):
            source = read_whitelist(spark, source)
        return source.filter("idx < 100") if test else source


def read_whitelist(spark, path: str) -> DataFrame:
    """(idx, barcode) of a headerless one-column list, numbered by its lines.

    A gzipped list is one partition; others are numbered through the offsets
    of their partitions, by a count of each.
    """
    lines = spark.read.text(path).select(F.split("value", "\t")[0].alias("barcode"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row"))
    counts = {r.part: r.n for r in lines.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    at, offsets = 0, []
    for part in sorted(counts):
        offsets.append((part, at))
        at += counts[part]
    starts = spark.createDataFrame(offsets, "part int, start long")
    inside = F.col("row") - F.shiftleft(F.col("part").cast("long"), 33)
    return lines.join(F.broadcast(starts), "part").select((F.col("start") + inside).alias("idx"), "barcode")
