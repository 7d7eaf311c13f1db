"""Encoding a corpus with a public byte-level BPE tokenizer.

Texts are cut into words by one regular expression on the JVM. Each task keeps
the words it has met with their ids; words new to it are encoded by a recursive
query in an embedded DuckDB: rows (word, position, token) are paired with their
neighbours, the pairs looked up in the merge table, and the leftmost pair of
least rank in each word contracted, until no word has a pair to merge. Ids are
then spread over the texts with array gathers, so the cost of a repeated word
is one lookup. Decoding joins the ids with the tokens' bytes and aggregates
them in order.

The vocabulary file is read on the driver and its merge table, of the size of
the vocabulary, broadcast.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readroute.session import col, map_arrow

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"

#: How the tokenizer cuts words, in Java's syntax. Blanks are Unicode's.
WORDS = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}++| ?\p{N}++| ?[^\p{IsWhite_Space}\p{L}\p{N}]++"
    r"|\p{IsWhite_Space}+(?![^\p{IsWhite_Space}])|\p{IsWhite_Space}++"
)

#: Words up to this many bytes contract one pair a step; longer ones contract
#: all places of their least pair at once, which takes fewer, costlier steps.
#: Longer ones are first cut where no merge can reach across.
SHORT = 64

_PAIRED = """
  paired AS (SELECT w, p, t, lead(t) OVER o AS t2, lead(p) OVER o AS p2 FROM state WHERE live WINDOW o AS (PARTITION BY w ORDER BY p)),
  ranked AS (SELECT s.*, m.m FROM paired s LEFT JOIN merges m ON m.k = (s.t::BIGINT << 32) | s.t2)"""

LEFTMOST = f"""
WITH RECURSIVE state(w, p, t, live) AS (
  SELECT w, p, t, true FROM words
  UNION ALL
  (WITH {_PAIRED},
  best AS (SELECT w, min((m::BIGINT << 32) | p) AS b, arg_min(p2, (m::BIGINT << 32) | p) AS gone FROM ranked WHERE m IS NOT NULL GROUP BY w)
  SELECT r.w, r.p, CASE WHEN r.p = b & 4294967295 THEN (b >> 32)::INTEGER ELSE r.t END, b IS NOT NULL
  FROM ranked r LEFT JOIN best USING (w) WHERE b IS NULL OR r.p <> gone))
SELECT w, list(t ORDER BY p) AS ids FROM state WHERE NOT live GROUP BY w ORDER BY w"""

EVERYWHERE = f"""
WITH RECURSIVE state(w, p, t, live) AS (
  SELECT w, p, t, true FROM words
  UNION ALL
  (WITH {_PAIRED},
  best AS (SELECT *, min(m) OVER (PARTITION BY w) AS b, row_number() OVER (PARTITION BY w ORDER BY p) AS i FROM ranked),
  runs AS (SELECT *, coalesce(m = b, false) AS hit,
    i - coalesce(max(CASE WHEN m = b THEN NULL ELSE i END) OVER (PARTITION BY w ORDER BY p ROWS UNBOUNDED PRECEDING), 0) AS place FROM best),
  taken AS (SELECT *, hit AND place % 2 = 1 AS take FROM runs),
  after AS (SELECT *, coalesce(lag(take) OVER (PARTITION BY w ORDER BY p), false) AS gone FROM taken)
  SELECT w, p, CASE WHEN take THEN b ELSE t END, b IS NOT NULL FROM after WHERE NOT gone))
SELECT w, list(t ORDER BY p) AS ids FROM state WHERE NOT live GROUP BY w ORDER BY w"""


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary file: printable
    bytes stand for themselves, the others for letters from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class Merges:
    """The merge table: pairs of ids packed in 64 bits, and what they become."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        letters = byte_letters()
        self.bytes = np.array([vocab[c] for c in letters], np.int32)
        pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        packed = np.array([(vocab[a] << 32) | vocab[b] for a, b in pairs], np.int64)
        # A merge's rank is its place; the ids of this kind of file follow it.
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        if (np.diff(self.made) <= 0).any():
            raise ValueError("ids of the vocabulary do not follow the ranks of its merges")
        self.pairs = packed
        back = {c: b for b, c in enumerate(letters)}
        self.tokens = {i: bytes(back[c] for c in t) for t, i in vocab.items() if all(c in back for c in t)}
        #: Whether two bytes stand side by side in any token. Where they do not,
        #: no merge ever reaches from one to the other.
        self.joins = np.zeros((256, 256), bool)
        for t in self.tokens.values():
            self.joins[list(t[:-1]), list(t[1:])] = True

    def pieces(self, raw: bytes) -> list[bytes]:
        """A word in parts that are encoded by themselves."""
        codes = np.frombuffer(raw, np.uint8)
        cuts = [0, *(np.flatnonzero(~self.joins[codes[:-1], codes[1:]]) + 1).tolist(), len(raw)]
        return [raw[a:b] for a, b in zip(cuts, cuts[1:])]


def _database():
    import duckdb

    # All in memory: a worker's own folder is no place for spilled data.
    return duckdb.connect(config={"threads": 1, "memory_limit": "512MB", "temp_directory": ""})


class Encoder:
    """Encodes words, remembering up to ``most`` of them; a query takes about
    ``letters`` bytes of words at a time."""

    def __init__(self, merges: Merges, most: int = 200_000, letters: int = 200_000):
        self.merges, self.most, self.letters = merges, most, letters
        self.known: dict[str, np.ndarray] = {}
        self.con = _database()
        self.con.register("given", pa.table({"k": merges.pairs, "m": merges.made}))
        self.con.execute("CREATE TABLE merges AS SELECT k, m FROM given")

    def _run(self, raw: list[bytes], sql: str) -> Iterator[tuple[bytes, np.ndarray]]:
        lengths = np.array([len(r) for r in raw])
        flat = self.merges.bytes[np.frombuffer(b"".join(raw), np.uint8)]
        at = np.repeat(np.arange(len(raw), dtype=np.int32), lengths)
        place = (np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.int32)
        self.con.register("words", pa.table({"w": at, "p": place, "t": flat}))
        found = self.con.sql(sql).to_arrow_reader().read_all()
        self.con.unregister("words")
        for batch in found.to_batches():
            ids = batch.column(1)
            values, offsets = ids.values.to_numpy().astype(np.int32), ids.offsets.to_numpy()
            for w, a, b in zip(batch.column(0).to_pylist(), offsets[:-1], offsets[1:]):
                yield raw[w], values[a:b].copy()

    def learn(self, words: list[str]) -> None:
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > self.most:
            self.known, new = {}, words
        raw = {w: w.encode("utf-8") for w in new}
        parts = {w: self.merges.pieces(r) if len(r) > SHORT else [r] for w, r in raw.items() if r}
        distinct = list({p for ps in parts.values() for p in ps})
        made: dict[bytes, np.ndarray] = {}
        for long, sql in ((False, LEFTMOST), (True, EVERYWHERE)):
            pick = [p for p in distinct if (len(p) > SHORT) == long]
            ends = np.cumsum([len(p) for p in pick])
            a = 0
            while a < len(pick):
                # As many as hold ``letters`` bytes, or one that is longer.
                top = (ends[a - 1] if a else 0) + self.letters
                b = max(a + 1, int(np.searchsorted(ends, top, "right")))
                made.update(self._run(pick[a:b], sql))
                a = b
        for w, ps in parts.items():
            self.known[w] = made[ps[0]] if len(ps) == 1 else np.concatenate([made[p] for p in ps])

    def encode(self, pieces: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, offsets of the texts in them)."""
        ends = pieces.offsets.to_numpy()
        words = pieces.values.slice(ends[0], ends[-1] - ends[0]).dictionary_encode()
        if not len(words.dictionary):
            return np.zeros(0, np.int32), np.zeros(len(pieces) + 1, np.int32)
        names = words.dictionary.to_pylist()
        self.learn(names)
        ids = [self.known[w] for w in names]
        lengths = np.array([len(x) for x in ids])
        flat, first = np.concatenate(ids), np.cumsum(lengths) - lengths
        code = words.indices.to_numpy()
        n = lengths[code]
        stop = np.cumsum(n)
        spread = np.repeat(first[code] - stop + n, n) + np.arange(stop[-1])
        return flat[spread], np.concatenate([[0], stop])[ends - ends[0]].astype(np.int32)


def _slices(batch: pa.RecordBatch, most: int = 600_000) -> Iterator[pa.RecordBatch]:
    """Runs of a batch's rows with about ``most`` words, or one longer row."""
    ends = batch.column(batch.num_columns - 1).offsets.to_numpy()
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + most, "right")) - 1)
        yield batch.slice(a, b - a)
        a = b


#: One encoder a Python worker: tasks that follow in it know the words met.
_ENCODERS: dict[str, Encoder] = {}


def _encoder(name: str, merges: Merges) -> Encoder:
    if name not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[name] = Encoder(merges)
    return _ENCODERS[name]


def _run_over(df: DataFrame, text: str, out: str, path: str, ids: bool) -> DataFrame:
    if out.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"the input has a column {out!r} already; pass another name")
    shared = df.sparkSession.sparkContext.broadcast(Merges(path))
    rest = [c for c in df.columns if c != text]
    cut = df.select(*[col(c) for c in rest], F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit(WORDS), F.lit(0)).alias("__pieces"))
    kind = T.ArrayType(T.IntegerType()) if ids else T.LongType()
    shape = T.StructType([*[f for f in cut.schema if f.name != "__pieces"], T.StructField(out, kind)])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, shared.value)
        for batch in (part for whole in batches for part in _slices(whole)):
            flat, ends = encoder.encode(batch.column(batch.num_columns - 1))
            made = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)) if ids else pa.array(np.diff(ends).astype(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], made], names=[*batch.schema.names[:-1], out])

    return map_arrow(cut, encode, shape)


def encode(df: DataFrame, text: str, out: str = "ids", path: str = VOCABULARY) -> DataFrame:
    """``df`` with the token ids of ``text`` in ``out``, in place of ``text``.

    No special tokens are added, and their strings inside a text are ordinary
    text. Null and empty texts have the empty list. Texts are encoded whole.
    Every row comes out once with its other columns; a column of ``df`` named
    like ``out`` raises ``ValueError``.
    """
    return _run_over(df, text, out, path, True)


def count_tokens(df: DataFrame, text: str, out: str = "n_tokens", path: str = VOCABULARY) -> DataFrame:
    """Like :func:`encode`, with the number of tokens instead of their ids."""
    return _run_over(df, text, out, path, False)


def decode(df: DataFrame, ids: str, out: str = "text", path: str = VOCABULARY) -> DataFrame:
    """``df`` with the text of ``ids`` in ``out``, in place of ``ids``.

    Null and empty lists give the empty text. An id the vocabulary lacks raises
    ``ValueError``; bytes that are no UTF-8 become the replacement character.
    """
    if out.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"the input has a column {out!r} already; pass another name")
    shared = df.sparkSession.sparkContext.broadcast(Merges(path).tokens)
    rest = [c for c in df.columns if c != ids]
    cut = df.select(*[col(c) for c in rest], F.coalesce(col(ids), F.array().cast("array<int>")).cast("array<int>").alias("__ids"))
    shape = T.StructType([*[f for f in cut.schema if f.name != "__ids"], T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _database()
        tokens = shared.value
        con.register("given", pa.table({"t": pa.array(list(tokens), pa.int32()), "hex": [b.hex() for b in tokens.values()]}))
        con.execute("CREATE TABLE tokens AS SELECT t, hex FROM given")
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            ends = lists.offsets.to_numpy()
            flat = lists.values.slice(ends[0], ends[-1] - ends[0])
            doc = np.repeat(np.arange(len(lists)), np.diff(ends))
            con.register("ids", pa.table({"d": doc, "p": np.arange(len(doc)), "t": flat}))
            rows = con.execute("SELECT d, string_agg(hex, '' ORDER BY p), count(*) FILTER (hex IS NULL) FROM ids LEFT JOIN tokens USING (t) GROUP BY d").fetchall()
            con.unregister("ids")
            texts = [""] * len(lists)
            for d, hexed, unknown in rows:
                if unknown:
                    raise ValueError("an id is not in the vocabulary")
                texts[d] = bytes.fromhex(hexed).decode("utf-8", "replace")
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*batch.schema.names[:-1], out])

    return map_arrow(cut, run, shape)
