"""Scoring documents for abusive, hateful and sexually explicit passages.

A noisy channel turns intended words into what stands in the text: digits and
signs for letters, stars for letters left out, letters repeated, separators,
blanks or invisible characters between letters, look-alikes of other scripts.
Each odd token is decoded by Viterbi search over the lattice of its characters'
readings under a character language model (:mod:`charmodel`), and the restored
words are scored by a learned model (:mod:`scorer`).

The JVM cuts texts into tokens; a worker restores each different token once,
and a batch's words are scored together by array operations.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readroute.llm import phrases, scorer
from readroute.llm.bpe import _slices
from readroute.llm.charmodel import ANY, STANDS_FOR, VOCABULARIES, CharModel, fold, latin, vocabulary
from readroute.session import col, map_arrow

KINDS = phrases.KINDS

#: Tokens: runs of letters, digits and the signs noise uses, and JSON escapes
#: of letters. Possessive, so that a token of any length needs no stack.
TOKENS = r"(?:\\u[0-9a-fA-F]{4}|[\p{L}\p{M}\p{N}\p{Cf}@$!*#%&+|.'’·•~_^-]++)++"
#: Texts sampled at most as plain ones when the scorer is fitted.
SAMPLE = 1000

_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})")
#: Scripts written without spaces: each character is a word.
_UNSPACED = re.compile("[぀-ヿ㐀-鿿가-힯]")
_SEPARATORS = re.compile(r"[._\-~·•^+|']+")
_EDGES = ".-_~·•'^+|&%#"
#: Letters, at least two, and signs that may stand for or between letters.
_HIDES = re.compile("(?=.*[a-z].*[a-z])[a-z%s]+" % re.escape("".join(STANDS_FOR) + ANY + _EDGES))
_CODED = re.compile("[A-Za-z0-9]{15,}")
_TWO = re.compile("[a-z].*[a-z]")
_NUMBER = r"^[-+.]?[0-9][0-9.eExX_%:/+*^~#&|-]*$"
#: Letters on both sides of an apostrophe, not single ones throughout.
_SHORTENED = re.compile(r"([a-z]+)'([a-z]{2,}|[stdm])|([a-z]{2,})'([a-z])")
# What stands shortened behind an apostrophe, and before it.
_LONG = {"m": "am", "re": "are", "ll": "will", "ve": "have", "d": "would", "s": ""}
_NOT = {"ca": "can", "wo": "will", "sha": "shall", "ai": "is"}


def unescape(token: str) -> str:
    """JSON escapes of letters as those letters; halves of pairs are joined."""
    plain = _ESCAPE.sub(lambda m: chr(int(m.group(1), 16)), token)
    return plain.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


class Restorer:
    """Tokens to restored words, remembering them."""

    def __init__(self, model: CharModel, most: int = 300_000):
        self.model, self.most = model, most
        self.known: dict[str, tuple[str, ...]] = {}

    def learn(self, tokens: Sequence[str]) -> None:
        """Restores all tokens not met before, decoding them together."""
        new = [t for t in tokens if t not in self.known]
        if len(self.known) + len(new) > self.most:
            self.known, new = {}, list(tokens)
        # Long runs of letters and digits, as images are coded in, first.
        coded = [t for t in new if _CODED.fullmatch(t) and not t.isalpha()]
        lost = {t for t, hopeless in zip(coded, self.model.hopeless(coded)) if hopeless}
        self.known.update(dict.fromkeys(lost, ("<num>",)))
        parted = {t: self._parts(t) for t in new if t not in lost}
        odd = {p for parts in parted.values() for p in parts if isinstance(p, tuple)}
        # The whole token first; where it is no word, its parts.
        read = self.model.decode(sorted({p[0] for p in odd} | {x for p in odd for x in p[1] if self._odd(x)}))
        for t, parts in parted.items():
            self.known[t] = tuple(w for p in parts for w in (self._choose(p, read) if isinstance(p, tuple) else [p]))

    def _odd(self, x: str) -> bool:
        """Whether a run of ASCII letters, digits and signs may hide a word."""
        if x in self.model.words:
            return False
        return _HIDES.fullmatch(x) is not None

    def _parts(self, token: str) -> list:
        """Words of the token, and (whole, parts) where it is to be decoded."""
        if "\\u" in token:
            token = unescape(token)
        if token.isascii() and token.isalpha():
            word = token.lower()
            return [word] if word in self.model.words else [(word, (word,))]
        word = token.lower() if token.isascii() else latin(token)
        if not word.isascii():
            if _UNSPACED.search(word):
                return [c for c in word if c.isalnum()]
            return ["".join(c for c in word if c.isalnum() or not c.isascii())]
        word = word.strip(_EDGES)
        bare = word.strip("!*" + _EDGES)
        if not bare or bare in self.model.words:
            return [bare] if bare else []
        short = _SHORTENED.fullmatch(word)
        if short:
            a, b = short.group(1) or short.group(3), short.group(2) or short.group(4)
            if b == "t" and a.endswith("n"):
                return [_NOT.get(a[:-1], a[:-1]), "not"]
            return [w for w in (a, _LONG.get(b, b)) if w]
        parts = tuple(p for p in _SEPARATORS.split(word) if p)
        if len(parts) > 1 and all(p in self.model.words for p in parts) and 3 * sum(len(p) == 1 for p in parts) <= len(parts):
            return list(parts)
        if not _TWO.search(word):
            return ["<num>"]
        return [(word, parts)]

    def _choose(self, odd: tuple[str, tuple[str, ...]], read: dict) -> list[str]:
        whole, parts = odd
        found = read.get(whole)
        # Whole, where signs stand within one word rather than between words.
        if found and (2 * sum(len(p) == 1 for p in parts) >= len(parts) or found[0] in self.model.words and not all(p in self.model.words for p in parts)):
            return self._run_on(found[0])
        if len(parts) == 1 and parts[0].isalpha():
            return self._run_on(parts[0])
        out: list[str] = []
        i = 0
        while i < len(parts):
            j = i
            while j < len(parts) and len(parts[j]) == 1 and parts[j].isalpha():
                j += 1
            if j - i >= 3:
                out += self.spelt(parts[i:j])
                i = j
                continue
            got = read.get(parts[i])
            plain = parts[i] if parts[i].isalpha() else parts[i].strip("!*@$") if parts[i].strip("!*@$").isalpha() else "<num>"
            out += self._run_on(got[0]) if got else self._run_on(plain) if plain.isalpha() else [plain]
            i += 1
        return out

    def _run_on(self, word: str) -> list[str]:
        """A word, or the words that run together in it."""
        if len(word) < 8 or word in self.model.words:
            return [word]
        return self.model.words_in(word) or [word]

    def spelt(self, letters: Sequence[str]) -> list[str]:
        """Single letters as the words they spell."""
        text = "".join(letters)
        return [text] if text in self.model.words else self.model.words_in(text) or [text]

    def words(self, text: str) -> list[str]:
        """A text's words, restored; for the passages that are learned from."""
        tokens = [t for t in re.findall(r"[^\s,;:()?\"]+", text)]
        self.learn(tokens)
        return self.joined([w for t in tokens for w in self.known[t]])

    def joined(self, words: list[str]) -> list[str]:
        """Runs of three and more single letters as the words they spell."""
        out: list[str] = []
        i = 0
        while i < len(words):
            j = i
            while j < len(words) and len(words[j]) == 1 and words[j].isascii() and words[j].isalpha():
                j += 1
            if j - i >= 3:
                out += self.spelt(words[i:j])
            else:
                out += words[i : max(j, i + 1)]
            i = max(j, i + 1)
        return out


def char_model(paths: Sequence[str] = VOCABULARIES) -> CharModel:
    """The character model over the vocabularies and the passages' words."""
    words, rng = vocabulary(paths), random.Random(3)
    abusive: set[str] = set()
    plain: set[str] = set()
    for kind in (*KINDS, "plain"):
        (plain if kind == "plain" else abusive).update(fold(w) for _, p in phrases.passages(kind, rng, 5) for w in p.split())
    for name in ("fool", "fools", "contempt", "slur", "sexpart"):
        plain -= {w for x in phrases.LISTS[name] for w in x.split()}
    least = sorted(words.values())[len(words) // 2]
    for w in abusive | plain:
        if w.isascii() and w.isalpha():
            words[w] = words.get(w, 0.0) + least
    return CharModel(words, abusive - plain)


class Scorer:
    """Scores batches of token lists under fitted weights."""

    def __init__(self, model: CharModel, weights: scorer.Weights, most: int = 300_000):
        self.restorer, self.weights, self.most = Restorer(model, most), weights, most
        self._forget()

    def _forget(self) -> None:
        self.words = scorer.Words()
        self.own = np.zeros(0, np.float32)
        self.hash, self.by_class, self.single = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool)

    def _number(self, words: Sequence[str]) -> list[int]:
        return [self.words(w) for w in words]

    def _update(self) -> None:
        a = len(self.own)
        if a < len(self.words.names):
            new = self.words.names[a:]
            self.own = np.concatenate([self.own, np.array([self.weights.of_word(w)[0] for w in new], np.float32)])
            self.hash = np.concatenate([self.hash, np.array(self.words.hash[a:], np.uint64)])
            self.by_class = np.concatenate([self.by_class, np.array(self.words.by_class[a:], np.uint64)])
            self.single = np.concatenate([self.single, np.array([len(w) == 1 and w.isascii() and w.isalpha() for w in new], bool)])

    def score(self, pieces: pa.ListArray) -> np.ndarray:
        """Scores (documents x (all, each kind)) of a batch of token lists."""
        out = np.zeros((len(pieces), 1 + len(KINDS)))
        ends = pieces.offsets.to_numpy()
        tokens = pieces.values.slice(ends[0], ends[-1] - ends[0]).dictionary_encode()
        if not len(tokens.dictionary):
            return out
        if len(self.words.names) > self.most:
            self._forget()
        # Runs of numbers are one word, and are not unpacked.
        number = pc.match_substring_regex(tokens.dictionary, _NUMBER).to_numpy(zero_copy_only=False)
        names = tokens.dictionary.filter(pa.array(~number)).to_pylist()
        self.restorer.learn(names)
        made = [self._number(self.restorer.known[t]) for t in names]
        nothing = self.words("<num>")
        self._update()
        count = np.ones(len(number), np.int64)
        count[~number] = [len(m) for m in made]
        flat, first = np.empty(count.sum(), np.int64), np.cumsum(count) - count
        flat[first[number]] = nothing
        spare = np.ones(len(flat), bool)
        spare[first[number]] = False
        flat[spare] = np.fromiter((w for m in made for w in m), np.int64)
        code = tokens.indices.to_numpy()
        again = number[code]
        again[1:] &= again[:-1].copy()
        again[:1] = False
        begin = ends[:-1] - ends[0]
        again[begin[begin < len(again)]] = False
        n = np.where(again, 0, count[code])
        stop = np.cumsum(n)
        word = flat[np.repeat(first[code] - stop + n, n) + np.arange(stop[-1] if len(stop) else 0)]
        bounds = np.concatenate([[0], stop])[ends - ends[0]]
        word, bounds = self._spelt(word, bounds)
        docs = np.flatnonzero(np.diff(bounds))
        if not len(docs):
            return out
        starts = bounds[:-1][docs]
        begins = np.zeros(len(word), bool)
        begins[starts] = True
        near = scorer.neighbours(self.hash[word], self.by_class[word], begins)
        best, a, b = scorer.best_passages(self.own[word] + self.weights.around(near), starts)
        out[docs, 0] = 1 / (1 + np.exp(-(best + self.weights.base)))
        for k, doc in enumerate(docs):
            if out[doc, 0] >= 0.1:
                out[doc, 1:] = out[doc, 0] * self._kinds(word[a[k] : b[k] + 1], [x[a[k] : b[k] + 1] for x in near])
        return out

    def _kinds(self, words: np.ndarray, near: list[np.ndarray]) -> np.ndarray:
        z = self.weights.kinds_base + sum(self.weights.of_word(self.words.names[w])[1:] for w in words) + self.weights.kinds_around(near)
        z = np.exp(z - z.max())
        return z / z.max()

    def _spelt(self, word: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Runs of three and more single letters as the words they spell."""
        single = self.single[word]
        if not single.any():
            return word, bounds
        edge = np.zeros(len(word) + 1, bool)
        edge[bounds] = True
        # A run ends where its text does.
        opens = single & (edge[:-1] | ~np.concatenate([[False], single[:-1]]))
        closes = single & (edge[1:] | ~np.concatenate([single[1:], [False]]))
        a, b = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        long = b - a >= 3
        runs = list(zip(a[long].tolist(), b[long].tolist()))
        if not runs:
            return word, bounds
        known: dict[tuple, list[int]] = {}
        parts, at, grown = [], 0, np.zeros(len(word) + 1, np.int64)
        for a, b in runs:
            key = tuple(word[a:b].tolist())
            if key not in known:
                known[key] = self._number(self.restorer.spelt([self.words.names[i] for i in key]))
            parts += [word[at:a], np.array(known[key], np.int64)]
            grown[b] += len(known[key]) - (b - a)
            at = b
        parts.append(word[at:])
        self._update()
        return np.concatenate(parts), bounds + np.cumsum(grown)[bounds]


def tokens_of(text: F.Column) -> F.Column:
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"\\[nrt\"\\]", " ")
    return F.regexp_extract_all(plain, F.lit(TOKENS), F.lit(0))


def fit(df: DataFrame, text: str, sample: int = SAMPLE, paths: Sequence[str] = VOCABULARIES) -> tuple[CharModel, scorer.Weights]:
    """The models: letters from the vocabularies, weights from the passages and
    from a sample of the texts of ``df`` as plain ones.

    About ``sample`` texts and at most twice as many are taken, those whose
    hash lies below the share they are of all; repeats count once. A sampled
    text gives at most 4,000 of its tokens, from a place its hash chooses;
    scoring reads all texts whole. Nothing but the sample is shuffled.
    """
    rows = df.select(col(text).alias("text"), F.xxhash64(col(text)).alias("h")).filter("text is not null")
    below = min(sample / max(df.count(), 1), 1.0) * 2.0**64 - 2.0**63
    held = rows.filter(F.col("h") <= F.lit(int(min(below, 2**63 - 1)))).groupBy("h").agg(F.first("text").alias("text")).limit(2 * sample)
    held = held.select("h", tokens_of(F.col("text")).alias("tokens"))
    begin = F.pmod(F.col("h"), F.greatest(F.size("tokens") - 4000, F.lit(1))).cast("int") + 1
    chosen = sorted(held.select("h", F.slice("tokens", begin, 4000).alias("tokens")).collect(), key=lambda r: r.h)
    model = char_model(paths)
    restorer = Restorer(model)
    restorer.learn(sorted({t for r in chosen for t in r.tokens}))
    texts = [restorer.joined([w for t in r.tokens for w in restorer.known[t]]) for r in chosen]
    return model, scorer.fit(restorer.words, texts, ordinary(model))


def ordinary(model: CharModel, many: int = 2000) -> list[str]:
    """Words of the vocabularies by falling weight, but for those of abuse."""
    return [w for w in sorted(model.words, key=lambda w: (-model.words[w], w)) if w not in model.offensive][:many]


_SCORERS: dict[str, Scorer] = {}


def score(df: DataFrame, text: str, models: tuple[CharModel, scorer.Weights] | None = None) -> DataFrame:
    """``df`` with the columns ``score, insult, threat, hate, sexual`` in place
    of ``text``: how likely the text's worst passage is abusive, from 0 to 1,
    and by kind. From :data:`CASE` on a document holds such a passage.

    The models are fitted on ``df`` itself where none are given. Null, empty
    and blank texts score 0. Texts are read whole. Columns of ``df`` named like
    a score raise ``ValueError``.
    """
    names = ("score", *KINDS)
    if {c.lower() for c in df.columns if c != text} & set(names):
        raise ValueError(f"the input has a column named like one of {names}; rename it first")
    rest = [c for c in df.columns if c != text]
    shared = df.sparkSession.sparkContext.broadcast(models or fit(df, text))
    key = str(shared.id) if hasattr(shared, "id") else str(shared._jbroadcast.id())
    cut = df.select(*[col(c) for c in rest], tokens_of(col(text)).alias("__tokens"))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in cut.schema if f.name != "__tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[key] = Scorer(*shared.value)
        for batch in (part for whole in batches for part in _slices(whole, 300_000)):
            found = _SCORERS[key].score(batch.column(batch.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *[pa.array(found[:, i]) for i in range(len(names))]], names=[*batch.schema.names[:-1], *names])

    return map_arrow(cut, run, fields + ", ".join(f"{n} double" for n in names))


#: The score from which a document holds such a passage.
CASE = 0.6


def rates(scored: DataFrame, source: str) -> DataFrame:
    """Per source: documents, those with a case, and their rate by kind."""
    case = lambda c: F.avg((F.col(c) >= CASE).cast("double"))
    return scored.groupBy(col(source).alias(source)).agg(F.count(F.lit(1)).alias("n_docs"), F.sum((F.col("score") >= CASE).cast("long")).alias("n_flagged"), case("score").alias("rate"), *[case(k).alias(f"{k}_rate") for k in KINDS])
