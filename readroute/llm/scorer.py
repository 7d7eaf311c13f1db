"""A learned scorer of restored words: how abusive the worst passage of a text is.

Every word adds its own weight and that of the pairs and triples it makes with
the two words before it, as written and by class (names of groups, parts of the
body and so on), less a constant. A passage's score is the sum over its words,
and a text's that of the passage of the highest sum, wherever it begins and
ends: no window, no line, no list of words decides what is looked at. A word's
own weight is partly that of its letter sequences, so that words never seen get
one too.

The weights are fitted by logistic regression on the passages of
:mod:`phrases`, and on a bounded sample of the corpus as plain text: after each
fit the worst passages of the sample's texts join the plain side, but for those
that score like the abusive ones, which may be just that.
"""

from __future__ import annotations

import random
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import xxhash

from readroute.llm import phrases

_BITS = 20
BUCKETS = 1 << _BITS
KINDS = phrases.KINDS
#: Classes of words, by the lists of the frames' slots.
_CLASSES = ("slur", "fool", "fools", "contempt", "sexpart", "sexdo", "sex", "bad", "group", "vermin", "harm", "harmed", "part", "kin", "weapon", "bare", "thing", "animal", "place")
_DEMONYM = ("ians", "eans", "anis", "nese", "stanis")
_M1, _M2, _M3, _M4 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def _classes() -> dict[str, str]:
    out: dict[str, str] = {}
    for name in _CLASSES:
        # Lists of other languages are of the same classes.
        for own in (name, *(n for n in phrases.LISTS if n[2:] == "_" + name)):
            for w in phrases.LISTS.get(own, ()):
                if " " not in w:
                    out.setdefault(w, "fool" if name == "fools" else name)
    return out


_CLASS = _classes()


def word_class(word: str) -> str:
    found = _CLASS.get(word)
    if found is None and len(word) > 6 and word.endswith(_DEMONYM):
        return "group"
    return found or word


def grams(word: str) -> list[str]:
    """Sequences of three to five letters, the word's ends marked."""
    text = f"<{word}>"
    return [text[a : a + n] for n in (3, 4, 5) for a in range(len(text) - n + 1)] if 3 < len(word) <= 40 else []


def word_hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8"))


class Words:
    """Numbers for words, with what the features need of each."""

    def __init__(self):
        self.ids: dict[str, int] = {}
        self.names: list[str] = []
        self.hash: list[int] = []
        self.by_class: list[int] = []

    def __call__(self, word: str) -> int:
        i = self.ids.get(word)
        if i is None:
            i = self.ids[word] = len(self.names)
            self.names.append(word)
            self.hash.append(word_hash(word))
            self.by_class.append(word_hash("<" + word_class(word) + ">"))
        return i


def neighbours(h: np.ndarray, c: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Keys of the features each word makes with the two before it: arrays as
    long as ``h``, 0 where a text does not reach back that far. ``first`` marks
    the first word of each text."""
    n = len(h)
    start = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    depth = np.arange(n) - start
    back = lambda x, k: np.concatenate([np.zeros(min(k, n), np.uint64), x[: max(n - k, 0)]])
    h1, c1, c2 = back(h, 1), back(c, 1), back(c, 2)
    made = [
        (1, h1 * _M1 + h),
        (1, c1 * _M2 + c),
        (2, back(h, 2) * _M3 + h * _M1),
        (2, c2 * _M2 + c * _M3),
        (2, (c2 * _M1 + c1) * _M3 + c),
    ]
    return [np.where(depth >= need, x * _M4, np.uint64(0)) for need, x in made]


def _place(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and mark of keys: the top bits, and others to tell those of one
    bucket apart."""
    return (keys >> np.uint64(64 - _BITS)).astype(np.int32), (keys >> np.uint64(48 - _BITS)).astype(np.uint16)


@dataclass
class Weights:
    """The fitted model. Words and letter sequences are looked up by name, as
    each different word is met once; pairs and triples by hash."""

    words: dict[str, tuple]
    grams: dict[str, tuple]
    table: np.ndarray
    marks: np.ndarray
    #: by kind, the same over the abusive passages alone
    kinds: np.ndarray
    #: constants a word and a text, and of the kinds
    each: float
    base: float
    kinds_base: np.ndarray

    def of_word(self, word: str) -> np.ndarray:
        """A word's own weight, and its weights by kind."""
        out = np.zeros(1 + len(KINDS))
        out[0] = self.each
        out += self.words.get(word, 0.0)
        parts = grams(word)
        for g in parts:
            if g in self.grams:
                out += np.divide(self.grams[g], len(parts))
        return out

    def around(self, near: list[np.ndarray]) -> np.ndarray:
        out = np.zeros(len(near[0]), np.float32)
        for keys in near:
            at, mark = _place(keys)
            out += np.where(self.marks[at] == mark, self.table[at], 0)
        return out

    def kinds_around(self, near: list[np.ndarray]) -> np.ndarray:
        out = np.zeros(len(KINDS))
        for keys in near:
            at, mark = _place(keys)
            out += self.kinds[at[self.marks[at] == mark]].sum(axis=0)
        return out


def best_passages(value: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts beginning at ``starts`` (none empty): the highest sum of
    consecutive values, and the first and last place of that passage."""
    total = np.cumsum(value, dtype=np.float64)
    before = total - value
    text = np.zeros(len(value), np.int64)
    text[starts[1:]] = 1
    text = np.cumsum(text)
    # Lowered text by text, a running minimum starts anew with each.
    low = before - text * (total.max() - total.min() + np.abs(value).max() + 1)
    least = np.minimum.accumulate(low)
    sums = low + value - least
    best = np.maximum.reduceat(sums, starts)
    place = np.arange(len(value))
    end = np.minimum.reduceat(np.where(sums >= best[text], place, len(value)), starts)
    begin = np.maximum.accumulate(np.where(low <= least, place, 0))[end]
    return best, begin, end


class _Examples:
    """Passages as a sparse matrix over the features they have: words, letter
    sequences of words, and what words make with those before them."""

    def __init__(self, words: Words, lists: Sequence[Sequence[int]]):
        flat = np.fromiter((w for x in lists for w in x), np.int64)
        sizes = np.array([len(x) for x in lists])
        row = np.repeat(np.arange(len(lists)), sizes)
        starts = np.cumsum(sizes) - sizes
        first = np.zeros(len(flat), bool)
        first[starts] = True
        h, c = np.array(words.hash, np.uint64)[flat], np.array(words.by_class, np.uint64)[flat]
        used, at = np.unique(flat, return_inverse=True)
        self.words = [words.names[w] for w in used]
        parts = [grams(w) for w in self.words]
        self.grams = sorted({g for p in parts for g in p})
        number = {g: len(used) + i for i, g in enumerate(self.grams)}
        count = np.array([len(p) for p in parts])
        held = np.array([number[g] for p in parts for g in p], np.int64)
        begin, n = (np.cumsum(count) - count)[at], count[at]
        spread = np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())
        near = neighbours(h, c, first)
        keys = np.concatenate(near)
        there = np.flatnonzero(keys)
        self.keys, pair = np.unique(keys[there], return_inverse=True)
        self.rows = np.concatenate([row, np.repeat(row, n), np.tile(row, len(near))[there]])
        self.cols = np.concatenate([at, held[spread], len(used) + len(self.grams) + pair])
        self.vals = np.concatenate([np.ones(len(flat)), np.repeat(1.0 / np.maximum(n, 1), n), np.ones(len(there))])
        self.columns = len(used) + len(self.grams) + len(self.keys)
        self.sizes, self.n = sizes.astype(float), len(lists)

    def names(self) -> list:
        return [*self.words, *(("#", g) for g in self.grams), *self.keys.tolist()]


def _fit(x: _Examples, y: np.ndarray, weight: np.ndarray, steps: int, ridge: float, begin: tuple | None = None) -> tuple[np.ndarray, float, float]:
    """Logistic regression by adaptive gradient steps over all examples:
    (weight by column, constant a word, constant a passage)."""
    w, each, base = (np.zeros(x.columns), -0.3, -1.0) if begin is None else begin
    grads, g_each, g_base = np.full(len(w), 1e-3), 1e-3, 1e-3
    for _ in range(steps):
        z = np.bincount(x.rows, x.vals * w[x.cols], x.n) + each * x.sizes + base
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight
        grad = np.bincount(x.cols, x.vals * error[x.rows], x.columns) + ridge * w
        grads += grad * grad
        w = w - 0.25 * grad / np.sqrt(grads)
        d_each, d_base = float((error * x.sizes).sum()), float(error.sum())
        g_each, g_base = g_each + d_each**2, g_base + d_base**2
        each, base = each - 0.1 * d_each / np.sqrt(g_each), base - 0.1 * d_base / np.sqrt(g_base)
        # Every further word must cost something, or passages would not end.
        each = min(each, -0.1)
    return w, each, base


def fit(restore, sample: Sequence[Sequence[str]] = (), ordinary: Sequence[str] = (), seed: int = 7, rounds: int = 4, steps: int = 60, leave_out: int | None = None, ridge: float = 0.01, suspect: float = 0.9) -> Weights:
    """Weights from the passages and the words of sampled texts.

    ``restore`` turns a text into words. ``ordinary`` are words that alone say
    nothing; strings of random letters are added to them. With ``leave_out``
    every fifth frame from that one on is not learned from (for measuring on
    those frames).
    """
    rng = random.Random(seed)
    words = Words()
    lists: list[list[int]] = []
    label: list[int] = []
    for k, kind in enumerate((*KINDS, "plain")):
        number = {f: i for i, f in enumerate(phrases.frames(kind))}
        for frame, text in phrases.passages(kind, rng, 6 if kind != "plain" else 4):
            if leave_out is None or number[frame] % 5 != leave_out:
                ids = [words(w) for w in restore(text)]
                if ids:
                    lists.append(ids)
                    label.append(k)
    texts = [[words(w) for w in t] for t in sample if t]
    plain = len(KINDS)
    scribble = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(1, 12))) for _ in range(len(ordinary) // 3)]
    alone = [words(w) for w in (*ordinary, *scribble)]
    lists += [[w] for w in alone]
    label += [plain] * len(alone)
    lists += [[rng.choice(alone) for _ in range(rng.randint(2, 8))] for _ in range(len(alone) // 3)]
    label += [plain] * (len(alone) // 3)
    pieces = [t[a : a + rng.randint(2, 14)] for t in texts for a in (rng.randrange(len(t)), rng.randrange(len(t)))]
    begin, known = None, {}
    for turn in range(rounds):
        x = _Examples(words, lists)
        y = (np.array(label) < plain).astype(float)
        if begin is not None:
            begin = (np.array([known.get(n, 0.0) for n in x.names()]), *begin[1:])
        begin = _fit(x, y, np.where(y > 0, 1.5, 1.0), steps, ridge, begin)
        known = dict(zip(x.names(), begin[0].tolist()))
        model = _weights(x, *begin)
        if turn + 1 < rounds:
            found = [(ids[a : b + 1], score) for ids, score, a, b in _worst(model, words, texts) if score > 0.02]
            if turn == 0:
                # The first fit knows the passages alone, and judges the sample.
                found += [(ids, score) for ids, score, _, _ in _worst(model, words, pieces)]
            clean = [ids for ids, score in found if score < suspect]
            lists += clean
            label += [plain] * len(clean)
            own = [ids for ids, k in zip(lists, label) if k == plain][:20_000]
            for ids, score, a, b in _worst(model, words, own):
                if score > 0.05 and b - a + 1 < len(ids):
                    lists.append(ids[a : b + 1])
                    label.append(plain)
    abusive = [i for i, k in enumerate(label) if k < plain]
    of = np.array([label[i] for i in abusive])
    z = _Examples(words, [lists[i] for i in abusive])
    fits = [_fit(z, (of == k).astype(float), np.ones(z.n), 40, ridge, (np.zeros(z.columns), 0.0, 0.0)) for k in range(len(KINDS))]
    return _weights(x, *begin, z, fits)


def _weights(x: _Examples, w: np.ndarray, each: float, base: float, z: _Examples | None = None, fits: Sequence[tuple] = ()) -> Weights:
    """The weights of a fit, and those by kind of passages ``z``."""
    every: dict = {n: np.concatenate([[v], np.zeros(len(KINDS))]) for n, v in zip(x.names(), w.tolist())}
    for k, (by_kind, _, _) in enumerate(fits):
        for n, v in zip(z.names(), by_kind.tolist()):
            every[n][1 + k] = v
    # Slight weights of pairs only add noise where buckets collide.
    keys = sorted((k for k, v in every.items() if isinstance(k, int) and abs(v[0]) > 0.02), key=lambda k: abs(every[k][0]))
    table, marks, kinds = np.zeros(BUCKETS, np.float32), np.zeros(BUCKETS, np.uint16), np.zeros((BUCKETS, len(KINDS)), np.float32)
    if keys:
        at, mark = _place(np.array(keys, np.uint64))
        values = np.array([every[k] for k in keys])
        table[at], marks[at], kinds[at] = values[:, 0], mark, values[:, 1:]
        # The key of no feature lies here.
        table[0], kinds[0] = 0, 0
    words = {k: tuple(v) for k, v in every.items() if isinstance(k, str)}
    parts = {k[1]: tuple(v) for k, v in every.items() if isinstance(k, tuple)}
    return Weights(words, parts, table, marks, kinds, each, base, np.array([f[2] for f in fits]) if fits else np.zeros(len(KINDS)))


def _worst(model: Weights, words: Words, texts: Sequence[Sequence[int]]):
    """(text, score, first, last) of each text's worst passage."""
    if not texts:
        return []
    own = np.array([model.of_word(w)[0] for w in words.names])
    flat = np.fromiter((w for t in texts for w in t), np.int64)
    sizes = np.array([len(t) for t in texts])
    starts = np.cumsum(sizes) - sizes
    first = np.zeros(len(flat), bool)
    first[starts] = True
    h, c = np.array(words.hash, np.uint64)[flat], np.array(words.by_class, np.uint64)[flat]
    best, begin, end = best_passages(own[flat] + model.around(neighbours(h, c, first)), starts)
    score = 1 / (1 + np.exp(-(best + model.base)))
    return list(zip(texts, score, begin - starts, end - starts))
