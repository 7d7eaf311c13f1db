"""A character language model, and the noisy channel decoded under it.

The model is an interpolated 4-gram model of letters with word boundaries,
counted over the words of public tokenizer vocabularies (whose rank says how
common a word is) and over the passages of :mod:`phrases`. It is open: any
string of letters has a probability, and words of the vocabulary have one of
their own beside it.

The channel turns intended letters into what stands in the text. A token is a
lattice: each character may be read as itself, as a letter it stands for, as any
letter (stars), as a separator, or as a repeat of the one before. The best paths
are found by Viterbi search over all tokens of a batch together, a character a
step, keeping the best states of each token. The reading is taken where it is
likelier than the token as it stands.
"""

from __future__ import annotations

import base64
import json
import re
import unicodedata
from collections.abc import Iterable

import numpy as np

from readroute.llm.bpe import byte_letters

VOCABULARIES = ("/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")

# What may stand for a letter, beside the letter itself.
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "gq",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t",
}
# Letters that stand for others, more rarely.
ALSO = {"v": "u", "x": "k", "z": "s", "k": "c", "w": "v", "y": "i"}
ANY, BETWEEN = "*#%&", ".-_~^+|*'"
_STARS, _READINGS = re.compile("[*#%&]"), re.compile(rf"[{''.join(ALSO)}]|(.)\1")

#: Costs (negative log-likelihoods) of the channel's acts.
SAME, SIGN, LETTER, WILD, GAP = 0.02, 1.2, 3.0, 0.3, 0.6
#: A repeat among three and more of a letter, and of a mere double letter.
AGAIN, TWICE = 0.5, 2.2
#: What a character costs in a token that is no language, as numbers and names.
PLAIN_LETTER, PLAIN_SIGN = 2.6, 3.6
#: How much likelier (in logarithms) stars are in a word that offends.
OFFENDS = 4.0
#: A token whose reading is this much worse after so many characters is left.
_PROBES, _HOPELESS = (7, 14), 5.0

_SIZE = 27


def fold(word: str) -> str:
    """Lower case without diacritics."""
    return "".join(c for c in unicodedata.normalize("NFKD", word.lower()) if not "̀" <= c <= "ͯ")


def vocabulary(paths: Iterable[str] = VOCABULARIES) -> dict[str, float]:
    """Words of the tokenizers' vocabularies, folded, with weights that fall
    with their rank. Only tokens that begin a word count."""
    back = {c: b for b, c in enumerate(byte_letters())}
    out: dict[str, float] = {}
    for path in paths:
        with open(path, encoding="utf-8") as f:
            if path.endswith(".json"):
                ranked = [(i, bytes(back[c] for c in t)) for t, i in json.load(f)["model"]["vocab"].items() if all(c in back for c in t)]
            else:
                ranked = [(int(i), base64.b64decode(t)) for t, i in (line.split() for line in f)]
        for rank, raw in ranked:
            word = fold(raw[1:].decode("utf-8", "ignore")) if raw[:1] == b" " else ""
            if word.isascii() and word.isalpha() and (len(word) > 1 or word in "ai"):
                out[word] = out.get(word, 0.0) + 1000.0 / (rank + 1000)
    return out


class CharModel:
    """Letters by the three before them, and words as wholes."""

    def __init__(self, words: dict[str, float], offensive: Iterable[str] = ()):
        self.words = words
        total = sum(words.values())
        self.word_cost = {w: float(-np.log(0.7 * n / total)) for w, n in words.items()}
        self.offensive = set(offensive)
        #: Words by length: the words, their letters, and costs for starred ones.
        self.by_length: dict[int, tuple] = {}
        for n in {len(w) for w in words}:
            own = [w for w in words if len(w) == n]
            cost = np.array([self.word_cost[w] - OFFENDS * (w in self.offensive) for w in own])
            self.by_length[n] = (own, np.array([[ord(c) for c in w] for w in own], np.uint8).reshape(len(own), n), cost)
        counts = np.zeros((_SIZE,) * 4)
        for w, n in words.items():
            codes = [0, 0, 0, *(ord(c) - 96 for c in w), 0]
            for k in range(3, len(codes)):
                counts[tuple(codes[k - 3 : k + 1])] += n
        # Witten and Bell: each context gives way by the kinds seen after it.
        model = np.full(_SIZE, 1 / _SIZE)
        for order in range(4):
            c = counts.sum(axis=tuple(range(3 - order))) if order < 3 else counts
            kinds = (c > 0).sum(axis=-1, keepdims=True) * 0.3
            model = (c + kinds * model) / np.maximum(c.sum(axis=-1, keepdims=True) + kinds, 1e-12) + (kinds == 0) * model
        self.cost = (-np.log(model.reshape(-1, _SIZE))).astype(np.float32)
        self._readings()

    def _readings(self) -> None:
        """For each ASCII character its readings: letters, or 0 for nothing."""
        read: list[list[tuple[int, float]]] = [[] for _ in range(128)]
        for c in map(chr, range(97, 123)):
            read[ord(c)] = [(ord(c) - 96, SAME)] + [(ord(x) - 96, LETTER) for x in ALSO.get(c, "")]
        for c, letters in STANDS_FOR.items():
            read[ord(c)] += [(ord(x) - 96, SIGN) for x in letters]
        for c in BETWEEN:
            read[ord(c)].append((0, GAP))
        self.few = self._table(read)
        #: What a character costs as it stands.
        self.stands = np.array([PLAIN_LETTER if chr(c).isalpha() else PLAIN_SIGN for c in range(128)], np.float32)
        self.repeats = np.array([chr(c).isalnum() or chr(c) in "@$!|" for c in range(128)])
        read[ord("*")] = [(0, 2.5)]
        for c in ANY:
            read[ord(c)] += [(x, WILD) for x in range(1, _SIZE)]
        self.many = self._table(read)

    @staticmethod
    def _table(read) -> tuple[np.ndarray, np.ndarray]:
        # One place more, for a repeat of the character before.
        width = max(map(len, read)) + 1
        letter, price = np.zeros((128, width), np.int32), np.full((128, width), np.inf, np.float32)
        for c, many in enumerate(read):
            for i, (x, cost) in enumerate(many, 1):
                letter[c, i], price[c, i] = x, cost
        return letter, price

    def as_it_stands(self, word: str) -> float:
        """The cost of a word of letters under the model."""
        codes = [0, 0, 0, *(ord(c) - 96 for c in word), 0]
        cost = sum(float(self.cost[(codes[k - 3] * _SIZE + codes[k - 2]) * _SIZE + codes[k - 1], codes[k]]) for k in range(3, len(codes)))
        return min(cost, self.word_cost.get(word, np.inf))

    def _search(self, tokens: list[str], table, keep: int, trace: bool = True):
        """Best paths of tokens sorted by falling length: costs, and with
        ``trace`` the letters read, as arrays (tokens, paths) and (tokens,
        paths, places)."""
        letter, price = table
        n, longest = len(tokens), len(tokens[0])
        codes = np.zeros((n, longest), np.int32)
        for k, t in enumerate(tokens):
            codes[k, : len(t)] = np.frombuffer(t.encode("ascii"), np.uint8)
        lengths = np.array([len(t) for t in tokens])
        cost = np.full((n, keep), np.inf, np.float32)
        cost[:, 0] = 0
        context = np.zeros((n, keep), np.int32)
        came, read = np.zeros((longest, n, keep), np.int16), np.zeros((longest, n, keep), np.int8)
        for i in range(longest):
            m = int(np.searchsorted(-lengths, -i, "left"))
            x, p = letter[codes[:m, i]], price[codes[:m, i]]
            if i:
                here = codes[:m, i]
                more = (codes[:m, i - 2] == here) & (i > 1)
                if i + 1 < longest:
                    more |= codes[:m, i + 1] == here
                p[:, 0] = np.where((here == codes[:m, i - 1]) & self.repeats[here], np.where(more, AGAIN, TWICE), np.inf)
            by_letter = self.cost[context[:m, :, None], x[:, None, :]]
            total = cost[:m, :, None] + p[:, None, :] + np.where(x[:, None, :] > 0, by_letter, 0)
            after = np.where(x[:, None, :] > 0, (context[:m, :, None] % 729) * _SIZE + x[:, None, :], context[:m, :, None])
            flat = total.reshape(m, -1)
            best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
            cost[:m] = np.take_along_axis(flat, best, 1)
            context[:m] = np.take_along_axis(after.reshape(m, -1), best, 1)
            came[i, :m] = best // x.shape[1]
            read[i, :m] = np.take_along_axis(x, best % x.shape[1], 1)
        if not trace:
            return cost, None
        cost = cost + self.cost[context, 0]
        out = np.zeros((n, keep, longest), np.int8)
        at = np.tile(np.arange(keep), (n, 1))
        for i in range(longest - 1, -1, -1):
            m = int(np.searchsorted(-lengths, -i, "left"))
            out[:m, :, i] = np.take_along_axis(read[i, :m], at[:m], 1)
            at[:m] = np.take_along_axis(came[i, :m].astype(np.int64), at[:m], 1)
        return cost, out

    def hopeless(self, tokens: list[str], probe: int = _PROBES[0], step: int = 8192) -> list[bool]:
        """Whether the first ``probe`` characters already rule out any likelier
        reading; of tokens of ASCII at least that long."""
        out: list[bool] = []
        for a in range(0, len(tokens), step):
            part = [t[:probe].lower() for t in tokens[a : a + step]]
            codes = np.frombuffer("".join(part).encode("ascii"), np.uint8).reshape(len(part), probe)
            out += (self._search(part, self.few, 3, False)[0].min(axis=1) >= self.stands[codes].sum(axis=1) + _HOPELESS).tolist()
        return out

    def decode(self, tokens: list[str], step: int = 4096) -> dict[str, tuple[str, float]]:
        """For tokens of ASCII letters (lower case), digits and signs: the
        likeliest intended word and its cost, where it is likelier than the
        token as it stands. Tokens may be of any length."""
        out: dict[str, tuple[str, float]] = {}
        starred = [t for t in tokens if _STARS.search(t)]
        # A word of letters that can only be read as itself needs no search.
        plain = [t for t in tokens if not _STARS.search(t) and (not t.isalpha() or _READINGS.search(t))]
        for probe in _PROBES:
            heads = sorted({t[:probe] for t in plain if len(t) > probe})
            hope = {h for h, lost in zip(heads, self.hopeless(heads, probe)) if not lost}
            plain = [t for t in plain if len(t) <= probe or t[:probe] in hope]
        for t in starred:
            found = self._starred(t)
            if found:
                out[t] = found
        for many, table, keep in ((plain, self.few, 5), ([t for t in starred if t not in out], self.many, 48)):
            many = sorted(many, key=len, reverse=True)
            a = 0
            while a < len(many):
                # Fewer long tokens at a time, so the arrays keep their size.
                b = a + max(1, min(step, step * 16 // max(len(many[a]), 1)) // (16 if keep > 6 else 1))
                part = many[a:b]
                cost, read = self._search(part, table, keep)
                hope = np.flatnonzero(cost.min(axis=1) < np.array([self.limit(t) for t in part]) + 8)
                for t, costs, paths in ((part[i], cost[i], read[i]) for i in hope):
                    found = self._best(t, costs, paths)
                    if found:
                        out[t] = found
                a = b
        return out

    def _starred(self, token: str) -> tuple[str, float] | None:
        """The likeliest word of as many letters, stars standing for any."""
        same = self.by_length.get(len(token))
        if same is None:
            return None
        words, letters, costs = same
        fits, price = np.ones(len(words), bool), 0.0
        for i, c in enumerate(token):
            if c in ANY:
                price += WILD
            else:
                stands = [c] if c.isalpha() else list(STANDS_FOR.get(c, ""))
                price += SAME if c.isalpha() else SIGN
                fits &= np.isin(letters[:, i], [ord(x) for x in stands])
        at = np.flatnonzero(fits)
        if not len(at) or sum(c.isalpha() for c in token) < 2:
            return None
        best = at[costs[at].argmin()]
        return (words[best], float(costs[best] + price)) if costs[best] + price < self.plain_cost(token) + 2 else None

    @staticmethod
    def plain_cost(token: str) -> float:
        letters = sum(map(str.isalpha, token))
        return PLAIN_LETTER * letters + PLAIN_SIGN * (len(token) - letters)

    def limit(self, token: str) -> float:
        """What the token costs as it stands."""
        return self.as_it_stands(token) if token.isalpha() else self.plain_cost(token)

    def _best(self, token: str, costs, paths) -> tuple[str, float] | None:
        limit, spelt = self.limit(token), token.isalpha()
        starred = _STARS.search(token) is not None
        best = None
        for k in np.argsort(costs):
            if not np.isfinite(costs[k]):
                break
            letters = paths[k][paths[k] > 0]
            word = (letters + 96).tobytes().decode("ascii")
            if len(word) < 2 or (spelt and word not in self.word_cost):
                continue
            # The path's cost less what its letters cost, plus the word's own.
            cost = float(costs[k])
            if word in self.word_cost:
                cost += self.word_cost[word] - self._letters(word)
                if starred:
                    cost -= OFFENDS if word in self.offensive else 0.0
            if best is None or cost < best[1]:
                best = (word, cost)
        if best is None or best[1] >= limit or best[0] == token:
            return None
        # Stars alone say little: two letters at least must be left.
        known = sum(c.isalpha() or c in STANDS_FOR for c in token if c not in ANY)
        return best if known >= 2 else None

    def _letters(self, word: str) -> float:
        codes = [0, 0, 0, *(ord(c) - 96 for c in word), 0]
        return sum(float(self.cost[(codes[k - 3] * _SIZE + codes[k - 2]) * _SIZE + codes[k - 1], codes[k]]) for k in range(3, len(codes)))

    def words_in(self, letters: str) -> list[str] | None:
        """Letters run together as words of the vocabulary, where that is
        likelier than one word of these letters; None where it is not."""
        cost, cut = [0.0] + [np.inf] * len(letters), [0] * (len(letters) + 1)
        for b in range(1, len(letters) + 1):
            for a in range(max(0, b - 24), b):
                c = cost[a] + self.word_cost.get(letters[a:b], np.inf)
                if c < cost[b]:
                    cost[b], cut[b] = c, a
        if cost[-1] >= self.as_it_stands(letters) + 2:
            return None
        out, b = [], len(letters)
        while b:
            out.append(letters[cut[b] : b])
            b = cut[b]
        return out[::-1] if len(out) > 1 else None


# Letters of other scripts that look like Latin ones.
ALIKE = str.maketrans("аеорсхуікнмтвѕјԁαοερικνυτßł", "aeopcxyikhmtbsjdaoepikvutbl")
_HIDDEN = re.compile("[​-‏⁠­﻿؜᠎]")


def latin(token: str) -> str:
    """Folded, without hidden characters, look-alikes beside Latin letters as
    these."""
    word = fold(_HIDDEN.sub("", token)).replace("’", "'").replace("·", ".").replace("•", ".")
    if not word.isascii() and any("a" <= c <= "z" for c in word):
        word = word.translate(ALIKE)
    return word
