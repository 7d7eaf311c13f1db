"""Local alignment of anchor spans to a template, a batch at a time.

Smith-Waterman with affine gaps. All pairs of a batch move through the table
together, a diagonal at a step, and walk back together too. Among
equal scores the walk prefers the diagonal, then a gap in the template, then one
in the span, a longer gap before a new one, and starts at the earliest best cell.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

# Scores of the alphabet ACGTN and anything else.
MATCH, MISMATCH, WITH_N, GAP_OPEN, GAP_MORE = 5, -1, 4, 2, 1
_LETTERS = "ACGTN"


def score_matrix() -> np.ndarray:
    """6 x 6: equal letters match, N meets A, C, G and T almost as well."""
    out = np.full((6, 6), MISMATCH, np.int32)
    np.fill_diagonal(out, MATCH)
    out[4, :4] = out[:4, 4] = WITH_N
    out[5, :] = out[:, 5] = 0
    return out


_CODES = np.full(256, 5, np.uint8)
for _i, _c in enumerate(_LETTERS):
    _CODES[ord(_c)] = _CODES[ord(_c.lower())] = _i


def encode(text: str) -> np.ndarray:
    return _CODES[np.frombuffer(text.encode("ascii", "replace"), np.uint8)]


@dataclass(frozen=True)
class Paths:
    """The best local alignments of a batch, by pair and column.

    ``span`` and ``template`` hold the index of the letter that stands in a
    column, -1 for a gap. Alignments end in the last column; columns before
    their first are -1 in both. ``start`` is where in the span each begins.
    """

    span: np.ndarray
    template: np.ndarray
    start: np.ndarray
    score: np.ndarray


_ZERO, _DIAGONAL, _REF_GAP, _QUERY_GAP = 0, 1, 2, 3


def align(spans: list[str], template: str) -> Paths:
    """Each span's best local alignment to ``template``."""
    many, n, m = len(spans), max(map(len, spans), default=0), len(template)
    if not n or not m:
        return Paths(*[np.full((many, 1), -1, np.int32)] * 2, *[np.zeros(many, np.int32)] * 2)
    codes = np.full((n, many), 5, np.uint8)
    for k, s in enumerate(spans):
        codes[: len(s), k] = encode(s)
    cost, ref, lengths = score_matrix(), encode(template), np.array([len(s) for s in spans])
    low, j = -(1 << 20), np.arange(1, m + 1)
    # By diagonal: row j of an array is the cell (d - j, j).
    came = np.zeros((n + m + 1, m + 1, many), np.uint8)
    more_ref, more_query = np.zeros((2, *came.shape), bool)
    before, last, zero = np.zeros((3, m + 1, many), np.int32)
    ref_gap, query_gap = np.full((2, m + 1, many), low, np.int32)
    best, order = np.zeros(many, np.int64), (n + 1) * (m + 1)
    for d in range(2, n + m + 1):
        i = d - j
        inside = ((i >= 1) & (i <= n))[:, None]
        opened, longer = last[1:] - GAP_OPEN, ref_gap[1:] - GAP_MORE
        more_ref[d, 1:] = longer >= opened
        above = np.maximum(opened, longer)
        opened, longer = last[:-1] - GAP_OPEN, query_gap[:-1] - GAP_MORE
        more_query[d, 1:] = longer >= opened
        left = np.maximum(opened, longer)
        diagonal = before[:-1] + cost[codes[np.clip(i - 1, 0, n - 1)], ref[:, None]]
        top = np.maximum(np.maximum(diagonal, above), np.maximum(left, 0))
        came[d, 1:] = np.where(~inside | (top <= 0), _ZERO, np.where(top == diagonal, _DIAGONAL, np.where(top == above, _REF_GAP, _QUERY_GAP)))
        before, last = last, zero.copy()
        last[1:] = np.where(inside, top, 0)
        ref_gap[1:], query_gap[1:] = np.where(inside, above, low), np.where(inside, left, low)
        # The best score first, then the earliest row, then the earliest column.
        rank = top.astype(np.int64) * order - (i * (m + 1) + j)[:, None]
        np.maximum(best, np.where(inside & (top > 0) & (i[:, None] <= lengths), rank, 0).max(axis=0), out=best)
    score = -(-best // order)
    i, j = np.divmod(score * order - best, m + 1)
    return _walk(came, more_ref, more_query, i, j, score)


def _walk(came, more_ref, more_query, i, j, score) -> Paths:
    many, at, column = len(i), np.arange(len(i)), came.shape[0]
    span, template = np.full((2, many, column), -1, np.int32)
    # A gap is walked to its own end, whatever the cells along it prefer.
    within = np.zeros(many, np.uint8)
    while (move := np.where(within > 0, within, came[i + j, j, at])).any():
        column -= 1
        longer = np.where(move == _REF_GAP, more_ref[i + j, j, at], (move == _QUERY_GAP) & more_query[i + j, j, at])
        within = np.where(longer, move, 0)
        by_span, by_template = (move == _DIAGONAL) | (move == _REF_GAP), (move == _DIAGONAL) | (move == _QUERY_GAP)
        i, j = i - by_span, j - by_template
        span[:, column], template[:, column] = np.where(by_span, i, -1), np.where(by_template, j, -1)
    return Paths(span[:, column:], template[:, column:], i, score)
