"""Vectorised pre-tokenisation without regex.

Codepoints become classes by one table lookup; each class (with one or two codepoints of
lookahead folded in) is a transition function on a few states. Function composition is
associative, so states come from a blocked scan: compose within blocks of ``BLOCK`` side by
side, chain the blocks' functions, then replay each block from its entry state. A boundary is a
property of (state before, class), looked up at the end.

The pieces are those of the pattern ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np

BLOCK = 64

# Classes of a codepoint in its place.
LETTER, NUMBER, OTHER, SPACE_IN, BLANK_LAST, SPACE_LAST, QUOTE1, QUOTE2, BREAK = range(9)
# States: what the piece that is open after a codepoint is.
IN_LETTERS, IN_NUMBERS, IN_OTHER, IN_SPACE, AFTER_BLANK, CLOSED, SUFFIX1, SUFFIX2 = range(8)
K = 8

# The codepoints with the White_Space property.
_WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@cache
def _classes() -> np.ndarray:
    """LETTER, NUMBER, OTHER or SPACE_IN for each codepoint, by Unicode's general category."""
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    out[_WHITE] = SPACE_IN
    return out


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """step[class, state] -> state after, cut[class, state] -> whether a piece begins here."""
    step, cut = np.zeros((9, K), np.uint8), np.zeros((9, K), bool)
    runs = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHER}
    for s in range(K):
        for c in range(9):
            if s == SUFFIX2 and c != BREAK:  # two letters of a contraction to come
                step[c, s] = SUFFIX1
            elif s == SUFFIX1 and c != BREAK:
                step[c, s] = CLOSED
            elif c in runs:
                step[c, s], cut[c, s] = runs[c], s not in (runs[c], AFTER_BLANK)
            elif c == SPACE_IN:
                step[c, s], cut[c, s] = IN_SPACE, s != IN_SPACE
            elif c == BLANK_LAST:
                step[c, s], cut[c, s] = AFTER_BLANK, True
            elif c in (SPACE_LAST, BREAK):
                step[c, s], cut[c, s] = CLOSED, True
            elif s in (IN_OTHER, AFTER_BLANK):  # a quote within a run, or after a blank, is like any other
                step[c, s] = IN_OTHER
            else:
                step[c, s], cut[c, s] = (SUFFIX1 if c == QUOTE1 else SUFFIX2), True
    return step, cut


_STEP, _CUT = _tables()
_STEP_FLAT = _STEP.ravel()


def _in_place(points: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """The class of each codepoint with lookahead: the last of a white-space run, quotes before suffixes."""
    cls = _classes()[points]
    cls[breaks] = BREAK
    space = cls == SPACE_IN
    ends = np.ones(len(cls), bool)  # before the end of a text counts as within the run
    ends[:-1] = space[1:] | (cls[1:] == BREAK)
    last = space & ~ends
    cls[last] = np.where(points[last] == 0x20, BLANK_LAST, SPACE_LAST)
    quotes = np.flatnonzero((points == 0x27) & (cls == OTHER))
    if len(quotes):
        padded = np.concatenate([points, np.zeros(2, points.dtype)])
        a, b = padded[quotes + 1], padded[quotes + 2]
        one = np.isin(a, [ord(x) for x in "stmd"])
        two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        cls[quotes[one]] = QUOTE1
        cls[quotes[two]] = QUOTE2
    return cls


def _states(cls: np.ndarray) -> np.ndarray:
    """The state before each codepoint, by the blocked scan; the first is CLOSED."""
    n = len(cls)
    rows = -(-n // BLOCK)
    grid = np.full(rows * BLOCK, BREAK, np.uint8)
    grid[:n] = cls
    base = np.ascontiguousarray(grid.reshape(rows, BLOCK).T) * np.uint8(K)  # step by step, all blocks side by side
    whole = np.tile(np.arange(K, dtype=np.uint8), (rows, 1))
    for j in range(BLOCK):
        whole = np.take(_STEP_FLAT, base[j][:, None] + whole)
    entry = np.empty(rows, np.uint8)
    state = CLOSED
    for r, f in enumerate(whole.tolist()):
        entry[r] = state
        state = f[state]
    before = np.empty((BLOCK, rows), np.uint8)
    for j in range(BLOCK):
        before[j] = entry
        entry = np.take(_STEP_FLAT, base[j] + entry)
    return before.T.ravel()[:n]


def pieces(texts: list[str]) -> list[tuple[list[str], np.ndarray]]:
    """For each text its pieces in order, and their first codepoints' places."""
    whole = "\0".join(texts)
    points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]).astype(np.int64)
    if not len(points):
        return [([], np.empty(0, np.int64)) for _ in texts]
    cls = _in_place(points, begins[1:] - 1)
    starts = np.flatnonzero(_CUT.ravel()[cls * np.uint8(K) + _states(cls)])
    cuts = starts.tolist()
    at = np.searchsorted(starts, begins).tolist()
    last = np.searchsorted(starts, begins + lengths).tolist()
    out = []
    for k, (i, j) in enumerate(zip(at, last)):
        stop = int(begins[k] + lengths[k])
        own = cuts[i:j]
        out.append(([whole[a:b] for a, b in zip(own, [*own[1:], stop])], starts[i:j] - begins[k]))
    return out
