"""64-bit hashes of the words of many texts at once, as numpy arrays."""

from __future__ import annotations

import re

import numpy as np

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes that end a word: space and the controls from tab to carriage return.
SEPARATES = np.zeros(256, bool)
SEPARATES[[0x20, *range(0x09, 0x0E)]] = True
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Bytes hashed in one step; a longer text is hashed in pieces that end between words, and only a longer word is taken whole.
STEP = 1 << 20
_GAP = re.compile(rb"[\x20\x09-\x0D]")

_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(1 << n.bit_length(), STEP)
        for name, base in (("up", BASE), ("down", INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A finalizer that spreads every bit; wraps modulo 2**64."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the number of words of each text. Equal words have equal hashes."""
    if sum(map(len, texts)) > 4 * STEP:
        parts = [(i, p) for i, t in enumerate(texts) for p in _pieces(t)]
        done = [(i, *_word_hashes([p])) for i, p in parts]
        counts = np.zeros(len(texts), np.int64)
        np.add.at(counts, [i for i, _, _ in done], [int(n[0]) for _, _, n in done])
        return np.concatenate([h for _, h, _ in done]), counts
    return _word_hashes(texts)


def _pieces(text: bytes):
    at = 0
    while len(text) - at > STEP and (gap := _GAP.search(text, at + STEP)):
        yield text[at : gap.start()]
        at = gap.end()
    yield text[at:]


def _word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    gap = SEPARATES[data]
    edges = np.flatnonzero(np.diff(np.concatenate([[True], gap]).astype(np.int8)))
    starts, ends = edges[0::2], edges[1::2]
    up, down = _powers(len(data))
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    bounds = np.cumsum([len(t) + 1 for t in texts])
    upto = np.searchsorted(starts, bounds)
    return mixed(h + (ends - starts).astype(np.uint64)), np.diff(np.concatenate([[0], upto]))


def stepped(texts: list[bytes], step: int = STEP):
    """Slices of a list of texts, of about `step` bytes each."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) + 1
        if size >= step:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def runs(data: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the runs of bytes that are no gap; the last byte has to be one. Equal runs have equal hashes."""
    edges = np.flatnonzero(np.diff(np.concatenate([[True], gap]).astype(np.int8)))
    starts, ends = edges[0::2], edges[1::2]
    up, down = _powers(len(data))
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
    return starts, ends, mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
