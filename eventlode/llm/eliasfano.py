"""Elias-Fano coded increasing sequences as numpy arrays, and files of named arrays that can be memory-mapped."""

from __future__ import annotations

import json

import numpy as np

from eventlode.llm.files import opened

_ONE = np.uint64(1)


def _packed(bits: np.ndarray) -> np.ndarray:
    """Bits, lowest first, as 64-bit words, and one word more."""
    raw = np.packbits(bits, bitorder="little")
    return np.concatenate([raw, np.zeros(16 - len(raw) % 8, np.uint8)]).view(np.uint64)


class EliasFano:
    """A strictly or weakly increasing sequence of whole numbers below 2**64.

    The low bits stand side by side; the high parts are unary in a bit vector, with the zeros before
    each of its words counted, so the elements that share a high part are found by two selections, and the one sought by halving.
    """

    def __init__(self, arrays: dict[str, np.ndarray], prefix: str = ""):
        self.low, self.high, self.zeros = (arrays[prefix + k] for k in ("low", "high", "zeros"))
        self.n, self.bits, self.top = (int(x) for x in arrays[prefix + "meta"])
        self.ones = np.arange(len(self.zeros), dtype=np.int64) * 64 - self.zeros

    @staticmethod
    def encode(values: np.ndarray, prefix: str = "") -> dict[str, np.ndarray]:
        v = values.astype(np.uint64)
        n = len(v)
        last = int(v[-1]) if n else 0
        bits = max(0, (last // max(n, 1)).bit_length() - 1) if n else 0
        low = np.zeros(2, np.uint64)
        if bits and n:
            rows = ((v[:, None] >> np.arange(bits, dtype=np.uint64)) & _ONE).astype(bool) if n * bits < 1 << 22 else None
            if rows is None:
                rows = np.empty((n, bits), bool)
                for j in range(bits):
                    rows[:, j] = (v >> np.uint64(j)) & _ONE
            low = _packed(rows.ravel())
        high = np.zeros(n + (last >> bits) + 2, bool)
        if n:
            high[(v >> np.uint64(bits)).astype(np.int64) + np.arange(n)] = True
        words = _packed(high)
        zeros = np.concatenate([[0], np.cumsum(64 - np.bitwise_count(words).astype(np.int64))[:-1]]).astype(np.int64)
        return {prefix + "low": low, prefix + "high": words, prefix + "zeros": zeros, prefix + "meta": np.asarray([n, bits, last >> bits], np.uint64)}

    def _select0(self, k: np.ndarray) -> np.ndarray:
        """Places of the k-th zeros of the bit vector."""
        at = np.searchsorted(self.zeros, k, side="right") - 1
        return (at << 6) + _select(~self.high[at], (k - self.zeros[at]).astype(np.uint8))

    def _lows(self, i: np.ndarray) -> np.ndarray:
        at = i * self.bits
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        both = (self.low[word] >> shift) | ((self.low[word + 1] << _ONE) << (np.uint64(63) - shift))
        return both & np.uint64((1 << self.bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The elements at the places i."""
        at = np.searchsorted(self.ones, i, side="right") - 1
        place = (at << 6) + _select(self.high[at], (i - self.ones[at]).astype(np.uint8))
        high = (place - i).astype(np.uint64) << np.uint64(self.bits)
        return high | self._lows(i) if self.bits else high

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places of keys, or -1: successor search among the elements that share the key's high part."""
        out = np.full(len(keys), -1, np.int64)
        if not self.n or not len(keys):
            return out
        high = keys >> np.uint64(self.bits)
        open_ = np.flatnonzero(high <= np.uint64(self.top))
        h = high[open_].astype(np.int64)
        first = np.where(h > 0, self._select0(np.maximum(h - 1, 0)) + 1, 0) - h
        last = self._select0(h) - h
        low = keys[open_] & np.uint64((1 << self.bits) - 1) if self.bits else np.zeros(len(open_), np.uint64)
        while True:
            more = first < last
            open_, first, last, low = open_[more], first[more], last[more], low[more]
            if not len(open_):
                return out
            middle = (first + last) >> 1  # dense contexts share a high part, so the search within it halves
            have = self._lows(middle) if self.bits else np.zeros(len(first), np.uint64)
            hit = have == low
            out[open_[hit]] = middle[hit]
            up = have < low
            first, last = np.where(up, middle + 1, first), np.where(up, last, middle)
            open_, first, last, low = open_[~hit], first[~hit], last[~hit], low[~hit]


def _select(words: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th set bit of each word."""
    place = np.zeros(len(words), np.int64)
    for width in (32, 16, 8, 4, 2, 1):
        n = np.bitwise_count(words & np.uint64((1 << width) - 1))
        go = k >= n
        k = np.where(go, k - n, k)
        words = np.where(go, words >> np.uint64(width), words)
        place += go * width
    return place


def save(uri: str, arrays: dict[str, np.ndarray]) -> None:
    files, path = opened(uri)
    files.create_dir(path.rsplit("/", 1)[0], recursive=True)
    at, where = 0, {}
    for name, a in arrays.items():
        where[name] = [a.dtype.str, at, len(a)]
        at += -(-a.nbytes // 8) * 8
    head = json.dumps(where).encode()
    head += b" " * (-(len(head) + 8) % 8)
    with files.open_output_stream(path) as out:
        out.write(len(head).to_bytes(8, "little") + head)
        for a in arrays.values():
            out.write(a.tobytes())
            out.write(b"\0" * (-a.nbytes % 8))


def load(uri: str) -> dict[str, np.ndarray]:
    """Memory-mapped where the file is local or on a mounted share, else read once."""
    files, path = opened(uri)
    if files.type_name == "local":
        raw = np.memmap(path, np.uint8, "r").view(np.ndarray)
    else:
        with files.open_input_stream(path) as f:
            raw = np.frombuffer(f.read(), np.uint8)
    size = int.from_bytes(raw[:8].tobytes(), "little")
    start = 8 + size
    return {name: raw[start + at : start + at + n * np.dtype(kind).itemsize].view(kind) for name, (kind, at, n) in json.loads(raw[8:start].tobytes()).items()}
