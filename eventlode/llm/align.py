"""Alignment of two tokenizers: where tokens of both end together, and which tokens meet there.

A text has two ascending lists of byte offsets, the ends of its tokens by a byte-level vocabulary (A) and by a piece vocabulary
(B, which puts a space before the text; A gets one too). The shorter list drives an exponential and then binary search
into the longer one, from where the last search ended. The common ends cut both lists into groups, and
differences of their places give the range of tokens that a group has on either side. Tokens that end together are linked.

Both vocabularies cut any text before a space or line end that follows other characters, so what lies between is looked up:
each worker aligns a stretch when it first meets it, many in step, and remembers its groups and links. Vocabularies
that might join tokens across such places are found out when they are loaded, and get whole texts.

Links that meet in a pair of ids are counted corpus-wide. A pair's bytes are equal or one ends in the other, so there are at
most as many different pairs as both vocabularies have bytes (some 600,000), whatever the corpus: their counts are broadcast.

Defined results: texts that are null or empty, or that a vocabulary does not give back byte by byte, have no tokens:
all counts 0 and an empty digest. Repeated rows count again; a null id is kept; texts of any length are
taken whole, in blocks; an empty table gives an empty result; columns other than the named ones are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlode.llm.common import new_shared_path, sliced
from eventlode.llm.packing import BYTE_LEVEL, cuts_at_spaces

#: Stretches of a generation, of which a worker remembers two, some 80 MB; none of more characters than LONG are. Characters aligned at once.
REMEMBERED, LONG, BLOCK = 150_000, 64, 1 << 19
#: Stretches that B encodes together.
TOGETHER = 256
SPACE_MARK = "▁"
#: Spaces and what follows up to the next ones; marks behind letters and digits stand apart where B has no piece of both.
_RUN = re.compile(r"[ \n]+[^ \n]*")
_MARKED = re.compile(r"[ \n]+(?:[0-9A-Za-zÀ-ÖØ-öø-ɏ]++(?=[.,;:!?])|[^ \n]*)|[.,;:!?][^ \n]*")
_MIXED = re.compile(r"[0-9A-Za-zÀ-ÖØ-öø-ɏ][.,;:!?]")
_ODD = re.compile(r"[^\S \n]")
_SAFE = re.compile(r"(?<=[\w!-~])(?=[ \n])")
FIRST = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes array<long>, times array<long>"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def gallop(driver: np.ndarray, d: np.ndarray, other: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of equal values in ascending stretches of two arrays: stretch i is d[i]:d[i + 1] of the driver and o[i]:o[i + 1] of the other.

    All stretches go in step. A value is searched from where the stretch's last search ended, in doubling steps, and
    then by halving the last step.
    """
    at, until = o[:-1].copy(), o[1:]
    lanes, k = np.flatnonzero(d[:-1] < d[1:]), 0
    mine, theirs = [], []
    while len(lanes):
        want, low, end, step = driver[d[lanes] + k], at[lanes], until[lanes], 1
        high = low.copy()
        on = np.flatnonzero(low < end)
        while len(on := on[other[high[on]] < want[on]]):
            low[on] = high[on] + 1
            high[on] = np.minimum(high[on] + step, end[on])
            step *= 2
            on = on[high[on] < end[on]]
        while len(on := np.flatnonzero(low < high)):
            mid = (low[on] + high[on]) // 2
            less = other[mid] < want[on]
            low[on[less]], high[on[~less]] = mid[less] + 1, mid[~less]
        at[lanes] = low
        hit = np.flatnonzero(low < end)
        hit = hit[other[low[hit]] == want[hit]]
        mine.append(d[lanes[hit]] + k)
        theirs.append(low[hit])
        k += 1
        lanes = lanes[d[lanes] + k < d[lanes + 1]]
    if not mine:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    mine, theirs = np.concatenate(mine), np.concatenate(theirs)
    order = np.argsort(mine, kind="stable")
    return mine[order], theirs[order]


def common_ends(ends_a: np.ndarray, cuts_a: np.ndarray, ends_b: np.ndarray, cuts_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in A's and B's lists of the ends that both have, stretch by stretch; the shorter list of a stretch drives."""
    shorter = np.diff(cuts_a) <= np.diff(cuts_b)
    found = []
    for own in (shorter, ~shorter):
        starts_a, starts_b = cuts_a.copy(), cuts_b.copy()
        # a stretch that the other side drives is empty here
        d, o = (starts_a, starts_b) if own is shorter else (starts_b, starts_a)
        keep = np.flatnonzero(own)
        lanes_d, lanes_o = _stretches(d, keep), _stretches(o, keep)
        source_d, source_o = (ends_a, ends_b) if own is shorter else (ends_b, ends_a)
        i, j = gallop(source_d[lanes_d[1]], lanes_d[0], source_o[lanes_o[1]], lanes_o[0])
        i, j = lanes_d[1][i], lanes_o[1][j]
        found.append((i, j) if own is shorter else (j, i))
    a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(a, kind="stable")
    return a[order], b[order]


def _stretches(cuts: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """New cuts of the kept stretches, and the places of their members."""
    n = (cuts[1:] - cuts[:-1])[keep]
    new = np.concatenate([[0], np.cumsum(n)])
    return new, np.repeat(cuts[:-1][keep] - new[:-1], n) + np.arange(new[-1])


class Pair:
    """Both vocabularies, with the bytes of every token."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        of_char = {c: i for i, c in BYTE_LEVEL.items()}
        own = self.a.get_vocab(with_added_tokens=False)
        self.bytes_a = [b""] * (max(self.a.get_vocab().values()) + 1)
        for token, i in own.items():
            self.bytes_a[i] = bytes(of_char[c] for c in token) if all(c in of_char for c in token) else token.encode()
        b, self.bytes_b = self.b, []
        for i in range(b.get_piece_size()):
            piece = b.id_to_piece(i)
            plain = not (b.is_control(i) or b.is_unknown(i) or b.is_unused(i))
            self.bytes_b.append(bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace(SPACE_MARK, " ").encode() if plain else b"")
        pieces = [b.id_to_piece(i) for i in range(b.get_piece_size()) if not b.is_byte(i)]
        self.by_stretch = cuts_at_spaces(self.a) and not any("\n" in p or SPACE_MARK in p.lstrip(SPACE_MARK) for p in pieces)
        self.run = _RUN if any(map(_MIXED.search, pieces)) else _MARKED
        self.a.encode_special_tokens = True
        self.lead = self.b.encode("a")
        self.size_a, self.size_b = (np.asarray([len(x) for x in y], np.int64) for y in (self.bytes_a, self.bytes_b))
        self.names_a, self.names_b = [str(i) for i in range(len(self.bytes_a))], [str(i) for i in range(len(self.bytes_b))]

    def most_pairs(self) -> int:
        """How many different pairs of ids can end together, at most."""
        return int(self.size_a.sum() + self.size_b.sum())

    def ids(self, text: str) -> tuple[list[int], list[int]] | None:
        """Ids of a text or stretch by both; None if either does not give its bytes back."""
        return self._ids(text, [text])

    def _ids(self, text: str, parts: list[str]) -> tuple[list[int], list[int]] | None:
        """The same, where the parts of the text are cut where both vocabularies cut: B is faster with short texts.

        B would add a space, so it gets a part behind a letter, which is cut off again, and a whole text without its first space.
        """
        raw = text.encode()
        ids_a = self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids
        if b"".join(map(self.bytes_a.__getitem__, ids_a)) != raw:
            return None
        if self.by_stretch:
            lead = len(self.lead)
            ids_b = [i for found in self.b.encode(["a" + p for p in parts], num_threads=1) for i in found[lead:]]
        else:
            ids_b = self.b.encode(text[1:])
        return None if b"".join(map(self.bytes_b.__getitem__, ids_b)) != raw else (ids_a, ids_b)

    def stretches(self, text: str) -> list[str]:
        """The text, which begins with a space, cut where both vocabularies cut."""
        if not self.by_stretch:
            return [text]
        return _SAFE.split(text) if _ODD.search(text) else self.run.findall(text)

    def blocks(self, text: str) -> Iterator[str]:
        """A long text in blocks that end where both vocabularies cut."""
        at = 0
        while self.by_stretch and len(text) - at > BLOCK and (cut := _SAFE.search(text, at + BLOCK)):
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:]

    def aligned(self, texts: list[str]) -> tuple[list[str], list[bytes | None]]:
        """Of stretches: their groups, and a negative number that holds how many A and B tokens they have, before the codes of their links. None where bytes differ."""
        joined = [i for i, t in enumerate(texts) if self.by_stretch and t[0] in " \n" and not t[-1].isspace()]
        groups, codes = [""] * len(texts), [None] * len(texts)
        parts = [" a", *["".join([texts[i] for i in joined[at : at + TOGETHER]]) for at in range(0, len(joined), TOGETHER)]]
        whole = self._ids("".join(parts), parts) if joined else None
        if whole:
            edges = np.cumsum([2, *[len(texts[i].encode()) for i in joined]])
            found = self._groups(*whole, edges)
            for i, group, link in zip(joined, found[0][1:], found[1][1:], strict=True):
                groups[i], codes[i] = group, link
        done = set(joined) if whole else set()
        for i, text in enumerate(texts):
            if i not in done and (own := self.ids(text)):
                (groups[i],), (codes[i],) = self._groups(*own, np.asarray([len(text.encode())]))
        return groups, codes

    def _groups(self, ids_a: list[int], ids_b: list[int], edges: np.ndarray) -> tuple[list[str], list[bytes]]:
        a, b = np.asarray(ids_a, np.int64), np.asarray(ids_b, np.int64)
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        cuts_a, cuts_b = (np.concatenate([[0], np.searchsorted(e, edges, side="right")]) for e in (ends_a, ends_b))
        at_a, at_b = common_ends(ends_a, cuts_a, ends_b, cuts_b)
        upto = np.searchsorted(at_a, cuts_a)
        rows = np.insert(a[at_a] * len(self.bytes_b) + b[at_b], upto[:-1], -(np.diff(cuts_a) << 32 | np.diff(cuts_b)))
        raw, places = rows.astype("<i8").tobytes(), ((upto + np.arange(len(upto))) * 8).tolist()
        names_a, names_b = list(map(self.names_a.__getitem__, ids_a)), list(map(self.names_b.__getitem__, ids_b))
        single = (np.diff(at_a, prepend=-1) == 1) & (np.diff(at_b, prepend=-1) == 1)
        parts, from_a, from_b = [], 0, 0
        for i, j, one in zip(at_a.tolist(), at_b.tolist(), single.tolist(), strict=True):
            parts.append(f"{names_a[i]}|{names_b[j]}" if one else f"{','.join(names_a[from_a : i + 1])}|{','.join(names_b[from_b : j + 1])}")
            from_a, from_b = i + 1, j + 1
        return [";".join(parts[p:q]) for p, q in pairwise(upto.tolist())], [raw[p:q] for p, q in pairwise(places)]

    def ranges(self, text: str) -> np.ndarray:
        """Rows a_from, a_to, b_from, b_to, end of a whole text's groups (places of tokens, exclusive; bytes of space and text)."""
        found = self.ids(" " + text) if text else None
        if not found:
            return np.zeros((0, 5), np.int64)
        ends_a, ends_b = np.cumsum(self.size_a[found[0]]), np.cumsum(self.size_b[found[1]])
        i, j = common_ends(ends_a, np.asarray([0, len(ends_a)]), ends_b, np.asarray([0, len(ends_b)]))
        return np.stack([np.concatenate([[0], i[:-1] + 1]), i + 1, np.concatenate([[0], j[:-1] + 1]), j + 1, ends_a[i]], axis=1)


class Aligner:
    """Aligns texts by their stretches, which it remembers."""

    def __init__(self, pair: Pair):
        self.pair, self.long = pair, []
        self.number: dict[str, int] = {}
        self._forget()

    def _forget(self) -> None:
        """Starts a new generation. What is met again is taken over from the one before."""
        self.old = (self.number, self.groups, self.codes) if self.number else ({}, [], [])
        self.number, self.groups, self.codes, self.bad = {}, [], [], set()

    def _keep(self, texts: list[str], groups: list[str], codes: list[bytes | None]) -> None:
        """codes is None where a vocabulary does not give the stretch back."""
        n = len(self.groups)
        if None in codes:
            self.bad.update(n + i for i, c in enumerate(codes) if c is None)
        self.number.update(zip(texts, range(n, n + len(texts)), strict=True))
        self.groups += groups
        self.codes += codes

    def _learn(self, stretches: list[list[str]]) -> None:
        if len(self.number) > REMEMBERED:
            self._forget()
        new = set().union(*stretches).difference(self.number)
        number, groups, codes = self.old
        again = [t for t in new if t in number]
        places = [number[t] for t in again]
        self._keep(again, [groups[i] for i in places], [codes[i] for i in places])
        new = list(new.difference(number))
        self._keep(new, *self.pair.aligned(new))
        self.long = [t for t in new if len(t) > LONG]

    def batch(self, texts: list[str | None]) -> list[tuple]:
        """n_a, n_b, n_links, digest, codes (ascending), how often each."""
        rows, held, size = [_Row() for _ in texts], [], 0
        for row, text in zip(rows, texts, strict=True):
            if not text or SPACE_MARK in text:
                row.bad = True
                continue
            for block in self.pair.blocks(" " + text):
                held.append((row, block))
                size += len(block)
                if size >= BLOCK:
                    self._add(held)
                    held, size = [], 0
        self._add(held)
        return [r.result() for r in rows]

    def _add(self, held: list[tuple[_Row, str]]) -> None:
        cut = [self.pair.stretches(block) for _, block in held]
        self._learn(cut)
        for (row, _), own in zip(held, cut, strict=True):
            numbers = list(map(self.number.__getitem__, own))
            if self.bad and not self.bad.isdisjoint(numbers):
                row.bad = True
            if row.bad:
                continue
            if row.links:
                row.digest.update(b";")
            row.digest.update(";".join(map(self.groups.__getitem__, numbers)).encode())
            rows = np.frombuffer(b"".join(map(self.codes.__getitem__, numbers)), "<i8")
            counts = -rows[rows < 0]
            codes = rows[rows >= 0]
            row.n_a += int((counts >> 32).sum())
            row.n_b += int((counts & 0xFFFFFFFF).sum())
            row.links += len(codes)
            row.parts.append(np.unique(codes, return_counts=True))
            if len(row.parts) > 16:
                row.parts = [_summed(row.parts)]
        for text in self.long:
            i = self.number.pop(text)
            self.groups[i], self.codes[i] = "", b""
        self.long = []


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(parts) == 1:
        return parts[0]
    codes, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return codes, np.bincount(inverse, np.concatenate([p[1] for p in parts])).astype(np.int64)


class _Row:
    """What is known of a text so far."""

    __slots__ = ("bad", "digest", "links", "n_a", "n_b", "parts")

    def __init__(self):
        self.n_a = self.n_b = self.links = 0
        self.digest, self.parts, self.bad = hashlib.sha256(), [], False

    def result(self) -> tuple:
        none = np.zeros(0, np.int64)
        if self.bad or not self.links:
            return 0, 0, 0, "", none, none
        return self.n_a, self.n_b, self.links, self.digest.hexdigest(), *_summed(self.parts)


_PAIRS: dict[tuple[str, str], Pair] = {}


def pair_of(path_a: str, path_b: str) -> Pair:
    if (path_a, path_b) not in _PAIRS:
        _PAIRS[path_a, path_b] = Pair(path_a, path_b)
    return _PAIRS[path_a, path_b]


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64), pa.int64()))


def _align(path_a: str, path_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(pair_of(path_a, path_b))
        for batch in sliced(batches, 4 << 20):
            n_a, n_b, links, digest, codes, times = zip(*aligner.batch(batch.column(1).to_pylist()), strict=True)
            columns = [batch.column(0), *[pa.array(x, pa.int64()) for x in (n_a, n_b, links, links)], pa.array(digest, pa.string()), _lists(codes), _lists(times)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "codes", "times"])

    return run


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links per code, summed over a task; there are no more codes than both vocabularies have bytes."""
    held = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    for batch in sliced(batches, 16 << 20):
        codes, times = (batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in (0, 1))
        held = _summed([held, (codes, times)])
    if len(held[0]):
        yield pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array(held[1])], names=["code", "n"])


def _rate(known, size_b: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts, best = known.value
        for batch in sliced(batches, 16 << 20):
            lists = batch.column(6)
            own, times = lists.flatten().to_numpy(zero_copy_only=False), batch.column(7).flatten().to_numpy(zero_copy_only=False)
            bounds = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            n = counts[np.searchsorted(codes, own)]
            sums = np.concatenate([[0], np.cumsum(n * times)])
            top = np.concatenate([[0], np.cumsum(np.where(n == best[own % size_b], times, 0))])
            columns = [*[batch.column(i) for i in range(5)], pa.array(np.diff(top[bounds])), pa.array(np.diff(sums[bounds])), batch.column(5)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return run


def alignment(df: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of df."""
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    path = new_shared_path(spark, "aligned")
    rows.mapInArrow(_align(path_a, path_b), FIRST).write.option("compression", "zstd").parquet(path)
    aligned = spark.read.parquet(path)
    counted = aligned.select("codes", "times").mapInArrow(_count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    pair = pair_of(path_a, path_b)
    found = counted.toArrow()
    if found.num_rows > pair.most_pairs():
        raise ValueError("more linked pairs than the vocabularies can have")
    codes, counts = found.column("code").to_numpy(), found.column("n").to_numpy()
    order, size_b = np.argsort(codes), len(pair.bytes_b)
    best = np.zeros(size_b, np.int64)
    np.maximum.at(best, codes % size_b, counts)
    known = spark.sparkContext.broadcast((codes[order], counts[order], best))
    return aligned.mapInArrow(_rate(known, size_b), RESULT)


def token_groups(df: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, group (from 0), a_from, a_to, b_from, b_to (places of tokens, exclusive), end (byte of space and text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_of(path_a, path_b)
        for batch in sliced(batches):
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = pair.ranges(body or "")
                for at in range(0, len(found), 1 << 16):
                    own = found[at : at + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array([doc] * len(own), pa.int64()), pa.array(np.arange(at, at + len(own))), *[pa.array(own[:, c]) for c in range(5)]], names=["doc_id", "group", "a_from", "a_to", "b_from", "b_to", "end"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, group long, a_from long, a_to long, b_from long, b_to long, end long")
