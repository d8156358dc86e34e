"""Best-fit packing by minimum bin slack, planned on counts of lengths.

Documents become token pieces of at most `capacity`. Which pieces share a sequence depends on their
lengths only, so the plan is made on the table of counts by length, of `capacity` rows at most however
many documents there are: per bin, the longest remaining length is placed and a bitset subset-sum over
the available lengths finds the fullest combination for the rest. That combination is removed as many
times as its counts allow. A bin filled to the last token can use up the short lengths that later bins need, so plans are
also made that take the longest lengths whose sum comes within some slack, and the plan with fewest bins is kept. Pieces then take their places by their rank among pieces of equal length.
Ranks come from counts per (length, bucket of ids), so one length that a third of all pieces have spreads
over many tasks.

Defined results: a null text is empty and is its end token alone; a null id is a document as any other,
ranked first; repeated rows are documents of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlode.llm.common import sliced

CAPACITY, END_ID = 1024, 2
#: Slacks of a bin with which plans are made, until one needs no more bins than its tokens do.
SLACKS = (0, 1, 2, 4, 8, 16)
#: Words whose ids a worker remembers after a space, and as many at line starts; when there are more, it goes on to remember those of
#: them that it meets again. With the ones before, that is twice as many, and some 200 MB in all.
REMEMBERED = 400_000
#: A byte-level vocabulary writes bytes as characters: printable Latin-1 as itself, the others from 256 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: Low bits of a place; the high ones, those of its file, are the bucket that ranks are counted by.
PLACE_BITS = 32
BYTE_LEVEL = {b: chr(b) for b in _PRINTED} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}
_OTHER_SPACE = re.compile(r"[^\S ]")
PIECES = "doc_id long, place long, piece int, start long, length long, ids_crc32 long"


class _Words(dict):
    """Ids of words after `before` (a space, or nothing at a line's start), found when a word is first asked for."""

    def __init__(self, tokenizer, before: str):
        super().__init__()
        self.older: dict[str, bytes] = {}
        self.tokenizer, self.before = tokenizer, before
        self.start = before.translate(BYTE_LEVEL)
        self.tokenize = tokenizer.model.tokenize
        self.packers = [struct.Struct(f"<{n}I").pack for n in range(64)]
        self.marks = {m: whole(tokenizer, m) for m in ".,;:!?"}

    def __missing__(self, word: str) -> bytes:
        out = self.older.get(word)
        if out is None:
            out = self.found(word)
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        self[word] = out
        return out

    def found(self, word: str) -> bytes:
        if word.isalpha():  # one run of letters is one piece: the model alone gives its ids
            written = word if word.isascii() else word.encode().decode("latin-1").translate(BYTE_LEVEL)
            ids = [t.id for t in self.tokenize(self.start + written)]
        elif len(word) > 1 and word[-1] in self.marks and word[-2].isalpha():  # a mark after letters is a piece by itself
            return self[word[:-1]] + self.marks[word[-1]]
        else:
            ids = self.tokenizer.encode(self.before + word, add_special_tokens=False).ids
        return self.packers[len(ids)](*ids) if len(ids) < len(self.packers) else np.asarray(ids, dtype="<u4").tobytes()


def whole(tokenizer, text: str) -> bytes:
    return np.asarray(tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


class Encoder:
    """Ids of whole texts, as little-endian bytes.

    Texts are cut where the vocabulary's pattern always cuts, before a space that a non-space follows
    and around a line end between non-spaces. What is between depends on itself alone, so its ids are
    looked up, and the tokenizer sees each word only when a worker meets it first.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_word = cuts_at_spaces(self.tokenizer)
        self.tokenizer.encode_special_tokens = True
        self.first, self.rest = _Words(self.tokenizer, ""), _Words(self.tokenizer, " ")
        self.line_end = self.whole("\n")

    def whole(self, text: str) -> bytes:
        return whole(self.tokenizer, text)

    @staticmethod
    def plain(line: str) -> bool:
        """Only spaces, single ones between words, and none at the ends."""
        return line != "" and "  " not in line and line[0] != " " and line[-1] != " " and (line.isascii() and line.isprintable() or not _OTHER_SPACE.search(line))

    def line(self, line: str) -> bytes:
        start, *others = line.split(" ")
        return self.first[start] + b"".join(map(self.rest.__getitem__, others))

    def batch(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            return list(map(self.whole, texts))
        cut = [t.split("\n") for t in texts]
        return [self.line_end.join(map(self.line, lines)) if all(map(self.plain, lines)) else self.whole(t) for t, lines in zip(texts, cut, strict=True)]


def cuts_at_spaces(tokenizer) -> bool:
    """Whether the vocabulary is of the kind whose texts may be looked up word by word: byte level, without a normalizer or a
    space put before the text, with the pattern that takes one space together with the letters, digits or marks after it."""
    import json

    told = json.loads(tokenizer.to_str())
    before, model = told.get("pre_tokenizer") or {}, told.get("model") or {}
    own = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    return bool(own and not told.get("normalizer") and model.get("type") == "BPE" and not model.get("dropout") and not model.get("continuing_subword_prefix") and not model.get("ignore_merges"))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def cuts(n: int, capacity: int = CAPACITY) -> Iterator[tuple[int, int]]:
    """Start and length of the pieces of n tokens: whole pieces but for the first, which may be shorter."""
    first = n % capacity or min(n, capacity)
    yield 0, first
    for at in range(first, n, capacity):
        yield at, capacity


def _pieces(path: str, capacity: int, end_id: int):
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in sliced(batches):
            rows: list[tuple] = []
            for doc, place, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), own.batch([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                ids += end
                rows += [(doc, place, k, s, n, zlib.crc32(memoryview(ids)[4 * s : 4 * (s + n)])) for k, (s, n) in enumerate(cuts(len(ids) // 4, capacity))]
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "place", "piece", "start", "length", "ids_crc32"])

    return run


def token_pieces(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, place: Column | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's pieces, and `place` (long), if given."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"), (F.lit(None) if place is None else place).cast("long").alias("place"))
    out = rows.mapInArrow(_pieces(tokenizer, capacity, end_id), PIECES)
    return out.drop("place") if place is None else out


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[tuple[int, int]], int]]:
    """Bins as (list of (length, how many), times): of the plans with the slacks SLACKS the first of those with fewest bins."""
    least, best, fewest = -(-sum(n * c for n, c in counts.items()) // capacity), [], None
    for slack in SLACKS:
        own = plan_within(counts, capacity, slack)
        bins = sum(times for _, times in own)
        if fewest is None or bins < fewest:
            best, fewest = own, bins
        if fewest <= least:
            break
    return best


def plan_within(counts: dict[int, int], capacity: int, slack: int) -> list[tuple[list[tuple[int, int]], int]]:
    """One plan: the longest remaining length of each bin is joined by the combination that `fill` finds."""
    left = {n: c for n, c in counts.items() if c > 0}
    out = []
    while left:
        top = max(left)
        room = capacity - top
        bin_ = {top: 1}
        left[top] -= 1
        chosen = fill({n: c for n, c in left.items() if c > 0 and n <= room}, room, slack)
        left[top] += 1
        for n, k in chosen.items():
            bin_[n] = bin_.get(n, 0) + k
        times = min(left[n] // k for n, k in bin_.items())
        for n, k in bin_.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
        out.append((sorted(bin_.items(), reverse=True), times))
    return out


def fill(counts: dict[int, int], room: int, slack: int = 0) -> dict[int, int]:
    """The fullest combination of lengths within `room`, of the longest ones that come within `slack` of it: subset sums as bits of one whole number."""
    mask, sums, steps = (1 << (room + 1)) - 1, 1, []
    for n in sorted(counts, reverse=True):
        many, size = min(counts[n], room // n), 1
        while many > 0:  # counts in powers of two
            take = min(size, many)
            steps.append((n, take, sums))
            sums |= (sums << (n * take)) & mask
            many, size = many - take, size * 2
        if sums >> max(room - slack, 0):
            break
    at, chosen = sums.bit_length() - 1, {}
    for n, take, before in reversed(steps):
        if not before >> at & 1:
            at -= n * take
            chosen[n] = chosen.get(n, 0) + take
    return chosen


def pack(pieces: DataFrame, capacity: int = CAPACITY, key: tuple[str, ...] = ("doc_id", "piece"), place: str | None = None) -> DataFrame:
    """Adds sequence_id and offset to rows that have length (1 to capacity) and the columns `key`.

    Equal lengths are interchangeable: they rank by a digest of the key, or by the column `place` (long), so that
    what comes earlier there is in the earlier of the sequences that are alike.
    """
    spark = pieces.sparkSession
    digest = F.md5(F.concat_ws("/", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key]))
    if place is None:
        ranked = pieces.withColumn("_d", digest).withColumn("_b", F.substring("_d", 1, 3))
    else:
        ranked = pieces.withColumn("_d", F.col(place)).withColumn("_b", F.shiftright(place, PLACE_BITS))
    cells = ranked.groupBy("length", "_b").agg(F.count(F.lit(1)).alias("n"))
    before = cells.withColumn("_o", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("length", "_b", "_o")
    counts = {r["length"]: r["n"] for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    # a run of ranks [lo, hi) of one length goes to `per` places in each of the bins from `first` on
    rows, first, used = [], 0, dict.fromkeys(counts, 0)
    for items, times in plan(counts, capacity):
        at = 0
        for n, per in items:
            rows.append((int(n), used[n], used[n] + per * times, per, first, at))
            used[n] += per * times
            at += n * per
        first += times
    places = spark.createDataFrame(rows, "length long, lo long, hi long, per long, first long, at long") if rows else spark.range(0).selectExpr("id length", "id lo", "id hi", "id per", "id first", "id at")
    table = places.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "per", "first", "at"))).alias("_p"))
    order = Window.partitionBy("length", "_b").orderBy("_d", *key)
    ranks = ranked.withColumn("_r", F.row_number().over(order) - 1).join(before, ["length", "_b"]).withColumn("_r", F.col("_r") + F.col("_o")).drop("_o", "_d", "_b")
    placed = ranks.join(F.broadcast(table), "length")  # one row per length, and in all some runs per length: bounded by capacity
    return _place(placed, len(rows).bit_length() + 1)


def _place(placed: DataFrame, halvings: int) -> DataFrame:
    # the run that holds the rank, by bisection over the sorted runs
    low, high = F.lit(0), F.size("_p") - 1
    found = F.aggregate(
        F.sequence(F.lit(1), F.lit(halvings)),
        F.struct(low.alias("a"), high.alias("b")),
        lambda s, _: F.when(
            F.get("_p", F.floor((s["a"] + s["b"] + 1) / 2).cast("int"))["lo"] <= F.col("_r"),
            F.struct(F.floor((s["a"] + s["b"] + 1) / 2).cast("int").alias("a"), s["b"].alias("b")),
        ).otherwise(F.struct(s["a"].alias("a"), F.greatest(F.floor((s["a"] + s["b"] + 1) / 2).cast("int") - 1, s["a"]).alias("b"))),
        lambda s: F.get("_p", s["a"]),
    )
    at = placed.withColumn("_q", found)
    j = F.col("_r") - F.col("_q.lo")
    out = at.withColumn("sequence_id", F.col("_q.first") + F.floor(j / F.col("_q.per"))).withColumn("offset", F.col("_q.at") + (j % F.col("_q.per")) * F.col("length"))
    return out.drop("_r", "_p", "_q")
