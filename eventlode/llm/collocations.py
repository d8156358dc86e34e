"""Phrases that stand together more often than their parts suggest, from a weighted de Bruijn graph of word grams.

Texts are cut into pieces at marks, and pieces into words. Nodes of the graph are runs of `longest` - 1 words and edges
join two that overlap in all but one word: an edge is a gram of `longest` words with its number of occurrences. Only these
longest grams are counted in the corpus, one at every word, together with the shorter ones that a piece's end cuts
off. The count of any shorter phrase is the flow through its node: the sum of all counted grams that begin with it,
the cut ones included. Each level is summed from the one above it.

A phrase can only be as frequent as its rarest word, pair or run of three words, so these are counted first, each among what the
ones before it leave. A piece also ends at a word, and a gram before the last word of a pair or run of three, that occurs less often than a candidate
must. Which ones those are is told by bitmaps of fixed size whose errors only let more through, so no phrase is lost and what is broadcast does not
grow with the data. As the least count is fixed, more of a larger corpus passes; no step makes more than one row for each word. Grams that are cut off
after two words are not told by every task again: they are what the longer ones leave of the pairs' counts.

Tasks combine what they count, share by share of the keys' range, and what leaves them is dealt out by key before Spark sums it up: summing it in
the same task once more would only take memory.

Unary paths, nodes whose whole flow comes over one edge and leaves over one edge, are compacted by pointer doubling into
the longest phrases that always stand together.

Everything is per language, which is part of a word's 64-bit hash; only words of phrases that are returned are looked up again. Equal hashes of
different words would add up their counts; with a billion distinct words that has a chance of about three in a hundred.

Defined results: a null text is empty, a null language `und`; repeated rows count again; a text of any length is
taken whole; an empty table gives an empty result; columns other than the named ones are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlode.llm.common import sliced, small_batches, stored
from eventlode.llm.hashing import LOWER, STEP, mixed, runs

LONGEST, MIN_COUNT, TOP = 5, 100, 2000
#: Bits of each bitmap, and how many of them a key sets: 4 MB, under 5% wrongly let through with four million keys.
BITMAP_BITS, BITMAP_KEYS = 1 << 25, 2
#: Words of the longest runs that are counted by hash before grams are.
TOLD = 3
#: Rows held by a task before they are combined and leave it, and how many of them are combined at once.
HELD, SHARE = 1 << 20, 1 << 17
#: Shares that a language's best rows are ranked in before the best of each are ranked together.
SALTS = 64
PRIME = np.uint64(0x9E3779B97F4A7C15)
#: Bytes between words: space and tab; marks end a piece as well.
MARKS = b".,;:!?\x0a\x0b\x0c\x0d"
_GAP, _ENDS = np.zeros(256, bool), np.zeros(256, bool)
_GAP[[0x20, 0x09, *MARKS]] = True
_ENDS[list(MARKS)] = True
_MARK = re.compile(rb"[.,;:!?\x0A-\x0D]")


def _blocks(texts: list[bytes]) -> Iterator[bytes]:
    """Texts joined to blocks of about STEP bytes. A longer text is cut where a piece ends; a piece is never cut."""
    held, size = [], 0
    for text in texts:
        at = 0
        while len(text) - at > STEP and (mark := _MARK.search(text, at + STEP)):
            yield text[at : mark.end()]
            at = mark.end()
        held.append(text[at:])
        size += len(text) - at + 1
        if size > STEP:
            yield b"\n".join(held) + b"\n"
            held, size = [], 0
    if held:
        yield b"\n".join(held) + b"\n"


def _words(block: bytes, salt: np.uint64) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, hashes of a block's words, and whether a word begins a piece."""
    data = np.frombuffer(block, np.uint8)
    if not _ENDS[data[-1]]:
        data = np.frombuffer(block + b"\n", np.uint8)
    starts, ends, h = runs(data, _GAP[data])
    marks = np.cumsum(_ENDS[data])[starts]
    return starts, ends, mixed(h ^ salt), np.diff(marks, prepend=-1) > 0


def salt_of(lang: str) -> np.uint64:
    raw = np.frombuffer(lang.encode() + b"\n", np.uint8)
    h = np.uint64(len(raw))
    for b in raw.astype(np.uint64):
        h = mixed(np.asarray([h * PRIME + b]))[0]
    return h


def _by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """Language and block of lower-cased text, from columns text and lang."""
    with np.errstate(over="ignore"):
        for batch in sliced(batches, 2 * STEP):
            texts = batch.column(0).cast(pa.binary()).to_pylist()
            of: dict[str, list[bytes]] = {}
            for text, lang in zip(texts, batch.column(1).to_pylist(), strict=True):
                if text:
                    of.setdefault(lang, []).append(text.translate(LOWER))
            for lang, own in of.items():
                for block in _blocks(own):
                    yield lang, block


def _combined(parts: list[tuple[np.ndarray, ...]]) -> Iterator[list[np.ndarray]]:
    """Columns of parts whose first column is a sorted hash and whose last one is a count: a row for each hash, with the sum of its counts.

    They come in shares of the hashes' range, of about SHARE rows each, so that no more than these are copied at once.
    """
    bits = (sum(len(p[0]) for p in parts) // SHARE).bit_length()
    edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.zeros(0, np.uint64)
    bounds = [[0, *np.searchsorted(p[0], edges).tolist(), len(p[0])] for p in parts]
    for share in range(1 << bits):
        columns = [np.concatenate(c) for c in zip(*[[c[b[share] : b[share + 1]] for c in p] for p, b in zip(parts, bounds, strict=True)], strict=True)]
        order = np.argsort(columns[0], kind="stable")
        keys = columns[0][order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
        if len(first):
            n = np.add.reduceat(columns[-1][order], first, dtype=np.int64)
            yield [keys[first], *[c[order[first]] for c in columns[1:-1]], n]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """h, lang, n of the words of texts, combined within the task."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

    def flush():
        for lang, parts in held.items():
            for keys, n in _combined(parts):
                langs = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(n), np.int32)), pa.array([lang], pa.string())).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), langs, pa.array(n)], names=["h", "lang", "n"])

    size = 0
    for lang, block in _by_language(batches):
        keys, n = np.unique(_words(block, salt_of(lang))[2], return_counts=True)
        held.setdefault(lang, []).append((keys, n.astype(np.int32)))
        size += len(keys)
        if size > 2 * HELD:
            yield from flush()
            held, size = {}, 0
    yield from flush()


def _tell_words(wanted):
    """h, word: the texts of words whose hashes may be wanted, each once in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[int] = set()
        for lang, block in _by_language(batches):
            starts, ends, h, _ = _words(block, salt_of(lang))
            at = np.flatnonzero(wanted.value.has(h))
            keys, first = np.unique(h[at], return_index=True)
            new = [(k, block[starts[i] : ends[i]].decode()) for k, i in zip(keys.tolist(), at[first].tolist(), strict=True) if k not in told]
            if new:
                told.update(k for k, _ in new)
                yield pa.RecordBatch.from_arrays([pa.array(np.asarray([k for k, _ in new], np.uint64).view(np.int64)), pa.array([w for _, w in new], pa.string())], names=["h", "word"])

    return run


class Bitmap:
    """Keys that may be in a set: every member is, and few others. Keys are 64-bit hashes."""

    def __init__(self, blocks: list[tuple[int, bytes]], bits: int):
        own = np.zeros(bits // 8, np.uint8)
        for number, block in blocks:
            own[number * 4096 : (number + 1) * 4096] = np.frombuffer(block, np.uint8)[: bits // 8]
        self.own, self.bits = own, bits

    def __contains__(self, key: int) -> bool:
        return bool(self.has(np.asarray([key], np.uint64))[0])

    def has(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), bool)
        for i in range(BITMAP_KEYS):
            at = (keys >> np.uint64(31 * i)) & np.uint64(self.bits - 1)
            found &= (self.own[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
        return found


def bitmap(keys: DataFrame, key: str, bits: int = BITMAP_BITS) -> Bitmap:
    """The bitmap of a column of hashes. It is built in blocks of 32,768 bits by Spark; at most bits / 32,768 rows are gathered."""
    at = F.explode(F.array(*[F.shiftrightunsigned(key, 31 * i).bitwiseAND(F.lit(bits - 1).cast("long")) for i in range(BITMAP_KEYS)]))
    placed = keys.select(at.alias("at"))
    blocks = placed.groupBy(F.shiftright("at", 15).alias("b")).agg(F.expr("bitmap_construct_agg(at & 32767)").alias("own"))
    return Bitmap([(r["b"], bytes(r["own"])) for r in blocks.collect()], bits)


def _kept_runs(h: np.ndarray, begins: np.ndarray, words: Bitmap, told: list[Bitmap]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For pairs of neighbours, runs of three words and so on: the hash of the run without its last word, the key of the run, and whether it may be frequent.

    A key is that hash times PRIME plus the last word; a run's hash is its mixed key.
    told: bitmaps of frequent pairs, runs of three and so on. The last entry is of runs one word longer than these tell of.
    """
    ok = words.has(h)
    before, keys = h[:-1], h[:-1] * PRIME + h[1:]
    kept = ok[:-1] & ok[1:] & ~begins[1:]
    found = [(before, keys, kept)]
    for size, frequent in enumerate(told, 3):
        hashes = mixed(keys)
        at = np.flatnonzero(kept)
        kept[at[~frequent.has(hashes[at])]] = False
        before, kept = hashes[:-1], kept[:-1] & kept[1:]
        keys = before * PRIME + h[size - 1 :]
        found.append((before, keys, kept))
    return found


def _count_runs(words, told: list):
    """p, w, n: the runs that `told` leaves, which are one word longer than the longest of these, combined within the task.

    p is the hash of the run without its last word (of a pair: its first word), w that word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            for keys, before, n in _combined(held):
                yield pa.RecordBatch.from_arrays([pa.array(before.view(np.int64)), pa.array((keys - before * PRIME).view(np.int64)), pa.array(n)], names=["p", "w", "n"])

        for lang, block in _by_language(batches):
            _, _, h, begins = _words(block, salt_of(lang))
            if len(h) < 2:
                continue
            before, keys, kept = _kept_runs(h, begins, words.value, [t.value for t in told])[-1]
            at = np.flatnonzero(kept)
            keys, first, n = np.unique(keys[at], return_index=True, return_counts=True)
            held.append((keys, before[at[first]], n.astype(np.int32)))
            size += len(keys)
            if size > 2 * HELD:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    return run


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """k: the hashes of runs, from their columns p and w."""
    for batch in batches:
        p, w = (batch.column(i).to_numpy().view(np.uint64) for i in range(2))
        yield pa.RecordBatch.from_arrays([pa.array(mixed(p * PRIME + w).view(np.int64))], names=["k"])


def grams(h: np.ndarray, kept: list[np.ndarray], longest: int) -> tuple[np.ndarray, np.ndarray]:
    """The gram that begins at each word whose run with the next two is kept, and its number of words.

    kept: for the place where each pair, each run of three words and so on begins, whether it may be frequent. A gram ends after `longest`
    words or where the longest of these runs that ends at the next word, within the gram, is not kept; words beyond its end are 0.
    """
    at = np.flatnonzero(kept[1])
    rows = np.zeros((len(at), longest), np.uint64)
    rows[:, 0] = h[at]
    n, on = np.ones(len(at), np.int64), np.ones(len(at), bool)
    kept = [np.concatenate([k, np.zeros(len(h) - len(k), bool)]) for k in kept]
    for k in range(1, longest):
        size = min(k + 1, len(kept) + 1)
        on = on & kept[size - 2][np.minimum(at + k + 1 - size, len(h) - 1)]
        rows[on, k] = h[at[on] + k]
        n += on
    return rows, n


def _count_grams(words, told: list, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def combined(rows, counts, n):
            key = rows[:, 0]
            for k in range(1, longest):
                key = mixed(key * PRIME + rows[:, k])
            _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
            return rows[first], counts[first], np.bincount(inverse, n, len(first)).astype(np.int64)

        def together():
            return combined(*(np.concatenate(x) for x in zip(*held, strict=True)))

        def batched(rows, counts, n):
            order = np.lexsort((rows[:, 1], rows[:, 0]))
            rows, counts, n = rows[order], counts[order], n[order]
            for at in range(0, len(n), 1 << 16):
                s = slice(at, at + (1 << 16))
                columns = [pa.array(rows[s, k].view(np.int64), mask=counts[s] <= k) for k in range(longest)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n[s])], names=[*_names(longest), "n"])

        for lang, block in _by_language(batches):
            _, _, h, begins = _words(block, salt_of(lang))
            if len(h) < 2:
                continue
            kept = [k for *_, k in _kept_runs(h, begins, words.value, [t.value for t in told])[: len(told)]]
            rows, counts = grams(h, kept, longest)
            held.append(combined(rows, counts, np.ones(len(counts), np.int64)))
            size += len(held[-1][2])
            if size > HELD // 2:
                held = [together()]
                size = len(held[0][2])
                if size > HELD // 4:  # little of it repeats: more of it would not either
                    yield from batched(*held[0])
                    held, size = [], 0
        if held:
            yield from batched(*together())

    return run


def _names(longest: int) -> list[str]:
    return [f"w{k}" for k in range(1, longest + 1)]


class Graph:
    """Counts of a corpus: `words` (h, lang, n) of frequent words, `totals` (lang, n), `edges` (w1.., n) of longest and cut-off grams, and its `rows` (text, lang)."""

    def __init__(self, rows: DataFrame, words: DataFrame, totals: DataFrame, edges: DataFrame, longest: int, least: int):
        self.rows, self.words, self.totals, self.edges, self.longest, self.least = rows, words, totals, edges, longest, least

    def phrases(self) -> DataFrame:
        """ws (hashes of the words in order), a: every phrase of 2 to `longest` words that occurs `least` times, from the flow through its node.

        Grams that end early are told from phrases only after they are stored: a test before would be done below
        the sums, and then every level would be summed anew from the edges for each shorter one.
        """
        level, names, out = self.edges, _names(self.longest), []
        for k in range(self.longest, 1, -1):
            level = level if k == self.longest else level.groupBy(*names[:k]).agg(F.sum("n").alias("n"))
            out.append(level.filter(F.col("n") >= self.least).select(F.array(*names[:k]).alias("ws"), F.col("n").alias("a")))
        return stored(reduce(DataFrame.unionByName, out), "phrases").filter(F.element_at("ws", -1).isNotNull())

    def texts(self, ws: DataFrame, bits: int) -> DataFrame:
        """h, word of all words of a column `ws`."""
        wanted = ws.select(F.explode("ws").alias("h")).distinct()
        shared = self.rows.sparkSession.sparkContext.broadcast(bitmap(wanted, "h", bits))
        return stored(self.rows.mapInArrow(_tell_words(shared), "h long, word string").groupBy("h").agg(F.min("word").alias("word")), "texts")

    def paths(self, phrases: DataFrame) -> DataFrame:
        """ws, path (words' hashes of the whole path), a: for every frequent edge, the unary path it lies on.

        An edge goes on to the next one if the node between them has no other flow: both counts are the node's. A path can't
        close to a circle, as the first occurrence in a text would have come into it over another edge.
        """
        k = self.longest
        edges = phrases.filter(F.size("ws") == k).select("ws", "a", F.slice("ws", 1, k - 1).alias("source"), F.slice("ws", 2, k - 1).alias("target"))
        edges = stored(edges, "edges")
        nodes = phrases.filter(F.size("ws") == k - 1).select(F.col("ws").alias("node"), F.col("a").alias("flow"))
        into = edges.select(F.col("target").alias("node"), F.col("a").alias("flow"), F.col("ws").alias("before"))
        out = edges.select(F.col("source").alias("node"), F.col("a").alias("flow"), "ws")
        links = nodes.join(into, ["node", "flow"]).join(out, ["node", "flow"]).select("ws", "before")
        # pointer doubling towards the first edge: `up` is the edge 2^i places before, or the first one
        step = edges.select("ws").join(links, "ws", "left").select("ws", F.coalesce("before", "ws").alias("up"), F.when(F.col("before").isNull(), 0).otherwise(1).cast("long").alias("place"))
        step = stored(step, "paths")
        inner = lambda: step.filter("place > 0")
        while not inner().select(F.col("up").alias("ws")).join(inner().select("ws"), "ws", "left_semi").isEmpty():
            higher = step.select(F.col("ws").alias("up"), F.col("up").alias("up2"), F.col("place").alias("place2"))
            step = stored(step.join(higher, "up").select("ws", F.col("up2").alias("up"), (F.col("place") + F.col("place2")).alias("place")), "paths")
        whole = step.groupBy("up").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", F.element_at("ws", -1).alias("w")))), lambda x: x["w"]).alias("tail"))
        path = whole.select("up", F.concat(F.slice("up", 1, k - 1), "tail").alias("path"))
        return edges.select("ws", "a").join(step.select("ws", "up"), "ws").join(path, "up").select("ws", "path", "a")


def summed(found: DataFrame, *keys: str) -> DataFrame:
    """Sums of n by keys, of rows that tasks have combined: they are dealt out first, as little is left to sum up before."""
    return found.repartition(*keys).groupBy(*keys).agg(F.sum("n").alias("n"))


def graph(df: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = MIN_COUNT, bits: int = BITMAP_BITS) -> Graph:
    """Counts words, then pairs of frequent words, then runs of three words of frequent pairs, then the grams that go through frequent ones only."""
    sc = df.sparkSession.sparkContext
    rows = df.select(F.col(text).cast("string").alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"))
    every = summed(rows.mapInArrow(_count_words, "h long, lang string, n long"), "h", "lang")
    # of words that are too rare, only how many there are of a language is kept
    counted = stored(every.groupBy(F.when(F.col("n") >= least, F.col("h")).alias("h"), "lang").agg(F.sum("n").alias("n")), "words")
    totals = counted.groupBy("lang").agg(F.sum("n").alias("n"))
    words = counted.filter(F.col("h").isNotNull())
    of_words = sc.broadcast(bitmap(words, "h", bits))
    told: list = []

    def frequent() -> DataFrame:
        return summed(rows.mapInArrow(_count_runs(of_words, [*told]), "p long, w long, n long"), "p", "w").filter(F.col("n") >= least)

    def tell(runs_of: DataFrame) -> None:
        told.append(sc.broadcast(bitmap(runs_of.mapInArrow(_hashed, "k long"), "k", bits)))

    names = _names(longest)
    pairs = stored(frequent(), "pairs").select(F.col("p").alias("w1"), F.col("w").alias("w2"), "n")
    if longest == 2:
        return Graph(rows, words, totals, pairs, longest, least)
    tell(pairs)
    for _ in range(3, TOLD + 1):
        tell(frequent())
    edges = rows.mapInArrow(_count_grams(of_words, told, longest), ", ".join(f"{w} long" for w in names) + ", n long")
    longer = stored(summed(edges, *names), "grams")
    left = pairs.unionByName(longer.select("w1", "w2", (-F.col("n")).alias("n"))).groupBy("w1", "w2").agg(F.sum("n").alias("n")).filter(F.col("n") > 0)
    cut = stored(left.select("w1", "w2", *[F.lit(None).cast("long").alias(w) for w in names[2:]], "n"), "pairs")
    return Graph(rows, words, totals, longer.unionByName(cut), longest, least)


def score_of(a: Column, n: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(1000 * a * n / (l * r)), exactly: products have up to 38 digits."""
    wide = [c.cast("decimal(38,0)") for c in (a, n, l, r)]
    return F.call_function("div", F.lit(1000).cast("decimal(4,0)") * wide[0] * wide[1], wide[2] * wide[3])


def scored(g: Graph, phrases: DataFrame) -> DataFrame:
    """ws, a, lang, l, r, n, score of the lowest-scoring cut of every phrase."""
    parts = phrases.unionByName(g.words.select(F.array("h").alias("ws"), F.col("n").alias("a")))
    cuts = phrases.select("ws", "a", F.explode(F.sequence(F.lit(1), F.size("ws") - 1)).alias("k"))
    sides = cuts.select("ws", "a", "k", F.slice("ws", 1, F.col("k")).alias("left"), F.expr("slice(ws, k + 1, size(ws) - k)").alias("right"))
    first = parts.select(F.col("ws").alias("left"), F.col("a").alias("l"))
    rest = parts.select(F.col("ws").alias("right"), F.col("a").alias("r"))
    langs = g.words.select(F.col("h").alias("_h"), "lang")
    known = sides.join(first, "left").join(rest, "right").withColumn("_h", F.get("ws", F.lit(0))).join(langs, "_h").join(F.broadcast(g.totals), "lang")
    cut = known.select("ws", "a", "lang", "n", F.struct(score_of(F.col("a"), F.col("n"), F.col("l"), F.col("r")).alias("score"), F.col("k"), F.col("l"), F.col("r")).alias("cut"))
    best = cut.groupBy("ws").agg(F.first("a").alias("a"), F.first("lang").alias("lang"), F.first("n").alias("n"), F.min("cut").alias("cut"))
    return best.select("ws", "a", "lang", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))


def unsubsumed(phrases: DataFrame, candidates: DataFrame, percent: int = 100) -> DataFrame:
    """Candidates but for those within a longer phrase that has `percent` of their count.

    A phrase on the way to a longer one is at least as frequent, so phrases of one word more decide.
    """
    longer = phrases.filter(F.size("ws") > 2)
    inner = longer.select(F.explode(F.array(F.expr("slice(ws, 1, size(ws) - 1)"), F.expr("slice(ws, 2, size(ws) - 1)"))).alias("ws"), "a")
    most = inner.groupBy("ws").agg(F.max("a").alias("more"))
    return candidates.join(most, "ws", "left").filter(F.col("more").isNull() | (100 * F.col("more") < percent * F.col("a"))).drop("more")


def spelled(g: Graph, rows: DataFrame, name: str, bits: int = BITMAP_BITS) -> DataFrame:
    """Adds the text of the phrase whose words' hashes are in `ws`."""
    key = [c for c in rows.columns if c != "ws"]
    words = rows.select("ws", *key, F.posexplode("ws").alias("_at", "h")).join(g.texts(rows, bits), "h")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_at", "word"))), lambda x: x["word"]), " ")
    return words.groupBy("ws", *key).agg(text.alias(name))


def collocations(df: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = MIN_COUNT, top: int = TOP, percent: int = 100, bits: int = BITMAP_BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first `top` phrases, and path_words: how many
    words stand together as often as the phrase's first longest gram does (the length of its unary path; null for shorter phrases).
    """
    with small_batches(df.sparkSession):
        g = graph(df, text, lang, longest, least, bits)
    phrases = g.phrases()
    candidates = stored(unsubsumed(phrases, scored(g, phrases), percent), "collocations")
    with small_batches(df.sparkSession):
        rows = spelled(g, _first(candidates, top), "phrase", bits)
    order = [F.desc("score"), F.desc("a"), "phrase"]
    some = rows.withColumn("_s", F.pmod(F.xxhash64("ws"), F.lit(SALTS))).withColumn("_r", F.row_number().over(Window.partitionBy("lang", "_s").orderBy(*order))).filter(F.col("_r") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    lengths = g.paths(phrases).select("ws", F.size("path").cast("long").alias("path_words"))
    return ranked.join(lengths, "ws", "left").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score", "path_words")


def _first(candidates: DataFrame, top: int) -> DataFrame:
    """Rows that may be among a language's first: those of the least bucket of scores that `top` rows reach, and better ones."""
    bucket = F.floor(F.log2(F.greatest("score", F.lit(1)).cast("double")) * 64)
    buckets = candidates.groupBy("lang", bucket.alias("b")).agg(F.count(F.lit(1)).alias("m"))
    above = F.sum("m").over(Window.partitionBy("lang").orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, -1))
    cuts = buckets.withColumn("above", F.coalesce(above, F.lit(0))).filter(F.col("above") < top).groupBy("lang").agg(F.min("b").alias("least"))
    return candidates.join(F.broadcast(cuts), "lang").filter(bucket >= F.col("least")).drop("least")


def oracle(docs: str = "documents", longest: int = LONGEST, least: int = MIN_COUNT, top: int = TOP) -> str:
    """DuckDB SQL for the query over `docs`: every gram of every length is counted by itself."""
    starts = " UNION ALL ".join(f"SELECT lang, {k} AS k, list_slice(w, i, i + {k - 1}) AS ws FROM places WHERE i + {k - 1} <= len(w)" for k in range(1, longest + 1))
    return f"""
    WITH RECURSIVE d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM {docs}),
    p AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
    s AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
    places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM s),
    g AS MATERIALIZED (SELECT lang, k, ws, count(*) AS a FROM ({starts}) GROUP BY lang, k, ws),
    t AS (SELECT lang, sum(a)::BIGINT AS n FROM g WHERE k = 1 GROUP BY lang),
    f AS MATERIALIZED (SELECT * FROM g WHERE k > 1 AND a >= {least}),
    c AS (SELECT lang, k, ws, a, unnest(range(1, k)) AS c FROM f),
    x AS (SELECT c.lang, c.k, c.ws, c.a, c.c, l.a AS l, r.a AS r, t.n, ((1000::HUGEINT * c.a * t.n) // (l.a::HUGEINT * r.a))::BIGINT AS score
      FROM c JOIN t USING (lang) JOIN g l ON l.lang = c.lang AND l.ws = list_slice(c.ws, 1, c.c) JOIN g r ON r.lang = c.lang AND r.ws = list_slice(c.ws, c.c + 1, c.k)),
    b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, ws ORDER BY score, c) = 1),
    m AS (SELECT lang, ws, max(a) AS more FROM (SELECT lang, list_slice(ws, 1, k - 1) AS ws, a FROM f WHERE k > 2 UNION ALL SELECT lang, list_slice(ws, 2, k) AS ws, a FROM f WHERE k > 2) GROUP BY lang, ws),
    o AS (SELECT b.* FROM b LEFT JOIN m USING (lang, ws) WHERE coalesce(m.more, 0) < b.a),
    e AS (SELECT lang, ws, a, list_slice(ws, 1, {longest - 1}) AS src, list_slice(ws, 2, {longest}) AS dst FROM f WHERE k = {longest}),
    n AS (SELECT y.lang, y.ws, z.ws AS after FROM e y JOIN f v ON v.lang = y.lang AND v.ws = y.dst AND v.a = y.a JOIN e z ON z.lang = v.lang AND z.src = v.ws AND z.a = v.a),
    h AS (SELECT lang, ws AS head, ws, 0 AS place FROM e WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.lang = e.lang AND n.after = e.ws)
      UNION ALL SELECT h.lang, h.head, n.after, h.place + 1 FROM h JOIN n ON n.lang = h.lang AND n.ws = h.ws),
    q AS (SELECT lang, ws, (max(place) OVER (PARTITION BY lang, head) + {longest})::BIGINT AS path_words FROM h),
    z AS (SELECT o.lang, row_number() OVER (PARTITION BY o.lang ORDER BY score DESC, a DESC, array_to_string(o.ws, ' ')) AS rank, array_to_string(o.ws, ' ') AS phrase, a, l, r, n, score, path_words FROM o LEFT JOIN q ON q.lang = o.lang AND q.ws = o.ws)
    SELECT * FROM z WHERE rank <= {top}"""
