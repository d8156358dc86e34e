"""Language-model scoring with an Elias-Fano n-gram trie.

Words are counted over the whole training part, and word pairs after them. The trie has two levels, each
in shards of bounded size that lie in the shared folder and are memory-mapped by the workers:

* words: their 64-bit hashes as an Elias-Fano sequence, exact counts in bytes (larger ones apart), and the
  back-off weight of each word as a context in one byte;
* pairs, all of them: per context a monotone pointer to its successors, the successors' numbers made
  monotone by adding the last number of the context before, and one byte for the smoothed probability.

A pair is found by its context's pointers and a successor search from the context's own base. Probabilities
are interpolated with absolute discounting: each pair gives the discount to the back-off weight of its context, which
hands it to the add-one word probability. Bytes index a shard's own codebook of
even steps. A text's end is a token; the end of "the text before" is the context of its first word.

Counts are grouped with map-side combine, so frequent words and pairs do not gather in one task; shards are
dealt by ranges of equal size, and one context may reach over several shards.

Defined results: a null text is empty and is its end token alone; repeated rows are texts of their own; with
no training text every token is unknown; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlode.llm.common import crc_mod, cut, new_shared_path, sliced, stored
from eventlode.llm.eliasfano import EliasFano, load, save
from eventlode.llm.hashing import LOWER, stepped, word_hashes

END = np.uint64(0x5851F42D4C957F2D)
#: Words of a shard of the first level, pairs of one of the second, bytes of text hashed at once, keys held before they are counted.
SHARD_WORDS, SHARD_PAIRS, STEP, HELD = 1 << 19, 1 << 21, 1 << 22, 1 << 21


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text's end included, and the number of tokens of each text."""
    h, counts = word_hashes([t.translate(LOWER) for t in texts])
    counts = counts + 1
    out = np.full(int(counts.sum()), END, np.uint64)
    word = np.ones(len(out), bool)
    word[np.cumsum(counts) - 1] = False
    out[word] = h
    return out, counts


def _raw(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def _flush(held: list[np.ndarray], counts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    if held:
        keys, inverse = np.unique(np.concatenate(held), return_inverse=True)
        n = np.bincount(inverse, np.concatenate(counts)).astype(np.int64)
        for at in range(0, len(keys), 1 << 17):
            yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + (1 << 17)].view(np.int64)), pa.array(n[at : at + (1 << 17)])], names=["key", "n"])


def _counted(keys_of):
    """Counts of the keys that keys_of finds in batches of texts, combined over HELD keys before they leave the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, held, counts, size = keys_of(), [], [], 0
        for batch in sliced(batches, STEP):
            raw = _raw(batch.column(0))
            for lo, hi in stepped(raw, STEP):
                k, n = np.unique(find(raw[lo:hi]), return_counts=True)
                held.append(k)
                counts.append(n)
                size += len(k)
                if size > HELD:
                    yield from _flush(held, counts)
                    held, counts, size = [], [], 0
        yield from _flush(held, counts)

    return run


def _word_keys():
    return lambda raw: tokens(raw)[0]


class Vocabulary:
    """The first level: numbers and counts of words."""

    def __init__(self, path: str, shards: list[tuple[int, int, int]]):
        """shards: number, first word's number, smallest hash; by hash."""
        self.first = np.asarray([s[1] for s in shards], np.int64)
        self.least = np.asarray([s[2] for s in shards], np.uint64)
        self.parts = [load(f"{path}/words-{s[0]}") for s in shards]
        self.hashes = [EliasFano(p) for p in self.parts]

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of sorted hashes; -1 for unknown ones."""
        out = np.full(len(hashes), -1, np.int64)
        cuts = [*np.searchsorted(hashes, self.least), len(hashes)]
        for i, part in enumerate(self.hashes):
            lo, hi = cuts[i], cuts[i + 1]
            if lo < hi:
                at = part.find(hashes[lo:hi] - self.least[i])
                out[lo:hi] = np.where(at >= 0, at + self.first[i], -1)
        return out

    def _by_shard(self, numbers: np.ndarray):
        shard = np.searchsorted(self.first, numbers, side="right") - 1
        for i in np.unique(shard):
            at = np.flatnonzero(shard == i)
            yield self.parts[i], at, numbers[at] - self.first[i]

    def counts(self, numbers: np.ndarray) -> np.ndarray:
        out = np.zeros(len(numbers), np.int64)
        for part, at, own in self._by_shard(numbers):
            n = part["count"][own].astype(np.int64)
            large = np.flatnonzero(n == 255)
            if len(large):
                n[large] = part["large_count"][np.searchsorted(part["large_at"], own[large])]
            out[at] = n
        return out


class Trie:
    """Both levels, for scoring."""

    def __init__(self, path: str, words: list, backoff: list, pairs: list[tuple[int, int]]):
        self.words = Vocabulary(path, words)
        self.backoff = {b: load(f"{path}/backoff-{b}") for b in backoff}
        self.first_key = np.asarray([k for _, k in pairs], np.uint64)
        self.parts = [load(f"{path}/pairs-{i}") for i, _ in pairs]
        self.levels = [(EliasFano(p, "ctx_"), EliasFano(p, "ptr_"), EliasFano(p, "suc_")) for p in self.parts]

    def weights(self, contexts: np.ndarray) -> np.ndarray:
        """log10 back-off weights of word numbers."""
        out = np.zeros(len(contexts))
        block = contexts // SHARD_WORDS
        for b in np.unique(block):
            at = np.flatnonzero(block == b)
            if b in self.backoff:
                part = self.backoff[b]
                out[at] = part["book"][part["code"][contexts[at] - b * SHARD_WORDS]]
        return out

    def pairs(self, keys: np.ndarray) -> np.ndarray:
        """log10 probabilities of sorted pair keys (context << 32 | word); nan where a pair is not in the trie."""
        out = np.full(len(keys), np.nan)
        cuts = np.maximum.accumulate([*np.searchsorted(keys, self.first_key), len(keys)])
        for i, (ctx, ptr, suc) in enumerate(self.levels):
            own = keys[cuts[i] : cuts[i + 1]]
            if not len(own):
                continue
            context = own >> np.uint64(32)
            new = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
            at = ctx.find(context[new])  # once per context
            lo, hi = ptr.get(np.maximum(at, 0)).astype(np.int64), ptr.get(np.maximum(at, 0) + 1).astype(np.int64)
            base = np.where(lo > 0, suc.get(np.maximum(lo - 1, 0)), np.uint64(0))
            spread = np.diff(np.concatenate([new, [len(own)]]))
            lo, hi, base = np.repeat(np.where(at >= 0, lo, 0), spread), np.repeat(np.where(at >= 0, hi, 0), spread), np.repeat(base, spread)
            place = suc.find(base + (own & np.uint64(0xFFFFFFFF)) + np.uint64(1))
            good = (place >= lo) & (place < hi)
            found = out[cuts[i] : cuts[i + 1]]
            found[good] = self.parts[i]["book"][self.parts[i]["code"][place[good]]]
        return out


_LOADED: dict[str, object] = {}


def _kept(key: str, make):
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = make()
    return _LOADED[key]


def _pair_keys(path: str, words: list):
    def make():
        vocabulary = _kept(path, lambda: Vocabulary(path, words))

        def find(raw: list[bytes]) -> np.ndarray:
            h, inverse = np.unique(tokens(raw)[0], return_inverse=True)
            number = vocabulary.numbers(h)[inverse].astype(np.uint64)
            end = vocabulary.numbers(np.asarray([END]))[0]
            return (np.concatenate([np.asarray([end], np.uint64), number[:-1]]) << np.uint64(32)) | number

        return find

    return make


def quantised(values: np.ndarray) -> dict[str, np.ndarray]:
    """One byte per value, and the codebook: 256 even steps from the least to the largest, so no value is off by more than half a step."""
    low, high = (float(values.min()), float(values.max())) if len(values) else (0.0, 0.0)
    step = (high - low) / 255 or 1.0
    return {"code": np.rint((values - low) / step).astype(np.uint8), "book": low + step * np.arange(256)}


def _save_words(path: str):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        shard = int(rows["shard"].iloc[0])
        h, n = rows["key"].to_numpy().view(np.uint64), rows["n"].to_numpy()
        order = np.argsort(h)
        h, n = h[order], n[order]
        large = np.flatnonzero(n >= 255)
        save(f"{path}/words-{shard}", EliasFano.encode(h - h[0]) | {"count": np.minimum(n, 255).astype(np.uint8), "large_at": large, "large_count": n[large]})
        return pd.DataFrame({"shard": [shard], "least": h[:1].view(np.int64), "n_words": [len(h)]})

    return run


def _save_backoff(path: str, words: list, discount: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        vocabulary = _kept(path, lambda: Vocabulary(path, words))
        block = int(rows["block"].iloc[0])
        at = rows["context"].to_numpy()
        weight = discount * rows["kinds"].to_numpy() / vocabulary.counts(at)
        full = np.zeros(SHARD_WORDS)
        full[at - block * SHARD_WORDS] = np.log10(np.minimum(weight, 1.0))
        save(f"{path}/backoff-{block}", quantised(full))
        return pd.DataFrame({"block": [block]})

    return run


def _save_pairs(path: str, words: list, discount: float, total: int, kinds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if not got:
            return
        vocabulary = _kept(path, lambda: Vocabulary(path, words))
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        key, n = np.concatenate([g[0] for g in got]).view(np.uint64), np.concatenate([g[1] for g in got])
        order = np.argsort(key)
        key, n = key[order], n[order]
        context, word = (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
        spread = np.diff(np.concatenate([new, [len(key)]]))
        c_context = np.repeat(vocabulary.counts(context[new]), spread)
        ones_more = _weights_of(path, context[new])
        lower = (vocabulary.counts(word) + 1) / (total + kinds + 1)
        p = np.log10((n - discount) / c_context + np.repeat(ones_more, spread) * lower)
        # a context's successors, made monotone by the last number of the context before
        ends = np.cumsum(word[np.concatenate([new[1:] - 1, [len(key) - 1]])] + 1)
        base = np.concatenate([[0], ends[:-1]])
        arrays = EliasFano.encode(context[new], "ctx_") | EliasFano.encode(np.concatenate([new, [len(key)]]), "ptr_") | EliasFano.encode(np.repeat(base, spread) + word + 1, "suc_") | quantised(p)
        save(f"{path}/pairs-{shard}", arrays)
        yield pa.RecordBatch.from_pydict({"shard": [shard], "first": key[:1].view(np.int64), "n": [len(key)]})

    return run


def _weights_of(path: str, contexts: np.ndarray) -> np.ndarray:
    out = np.ones(len(contexts))
    block = contexts // SHARD_WORDS
    for b in np.unique(block):
        part, at = load(f"{path}/backoff-{b}"), np.flatnonzero(block == b)
        out[at] = 10.0 ** part["book"][part["code"][contexts[at] - b * SHARD_WORDS]]
    return out


def train(texts: DataFrame, folder: str | None = None) -> dict:
    """Counts the column text and writes the trie. Returns what a worker needs to open it: a few numbers per shard."""
    path = folder or new_shared_path(texts.sparkSession, "trie")
    words = cut(texts.mapInArrow(_counted(_word_keys), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")))
    stats = words.agg(F.count(F.lit(1)).alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("t")).first()
    kinds, total = stats["v"], stats["t"]
    bits = max(0, (kinds // SHARD_WORDS).bit_length())  # shards by the first bits of hashes, which are even
    model = {"path": path, "total": total, "kinds": kinds, "words": [], "backoff": [], "pairs": []}
    if not kinds:
        return model
    shard = F.shiftrightunsigned("key", 64 - bits).cast("int") if bits else F.lit(0)
    parts = words.withColumn("shard", shard).groupBy("shard").applyInPandas(_save_words(path), "shard int, least long, n_words long")
    first = 0
    for r in sorted(parts.collect(), key=lambda r: r["shard"]):
        model["words"].append((r["shard"], first, r["least"] % (1 << 64)))
        first += r["n_words"]
    pairs = stored(texts.mapInArrow(_counted(_pair_keys(path, model["words"])), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "pairs")
    c = pairs.agg(F.count(F.when(F.col("n") == 1, 1)).alias("n1"), F.count(F.when(F.col("n") == 2, 1)).alias("n2"), F.count(F.lit(1)).alias("kept")).first()
    discount = min(0.9, max(0.3, c["n1"] / max(1, c["n1"] + 2 * c["n2"])))
    per_context = pairs.groupBy(F.shiftrightunsigned("key", 32).alias("context")).agg(F.count(F.lit(1)).alias("kinds")).withColumn("block", F.floor(F.col("context") / SHARD_WORDS))
    model["backoff"] = sorted(r["block"] for r in per_context.groupBy("block").applyInPandas(_save_backoff(path, model["words"], discount), "block long").collect())
    ranges = max(1, -(-c["kept"] // SHARD_PAIRS))
    kept = pairs.repartitionByRange(ranges, "key").mapInArrow(_save_pairs(path, model["words"], discount, total, kinds), "shard long, first long, n long")
    model["pairs"] = sorted(((r["shard"], r["first"] % (1 << 64)) for r in kept.collect()), key=lambda x: x[1])
    return model


def _score(model: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = _kept(model["path"] + "/", lambda: Trie(model["path"], model["words"], model["backoff"], model["pairs"])) if model["kinds"] else None
        whole = np.log10(model["total"] + model["kinds"] + 1)
        for batch in sliced(batches, STEP):
            raw = _raw(batch.column(2))
            for lo, hi in stepped(raw, STEP):
                h, n = tokens(raw[lo:hi])
                start = np.concatenate([[0], np.cumsum(n)[:-1]])
                uniq, inverse = np.unique(h, return_inverse=True)
                number = trie.words.numbers(uniq) if trie else np.full(len(uniq), -1)
                known = number >= 0
                count = np.zeros(len(uniq), np.int64)
                count[known] = trie.words.counts(number[known]) if known.any() else 0
                base_u = np.log10(count + 1) - whole
                base = base_u[inverse]
                score = base.copy()
                if trie:
                    weight = np.zeros(len(uniq))
                    weight[known] = trie.weights(number[known])
                    end = np.searchsorted(uniq, END)
                    before = np.concatenate([[end], inverse[:-1]])
                    score += np.where(known[before], weight[before], 0.0)
                    both = np.flatnonzero(known[before] & known[inverse])
                    key = (number[before[both]].astype(np.uint64) << np.uint64(32)) | number[inverse[both]].astype(np.uint64)
                    ukey, back = np.unique(key, return_inverse=True)
                    p = trie.pairs(ukey)[back]
                    seen = ~np.isnan(p)
                    score[both[seen]] = p[seen]
                own = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [own.column(0), own.column(1), pa.array(n), pa.array(np.add.reduceat(known[inverse].astype(np.int64), start)), pa.array(np.add.reduceat(base, start)), pa.array(np.add.reduceat(score, start))],
                    names=["id", "held_out", "n_tokens", "n_known", "base_score", "score"],
                )

    return run


def score(df: DataFrame, model: dict) -> DataFrame:
    """df: id, held_out, text. Adds n_tokens, n_known, base_score, score."""
    return df.select("id", "held_out", "text").mapInArrow(_score(model), "id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")


def lm_scores(df: DataFrame, id_col: str = "doc_id", text: str = "text", fold: int = 2, folds: int = 7) -> DataFrame:
    """Learns from the rows outside the fold and scores all."""
    docs = df.select(F.col(id_col).cast("long").alias("id"), (crc_mod(id_col, folds) == fold).alias("held_out"), F.col(text).alias("text"))
    model = train(docs.filter("not held_out").select("text"))
    out = score(docs, model)
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(model["total"]).cast("long").alias("train_tokens"), "base_score", "score")
