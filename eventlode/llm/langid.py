"""Language identification by interpolated Kneser-Ney character models in sorted hash arrays.

A model per language is fitted on a bounded sample: at most `per_language` documents of each of the
`most_languages` commonest languages, those of smallest id hash, whole. Letters are lower-cased, anything else is one space. The
n-grams that any language has seen stand in one sorted array of hashes per order, with the
interpolated log probability under every language beside them; the contexts stand in another, with
their back-off weights. A text is scored under all languages at once: its longest known n-gram ends
the search at each character. The language of lowest cross-entropy per character is the prediction.

A part of the sample is held out of the fit. On it the score is calibrated (a logistic of the gap in
cross-entropy, sharpness by likelihood), and per language the cross-entropy that all but `reject` of its texts
stay below: a text above it is marked rejected, and keeps its prediction.

Defined results: a null text or one without a letter is `und` with score 0; a null language is not learned
from; with nothing to learn from everything is `und`; texts are taken whole, in steps of bounded memory;
repeated rows repeat; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventlode.llm.common import crc_mod, cut, sliced

ORDER, PER_LANGUAGE, MOST_LANGUAGES, HOLD_FROM, REJECT = 4, 400, 400, 20, 0.005
STEP = 1 << 19
_K = np.uint64(0x9E3779B97F4A7C15)
_SPACE = 32


def letters() -> np.ndarray:
    """Which code points are letters."""
    if "t" not in _LETTERS:
        _LETTERS["t"] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _LETTERS["t"]


_LETTERS: dict[str, np.ndarray] = {}


def characters(texts: list[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each after order - 1 zeros, and each text's first place in them."""
    pad = "\0" * (order - 1)
    flat = np.frombuffer((pad + pad.join(t.lower() for t in texts)).encode("utf-32-le", "surrogatepass"), np.uint32) if texts else np.empty(0, np.uint32)
    # lower() may change lengths, so ends are found by the zeros; zeros inside texts become spaces beforehand
    keep = letters()[np.minimum(flat, 0x10FFFF)]
    zero = flat == 0
    out = np.where(keep | zero, flat, _SPACE)
    twice = np.zeros(len(out), bool)
    twice[1:] = (out[1:] == _SPACE) & (out[:-1] == _SPACE)
    out, zero = out[~twice], zero[~twice]
    starts = np.flatnonzero(zero[:-1] & ~zero[1:]) + 1 if len(out) else np.empty(0, np.int64)
    return out.astype(np.uint64), starts


def grams(chars: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n characters up to each place; the first n - 1 places are of no use."""
    h = np.zeros(len(chars), np.uint64)
    for j in range(n - 1, -1, -1):
        shifted = chars if j == 0 else np.concatenate([np.zeros(j, np.uint64), chars[:-j]])
        h = h * _K + shifted + np.uint64(1)
    return h ^ (h >> np.uint64(29))


@dataclass
class Model:
    """Sorted hashes per order with rows of log10 probabilities, and contexts with back-off weights."""

    languages: list[str]
    order: int = ORDER
    grams: list[np.ndarray] = field(default_factory=list)
    logs: list[np.ndarray] = field(default_factory=list)
    contexts: list[np.ndarray] = field(default_factory=list)
    weights: list[np.ndarray] = field(default_factory=list)
    unseen: np.ndarray | None = None
    sharpness: float = 50.0
    bounds: np.ndarray | None = None

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character of each text under each language, and its number of characters."""
        sums, count = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64)
        size, held = 0, []
        for i, t in enumerate(texts):
            if len(t) > STEP:
                self._add_long(i, t, sums, count)
                continue
            held.append((i, t.replace("\0", " ")))
            size += len(t)
            if size >= STEP:
                self._add(held, sums, count)
                held, size = [], 0
        if held:
            self._add(held, sums, count)
        return -sums / np.maximum(count, 1)[:, None], count

    def _add_long(self, i: int, text: str, sums: np.ndarray, count: np.ndarray) -> None:
        """A long text in steps; each knows the characters before it and counts only its own."""
        before = np.zeros(self.order - 1, np.uint64)
        for lo in range(0, len(text), STEP):
            own = characters([text[lo : lo + STEP].replace("\0", " ")], self.order)[0][self.order - 1 :]
            if before[-1] == _SPACE and len(own) and own[0] == _SPACE:
                own = own[1:]
            chars = np.concatenate([before, own])
            sums[i] += self.score(chars, np.arange(self.order - 1, len(chars))).sum(0, dtype=np.float64)
            count[i] += len(own)
            before = chars[len(chars) - self.order + 1 :]

    def _add(self, held: list[tuple[int, str]], sums: np.ndarray, count: np.ndarray) -> None:
        chars, _ = characters([t for _, t in held], self.order)
        real = chars > 0
        # which piece a character is of: pieces are apart by zeros
        piece = np.cumsum(np.concatenate([[False], ~real[:-1]]) & real & True) - 1 if len(chars) else np.empty(0, np.int64)
        owners = [i for i, t in held if t]
        take = np.flatnonzero(real)
        if not len(take):
            return
        logs = self.score(chars, take)
        doc = np.asarray(owners, np.int64)[piece[take]]
        for j in range(len(self.languages)):
            sums[:, j] += np.bincount(doc, logs[:, j], minlength=len(sums))
        count += np.bincount(doc, minlength=len(count))

    def score(self, chars: np.ndarray, take: np.ndarray) -> np.ndarray:
        """Log probabilities of the characters at `take`, one column per language."""
        out = np.zeros((len(take), len(self.languages)), np.float32)
        open_ = np.arange(len(take))
        for n in range(self.order, 0, -1):
            h = grams(chars, n)[take[open_]]
            at = np.minimum(np.searchsorted(self.grams[n - 1], h), len(self.grams[n - 1]) - 1)
            hit = self.grams[n - 1][at] == h
            out[open_[hit]] += self.logs[n - 1][at[hit]]
            open_ = open_[~hit]
            if not len(open_):
                return out
            if n > 1:  # the back-off weight of the context
                c = grams(chars, n - 1)[take[open_] - 1]
                at = np.minimum(np.searchsorted(self.contexts[n - 1], c), len(self.contexts[n - 1]) - 1)
                seen = self.contexts[n - 1][at] == c
                out[open_[seen]] += self.weights[n - 1][at[seen]]
        out[open_] += self.unseen
        return out


def fit(counts: dict[str, dict[str, int]], order: int = ORDER) -> Model:
    """counts: by language, the number of each string of `order` characters (zeros before a text's start)."""
    languages = sorted(counts)
    model = Model(languages, order, [None] * order, [None] * order, [None] * order, [None] * order)
    tables: list[list[dict[str, int]]] = []  # by language, by order
    for lang in languages:
        by_order: list[dict[str, int]] = [{}] * order
        by_order[order - 1] = counts[lang]
        for n in range(order - 1, 0, -1):  # how many characters come before a shorter one
            lower: dict[str, int] = {}
            for g in by_order[n]:
                if g[1:][-1] != "\0":
                    lower[g[1:]] = lower.get(g[1:], 0) + 1
            by_order[n - 1] = lower
        tables.append(by_order)
    alphabet = len({g for t in tables for g in t[0]}) + 1
    model.unseen = np.full(len(languages), -np.log10(alphabet), np.float32)
    lower_index, lower_p = {}, np.full((1, len(languages)), 1.0 / alphabet)
    for n in range(1, order + 1):
        union = sorted({g for t in tables for g in t[n - 1]})
        contexts = sorted({g[:-1] for g in union})
        where = {c: i for i, c in enumerate(contexts)}
        have = np.zeros((len(union), len(languages)))
        for j, t in enumerate(tables):
            have[:, j] = [t[n - 1].get(g, 0) for g in union]
        row = np.asarray([where[g[:-1]] for g in union], np.int64)
        total, kinds = np.zeros((len(contexts), len(languages))), np.zeros((len(contexts), len(languages)))
        np.add.at(total, row, have)
        np.add.at(kinds, row, have > 0)
        ones, twos = (have == 1).sum(0), (have == 2).sum(0)
        discount = np.where(ones + twos > 0, ones / np.maximum(ones + 2 * twos, 1), 0.5)
        discount = np.clip(discount, 0.1, 0.9)
        weight = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
        below = lower_p[[lower_index[g[1:]] for g in union]] if n > 1 else np.repeat(lower_p, len(union), 0)
        p = np.maximum(have - discount, 0) / np.maximum(total[row], 1) + weight[row] * below
        codes = np.asarray([[ord(ch) for ch in g] for g in union], np.uint64).reshape(len(union), n)
        h = _hash_rows(codes)
        order_ = np.argsort(h)
        model.grams[n - 1], model.logs[n - 1] = h[order_], np.log10(p[order_]).astype(np.float32)
        if n > 1:
            ch = _hash_rows(np.asarray([[ord(x) for x in c] for c in contexts], np.uint64).reshape(len(contexts), n - 1))
            order_ = np.argsort(ch)
            model.contexts[n - 1], model.weights[n - 1] = ch[order_], np.log10(np.maximum(weight[order_], 1e-9)).astype(np.float32)
        else:
            model.unseen = np.log10(np.maximum(weight[0] / alphabet, 1e-9)).astype(np.float32)
        lower_index, lower_p = {g: i for i, g in enumerate(union)}, p
    return model


def _hash_rows(codes: np.ndarray) -> np.ndarray:
    h = np.zeros(len(codes), np.uint64)
    for j in range(codes.shape[1]):
        h = h * _K + codes[:, j] + np.uint64(1)
    return h ^ (h >> np.uint64(29))


def _count(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, dict[str, int]] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = found.setdefault(lang, {})
                chars, _ = characters([text.replace("\0", " ")], order)
                s = "".join(map(chr, chars.tolist()))
                for i in range(order, len(s) + 1):
                    g = s[i - order : i]
                    own[g] = own.get(g, 0) + 1
        rows = [(lang, g, n) for lang, own in found.items() for g, n in own.items() if g[-1] != "\0"]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1].encode("utf-32-le") for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.int64())], names=["lang", "gram", "n"])

    return run


def learned_from(docs: DataFrame, per_language: int, most_languages: int = MOST_LANGUAGES) -> DataFrame:
    """lang, text, held: the documents of smallest id hash of each language, at most `per_language`, of the commonest languages.

    Each language is thinned out by its own count before anything is shuffled, to half as many again as are wanted. Every
    fourth document of a language is held out of the fit, and none of one with fewer than HOLD_FROM.
    """
    own = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("id").isNotNull()).withColumn("h", F.xxhash64("id")).withColumn("u", F.shiftrightunsigned("h", 32))
    counts = own.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages)
    limit = F.lit(float(1 << 32)) * F.lit(1.5 * (per_language + 50)) / F.col("n")
    thin = own.join(F.broadcast(counts), "lang").filter(F.col("u") < limit)
    ranked = thin.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("u", "h", "id", "text"))).filter(F.col("r") <= per_language)
    return ranked.select("lang", "text", ((F.col("r") % 4 == 0) & (F.col("n") >= HOLD_FROM)).alias("held"))


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model | None = shared.value
        for batch in sliced(batches):
            texts = [t or "" for t in batch.column(2).to_pylist()]
            n = len(texts)
            pred, score, cross, rejected = ["und"] * n, np.zeros(n), np.full(n, np.nan), np.zeros(n, bool)
            if model is not None and n:
                # letters decide whether a text has a language at all
                lettered = np.asarray([any(map(str.isalpha, t)) for t in texts])
                h, _ = model.entropies(texts)
                best = h.argmin(1)
                gap = h - h[np.arange(n), best][:, None]
                conf = 1.0 / np.exp(-np.minimum(gap * model.sharpness, 700)).sum(1)
                for i in np.flatnonzero(lettered):
                    pred[i], score[i], cross[i] = model.languages[best[i]], conf[i], h[i, best[i]]
                    rejected[i] = cross[i] > model.bounds[best[i]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pred), pa.array(score), pa.array([None if np.isnan(x) else x for x in cross], pa.float64()), pa.array(rejected)], names=["id", "held_out", "lang_pred", "score", "cross_entropy", "rejected"])

    return run


def _entropies(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            h, n = shared.value.entropies(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(h.astype(float)), pa.list_(pa.float64())), pa.array(n)], names=["lang", "h", "n"])

    return run


def trained(docs: DataFrame, per_language: int = PER_LANGUAGE, order: int = ORDER, reject: float = REJECT) -> Model | None:
    """docs: id, text, lang of documents to learn from. What comes to the driver is bounded by the sample."""
    spark = docs.sparkSession
    sample = cut(learned_from(docs, per_language))
    found = sample.filter("not held").select("lang", "text").mapInArrow(_count(order), "lang string, gram binary, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts: dict[str, dict[str, int]] = {}
    for r in found.toLocalIterator():
        counts.setdefault(r["lang"], {})[bytes(r["gram"]).decode("utf-32-le")] = r["n"]
    if not counts:
        return None
    model = fit(counts, order)
    shared = spark.sparkContext.broadcast(model)
    rows = [r for r in sample.filter("held").select("lang", "text").mapInArrow(_entropies(shared), "lang string, h array<double>, n long").collect() if r["n"]]
    shared.unpersist()
    calibrate(model, rows, reject)
    return model


def calibrate(model: Model, rows: list, reject: float) -> None:
    """Sharpness by likelihood of the held languages, and bounds that all but `reject` of them stay below."""
    known = [(model.languages.index(r["lang"]), np.asarray(r["h"])) for r in rows if r["lang"] in model.languages]
    model.bounds = np.full(len(model.languages), np.inf)
    if not known:
        return
    y, h = np.asarray([k for k, _ in known]), np.asarray([v for _, v in known])
    gap = h - h.min(1, keepdims=True)
    best = -np.inf
    for sharp in (1, 2, 5, 10, 20, 50, 100):
        like = (-gap[np.arange(len(y)), y] * sharp - np.log(np.exp(-np.minimum(gap * sharp, 700)).sum(1))).sum()
        if like > best + 1e-6:
            best, model.sharpness = like, float(sharp)
    for j in range(len(model.languages)):
        own = h[y == j, j]
        if len(own):
            model.bounds[j] = np.quantile(own, 1 - reject) + 3 * own.std()


def identify(df: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE, order: int = ORDER, fold: int = 2, folds: int = 4) -> DataFrame:
    """id, held_out, lang_pred, score, cross_entropy, rejected. Learns from documents outside the fold."""
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"), (crc_mod(id_col, folds) == fold).alias("held_out"))
    model = trained(docs.filter("not held_out").select("id", "text", "lang"), per_language, order)
    shared = df.sparkSession.sparkContext.broadcast(model)  # its size is bounded by the sample
    out = docs.select("id", "held_out", "text").mapInArrow(_predict(shared), "id long, held_out boolean, lang_pred string, score double, cross_entropy double, rejected boolean")
    return out.withColumnRenamed("id", id_col)
