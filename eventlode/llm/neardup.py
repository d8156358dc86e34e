"""Near-duplicate documents by order MinHash, verified by banded alignment.

A document is the sequence of its five-word shingles, each labelled with its occurrence number, so no
label occurs twice in it. A sketch takes the three labelled shingles of smallest hash under one hash
function and keeps them in text order; it agrees for two documents if they share these shingles in the
same order. Twenty sketches, each a bucket key of its own, find a pair of similarity 0.8 with a chance of
1 - (1 - 0.8**3)**20, over 0.999999.

Two documents are linked if the best alignment of their shingles matches M of n1 and n2 with
M / (n1 + n2 - M) >= 0.8. As labels are unique, that alignment is the longest increasing chain of common
labels; a pair that is similar enough stays within a band of (n1 + n2) / 9 around the diagonal, so
only matches in the band count. Classes are the connected components of the links.

Equal texts are grouped first, by a 128-bit digest of their words, and one document stands for each group.
Buckets are stars: each member is compared with the bucket's leader, the document that meets most others in all its
buckets, and linked documents form classes. What the leaders leave open is done exactly: the documents of buckets that
still hold several classes are joined by the rarest of their shingles. Two texts of similarity s share one of
the first n - s * n + 1 shingles in any common order, and of the shorter text n - 2 * s / (1 + s) * n + 1 are enough; the
order is by the counts of shingles in BINS bins, so a passage that many documents share comes last and brings nobody
together who does not consist of it. All pairs of different classes that meet there, and whose lengths and the places of
the shingle in their orders allow the similarity, are compared. No bucket is collected in one task, and pairs within a class are not made.

Defined results: texts are lower-cased and split at white space; one of fewer than five words is one shingle;
one without words (null, empty) is a class of its own; a null id has a null class; of rows that repeat an id the one
of smallest text counts; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlode.llm.common import cut, sliced, spread_join, stored
from eventlode.llm.graph import components
from eventlode.llm.hashing import LOWER, mixed, stepped, word_hashes

WORDS, SIMILARITY, SKETCHES, TAKEN = 5, 0.8, 20, 3
#: Bins of shingle counts.
BINS = 1 << 18
#: Shingles from which on a text's sketches are taken one by one.
MANY = 1 << 16
_SEEDS = mixed(np.arange(1, SKETCHES + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))


def _bytes(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "surrogatepass")


def labelled(words: np.ndarray, k: int = WORDS) -> np.ndarray:
    """Hashes of the k-word shingles with their occurrence numbers; all of one document are different."""
    n = len(words)
    if n == 0:
        return words
    if n < k:
        words, n, k = np.concatenate([words, np.zeros(k - n, np.uint64)]), k, k
    h = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        h = h * np.uint64(0xD6E8FEB86659FD93) + words[j : n - k + 1 + j]
    h = mixed(h)
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.concatenate([[True], s[1:] != s[:-1]])
    if not new.all():
        at = np.arange(len(s))
        label = np.empty(len(s), np.uint64)
        label[order] = at - np.maximum.accumulate(np.where(new, at, 0))
        h = np.where(label > 0, mixed(h + label * np.uint64(0x9E3779B97F4A7C15)), h)
    return h


def sketch(kmers: np.ndarray, seeds: np.ndarray = _SEEDS, taken: int = TAKEN) -> np.ndarray:
    """One hash per sketch: its smallest labelled shingles, in text order."""
    n = len(kmers)
    if n > MANY and len(seeds) > 1:  # a long text goes seed by seed, so that memory is a small multiple of it
        return np.concatenate([sketch(kmers, seeds[i : i + 1], taken) for i in range(len(seeds))])
    take = min(taken, n)
    v = kmers[None, :] ^ seeds[:, None]
    v *= np.uint64(0xBF58476D1CE4E5B9)
    v ^= v >> np.uint64(29)
    at = np.argpartition(v, take - 1, axis=1)[:, :take] if n > take else np.broadcast_to(np.arange(n), (len(seeds), n))
    at = np.sort(at, axis=1)
    out = np.zeros(len(seeds), np.uint64)
    for j in range(take):
        out = out * np.uint64(0xD6E8FEB86659FD93) + kmers[at[:, j]]
    return mixed(out + seeds)


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """M / (n1 + n2 - M) of the banded alignment; 0 where it can't reach `least`."""
    total = len(a) + len(b)
    need = int(np.ceil(least * total / (1 + least) - 1e-9))
    if min(len(a), len(b)) < need or not total:
        return 0.0
    _, pa_, pb_ = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    near = np.abs(pa_ - pb_) <= total - 2 * need + 1
    pa_, pb_ = pa_[near], pb_[near]
    if len(pa_) < need:
        return 0.0
    chain = pb_[np.argsort(pa_)]
    if np.all(chain[1:] > chain[:-1]):
        m = len(chain)
    else:
        tails: list[int] = []
        for x in chain.tolist():
            i = bisect_left(tails, x)
            if i == len(tails):
                tails.append(x)
            else:
                tails[i] = x
        m = len(tails)
    return m / (total - m)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        ids, texts = batch.column(0), batch.column(1)
        raw = [_bytes(t) for t in texts.to_pylist()]
        for lo, hi in stepped(raw):
            h, counts = word_hashes(raw[lo:hi])
            at = np.concatenate([[0], np.cumsum(counts)])
            d = np.zeros((hi - lo, 2), np.uint64)
            keys = np.zeros((hi - lo, SKETCHES), np.uint64)
            for i in np.flatnonzero(counts):
                w = h[at[i] : at[i + 1]]
                place = np.arange(1, len(w) + 1, dtype=np.uint64)
                d[i] = mixed(w + place * np.uint64(0x9E3779B97F4A7C15)).sum(), mixed(w * np.uint64(0xC2B2AE3D27D4EB4F) + place).sum()
                keys[i] = sketch(labelled(w))
            flat = pa.array(keys.view(np.int64).ravel())
            yield pa.RecordBatch.from_arrays(
                [ids.slice(lo, hi - lo), pa.array(counts.astype(np.int64)), pa.array(d[:, 0].view(np.int64)), pa.array(d[:, 1].view(np.int64)), pa.FixedSizeListArray.from_arrays(flat, SKETCHES).cast(pa.list_(pa.int64()))],
                names=["id", "n_words", "d1", "d2", "keys"],
            )


def _bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(BINS, np.int64)
    for batch in sliced(batches):
        for text in batch.column(0):
            counts += np.bincount((labelled(word_hashes([_bytes(text.as_py())])[0]) % np.uint64(BINS)).astype(np.int64), minlength=BINS)
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["bin", "n"])


def prefixes(n: int, least: float) -> tuple[int, int]:
    """How many of n ordered shingles a text of no more shingles, and one of no fewer, must share one of."""
    return n - int(np.ceil(least * n - 1e-9)) + 1, n - int(np.ceil(2 * least / (1 + least) * n - 1e-9)) + 1


def _rarest(shared, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            for i, n, c, text in zip(*[batch.column(j).to_pylist() for j in range(3)], batch.column(3), strict=True):
                h = labelled(word_hashes([_bytes(text.as_py())])[0])
                h = h[np.lexsort((h, shared.value[(h % np.uint64(BINS)).astype(np.int64)]))]
                longer, shorter = prefixes(len(h), least)
                yield pa.RecordBatch.from_arrays([pa.array(h[:longer].view(np.int64)), pa.array([c] * longer, pa.int64()), pa.array([i] * longer, pa.int64()), pa.array([n] * longer, pa.int64()), pa.array(np.arange(longer)), pa.array(np.arange(longer) < shorter)], names=["k", "c", "id", "n", "p", "shorter"])

    return run


def _verify(least: float):
    def shingles(text: str) -> np.ndarray:
        return labelled(word_hashes([_bytes(text)])[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, lead = None, np.empty(0, np.uint64)
        for batch in sliced(batches):
            out = []
            for b, ta, tb in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if b != last:
                    last, lead = b, shingles(tb.as_py())
                ta = ta.as_py()
                out.append(similarity(shingles(ta), lead, least) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.bool_())], names=["a", "b", "linked"])

    return run


def _members(keys: DataFrame) -> DataFrame:
    """keys: k1, k2 (the bucket), id, n (its shingles). Those of shared buckets, with the document's weight: all it meets in its buckets."""
    size = keys.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    shared = keys.join(size, ["k1", "k2"])
    return cut(shared.join(shared.groupBy("id").agg(F.sum("size").alias("weight")), "id").select("k1", "k2", "id", "n", "weight"))


def _leaders(m: DataFrame) -> DataFrame:
    """Per bucket the document that meets most others in all its buckets."""
    best = F.max(F.struct("weight", (-F.col("id")).alias("o"), F.col("n").alias("nb"))).alias("l")
    return m.groupBy("k1", "k2").agg(best).select("k1", "k2", (-F.col("l.o")).alias("b"), "l.nb")


def _fits(least: float) -> Column:
    """False where the lengths n and nb alone exclude the similarity."""
    return F.least("n", "nb") >= F.lit(least) * F.greatest("n", "nb") - F.lit(1e-6)


def _stars(m: DataFrame, lead: DataFrame, least: float) -> DataFrame:
    """a, b: members with their bucket's leader."""
    return m.join(lead, ["k1", "k2"]).filter((F.col("id") != F.col("b")) & _fits(least)).select(F.col("id").alias("a"), "b").distinct()


def _mixed(m: DataFrame, classes: DataFrame) -> DataFrame:
    """id, n, c: the documents of buckets of several classes, with their class."""
    own = m.join(classes, "id", "left").withColumn("c", F.coalesce("class_id", "id")).select("k1", "k2", "id", "n", "c")
    several = own.groupBy("k1", "k2").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("k1", "k2")
    return cut(own.join(several, ["k1", "k2"]).select("id", "n", "c").distinct())


def _rare_pairs(docs: DataFrame, rest: DataFrame, least: float) -> DataFrame:
    """a, b: all pairs of different classes among rest (id, n, c) that may be similar enough, by their rarest shingles."""
    texts = stored(docs.join(rest, "id").select("id", "n", "c", "text"), "mixed")
    counts = texts.select("text").mapInArrow(_bins, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n"))
    found, total = counts.toArrow(), np.zeros(BINS, np.int64)  # BINS rows at most
    total[found["bin"].to_numpy()] = found["n"].to_numpy()
    rare = stored(texts.mapInArrow(_rarest(docs.sparkSession.sparkContext.broadcast(total), least), "k long, c long, id long, n long, p long, shorter boolean"), "rare")
    several = rare.groupBy("k").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("k")
    shorter = rare.filter("shorter")
    groups = shorter.groupBy("k", "c").agg(F.min("n").alias("least_n"), F.max("n").alias("most_n")).join(several, "k")
    one = shorter.select("k", "c", F.col("id").alias("a"), "n", "p")
    other = rare.select("k", F.col("c").alias("cb"), F.col("id").alias("b"), F.col("n").alias("nb"), F.col("p").alias("pb"))
    # the first shingle that two texts share leaves room for all that they must share; any later one leaves less
    must = least / (1 + least)
    room = F.least(F.col("n") - F.col("p"), F.col("nb") - F.col("pb")) >= F.ceil(F.lit(must) * (F.col("n") + F.col("nb")) - F.lit(1e-6))
    # so a longer text bounds the length of the shorter one, and classes without such a member are not met at all
    bound = F.least(F.col("nb"), F.floor((F.col("nb") - F.col("pb") + F.lit(1e-6)) / F.lit(must)) - F.col("nb"))
    near = groups.join(other, "k").filter((F.col("c") != F.col("cb")) & (F.col("least_n") <= bound) & (F.col("most_n") >= F.lit(least) * F.col("nb") - F.lit(1e-6)))
    met = near.select("k", "c", "b", "nb", "pb").join(one, ["k", "c"]).filter("n < nb or n = nb and a < b").filter(_fits(least)).filter(room)
    return met.select("a", "b").distinct()


def _links(keys: DataFrame, docs: DataFrame, least: float) -> DataFrame:
    """a, b: links whose components are those of all links. keys: k1, k2, id, n of documents that stand for their copies."""
    members = _members(keys)
    pairs = cut(_stars(members, _leaders(members), least))
    found = _verified(pairs, _texts(docs, pairs), least)
    links = found.filter("linked").select("a", "b")
    rest = _mixed(members, components(links))
    if rest.isEmpty():
        return links
    done = found.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
    met = _rare_pairs(docs, rest, least).withColumns({"x": F.least("a", "b"), "y": F.greatest("a", "b")})
    pairs = cut(met.join(done, ["x", "y"], "left_anti").select("a", "b"))
    return links.union(_verified(pairs, _texts(docs, pairs), least).filter("linked").select("a", "b"))


def _verified(pairs: DataFrame, docs: DataFrame, least: float) -> DataFrame:
    """pairs: a, b, distinct. Adds linked."""
    both = pairs.join(docs.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(docs.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    return cut(both.select("a", "b", "ta", "tb").mapInArrow(_verify(least), "a long, b long, linked boolean"))


def _texts(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    wanted = pairs.select("a").union(pairs.select(F.col("b").alias("a"))).distinct().withColumnRenamed("a", "id")
    return docs.join(wanted, "id", "left_semi")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """id, class_id (smallest id of the class): one row for each different id."""
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    sketched = lambda d: cut(d.mapInArrow(_sketches, "id long, n_words long, d1 long, d2 long, keys array<long>"))
    rows = sketched(docs)
    if not rows.filter("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        docs = docs.groupBy("id").agg(F.min("text").alias("text"))
        rows = sketched(docs)
    full = rows.filter("n_words > 0 and id is not null")
    groups = cut(full.groupBy("d1", "d2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")))
    reps = full.join(groups.select(F.col("rep").alias("id")), "id", "left_semi").select("id", F.greatest(F.col("n_words") - (WORDS - 1), F.lit(1)).alias("n"), "keys")
    keys = reps.select("id", "n", F.posexplode("keys").alias("j", "k1")).select("k1", F.col("j").cast("long").alias("k2"), "id", "n").distinct()
    classes = components(_links(keys, docs, least)).select(F.col("id").alias("rep"), "class_id")
    # copies take the class of the document that stands for them; the smallest id of a component is one of these
    named = groups.join(classes, "rep", "left").select("d1", "d2", F.coalesce("class_id", "rep").alias("class_id"), "n")
    found = spread_join(full.select("id", "d1", "d2"), named, ["d1", "d2"], "n").select("id", "class_id")
    others = rows.filter("n_words = 0 or id is null").select("id").distinct()
    return found.union(others.select("id", F.col("id").alias("class_id"))).withColumnRenamed("id", id_col)
