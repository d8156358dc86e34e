"""Substring dedup over sliding spans of sentences.

A span is a run of consecutive sentences: from each sentence on, and up to each sentence, the shortest run of at
least `min_sentences` sentences with at least `min_words` words; a sentence of LONE_WORDS words or more is a span
by itself too. So every sentence inside a repeated run lies in a repeated span. Every span of every text is hashed to 128
bits and joined globally; the first place of a span (smallest id, then position) stays, and the
sentences that any other place covers are removed.

Spans are hashed once, in tasks of their own text, and stored; the global side is a grouped minimum with map-side
combine, and a join that keeps the places of a span which more than a thousandth of all places have out of the shuffle by
span, so a passage that a third of all documents share is spread over tasks. A sentence of LONE_WORDS words or more
goes as well where it repeats alone; shorter ones only within a run.

Defined results: null and empty texts have no sentences and stay as they are; a text with fewer words
than a span needs stays; rows with a null id stay whole and take no part; repeated rows of one id are
one document, and keep their first place; an empty table gives an empty result. Other columns pass.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlode.llm.common import sliced, spread_join, stored

MIN_SENTENCES, MIN_WORDS, LONE_WORDS = 2, 20, 20
#: A sentence runs to its stop or line end, with the space after it; sentences together are the whole text.
SENTENCE = re.compile(r"[^.!?\n]*(?:[.!?\n]+\s*|\Z)")
#: Odd multipliers of the two running hashes, and their inverses modulo 2**64.
BASES = [0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93]
INVERSES = [pow(b, -1, 1 << 64) for b in BASES]


def sentences(text: str) -> list[str]:
    return [s for s in SENTENCE.findall(text) if s]


def spans(text: str, min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (in sentences) of all spans of a text, and their hashes in two columns."""
    parts = [s.split() for s in sentences(text)]
    count = np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)])
    n = len(parts)
    at = np.arange(n)
    end = np.maximum(np.searchsorted(count, count[:-1] + min_words), at + min_sentences)
    start = np.minimum(np.searchsorted(count, count[1:] - min_words, side="right") - 1, at + 1 - min_sentences)
    lone = at[np.diff(count) >= max(LONE_WORDS, min_words)]
    start, end = np.concatenate([at[end <= n], start[start >= 0], lone]), np.concatenate([end[end <= n], at[start >= 0] + 1, lone + 1])
    start, end = np.divmod(np.unique(start * (n + 1) + end), n + 1)
    if not len(start):
        return start, end, np.empty((0, 2), np.int64)
    own = np.frombuffer(b"".join(xxhash.xxh3_128_digest(" ".join(p).lower()) for p in parts), dtype="<u8").reshape(n, 2)
    out = np.empty((len(start), 2), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(2):
            up = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, BASES[j], np.uint64)]))
            down = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, INVERSES[j], np.uint64)]))
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(own[:, j] * up[:-1])])
            mixed = (total[end] - total[start]) * down[start] + (end - start).astype(np.uint64)
            mixed ^= mixed >> np.uint64(31)
            out[:, j] = mixed * np.uint64(BASES[1 - j])
    return start, end, out.view(np.int64)


def _emit(min_sentences: int, min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = [(i, *spans(t, min_sentences, min_words)) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if t and i is not None]
            found = [x for x in found if len(x[1])]
            if found:
                key = np.concatenate([x[3] for x in found])
                yield pa.RecordBatch.from_pydict(
                    {
                        "h1": key[:, 0],
                        "h2": key[:, 1],
                        "id": np.repeat(np.array([x[0] for x in found], np.int64), [len(x[1]) for x in found]),
                        "s": np.concatenate([x[1] for x in found]).astype(np.int32),
                        "e": np.concatenate([x[2] for x in found]).astype(np.int32),
                    }
                )

    return run


def repeated(df: DataFrame, id_col: str, text: str, min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS) -> DataFrame:
    """id, s, e: the places of spans that are not the span's first."""
    places = df.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("t")).mapInArrow(_emit(min_sentences, min_words), "h1 long, h2 long, id long, s int, e int")
    places = stored(places, "spans")  # hashed once, read twice
    first = places.groupBy("h1", "h2").agg(F.min(F.struct("id", "s")).alias("f"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("h1", "h2", F.col("f.id").alias("fid"), F.col("f.s").alias("fs"), "n")
    return spread_join(places, first, ["h1", "h2"], "n").filter("id <> fid or s <> fs").select("id", "s", "e")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        names = batch.schema.names
        own, marks = batch.column(names.index("_text")), batch.column(names.index("_marks"))
        total, gone, kept = [], [], []
        for text, mark in zip(own.to_pylist(), marks.to_pylist(), strict=True):
            parts = sentences(text or "")
            out = np.zeros(len(parts) + 1, np.int64)
            for m in mark or []:
                if m["e"] <= len(parts):
                    out[m["s"]] += 1
                    out[m["e"]] -= 1
            drop = np.cumsum(out)[:-1] > 0
            total.append(len(parts))
            gone.append(int(drop.sum()))
            kept.append(text if not drop.any() else "".join(p for p, d in zip(parts, drop, strict=True) if not d))
        rest = [n for n in names if n not in ("_text", "_marks")]
        yield pa.RecordBatch.from_arrays([*(batch.column(names.index(n)) for n in rest), pa.array(total, pa.int32()), pa.array(gone, pa.int32()), pa.array(kept, pa.string())], names=[*rest, "n_sentences", "n_removed", "kept_text"])


def substring_dedup(df: DataFrame, id_col: str = "doc_id", text: str = "text", keep: list[str] | None = None, min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS) -> DataFrame:
    """id, the columns `keep`, n_sentences, n_removed, kept_text: the text without repeated sentences."""
    places = repeated(df, id_col, text, min_sentences, min_words)
    marks = places.groupBy("id").agg(F.collect_set(F.struct("s", "e")).alias("_marks"))
    rows = df.select(F.col(id_col).cast("long").alias("id"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep or [])], F.col(text).alias("_text"))
    # rows without an id have no marks, and keys of their own, so that they don't gather in one task
    rows = rows.withColumns({"_i": F.coalesce("id", F.lit(0)), "_n": F.when(F.col("id").isNull(), F.xxhash64("_text").bitwiseOR(F.lit(1).cast("long"))).otherwise(F.lit(0).cast("long"))})
    joined = rows.join(marks.select(F.col("id").alias("_i"), F.lit(0).cast("long").alias("_n"), "_marks"), ["_i", "_n"], "left").drop("_i", "_n")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema if f.name not in ("_text", "_marks"))
    out = joined.mapInArrow(_cut, kinds + ", n_sentences int, n_removed int, kept_text string")
    return out.withColumnsRenamed({"id": id_col} | {f"_k{i}": c for i, c in enumerate(keep or [])})
