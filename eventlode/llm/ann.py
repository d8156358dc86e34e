"""Approximate nearest neighbours by largest inner product, with a forest of random-projection trees.

Vectors are lengthened by sqrt(M**2 - |x|**2), M the largest norm, which makes the largest inner product
the smallest angle; queries get a zero. Trees are fitted on a bounded sample: each node splits its sample rows
at the median of their projections on a random direction through two of them. Every row of the table is
then routed to its leaf in each tree. A query takes leaves from all trees through one priority queue, nearest
cell first, until it has `leaves` of them; their number is set by measuring (calibrated), so that recall does not hang on how the
vectors lie. Leaves are dealt out to a fixed number of bundles, and queries meet the rows of their leaves in a join by bundle;
a bundle's rows are dealt out in blocks of bounded size, and each block answers with the best rows of all leaves that the query asks of
it only, by exact inner products in double precision. The best of a query's blocks are its result. So what a query is answered grows
with its leaves only until it asks something of every bundle.

Equal vectors are grouped first: ties go to the smaller id, so of one vector no more than the k + 1
smallest ids can be in any result, and a vector that many rows share weighs no more than those. Queries with equal
vectors are searched once.

Defined results: vectors that are null, empty, zero, of another length than most, or hold null or
non-finite components take no part; a query without candidates has no rows; rows repeating an id and vector
count once; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventlode.llm.common import cut

K, TREES, SAMPLE, LEAF, BLOCK, SEED = 20, 4, 40_000, 160, 4_000, 7
#: Groups that the leaves of all trees are dealt out to.
BUNDLES = 64
#: Vectors that the number of leaves is set by, and the share of their true neighbours that is to be found.
PROBES, RECALL = 64, 0.95


@dataclass
class Tree:
    """Inner nodes by number: a direction, a threshold, and children (>= 0 inner, < 0 a leaf, ~leaf)."""

    directions: np.ndarray
    cuts: np.ndarray
    left: np.ndarray
    right: np.ndarray


def grow(sample: np.ndarray, leaf: int, rng: np.random.Generator) -> Tree:
    """A tree over the sample; without a split there is one node whose children are the same leaf."""
    directions, cuts, left, right, leaves = [], [], [], [], 0
    todo: list[tuple[np.ndarray, int, int]] = [(np.arange(len(sample)), -1, 0)]
    while todo:
        rows, parent, side = todo.pop()
        number = None
        if len(rows) > leaf or parent < 0:
            a, b = sample[rng.choice(rows, 2, replace=len(rows) < 2)] if len(rows) else (np.ones(sample.shape[1]), np.zeros(sample.shape[1]))
            d = a - b
            if not np.any(d):
                d = rng.standard_normal(sample.shape[1])
            d = d / np.linalg.norm(d)
            p = sample[rows] @ d
            at = float(np.median(p)) if len(p) else 0.0
            low, high = rows[p <= at], rows[p > at]
            if (len(low) and len(high)) or parent < 0:
                number = len(cuts)
                directions.append(d)
                cuts.append(at)
                left.append(0)
                right.append(0)
                if len(low) and len(high):
                    todo += [(low, number, 0), (high, number, 1)]
                else:
                    left[number] = right[number] = ~leaves
                    leaves += 1
        if number is None:
            number = ~leaves
            leaves += 1
        if parent >= 0:
            (left if side == 0 else right)[parent] = number
    return Tree(np.asarray(directions), np.asarray(cuts), np.asarray(left), np.asarray(right))


def route(tree: Tree, x: np.ndarray) -> np.ndarray:
    """The leaf of each row."""
    at = np.zeros(len(x), np.int64)
    while True:
        open_ = np.flatnonzero(at >= 0)
        if not len(open_):
            return ~at
        node = at[open_]
        side = np.einsum("ij,ij->i", x[open_], tree.directions[node]) > tree.cuts[node]
        at[open_] = np.where(side, tree.right[node], tree.left[node])


def nearest_leaves(forest: list[Tree], q: np.ndarray, many: int) -> list[tuple[int, int]]:
    """(tree, leaf) pairs in order of their cells' squared distance (at least the sum over the splits on the other side), from one queue over all trees."""
    queue = [(0.0, t, 0) for t in range(len(forest))]
    found: list[tuple[int, int]] = []
    while queue and len(found) < many:
        margin, t, node = heapq.heappop(queue)
        tree = forest[t]
        while node >= 0:
            d = float(tree.directions[node] @ q) - float(tree.cuts[node])
            near, far = (tree.right[node], tree.left[node]) if d > 0 else (tree.left[node], tree.right[node])
            if near != far:
                heapq.heappush(queue, (margin + d * d, t, int(far)))
            node = int(near)
        found.append((t, ~node))
    return found


def _matrix(column: pa.Array, longer: float | None = None) -> np.ndarray:
    """Rows of a list column; with `longer` each gets the component that makes its norm that."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))
    if longer is None:
        return x
    return np.hstack([x, np.sqrt(np.maximum(longer**2 - (x**2).sum(1), 0))[:, None]])


def _place(shared, norm: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), norm)
            for t, tree in enumerate(shared.value):
                n = batch.num_rows
                if n:
                    leaf = route(tree, x) * len(shared.value) + t
                    yield pa.RecordBatch.from_arrays([pa.array((leaf % BUNDLES).astype(np.int32)), pa.array(leaf), batch.column(0), batch.column(1)], names=["bundle", "leaf", "v", "vec"])

    return run


def _ask(shared, norm: float, leaves: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = np.hstack([_matrix(batch.column(1)), np.zeros((batch.num_rows, 1))]) if batch.num_rows else []
            asked: dict[tuple[int, int], list[int]] = {}
            for i, row in enumerate(q):
                for t, leaf in nearest_leaves(shared.value, row * (norm / np.linalg.norm(row)), leaves):
                    number = leaf * len(shared.value) + t
                    asked.setdefault((i, number % BUNDLES), []).append(number)
            if asked:
                i, bundle = (np.asarray(c, np.int64) for c in zip(*asked, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(bundle.astype(np.int32)), pa.array(list(asked.values()), pa.list_(pa.int64())), batch.column(0).take(pa.array(i)), batch.column(1).take(pa.array(i))], names=["bundle", "leaves", "q", "vec"])

    return run


def _best(k: int):
    def run(key: tuple, queries: pa.Table, rows: pa.Table) -> pa.Table:
        out_q, out_v, out_s = [], [], []
        if queries.num_rows and rows.num_rows:
            leaf = rows["leaf"].to_numpy()
            order = np.argsort(leaf, kind="stable")
            leaf, v, x = leaf[order], rows["v"].to_numpy()[order], _matrix(rows["vec"].combine_chunks())[order]
            q, ids = _matrix(queries["vec"].combine_chunks()), queries["q"].to_numpy()
            for i, own in enumerate(queries["leaves"].to_pylist()):
                ends = zip(np.searchsorted(leaf, own), np.searchsorted(leaf, own, "right"), strict=True)
                met = np.concatenate([np.arange(a, b) for a, b in ends])
                met = met[np.unique(v[met], return_index=True)[1]]  # a row lies in a leaf of each tree
                s = x[met] @ q[i]
                # all that reach the k-th score stay, so that ties are settled by id later
                top = np.flatnonzero(s >= np.partition(s, -k)[-k]) if len(s) > k else np.arange(len(s))
                out_q.append(np.full(len(top), ids[i]))
                out_v.append(v[met[top]])
                out_s.append(s[top])
        cat = lambda a, t: np.concatenate(a) if a else np.empty(0, t)
        return pa.table({"q": cat(out_q, np.int64), "v": cat(out_v, np.int64), "s": cat(out_s, np.float64)})

    return run


def _true(shared, k: int):
    """The k nearest rows of each probe within a task, by brute force."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = shared.value
        best_s, best_v = np.full((len(q), k), -np.inf), np.full((len(q), k), -1, np.int64)
        for batch in batches:
            if batch.num_rows:
                v = batch.column(0).to_numpy()
                s = np.where(ids[:, None] == v[None, :], -np.inf, q @ _matrix(batch.column(1)).T)
                s, v = np.hstack([best_s, s]), np.hstack([best_v, np.broadcast_to(v, (len(q), len(v)))])
                at = np.argpartition(-s, k - 1, axis=1)[:, :k]
                best_s, best_v = np.take_along_axis(s, at, 1), np.take_along_axis(v, at, 1)
        i, j = np.nonzero(best_v >= 0)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(best_v[i, j]), pa.array(best_s[i, j])], names=["p", "v", "s"])

    return run


def calibrated(reps: DataFrame, forest: list[Tree], norm: float, k: int, probes: int, recall: float, seed: int) -> tuple[int, float]:
    """How many leaves a query must visit: the fewest that find `recall` of the true neighbours of the probes, which are
    `probes` rows by hash; and the recall. The truth comes from one pass over all rows against the probes; what reaches the
    driver are probes and their neighbours. Vectors in clusters need few leaves, random ones most."""
    spark = reps.sparkSession
    rows = reps.orderBy(F.xxhash64("v", F.lit(seed + 1)), "v").limit(probes).collect()
    ids, q = np.asarray([r["v"] for r in rows], np.int64), np.asarray([r["vec"] for r in rows], np.float64)
    shared = spark.sparkContext.broadcast((ids, q))
    order = Window.partitionBy("p").orderBy(F.desc("s"), "v")
    true = reps.select("v", "vec").mapInArrow(_true(shared, k), "p int, v long, s double").withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k)
    found = true.join(reps, "v").select("p", "vec").collect()  # probes * k rows
    leaves = sum(int(max(-min(t.left), -min(t.right))) for t in forest)
    if not found:
        return leaves, 1.0
    x = np.asarray([r["vec"] for r in found], np.float64)
    x = np.hstack([x, np.sqrt(np.maximum(norm**2 - (x**2).sum(1), 0))[:, None]])
    at = np.stack([route(t, x) for t in forest], axis=1)
    owner = np.asarray([r["p"] for r in found])
    rank = np.zeros(len(found), np.int64)
    for p in np.unique(owner):
        places = {pair: i for i, pair in enumerate(nearest_leaves(forest, np.append(q[p] / np.linalg.norm(q[p]), 0.0) * norm, leaves))}
        for i in np.flatnonzero(owner == p):
            rank[i] = min(places[t, int(leaf)] for t, leaf in enumerate(at[i]))
    need = int(np.sort(rank)[max(0, int(np.ceil(recall * len(rank))) - 1)]) + 1
    return need, float((rank < need).mean())


def _usable(df: DataFrame, id_col: str, vec: str) -> DataFrame:
    """id, vec (array of doubles) of the rows that take part; lengths other than the commonest are left out."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("vec")).filter("id is not null and vec is not null and size(vec) > 0")
    good = rows.filter(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))).filter(F.exists("vec", lambda x: x != 0))
    return good


def nearest(df: DataFrame, id_col: str = "vec_id", vec: str = "embedding", every: int = 20, k: int = K, trees: int = TREES, sample_rows: int = SAMPLE, leaf_rows: int = LEAF, leaves: int | None = None, block_rows: int = BLOCK, seed: int = SEED) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by `every`, its k nearest other rows found."""
    spark = df.sparkSession
    usable = _usable(df, id_col, vec)
    sizes = usable.groupBy(F.size("vec").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)).alias("m"))
    most = sizes.orderBy(F.desc("n"), "d").first()
    if most is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    usable = usable.filter(F.size("vec") == most["d"])
    norm = float(np.sqrt(most["m"]))
    # one row per different vector, with its k + 1 smallest ids; the limit by rank is applied before the shuffle too
    usable = usable.distinct()
    order = Window.partitionBy("vec").orderBy("id")
    few = cut(usable.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k + 1))
    reps = few.filter("r = 1").select("vec", F.col("id").alias("v"))
    queries = cut(usable.filter(F.col("id") % every == 0).join(reps, "vec").select(F.col("v").alias("q"), F.col("id").alias("query_id")))
    share = min(1.0, 1.2 * sample_rows / max(1, most["n"]))
    drawn = reps.filter(F.pmod(F.xxhash64("v", F.lit(seed)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).orderBy(F.xxhash64("v", F.lit(seed))).limit(sample_rows).select("vec")
    rng = np.random.default_rng(seed)
    x = np.asarray([r["vec"] for r in drawn.toLocalIterator()], np.float64).reshape(-1, most["d"])  # bounded by sample_rows
    x = np.hstack([x, np.sqrt(np.maximum(norm**2 - (x**2).sum(1), 0))[:, None]])
    forest = [grow(x, leaf_rows, rng) for _ in range(trees)]
    if leaves is None:
        leaves, _ = calibrated(reps, forest, norm, k, PROBES, RECALL, seed)
    shared = spark.sparkContext.broadcast(forest)
    rows = cut(reps.select("v", "vec").mapInArrow(_place(shared, norm), "bundle int, leaf long, v long, vec array<double>"))
    asked = reps.join(queries.select(F.col("q").alias("v")).distinct(), "v").select(F.col("v").alias("q"), "vec")
    asks = asked.mapInArrow(_ask(shared, norm, leaves), "bundle int, leaves array<long>, q long, vec array<double>")
    # bundles in blocks: rows go to one block, queries to all blocks of the bundle
    blocks = rows.groupBy("bundle").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("blocks"))
    asks = asks.join(blocks, "bundle").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("bundle", "block", "leaves", "q", "vec")
    rows = rows.join(blocks, "bundle").withColumn("block", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int")).select("bundle", "block", "leaf", "v", "vec")
    found = asks.groupBy("bundle", "block").cogroup(rows.groupBy("bundle", "block")).applyInArrow(_best(k + 1), "q long, v long, s double")
    best = found.groupBy("q", "v").agg(F.max("s").alias("s"))
    # the k + 1 best vectors of a query vector hold the k best rows of each query
    top = best.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "v"))).filter(F.col("r") <= k + 1).select("q", "v", "s")
    same = few.join(reps, "vec").select("v", F.col("id").alias("vec_id"))
    wide = top.join(same, "v").withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "vec_id"))).filter(F.col("r") <= k + 1)
    pairs = wide.join(queries, "q").filter("query_id <> vec_id")
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("s"), "vec_id"))).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", F.col("s").alias("score"))
