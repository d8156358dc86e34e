"""Nearest neighbours, WARC archives, and the pipeline."""

import hashlib
import math

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from eventlode.llm import ann, warc

VEC = "vec_id long, embedding array<float>, label int, v string"


def test_neighbours_are_found(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((1500, 16)).astype(np.float32)
    x[100:400] = x[100]  # a vector that many rows share
    rows = [(i, [float(f) for f in v], 0, "z") for i, v in enumerate(x)]
    odd = [(2000, None, 0, "z"), (2020, [0.0] * 16, 0, "z"), (2040, [float("nan")] * 16, 0, "z"), (2060, [None] * 16, 0, "z"), (None, rows[5][1], 0, "z"), (2080, [1.0, 2.0], 0, "z"), rows[60]]
    out = ann.nearest(spark.createDataFrame(rows + odd, VEC), sample_rows=800, leaf_rows=60, leaves=60, block_rows=200).toPandas()
    s = x.astype(float) @ x.astype(float).T
    hits = 0
    for q in range(0, 1500, 20):
        own = out[out.query_id == q].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 21)) and q not in set(own.vec_id)
        order = [int(i) for i in np.lexsort((np.arange(1500), -s[q].round(12))) if i != q][:20]
        hits += len(set(order) & set(own.vec_id))
        assert np.allclose(own.score, s[q][own.vec_id.to_numpy()], atol=1e-9) and (np.diff(own.score) <= 1e-12).all()
        if 100 <= q < 400:
            assert own.vec_id.tolist() == order
    assert hits >= 0.9 * 20 * 75 and set(out.query_id) == set(range(0, 1500, 20))


def test_vectors_in_clusters_need_few_leaves(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((60, 24)) * 3
    x = (centres[rng.integers(0, 60, 4000)] + rng.standard_normal((4000, 24)) * 0.3).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    rows = spark.createDataFrame([(i, [float(f) for f in v], 0, "z") for i, v in enumerate(x)], VEC)
    forest = [ann.grow(np.hstack([x.astype(float), np.zeros((4000, 1))]), 40, np.random.default_rng(t)) for t in range(4)]
    total = sum(int(max(-min(t.left), -min(t.right))) for t in forest)
    need, recall = ann.calibrated(rows.select(ann.F.col("vec_id").alias("v"), ann.F.col("embedding").cast("array<double>").alias("vec")), forest, 1.0, 20, 64, 0.95, 7)
    assert need < 0.1 * total and recall >= 0.95  # most leaves stay unvisited
    out = ann.nearest(rows, leaf_rows=40).toPandas()
    s = x.astype(float) @ x.astype(float).T
    found = sum(len((set(np.lexsort((np.arange(4000), -s[q]))[:21].tolist()) - {q}) & set(g.vec_id)) for q, g in out.groupby("query_id"))
    assert out.query_id.nunique() == 200 and found >= 0.9 * 20 * 200


def test_neighbours_of_few(spark):
    out = ann.nearest(spark.createDataFrame([(0, [1.0, 0.0], 0, ""), (1, [0.0, 1.0], 0, ""), (20, [1.0, 0.0], 0, "")], VEC)).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in out) == [(0, 1, 20, 1.0), (0, 2, 1, 0.0), (20, 1, 0, 1.0), (20, 2, 1, 0.0)]
    assert ann.nearest(spark.createDataFrame([], VEC)).count() == 0


def test_archives_come_back(spark, tmp_path):
    big = "é<p>" * 300_000
    rows = [(1, "http://a", "x" * 999), (2, "http://b", "x" * 999), (3, None, "y" * 1000), (4, "u\r\nv", "y" * 1000), (9, "", "y" * 1000), (5, "h", None), (6, "h", ""), (7, "h", big), (8, "h", big), (None, "h", "n" * 1000), (10, "h", "n" * 1000)]
    pages = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, k int").repartition(3)
    manifest = warc.write_warc(pages, str(tmp_path / "w"), chunk_bytes=70_000)
    chunks = warc.read_warc(manifest, chunk_bytes=50_000)
    got = {r.page_id: r for r in warc.page_digests(chunks).collect()}
    for page, _, html in rows:
        raw, r = (html or "").encode(), got[page]
        assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
        assert (r.record_type, r.refers_to) == {3: ("revisit", 9), 4: ("revisit", 9), 7: ("revisit", 8)}.get(page, ("response", None))
    parts = sorted((r.chunk_no, bytes(r.data)) for r in chunks.filter("page_id = 8").collect())
    assert b"".join(d for _, d in parts) == big.encode() and len(parts) == math.ceil(len(big.encode()) / 50_000)
    assert chunks.filter("is_last and record_type = 'response' and declared_sha1 <> sha1_so_far").count() == 0
    empty = warc.write_warc(pages.filter("page_id < 0"), str(tmp_path / "e"))
    assert empty.count() == 0 and warc.read_warc(empty).count() == 0


def test_an_id_with_several_payloads(spark, tmp_path):
    a, b = "a" * 2000, "b" * 1500
    pages = spark.createDataFrame([(5, "u", a, "x"), (5, "u", b, "x"), (9, "u", a, "x"), (9, "u", "small", "x"), (9, "u", a, "x"), (7, "u", b, "x")], "page_id long, url string, html string, sha1 string")
    got = sorted(tuple(r) for r in warc.page_digests(warc.read_warc(warc.write_warc(pages, str(tmp_path / "w")))).collect())
    sha = lambda t: hashlib.sha1(t.encode()).hexdigest()
    want = [(5, 2000, sha(a), "revisit", 9), (5, 1500, sha(b), "revisit", 7), (7, 1500, sha(b), "response", None), (9, 5, sha("small"), "response", None)] + [(9, 2000, sha(a), "response", None)] * 2
    assert got == sorted(want)


ODD = [(1, None, "en", "a"), (2, "", "en", "a"), (None, "no id here", None, None), (3, "w " * 30_000, "en", "b"), (4, "one two three four five six seven", None, None), (4, "one two three four five six seven", None, None), (5, "\x00 \ud7ff é " * 30, "fr", "")]


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_stages_bear_odd_rows(spark, sf, docs, stage):
    odd = docs(ODD)  # with columns whose names may clash
    out = stage(spark, odd, sf)
    ids = [r.doc_id for r in out.collect()]
    assert set(ids) <= {1, 2, 3, 4, 5, None}
    if stage is not corpus_pipeline.packing_stage:
        assert out.columns == corpus_pipeline.COLUMNS
    if stage is corpus_pipeline.mixing_stage:
        assert len(ids) == len(ODD)
    if stage is corpus_pipeline.near_duplicate_stage:
        assert len(ids) == len(ODD)  # of rows that repeat an id all stay or go
    assert stage(spark, odd.filter("doc_id > 99"), sf).count() == 0


def test_pipeline_applies_its_stages_in_turn(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.count()
    seen = [before]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.cut(stage(spark, docs, sf))
        assert docs.columns == columns
        seen.append(docs.count())
    assert seen[0] > seen[1] > seen[2] >= seen[3] == seen[4] > 0.5 * before
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf).toPandas()
    assert set(pieces.doc_id) == {r.doc_id for r in docs.collect()}
    assert pieces.groupby("sequence_id").length.sum().max() <= 1024


def test_a_block_answers_with_the_best_of_all_leaves_asked_of_it():
    """One answer of k rows per query and block, whatever the number of leaves; before, each leaf gave its own."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((400, 8))
    rows = pa.table({"leaf": np.concatenate([np.repeat(np.arange(10), 40), np.tile(np.arange(10, 20), 40)]), "v": np.tile(np.arange(400), 2), "vec": pa.array([*x.tolist(), *x.tolist()])})
    asked = [[0, 3, 7, 12], [5], [99]]
    queries = pa.table({"leaves": pa.array(asked, pa.list_(pa.int64())), "q": [0, 1, 2], "vec": pa.array(rng.standard_normal((3, 8)).tolist())})
    out = ann._best(6)((0, 0), queries, rows).to_pylist()
    leaf, v = rows["leaf"].to_numpy(), rows["v"].to_numpy()
    for i, own in enumerate(asked):
        scores = {int(c): float(x[c] @ np.asarray(queries["vec"][i].as_py())) for c in v[np.isin(leaf, own)]}
        assert {r["v"] for r in out if r["q"] == i} == set(sorted(scores, key=scores.get)[-6:])
    assert len(out) == 12
