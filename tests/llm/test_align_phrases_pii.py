"""Token alignment, collocations and personal data against slow versions, and language identification of empty batches."""

import hashlib
import random
import re
import tracemalloc
from bisect import bisect_right
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from eventlode.llm import align, collocations, common, langid, pii
from eventlode.llm.registry import tokenizer_path
from tests.oracle_check import assert_same, connected

A, B = tokenizer_path(), tokenizer_path("piece_bpe_32k.model")
ODD = [None, "", " ", "  ", "\n", "\n\n a", "x", " x ", "a,b. c;d", "tab\there", "no\xa0break  two", "mark ▁ here", "<s> and </s> <|endoftext|>", "日本 語 🙂", "it's, isn't", "a .b ,,c", "\x00 nul", "é" * 3000, "word, " * 2000]


def _aligned(pair, text):
    if not text:
        return None
    raw = (" " + text).encode()
    ids = pair.a.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text)
    told = [[pair.bytes_a[i] for i in ids[0]], [pair.bytes_b[i] for i in ids[1]]]
    if any(b"".join(t) != raw for t in told):
        return None
    ends = [np.cumsum([len(x) for x in t]).tolist() for t in told]
    groups, links, i, j = [], [], 0, 0
    for end in sorted(set(ends[0]) & set(ends[1])):
        p, q = bisect_right(ends[0], end), bisect_right(ends[1], end)
        groups.append(",".join(map(str, ids[0][i:p])) + "|" + ",".join(map(str, ids[1][j:q])))
        links.append((ids[0][p - 1], ids[1][q - 1]))
        i, j = p, q
    return *map(len, ids), hashlib.sha256(";".join(groups).encode()).hexdigest(), links


def _random_texts(n, seed):
    rng = random.Random(seed)
    chars = [*"ab eT1 \n\t .,'’é日　\xa0\x00\x1c\x85​🙂</s>٣", "<s>", "'s", " the", " onnd", "▁"]
    return ["".join(rng.choice(chars[:-1] if rng.random() < 0.95 else chars) for _ in range(rng.randint(0, 50))) for _ in range(n)]


def test_alignment_agrees_with_whole_texts(docs, monkeypatch):
    pair = align.pair_of(A, B)
    assert pair.by_stretch
    rows = [*enumerate(ODD + _random_texts(400, 2)), (None, "a b"), (3, "again, again")]
    want = {i: _aligned(pair, t) for i, t in rows if i != 3}
    counts = Counter(x for _, t in rows for x in ((_aligned(pair, t) or [0] * 4)[3] or []))
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    out = align.alignment(docs(rows), A, B).collect()
    assert len(out) == len(rows)
    for r in out:
        if r.doc_id == 3:
            continue
        w = want[r.doc_id]
        got = (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)
        if w is None:
            assert got == (0, 0, 0, 0, 0, 0, "")
        else:
            assert got == (w[0], w[1], len(w[3]), len(w[3]), sum(counts[x] == best[x[1]] for x in w[3]), sum(counts[x] for x in w[3]), w[2])
    assert len(counts) <= pair.most_pairs()
    assert align.alignment(docs([(1, "a")]).filter("doc_id > 1"), A, B).count() == 0
    # long texts in blocks, and generations that are forgotten
    monkeypatch.setattr(align, "BLOCK", 40)
    monkeypatch.setattr(align, "REMEMBERED", 20)
    for (_, text), got in zip(rows, align.Aligner(pair).batch([t for _, t in rows]), strict=True):
        w = _aligned(pair, text)
        assert got[:4] == ((0, 0, 0, "") if w is None else (w[0], w[1], len(w[3]), w[2]))


@pytest.mark.parametrize("seed", range(5))
def test_galloping_finds_all_common_values(seed):
    rng = np.random.default_rng(seed)
    sides = [[np.unique(rng.integers(0, 60, rng.integers(0, 30))) for _ in range(40)] for _ in range(2)]
    flat = [np.concatenate(s) for s in sides]
    cuts = [np.concatenate([[0], np.cumsum([len(x) for x in s])]) for s in sides]
    i, j = align.common_ends(flat[0], cuts[0], flat[1], cuts[1])
    want = [(cuts[0][k] + np.searchsorted(a, v), cuts[1][k] + np.searchsorted(b, v)) for k, (a, b) in enumerate(zip(*sides, strict=True)) for v in np.intersect1d(a, b)]
    assert list(zip(i.tolist(), j.tolist(), strict=True)) == want


def test_token_groups_are_ranges(docs):
    pair = align.pair_of(A, B)
    text = "The tokenizers, both of them, see zyxwvut."
    rows = align.token_groups(docs([(1, text), (2, None)]), A, B).orderBy("group").collect()
    ends = np.cumsum(pair.size_a[pair.a.encode(" " + text, add_special_tokens=False).ids])
    assert [r.group for r in rows] == [*range(len(rows))] and rows[-1].end == len(text) + 1
    assert all(r.a_from < r.a_to and r.b_from < r.b_to and ends[r.a_to - 1] == r.end for r in rows)
    assert all(x.a_to == y.a_from and x.b_to == y.b_from for x, y in zip(rows, rows[1:], strict=False))


def _phrase_texts(seed, n=120):
    rng = random.Random(seed)
    words = [f"W{i}" for i in range(12)] + ["é", "the", "THE", "x\x1fy"]
    fixed = " ".join(f"p{i}" for i in range(40))
    texts = ["".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ". ", "\n", "! ?"]) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    return [*texts, *([fixed] * 40), *["cut " + fixed + " end"] * 3, None, "", "...", "loop " * 50, " ".join(f"r{i}" for i in range(300))]


@pytest.mark.parametrize("least", [3, 8])
def test_collocations_equal_their_sql(spark, docs, least, tmp_path):
    rng = random.Random(least)
    rows = [(i, t, rng.choice(["en", "de", None])) for i, t in enumerate(_phrase_texts(least))]
    table = docs(rows).select("doc_id", "text", "lang")
    duck = connected("/root/testdata/sf0.001")
    path = str(tmp_path / "rows")
    table.write.parquet(path)
    duck.execute(f"CREATE TABLE own AS SELECT * FROM '{path}/*.parquet'")
    out = collocations.collocations(docs(rows), least=least, top=150, bits=1 << 12).cache()
    assert_same(out, duck, collocations.oracle("own", least=least, top=150))
    assert out.filter("path_words > 30").count() > 0
    assert collocations.collocations(docs([(1, "a")]).filter("doc_id > 1"), least=1).count() == 0
    assert collocations.collocations(docs([(1, None), (2, "one")]), least=1).count() == 0


def test_grams_go_through_frequent_runs_of_three_only(docs):
    """All pairs of these words are frequent and nearly no run of three is; such words made a row each before."""
    rng = random.Random(1)
    words = [f"w{i}" for i in range(30)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(300))) for i in range(100)] + [(i, "p q r s t u") for i in range(100, 150)]
    g = collocations.graph(docs(rows), least=10)
    edges = [tuple(r)[:5] for r in g.edges.collect()]
    counts = Counter(t[i : i + k] for _, text in rows for t in [tuple(text.split())] for k in (2, 3) for i in range(len(t) - k + 1))
    frequent = {k: sum(len(x) == k and n >= 10 for x, n in counts.items()) for k in (2, 3)}
    assert frequent[2] > 890 and frequent[3] < 50
    assert len({e[:2] for e in edges}) == frequent[2] and len({e[:3] for e in edges if e[2] is not None}) == frequent[3]
    assert len(edges) < 2 * frequent[2]


class _Shared:
    def __init__(self, value):
        self.value = value


def test_tasks_hold_little_besides_what_they_count():
    """1.5 million different pairs: all that a task held was copied several times at once before, to 3000 MB of an executor."""
    every = _Shared(collocations.Bitmap([(0, b"\xff")], 8))
    rng = np.random.default_rng(1)
    texts = [" ".join(map(str, rng.integers(0, 1 << 20, 10_000).tolist())) for _ in range(150)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(["en"] * len(texts))], names=["text", "lang"])
    tracemalloc.start()
    n = sum(sum(out.column(out.num_columns - 1).to_pylist()) for out in collocations._count_runs(every, [])(iter([batch])))
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert n == 150 * 9_999
    assert most < 110


def test_batches_of_texts_are_small_within_a_count_only(spark):
    """A batch had 10,000 texts, however long."""
    sizes = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"]) for b in batches)
    most = lambda: spark.range(0, 3000, 1, 1).mapInArrow(sizes, "n long").agg({"n": "max"}).first()[0]
    before = most()
    with common.small_batches(spark):
        assert most() <= 1000
    assert most() == before == 3000


def test_pairs_are_not_told_again_as_grams():
    """A gram of two words was a row of every task that had its pair."""
    h = np.arange(1, 9, dtype=np.uint64)
    pairs, threes = np.ones(7, bool), np.zeros(6, bool)
    threes[2:4] = True
    rows, n = collocations.grams(h, [pairs, threes], 5)
    assert rows.tolist() == [[3, 4, 5, 6, 0], [4, 5, 6, 0, 0]] and n.tolist() == [4, 3]


def test_a_full_bitmap_loses_nothing(docs):
    rows = [(i, t) for i, t in enumerate(_phrase_texts(5))]
    key = ["lang", "rank"]
    few, many = (collocations.collocations(docs(rows), least=3, bits=bits).orderBy(*key).collect() for bits in (8, 1 << 20))
    assert few == many and len(few) > 50


def test_pieces_are_never_cut(monkeypatch):
    text = ("word " * 30 + ". " + "a b c, " * 40).encode()
    whole = [b for b in collocations._blocks([text, b"x y", b""])]
    monkeypatch.setattr(collocations, "STEP", 64)
    blocks = list(collocations._blocks([text, b"x y", b""]))
    assert len(blocks) > len(whole)
    pieces = lambda parts: [p.split() for b in parts for p in re.split(rb"[.,\n]", b) if p.split()]
    assert pieces(blocks) == pieces(whole)


def test_scores_are_exact_beyond_64_bits(spark):
    a, n, left, right = 987_654_321_987, 98_765_432_109_876, 1_987_654_321_987, 987_654_321_988
    row = spark.createDataFrame([(a, n, left, right)], "a long, n long, l long, r long")
    assert row.select(collocations.score_of(row.a, row.n, row.l, row.r).alias("s")).first().s == 1000 * a * n // (left * right)


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


def _base(text):
    digits = lambda s: "".join(c for c in s if c in "0123456789")
    twice = lambda d: sum((2 * int(c) - 9 * (int(c) > 4)) if i % 2 else int(c) for i, c in enumerate(reversed(d)))
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(d := digits(m[0])) <= 19 and twice(d) % 10 == 0]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m[0])) <= 15]
    return ",".join(f"{k}:{s}:{e}" for k, s, e in out)


def test_patterns_agree_with_plain_searches(docs):
    rng = random.Random(4)
    parts = ["a.b", "@", "x-1", ".com", " ", "+1", "(555)", "-", "4111 1111 1111 1111", "4111111111111111", "10.0.0.1", ".", "256", "7", "é", "\n", "dot", " at ", "+49 30 1234567", "0"]
    texts = [None, "", "@", "a@b@c.d@e.f.g", "1.2.3.4.5.6.7.8", "0" * 4000 + "1.2.3.4", "+1 " * 40, "5" * 3000] + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 30))) for _ in range(1500)]
    out = pii.personal_data(docs([*enumerate(texts), (None, "a@b.c"), (0, "a@b.c")])).collect()
    assert len(out) == len(texts) + 2
    for r in out:
        if r.doc_id:
            base = _base(texts[r.doc_id] or "")
            assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest(), texts[r.doc_id]
            assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [base.count(f"{k}:") for k in pii.KINDS]
            assert set(filter(None, base.split(","))) <= set(r.spans.split(","))
    assert pii.personal_data(docs([(1, "a")]).filter("doc_id > 1")).count() == 0


@pytest.fixture(scope="module")
def field():
    return pii.trained(pii.labelled_rows())


UNSEEN = [
    "please call [phone:212-555-0187] today",
    "email [email:john.smith at gmail dot com] now",
    "contact: [email:anna (at) uni (dot) de]",
    "erble [phone:(402) 555-7193] onthe",
    "host [ip:10[.]2[.]3[.]4] x",
    "ring [phone:(988) 555-2485] or stop",
    "the card [card:4242.4242.4242.4242] was used",
    "in 2019 and 2020 there were 12345678 of them",
    "thly 1 2 3 4 5 6 7 8 9 10 11 12 erty",
    "at 5 dot 3 of 9",
    "version 12.4 came out on 3/4/2021",
    "number 9807915762804490 fails its test",
    "from 10 to 20, and 30 at most",
]


def test_the_field_finds_what_patterns_miss_and_leaves_the_rest(field):
    finder = pii.Finder(field)
    for marked in UNSEEN + pii.LABELLED:
        text, spans = pii.parsed(marked)
        base, added = finder.batch([text])[0]
        assert sorted(base + added) == sorted(spans), marked


def test_clean_documents_stay_clean(spark, sf, field):
    texts = [r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    plain = [t for t in texts if not re.search(r"[0-9@]", t)]
    assert len(plain) > 50 and all(b == [] and a == [] for b, a in pii.Finder(field).batch(plain))


def test_viterbi_is_the_best_sequence(field):
    rng = np.random.default_rng(3)
    scores = rng.normal(size=(6, 4, len(pii.LABELS))).astype(np.float32)
    lengths = np.asarray([1, 2, 3, 4, 4, 2])
    small = [0, 1, 2, 5]
    masked = np.full_like(scores, -1e6)
    masked[:, :, small] = scores[:, :, small]
    got = field.decoded(masked, lengths)
    from itertools import product

    for row, n, found in zip(masked, lengths, got, strict=True):
        value = lambda y: field.first[y[0]] + sum(row[t, y[t]] for t in range(n)) + sum(field.steps[y[t - 1], y[t]] for t in range(1, n))  # noqa: B023, E731
        best = max(product(small, repeat=n), key=value)
        assert tuple(found[:n]) == best


def test_a_labelled_table_trains_it(spark, docs):
    table = spark.createDataFrame([("id is [card:4242_4242_4242_4242] ok",), ("nothing 1 2 3",), (None,)], "marked string")
    out = pii.personal_data(docs([(1, "id is 4111_1111_1111_1111 ok"), (2, "nothing 4 5 6")]), labelled=table).orderBy("doc_id").collect()
    assert [r.spans for r in out] == ["card:6:25", ""]
    with pytest.raises(ValueError, match="labelled"):
        pii.labelled_rows(table, 1)
    assert pii.personal_data(docs([(1, "call 555-123-4567")]), labelled=table.limit(0)).first().spans == ""


def test_batches_of_empty_texts_have_no_language(docs, spark):
    rows = [(i, "the cat sat on the mat and that was that" if i % 2 else "der Hund und die Katze sind nicht hier", "en" if i % 2 else "de") for i in range(60)]
    model = langid.trained(docs(rows).selectExpr("doc_id id", "text", "lang"))
    for texts in ([""], ["", ""], [" "], ["\0"], ["", "the cat"]):
        assert len(model.entropies(texts)[1]) == len(texts)
    odd = [(100 + i, t, None) for i, t in enumerate([None, "", None, ""])]
    both = docs(rows).unionByName(docs(odd).repartition(4))
    out = {r.doc_id: r for r in langid.identify(both).collect()}
    assert all(out[i].lang_pred == "und" and out[i].score == 0 for i, _, _ in odd) and out[1].lang_pred == "en"
    alone = docs([(i, t) for i, t, _ in odd]).repartition(4)
    assert {r.lang_pred for r in langid.identify(alone).collect()} == {"und"}
