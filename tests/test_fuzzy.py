"""Resembling names against comparisons of all pairs and against row loops, in blocks that hold most rows."""

import random
from difflib import SequenceMatcher

import pytest

from eventlode.operators import fuzzy, similarity

SCHEMA = "id long, v string, n string, new boolean"
WORDS = ["jazz", "night", "show", "big", "trio", "the", "live", "at", "rock", "open", "mic", "of", "band"]


def _ratio(a, b):
    return SequenceMatcher(None, a, b).ratio()


def _names(rng, n):
    out = []
    for _ in range(n):
        if out and rng.random() < 0.5:
            text = list(rng.choice(out))
            for _ in range(rng.randint(0, 4)):
                at = rng.randint(0, len(text))
                if rng.random() < 0.5:
                    text[at : at + 1] = []
                else:
                    text[at:at] = [rng.choice("abcdeé ")]
            out.append("".join(text))
        else:
            out.append(" ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 6))))
    return out


@pytest.mark.parametrize(("least", "seed"), [(0.8, 1), (0.85, 2), (0.95, 3)])
def test_no_pair_is_lost(spark, least, seed):
    rng = random.Random(seed)
    names = sorted({*_names(rng, 150), "", "a", "ab", "ba", "abc", "abd", "x" * 230, "x" * 228 + "yz", "ab" * 60, "ab" * 58})
    df = spark.createDataFrame([(0, v, n, True) for v in "pq" for n in (names if v == "p" else names[::3])], SCHEMA)
    got = {(r.v, r.a, r.b): (r.ab, r.ba) for r in fuzzy.alike(df, ["v"], "n", least).collect()}
    want = {}
    for v, own in (("p", names), ("q", names[::3])):
        for i, a in enumerate(own):
            for b in own[i + 1 :]:
                ways = _ratio(a, b) > least, _ratio(b, a) > least
                if any(ways):
                    want[v, a, b] = ways
    assert len(want) > 10 and got == want


def test_low_ratios_are_refused(spark):
    with pytest.raises(ValueError, match="letter pair"):
        fuzzy.alike(spark.createDataFrame([], SCHEMA), ["v"], "n", 0.7)


def _clusters(rows, least):
    found, want = {}, {}
    for i, v, n, _ in sorted(rows, key=lambda r: r[0]):
        if v is None:
            want[i] = i
            continue
        own = found.setdefault(v, [])
        text = (n or "").lower()
        for head, members in own:
            if any(_ratio(text, m) > least for m in members):
                members.append(text)
                want[i] = head
                break
        else:
            own.append((i, [text]))
            want[i] = i
    return want


def _rows(seed, n=240):
    rng = random.Random(seed)
    names = _names(rng, 90)
    rows = [(i, rng.choice(["hall"] * 5 + ["club", None]), rng.choice([*names, None]), rng.random() < 0.7) for i in range(n)]
    return [(i, v, names[3] if v == "hall" and rng.random() < 0.3 else x, new) for i, v, x, new in rows]


@pytest.mark.parametrize("seed", [5, 6])
def test_clusters_are_those_of_a_row_loop(spark, seed):
    rows = _rows(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {r.id: r.cluster for r in fuzzy.greedy_clusters(df, ["v"], "id", "n").collect()}
    want = _clusters(rows, 0.8)
    assert got == want and len(set(want.values())) < len(rows) // 2
    assert got == {r.id: r.cluster for r in similarity.greedy_clusters(df, ["v"], "id", "n").collect()}


@pytest.mark.parametrize("seed", [7, 8])
def test_survivors_are_those_of_a_row_loop(spark, seed):
    rows = _rows(seed)
    kept, want = {}, set()
    for i, v, n, new in sorted(rows, key=lambda r: (r[3], r[0])):
        block, text = kept.setdefault(v, []), (n or "").lower()
        if new and v and any(_ratio(text, s) > 0.85 for s in block):
            continue
        block.append(text)
        if new:
            want.add(i)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = [r.id for r in fuzzy.survivors(df, ["v"], "id", "n", "new").collect()]
    assert sorted(got) == sorted(want)


def test_nothing_alike_and_nothing_at_all(spark):
    df = spark.createDataFrame([(1, "h", "aaa bbb", True), (2, "h", "ccc ddd", True), (3, "h", "aaa bbb", True)], SCHEMA)
    assert {r.id: r.cluster for r in fuzzy.greedy_clusters(df, ["v"], "id", "n").collect()} == {1: 1, 2: 2, 3: 1}
    assert sorted(r.id for r in fuzzy.survivors(df, ["v"], "id", "n", "new").collect()) == [1, 2]
    assert fuzzy.greedy_clusters(df.limit(0), ["v"], "id", "n").count() == 0 and fuzzy.survivors(df.limit(0), ["v"], "id", "n", "new").count() == 0
