"""Near duplicates in groups whose members resemble an original, or share a passage, but not each other."""

import random

from eventlode.llm import neardup
from eventlode.llm.hashing import word_hashes


def _kmers(text):
    return neardup.labelled(word_hashes([neardup._bytes(text)])[0])


def _words(rng, n):
    return [f"w{rng.randint(0, 10**6)}" for _ in range(n)]


def _copy(rng, words, rate):
    return [w if rng.random() > rate else f"e{rng.randint(0, 10**9)}" for w in words]


def _top(up, x):
    while up[x] != x:
        x = up[x]
    return x


def _classes(texts):
    k = {i: _kmers(t) for i, t in texts}
    up = {i: i for i in k}
    for a in k:
        for b in k:
            if a < b and _top(up, a) != _top(up, b) and neardup.similarity(k[a], k[b]) >= 0.8:
                x, y = _top(up, a), _top(up, b)
                up[max(x, y)] = min(x, y)
    return {i: _top(up, i) for i in k}


def _groups(rng, sizes):
    texts = []
    for size in sizes:
        original = _words(rng, 400)
        texts += [original, *(_copy(rng, original, rng.uniform(0.01, 0.02)) for _ in range(size))]
    return texts


def test_copies_meet_an_original_of_any_id(docs):
    rng = random.Random(11)
    texts = [" ".join(w) for w in _groups(rng, [10, 30, 100])]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    assert {r.doc_id: r.class_id for r in neardup.near_duplicates(docs(rows)).collect()} == _classes(rows)


def test_a_thousand_copies_meet_their_original(docs):
    rng = random.Random(12)
    texts = [" ".join(w) for w in _groups(rng, [1000])]
    ids = rng.sample(range(10**6), len(texts))
    original = _kmers(texts[0])
    near = {i for i, t in zip(ids, texts, strict=True) if neardup.similarity(_kmers(t), original) >= 0.8}
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(docs(list(zip(ids, texts, strict=True)))).collect()}
    assert len(near) > 800 and len({got[i] for i in near}) == 1


def test_near_copies_among_texts_with_a_common_passage(docs):
    rng = random.Random(13)
    passage = _words(rng, 150)
    own = [_words(rng, 60) for _ in range(50)]
    texts = [" ".join(passage + w) for w in own] + [" ".join(_copy(rng, passage + w, 0.018)) for w in own * 2]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    assert {r.doc_id: r.class_id for r in neardup.near_duplicates(docs(rows)).collect()} == _classes(rows)


def test_similar_texts_share_a_rare_shingle():
    rng = random.Random(14)
    for _ in range(300):
        a = _words(rng, rng.randint(6, 60))
        b = [w for w in _copy(rng, a, rng.choice([0.0, 0.01, 0.03])) if rng.random() > 0.02]
        x, y = sorted((_kmers(" ".join(a)), _kmers(" ".join(b))), key=len)
        if neardup.similarity(x, y) >= 0.8:
            assert set(sorted(x)[: neardup.prefixes(len(x), 0.8)[1]]) & set(sorted(y)[: neardup.prefixes(len(y), 0.8)[0]])
