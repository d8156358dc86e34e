"""Every sentence inside a repeated run of two sentences and 20 words, or a repeated one of 20 words, goes."""

import random
from collections import defaultdict

import pytest

from eventlode.llm import substring


def _kept(texts):
    """Over all runs, not the shortest ones: first places stay, sentences that any other place covers go."""
    first, places = {}, []
    for i, t in texts:
        n = [s.split() for s in substring.sentences(t)]
        for b in range(len(n)):
            for e in range(b + 1, len(n) + 1):
                if sum(map(len, n[b:e])) >= 20:
                    key = tuple(" ".join(w).lower() for w in n[b:e])
                    places.append((key, i, b, e))
                    first.setdefault(key, (i, b))
    drop = defaultdict(set)
    for key, i, b, e in places:
        if first[key] != (i, b):
            drop[i].update(range(b, e))
    return {i: "".join(s for j, s in enumerate(substring.sentences(t)) if j not in drop[i]) for i, t in texts}


@pytest.mark.parametrize("lengths", [[42, 30], [25, 41, 39], [45, 19], [44, 8], [14, 29, 21], [14, 14, 5], [25, 3, 5], [3, 25]])
def test_all_of_a_passage_goes_and_all_runs_agree(docs, lengths):
    rng = random.Random(str(lengths))
    sentence = lambda n: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(n)) + ". "
    passage = "".join(sentence(n) for n in lengths)
    texts = [(i, sentence(7) + passage + sentence(6)) for i in range(3)]
    got = {r.doc_id: r.kept_text for r in substring.substring_dedup(docs(texts)).collect()}
    assert got == _kept(texts) and all(len(got[i].split()) == 13 for i in (1, 2))


def test_random_runs_agree(docs):
    rng = random.Random(5)
    sentence = lambda: " ".join(f"w{rng.randint(0, 900)}" for _ in range(rng.choice([1, 3, 5, 9, 14, 22, 45]))) + rng.choice([". ", "! ", "\n"])
    pool = [sentence() for _ in range(40)]
    runs = [pool[i : i + 6] for i in range(0, 36, 6)]
    texts = [(i, "".join("".join(rng.choice(runs)[rng.randint(0, 2) :]) if rng.random() < 0.2 else sentence() for _ in range(rng.randint(1, 10)))) for i in range(80)]
    assert {r.doc_id: r.kept_text for r in substring.substring_dedup(docs(texts)).collect()} == _kept(texts)
