"""Near duplicates, sentence spans, packing, language identification, LM scores: against slow versions."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

from eventlode.llm import langid, lm, neardup, packing, substring
from eventlode.llm.eliasfano import EliasFano
from eventlode.llm.hashing import word_hashes
from eventlode.llm.registry import tokenizer_path


def _prose(rng, n, words=400):
    return " ".join(f"w{rng.randint(0, words)}" for _ in range(n))


def _edited(rng, text, rate):
    return " ".join(w if rng.random() > rate else f"e{rng.randint(0, 10**6)}" for w in text.split())


def _corpus(seed=1):
    rng = random.Random(seed)
    texts = [_prose(rng, rng.randint(5, 300), 5000) for _ in range(80)]
    passage = _prose(rng, 120, 5000)
    texts += [t.upper() for t in texts[:5]] + texts[:3] * 4
    texts += [_edited(rng, t, rng.choice([0.005, 0.01, 0.02, 0.05, 0.2])) for t in texts[:60] for _ in range(2)]
    texts += [passage + " " + _prose(rng, 40, 5000) for _ in range(60)]
    texts += [None, "", " \n ", "one", "one two", "one two", "a a a a a a a a a a"]
    return texts


def _components(links, ids):
    up = {i: i for i in ids}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def test_near_duplicates_are_the_components_of_all_links(docs):
    texts = _corpus()
    k = {i: neardup.labelled(word_hashes([neardup._bytes(t)])[0]) for i, t in enumerate(texts)}
    links = [(i, j) for i in k for j in range(i) if len(k[i]) and len(k[j]) and neardup.similarity(k[i], k[j]) >= 0.8]
    assert len(links) > 60
    out = neardup.near_duplicates(docs([*enumerate(texts), (None, texts[0]), (3, texts[3])])).collect()
    assert len(out) == len(texts) + 1
    assert {r.doc_id: r.class_id for r in out if r.doc_id is not None} == _components(links, k)
    assert [r.class_id for r in out if r.doc_id is None] == [None]
    assert neardup.near_duplicates(docs([(1, "a")]).filter("doc_id > 1")).count() == 0


def test_alignment_is_the_longest_common_chain():
    rng = random.Random(2)
    for _ in range(200):
        a = [f"w{rng.randint(0, 30)}" for _ in range(rng.randint(5, 60))]
        b = list(a)
        for _ in range(rng.randint(0, 3)):
            b[rng.randrange(len(b))] = "new"
        if rng.random() < 0.3:
            b = b[4:] + b[:4]
        x, y = (neardup.labelled(word_hashes([" ".join(w).encode()])[0]).tolist() for w in (a, b))
        lcs = np.zeros((len(x) + 1, len(y) + 1), int)
        for i in range(len(x)):
            for j in range(len(y)):
                lcs[i + 1, j + 1] = lcs[i, j] + 1 if x[i] == y[j] else max(lcs[i, j + 1], lcs[i + 1, j])
        m = lcs[-1, -1]
        want = m / (len(x) + len(y) - m)
        got = neardup.similarity(np.asarray(x, np.uint64), np.asarray(y, np.uint64))
        assert (got >= 0.8) == (want >= 0.8) and (want < 0.8 or got == want)


def _slow_spans(texts):
    first, places = {}, []
    for i, t in sorted((i, t) for i, t in texts if i is not None):
        s = substring.sentences(t or "")
        n = [x.split() for x in s]
        for b in range(len(s)):
            words = 0
            for e in range(b, len(s)):
                words += len(n[e])
                if words >= 20:  # every run of two sentences or more, and every long sentence
                    key = tuple(" ".join(w).lower() for w in n[b : e + 1])
                    places.append((key, i, b, e + 1))
                    first.setdefault(key, (i, b))
    drop = defaultdict(set)
    for key, i, b, e in places:
        if first[key] != (i, b):
            drop[i].update(range(b, e))
    return {i: "".join(x for j, x in enumerate(substring.sentences(t or "")) if j not in drop[i]) for i, t in texts if i is not None}


def test_spans_that_repeat_are_cut(docs):
    rng = random.Random(4)
    sentence = lambda: " ".join(f"w{rng.randint(0, 900)}" for _ in range(rng.choice([1, 3, 5, 9, 14, 14, 45]))) + rng.choice([". ", "! ", ".\n", "\n"])
    passages = ["".join(sentence() for _ in range(9)) for _ in range(4)]
    texts = [(i, "".join(sentence() if rng.random() < 0.8 else rng.choice(passages) for _ in range(rng.randint(0, 14)))) for i in range(120)]
    texts += [(200, None), (201, ""), (202, "\n\n"), (203, "same here. " * 60), (204, texts[3][1])]
    out = substring.substring_dedup(docs([*texts, (None, passages[0])]), keep=["lang", "id"]).collect()
    want = _slow_spans(texts)
    assert {r.doc_id: r.kept_text or "" for r in out if r.doc_id is not None} == want
    assert next(r for r in out if r.doc_id is None).kept_text == passages[0]
    assert {r.id for r in out} == {"x"} and want[204] == ""
    assert substring.substring_dedup(docs([(1, "a")]).filter("doc_id > 1")).count() == 0


ODD = ["", "  a", "a  b\n\n c", "<|endoftext|> a", "don't I'll 12abc 3,000.50 日本 語 'quoted' a\tb \r\n q", " lead", "trail ", "naïve ñ. É!", "\n", "a\n\nb", "_x_ -- ... !!!", "ﬁ ½ a.b c,d e. f.. g?!"]


def test_encoder_agrees_with_the_tokenizer_on_whole_texts(spark, sf):
    own = packing.Encoder(tokenizer_path())
    texts = ODD + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert own.batch(texts) == [own.whole(t) for t in texts]


def test_packing_places_every_token_once(docs):
    rng = random.Random(6)
    texts = [None, "", *ODD, *[_prose(rng, rng.choice([1, 5, 60, 300, 900]), 300) for _ in range(150)], _prose(rng, 9000)]
    table = docs([*enumerate(texts), (None, "x y")])
    out = packing.pack(packing.token_pieces(table, tokenizer_path())).toPandas()
    own = packing.Encoder(tokenizer_path())
    want = {}
    for i, t in enumerate(texts):
        ids = np.frombuffer(own.whole(t or ""), "<u4").tolist() + [2]
        at, n = 0, len(ids) % 1024 or min(len(ids), 1024)
        k = 0
        while at < len(ids):
            want[i, k] = (at, n, zlib.crc32(np.asarray(ids[at : at + n], "<u4").tobytes()))
            at, n, k = at + n, 1024, k + 1
    assert {(int(r.doc_id), r.piece): (r.start, r.length, r.ids_crc32) for r in out.dropna().itertuples()} == want
    for _, s in out.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == np.concatenate([[0], np.cumsum(s.length)[:-1]]).tolist() and s.length.sum() <= 1024
    assert out.sequence_id.nunique() <= 1.02 * max(out.length.sum() / 1024, (out.length > 512).sum()) + 2
    assert packing.pack(packing.token_pieces(table.filter("doc_id < 0"), tokenizer_path())).count() == 0


def test_fill_is_the_best_subset():
    rng = random.Random(7)
    for _ in range(200):
        counts = {rng.randint(1, 40): rng.randint(1, 4) for _ in range(rng.randint(0, 6))}
        room = rng.randint(0, 90)
        sums = {0}
        for n, c in counts.items():
            sums = {s + n * k for s in sums for k in range(c + 1)}
        got = packing.fill(counts, room)
        assert sum(n * k for n, k in got.items()) == max(s for s in sums if s <= room)
        assert all(k <= counts[n] for n, k in got.items())


def test_languages_are_told_apart(spark, sf, docs):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    odd = docs([(10**6, None), (10**6 + 1, ""), (10**6 + 2, "123 !!"), (10**6 + 3, "Ж"), (None, "the of and")]).select(*d.columns)
    out = langid.identify(d.unionByName(odd)).join(d.select("doc_id", "lang"), "doc_id", "left").toPandas()
    real = out[out.lang.notna()]
    assert (real.lang == real.lang_pred)[real.held_out].mean() >= 0.98
    assert set(out[out.doc_id.between(10**6, 10**6 + 2)].lang_pred) == {"und"} and out.score.between(0, 1).all()
    assert all(r.held_out == (zlib.crc32(str(int(r.doc_id)).encode()) % 4 == 2) for r in real.itertuples())
    none = langid.identify(docs([(1, "a"), (2, "b")]).withColumn("lang", langid.F.lit(None).cast("string"))).collect()
    assert [r.lang_pred for r in none] == ["und", "und"]
    assert langid.identify(docs([(1, "a")]).filter("doc_id > 1")).count() == 0


def test_character_probabilities_sum_to_one():
    model = langid.fit({"a": {"\0ab": 2, "abc": 3, "bca": 1, "\0\0a": 4}, "b": {"\0\0b": 1, "\0ba": 5, "bac": 2}}, order=3)
    letters = [ord(c) for c in "abc"]
    for context in ([0, 0], [0, ord("a")], [ord("a"), ord("b")], [ord("c"), ord("c")]):
        rows = [model.score(np.asarray([*context, c], np.uint64), np.asarray([2]))[0] for c in letters]
        total = (10.0 ** np.asarray(rows)).sum(0)
        assert np.all(total < 1.0) and np.all(total > 0.5)


def _slow_kneser_ney(counts, order):
    """log10 probability of a character after a context, by dictionaries and the textbook's recursion. counts: of strings of `order`."""
    tables = {order: dict(counts)}
    for n in range(order - 1, 0, -1):
        lower = Counter(g[1:] for g in tables[n + 1] if g[-1] != "\0")
        tables[n] = dict(lower)
    return tables


def test_character_models_are_interpolated_kneser_ney():
    rng = random.Random(15)
    texts = {lang: ["".join(rng.choice(letters) for _ in range(rng.randint(1, 40))) for _ in range(30)] for lang, letters in (("x", "aabc "), ("y", "bccde "))}
    order, counts = 3, {}
    for lang, ts in texts.items():
        chars, _ = langid.characters(ts, order)
        flat = "".join(map(chr, chars.tolist()))
        counts[lang] = Counter(flat[i - order : i] for i in range(order, len(flat) + 1) if flat[i - 1] != "\0")
    model = langid.fit({k: dict(v) for k, v in counts.items()}, order)
    tables = {lang: _slow_kneser_ney(c, order) for lang, c in counts.items()}
    alphabet = len({g for t in tables.values() for g in t[1]}) + 1

    def p(lang, context, ch):
        n = len(context) + 1
        t = tables[lang][n]
        ones, twos = sum(v == 1 for v in t.values()), sum(v == 2 for v in t.values())
        d = min(0.9, max(0.1, ones / max(1, ones + 2 * twos) if ones + twos else 0.5))
        own = {g: v for g, v in t.items() if g[:-1] == context}
        below = p(lang, context[1:], ch) if n > 1 else 1.0 / alphabet
        total = sum(own.values())
        return max(own.get(context + ch, 0) - d, 0) / total + d * len(own) / total * below if total else below

    for _ in range(200):
        lang, context, ch = rng.choice("xy"), rng.choice(["\0\0", "\0a", "ab", "bc", "dd", "ea", " b"]), rng.choice("abcde")
        got = model.score(np.asarray([*map(ord, context), ord(ch)], np.uint64), np.asarray([2]))[0][model.languages.index(lang)]
        assert abs(got - math.log10(p(lang, context, ch))) < 1e-4


def test_long_texts_score_as_short_ones(monkeypatch):
    rng = random.Random(16)
    model = langid.fit({"a": {"\0ab": 2, "abc": 3, "bca": 1, "\0\0a": 4, "c a": 2}, "b": {"\0\0b": 1, "\0ba": 5, "bac": 2}}, order=3)
    text = "".join(rng.choice("abc  .") for _ in range(900))
    whole = model.entropies([text])
    monkeypatch.setattr(langid, "STEP", 64)
    steps = model.entropies([text])
    assert whole[1] == steps[1] and np.allclose(whole[0], steps[0], atol=1e-5)


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    from eventlode.llm import hashing

    rng = random.Random(17)
    texts = [_prose(rng, 3000).encode(), b"", b"x" * 5000 + b" y", _prose(rng, 2000).encode()]
    whole = word_hashes(texts)
    monkeypatch.setattr(hashing, "STEP", 512)
    pieces = word_hashes(texts)
    assert (whole[0] == pieces[0]).all() and (whole[1] == pieces[1]).all()
    monkeypatch.setattr(neardup, "MANY", 100)
    k = neardup.labelled(whole[0])
    one_by_one = neardup.sketch(k)
    monkeypatch.setattr(neardup, "MANY", 1 << 16)
    assert (one_by_one == neardup.sketch(k)).all()


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n, top in [(0, 10), (1, 1), (5, 6), (1000, 1001), (1000, 1 << 40), (50_000, (1 << 64) - 1)]:
        v = np.unique(rng.integers(0, top, n, dtype=np.uint64))
        e = EliasFano(EliasFano.encode(v))
        assert (e.get(np.arange(len(v))) == v).all() and (e.find(v) == np.arange(len(v))).all()
        q = rng.integers(0, top, 5000, dtype=np.uint64)
        assert ((e.find(q) >= 0) == np.isin(q, v)).all()


def test_lm_scores_follow_the_formula(docs):
    rng = random.Random(8)
    texts = [*[_prose(rng, rng.randint(0, 80), 40) for _ in range(60)], None, "", "É é A a\x0bB\xa0c"]
    out = {r.doc_id: r for r in lm.lm_scores(docs(list(enumerate(texts)))).collect()}
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    tokens = {i: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower)), None] for i, t in enumerate(texts)}
    train = [i for i in tokens if zlib.crc32(str(i).encode()) % 7 != 2]
    c, pairs = Counter(), Counter()
    for i in train:
        c.update(tokens[i])
        pairs.update(zip([None, *tokens[i][:-1]], tokens[i], strict=True))
    n, v = sum(c.values()), len(c)
    more = Counter()
    for a, _ in pairs:
        more[a] += 1
    n1, n2 = sum(k == 1 for k in pairs.values()), sum(k == 2 for k in pairs.values())
    d = min(0.9, max(0.3, n1 / max(1, n1 + 2 * n2)))
    for i, ts in tokens.items():
        r = out[i]
        base = sum(math.log10((c[t] + 1) / (n + v + 1)) for t in ts)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ts), sum(c[t] > 0 for t in ts), n)
        assert abs(r.base_score - base) < 1e-9 * max(1, abs(base)) and r.held_out == (i not in train)
        want = 0.0
        for a, b in zip([None, *ts[:-1]], ts, strict=True):
            back = min(1.0, d * more[a] / c[a]) if c[a] else 1.0
            k = pairs.get((a, b), 0)
            want += math.log10((max(k - d, 0) / c[a] if k else 0.0) + back * (c[b] + 1) / (n + v + 1))
        assert abs(r.score - want) < 0.01 * len(ts)  # half a step of both codebooks
    assert lm.lm_scores(docs([(1, "a")]).filter("doc_id > 1")).count() == 0


def test_plans_with_slack_save_bins_and_place_every_piece():
    rng, worse = random.Random(12), 0
    for _ in range(30):
        counts: dict[int, int] = {}
        for _ in range(rng.randint(1, 60)):
            n = rng.choice([rng.randint(1, 64), rng.randint(20, 35)])
            counts[n] = counts.get(n, 0) + rng.randint(1, 30)
        placed: dict[int, int] = {}
        for items, times in packing.plan(counts, 64):
            assert sum(n * k for n, k in items) <= 64 and times > 0
            for n, k in items:
                placed[n] = placed.get(n, 0) + k * times
        assert placed == counts
        bins, plain = (sum(t for _, t in p) for p in (packing.plan(counts, 64), packing.plan_within(counts, 64, 0)))
        assert -(-sum(n * c for n, c in counts.items()) // 64) <= bins <= plain
        worse += plain > bins
    assert worse and packing.plan({}, 64) == []
