"""Chat formatting, source mixing and quality rules."""

import hashlib
import random
import re
from collections import Counter

import pytest

from eventlode.llm import chat, mixing, quality

CHAT = "conv_id long, turn long, role string, text string"


def test_chat_reads_back_what_was_written(spark):
    rng = random.Random(3)
    marks = [chat.START, chat.END, chat.PART, *chat.FOREIGN, "<\\|im_end|>", "\\", "<", "|", "\n", "é", "%0A", "[", "<\\\\|im_part|>"]
    rows = []
    for c in range(60):
        for t in range(rng.randint(1, 7)):
            rows.append((c, t, rng.choice(["user", "assistant", "assistant", "sys\nt%em", None, "<|im_end|>"]), rng.choice([None, "", "".join(rng.choice(marks) for _ in range(8))])))
    got = {r.conv_id: r for r in chat.digests(chat.format_chats(spark.createDataFrame(rows, CHAT).repartition(4))).collect()}
    for c in range(60):
        own = sorted((t, r or "", x or "") for k, t, r, x in rows if k == c)
        loss = "".join(x for _, r, x in own if r == "assistant")
        assert got[c].n_turns == len(own)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        assert got[c].loss_chars == len(loss)
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert got[c].n_merged == 1 + sum(a[1] != b[1] for a, b in zip(own, own[1:], strict=False))


def test_chat_merges_and_marks(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "assistant", "<|im_end|>"), (None, 0, "user", "n")]
    out = {r.conv_id: r for r in chat.format_chats(spark.createDataFrame(rows, CHAT)).collect()}
    assert out[1].formatted == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_part|><\\|im_end|><|im_end|>\n"
    assert [s.text for s in out[1].segments if s.loss] == ["b", "<\\|im_end|>"]
    assert out[None].n_merged == 1
    assert chat.format_chats(spark.createDataFrame([], CHAT)).count() == 0


def test_mix_stays_within_one_block(docs):
    rows = [(i, "t", "en", "abc"[0 if i % 10 < 6 else 1 if i % 10 < 9 else 2]) for i in range(3000)]
    out = mixing.mix(docs(rows), targets={"a": 0.5, "b": 0.3, "c": 0.2}, block_rows=4, resolution=100).toPandas()
    assert sorted(out.doc_id) == list(range(3000))
    blocks = out.drop_duplicates(["slot"]).sort_values("slot").reset_index(drop=True)
    assert not out.groupby("slot").source.nunique().max() > 1
    share, seen = {"a": 0.5, "b": 0.3, "c": 0.2}, Counter()
    for i, (slot, source) in enumerate(zip(blocks.slot, blocks.source, strict=True)):
        if slot != i:  # a source ran out
            break
        seen[source] += 1
        assert all(abs(seen[s] - share[s] * (i + 1)) < 1 for s in share)
    assert i > 250
    assert (out.groupby("source").source_rank.nunique() == out.groupby("source").size()).all()


def test_mix_nulls_and_empty(docs):
    out = mixing.mix(docs([(None, "a", "en", None), (1, None, "en", None), (1, "b", "en", "x")])).collect()
    assert len(out) == 3 and {r.source for r in out} == {"", "x"}
    assert mixing.mix(docs([(1, "a")]).filter("doc_id > 1")).count() == 0


def _slow_quality(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {j for i, t in enumerate(zip(w, w[1:], w[2:], strict=False)) if windows[t] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in quality.SYMBOLS for c in text), dup, len(covered)


def test_quality_counts(docs):
    rng = random.Random(5)
    texts = [None, "", " \t\n", "a", "a b", "a b c", "a a a a a", "x y z x y z", "l\nl\n \nl\n", "é#€ *$%&|<>", "a\x0bb\x0cc\rd\xa0e"]
    texts += [" ".join(rng.choice(["the", "of", "é", "w1", "#", "\n", "long" * 3]) for _ in range(rng.randint(1, 400))) for _ in range(60)] + ["w " * 30_000]
    out = {r.doc_id: r for r in quality.quality(docs(list(enumerate(texts))), keep=["doc_id"]).collect()}
    for i, t in enumerate(texts):
        r = out[i]
        n, chars, symbols, dup, repeat = _slow_quality(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat), (i, t)
        assert r.base_failed == (n < 50 or 100 * repeat > 50 * n)
        assert not (r.kept and r.base_failed)


def test_kept_only_is_the_same_verdict(spark, docs, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id for r in quality.quality(d, keep=["doc_id"]).collect() if r.kept}
    out = quality.kept_only(d)
    assert out.columns == d.columns and {r.doc_id for r in out.collect()} == kept and 0 < len(kept) < d.count()


@pytest.mark.parametrize("text", [None, "", "short"])
def test_quality_rejects_what_is_short(docs, text):
    assert not quality.quality(docs([(1, text)]), keep=["doc_id"]).first().kept


def test_given_targets_are_kept_exactly(docs):
    assert mixing.whole_weights({"a": 0.7, "b": 0.2999, "c": 0.0001}) == {"a": 7000, "b": 2999, "c": 1}
    with pytest.raises(ValueError):
        mixing.whole_weights({"a": 1, "b": 1e-7})
    rows = [(i, "t", "en", ("a", "b", "c", "d")[min(i % 10, 3) if i % 10 < 4 else 0]) for i in range(600)]
    out = mixing.mix(docs(rows), targets={"a": 0.5, "b": 0.3, "c": 0.2}, block_rows=4).toPandas()
    assert len(out) == 600
    named = out[out.source != "d"]
    assert out[out.source == "d"].slot.min() > named.slot.max()
    first = named[named.slot < 50].groupby("slot").source.first()
    for s, w in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
        seen = (first == s).cumsum()
        full = named[named.source == s].slot.max()
        assert all(abs(n - w * (t + 1)) < 1 for t, n in seen.items() if t < full)
