"""Substring and suffix-array deduplication against brute force."""

import hashlib
import random

import numpy as np
import pytest
from tests.llm.helpers import clashing, documents, edge_cases

from tessera.llm import repeats, substring_dedup, suffix_dedup


def brute_words(pairs, window):
    first = {}
    words = {i: (t or "").encode().split() for i, t in pairs}
    for i in sorted(words):
        w = words[i]
        for a in range(len(w) - window + 1):
            first.setdefault(tuple(w[a : a + window]), i)
    out = []
    for i, _ in pairs:
        w, gone = words[i], set()
        for a in range(len(w) - window + 1):
            if first[tuple(w[a : a + window])] < i:
                gone.update(range(a, a + window))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out)


def noisy(rng, n, passages, vocabulary):
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(1, 4)):
            if rng.random() < 0.5:
                p = rng.choice(passages).split()
                if rng.random() < 0.6:
                    p[rng.randrange(len(p))] = rng.choice(vocabulary)
                a = rng.randint(0, len(p) // 3)
                parts.append(" ".join(p[a : len(p) - rng.randint(0, len(p) // 3)]))
            parts.append(" ".join(rng.choices(vocabulary, k=rng.randint(0, 30))))
        out.append(rng.choice([" ", "\n", "\x0b "]).join(parts))
    return out


@pytest.mark.parametrize(("seed", "window"), [(0, 50), (1, 10), (2, 3)])
def test_substring_dedup_equals_brute_force(spark, seed, window):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "c\xa0d", "é", "x\x1cy"] if seed else [f"w{i}" for i in range(300)]
    passages = [" ".join(rng.choices(vocabulary, k=rng.randint(window, 3 * window))) for _ in range(5)]
    texts = edge_cases() + noisy(rng, 60, passages, vocabulary) + ["be " * 70, "be " * 51, "be " * 200 + "end"]
    docs = documents(spark, texts).repartition(6)
    got = sorted(map(tuple, substring_dedup.dedup_report(clashing(docs), window).collect()))
    assert got == brute_words(list(enumerate(texts)), window)


def test_substring_dedup_of_ties_and_missing_ids(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text), (1, text), (None, text), (2, text + " x"), (3, None)], "doc_id long, text string")
    got = {(r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.dedup_report(docs).collect()}
    assert got == {(1, 60, 0), (None, 60, 0), (2, 61, 60), (3, 0, 0)}
    assert substring_dedup.dedup_report(docs).count() == 5
    assert substring_dedup.dedup_report(docs.limit(0)).count() == 0


def test_dedup_cuts_texts_and_keeps_columns(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = clashing(documents(spark, ["intro\n" + text, "other " + text + "\nthe end", text, "plain", None]))
    out = {r.doc_id: r for r in substring_dedup.dedup(docs).collect()}
    assert sorted(out) == [0, 1, 3, 4] and substring_dedup.dedup(docs).columns == docs.columns
    assert out[1].text == "other \nthe end" and out[1].n_chars == len(out[1].text)
    assert out[0].text == "intro\n" + text and out[4].text is None


def brute_bytes(pairs, length):
    raw = {i: (t or "").encode() for i, t in pairs}
    seen, out = set(), []
    for i in sorted(raw):
        b, gone = raw[i], [False] * len(raw[i])
        for a in range(len(b) - length + 1):
            s = b[a : a + length]
            if s in seen:
                gone[a : a + length] = [True] * length
            seen.add(s)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize(("seed", "length"), [(0, 100), (1, 12), (2, 5)])
def test_suffix_dedup_equals_brute_force(spark, seed, length, monkeypatch):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "ab", "é"] if seed else [f"w{i}" for i in range(300)]
    passages = [" ".join(rng.choices(vocabulary, k=rng.randint(length // 2, length))) for _ in range(5)]
    texts = edge_cases() + noisy(rng, 50, passages, vocabulary) + ["ab" * 60, "ab" * 90 + "c"]
    if seed:  # every group is large, every shard small
        monkeypatch.setattr(suffix_dedup, "GROUP_BYTES", 40)
        monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 64)
        monkeypatch.setattr(suffix_dedup, "PIECE", 7)
        monkeypatch.setattr(suffix_dedup, "SLICE", 33)
    docs = documents(spark, texts).repartition(6)
    got = sorted(map(tuple, suffix_dedup.dedup_report(clashing(docs), length).collect()))
    assert got == brute_bytes(list(enumerate(texts)), length)


def test_suffix_dedup_of_ties_and_missing_ids(spark):
    text = "".join(chr(97 + i * i % 23) + str(i) for i in range(60))
    docs = spark.createDataFrame([(1, text), (1, text), (None, text), (2, text + " x"), (3, None)], "doc_id long, text string")
    got = {(r.doc_id, r.n_removed, r.n_spans) for r in suffix_dedup.dedup_report(docs).collect()}
    assert got == {(1, 0, 0), (None, 0, 0), (2, len(text), 1), (3, 0, 0)}
    assert suffix_dedup.dedup_report(docs.limit(0)).count() == 0


def test_long_texts_in_slices(spark, monkeypatch):
    """Chunks of 300 bytes, slices of 400: passages cross borders at different places of different texts."""
    monkeypatch.setattr(repeats, "TOGETHER", 300)
    monkeypatch.setattr(repeats, "LONG", 400)
    rng = random.Random(8)
    passages = ["".join(rng.choices("abcdefgh  ", k=rng.randint(90, 700))) for _ in range(6)]
    texts = ["".join(rng.choice(passages)[rng.randint(0, 40) :] + "".join(rng.choices("xyz ", k=rng.randint(0, 90))) for _ in range(rng.randint(1, 6))) for _ in range(40)]
    texts += ["ab" * 900, "ab" * 800 + "c" + "ab" * 300]
    docs = documents(spark, texts).repartition(4)
    assert sorted(map(tuple, suffix_dedup.dedup_report(docs).collect())) == brute_bytes(list(enumerate(texts)), 100)
    assert sorted(map(tuple, substring_dedup.dedup_report(docs, 10).collect())) == brute_words(list(enumerate(texts)), 10)


def test_suffix_dedup_of_one_frequent_passage(spark):
    """A passage of 90 bytes with 700 different surroundings, and pairs of equal surroundings."""
    rng = random.Random(3)
    passage = "".join(rng.choices("abcdefgh ", k=90))
    texts = [f"{rng.random()} {k % 350} {passage}{k % 175} {rng.random()}" for k in range(700)]
    got = sorted(map(tuple, suffix_dedup.dedup_report(documents(spark, texts).repartition(5)).collect()))
    assert got == brute_bytes(list(enumerate(texts)), 100) and sum(r[2] for r in got) > 10_000


def test_suffix_dedup_of_long_periodic_texts_and_many_repeated_rows(spark):
    long, odd = "abc" * 3_400_000, "".join(f"line {k % 7} of " for k in range(3000))
    rows = [(1, long), (2, long[1:] + "end"), (3, odd), *[(4, odd + "x")] * 300]
    got = {tuple(r)[:4] for r in suffix_dedup.dedup_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, len(long), len(long) - 3, 1), (2, len(long) + 2, len(long) - 1, 1), (3, len(odd), len(odd) - 70, 1), (4, len(odd) + 1, len(odd), 1)}


@pytest.mark.parametrize("stride", [3, 256])
def test_suffix_array_and_common_prefixes(stride, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "STRIDE", stride)
    rng = random.Random(5)
    for _ in range(30):
        parts = ["".join(rng.choices("ab", k=rng.randint(1, 40))).encode() for _ in range(rng.randint(1, 6))]
        text = b"".join(p + b"\0" for p in parts)
        raw = np.frombuffer(text, dtype=np.uint8)
        first = np.concatenate(([0], np.cumsum([len(p) + 1 for p in parts])))
        order, rank = suffix_dedup.suffix_array(raw, first)
        whole = [(list(p[a:]) + [-len(parts) + k], first[k] + a) for k, p in enumerate(parts) for a in range(len(p) + 1)]
        assert order.tolist() == [at for _, at in sorted(whole)]
        prefixes = suffix_dedup.common_prefixes(raw, first, order, rank)
        capped = suffix_dedup.common_prefixes(raw, first, order, rank, 4)
        assert capped.tolist() == np.minimum(prefixes, 4).tolist()
        texts = [s for s, _ in sorted(whole)]
        for k in range(1, len(texts)):
            same = next(i for i, (x, y) in enumerate(zip(texts[k - 1], texts[k], strict=False)) if x != y)
            assert prefixes[k] == same
