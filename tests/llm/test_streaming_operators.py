"""Token counts, decontamination and fingerprints against brute force."""

import hashlib
import random
import re

import pytest
import xxhash
from tests.llm.helpers import clashing, documents, edge_cases

from tessera.llm import decontamination, fingerprints, queries, token_counts


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_token_counts_equal_the_library(spark):
    from tokenizers import Tokenizer

    rng = random.Random(1)
    alphabet = "ab'sStre lLdV 12².,!\n\t\r\x0b\x1c\x1d\x1e\x1f\x85\xa0 ᠎ ​ 　é你́\U0001f600"
    texts = edge_cases() + ["".join(rng.choices(alphabet, k=rng.randint(1, 60))) for _ in range(1500)]
    direct = Tokenizer.from_file(queries.tokenizer_path())
    expected = [
        (i, len((t or "").encode()), n := len(direct.encode(t or "", add_special_tokens=False).ids), n > 1024)
        for i, t in enumerate(texts)
    ]
    got = rows(token_counts.token_counts(clashing(documents(spark, texts)), queries.tokenizer_path()))
    assert sorted(got) == expected


def test_other_vocabularies_are_refused(spark, tmp_path):
    import json
    from pathlib import Path

    parts = json.loads(Path(queries.tokenizer_path()).read_text(encoding="utf-8"))
    parts["pre_tokenizer"] = {"type": "Whitespace"}
    (tmp_path / "other.json").write_text(json.dumps(parts), encoding="utf-8")
    with pytest.raises(ValueError):
        token_counts.token_counts(documents(spark, ["a"]), str(tmp_path / "other.json"))


def test_token_counts_of_an_empty_table(spark):
    assert rows(token_counts.token_counts(documents(spark, []), queries.tokenizer_path())) == []


def brute_contamination(texts, items, window=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    cut = lambda t: word.findall((t or "").translate(lower))
    windows = {}
    for k, t in items:
        w = cut(t)
        for n in [window] if len(w) >= window else [len(w)] if w else []:
            for i in range(len(w) - n + 1):
                windows.setdefault(tuple(w[i : i + n]), set()).add(str(k))
    out = []
    for i, t in enumerate(texts):
        w = cut(t)
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for a in range(len(w) - n + 1):
                if tuple(w[a : a + n]) in windows:
                    hit.update(range(a, a + n))
                    found |= windows[tuple(w[a : a + n])]
        out.append((i, len(w), len(hit), sorted(found)))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_contamination_equals_brute_force(spark, seed, monkeypatch):
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choices(["a", "B", "c,", "d-e", "Éf"], k=n))
    items = [(k, text(rng.choice([0, 1, 4, 9, 10, 11, 25]) if k else 3)) for k in range(12)] + [(98, None), (99, "")]
    items = [(k, t) for k, t in items if t is None or len(t.split()) != 1]
    texts = edge_cases() + [text(rng.randint(0, 60)) for _ in range(60)]
    texts += [text(8) + " " + t + " " + text(8) for _, t in items if t]
    if seed % 2:
        monkeypatch.setattr(decontamination, "MAX_WORDS_EACH", 30)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.contamination(clashing(documents(spark, texts)), bench).drop("spans")
    assert sorted(rows(got)) == brute_contamination(texts, items)


def test_items_longer_than_an_automaton_and_repeated_texts(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "MAX_WORDS_EACH", 25)
    item = " ".join(f"w{k}" for k in range(90))
    words = item.split()
    texts = [" ".join(["x", *words[a : a + n], "y"]) for a in range(0, 80, 3) for n in (9, 10, 31)] * 2 + [item, None]
    bench = spark.createDataFrame([(1, item), (2, "w3 w4"), (3, item + " end")], "item_id long, text string")
    docs = documents(spark, texts).repartition(4)
    got = rows(decontamination.contamination(docs, bench).drop("spans"))
    assert sorted(got) == brute_contamination(texts, [(1, item), (2, "w3 w4"), (3, item + " end")])
    clean = clashing(docs)
    assert decontamination.decontaminate(clean, bench).columns == clean.columns


def test_decontaminate_cuts_spans_and_drops_covered_documents(spark):
    item = " ".join(f"secret{i}" for i in range(12))
    other = " ".join(f"plain{i}" for i in range(30))
    texts = [other, f"{other}, {item.upper()}! {other}", item, None, ""]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = documents(spark, texts)
    out = {r.doc_id: r for r in decontamination.decontaminate(docs, bench).collect()}
    assert sorted(out) == [0, 1, 3, 4]
    assert out[0].text == other and out[3].text is None and out[4].text == ""
    assert out[1].text == f"{other}, ! {other}" and out[1].n_chars == len(out[1].text)
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.decontaminate(docs, nothing).count() == 5


def test_items_with_a_null_id_hit(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "MAX_WORDS_EACH", 20)
    nameless, named = (" ".join(f"{w}{i}" for i in range(12)) for w in ("secret", "public"))
    other = " ".join(f"plain{i}" for i in range(30))
    docs = documents(spark, [f"{other} {nameless}", f"{nameless} {other} {named}", other, nameless])
    bench = spark.createDataFrame([(None, nameless), (7, named), (None, None)], "item_id long, text string")
    got = {r.doc_id: (r.n_hit, r["items"]) for r in decontamination.contamination(docs, bench).collect()}
    assert got == {0: (12, []), 1: (24, ["7"]), 2: (0, []), 3: (12, [])}
    kept = {r.doc_id: r.text.strip() for r in decontamination.decontaminate(docs, bench).collect()}
    assert kept == {0: other, 1: other, 2: other}


def brute_signature(text):
    """The fingerprint by its definition, in whole numbers: 128 minima of 16 bits over the phrases of an LZ78 parse."""
    seen, p = set(), ""
    for c in text:
        p += c
        if p not in seen:
            seen.add(p)
            p = ""
    inverse, whole = pow(0x9E3779B97F4A7C15, -1, 2**64), 2**64
    bins = [0xFFFF] * 128
    for phrase in seen:
        x = sum((ord(c) + 1) * pow(inverse, k, whole) for k, c in enumerate(phrase)) % whole
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % whole
        x = (x ^ x >> 27) * 0x94D049BB133111EB % whole
        x ^= x >> 31
        bins[x >> 57] = min(bins[x >> 57], (x >> 8) % 0xFFFF)
    return bins


def brute_likeness(a, b):
    filled = [(x, y) for x, y in zip(a, b, strict=True) if (x, y) != (0xFFFF, 0xFFFF)]
    return sum(x == y for x, y in filled) / len(filled) if filled else 1.0


def spark_hash(text):
    return 42 if text is None else xxhash.xxh64_intdigest(text.encode(), 42) - 2**64 * (xxhash.xxh64_intdigest(text.encode(), 42) >> 63)


def brute_edit(rows_in):
    """rows_in: (doc_id, text).  Plain LZ78 on both texts."""
    order = sorted(rows_in, key=lambda r: (r[0] is None, -(r[0] or 0), spark_hash(r[1]), r[1] or ""))
    out = []
    for k, (doc_id, text) in enumerate(order):
        text, follow = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        new = text[: len(text) - half] + follow[:half]
        a, b, c = brute_signature(text), brute_signature(new), brute_signature(follow)
        texts = ["".join(f"{x:04x}" for x in bins) for bins in (a, b)]
        out.append((doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), *texts, brute_likeness(a, b), brute_likeness(a, c)))
    return out


def test_edit_likeness_equals_brute_force(spark):
    texts = edge_cases() * 3
    docs = documents(spark, texts).repartition(5)
    got = rows(fingerprints.edit_likeness(clashing(docs)))
    assert sorted(got) == sorted(brute_edit(list(enumerate(texts))))
    equal = {r[3] for r in got if r[0] in (4, 5)}
    assert len(equal) == 1 and min(r[5] for r in got) >= 0


def test_edit_likeness_of_ties_nulls_and_small_tables(spark):
    pairs = [(5, "five a"), (5, "five b"), (None, "none of it"), (-3, "minus three"), (None, None), (7, "")]
    docs = spark.createDataFrame(pairs, "doc_id long, text string")
    got = rows(fingerprints.edit_likeness(docs))
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert sorted(got, key=key) == sorted(brute_edit(pairs), key=key)
    assert rows(fingerprints.edit_likeness(docs.limit(0))) == []
    one = rows(fingerprints.edit_likeness(docs.where("doc_id = 7")))
    assert len(one) == 1 and one[0][5:] == (1.0, 1.0)


def test_frequent_ids_and_nulls_are_dealt_over_buckets(spark):
    pairs = [(7, f"seven {k}") for k in range(300)] + [(None, f"none {k}") for k in range(200)] + [(k, f"text {k}") for k in range(60)]
    docs = spark.createDataFrame(pairs, "doc_id long, text string").repartition(6)
    placed = fingerprints.in_descending_order(docs).where("not guest").groupBy("bucket").count()
    assert placed.agg({"count": "max"}).head()[0] < 200 and placed.count() > 6
    got = rows(fingerprints.edit_likeness(docs))
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert sorted(got, key=key) == sorted(brute_edit(pairs), key=key)


def test_fingerprints_without_order(spark):
    texts = edge_cases()
    got = dict(rows(fingerprints.fingerprints(documents(spark, texts))))
    assert got == {i: fingerprints.fingerprint(t) for i, t in enumerate(texts)}
    assert got == {i: "".join(f"{x:04x}" for x in brute_signature(t or "")) for i, t in enumerate(texts)}
