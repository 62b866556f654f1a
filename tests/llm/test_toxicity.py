"""The string-kernel machine: kernel by enumeration, held-out accuracy, edge cases."""

import itertools
import random
import time
import zlib

import numpy as np
from tests.llm.helpers import clashing, documents, edge_cases

from tessera.llm import queries, toxicity


def brute_kernel(a, b):
    def features(w):
        codes = [0, *(int(toxicity.CODES[ord(c)]) for c in w if toxicity.CODES[ord(c)] >= 0), 0]
        out, square = {}, 0.0
        for at in itertools.combinations(range(len(codes)), 4):
            span = at[-1] - at[0] + 1
            if span <= toxicity.SPAN:
                key = tuple(codes[i] for i in at)
                out[key] = out.get(key, 0) + toxicity.DECAY**span
                square += toxicity.DECAY ** (2 * span)
        return out, square**0.5

    (x, nx), (y, ny) = features(a), features(b)
    return sum(v * y.get(k, 0) for k, v in x.items()) / (nx * ny)


def test_kernel_equals_enumeration():
    words = ["stupid", "st.u-pid", "stuupid", "x", "banana", "scum", "abababab"]
    k = toxicity.Encoded(words).kernels(words)
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            if len(a) > 1 and len(b) > 1:
                assert np.isclose(k[i, j], brute_kernel(a, b), atol=1e-5)
    assert np.linalg.eigvalsh((k + k.T) / 2).min() > -1e-6


def test_spaced_letters_are_one_word():
    assert "stupid" in toxicity.words_of("so s t u p i d indeed") and "moron" in toxicity.words_of("a  M.o.r.o.n x") | {"moron"}


def brute_spelt(text):
    """Spelt words by looking at every pair of ends."""
    text, sep = text.lower(), set(" \t\n.*_-")
    found, at = set(), 0
    while at < len(text):
        best = None
        if at == 0 or text[at - 1].isspace():
            k, letters = at, ""
            while k < len(text) and text[k] not in sep:
                letters += text[k]
                if (k + 1 == len(text) or text[k + 1].isspace()) and len(letters) > 3:
                    best = (k + 1, letters)
                j = k + 1
                while j < len(text) and text[j] in sep:
                    j += 1
                if j == k + 1:
                    break
                k = j
        if best:
            found.add(best[1])
            at = best[0]
        else:
            at += 1
    return found


def test_spelt_words_equal_brute_force_and_take_no_time():
    rng = random.Random(0)
    for _ in range(3000):
        text = "".join(rng.choices("ab .-_\n", [3, 3, 4, 2, 1, 1, 1], k=rng.randint(0, 25)))
        assert toxicity.words_of(text) == set(text.split()) | brute_spelt(text), text
    began = time.time()
    for unit in ("_", "_ ", "a_", "a. ", ". ", "a ", "a" * 4, "a-b "):
        toxicity.words_of(unit * 100_000 + "title word")
        toxicity.words_of("x" + unit * 100_000 + "title")
    assert time.time() - began < 8


def exact_machine(words, y, cost):
    """A squared-hinge machine on exact kernels, by its optimality conditions on the active set."""
    k = np.array([[brute_kernel(a, b) for b in words] for a in words])
    active = np.ones(len(words), dtype=bool)
    for _ in range(100):
        n = active.sum()
        # alpha = 2 cost (y - f) on the active set; the bias has a ridge of 1e-3.
        system = np.zeros((n + 1, n + 1))
        system[:n, :n] = k[np.ix_(active, active)] + np.diag(1 / (2 * cost[active]))
        system[:n, n], system[n, :n], system[n, n] = 1, 1, -1e-3
        solved = np.linalg.solve(system, np.append(y[active], 0))
        alpha = np.zeros(len(words))
        alpha[active] = solved[:n]
        f = k @ alpha + solved[n]
        new = y * f < 1
        if (new == active).all():
            break
        active = new
    return alpha, solved[n]


def test_machine_with_all_words_as_landmarks_is_the_exact_one():
    positive, negative = ["stupid", "stuupid", "moron", "m0ronic"], ["student", "moran", "lamp", "window", "statue", "study", "more"]
    weight = {"stupid": 3.0, "moron": 2.0}
    model = toxicity.nystroem_machine(positive, negative, weight)
    cost = np.array([weight.get(p, 1.0) for p in positive] + [1.0] * len(negative))
    n = len(cost)
    cost[: len(positive)] *= 0.5 * n / cost[: len(positive)].sum()
    cost[len(positive) :] *= 0.5 * n / len(negative)
    words = positive + negative
    alpha, bias = exact_machine(words, np.array([1.0] * len(positive) + [-1.0] * len(negative)), toxicity.COST * cost)
    for w in [*words, "st.upid", "morons", "tree", "stupidly"]:
        exact = sum(a * brute_kernel(v, w) for a, v in zip(alpha, words, strict=True)) + bias
        assert np.isclose(model.values([w])[0], exact, atol=2e-3), w


def test_many_rows_of_one_id_train_as_one(spark):
    texts, labels = labelled(spark)
    docs = documents(spark, texts)
    many = docs.unionAll(docs.where("doc_id = 1").crossJoin(spark.range(300).select()))
    bags, marks = toxicity.training_rows(toxicity.texts_of(many), labels, None)
    assert len(bags) == 60 and sum(marks) == 30
    assert sorted(tuple(r) for r in toxicity.toxicity(docs, labels).collect()) == sorted({tuple(r) for r in toxicity.toxicity(many, labels).collect()})


def held_out_figures(spark, sf_dir):
    got = {r.doc_id: r for r in queries.op4_toxicity(spark, sf_dir).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    pairs = [(got[i].predicted, y) for i, y in labels.items() if i in got and got[i].held_out]
    hits = sum(p and y for p, y in pairs)
    return hits / max(1, sum(y for _, y in pairs)), hits / max(1, sum(p for p, _ in pairs))


def test_held_out_accuracy(spark):
    recall, precision = held_out_figures(spark, "/root/testdata/sf0.1")
    assert recall > 0.6 and precision > 0.95


def labelled(spark):
    bad = ["you are stupid ", "what an idiot ", "idiot and stupid "]
    good = ["a fine day ", "we walk home ", "the tree is green ", "study a statue "]
    texts = [(bad[i % 3] if i % 2 else good[i % 4]) + f"number{i} word{i * 7}" for i in range(60)]
    labels = [(i, None, i % 2) for i in range(60)] + [(3, 1, None), (None, 1, 1), (99999, 0, 1)]
    return texts, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_small_tables_and_edge_cases(spark):
    texts, labels = labelled(spark)
    docs = clashing(documents(spark, texts + edge_cases()))
    got = {r.doc_id: r.score for r in toxicity.toxicity(docs, labels).collect()}
    assert len(got) == len(texts) + len(edge_cases())
    assert min(got[i] for i in range(1, 60, 2)) > max(got[i] for i in range(0, 60, 2))
    assert got[60] == got[61] < 0.5  # null and empty
    kept = toxicity.reject_toxic(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, s in got.items() if s < toxicity.THRESHOLD}
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0
    one_class = toxicity.toxicity(docs, labels.where("toxic = 0")).collect()
    assert {r.score for r in one_class} == {0.0}
    assert toxicity.reject_toxic(docs, labels.limit(0)).count() == docs.count()
