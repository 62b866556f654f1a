"""Cross-entropy difference against the plain formula."""

import math
import random
from collections import Counter

import pytest
from tests.llm.helpers import clashing, documents, edge_cases

from tessera.llm import lm_scoring


def brute(pairs, target):
    words = {i: (t or "").encode().split() for i, t in pairs}
    uni = {True: Counter(), False: Counter()}
    two = {True: Counter(), False: Counter()}
    for i, w in words.items():
        uni[i in target].update(w)
        two[i in target].update(zip(w, w[1:], strict=False))
    vocabulary = len(uni[True] | uni[False])
    out = {}
    for i, w in words.items():
        own1, own2, loss = Counter(w), Counter(zip(w, w[1:], strict=False)), {}
        for m in (True, False):
            mine = (i in target) == m
            n = sum(uni[m].values()) - mine * len(w)
            total = 0.0
            for k, x in enumerate(w):
                p = (uni[m][x] - mine * own1[x] + 1) / (n + vocabulary)
                if k:
                    v = w[k - 1]
                    p = (two[m][v, x] - mine * own2[v, x] + lm_scoring.PRIOR * p) / (uni[m][v] - mine * own1[v] + lm_scoring.PRIOR)
                total -= math.log(p)
            loss[m] = total / max(1, len(w))
        out[i] = (len(w), loss[True], loss[False], loss[True] - loss[False])
    return out


def test_scores_equal_the_formula(spark):
    rng = random.Random(3)
    texts = edge_cases() + [" ".join(rng.choices(["a", "b", "c", "d", "e\n"], k=rng.randint(0, 50))) for _ in range(80)]
    labels = [(i, rng.choice([0, 1, 1, None]), 0) for i in range(60)] + [(None, 1, 0), (5, 1, 0), (5, 0, 0), (9999, 1, 0)]
    target = {i for i, q, _ in labels if q == 1}
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs = clashing(documents(spark, texts).repartition(4))
    got = {r.doc_id: tuple(r)[1:] for r in lm_scoring.cross_entropy_difference(docs, table).collect()}
    expected = brute(list(enumerate(texts)), target)
    assert got.keys() == expected.keys()
    for i, x in expected.items():
        assert got[i] == pytest.approx(x, abs=1e-9)


def test_few_rows_for_many_blocks(spark):
    """Ranges without n-grams get no rows: far fewer than the square of the blocks."""
    docs = documents(spark, [f"only{k}" for k in range(40)])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        got = {r.doc_id: tuple(r)[1:] for r in lm_scoring.cross_entropy_difference(docs, labels).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    expected = brute([(k, f"only{k}") for k in range(40)], {k for k in range(40) if k % 2})
    assert all(got[k] == pytest.approx(x, abs=1e-9) for k, x in expected.items())


def test_small_tables(spark):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    docs = documents(spark, ["a b", "a b c", None])
    assert lm_scoring.cross_entropy_difference(docs.limit(0), labels).count() == 0
    assert lm_scoring.cross_entropy_difference(docs, labels.limit(0)).count() == 3
    rows = spark.createDataFrame([(None, "a b"), (None, None), (1, "a"), (1, "a")], "doc_id long, text string")
    assert sorted(r.n_tokens for r in lm_scoring.cross_entropy_difference(rows, labels).collect()) == [0, 1, 1, 2]


def test_target_like_documents_score_lower(spark):
    good = ["the cat sat on the mat and slept"] * 5 + ["the dog sat on the rug and slept"] * 5
    bad = ["click here buy now cheap cheap"] * 10
    docs = documents(spark, good + bad)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(5)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.score for r in lm_scoring.cross_entropy_difference(docs, labels).collect()}
    assert max(got[i] for i in range(10)) < min(got[i] for i in range(10, 20))
