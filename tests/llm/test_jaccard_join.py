"""The Jaccard join against all pairs."""

import random

import pytest
from tests.llm.helpers import clashing, documents, edge_cases

from tessera.llm import jaccard_join as jj


def brute(pairs):
    sets = {}
    for i, t in pairs:
        w = (t or "").encode().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    links, texts = dict.fromkeys(sets, 0), {i: set() for i in sets}
    for i in sets:
        for j in sets:
            a, b = sets[i], sets[j]
            if i != j and a and b and 5 * len(a & b) >= 4 * len(a | b):
                links[i] += 1
                if a != b:
                    texts[i].add(frozenset(b))
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    same = {i: min([j for j in sets if sets[j] == sets[i] and sets[i]] or [i]) for i in sets}
    return sorted((i, find(i), same[i], links[i], len(texts[i])) for i in sets)


def brute_rows(rows):
    """As brute, for rows whose ids may repeat: each row is a document."""
    whole = brute([(k, t) for k, (_, t) in enumerate(rows)])
    first = {}
    for k, root, same, *_ in whole:
        for group in (("c", root), ("t", same)):
            first[group] = min(first.get(group, rows[k][0]), rows[k][0])
    return sorted((rows[k][0], first["c", root], first["t", same], links, texts) for k, root, same, links, texts in whole)


def near_copies(rng, groups, size, words=60, edits=4):
    out = []
    for _ in range(groups):
        base = [f"w{rng.randrange(500)}" for _ in range(words)]
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.randint(0, edits)):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(500)}"
            if rng.random() < 0.3:
                copy = copy[rng.randint(0, 6) :]
            out.append(" ".join(copy))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize(("seed", "together"), [(0, 256), (1, 6)])
def test_join_equals_all_pairs(spark, seed, together, monkeypatch):
    monkeypatch.setattr(jj, "TOGETHER", together)
    rng = random.Random(seed)
    texts = edge_cases() + near_copies(rng, 8, 12) + near_copies(rng, 3, 6, words=9, edits=1) + ["one two", "one  two", "one two three four five"]
    docs = clashing(documents(spark, texts).repartition(5))
    got = sorted(map(tuple, jj.jaccard_join(docs).collect()))
    assert got == brute(list(enumerate(texts)))


def test_keep_one_of_each(spark):
    texts = [None, "", "a b c d e f g h i j", "a b c d e f g h i j", "x", "x", ""]
    docs = documents(spark, texts)
    out = jj.keep_one_of_each(docs)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == [0, 1, 2, 4, 6]
    no_id = spark.createDataFrame([(None, "x", None, None, None)], docs.schema)
    assert jj.keep_one_of_each(docs.unionAll(no_id)).count() == 6
    assert jj.keep_one_of_each(docs.limit(0)).count() == 0


def test_pruning_table():
    assert jj.least_matches(125, 0.8, 1e-5) < 100 * 0.95
    least = [jj.least_matches(n, 0.8, 1e-5) for n in (25, 50, 75, 100, 125)]
    assert least == sorted(least) and least[0] > 0


def test_keep_one_of_each_of_repeated_rows(spark):
    plain = lambda a: " ".join(f"w{a}x{k}" for k in range(40))
    docs = clashing(documents(spark, [plain(1), plain(1) + " tail", plain(2), "", None]))
    other = documents(spark, [plain(3)], start=2)
    out = jj.keep_one_of_each(docs.unionAll(docs).unionAll(docs).unionAll(clashing(other)))
    assert out.columns == docs.columns
    got = sorted((r.doc_id, r.text or "") for r in out.collect())
    assert got == sorted([(0, plain(1)), (2, plain(2)), (2, plain(3))] + 3 * [(3, "")] + 3 * [(4, "")])


@pytest.mark.parametrize("together", [2, 256])
def test_repeated_ids_of_different_texts(spark, together, monkeypatch):
    monkeypatch.setattr(jj, "TOGETHER", together)
    plain = lambda a: " ".join(f"w{a}x{k}" for k in range(40))
    rows = [(1, plain(1)), (1, plain(2)), (2, plain(1) + " tail"), (3, plain(2) + " tail"), (-4, plain(2)), (-4, plain(2)), (5, plain(5)), (5, ""), (6, plain(1) + " other")]
    rng = random.Random(4)
    rows += [(rng.randint(10, 20), t) for t in near_copies(rng, 4, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, jj.jaccard_join(docs).collect())) == brute_rows(rows)


def test_bands_and_pruning_lose_what_the_docstring_says(spark):
    """All pairs near the threshold that bands and pruning lose, against the binomial figures."""
    rng = random.Random(7)
    pairs = 400
    texts = []
    for k in range(pairs):  # pairs of a likeness just above 0.8
        words = [f"p{k}w{i}" for i in range(105)]
        other = list(words)
        for i in rng.sample(range(5), 1):
            other[i * 20] = f"p{k}x"
        texts += [" ".join(words), " ".join(other[:93])]
    got = jj.jaccard_join(documents(spark, texts)).where("n_links > 0").count()
    expected = sum(r[3] > 0 for r in brute_pairs(texts))
    assert expected > 0 and got >= 0.99 * expected


def brute_pairs(texts):
    """brute for texts of which only neighbours (2k, 2k + 1) can be alike."""
    out = []
    for k in range(0, len(texts), 2):
        out += [(k + i, 0, 0, n, 0) for i, (_, _, _, n, _) in enumerate(brute(list(enumerate(texts[k : k + 2]))))]
    return out
