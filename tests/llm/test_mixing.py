"""Pfair mixing against its definition."""

import hashlib
from collections import Counter
from fractions import Fraction

import pytest
from tests.llm.helpers import clashing, documents

from tessera.llm import mixing


@pytest.mark.parametrize("weights", [{"a": 1}, {"a": 5, "b": 3, "c": 1}, {str(i): i * i + 1 for i in range(40)}])
def test_frame_deviates_less_than_one_block(weights):
    shares = mixing.whole_weights(weights)
    frame = sum(shares.values())
    assert all(n >= 1 for n in shares.values())
    taken = dict.fromkeys(shares, 0)
    for t, s in enumerate(mixing.pfair_frame(shares), 1):
        taken[s] += 1
        assert all(abs(taken[x] - Fraction(shares[x] * t, frame)) < 1 for x in shares)
    assert taken == shares


def expected(pairs, block, weights):
    """By definition: order each source, then take one slot after the other."""
    key = lambda p: (hashlib.md5(str(p[0]).encode()).hexdigest(), p[0])
    name = lambda s: "null" if s is None else f"s{s}"
    rows = {}
    for p in sorted(pairs, key=key):
        rows.setdefault(name(p[1]), []).append(p[0])
    target = mixing.default_weights({s: len(r) for s, r in rows.items()}) | {name(s): Fraction(w) for s, w in weights.items()}
    blocks = {s: [r[i : i + block] for i in range(0, len(r), block)] for s, r in rows.items()}
    at, slot, out = dict.fromkeys(blocks, 0), 0, {}
    while blocks:
        order = mixing.pfair_frame(mixing.whole_weights({s: target[s] for s in blocks}))
        alone, t = len(blocks), 0
        while len(blocks) == alone:
            s = order[t % len(order)]
            for i, d in enumerate(blocks[s].pop(0)):
                out[d] = (at[s], slot, slot * block + i)
            at[s] += 1
            if not blocks[s]:
                del blocks[s]
            t, slot = t + 1, slot + 1
    return out


@pytest.mark.parametrize("weights", [{}, {"src0": 1, "src1": 7, None: 2}])
def test_mixture_follows_the_definition(spark, weights, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP", 20)
    sources = ["src0"] * 300 + ["src1"] * 90 + ["src2"] * 40 + [None] * 25
    docs = clashing(documents(spark, ["t"] * len(sources), sources=sources).repartition(4))
    got = mixing.mix_sources(docs.withColumn("slot", docs.lang), weights, block=4)
    kept = [c for c in docs.columns if c not in ("block", "slot", "place")]
    assert got.columns == [*kept, "block", "slot", "place"]
    rows = {r.doc_id: (r.block, r.slot, r.place) for r in got.collect()}
    assert rows == expected(list(enumerate(sources)), 4, weights)


def test_empty_null_and_repeated_rows(spark):
    docs = documents(spark, ["a", "b", None], sources=["x", "x", None])
    assert mixing.mix_sources(docs.limit(0)).count() == 0
    twice = docs.unionAll(docs).unionAll(spark.createDataFrame([(None, None, None, None, None)], docs.schema))
    got = mixing.mix_sources(twice).collect()
    assert len(got) == 7 and len({r.place for r in got}) == 7


def test_many_sources(spark, monkeypatch):
    """More sources than a frame has slots, and frames that grow with the blocks."""
    monkeypatch.setattr(mixing, "FRAMES", 3)
    sources = [f"s{k % 150}" for k in range(700)]
    docs = spark.createDataFrame(list(enumerate(sources)), "doc_id long, source string")
    rows = {r.doc_id: (r.block, r.slot, r.place) for r in mixing.mix_sources(docs, block=1, frame=10).collect()}
    sizes = Counter(f"s{s}" for s in sources)
    shares, names = mixing.whole_weights(mixing.default_weights(sizes)), sorted(sizes)
    order = mixing.Schedule([shares[s] for s in names], [sizes[s] for s in names]).take(700)
    assert {p: (f"s{sources[i]}", b) for i, (b, _, p) in rows.items()} == {p: (names[s], b) for p, (s, b) in enumerate(order)}


def test_many_rows_without_id(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP", 4)
    rows = [(None, "a")] * 900 + [(7, "a")] * 300 + [(k, "ab"[k % 2]) for k in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, source string").repartition(5)
    got = mixing.mix_sources(docs, {"a": 1, "b": 1}, block=3).collect()
    assert len(got) == 1300 and len({r.place for r in got}) == 1300
    sizes = {s: sum(r[1] == s for r in rows) for s in "ab"}
    assert {s: sorted(r.block for r in got if r.source == s) for s in "ab"} == {s: [k // 3 for k in range(n)] for s, n in sizes.items()}


def drift(order, weights):
    """The largest distance, in blocks, of any source from its exact share after any slot."""
    weights = {x: mixing.exactly(w) for x, w in weights.items()}
    total, taken, worst = sum(weights.values()), dict.fromkeys(weights, 0), Fraction(0)
    for t, s in enumerate(order, 1):
        taken[s] += 1
        worst = max(worst, *(abs(taken[x] - w * t / total) for x, w in weights.items()))
    return worst


@pytest.mark.parametrize("weights", [{"a": 1, "b": 2}, {"a": Fraction(2, 10_000), "b": Fraction(9998, 10_000)}, {"a": 0.1, "b": 1 / 3, "c": 2.5}])
def test_exact_targets_hold_over_many_frames(weights):
    shares = mixing.whole_weights(weights)
    order = mixing.Schedule(list(shares.values()), [30_000] * len(shares)).take(12_000)
    names = list(shares)
    assert drift([names[s] for s, _ in order], weights) < 1


def test_a_schedule_goes_on_from_every_state():
    weights, blocks = [7, 1, 30, 11, 2], [40, 3, 900, 55, 90]
    whole = mixing.Schedule(weights, blocks).take(10**6)
    assert len(whole) == sum(blocks)
    parts = [mixing.Schedule(weights, blocks, *state).take(17) for state in mixing.states(weights, blocks, 17)]
    assert [x for part in parts for x in part] == whole


@pytest.mark.parametrize("frame", [1, 10, 17, 1000, 5000])
def test_leaps_over_periods_change_no_state(frame):
    weights, blocks = [7, 1, 30, 11, 2], [4000, 30, 9000, 5500, 900]
    schedule, played = mixing.Schedule(weights, blocks), []
    while schedule.slot < sum(blocks):
        played.append(schedule.state())
        schedule.take(frame)
    assert list(mixing.states(weights, blocks, frame)) == played


def test_time_of_the_plan_does_not_grow_with_the_blocks(monkeypatch):
    played = Counter()
    take = mixing.Schedule.take

    def counted(self, slots):
        out = take(self, slots)
        played["slots"] += len(out)
        return out

    monkeypatch.setattr(mixing.Schedule, "take", counted)
    sizes = {str(k): 10**9 // (k + 1) for k in range(20)}
    shares = mixing.whole_weights(mixing.default_weights(sizes))
    blocks = list(sizes.values())
    frame = sum(blocks) // mixing.FRAMES
    found = list(mixing.states(list(shares.values()), blocks, frame))
    assert [f[0] for f in found] == list(range(0, sum(blocks), frame)) and all(sum(f[3]) == f[0] for f in found)
    assert played["slots"] < 20 * (3 * sum(shares.values()) + 2 * frame)
    # The leap lands on the states that the schedule itself passes through.
    slot, start, base, done = found[100]
    assert start == 0 and all(abs(d - Fraction(w * slot, sum(shares.values()))) < 1 for d, w in zip(done, shares.values(), strict=True))


def test_floats_count_as_they_print():
    assert mixing.whole_weights({"a": 0.1, "b": 0.2, "c": 0.7}) == {"a": 1, "b": 2, "c": 7}


def test_mixture_keeps_to_exact_targets(spark):
    docs = spark.range(12_000).selectExpr("id as doc_id", "if(id < 4000, 'a', 'b') as source")
    got = mixing.mix_sources(docs, {"a": 1, "b": 2}, block=1).orderBy("place").collect()
    assert [r.place for r in got] == list(range(12_000))
    assert drift([r.source for r in got], {"a": 1, "b": 2}) < 1
