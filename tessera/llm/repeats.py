"""Finding repeated fixed-length windows without shuffling a row for every window.

A window of W units (words or bytes) holds W - k + 1 grams of k units; the smallest of
their Rabin-Karp hashes is the window's anchor.  Equal windows have equal anchors, so a
window whose anchor occurs nowhere else cannot repeat.  Consecutive windows with the same
anchor form a fragment, about one for every (W - k) / 2 units, and only fragments travel:

1. anchors are counted; those seen once are forgotten;
2. fragments with a shared anchor are compared as wholes, by a hash of all their units.
   Of equal fragments all but the first lose every window;
3. first fragments whose anchor also has *different* fragments (or, where a window may repeat
   its own document, occurs twice in the fragment itself) are contested: their
   windows are compared by the calling operator's own method.

No repeat is missed whatever the hash values; different contents are told apart by 128 bits,
the anchor and the hash of the whole.  A third of all rows in one group shrinks to one row a
task before the counts of steps 1 and 2, and the joins are of written tables on both sides,
so skewed keys can be split at run time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import built, materialise, mix, odd_powers, release

U64 = np.uint64
BASE = 0xD1342543DE82EF95
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes hashed together; longer texts are hashed by themselves, in slices of LONG bytes.
TOGETHER, LONG = 1 << 18, 1 << 20


class Tables:
    """Powers of BASE and of its inverse modulo 2 ** 64, extended on demand."""

    def __init__(self):
        self.n = 0

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, 1 << 16)
            self.up, self.down = odd_powers(BASE, self.n), odd_powers(INVERSE, self.n)
        return self.up, self.down


class Rolling:
    """Rabin-Karp hashes of any runs of units: prefix sums of unit hashes times inverse powers."""

    def __init__(self, units: np.ndarray, tables: Tables):
        self.up, down = tables.get(len(units) + 1)
        self.sums = np.zeros(len(units) + 1, dtype=U64)
        np.cumsum(units * down[: len(units)], out=self.sums[1:])

    def all(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return mix((self.sums[length:] - self.sums[:n]) * self.up[:n])

    def at(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.up[start])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def hold_twice(grams: np.ndarray, least: np.ndarray, wide: int, start: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Whether each fragment holds its anchor more than once; least: the smallest gram of each window of wide grams."""
    if not len(start):
        return np.zeros(0, dtype=bool)
    # A gram is some window's smallest if it equals the largest of the minima of the windows over it.
    edge = np.zeros(wide - 1, dtype=U64)
    largest = ~sliding_min(~np.concatenate([edge, least, edge]), wide)
    chosen = np.flatnonzero(grams == largest)
    value = grams[chosen]
    at, stop = np.searchsorted(chosen, start), np.searchsorted(chosen, start + windows + wide - 1)
    count = np.zeros(len(start), dtype=np.int64)
    live = np.arange(len(start))
    while len(live):
        count[live] += value[at[live]] == least[start[live]]
        at[live] += 1
        live = live[(at[live] < stop[live]) & (count[live] < 2)]
    return count > 1


@dataclass(frozen=True)
class Scheme:
    """What a unit is, how long windows and grams are, and what counts as earlier."""

    window: int
    gram: int
    #: (texts in UTF-8, tables) -> hash of every unit, index of the first unit of each text and the end.
    units: Callable
    #: Whether a window may repeat an earlier one of its own document.
    within: bool


def byte_units(texts: list[bytes], tables: Tables) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join(texts), dtype=np.uint8)
    return BYTE_HASH[raw], np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))


BYTE_HASH = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_places(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of every word of a buffer."""
    space = IS_SPACE[raw]
    before = np.concatenate(([True], space))
    after = np.concatenate((space, [True]))
    return np.flatnonzero(before[:-1] & ~space), np.flatnonzero(~space & after[1:]) + 1


def word_units(texts: list[bytes], tables: Tables) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"\n".join(texts), dtype=np.uint8)
    offsets = np.cumsum([0] + [len(t) + 1 for t in texts], dtype=np.int64)
    start, stop = word_places(raw)
    hashes, a = np.empty(len(start), dtype=U64), 0
    while a < len(start):  # words within LONG bytes at once, or a single one
        b = max(a + 1, int(np.searchsorted(stop, start[a] + LONG, side="right")))
        at = start[a]
        hashes[a:b] = Rolling(BYTE_HASH[raw[at : stop[b - 1]]], tables).at(start[a:b] - at, stop[a:b] - at)
        a = b
    return hashes, np.searchsorted(start, offsets)


def fragments(texts: list[bytes], scheme: Scheme, tables: Tables) -> dict[str, np.ndarray]:
    """Fragments of texts: index of the text, first unit in it, number of windows, anchor, hash of all units."""
    units, first = scheme.units(texts, tables)
    w, none = scheme.window, np.zeros(0, dtype=np.int64)
    if len(units) < w:
        return {"text": none, "start": none, "windows": none, "anchor": none.view(U64), "whole": none.view(U64), "twice": none > 0}
    rolling = Rolling(units, tables)
    grams, wide = rolling.all(scheme.gram), w - scheme.gram + 1
    least = anchor = sliding_min(grams, wide)
    end = np.repeat(first[1:], np.diff(first))  # of the text that a unit belongs to
    at = np.flatnonzero(np.arange(len(anchor)) + w <= end[: len(anchor)])
    anchor = anchor[at]
    new = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)))) if len(at) else none
    start, windows = at[new], np.diff(np.append(new, len(at)))
    text = np.searchsorted(first, start, side="right") - 1
    if scheme.gram == w:  # the anchor is the whole window: another hash tells contents apart
        rolling = Rolling(mix(units), tables)
    return {
        "text": text,
        "start": start - first[text],
        "windows": windows,
        "anchor": anchor[new],
        "whole": rolling.at(start, start + windows + w - 1),
        "twice": hold_twice(grams, least, wide, start, windows) if scheme.within else np.zeros(len(start), dtype=bool),
    }


def in_chunks(ids: list, texts: list[str | None]) -> Iterator[tuple[list, list[bytes]]]:
    """Rows with an id and a text, gathered up to TOGETHER bytes."""
    part_ids, part, size = [], [], 0
    for i, t in zip(ids, texts, strict=True):
        if i is None or not t:
            continue
        raw = t.encode("utf-8", "surrogatepass")
        if part and size + len(raw) > TOGETHER:
            yield part_ids, part
            part_ids, part, size = [], [], 0
        part_ids.append(i)
        part.append(raw)
        size += len(raw)
    if part:
        yield part_ids, part


def in_slices(ids: list, texts: list[str | None], scheme: Scheme) -> Iterator[tuple[list, np.ndarray, list[bytes]]]:
    """As in_chunks, with the first unit of each piece: long texts whose units are bytes come in slices.

    Slices overlap so that each window is in one of them.  A fragment that a border cuts has
    other contents than its copies elsewhere, and is contested rather than equal.
    """
    for some, parts in in_chunks(ids, texts):
        if scheme.units is not byte_units or len(parts[0]) <= LONG:
            yield some, np.zeros(len(some), dtype=np.int64), parts
            continue
        for at in range(0, len(parts[0]), LONG):  # a long text comes alone
            yield some, np.array([at]), [parts[0][at : at + LONG + scheme.window - 1]]


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def shared_fragments(docs: DataFrame, scheme: Scheme) -> DataFrame:
    """Written table (anchor, whole, doc_id, start, windows, twice) of the fragments whose anchor is shared."""

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Tables()
        for batch in batches:
            for ids, _, texts in in_slices(batch.column(0).to_pylist(), batch.column(1).to_pylist(), scheme):
                f = fragments(texts, scheme, tables)
                if scheme.within:
                    anchor, n = np.unique(np.concatenate([f["anchor"], f["anchor"][f["twice"]]]), return_counts=True)
                    yield pa.record_batch([signed(anchor), pa.array(n.astype(np.int64)), pa.array(n.astype(np.int64))], ["anchor", "low", "high"])
                else:
                    owner = np.array(ids, dtype=np.int64)[f["text"]]
                    order = np.lexsort((owner, f["anchor"]))
                    anchor, owner = f["anchor"][order], owner[order]
                    cut = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1]))) if len(anchor) else order
                    last = np.append(cut[1:], len(anchor))[: len(cut)] - 1
                    yield pa.record_batch([signed(anchor[cut]), pa.array(owner[cut]), pa.array(owner[last])], ["anchor", "low", "high"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Tables()
        for batch in batches:
            for ids, offsets, texts in in_slices(batch.column(0).to_pylist(), batch.column(1).to_pylist(), scheme):
                f = fragments(texts, scheme, tables)
                owner = np.array(ids, dtype=np.int64)[f["text"]]
                # Three small fields in one: rows of this table are the bulk of what is shuffled.
                place = (f["start"] + offsets[f["text"]]).astype(np.int64) << 32 | f["windows"].astype(np.int64) << 1 | f["twice"]
                yield pa.record_batch([signed(f["anchor"]), signed(f["whole"]), pa.array(owner), pa.array(place)], ["anchor", "whole", "doc_id", "place"])

    counted = docs.mapInArrow(anchors, "anchor long, low long, high long").groupBy("anchor")
    if scheme.within:
        shared = counted.agg(F.sum("low").alias("n")).where("n > 1")
    else:
        shared = counted.agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high")
    shared = materialise(shared.select("anchor"), "anchors")
    every = docs.mapInArrow(rows, "anchor long, whole long, doc_id long, place long")
    found = every.join(built(shared), "anchor")
    place = F.col("place")
    start, windows = F.shiftright(place, 32).cast("int"), F.shiftright(place.bitwiseAND(0xFFFFFFFF), 1).cast("int")
    twice = place.bitwiseAND(1) == 1
    out = found.select("anchor", "whole", "doc_id", start.alias("start"), windows.alias("windows"), twice.alias("twice"))
    out = materialise(out, "fragments")
    release(shared)
    return out


#: What becomes of a fragment: every window repeats an earlier one; contested; contested, and it may repeat itself.
SURE, CONTESTED, REPETITIVE = 0, 1, 2


def judged(found: DataFrame, scheme: Scheme) -> DataFrame:
    """Written table (doc_id, spans) with spans: (start, windows, anchor, kind) of fragments to be cut or contested.

    found is deleted afterwards.  A contested fragment is the first of its content, and its
    anchor has other contents as well, or occurs twice in it.  Rows that repeat an id and a
    text have equal spans, which are listed once.
    """
    if scheme.within:
        first = F.min(F.struct("doc_id", "start"))
        later = F.struct(F.col("doc_id"), F.col("start")) > F.col("first")
    else:
        first = F.min("doc_id")
        later = F.col("doc_id") > F.col("first")
    contents = found.groupBy("anchor", "whole").agg(first.alias("first"))
    contents = materialise(contents, "contents")
    numbers = materialise(contents.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")), "kinds")
    kinds = materialise(contents.join(numbers, "anchor"), "judged")
    release(contents, numbers)
    kind = F.when(later, F.lit(SURE)).when(F.col("twice"), F.lit(REPETITIVE)).when(F.col("kinds") > 1, F.lit(CONTESTED))
    spans = found.join(kinds, ["anchor", "whole"]).select("doc_id", "start", "windows", "anchor", kind.alias("kind")).where("kind is not null")
    out = materialise(spans.groupBy("doc_id").agg(F.collect_set(F.struct("start", "windows", "anchor", "kind")).alias("spans")), "spans")
    release(found, kinds)
    return out


def spans_of_mask(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and length of each run of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return edge[::2], edge[1::2] - edge[::2]


def runs_of_arrays(start: np.ndarray, stop: np.ndarray) -> list[tuple[int, int]]:
    """Disjoint, maximal half-open runs, in order, that cover what half-open spans cover."""
    if not len(start):
        return []
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(stop[order])
    first = np.flatnonzero(np.concatenate(([True], start[1:] > reach[:-1])))
    last = np.append(first[1:], len(start)) - 1
    return list(zip(start[first].tolist(), reach[last].tolist(), strict=True))
