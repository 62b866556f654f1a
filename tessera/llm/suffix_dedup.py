"""Suffix-array deduplication of byte strings.

A byte goes if a string of ``length`` bytes over it also starts earlier: in a document
with a smaller doc_id, or earlier in the same document.  Matches never cross documents and
are judged on the input.

Documents are first reduced to contested fragments (see repeats): strings whose anchor
gram of a third of the length is shared but whose surroundings differ.  These pieces are
cut again by longer anchors, of two thirds of the length, and what is unique, or equal as
a whole, is settled.  The pieces of one anchor that are still contested may hold equal
strings; where they take more than GROUP_BYTES together, they are cut by ever longer
anchors, so that no anchor has more pieces than one task holds, however frequent it is.

The rest is dealt by anchor to tasks.  A task cuts its pieces into shards of SHARD_BYTES.
Each shard gets a suffix array in numpy by Larsson-Sadakane refinement: suffixes are ranked
by their first h bytes, and only groups that are still tied are sorted again by the rank h
bytes further on, h doubling.  Kasai's scan, by cursors side by side, gives the common
prefixes of neighbours; neighbours that share ``length`` bytes are one string.  The shards'
sorted lists of distinct strings are merged by binary search, and each string's earliest
place is kept.  Strings are compared byte by byte there.

Null and empty texts have no bytes.  Rows without doc_id are never cut and never count as
earlier.  Rows that repeat an id and its text get the same result; an id is expected to
stand for one text, and must be a number.  Periodic texts of any length are cut into slices.
An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import built, materialise, mix, release, texts_of
from tessera.llm.repeats import BYTE_HASH, REPETITIVE, TOGETHER, Rolling, Scheme, Tables, byte_units, fragments, signed, spans_of_mask
from tessera.llm.resolve import remove_repeats, span_arrays

LENGTH = 100
#: Bytes of the pieces of one anchor beyond which they are cut by longer anchors.
GROUP_BYTES = 1 << 18
#: Bytes of pieces that one task is meant for, and those of one suffix array.
TASK_BYTES, SHARD_BYTES = 1 << 21, 1 << 19
#: Windows of a fragment that repeats itself which are looked at together, and of one piece.
SLICE, PIECE = 1 << 16, 1 << 12
#: Positions of a fragment that one cursor of the common-prefix scan takes.
STRIDE = 256
U64 = np.uint64


def scheme_for(length: int) -> Scheme:
    return Scheme(length, max(1, length // 3), byte_units, within=True)


def suffix_array(raw: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of fragments and rank of every position.

    raw holds the fragments one after the other, each followed by a byte that is read as a
    terminator of its own, smaller than any byte; first has the start of each and the end.
    """
    n = len(raw)
    size = np.diff(first)
    fragment = np.repeat(np.arange(len(size)), size)
    ends = first[1:] - 1
    end = ends[fragment]
    letters = raw.astype(np.int64) + 1
    letters[ends] = 0
    # The first seven letters as one number; nothing after a terminator.
    key = letters.copy()
    for k in range(1, 7):
        at = np.arange(k, n + k)
        key *= 257
        key += np.where(at <= end, letters[np.minimum(at, n - 1)], 0)
    key[ends] = np.arange(len(size)) - len(size)
    order = np.argsort(key)
    rank = np.zeros(n, dtype=np.int64)
    sorted_key = key[order]
    new = np.concatenate(([True], sorted_key[1:] != sorted_key[:-1])) if n else np.zeros(0, dtype=bool)
    # The rank of a group is the place of its first member, so a group that is refined keeps its range.
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    h = 7
    while True:
        tied = ~(new & np.append(new[1:], True))
        place = np.flatnonzero(tied)
        if not len(place):
            return order, rank
        members = order[place]
        group = rank[members]
        ahead = rank[np.minimum(members + h, end[members])]
        key = group * n + ahead  # one number for both, so one sort is enough
        again = np.argsort(key)
        members, key = members[again], key[again]
        order[place] = members
        start = np.concatenate(([True], key[1:] != key[:-1]))
        new[place] = start
        rank[members] = np.maximum.accumulate(np.where(start, place, 0))
        h *= 2


def common_prefixes(raw: np.ndarray, first: np.ndarray, order: np.ndarray, rank: np.ndarray, most: int | None = None) -> np.ndarray:
    """Kasai: bytes, up to most, that each suffix of the array shares with the one before it.

    A position's shared bytes are at least those of the position before less one, so a
    cursor compares each byte about once.  Cursors run side by side, one for every STRIDE
    positions of a fragment, so that a long fragment takes no more steps than a short one.
    """
    n = len(raw)
    out = np.zeros(n, dtype=np.int64)
    if not n:
        return out
    size = np.diff(first)
    end = np.repeat(first[1:] - 1, size)
    most = n if most is None else most
    cursors = -(-size // STRIDE)
    number = np.arange(cursors.sum()) - np.repeat(np.cumsum(cursors) - cursors, cursors)
    start = np.repeat(first[:-1], cursors) + number * STRIDE
    sizes = np.minimum(np.repeat(size, cursors) - number * STRIDE, STRIDE)
    live = np.argsort(-sizes, kind="stable")
    sizes, start = sizes[live], start[live]
    shared = np.zeros(len(start), dtype=np.int64)
    for step in range(int(sizes[0])):
        k = np.searchsorted(-sizes, -step, side="left")  # cursors with further positions
        at = start[:k] + step
        place = rank[at]
        before = order[np.maximum(place - 1, 0)]
        room = np.minimum(np.minimum(end[at] - at, end[before] - before), most)
        room[place == 0] = 0
        have = np.minimum(np.maximum(shared[:k] - 1, 0), room)
        going = np.flatnonzero(have < room)
        while len(going):
            going = going[raw[at[going] + have[going]] == raw[before[going] + have[going]]]
            have[going] += 1
            going = going[have[going] < room[going]]
        out[place] = have
        shared[:k] = have
    return out


class Shard:
    """The strings of ``length`` bytes of some pieces, in sorted order with equal ones numbered alike."""

    def __init__(self, pieces: list[bytes], length: int):
        text = b"".join(f + b"\0" for f in pieces)
        raw = np.frombuffer(text, dtype=np.uint8)
        first = np.concatenate(([0], np.cumsum([len(f) + 1 for f in pieces], dtype=np.int64)))
        order, rank = suffix_array(raw, first)
        prefixes = common_prefixes(raw, first, order, rank, length)
        end = np.repeat(first[1:] - 1, np.diff(first))
        whole = np.flatnonzero(end[order] - order >= length)
        at = order[whole]
        new = prefixes[whole] < length
        self.string = np.cumsum(new) - 1
        self.piece = np.searchsorted(first, at, side="right") - 1
        self.offset = at - first[self.piece]
        # Fixed-width byte strings compare like their bytes, and are sorted here as their suffixes are.
        views = np.lib.stride_tricks.sliding_window_view(raw, length) if len(raw) >= length else np.zeros((0, length), dtype=np.uint8)
        self.distinct = np.ascontiguousarray(views[at[new]]).view(f"S{length}").ravel()


def least_owner(string: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest (doc, start) of each string, by string number."""
    order = np.lexsort((start, doc, string))
    first = np.concatenate(([True], np.diff(string[order]) != 0)) if len(order) else np.zeros(0, dtype=bool)
    return doc[order][first], start[order][first]


def window_runs(doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, first start and number of windows of each run of windows that start one after the other."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    first = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + 1)))) if len(doc) else order
    last = np.append(first[1:], len(doc))[: len(first)] - 1
    return doc[first], start[first], start[last] - start[first] + 1


Strings = tuple[np.ndarray, np.ndarray, np.ndarray]


def merge_sorted(one: Strings, other: Strings) -> Strings:
    """Merge two sorted lists (string, doc, start) of distinct strings by binary search; of equal ones the smaller (doc, start) stays."""
    if len(one[0]) < len(other[0]):
        one, other = other, one
    (string, doc, start), (s, d, a) = one, other
    place = np.searchsorted(string, s)
    known = np.zeros(len(s), dtype=bool)
    inside = place < len(string)
    known[inside] = string[place[inside]] == s[inside]
    doc, start, to = doc.copy(), start.copy(), place[known]
    less = (d[known] < doc[to]) | ((d[known] == doc[to]) & (a[known] < start[to]))
    doc[to[less]], start[to[less]] = d[known][less], a[known][less]
    new = ~known
    return np.insert(string, place[new], s[new]), np.insert(doc, place[new], d[new]), np.insert(start, place[new], a[new])


def merged(lists: list[Strings]) -> Strings:
    """Sorted lists merged two by two."""
    while len(lists) > 1:
        lists = [merge_sorted(*lists[k : k + 2]) if k + 1 < len(lists) else lists[k] for k in range(0, len(lists), 2)]
    return lists[0]


def shard_ends(size: np.ndarray) -> list[int]:
    """Ends of consecutive shards of about SHARD_BYTES, given the bytes of pieces."""
    shard = np.cumsum(size) // SHARD_BYTES
    return [*(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(size)] if len(size) else []


def later_windows(doc: np.ndarray, start: np.ndarray, pieces: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs (doc, start, number) of the windows of pieces whose string also starts earlier in some piece."""
    shards, lists, a = [], [], 0
    for b in shard_ends(np.array([len(p) for p in pieces], dtype=np.int64)):
        shard = Shard(pieces[a:b], length)
        own = doc[a:b][shard.piece], start[a:b][shard.piece] + shard.offset
        shards.append((shard, *own))
        lists.append((shard.distinct, *least_owner(shard.string, *own)))
        a = b
    if not shards:
        return doc, start, start
    string, least_doc, least_start = merged(lists)
    gone = []
    for shard, own_doc, own_start in shards:
        place = np.searchsorted(string, shard.distinct)[shard.string]
        later = (own_doc != least_doc[place]) | (own_start != least_start[place])
        gone.append((own_doc[later], own_start[later]))
    return window_runs(*(np.concatenate(x) for x in zip(*gone, strict=True)))


def first_windows(raw: bytes, length: int, tables: Tables) -> np.ndarray:
    """Whether each window of raw is the first of its content, by 128 bits of hash."""
    units = BYTE_HASH[np.frombuffer(raw, dtype=np.uint8)]
    one, two = Rolling(units, tables).all(length), Rolling(mix(units), tables).all(length)
    order = np.lexsort((two, one))
    again = (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1])
    out = np.ones(len(order), dtype=bool)
    out[order[1:][again]] = False
    return out


PIECES = "doc_id long, start int, windows int, bytes binary"
FOUND = "anchor long, whole long, doc_id long, piece int, place long"


def pieces_of(contested: DataFrame, length: int) -> DataFrame:
    """Written table PIECES of contested fragments; without bytes: windows that repeat earlier ones of their own fragment.

    The windows of one piece are all different.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Tables()
        for batch in batches:
            docs, starts, counts, parts = [], [], [], []
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), span_arrays(batch.column(2)), strict=True)
            for doc_id, text, spans in rows:
                raw = text.encode("utf-8", "surrogatepass")
                use = np.flatnonzero((spans["kind"] > 0) & (spans["start"] + spans["windows"] + length - 1 <= len(raw)))
                plain = use[(spans["kind"][use] != REPETITIVE) & (spans["windows"][use] <= PIECE)]
                found = [(a, n, True) for a, n in zip(spans["start"][plain].tolist(), spans["windows"][plain].tolist(), strict=True)]
                for k in np.setdiff1d(use, plain).tolist():
                    begin, end = int(spans["start"][k]), int(spans["start"][k] + spans["windows"][k])
                    for lo in range(begin, end, SLICE):
                        hi = min(lo + SLICE, end)
                        mask = first_windows(raw[lo : hi + length - 1], length, tables)
                        found += [(lo + a, n, False) for a, n in zip(*(x.tolist() for x in spans_of_mask(~mask)), strict=True)]
                        for a, n in zip(*(x.tolist() for x in spans_of_mask(mask)), strict=True):
                            found += [(lo + b, min(PIECE, a + n - b), True) for b in range(a, a + n, PIECE)]
                docs += [doc_id] * len(found)
                starts += [a for a, _, _ in found]
                counts += [n for _, n, _ in found]
                parts += [raw[a : a + n + length - 1] if kept else None for a, n, kept in found]
            if docs:
                yield pa.record_batch([pa.array(docs, pa.int64()), pa.array(starts, pa.int32()), pa.array(counts, pa.int32()), pa.array(parts, pa.binary())], ["doc_id", "start", "windows", "bytes"])

    return materialise(contested.mapInArrow(run, PIECES), "pieces")


def piece_chunks(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """(doc_id, start, bytes) of the rows of a batch of pieces, up to TOGETHER bytes at once."""
    doc, start, parts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist()
    group = np.cumsum([len(p) for p in parts]) // TOGETHER
    ends = [*(np.flatnonzero(np.diff(group)) + 1).tolist(), len(parts)] if parts else []
    for a, b in zip([0, *ends], ends, strict=False):
        yield doc[a:b], start[a:b], parts[a:b]


def cut_again(pieces: DataFrame, gram: int, length: int) -> tuple[DataFrame, DataFrame]:
    """Pieces (doc_id, start, bytes) by longer anchors: written tables of the windows that are settled, and of smaller pieces.

    The first has (doc_id, start, windows), windows that repeat earlier ones.  The second has
    the first fragments of their content whose anchor has several contents: (doc_id, start,
    bytes, anchor, size) with the bytes that the anchor's pieces take together.
    """
    scheme = Scheme(length, gram, byte_units, within=False)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Tables()
        for batch in batches:
            for _, _, parts in piece_chunks(batch):
                anchor, n = np.unique(fragments(parts, scheme, tables)["anchor"], return_counts=True)
                yield pa.record_batch([signed(anchor), pa.array(n.astype(np.int64))], ["anchor", "n"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Tables()
        for batch in batches:
            for doc, start, parts in piece_chunks(batch):
                f = fragments(parts, scheme, tables)
                place = f["start"].astype(np.int64) << 32 | f["windows"].astype(np.int64)
                yield pa.record_batch([signed(f["anchor"]), signed(f["whole"]), pa.array(doc[f["text"]]), pa.array(start[f["text"]]), pa.array(place)], ["anchor", "whole", "doc_id", "piece", "place"])

    slim = pieces.select("doc_id", "start", "bytes")
    shared = slim.mapInArrow(anchors, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1")
    shared = materialise(shared.select("anchor"), "anchors")
    found = slim.mapInArrow(rows, FOUND).join(built(shared), "anchor")
    offset, windows = F.shiftright("place", 32).cast("int"), F.col("place").bitwiseAND(0xFFFFFFFF).cast("int")
    found = materialise(found.select("anchor", "whole", "doc_id", "piece", offset.alias("offset"), windows.alias("windows")), "fragments")
    release(shared)
    own = F.struct(F.col("doc_id"), (F.col("piece") + F.col("offset")).alias("start"))
    contents = materialise(found.groupBy("anchor", "whole").agg(F.min(own).alias("first"), F.max("windows").alias("windows")), "contents")
    sums = contents.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.sum(F.col("windows").cast("long") + (length - 1)).alias("size"))
    sums = materialise(sums, "sums")
    judged = materialise(contents.drop("windows").join(sums, "anchor"), "judged")
    release(contents, sums)
    size = F.when(own > F.col("first"), F.lit(0).cast("long")).when(F.col("kinds") > 1, F.col("size"))
    marked = found.join(judged, ["anchor", "whole"]).select("doc_id", "piece", "offset", "windows", "anchor", size.alias("size")).where("size is not null")
    marked = materialise(marked, "marked")
    release(found, judged)
    settled = marked.where("size = 0").select("doc_id", (F.col("piece") + F.col("offset")).alias("start"), "windows")
    settled = materialise(settled, "repeats")
    lists = marked.where("size > 0").groupBy("doc_id", F.col("piece").alias("start")).agg(F.collect_list(F.struct("offset", "windows", "anchor", "size")).alias("parts"))
    lists = materialise(lists, "parts")
    release(marked)
    part = F.explode("parts").alias("part")
    smaller = slim.join(built(lists), ["doc_id", "start"]).select("doc_id", "start", "bytes", part)
    smaller = smaller.select("doc_id", (F.col("start") + F.col("part.offset")).alias("start"), F.expr(f"substring(bytes, part.offset + 1, part.windows + {length - 1})").alias("bytes"), "part.anchor", "part.size")
    smaller = materialise(smaller, "smaller")
    release(lists)
    return settled, smaller


def longer(gram: int, length: int) -> int:
    return gram + (length - gram + 1) // 2


def contested_strings(length: int):
    def settle(contested: DataFrame) -> DataFrame:
        def later(table: pa.Table) -> pa.Table:
            doc, start, windows = later_windows(table.column("doc_id").to_numpy(), table.column("start").to_numpy().astype(np.int64), table.column("bytes").to_pylist(), length)
            return pa.table({"doc_id": doc, "start": start.astype(np.int32), "windows": windows.astype(np.int32)})

        every = pieces_of(contested, length)
        repeats = every.where("bytes is null").select("doc_id", "start", "windows")
        pieces, gram = every.where("bytes is not null"), scheme_for(length).gram
        rest, total, written = None, 0, []
        while True:
            gram = longer(gram, length)
            settled, smaller = cut_again(pieces, gram, length)
            written.append(smaller)
            repeats = repeats.unionByName(settled)
            n_bytes, largest = smaller.agg(F.coalesce(F.sum(F.length("bytes")), F.lit(0)), F.coalesce(F.max("size"), F.lit(0))).head()
            last = largest <= GROUP_BYTES or gram >= length
            few = smaller if last else smaller.where(F.col("size") <= GROUP_BYTES)
            rest, total = few if rest is None else rest.unionByName(few), total + n_bytes
            if last:
                break
            pieces = smaller.where(F.col("size") > GROUP_BYTES)
        tasks = max(total // TASK_BYTES, int(contested.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        task = F.pmod(F.xxhash64("anchor"), F.lit(tasks)).alias("task")
        found = rest.select(task, "doc_id", "start", "bytes").groupBy("task").applyInArrow(later, "doc_id long, start int, windows int")
        repeats = repeats.unionByName(materialise(found, "later"))
        release(*written)
        run = F.struct(F.col("start").alias("a"), (F.col("start") + F.col("windows") + (length - 1)).alias("b"))
        return repeats.groupBy("doc_id").agg(F.collect_list(run).alias("runs"))

    return settle


def dedup_report(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and the SHA-256 of the remaining bytes, for every row."""

    def finish(batch: pa.RecordBatch, cuts: list[list[tuple[int, int]]]) -> pa.RecordBatch:
        total, gone, spans, kept = [], [], [], []
        for text, runs in zip(batch.column(1).to_pylist(), cuts, strict=True):
            raw = (text or "").encode("utf-8", "surrogatepass")
            runs = [(a, min(b, len(raw))) for a, b in runs if a < len(raw)]
            parts, end = [], 0
            for a, b in runs:
                parts.append(raw[end:a])
                end = b
            parts.append(raw[end:])
            total.append(len(raw))
            gone.append(sum(b - a for a, b in runs))
            spans.append(len(runs))
            kept.append(hashlib.sha256(b"".join(parts)).hexdigest())
        columns = [batch.column(0), *(pa.array(x, pa.int64()) for x in (total, gone, spans)), pa.array(kept, pa.string())]
        return pa.record_batch(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return remove_repeats(texts_of(docs), scheme_for(length), contested_strings(length), finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
