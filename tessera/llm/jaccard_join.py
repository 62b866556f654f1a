"""N-gram Jaccard join with Bayesian candidate pruning.

Documents are sets of shingles of five words.  Equal sets form a class, which goes on as
one.  Banded MinHash keys propose candidates.  Classes that share a bucket get the same
label in two rounds of taking the smallest one, and classes of one label meet in one
task; labels with many classes are cut into blocks and every two blocks meet.  Buckets whose
classes still have several labels are looked at by themselves, so that no pair that shares
a bucket goes unmet, and none is looked at twice.  Pairs with neither a bucket nor a label
in common are not compared: at a likeness of exactly 0.8 a pair shares no bucket with
probability (1 - 0.8 ** 5) ** 25 = 4.9e-5, at a higher likeness with a smaller one.

In a task, MinHash values of a pair are compared STEP at a time.  With a uniform prior, the
probability that the Jaccard likeness reaches the threshold after m equal ones of n is a
binomial tail; pairs whose probability falls below TOLERANCE are dropped (at a likeness of
0.8 each of the five steps loses 0.8e-5 to 2.0e-5 of the pairs, all together at most
6.2e-5), the rest is verified on the shingle sets themselves.  Tasks return counts and each class's smallest
partner in the task, never pairs, so a large group of near copies costs comparisons but no rows.

Texts with one to four words have one shingle of all of them.  Null and empty texts have
none: each is a class of its own without links.  Rows without doc_id have no class and
no links.  Rows that repeat an id count row by row: as further copies where their shingles
are the same, else as documents of their own, which are known apart by their digests though
their class ids may be equal.  Ids must be numbers.  An empty table gives an empty result; further
columns are ignored, or kept by ``keep_one_of_each``.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from fractions import Fraction
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import built, materialise, mix, release, texts_of
from tessera.llm.components import components
from tessera.llm.repeats import Rolling, Tables, in_chunks, word_units

SHINGLE, THRESHOLD, TOLERANCE = 5, Fraction(4, 5), 1e-5
BANDS, ROWS, STEP = 25, 5, 25
#: Classes that meet in one task; more are cut into blocks of half as many.
TOGETHER = 256
U64 = np.uint64
FACTORS = mix(np.arange(1, BANDS * ROWS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)


def shingle_sets(texts: list[bytes], tables: Tables) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    units, first = word_units(texts, tables)
    if not len(units):
        return [np.zeros(0, dtype=U64)] * len(texts)
    rolling = Rolling(units, tables)
    every = rolling.all(SHINGLE) if len(units) >= SHINGLE else np.zeros(0, dtype=U64)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            out.append(np.unique(every[a : b - SHINGLE + 1]))
        else:
            out.append(rolling.at(np.array([a]), np.array([b])) if b > a else np.zeros(0, dtype=U64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values (32 bits each) of sets that are not empty, a row each."""
    start = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1])).astype(np.int64)
    flat = np.concatenate(sets)
    out = np.empty((len(sets), len(FACTORS)), dtype=np.uint32)
    for k, factor in enumerate(FACTORS):
        out[:, k] = np.minimum.reduceat((flat * factor) >> U64(32), start)
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each signature; keys of different bands differ."""
    rows = signature.reshape(len(signature), BANDS, ROWS).astype(U64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15), rows.shape[:2]).copy()
    for r in range(ROWS):
        key = mix(key * U64(0xD1342543DE82EF95) + rows[:, :, r] + U64(1))
    return key


def least_matches(n: int, threshold: float, tolerance: float) -> int:
    """Fewest equal MinHash values of n at which the likeness still reaches threshold with probability tolerance."""
    total = 0.0
    for m in range(n + 2):
        total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if total >= tolerance:
            return m
    return n


def described(docs: DataFrame) -> DataFrame:
    """Written table (doc_id, print, digest of the shingle set, bands) of the documents with words and an id.

    print tells the texts of one id apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Tables()
        for batch in batches:
            ids, prints = batch.column(0).flatten()
            rows = [None if i is None else (i, p) for i, p in zip(ids.to_pylist(), prints.to_pylist(), strict=True)]
            for ids, texts in in_chunks(rows, batch.column(1).to_pylist()):
                sets = shingle_sets(texts, tables)
                keep = [k for k, s in enumerate(sets) if len(s)]
                if not keep:
                    continue
                keys = band_keys(signatures([sets[k] for k in keep])).view(np.int64)
                yield pa.record_batch(
                    [
                        pa.array([{"doc_id": ids[k][0], "print": ids[k][1]} for k in keep], pa.struct([("doc_id", pa.int64()), ("print", pa.int64())])),
                        pa.array([hashlib.blake2b(sets[k].tobytes(), digest_size=16).digest() for k in keep], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32)), pa.array(keys.ravel())),
                    ],
                    ["row", "digest", "bands"],
                )

    prints = docs.select(F.struct("doc_id", F.xxhash64("text").alias("print")).alias("row"), "text")
    found = prints.mapInArrow(run, "row struct<doc_id:long,print:long>, digest binary, bands array<long>")
    return materialise(found.select("row.*", "digest", "bands"), "described")


def sets_of(texts: list[str]) -> list[np.ndarray]:
    tables = Tables()
    return [shingle_sets([t.encode("utf-8", "surrogatepass")], tables)[0] for t in texts]


class Meeting:
    """Classes that meet in a task: their shingles as small numbers, and their signatures."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets])
        self.signature = signatures(sets)
        names, flat = np.unique(np.concatenate(sets), return_inverse=True)
        self.numbers = np.split(flat, np.cumsum(self.size)[:-1])
        self.mark = np.zeros(len(names), dtype=bool)
        self.least = {n: least_matches(n, float(THRESHOLD), TOLERANCE) for n in range(STEP, BANDS * ROWS + 1, STEP)}

    def partners(self, i: int, others: np.ndarray) -> np.ndarray:
        """Those of others whose likeness to i reaches the threshold."""
        p, q = THRESHOLD.numerator, THRESHOLD.denominator
        small, large = np.minimum(self.size[i], self.size[others]), np.maximum(self.size[i], self.size[others])
        others = others[small * q >= large * p]
        equal = np.zeros(len(others), dtype=np.int64)
        for n in range(STEP, BANDS * ROWS + 1, STEP):
            if not len(others):
                return others
            equal = equal + (self.signature[others, n - STEP : n] == self.signature[i, n - STEP : n]).sum(axis=1)
            likely = equal >= self.least[n]
            others, equal = others[likely], equal[likely]
        if not len(others):
            return others
        self.mark[self.numbers[i]] = True
        flat = self.mark[np.concatenate([self.numbers[j] for j in others])]
        start = np.concatenate(([0], np.cumsum(self.size[others])[:-1]))
        common = np.add.reduceat(flat.astype(np.int64), start)
        self.mark[self.numbers[i]] = False
        return others[common * (p + q) >= p * (self.size[i] + self.size[others])]


LINKS = "class binary, text_links long, doc_links long, root binary"


def meet(table: pa.Table) -> pa.Table:
    """Links of each class in one task, and the smallest class of its component there.

    lo and hi: the blocks that meet (equal: all pairs); band: where it is not null, the pairs
    whose labels differ and whose first equal band it is.
    """
    rows = sorted(table.to_pylist(), key=lambda r: (r["class"], r["block"]))
    ids = np.array([r["class"] for r in rows], dtype=object)
    copies = np.array([r["copies"] for r in rows], dtype=np.int64)
    label = np.unique(np.array([r["label"] for r in rows], dtype=object), return_inverse=True)[1]
    block = np.array([r["block"] for r in rows], dtype=np.int64)
    lo, hi, band = rows[0]["lo"], rows[0]["hi"], rows[0]["band"]
    meeting = Meeting(sets_of([r["text"] for r in rows]))
    keys = band_keys(meeting.signature) if band is not None else None
    links, doc_links = np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows), dtype=np.int64)
    root = np.arange(len(rows))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for i in range(len(rows)):
        if lo == hi:
            others = np.arange(i + 1, len(rows))
        elif block[i] == lo:
            others = np.flatnonzero(block == hi)
        else:
            continue
        if band is not None:
            others = others[label[others] != label[i]]
            if len(others):
                same = keys[others] == keys[i]
                others = others[same.any(axis=1) & (same.argmax(axis=1) == band)]
        others = meeting.partners(i, others)
        if len(others):
            links[i] += len(others)
            doc_links[i] += copies[others].sum()
            np.add.at(links, others, 1)
            np.add.at(doc_links, others, copies[i])
            for j in others:
                a, b = find(i), find(j)
                if a != b:
                    root[max(a, b)] = min(a, b)
    linked = np.flatnonzero(links)
    roots = [find(k) for k in linked]
    classes, roots = (pa.array([ids[k] for k in x], pa.binary()) for x in (linked, roots))
    return pa.table({"class": classes, "text_links": links[linked], "doc_links": doc_links[linked], "root": roots})


def tasks_of(classes: DataFrame) -> DataFrame:
    """Written table (task, lo, hi, band, class, block, label): which classes meet where."""
    band = classes.select("class", F.posexplode("bands").alias("band", "key"))
    band = band.select("class", F.col("band").cast("int").alias("band"), "key")
    counts = band.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("class").alias("low")).where("n > 1")
    shared = materialise(band.join(materialise(counts, "buckets"), "key"), "shared")
    # Two rounds of taking the smallest label of the buckets a class is in.
    first = materialise(shared.groupBy("class").agg(F.min("low").alias("label")), "label")
    bucket = materialise(shared.join(first, "class").groupBy("key").agg(F.min("label").alias("low2")), "second")
    label = materialise(shared.drop("low").join(bucket, "key").groupBy("class").agg(F.min("low2").alias("label")), "label")
    sizes = materialise(label.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "sizes")
    blocks = F.when(F.col("n") <= TOGETHER, F.lit(1)).otherwise(F.ceil(F.col("n") * 2 / TOGETHER)).cast("int")
    own = label.join(sizes, "label").select("class", "label", blocks.alias("blocks"), F.pmod(F.xxhash64("class"), blocks).cast("int").alias("block"))
    grouped = own.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        F.col("label").alias("task"), F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), F.lit(None).cast("int").alias("band"), "class", "block", "label"
    )
    # Buckets over several labels; the label group covers all pairs within one label.
    labelled = materialise(shared.select("key", "band", "class", "n").join(label, "class"), "labelled")
    several = materialise(labelled.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("key"), "several")
    rest_blocks = F.when(F.col("n") <= TOGETHER, F.lit(1)).otherwise(F.ceil(F.col("n") * 2 / TOGETHER)).cast("int")
    rest = labelled.join(several, "key").select("*", rest_blocks.alias("blocks"), F.pmod(F.xxhash64("class"), rest_blocks).cast("int").alias("block"))
    rest = rest.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        F.col("key").cast("string").cast("binary").alias("task"), F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "band", "class", "block", "label"
    )
    return materialise(grouped.unionByName(rest), "tasks")


def jaccard_join(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, text_class, n_links, n_text_links of every row.

    text_class: the smallest doc_id with the same shingle set.  class_id: the smallest
    doc_id of the component of documents linked by a likeness of at least THRESHOLD.  n_links counts the
    other rows, n_text_links the other shingle sets, that a row is linked with.
    """
    docs = texts_of(docs)
    sets = described(docs)
    # A class is known by its smallest id and its digest, as bytes in the order of the ids; repeated ids stay apart.
    one = F.min(F.struct("doc_id", "print")).alias("one")
    classes = sets.groupBy("digest").agg(one, F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"))
    number = F.unhex(F.lpad(F.hex(F.col("one.doc_id").bitwiseXOR(F.lit(-(2**63)))), 16, "0"))
    classes = classes.select("digest", F.concat(number, "digest").alias("class"), F.col("one.doc_id").alias("class_id"), F.col("one.print").alias("print"), "copies", "bands")
    classes = materialise(classes, "classes")
    tasks = tasks_of(classes)
    needed = materialise(tasks.select("class").distinct().join(classes.select("class", F.col("class_id").alias("doc_id"), "print", "copies"), "class"), "needed")
    # Hash join with the short side built, where it fits: the texts are streamed and need no sort.
    prints = docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("print"), "text")
    texts = prints.join(built(needed), ["doc_id", "print"])
    # Of rows that repeat an id and its text one stays.
    texts = materialise(texts.groupBy("class", "copies").agg(F.first("text").alias("text")), "texts")
    links = tasks.join(texts, "class").groupBy("task", "lo", "hi", "band").applyInArrow(meet, LINKS)
    links = materialise(links, "links")
    release(tasks, needed, texts)
    totals = links.groupBy("class").agg(F.sum("text_links").alias("text_links"), F.sum("doc_links").alias("doc_links"))
    linked = components(links.select(F.col("class").alias("a"), F.col("root").alias("b")))
    first = F.conv(F.hex(F.substring("component", 1, 8)), 16, 10).cast("decimal(20,0)") - F.lit(str(2**63)).cast("decimal(20,0)")
    linked = linked.select(F.col("node").alias("class"), first.cast("long").alias("component"))
    known = classes.select("digest", "class", "class_id", "copies").join(totals, "class", "left").join(linked, "class", "left").drop("class")
    known = materialise(known, "known")
    release(classes, links)
    placed = sets.select("doc_id", "digest").join(known, "digest").select(
        "doc_id",
        F.coalesce("component", "class_id").alias("class_id"),
        F.col("class_id").alias("text_class"),
        (F.col("copies") - 1 + F.coalesce("doc_links", F.lit(0))).alias("n_links"),
        F.coalesce("text_links", F.lit(0)).alias("n_text_links"),
    )
    alone = ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)) | F.col("doc_id").isNull()
    rest = docs.where(alone).select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("text_class"), F.lit(0).cast("long").alias("n_links"), F.lit(0).cast("long").alias("n_text_links"))
    return placed.unionByName(rest)


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns kept, whose id is the smallest of its component; rows without id or words stay.

    Of rows that repeat both id and text one stays, any of them where other columns differ.
    Different texts under one id are different documents that the id cannot tell apart: all
    of them stay, or go, with the id, even where they are near copies of each other.
    """
    tag = uuid.uuid4().hex[:8]
    gone_id, own_id, count, digest, row = (f"{x}_{tag}" for x in ("gone", "id", "rows", "text", "row"))
    gone = materialise(jaccard_join(docs).where("doc_id != class_id").select(F.col("doc_id").alias(gone_id)).distinct(), "gone")
    key, words = F.col("doc_id").cast("long"), F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    kept = docs.join(built(gone), key == F.col(gone_id), "left_anti")
    ids = docs.where(key.isNotNull() & words).groupBy(key.alias(own_id)).agg(F.count(F.lit(1)).alias(count))
    twice = materialise(ids.where(F.col(count) > 1).select(own_id), "twice")
    if twice.isEmpty():
        return kept
    repeated = words & (key == F.col(own_id))
    many = kept.join(built(twice), repeated, "left_semi")
    # Partial aggregates leave one row a partition, so a row repeated any number of times is no large group.
    one = many.groupBy(key.alias(own_id), F.sha2(F.col("text").cast("binary"), 256).alias(digest)).agg(F.first(F.struct(*docs.columns)).alias(row))
    return kept.join(built(twice), repeated, "left_anti").unionByName(one.select(f"{row}.*"))
