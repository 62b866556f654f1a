"""Lempel-Ziv phrase fingerprints: a minimum-hash signature of the phrases of a text's LZ78 parse.

Texts that compress well together share dictionary phrases, so the share of equal bins
estimates the Jaccard likeness of two phrase sets.  One hash a phrase is enough: its top
bits choose one of BINS bins, and each bin keeps its minimum.

Texts of any length are parsed whole; a task holds the texts of a batch and the dictionary
of one.  Ids must be numbers or null; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import mix, odd_powers, shuffle_partitions, texts_of

BINS = 128
EMPTY = 0xFFFF
U64 = np.uint64
BASE = 0x9E3779B97F4A7C15
#: BASE ** -1 modulo 2 ** 64.
INVERSE = pow(BASE, -1, 1 << 64)


class Powers:
    """Powers of BASE and of its inverse, as far as they have been needed."""

    def __init__(self):
        self.n = 0

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, 2 * self.n, 1 << 12)
            self.up, self.down = odd_powers(BASE, self.n), odd_powers(INVERSE, self.n)
        return self.up, self.down


class Parse:
    """An LZ78 parse that can be forked: the phrases so far and the phrase that is being read."""

    def __init__(self):
        self.seen: set[str] = set()
        self.ends: list[int] = []
        self.pending = ""
        self.at = 0

    def fork(self) -> Parse:
        other = Parse()
        other.seen, other.ends, other.pending, other.at = set(self.seen), list(self.ends), self.pending, self.at
        return other

    def feed(self, text: str) -> Parse:
        seen, ends, p = self.seen, self.ends, self.pending
        for i, c in enumerate(text, self.at + 1):
            p += c
            if p not in seen:
                seen.add(p)
                ends.append(i)
                p = ""
        self.pending, self.at = p, self.at + len(text)
        return self


def signature(text: str, ends: list[int], powers: Powers) -> np.ndarray:
    """BINS minima (uint16; EMPTY: no phrase) of the phrases that end at ends.

    Phrases are hashed together: a prefix sum of characters times inverse powers gives any
    substring's polynomial hash modulo 2 ** 64, which a finaliser then mixes.
    """
    bins = np.full(BINS, EMPTY, dtype=np.uint16)
    if not ends:
        return bins
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(U64)
    up, down = powers.get(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, dtype=U64)
    np.cumsum((codes + U64(1)) * down[: len(codes)], out=sums[1:])
    stop = np.array(ends, dtype=np.int64)
    start = np.concatenate(([0], stop[:-1]))
    h = mix((sums[stop] - sums[start]) * up[start])
    where = (h >> U64(57)).astype(np.int64)
    np.minimum.at(bins, where, ((h >> U64(8)) % U64(EMPTY)).astype(np.uint16))
    return bins


def as_text(bins: np.ndarray) -> str:
    return bins.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal bins among those that either text fills; two texts without phrases are alike."""
    filled = int(((a != EMPTY) | (b != EMPTY)).sum())
    return float(((a == b) & (a != EMPTY)).sum()) / filled if filled else 1.0


def fingerprint(text: str | None) -> str:
    """The fingerprint of one text, for use outside Spark."""
    text = text or ""
    return as_text(signature(text, Parse().feed(text).ends, Powers()))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every row; null counts as empty, whose fingerprint has only empty bins. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                text = text or ""
                out.append(as_text(signature(text, Parse().feed(text).ends, powers)))
            yield pa.record_batch([batch.column(0), pa.array(out, pa.string())], ["doc_id", "fingerprint"])

    return texts_of(docs).mapInArrow(run, "doc_id long, fingerprint string")


class Order:
    """Buckets of the order: descending id, nulls last, equal ids by the hash of their text.

    cuts: ascending ids at which buckets begin; parts: into how many buckets the rows of one
    frequent id are dealt by hash; nulls: the same for rows without id, which have buckets of their own.
    """

    def __init__(self, quantiles: list[int], nulls: int):
        counted = Counter(quantiles)
        self.cuts = np.array(sorted(counted), dtype=np.int64)
        # An id that is several quantiles in a row has as many buckets' worth of rows.
        self.parts = np.array([counted[x] for x in self.cuts.tolist()], dtype=np.int64)
        self.nulls = max(1, nulls)
        # From each cut up to the next one there is a bucket, and after it those of the cut's own id if that is frequent.
        width = np.where(self.parts > 1, self.parts + 1, 1)
        self.before = np.concatenate((np.cumsum(width[::-1])[::-1][1:], [0])) if len(self.cuts) else width
        self.size = int(width.sum()) + 1 + self.nulls

    def buckets(self, ids: pa.Array, hashes: pa.Array) -> np.ndarray:
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        values = ids.fill_null(0).to_numpy(zero_copy_only=False)
        share = (hashes.to_numpy(zero_copy_only=False).astype(np.float64) / 2.0**64 + 0.5).clip(0, 1 - 1e-9)
        first_null = self.size - self.nulls
        out = np.full(len(values), first_null - 1, dtype=np.int64)  # below all cuts
        if len(self.cuts):
            at = np.searchsorted(self.cuts, values, side="right") - 1
            low = np.maximum(at, 0)
            own = (self.parts[low] > 1) & (self.cuts[low] == values)
            out = np.where(at >= 0, self.before[low] + np.where(own, 1 + (share * self.parts[low]).astype(np.int64), 0), out)
        return np.where(known, out, first_null + (share * self.nulls).astype(np.int64)).astype(np.int32)


def in_descending_order(docs: DataFrame) -> DataFrame:
    """Partitions of (bucket, guest, doc_id, text), sorted so that every row is followed by its successor.

    The order is descending doc_id, nulls last, then a hash of the text, then the text.  Rows
    are cut into buckets at quantiles of the id; those of a frequent id, or without one, are
    dealt over several by the hash, so only equal rows cannot be parted, and these are
    streamed.  The first row of a bucket also goes, as a guest, to the end of the
    bucket before it (that of the first bucket to the end of the last), so the texts are
    exchanged once and the driver sees one id for each bucket.
    """
    docs = texts_of(docs).withColumn("hash", F.xxhash64("text"))
    n = shuffle_partitions(docs)
    total, known = docs.agg(F.count(F.lit(1)), F.count("doc_id")).head()
    quantiles = docs.approxQuantile("doc_id", [k / n for k in range(1, n)], 1 / (4 * n)) if n > 1 and known else []
    order = Order([int(x) for x in quantiles], -(-(total - known) * n // max(total, 1)))

    @F.arrow_udf("int")
    def bucket(ids: pa.Array, hashes: pa.Array) -> pa.Array:
        return pa.array(order.buckets(ids, hashes), pa.int32())

    # bitwise not is the descending order of ids; one value for rows without id.
    down = F.coalesce(F.bitwise_not("doc_id"), F.lit(0))
    first = F.min(F.struct(down.alias("down"), "hash")).alias("first")
    firsts = {r.bucket: tuple(r.first) for r in docs.select(bucket("doc_id", "hash").alias("bucket"), "doc_id", "hash").groupBy("bucket").agg(first).collect()}
    used = sorted(firsts)
    before = {k: used[i - 1] for i, k in enumerate(used)}

    @F.arrow_udf("array<int>")
    def places(ids: pa.Array, hashes: pa.Array) -> pa.Array:
        """A row's bucket and, where it is the first of its bucket, -1 - the bucket it is a guest of."""
        own = order.buckets(ids, hashes)
        out = [[b] for b in own.tolist()]
        for i, (x, h) in enumerate(zip(ids.to_pylist(), hashes.to_pylist(), strict=True)):
            if firsts[out[i][0]] == (0 if x is None else ~x, h):
                out[i].append(-1 - before[out[i][0]])
        return pa.array(out, pa.list_(pa.int32()))

    place = F.col("place")
    return (
        docs.select(F.explode(places("doc_id", "hash")).alias("place"), "doc_id", "hash", "text")
        .select(F.when(place < 0, -1 - place).otherwise(place).alias("bucket"), (place < 0).alias("guest"), "doc_id", "hash", "text")
        .repartitionById(order.size, F.col("bucket"))
        .sortWithinPartitions("bucket", "guest", F.col("doc_id").desc_nulls_last(), "hash", F.col("text").asc_nulls_last())
        .select("bucket", "guest", "doc_id", "text")
    )


def edited(text: str, following: str) -> tuple[int, str]:
    """How many code points of text stay, and what is put in place of the rest."""
    half = len(text) // 2
    return len(text) - half, following[:half]


def edit_likeness(docs: DataFrame) -> DataFrame:
    """Each row's fingerprint, that of its edited text, and their likeness.

    The edited text is the row's with its last floor(n_chars / 2) code points replaced by
    the first as many (or all) of the next document's, by descending doc_id; the last one
    is followed by the first.  Null texts count as empty.  Rows with equal ids follow one
    another by a hash of their text; null ids come last; a single row is its own successor.  The half that
    both texts share is parsed once and the parse forked.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

        def parsed(text: str) -> tuple[np.ndarray, Parse]:
            """The signature, and the parse of the half that stays."""
            keep = len(text) - len(text) // 2
            half = Parse().feed(text[:keep])
            return signature(text, half.fork().feed(text[keep:]).ends, powers), half

        waiting = None  # bucket, id, text, signature, parse of the half that stays
        for batch in batches:
            rows: list[tuple] = []
            buckets, is_guest, ids = (batch.column(k).to_pylist() for k in range(3))
            for bucket, guest, doc_id, text in zip(buckets, is_guest, ids, batch.column(3), strict=True):
                if waiting is None and guest:
                    continue  # a further guest with the same id
                text = text.as_py() or ""
                own, half = parsed(text)
                if waiting is not None:
                    _, last_id, last, bins, kept = waiting
                    keep, put = edited(last, text)
                    new = last[:keep] + put
                    new_bins = signature(new, kept.feed(put).ends, powers)
                    rows.append(
                        (
                            last_id,
                            len(last),
                            hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(),
                            as_text(bins),
                            as_text(new_bins),
                            likeness(bins, new_bins),
                            likeness(bins, own),
                        )
                    )
                waiting = None if guest else (bucket, doc_id, text, own, half)
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return in_descending_order(docs).mapInArrow(
        run,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    )
