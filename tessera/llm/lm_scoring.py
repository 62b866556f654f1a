"""Cross-entropy difference of matched target and background bigram models.

Target are the documents labelled quality 1, background all others.  Both models are of
one kind - bigrams, smoothed towards unigrams (PRIOR pseudo-counts), which are smoothed
towards the uniform distribution over one shared vocabulary, every word of the corpus -
and a document's own words are taken out of the model it belongs to.  A document's score
is the mean over its tokens of target loss minus background loss: lower is more like the
target.

Counts cover the whole corpus and nothing is capped.  Documents are dealt into blocks
once; a block sends its distinct unigrams and bigrams (64-bit hashes) with their counts,
as sorted columns cut into ranges of the hash, to one task for each range, which adds
them up and returns the sums in the order in which they came.  A frequent n-gram is one
entry a block, so no key is hot; both uses of the blocks share one exchange of the texts.
Only ranges of which a block has n-grams get a row from it, so there are never more rows
than distinct n-grams of blocks, whatever the number of blocks and ranges.

Null and empty texts have no tokens and losses of 0.  Labels of unknown documents, and null
labels, are ignored; of several for one id the largest counts.  Rows without doc_id are
background.  Rows that repeat an id are documents of their own and share a block; texts of
any length are read whole.  An empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialise, mix, shuffle_partitions, texts_of
from tessera.llm.repeats import Tables, word_units

PRIOR = 2.0
TOTALS = ["vocabulary", "target_tokens", "rest_tokens"]
#: Bytes below which counts are not compressed.
SMALL = 64
U64 = np.uint64
PAIR = U64(0x9FB21C651E98DF25)


def packed(x: np.ndarray) -> bytes:
    """Bytes of x by place value, so that compression finds the equal ones together."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def unpacked(raw: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(width, len(raw) // width).T).view(kind).ravel()


def squeezed(counts: np.ndarray) -> bytes:
    """Counts, most of which are 0 or 1, by place value without the empty places, compressed if there are many."""
    width = max(1, -(-int(counts.max(initial=0)).bit_length() // 8))
    places = packed(counts.astype(np.uint64))[: width * len(counts)]
    return bytes([width]) + places if len(places) < SMALL else bytes([width + 8]) + zlib.compress(places, 1)


def counts_of(raw: bytes) -> np.ndarray:
    width, places = raw[0], np.frombuffer(raw[1:] if raw[0] <= 8 else zlib.decompress(raw[1:]), dtype=np.uint8)
    width -= 8 * (width > 8)
    places = places.reshape(width, len(places) // width)
    return sum(places[k].astype(np.int64) << (8 * k) for k in range(width))


class Block:
    """Tokens of some documents as numbers of the block's distinct unigrams and bigrams."""

    def __init__(self, ids: list, texts: list[str | None], target_ids: set):
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        words, self.first = word_units(raw, Tables()) if raw else (np.zeros(0, dtype=U64), np.zeros(1, dtype=np.int64))
        self.n = len(words)
        self.document = np.repeat(np.arange(len(raw), dtype=np.int32), np.diff(self.first))
        self.target = np.array([i in target_ids for i in ids], dtype=bool)
        self.second = np.flatnonzero(self.document[1:] == self.document[:-1]) + 1 if self.n else np.zeros(0, dtype=np.int64)
        pairs = mix(words[self.second - 1] * PAIR + words[self.second])
        self.keys, number = np.unique(np.concatenate([words, pairs]), return_inverse=True)
        self.number = number.astype(np.int32)
        self.owner = np.concatenate([self.document, self.document[self.second]])
        self.is_word = np.zeros(len(self.keys), dtype=bool)
        self.is_word[self.number[: self.n]] = True

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of each key in target and in background documents."""
        mine = self.target[self.owner] if len(self.owner) else np.zeros(0, dtype=bool)
        size = len(self.keys)
        return tuple(np.bincount(self.number[m], minlength=size).astype(np.uint64) for m in (mine, ~mine))

    def own(self) -> np.ndarray:
        """How often each entry's key occurs in its own document."""
        size = max(len(self.keys), 1)
        pair = self.owner * np.int64(size) + self.number
        order = np.argsort(pair)
        pair = pair[order]
        first = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1]))) if len(pair) else order
        out = np.empty(len(pair), dtype=np.float32)  # exact below 2 ** 24 occurrences in one document
        out[order] = np.repeat(np.diff(np.append(first, len(pair))), np.diff(np.append(first, len(pair))))
        return out

    def losses(self, counts: np.ndarray, total: float, vocabulary: float, own: np.ndarray, is_target: bool) -> np.ndarray:
        """Sum of each document's losses under one model, its own words taken out if the model has them."""
        part = (self.target == is_target)[self.document]
        mine = np.concatenate([part, part[self.second]]) * own
        seen = counts[self.number] - mine
        size = np.diff(self.first)
        tokens = total - np.where(part, size[self.document], 0)
        p = (seen[: self.n] + 1) / (tokens + vocabulary)
        s = self.second
        p[s] = (seen[self.n :] + PRIOR * p[s]) / (seen[s - 1] + PRIOR)
        sums = np.concatenate(([0.0], np.cumsum(-np.log(p))))
        return sums[self.first[1:]] - sums[self.first[:-1]]


def cut_places(keys: np.ndarray, buckets: int) -> np.ndarray:
    """First place of each range of the hash, and the end, in sorted keys."""
    edges = np.array([(k << 64) // buckets for k in range(1, buckets)], dtype=U64)
    return np.concatenate(([0], np.searchsorted(keys, edges), [len(keys)])).astype(np.int64)


def targets_of(rows: pa.Table) -> set:
    return set(rows.column("doc_id").drop_null().to_pylist())


def cross_entropy_difference(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_tokens, target_loss and background_loss (means over tokens) and score of every row."""
    slim = texts_of(docs)
    # A block's arrays take about fifty times the bytes of its texts; a task holds one block.
    blocks = max(2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), shuffle_partitions(slim, 8 << 20))
    block = F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int").alias("block")
    # Null ids are spread by their text.
    deal = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("text"), F.lit(blocks)).cast("int")).otherwise(block).alias("block")
    texts = slim.select(deal, "doc_id", "text").groupBy("block")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).dropna()
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality")).where("quality = 1").select(block, "doc_id")

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        """One row for each range, with the block's keys and counts in it."""
        if not left.num_rows:
            return pa.table({k: pa.array([], t) for k, t in (("bucket", pa.int32()), ("block", pa.int32()), ("keys", pa.binary()), ("target", pa.binary()), ("rest", pa.binary()), ("words", pa.binary()))})
        b = Block(left.column("doc_id").to_pylist(), left.column("text").to_pylist(), targets_of(right))
        at = cut_places(b.keys, blocks)
        used = np.flatnonzero(np.diff(at))
        target, rest = b.counts()

        def cut(x: np.ndarray, pack: Callable[[np.ndarray], bytes]) -> pa.Array:
            return pa.array([pack(x[i:j]) for i, j in zip(at[used].tolist(), at[used + 1].tolist(), strict=True)], pa.binary())

        return pa.table(
            {
                "bucket": pa.array(used, pa.int32()),
                "block": pa.array([left.column("block")[0].as_py()] * len(used), pa.int32()),
                "keys": cut(b.keys, packed),
                "target": cut(target, squeezed),
                "rest": cut(rest, squeezed),
                "words": cut(b.is_word, lambda x: np.packbits(x).tobytes()),
            }
        )

    def add(table: pa.Table) -> pa.Table:
        """The sums of one range for every block, and the range's share of vocabulary and tokens."""
        columns = {k: table.column(k).to_pylist() for k in ("keys", "target", "rest", "words")}
        keys = [unpacked(x, U64) for x in columns["keys"]]
        _, at = np.unique(np.concatenate(keys), return_inverse=True)
        size = int(at.max()) + 1 if len(at) else 0
        target, rest = (np.bincount(at, np.concatenate([counts_of(x) for x in columns[k]]), minlength=size) for k in ("target", "rest"))
        word = np.zeros(size, dtype=bool)
        flags = [np.unpackbits(np.frombuffer(x, dtype=np.uint8), count=len(k)) for x, k in zip(columns["words"], keys, strict=True)]
        word[at[np.concatenate(flags).astype(bool)]] = True
        ends = np.cumsum([0] + [len(k) for k in keys])
        n = len(keys)
        return pa.table(
            {
                "block": table.column("block").combine_chunks(),
                "bucket": table.column("bucket").combine_chunks(),
                "target": pa.array([squeezed(target[at[i:j]].astype(np.uint64)) for i, j in zip(ends[:-1], ends[1:], strict=True)], pa.binary()),
                "rest": pa.array([squeezed(rest[at[i:j]].astype(np.uint64)) for i, j in zip(ends[:-1], ends[1:], strict=True)], pa.binary()),
                "vocabulary": pa.array([int(word.sum())] * n, pa.int64()),
                "target_tokens": pa.array([int(target[word].sum())] * n, pa.int64()),
                "rest_tokens": pa.array([int(rest[word].sum())] * n, pa.int64()),
                "doc_id": pa.nulls(n, pa.int64()),
            }
        )

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["doc_id", "n_tokens", "target_loss", "background_loss", "score"]
        if not left.num_rows:
            return pa.table({k: pa.array([], pa.int64() if k in names[:2] else pa.float64()) for k in names})
        b = Block(left.column("doc_id").to_pylist(), left.column("text").to_pylist(), targets_of(right))
        sums = right.filter(pc.is_valid(right.column("bucket"))).sort_by("bucket")
        none = [np.zeros(0, dtype=np.int64)]
        target, rest = (np.concatenate(none + [counts_of(x) for x in sums.column(k).to_pylist()]).astype(np.float64) for k in ("target", "rest"))
        own, n = b.own(), np.diff(b.first)
        lt = b.losses(target, nt, vocabulary, own, True) / np.maximum(n, 1)
        lr = b.losses(rest, nr, vocabulary, own, False) / np.maximum(n, 1)
        return pa.table(dict(zip(names, [left.column("doc_id").combine_chunks(), pa.array(n.astype(np.int64)), pa.array(lt), pa.array(lr), pa.array(lt - lr)], strict=True)))

    sent = texts.cogroup(known.groupBy("block")).applyInArrow(send, "bucket int, block int, keys binary, target binary, rest binary, words binary")
    sums = sent.groupBy("bucket").applyInArrow(add, "block int, bucket int, target binary, rest binary, vocabulary long, target_tokens long, rest_tokens long, doc_id long")
    # Every row of a range carries the range's totals; the corpus's are those of one row each.
    sums = materialise(sums, "sums")
    totals = sums.groupBy("bucket").agg(*[F.first(c).alias(c) for c in TOTALS]).agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in TOTALS])
    vocabulary, nt, nr = totals.head()
    sums = sums.drop(*TOTALS)
    both = sums.unionByName(known, allowMissingColumns=True)
    return texts.cogroup(both.groupBy("block")).applyInArrow(score, "doc_id long, n_tokens long, target_loss double, background_loss double, score double")
