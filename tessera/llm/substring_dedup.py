"""Substring deduplication by Rabin-Karp hashes of fixed-length word windows.

A word goes if a window over it, of ``window`` consecutive words, also starts in a document
with a smaller doc_id.  Windows are judged on the input.  Hashes are polynomial and rolled
by prefix sums; which windows repeat is found by way of fragments (see repeats), and the
windows of contested fragments are hashed one by one and counted in Spark.  Overlapping
repeated windows merge into maximal removal intervals.

Null and empty texts have no words.  Rows without doc_id are never cut and never count as
earlier.  Rows that repeat an id and its text get the same result.  An empty table gives
an empty result, further columns are ignored (or kept, by ``dedup``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialise, texts_of
from tessera.llm.repeats import Rolling, Scheme, Tables, in_chunks, signed, word_places, word_units
from tessera.llm.resolve import remove_repeats, span_arrays

WINDOW = 50


def scheme_for(window: int) -> Scheme:
    return Scheme(window, max(1, window // 2), word_units, within=False)


def gather_runs(flags: DataFrame, window: int) -> DataFrame:
    """(doc_id, start) of windows to (doc_id, runs of units): neighbours merge in the array, without Python."""
    spans = F.transform(F.array_sort(F.collect_set("start")), lambda s: F.struct(s.alias("a"), (s + window).alias("b")))
    return flags.groupBy("doc_id").agg(spans.alias("runs"))


def contested_windows(window: int):
    def settle(contested: DataFrame) -> DataFrame:
        def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tables = Tables()
            for batch in batches:
                rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), span_arrays(batch.column(2)), strict=True)
                for doc_id, text, spans in rows:
                    units, _ = word_units([text.encode("utf-8", "surrogatepass")], tables)
                    rolling = Rolling(units, tables)
                    use = (spans["kind"] > 0) & (spans["start"] + spans["windows"] + window - 1 <= len(units))
                    n = spans["windows"][use].astype(np.int64)
                    if not len(n):
                        continue
                    start = np.repeat(spans["start"][use] - np.cumsum(n) + n, n) + np.arange(n.sum())
                    anchor = np.repeat(spans["anchor"][use], n)
                    yield pa.record_batch(
                        [pa.array(anchor), signed(rolling.at(start, start + window)), pa.array(np.full(len(start), doc_id)), pa.array(start.astype(np.int32))],
                        ["anchor", "hash", "doc_id", "start"],
                    )

        windows = materialise(contested.mapInArrow(hashes, "anchor long, hash long, doc_id long, start int"), "windows")
        counted = windows.groupBy("anchor", "hash").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
        repeated = materialise(counted.where("low < high").drop("high"), "repeated")
        return gather_runs(windows.join(repeated, ["anchor", "hash"]).where("doc_id > low"), window)

    return settle


def removed_mask(n: int, runs: list[tuple[int, int]]) -> np.ndarray:
    gone = np.zeros(n, dtype=bool)
    for a, b in runs:
        gone[a:b] = True
    return gone


def dedup_report(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of the kept words joined by one space, for every row."""

    def finish(batch: pa.RecordBatch, cuts: list[list[tuple[int, int]]]) -> pa.RecordBatch:
        total, gone, kept = [], [], []
        for text, runs in zip(batch.column(1).to_pylist(), cuts, strict=True):
            words = (text or "").encode("utf-8", "surrogatepass").split()
            total.append(len(words))
            if runs:
                mask = removed_mask(len(words), runs)
                words = [w for w, m in zip(words, mask.tolist(), strict=True) if not m]
            gone.append(total[-1] - len(words))
            kept.append(hashlib.sha256(b" ".join(words)).hexdigest())
        return pa.record_batch([batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return remove_repeats(texts_of(docs), scheme_for(window), contested_windows(window), finish, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def cut_words(text: str, runs: list[tuple[int, int]]) -> str | None:
    """text without the bytes of each run of words; None if no word is left."""
    raw = text.encode("utf-8", "surrogatepass")
    first, end = word_places(np.frombuffer(raw, dtype=np.uint8))
    if removed_mask(len(first), runs).all():
        return None
    kept, at = [], 0
    for a, b in runs:
        b = min(b, len(first))
        if a < b:
            kept.append(raw[at : first[a]])
            at = end[b - 1]
    return b"".join([*kept, raw[at:]]).decode("utf-8", "surrogatepass")


def dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs, all columns kept, with repeated runs of words cut out; n_chars follows.  A row of which no word is left goes."""
    names = docs.columns
    at = names.index("text")
    n_at = names.index("n_chars") if "n_chars" in names else None

    def finish(batch: pa.RecordBatch, cuts: list[list[tuple[int, int]]]) -> pa.RecordBatch:
        columns = list(batch.columns)
        if any(cuts):
            texts = columns[at].to_pylist()
            new = [cut_words(t, r) if r else t for t, r in zip(texts, cuts, strict=True)]
            keep = [not r or t is not None for t, r in zip(new, cuts, strict=True)]
            columns[at] = pa.array(new, columns[at].type)
            if n_at is not None:
                old = columns[n_at].to_pylist()
                columns[n_at] = pa.array([len(t) if r and t is not None else x for t, r, x in zip(new, cuts, old, strict=True)], columns[n_at].type)
            return pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep))
        return batch

    return remove_repeats(docs, scheme_for(window), contested_windows(window), finish, docs.schema)


