"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

Words are what remains of the lower-cased text between ASCII bytes that are neither
letters nor digits.  The automaton of all items is built on the driver and sent to
the executors; a document's words are streamed through it and the longest matching
suffix is tracked, so the cost is one step a word whatever the number of items.

Size bound of what is broadcast: an automaton holds at most ``MAX_WORDS_EACH`` words, and items
beyond that are cut into overlapping slices, which hold the same windows.  A benchmark of
more words gets several automata, one at a time.  Each of them reads the documents and
writes only what it hits, by text; at the end documents are joined with the hits of their texts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import built, materialise, release, small_batches, texts_of

WINDOW = 10
#: Words of items in one automaton (about 500 bytes each in a Python worker).
MAX_WORDS_EACH = 400_000
#: Lower-cases A-Z and blanks every ASCII byte that is not a letter or digit; one byte stays one byte.
NORMAL = bytes(
    (b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32) for b in range(256)
)
WORD = re.compile(rb"[^ ]+")


def normal_words(text: str | None) -> list[bytes]:
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(NORMAL).split()


class SuffixAutomaton:
    """Generalised suffix automaton over word ids, with the items that hold each state's strings."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.window = window
        self.names = [name for name, _ in items]
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        holds: list[set[int]] = [set()]
        whole: list[tuple[int, int]] = []
        for k, (_, words) in enumerate(items):
            at = 0
            for word in words:
                at = self._append(at, self.ids.setdefault(word, len(self.ids)), holds)
                holds[at].add(k)
            if 0 < len(words) < window:
                whole.append((k, len(words)))
        order = sorted(range(1, len(self.link)), key=self.length.__getitem__)
        # top: the shortest suffix of at least a window; only such states need to know their items.
        self.top = [0] * len(self.link)
        for s in order:
            if self.length[s] >= window:
                up = self.link[s]
                self.top[s] = self.top[up] if self.length[up] >= window else s
        for s in reversed(order):
            if self.length[self.link[s]] >= window:
                holds[self.link[s]] |= holds[s]
                holds[s] = holds[s] if self.top[s] == s else set()
        self.holds = {s: tuple(holds[s]) for s in order if self.top[s] == s}
        # Items shorter than a window: (words, item) at the state of the item's text, handed down the link tree.
        self.short: list[tuple[tuple[int, int], ...]] = [()] * len(self.link)
        own: dict[int, list[tuple[int, int]]] = {}
        for k, n in whole:
            at = 0
            for word in items[k][1]:
                at = self.next[at][self.ids[word]]
            own.setdefault(at, []).append((n, k))
        if own:
            for s in order:
                self.short[s] = self.short[self.link[s]] + tuple(own.get(s, ()))
        self.least = min([window, *(n for _, n in whole)])

    def _append(self, last: int, c: int, holds: list[set[int]]) -> int:
        known = self.next[last].get(c)
        if known is not None:
            if self.length[known] == self.length[last] + 1:
                return known
            return self._split(last, known, c, holds)
        new = self._state(self.length[last] + 1, {}, holds)
        p = last
        while p != -1 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p == -1:
            self.link[new] = 0
        else:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, c, holds)
        return new

    def _state(self, length: int, edges: dict[int, int], holds: list[set[int]]) -> int:
        self.next.append(edges)
        self.link.append(0)
        self.length.append(length)
        holds.append(set())
        return len(self.link) - 1

    def _split(self, p: int, q: int, c: int, holds: list[set[int]]) -> int:
        clone = self._state(self.length[p] + 1, dict(self.next[q]), holds)
        self.link[clone] = self.link[q]
        self.link[q] = clone
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Half-open runs of words covered by windows, in order and disjoint, and the items of those windows."""
        step, link, length, window, least = self.next, self.link, self.length, self.window, self.least
        top, holds = self.top, self.holds
        runs: list[list[int]] = []
        found: set[int] = set()
        state = matched = 0
        for i, c in enumerate(map(self.ids.get, words)):
            if c is None:
                state = matched = 0
                continue
            to = step[state].get(c)
            if to is not None:
                state = to
                matched += 1
            else:
                while state != -1 and c not in step[state]:
                    state = link[state]
                if state == -1:
                    state = matched = 0
                    continue
                matched = length[state] + 1
                state = step[state][c]
            if matched < least:
                continue
            cover = 0
            if matched >= window:
                found.update(holds[top[state]])
                cover = window
            for n, k in self.short[state]:
                if n <= matched:
                    found.add(k)
                    cover = max(cover, n)
            if cover:
                lo = i + 1 - cover
                while runs and runs[-1][0] >= lo:
                    runs.pop()
                if runs and runs[-1][1] >= lo:
                    runs[-1][1] = i + 1
                else:
                    runs.append([lo, i + 1])
        return [(a, b) for a, b in runs], found


def automata(benchmark: DataFrame, window: int = WINDOW) -> Iterator[SuffixAutomaton]:
    """One automaton for each slice of at most MAX_WORDS_EACH item words; items without words are in none.

    Items are read through an iterator, so that the driver holds one partition of them and one automaton.
    """
    part, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("string").alias("k"), F.col("text").cast("string").alias("t"))
    for r in rows.where("t is not null").toLocalIterator():
        words = normal_words(r.t)
        if not words:
            continue
        # Slices of long items overlap by a window less one word, and none is shorter than a window.
        step = max(MAX_WORDS_EACH - window + 1, window)
        for at in range(0, max(len(words) - window + 1, 1), step):
            piece = words[at : at + step + window - 1]
            if part and size + len(piece) > MAX_WORDS_EACH:
                yield SuffixAutomaton(part, window)
                part, size = [], 0
            part.append((r.k, piece))
            size += len(piece)
    if part:
        yield SuffixAutomaton(part, window)


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


Finish = Callable[[pa.RecordBatch, list[list[bytes]], list[list[tuple[int, int]]], list[set[str]]], pa.RecordBatch]


def pairs(flat: list[int]) -> list[tuple[int, int]]:
    return list(zip(flat[::2], flat[1::2], strict=True))


def hit_texts(docs: DataFrame, sent) -> DataFrame:
    """Written table (digest, runs, items) of the texts that the broadcast automaton hits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, known = sent.value, set()
        for batch in batches:
            digests, runs, items = [], [], []
            for text in batch.column(0).to_pylist():
                new, found = machine.hits(normal_words(text))
                if new:
                    digest = hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()
                    if digest not in known:
                        known.add(digest)
                        digests.append(digest)
                        runs.append([x for r in new for x in r])
                        items.append(sorted({machine.names[k] for k in found if machine.names[k] is not None}))
            kinds = (pa.binary(), pa.list_(pa.int64()), pa.list_(pa.string()))
            yield pa.record_batch([pa.array(c, k) for c, k in zip((digests, runs, items), kinds, strict=True)], ["digest", "runs", "items"])

    slim = docs.select(F.col("text").cast("string").alias("text")).where("text is not null")
    return materialise(slim.mapInArrow(run, "digest binary, runs array<long>, items array<string>"), "hits")


def matched(docs: DataFrame, benchmark: DataFrame, window: int, finish: Finish, schema: T.StructType | str) -> DataFrame:
    """finish(batch of docs, words, hit runs, items) of all rows; one pass and no exchange if one automaton holds all items."""
    spark = docs.sparkSession
    small_batches(spark)
    names, at, n = docs.columns, docs.columns.index("text"), len(docs.columns)
    machines = automata(benchmark, window)
    machine, following = next(machines, None), next(machines, None)
    if following is None:
        sent = spark.sparkContext.broadcast(machine)

        def one_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            machine = sent.value
            for batch in batches:
                words = [normal_words(t) for t in batch.column(at).to_pylist()]
                hits = [machine.hits(w) if machine else ([], set()) for w in words]
                items = [{machine.names[k] for k in found if machine.names[k] is not None} for _, found in hits]
                yield finish(pa.RecordBatch.from_arrays(batch.columns, names=names), words, [r for r, _ in hits], items)

        return docs.mapInArrow(one_pass, schema)
    tables = []
    while machine is not None:
        sent = spark.sparkContext.broadcast(machine)
        tables.append(hit_texts(docs, sent))
        sent.unpersist()
        machine, following = following, next(machines, None)
    hits = tables[0]
    for t in tables[1:]:
        hits = hits.unionByName(t)
    # Equal texts in several tasks or automata: sets, so that repetitions count once.
    flat = F.flatten(F.collect_set("runs")).alias("runs")
    found = materialise(hits.groupBy("digest").agg(flat, F.array_distinct(F.flatten(F.collect_set("items"))).alias("items")), "found")
    release(*tables)
    own = docs.toDF(*[f"i{k}" for k in range(n)]).withColumn("own", F.unhex(F.sha2(F.col(f"i{at}").cast("string").cast("binary"), 256)))
    joined = own.join(built(found), F.col("own") == F.col("digest"), "left").drop("own", "digest")

    def last_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [normal_words(t) for t in batch.column(at).to_pylist()]
            runs = [merged(pairs(r)) if r else [] for r in batch.column(n).to_pylist()]
            items = [set(x or ()) for x in batch.column(n + 1).to_pylist()]
            yield finish(pa.RecordBatch.from_arrays(batch.columns[:n], names=names), words, runs, items)

    return joined.mapInArrow(last_pass, schema)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted distinct item ids), spans (half-open word runs) of every row.

    A null or empty text has no words and no hits.  Repeated rows and ids are scored row by
    row.  An empty benchmark, or items without words, hit nothing.  An item with a null id hits
    like any other (n_hit and spans), but has no id to add to items.  Other columns are ignored.
    """

    def score(batch: pa.RecordBatch, words: list, runs: list, items: list) -> pa.RecordBatch:
        return pa.record_batch(
            [
                batch.column(0),
                pa.array([len(w) for w in words], pa.int64()),
                pa.array([sum(b - a for a, b in r) for r in runs], pa.int64()),
                pa.array([sorted(i) for i in items], pa.list_(pa.string())),
                pa.array([[x for run in r for x in run] for r in runs], pa.list_(pa.int64())),
            ],
            ["doc_id", "n_words", "n_hit", "items", "spans"],
        )

    schema = "doc_id long, n_words long, n_hit long, items array<string>, spans array<long>"
    return matched(texts_of(docs), benchmark, window, score, schema)


def cut(text: str, runs: list[tuple[int, int]]) -> str:
    """text without the bytes from the first to the last word of each run."""
    raw = text.encode("utf-8", "surrogatepass")
    at = [m.span() for m in WORD.finditer(raw.translate(NORMAL))]
    kept, end = [], 0
    for a, b in runs:
        kept.append(raw[end : at[a][0]])
        end = at[b - 1][1]
    return b"".join([*kept, raw[end:]]).decode("utf-8", "surrogatepass")


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = 0.5
) -> DataFrame:
    """docs, all columns kept, without the spans of words that windows of items cover.

    The window is the length limit: matches of fewer words stay, unless they are a whole
    short item.  A document of which more than max_coverage of the words are hit goes altogether.
    Items with a null id count.  Rows without hits pass unchanged; n_chars, where present, follows the new text.
    No shuffle: rows are filtered and rewritten as they stream by.
    """
    names = docs.columns
    at = names.index("text")
    n_at = names.index("n_chars") if "n_chars" in names else None

    def clean(batch: pa.RecordBatch, words: list, runs: list, items: list) -> pa.RecordBatch:
        hit = [sum(b - a for a, b in r) for r in runs]
        keep = [h <= max_coverage * len(w) for h, w in zip(hit, words, strict=True)]
        columns = list(batch.columns)
        texts = columns[at].to_pylist()
        new = {i: cut(texts[i], runs[i]) for i, h in enumerate(hit) if h and keep[i]}
        if new:
            columns[at] = pa.array([new.get(i, t) for i, t in enumerate(texts)], batch.schema.field(at).type)
            if n_at is not None:
                old = columns[n_at].to_pylist()
                columns[n_at] = pa.array([len(new[i]) if i in new else x for i, x in enumerate(old)], batch.schema.field(n_at).type)
        return pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep, pa.bool_()))

    return matched(docs, benchmark, window, clean, docs.schema)
