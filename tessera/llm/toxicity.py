"""Toxicity by a support vector machine on a gap-weighted subsequence string kernel, with Nystroem landmarks.

The kernel compares words by their common subsequences of four characters, which lie
within SPAN characters and weigh DECAY ** span, so that an insult keeps most of its
likeness when characters are left out or put between.  Word ends count as characters,
punctuation inside a word does not, and runs of single letters are read as one word.

Documents are labelled, words are not, so the machine is trained as in multiple-instance
learning: words that label-1 sentences hold far more often than label-0 ones are positive,
words of label-0 documents are negative, and the hardest negatives and the best word of
each label-1 document without a positive one join in further rounds.  The decision
function is a weighted sum of kernels with the landmarks; as the kernel is an inner
product of subsequence counts, that sum is folded into one weight for each subsequence,
and a word's value costs one look-up for each of its subsequences.  A document's score is
the calibrated value of its worst word.

Sizes: at most MAX_POSITIVE and MAX_NEGATIVE labelled documents (lowest hash of the id)
train the model on the driver; the model is 32 ** 4 floats.  Scoring reads whole texts in
one pass without exchange.

Null and empty texts have no words and get the score of a document far on the clean side.
If no training document is toxic, or none is clean, every score is 0.  Labels that are null
or without doc_id are ignored; of several for one id the largest counts.  Repeated rows are
scored one by one; of the rows of one id, that whose text has the smallest hash trains the
model, so an id sends one bag to the driver however often it occurs.  Texts of any length
are scored whole, in time in proportion to them; other columns are ignored (or kept, by
``reject_toxic``).
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import small_batches, texts_of

MAX_POSITIVE, MAX_NEGATIVE = 1500, 3000
LANDMARKS, SPAN, DECAY, LETTERS = 128, 6, 0.7, 32
OFFSETS = list(combinations(range(1, SPAN), 3))
#: Value of a document without words, and the least one of any.
FLOOR = -2.0
THRESHOLD = 0.7
COST, ROUNDS, ALTERED = 30.0, 5, 60
EVIDENCE, EXTRA = 2.0, 0.5
#: Word values that one task remembers.
MEMORY = 400_000
#: Runs of single letters with separators after them, from the beginning of a token.  Letters and separators have
#: nothing in common and nothing is given back, so the time is in proportion to the text.
SPACED = re.compile(r"(?<!\S)(?:[^\s.*_-][\s.*_-]++){3,}+[^\s.*_-]?")
SEPARATORS = re.compile(r"[\s.*_-]+")
#: A letter that ends a token; a spelt word ends with one, what follows the last of a run is another token's.
LAST = re.compile(r"[^\s.*_-](?=\s)")
#: Characters that stand for letters; fixed values.
STAND_INS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}


def letter_codes() -> np.ndarray:
    """Code of each ASCII character: 0 word end (line feed), 1-26 letters, -1 not read."""
    out = np.full(128, -1, dtype=np.int64)
    out[10] = 0
    for k, c in enumerate("abcdefghijklmnopqrstuvwxyz", 1):
        out[ord(c)] = k
    for c, like in STAND_INS.items():
        out[ord(c)] = out[ord(like)]
    for c in "2689":
        out[ord(c)] = 27 + ord(c) % 5
    return out


CODES = letter_codes()


def words_of(text: str | None) -> set[str]:
    if not text:
        return set()
    text = text.lower()
    found = set(text.split())
    for m in SPACED.finditer(text):
        run, end = m[0], 0
        if not SEPARATORS.match(run[-1]) and not text[m.end() : m.end() + 1].strip():
            end = len(run)
        else:
            for last in LAST.finditer(run):
                end = last.end()
        letters = SEPARATORS.sub("", run[:end])
        if len(letters) > 3:
            found.add(letters)
    return found


class Encoded:
    """Words as one array of letter codes."""

    def __init__(self, words: list[str]):
        raw = np.frombuffer("".join(f"\n{w}\n" for w in words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        word = (np.cumsum(raw == 10) - 1) // 2
        code = np.where(raw < 128, CODES[np.minimum(raw, 127)], 27 + raw % (LETTERS - 27))
        keep = code >= 0
        self.n, self.code, self.word = len(words), code[keep], word[keep]
        length = np.bincount(self.word, minlength=self.n)
        squares = sum(np.maximum(length - j, 0) * DECAY ** (2 * (j + 1)) for *_, j in OFFSETS)
        self.norm = np.sqrt(np.maximum(squares, 1e-12))

    def subsequences(self) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
        """For each choice of distances: positions, subsequence and weight."""
        c, w = self.code, self.word
        for i, k, j in OFFSETS:
            at = np.flatnonzero(w[:-j] == w[j:]) if len(w) > j else np.zeros(0, dtype=np.int64)
            yield at, ((c[at] * LETTERS + c[at + i]) * LETTERS + c[at + k]) * LETTERS + c[at + j], DECAY ** (j + 1)

    def dot(self, table: np.ndarray) -> np.ndarray:
        """Inner product of each word's normed subsequence weights with table."""
        total = np.zeros(len(self.code))
        for at, feature, weight in self.subsequences():
            total[at] += weight * table[feature]
        return np.bincount(self.word, total, minlength=self.n) / self.norm

    def add_to(self, table: np.ndarray, factor: float = 1.0) -> None:
        """Add the normed subsequence weights of the only word, times factor, to table."""
        for _, feature, weight in self.subsequences():
            np.add.at(table, feature, factor * weight / self.norm[0])

    def kernels(self, marks: list[str]) -> np.ndarray:
        """Kernel of each word (row) with each mark (column); one table is used for all marks in turn."""
        table, out = np.zeros(LETTERS**4, dtype=np.float32), np.empty((self.n, len(marks)))
        for k, mark in enumerate(marks):
            one = Encoded([mark])
            one.add_to(table)
            out[:, k] = self.dot(table)
            for _, feature, _ in one.subsequences():
                table[feature] = 0
        return out


def squared_hinge(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise |w|^2 / 2 + sum cost * max(0, 1 - y f)^2, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-3
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        active = y * (x @ w) < 1
        xa, ca = x[active], cost[active]
        new = np.linalg.solve(ridge + 2 * (xa * ca[:, None]).T @ xa, 2 * xa.T @ (ca * y[active]))
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    return w[:-1], float(w[-1])


class Model:
    """One weight for each subsequence, a bias, and the calibration of document values."""

    def __init__(self, table: np.ndarray, bias: float):
        self.table, self.bias, self.slope, self.shift = table.astype(np.float32), bias, 1.0, 0.0

    def values(self, words: list[str]) -> np.ndarray:
        return Encoded(words).dot(self.table) + self.bias if words else np.zeros(0)

    def scores(self, values: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * values + self.shift, -50, 50)))


def nystroem_machine(positive: list[str], negative: list[str], weight: dict[str, float]) -> Model:
    """A support vector machine in the space that the landmarks span."""
    half = LANDMARKS // 2
    marks = list(dict.fromkeys([*positive[:half], *negative[: LANDMARKS - min(half, len(positive))]]))
    k = Encoded([*positive, *negative]).kernels(marks)
    square = Encoded(marks).kernels(marks)
    values, vectors = np.linalg.eigh((square + square.T) / 2)
    good = values > 1e-8 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    y = np.concatenate([np.ones(len(positive)), -np.ones(len(negative))])
    cost = np.concatenate([[weight.get(p, 1.0) for p in positive], np.full(len(negative), 1.0)])
    cost[: len(positive)] *= 0.5 * len(y) / cost[: len(positive)].sum()
    cost[len(positive) :] *= 0.5 * len(y) / len(negative)
    w, bias = squared_hinge(k @ root, y, COST * cost)
    table = np.zeros(LETTERS**4)
    for factor, mark in zip(root @ w, marks, strict=True):
        Encoded([mark]).add_to(table, factor)
    return Model(table, bias)


def document_values(model: Model, bags: list[set[str]]) -> np.ndarray:
    vocabulary = list(set().union(*bags)) if bags else []
    value = dict(zip(vocabulary, model.values(vocabulary).tolist(), strict=True))
    return np.array([max([FLOOR, *(value[w] for w in bag)]) for bag in bags])


def calibrate(model: Model, values: np.ndarray, labels: np.ndarray) -> None:
    """Platt's sigmoid with smoothed targets, by damped Newton steps."""
    n1, n0 = labels.sum(), len(labels) - labels.sum()
    target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.column_stack([values, np.ones(len(values))])
    w = np.array([1.0, 0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        gradient = x.T @ (p - target) + np.array([1e-3 * w[0], 0])
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-3, 1e-6])
        step = np.linalg.solve(hessian, gradient)
        w = w - step * min(1.0, 2.0 / (np.abs(step).max() + 1e-12))
    model.slope, model.shift = max(float(w[0]), 1e-3), float(w[1])


def disturbed(word: str) -> list[str]:
    """The word with one character put between, doubled or left out, so that the machine learns to bear it."""
    mid = len(word) // 2
    return [word[:mid] + "x" + word[mid:], word[:mid] + word[mid - 1] + word[mid:], word[: mid - 1] + word[mid:]] if len(word) > 4 else []


def without_copies(bags: list[set[str]]) -> list[set[str]]:
    """Bags whose two words of lowest hash no earlier bag has: copies would lend their rare words weight."""
    kept = {tuple(sorted(b, key=lambda w: zlib.crc32(w.encode("utf-8", "replace")))[:2]): b for b in reversed(bags)}
    return list(kept.values())[::-1]


def train(bags: list[set[str]], labels: list[int]) -> Model | None:
    """The model of labelled bags of words; None if a class is missing."""
    toxic = without_copies([b for b, y in zip(bags, labels, strict=True) if y])
    clean = [b for b, y in zip(bags, labels, strict=True) if not y]
    if not toxic or not clean:
        return None
    seen_1, seen_0 = Counter(w for b in toxic for w in b), Counter(w for b in clean for w in b)

    def evidence(w: str) -> float:
        return float(np.log((seen_1[w] + 0.1) / (len(toxic) + 1)) - np.log((seen_0[w] + EXTRA) / (len(clean) + 1)))

    least = max(2, round(len(toxic) ** 0.5 / 4))
    weight = {w: n**0.5 * e for w, n in seen_1.items() if n >= least and (e := evidence(w)) > EVIDENCE}
    positive = sorted(weight, key=lambda w: (-weight[w], w))[:400]
    if not positive:
        positive = sorted(seen_1, key=lambda w: (-seen_1[w] * evidence(w), w))[:1]
    for w in positive[:ALTERED]:
        for v in disturbed(w):
            if v not in weight and not seen_0[v]:
                positive.append(v)
                weight[v] = weight[w] / 4
    common = [w for w, _ in sorted(seen_0.items(), key=lambda x: (-x[1], zlib.crc32(x[0].encode("utf-8", "replace"))))]
    negative = [w for w in common[:3000] if w not in weight] or common[:1]
    others = list(seen_0)
    model = None
    for step in range(ROUNDS):
        model = nystroem_machine(positive, negative, weight)
        if step == ROUNDS - 1:
            break
        value = model.values(others)
        known = set(negative)
        hard = [others[i] for i in np.argsort(-value)[:600] if value[i] > -0.8 and others[i] not in known]
        negative = hard + negative
        found = set(positive)
        bag_value = document_values(model, toxic)
        for bag, v in zip(toxic, bag_value, strict=True):
            if v < 0.3:
                fresh = [w for w in bag if not seen_0[w] and w not in found]
                if fresh:
                    values = model.values(fresh)
                    best = fresh[int(np.argmax(values))]
                    if values.max() > -0.5:
                        found.add(best)
                        positive.append(best)
                        weight[best] = 1.0
    calibrate(model, document_values(model, bags), np.array(labels))
    return model


def training_rows(docs: DataFrame, labels: DataFrame, held_out: int | None) -> tuple[list[set[str]], list[int]]:
    """Bags of words and labels of the training documents; those with crc32(doc_id) % 3 == held_out stay out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna()
    if held_out is not None:
        known = known.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != held_out)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    few = known.where("toxic = 1").orderBy(*order).limit(MAX_POSITIVE).unionByName(known.where("toxic = 0").orderBy(*order).limit(MAX_NEGATIVE))
    chosen = docs.join(F.broadcast(few), "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("row"))
    chosen = chosen.select("doc_id", "toxic", "row.text")

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [" ".join(sorted(words_of(t))) for t in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(found, pa.string())], ["doc_id", "toxic", "words"])

    got = chosen.mapInArrow(bags, "doc_id long, toxic int, words string").collect()
    got.sort(key=lambda r: (r.doc_id, r.words))
    return [set(r.words.split()) for r in got], [r.toxic for r in got]


class Scorer:
    """Values of documents, remembering words."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        bags = [words_of(t) for t in texts]
        if len(self.known) > MEMORY:
            self.known.clear()
        known = self.known
        new = list(set().union(*bags).difference(known)) if bags else []
        for at in range(0, len(new), 50_000):
            part = new[at : at + 50_000]
            known.update(zip(part, self.model.values(part).tolist(), strict=True))
        return self.model.scores(np.array([max(map(known.__getitem__, b), default=FLOOR) if b else FLOOR for b in bags]).clip(min=FLOOR))


def in_parts(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def fit(docs: DataFrame, labels: DataFrame, held_out: int | None) -> Model | None:
    return train(*training_rows(texts_of(docs), labels, held_out))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, held_out: int | None = 1) -> DataFrame:
    """doc_id, held_out, score and predicted for every row; rows with a null id are not held out."""
    slim = texts_of(docs)
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, held_out))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value) if sent.value else None
        for batch in batches:
            for part in in_parts(batch):
                texts = part.column(1).to_pylist()
                yield pa.record_batch([part.column(0), pa.array(scorer(texts) if scorer else np.zeros(len(texts)), pa.float64())], ["doc_id", "score"])

    apart = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == (-1 if held_out is None else held_out), F.lit(False))
    scored = slim.mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", apart.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, held_out: int | None = 1) -> DataFrame:
    """The rows of docs, all columns kept, whose score is below threshold."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, held_out))
    at = docs.columns.index("text")
    small_batches(docs.sparkSession)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value) if sent.value else None
        for batch in batches:
            for part in in_parts(batch):
                yield part.filter(pa.array(scorer(part.column(at).to_pylist()) < threshold)) if scorer else part

    return docs.mapInArrow(clean, docs.schema)
