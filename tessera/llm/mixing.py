"""Mixing sources to target weights by Pfair scheduling.

A source's documents are put in a fixed pseudo-random order (MD5 of the id) and cut into
blocks.  Of a source with weight w, block k (from 0) is released at slot floor(k / w) and is
due by slot ceil((k + 1) / w); in each slot the released block with the earliest deadline
is taken.  With weights that sum to one this meets every deadline, so after any number of
slots each source is less than one block away from its share.

Weights are exact: whole numbers in the proportion of the target weights, whatever their
size, so releases and deadlines hold over a whole phase and nothing is rounded.  Where a
source runs out, a new phase begins in which the weights of the remaining ones are scaled
up.  The driver keeps the schedule's state (two numbers for each source) every frame of at
least FRAME slots; frames grow with sources and blocks, so that there are at most FRAMES of
them and their states hold no more numbers than an eighth of the blocks.  Within a phase the
schedule repeats after a period, the sum of the remaining weights, in slots; the driver plays
a few periods of a phase, or the whole phase if that is shorter, and leaps over the
rest.  From the states executors play all frames, side by side, and write the slot of every
block.  Any number of sources is planned, in driver memory of a few numbers for each.  With
default weights a period has at most 1000 slots for each source, so the driver's time depends
on the sources and not on the documents; with weights of many digits it may grow with the
blocks.  The driver never handles documents: their positions come from
counts by bucket of the order, and a window over buckets that no source can overfill.

A null source is a source of its own; null texts count as documents.  Null ids are ordered
by text hash, where there is a text; rows that have the same key then are ordered
arbitrarily among themselves, and dealt over many windows if they are many.  An empty table gives an empty result.  No row is dropped.
"""

from __future__ import annotations

import heapq
import math
import uuid
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import built, materialise

FRAME, FRAMES, BLOCK = 1000, 4096, 16
#: Slots played, or written, at once.
PIECE = 8192
#: Rows that one window group is meant for.
GROUP = 1024


def exactly(weight) -> Fraction:
    """A weight without rounding; a float counts as the decimal number that it prints as."""
    return Fraction(repr(float(weight))) if isinstance(weight, float) else Fraction(weight)


def whole_weights(weights: dict) -> dict:
    """The least positive whole numbers in exactly the proportion of positive weights."""
    exact = {s: exactly(w) for s, w in weights.items()}
    scale = math.lcm(*(w.denominator for w in exact.values()))
    out = {s: w.numerator * (scale // w.denominator) for s, w in exact.items()}
    common = math.gcd(*out.values())
    return {s: w // common for s, w in out.items()}


class Schedule:
    """Earliest deadline first among released blocks, from any slot on; sources are numbers, which break ties.

    start is the first slot of the phase, base the blocks that each source had taken by
    then, done those taken by slot.  A phase ends with the slot in which some source's last
    block is taken.
    """

    def __init__(self, weights: list[int], blocks: list[int], slot: int = 0, start: int = 0, base: list | None = None, done: list | None = None):
        self.weights, self.blocks, self.slot, self.start = weights, blocks, slot, start
        self.base = list(base or [0] * len(blocks))
        self.done = list(done or self.base)
        self._queue()

    def state(self) -> tuple:
        return self.slot, self.start, list(self.base), list(self.done)

    def _queue(self) -> None:
        self.live = [s for s, n in enumerate(self.blocks) if self.base[s] < n]
        self.total = sum(self.weights[s] for s in self.live)
        self.ready: list[tuple] = []
        self.later: list[tuple] = []
        for s in self.live:
            self._push(s)

    def periods(self) -> int:
        """Whole periods of total slots each after which every live source still has a block to take."""
        return min(((self.blocks[s] - 1 - self.done[s]) // self.weights[s] for s in self.live), default=0)

    def state_after(self, periods: int) -> tuple:
        """The state that many periods later: each has every live source take as many blocks as its weight."""
        slot, start, base, done = self.state()
        for s in self.live:
            done[s] += periods * self.weights[s]
        return slot + periods * self.total, start, base, done

    def play(self, slots: int) -> None:
        """Take so many slots and forget them; whole periods are leapt over."""
        end = min(self.slot + slots, sum(self.blocks))
        while self.slot < end:
            periods = min(self.periods(), (end - self.slot) // self.total)
            if periods:
                self.slot, self.start, self.base, self.done = self.state_after(periods)
                self._queue()
            else:
                self.take(min(PIECE, end - self.slot))

    def _push(self, s: int) -> None:
        k, w = self.done[s] - self.base[s], self.weights[s]
        heapq.heappush(self.later, (k * self.total // w, -(-(k + 1) * self.total // w), s))

    def take(self, slots: int) -> list[tuple[int, int]]:
        """(source, block) of each of the next slots; fewer at the end."""
        out: list[tuple[int, int]] = []
        while len(out) < slots and (self.ready or self.later):
            t = self.slot - self.start
            while self.later and self.later[0][0] <= t:
                _, due, s = heapq.heappop(self.later)
                heapq.heappush(self.ready, (due, s))
            due, s = heapq.heappop(self.ready)
            if due <= t:
                raise AssertionError("a deadline was missed")
            out.append((s, self.done[s]))
            self.done[s] += 1
            self.slot += 1
            if self.done[s] < self.blocks[s]:
                self._push(s)
            else:
                self.start, self.base = self.slot, list(self.done)
                self._queue()
        return out


def pfair_frame(shares: dict) -> list:
    """The source of each slot of one frame, after which the schedule of these whole weights repeats."""
    names = sorted(shares, key=str)
    weights = [shares[s] for s in names]
    # One block more than the frame takes: no source runs out in it.
    return [names[s] for s, _ in Schedule(weights, [w + 1 for w in weights]).take(sum(weights))]


def states(weights: list[int], blocks: list[int], frame: int = FRAME) -> Iterator[tuple]:
    """The schedule's state at every frame slots, from 0 on; of many periods of a phase only one is played."""
    schedule, total = Schedule(weights, blocks), sum(blocks)
    while schedule.slot < total:
        periods, period = schedule.periods(), schedule.total
        if periods < 2:
            yield schedule.state()
            schedule.play(frame)
            continue
        leap = periods * period
        wanted = sorted((at % period, at // period) for at in range(0, leap, frame))
        one, found = Schedule(weights, blocks, *schedule.state()), []
        for place, skipped in wanted:
            one.play(schedule.slot + place - one.slot)
            found.append(one.state_after(skipped))
        yield from sorted(found)
        schedule.play(len(wanted) * frame)


def default_weights(counts: dict, power: float = 0.5) -> dict:
    """Weights as a power of the sources' sizes, so that large sources give way to small ones: 1000 for the largest, whole numbers, at least 1."""
    most = max(counts.values(), default=1)
    return {s: Fraction(max(1, round(1000 * (n / most) ** power))) for s, n in counts.items()}


def without_hot_buckets(marked: DataFrame, counts: DataFrame, source: str, digest: str, bucket: str) -> tuple[DataFrame, DataFrame]:
    """The same rows and counts with the buckets of very many rows cut by the whole MD5 and, within one MD5, by a number dealt once.

    Only repeated or missing ids fill a bucket so; their numbers are written with the rows, as
    both the counts and the documents have to see the same ones.
    """
    hot = counts.where(F.col("n") > 64 * GROUP)
    most = hot.agg(F.max("n")).head()[0]
    if most is None:
        return marked, counts
    digits = 1
    while most > GROUP * 16**digits:
        digits += 1
    keys = built(materialise(hot.select(source, bucket), "hot"))
    number = F.lpad(F.lower(F.hex(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(16**digits)))), digits, "0")
    rows = marked.join(keys, [source, bucket], "left_semi").withColumn(digest, F.concat(digest, number)).withColumn(bucket, F.col(digest))
    rows = materialise(rows, "dealt")
    more = rows.groupBy(source, bucket).agg(F.count(F.lit(1)).alias("n"))
    counts = materialise(counts.where(F.col("n") <= 64 * GROUP).unionByName(more), "counts")
    return marked.join(keys, [source, bucket], "left_anti").unionByName(rows), counts


def mix_sources(docs: DataFrame, weights: dict | None = None, block: int = BLOCK, frame: int = FRAME) -> DataFrame:
    """docs with block (number within the source), slot (of the block) and place; ordering by place mixes the sources.

    weights: positive target weight by source, None for the null source; sources that it
    does not name, and all if it is None, get default weights.  Columns of docs that are
    called block, slot or place are replaced.
    """
    spark = docs.sparkSession
    tag = uuid.uuid4().hex[:8]
    source, digest, bucket, rank, first = (f"__{x}_{tag}" for x in ("source", "md5", "bucket", "rank", "first"))
    kept = [c for c in docs.columns if c not in ("block", "slot", "place")]
    marked = docs.select(kept).withColumn(source, F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("null")))
    marked = marked.withColumn(digest, F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
    if "text" in kept:
        marked = marked.withColumn(digest, F.when(F.col("doc_id").isNotNull() | F.col("text").isNull(), F.col(digest)).otherwise(F.md5(F.col("text").cast("binary"))))
    # As many leading digits of the MD5 as make groups of at most about GROUP rows.
    total, digits = docs.count(), 1
    while total > GROUP * 16**digits and digits < 15:
        digits += 1
    marked = marked.withColumn(bucket, F.substring(digest, 1, digits))
    counts = materialise(marked.groupBy(source, bucket).agg(F.count(F.lit(1)).alias("n")), "counts")
    marked, counts = without_hot_buckets(marked, counts, source, digest, bucket)
    sizes = {r[0]: r[1] for r in counts.groupBy(source).agg(F.sum("n")).toLocalIterator()}
    target = default_weights(sizes)
    target.update({"null" if s is None else f"s{s}": exactly(w) for s, w in (weights or {}).items() if exactly(w) > 0})
    names = sorted(sizes)
    shares = whole_weights({s: target[s] for s in names}) if names else {}
    weight, blocks = [shares[s] for s in names], [-(-sizes[s] // block) for s in names]
    # A state holds two numbers a source: longer frames where sources or blocks are many.
    frame = max(frame, 16 * len(names), -(-sum(blocks) // FRAMES))
    sent = spark.sparkContext.broadcast((names, weight, blocks))
    frames = spark.createDataFrame(list(states(weight, blocks, frame)), "slot long, start long, base array<long>, done array<long>")

    def play(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, weight, blocks = sent.value
        for batch in batches:
            for at in batch.to_pylist():
                schedule, left = Schedule(weight, blocks, **at), frame
                while left and (taken := schedule.take(min(left, PIECE))):
                    left -= len(taken)
                    columns = [[names[s] for s, _ in taken], [k for _, k in taken], range(schedule.slot - len(taken), schedule.slot)]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)], names=[source, "block", "slot"])

    schedule = frames.mapInArrow(play, f"{source} string, block long, slot long")
    # Rows before a bucket in two levels, so that no window holds more than the root of a source's buckets.
    head = F.substring(bucket, 1, -(-digits // 2))

    def before(*keys: str) -> Column:
        order = "head" if len(keys) == 1 else bucket
        total = F.sum("n").over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
        return F.coalesce(total, F.lit(0))

    headed = counts.withColumn("head", head)
    heads = headed.groupBy(source, "head").agg(F.sum("n").alias("n")).select(source, "head", before(source).alias("outer"))
    offsets = headed.withColumn("inner", before(source, "head")).join(heads, [source, "head"]).select(source, bucket, "n", (F.col("outer") + F.col("inner")).alias(first))
    # The slots of a bucket's blocks, in order: documents meet them with the keys that their window has anyway.
    span = F.sequence(F.floor(F.col(first) / block), F.floor((F.col(first) + F.col("n") - 1) / block))
    slots = offsets.select(source, bucket, first, F.explode(span).alias("block")).join(schedule, [source, "block"])
    slots = slots.groupBy(source, bucket, first).agg(F.sort_array(F.collect_list("slot")).alias("slots")).alias("plan")
    within = F.row_number().over(Window.partitionBy(source, bucket).orderBy(digest, "doc_id"))
    ranked = marked.withColumn(rank, within).alias("docs")
    out = ranked.join(slots, (F.col(f"docs.{source}") == F.col(f"plan.{source}")) & (F.col(f"docs.{bucket}") == F.col(f"plan.{bucket}")))
    at = F.col(f"plan.{first}") + F.col(f"docs.{rank}") - 1
    number = F.floor(at / block).cast("long")
    nth = number - F.floor(F.col(f"plan.{first}") / block) + 1
    slot = F.element_at("plan.slots", nth.cast("int"))
    columns = [number.alias("block"), slot.alias("slot"), (slot * block + at % block).alias("place")]
    return out.select(*[F.col(f"docs.{c}") for c in kept], *columns)
