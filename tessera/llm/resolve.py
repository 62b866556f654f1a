"""From judged fragments to texts: one exchange of the texts, contested documents settled in a second, smaller one."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import built, materialise, release, texts_of
from tessera.llm.repeats import Scheme, judged, runs_of_arrays, shared_fragments

SPAN = "array<struct<start:int,windows:int,anchor:long,kind:int>>"


def span_arrays(column: pa.Array) -> Iterator[dict[str, np.ndarray] | None]:
    """For each row of a SPAN column, its start, windows, anchor and kind as arrays; None where it is null."""
    offsets, flat = column.offsets.to_numpy(), column.values
    fields = {k: flat.field(k).to_numpy(zero_copy_only=False) for k in ("start", "windows", "anchor", "kind")}
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    for k in range(len(column)):
        a, b = offsets[k], offsets[k + 1]
        yield {n: v[a:b] for n, v in fields.items()} if valid[k] else None


def sure_runs(spans: dict[str, np.ndarray] | None, window: int) -> list[tuple[int, int]]:
    """Runs of units that go in any case."""
    if spans is None:
        return []
    sure = spans["kind"] == 0
    start, stop = spans["start"][sure], spans["start"][sure] + spans["windows"][sure] + window - 1
    return runs_of_arrays(start, stop)


def remove_repeats(
    docs: DataFrame,
    scheme: Scheme,
    contested_runs: Callable[[DataFrame], DataFrame],
    finish: Callable[[pa.RecordBatch, list[list[tuple[int, int]]]], pa.RecordBatch],
    schema: T.StructType | str,
) -> DataFrame:
    """finish(batch of docs, runs of units to cut from each) for all rows; rows it leaves out of its answer go.

    contested_runs takes (doc_id, text, spans) of the documents with contested fragments
    and returns (doc_id, runs): the windows among them that repeat an earlier one.  Rows that
    repeat an id and its text are handed to it once (once for each part of a split
    partition), however many they are.  Columns are known by their place, so any names will do.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spans = judged(shared_fragments(texts_of(docs), scheme), scheme)
    names, out = docs.columns, T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    id_at, text_at, n_out, n_in, window = names.index("doc_id"), names.index("text"), len(out), len(names), scheme.window
    own = docs.toDF(*[f"i{i}" for i in range(n_in)])
    key = F.col(f"i{id_at}").cast("long")
    # Hash join with the short side built, where it fits: the texts are streamed and need no sort.
    joined = own.join(built(spans.select(F.col("doc_id").alias("doc"), "spans")), key == F.col("doc"), "left").drop("doc")
    fields = [T.StructField(f"o{i}", f.dataType) for i, f in enumerate(out)] + [T.StructField(f"i{i}", f.dataType) for i, f in enumerate(docs.schema)]
    both = T.StructType([*fields, T.StructField("spans", T._parse_datatype_string(SPAN)), T.StructField("lead", T.BooleanType())])
    arrow = to_arrow_schema(both)

    def nulls(fields: list[pa.Field], n: int) -> list[pa.Array]:
        return [pa.nulls(n, f.type) for f in fields]

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[bytes] = set()
        for batch in batches:
            open_rows, lead, settled, runs = [], [], [], []
            for i, spans in enumerate(span_arrays(batch.column(n_in))):
                if spans is not None and spans["kind"].any():
                    text = batch.column(text_at)[i].as_py() or ""
                    digest = hashlib.blake2b(f"{batch.column(id_at)[i].as_py()} {text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()
                    open_rows.append(i)
                    lead.append(digest not in met)
                    met.add(digest)
                else:
                    settled.append(i)
                    runs.append(sure_runs(spans, window))
            source = pa.RecordBatch.from_arrays(batch.columns[:n_in], names=names)
            if settled:
                done = finish(source.take(pa.array(settled)), runs)
                yield pa.RecordBatch.from_arrays([*[c.cast(f.type) for c, f in zip(done.columns, arrow, strict=False)], *nulls(list(arrow)[n_out:], done.num_rows)], schema=arrow)
            if open_rows:
                some = batch.take(pa.array(open_rows))
                yield pa.RecordBatch.from_arrays([*nulls(list(arrow)[:n_out], some.num_rows), *[c.cast(f.type) for c, f in zip(some.columns, list(arrow)[n_out:-1], strict=True)], pa.array(lead)], schema=arrow)

    passed = materialise(joined.mapInArrow(first_pass, both), "settled")
    release(spans)
    done = passed.where("spans is null").select(*[F.col(f"o{i}").alias(f.name) for i, f in enumerate(out)])
    contested = passed.where("spans is not null").select(*[f"i{i}" for i in range(n_in)], "spans", "lead")
    slim = contested.where("lead").select(key.alias("doc_id"), F.col(f"i{text_at}").cast("string").alias("text"), "spans")
    runs = materialise(contested_runs(slim).select(F.col("doc_id").alias("doc"), "runs"), "runs")
    rest = contested.drop("lead").join(built(runs), key == F.col("doc"), "left").drop("doc")

    def second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = []
            found = batch.column(n_in + 1)
            offsets, a, b = found.offsets.to_numpy(), found.values.field("a").to_numpy(), found.values.field("b").to_numpy()
            for k, spans in enumerate(span_arrays(batch.column(n_in))):
                own = np.array(sure_runs(spans, window), dtype=np.int64).reshape(-1, 2)
                lo, hi = offsets[k], offsets[k + 1]  # equal where no runs were found
                cut.append(runs_of_arrays(np.concatenate([own[:, 0], a[lo:hi]]), np.concatenate([own[:, 1], b[lo:hi]])))
            yield finish(pa.RecordBatch.from_arrays(batch.columns[:n_in], names=names), cut)

    return done.unionByName(rest.mapInArrow(second_pass, out))
