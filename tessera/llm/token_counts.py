"""Token counts of a byte-level BPE without materialising ids.

A text is cut into pre-tokens; the pieces of each distinct pre-token of a partition are
counted once, by the tokenizer itself, and joined to the documents' pre-token
frequencies, whose weighted sum is the count.  The join is local to the partition: a
cluster-wide table of distinct pre-tokens would shuffle more bytes than the texts have
(see README), while a partition's table needs no exchange at all.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tessera.llm.common import texts_of

#: Unicode White_Space, which the tokenizers library means by \s; fixed values.
SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The pre-tokenizer pattern of byte-level BPE vocabularies, \s spelt out; fixed values.
PRE_TOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: Pre-tokens whose counts one task remembers at once, and documents looked at together.
MEMORY, TOGETHER = 400_000, 256


def plain_byte_level(parts: dict) -> bool:
    """Whether a tokenizer's description says that PRE_TOKEN cuts its texts: byte level, nothing else before it."""
    before = parts.get("pre_tokenizer") or {}
    plain = all(not t[k] for t in parts.get("added_tokens", []) for k in ("lstrip", "rstrip", "single_word"))
    return before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True) and parts.get("normalizer") is None and plain


class PieceCounter:
    """Counts tokens of texts; remembers the number of pieces of each distinct pre-token.

    A vocabulary whose texts are cut in another way is refused: its counts would be wrong.
    """

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        if not plain_byte_level(json.loads(tokenizer_json)):
            raise ValueError("only byte-level vocabularies without normaliser and prefix space are supported")
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.special_texts = special
        self.cut = regex.compile(PRE_TOKEN).findall
        self.pieces: dict[str, int] = {}

    def frequencies(self, text: str) -> tuple[int, Counter]:
        """Occurrences of special tokens' strings, and how often each pre-token of the rest occurs."""
        if self.special is None or not any(s in text for s in self.special_texts):
            return 0, Counter(self.cut(text))
        parts = self.special.split(text)
        found: Counter = Counter()
        for part in parts:
            found.update(self.cut(part))
        return len(parts) - 1, found

    def count(self, texts: list[str]) -> list[int]:
        tables = [self.frequencies(t) for t in texts]
        pieces = self.pieces
        if len(pieces) > MEMORY:
            pieces.clear()
        new = list({p for _, table in tables for p in table if p not in pieces})
        for p, e in zip(new, self.tokenizer.encode_batch(new, add_special_tokens=False), strict=True):
            pieces[p] = len(e)
        return [n + sum(f * pieces[p] for p, f in table.items()) for n, table in tables]


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row.

    A null text counts as empty: no bytes and no tokens.  Repeated rows and ids are counted
    row by row; other columns are ignored; texts of any length are counted whole.  The
    vocabulary file (about a megabyte, fixed) is read on the driver and broadcast.
    """
    text = Path(tokenizer_path).read_text(encoding="utf-8")
    PieceCounter(text)  # refuses other vocabularies before any job runs
    sent = docs.sparkSession.sparkContext.broadcast(text)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter(sent.value)
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                texts = [t or "" for t in part.column(1).to_pylist()]
                n = counter.count(texts)
                yield pa.record_batch(
                    [
                        part.column(0),
                        pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()),
                        pa.array(n, pa.int64()),
                        pa.array([x > limit for x in n], pa.bool_()),
                    ],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    return texts_of(docs).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
