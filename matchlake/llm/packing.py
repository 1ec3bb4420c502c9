"""Operator 2: packing by power-of-two decomposition.

A document's ids (with the end mark) are cut into as many pieces of ``max_tokens`` as fit and, for the rest, one piece
for each binary digit of its length, largest first. Every piece is a sequence of its own whose length is a power of two,
so no sequence crosses documents and none needs padding; training draws batches from buckets of equal length.

The ids are those that the ``tokenizers`` file of the vocabulary gives without its post-processor: texts are split on the
added tokens that the file lists (with their ``lstrip``, ``rstrip`` and ``single_word``) and these get their own ids; what
lies between is encoded by the vocabulary's ranks, which gives equal ids (tests compare them). Null and empty texts consist of the end mark alone. Rows with equal or null ids are packed separately. Sequence
numbers are unique, not gapless. Everything happens in one pass without a shuffle.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Codec, codec
from .common import slices


def added_tokens(tokenizer_path: str) -> list[dict]:
    """The added tokens of a ``tokenizers`` file."""
    with open(tokenizer_path, encoding="utf-8") as f:
        file = json.load(f)
    if file.get("normalizer"):
        raise ValueError("a normalizer changes the text that added tokens are matched in")
    return file.get("added_tokens") or []


class AddedTokens:
    """Encodes texts with the added tokens matched first: the leftmost, and of several at one place the longest."""

    def __init__(self, tokens: list[dict], c: Codec):
        self.codec, self.tokens = c, {t["content"]: t for t in tokens if t["content"]}
        longest = sorted(self.tokens, key=len, reverse=True)
        self.pattern = re.compile("|".join(map(re.escape, longest))) if longest else None

    def _spans(self, text: str) -> list[tuple[int, int, int]]:
        """(start, stop, id) of the matches."""
        out, at = [], 0
        for m in self.pattern.finditer(text):
            token, (start, stop) = self.tokens[m.group()], m.span()
            if token.get("single_word") and (re.match(r"\w", text[start - 1 : start]) or re.match(r"\w", text[stop : stop + 1])):
                continue
            if token.get("lstrip"):
                start = max(at, len(text[:start].rstrip()))
            if token.get("rstrip"):
                stop = len(text) - len(text[stop:].lstrip())
            out.append((start, stop, token["id"]))
            at = stop
        return out

    def encode(self, text: str) -> bytes:
        if self.pattern is None or not self.pattern.search(text):
            return self.codec.encode(text)
        out, at = [], 0
        for start, stop, token_id in self._spans(text):
            out += [self.codec.encode(text[at:start]) if start > at else b"", token_id.to_bytes(4, "little")]
            at = stop
        return b"".join([*out, self.codec.encode(text[at:]) if at < len(text) else b""])


def binary_lengths(n: int, max_tokens: int) -> list[int]:
    """Piece lengths for ``n`` ids: 2500 with 1024 gives 1024, 1024, 256, 128, 64, 4."""
    whole, rest = divmod(n, max_tokens)
    return [max_tokens] * whole + [1 << b for b in range(max_tokens.bit_length() - 2, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text",
         max_tokens: int = 1024, end_id: int = 0, tokenizer_path: str | None = None) -> DataFrame:
    """One row per piece: ``doc_id``, ``start``, ``length``, ``doc_tokens``, ``ids`` (binary u32), ``sequence_id``, ``offset``.

    ``tokenizer_path`` is the ``tokenizers`` file, beside the ranks under the same name if not given; it is read once, by the driver.
    """
    tokens = added_tokens(tokenizer_path or f"{ranks_path.removesuffix('.tiktoken')}.json")
    if max_tokens < 1 or max_tokens & (max_tokens - 1):
        raise ValueError("max_tokens must be a power of two")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = AddedTokens(tokens, codec(ranks_path, pattern))
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                owner, start, length, total, ids = [], [], [], [], []
                for i, text in enumerate(part.column("text").to_pylist()):
                    coded, at = c.encode(text or "") + end, 0
                    n = len(coded) // 4
                    for size in binary_lengths(n, max_tokens):
                        owner.append(i)
                        start.append(at)
                        length.append(size)
                        total.append(n)
                        ids.append(coded[4 * at : 4 * (at + size)])
                        at += size
                longs = [pa.array(v, pa.int64()) for v in (start, length, total)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(owner, pa.int64())), *longs, pa.array(ids, pa.binary())],
                                                 names=["doc_id", "start", "length", "doc_tokens", "ids"])

    pieces = rows.mapInArrow(run, f"doc_id {kind}, start long, length long, doc_tokens long, ids binary")
    return pieces.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Write the sequences in one folder per length, as trainers read them."""
    pieces.write.mode("overwrite").partitionBy("length").parquet(path)
