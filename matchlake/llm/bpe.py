"""Operator 1: byte-level BPE encoding and decoding.

Texts longer than ``chunk_chars`` are cut into chunks that overlap by ``overlap_chars``. Chunks are pre-tokenised in
parallel, each from its own start, which may lie inside a pre-token. Whether a match starts at a position depends only
on the text from that position on, so as soon as two neighbours have a boundary in common, all later boundaries agree:
the first common boundary inside the overlap is where the text is cut. A chunk without one (a pre-token longer than the
overlap) is joined to the chunk before it. The pieces between cuts are encoded independently and their ids concatenated.

A boundary within ``MARGIN`` characters of the end of a cut chunk may still change with the text that follows (a
contraction, a run of white space), so it isn't used.

Null text is encoded as the empty text (no ids); empty texts give no ids; rows with equal or null ids are kept apart by a
row number, so they all come back; other columns are dropped. The ids travel as little-endian unsigned 32-bit integers.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices

MARGIN = 8
#: Above this many characters a single call of the library may exhaust its stack on long runs; such texts are matched first.
LIBRARY_CHARS = 50_000
#: Entries of the per-worker memo of space-separated words; emptied when full.
MEMO = 200_000
_SPACED = re.compile(r"\s \s|\s |\s$| \s")


class Codec:
    """Ranks and pattern of a byte-level BPE vocabulary, loaded once per Python worker."""

    def __init__(self, ranks_path: str, pattern: str):
        import regex
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.ordinary = self.encoding._core_bpe.encode_ordinary
        self.pattern = regex.compile(pattern)
        self.memo: dict[str, bytes] = {}
        size = max(ranks.values()) + 1
        self.tokens = np.empty(size, dtype=object)
        self.tokens[:] = b""
        for token, rank in ranks.items():
            self.tokens[rank] = token

    def _ids(self, text: str) -> bytes:
        if len(text) <= LIBRARY_CHARS:
            return np.array(self.ordinary(text), dtype="<u4").tobytes()
        single = self.encoding._encode_single_piece
        return b"".join(np.array(single(m.group().encode()), dtype="<u4").tobytes() for m in self.pattern.finditer(text))

    def encode(self, text: str) -> bytes:
        """Ids of a text.

        A pre-token never runs on into a single space between two other characters, so a text without adjoining white
        space falls apart into words with their leading space; those repeat, and their ids are remembered.
        """
        if not text:
            return b""
        if _SPACED.search(text):
            return self._ids(text)
        memo, out = self.memo, []
        first, *rest = text.split(" ")
        words = [first, *[" " + w for w in rest]] if first else [" " + w for w in rest]
        if len(memo) > MEMO:
            memo.clear()
        for w in words:
            ids = memo.get(w)
            if ids is None:
                ids = self._ids(w)
                if len(w) < 64:
                    memo[w] = ids
            out.append(ids)
        return b"".join(out)

    def boundaries(self, text: str, final: bool) -> np.ndarray:
        """Starts of the matches in a chunk, without those that text after the chunk could change."""
        starts = np.fromiter((m.start() for m in self.pattern.finditer(text)), dtype=np.int32)
        if final or not len(starts):
            return starts
        # a start is certain if the match before it ends away from the chunk's end, that is, if it is itself away from it
        return starts[starts <= len(text) - MARGIN]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(self.tokens[np.frombuffer(ids, dtype="<u4")].tolist())


@lru_cache(maxsize=2)
def codec(ranks_path: str, pattern: str) -> Codec:
    return Codec(ranks_path, pattern)


def _encode_column(ranks_path: str, pattern: str, keep: list[str], max_bytes: int = 4 << 20):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        for batch in batches:
            for part in slices(batch, "text", max_bytes):
                ids = [c.encode(t or "") for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), pa.array(ids, pa.binary())], names=[*keep, "ids"])

    return run


def encode(docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text",
           chunk_chars: int = 32_768, overlap_chars: int = 1_024) -> DataFrame:
    """One row per document: ``doc_id``, ``ids`` (binary, little-endian u32) and ``n_tokens``."""
    if not 4 * MARGIN < overlap_chars <= chunk_chars:
        raise ValueError("overlap_chars must be at most chunk_chars and well over the margin")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    length = F.coalesce(F.length("text"), F.lit(0))
    short = rows.where(length <= chunk_chars).mapInArrow(_encode_column(ranks_path, pattern, ["doc_id"]), f"doc_id {kind}, ids binary")
    long = rows.withColumn("row", F.monotonically_increasing_id()).where(length > chunk_chars)
    pieces = _pieces(long, kind, ranks_path, pattern, chunk_chars, overlap_chars)
    coded = pieces.mapInArrow(_encode_column(ranks_path, pattern, ["row", "doc_id", "piece"], 1 << 20), f"row long, doc_id {kind}, piece long, ids binary")
    joined = coded.groupBy("row").applyInArrow(_join_ids, f"doc_id {kind}, ids binary")
    return short.unionByName(joined).select("doc_id", "ids", (F.length("ids") / 4).cast("long").alias("n_tokens"))


def _join_ids(group: pa.Table) -> pa.Table:
    """Ids of the pieces of one document in order; a document's ids are one row by contract."""
    group = group.sort_by("piece")
    return pa.table({"doc_id": group.column("doc_id").slice(0, 1), "ids": pa.array([b"".join(group.column("ids").to_pylist())], pa.binary())})


def _pieces(long: DataFrame, kind: str, ranks_path: str, pattern: str, size: int, overlap: int) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, doc, text in zip(*(batch.column(n).to_pylist() for n in ("row", "doc_id", "text"))):
                n = max(1, -(-len(text) // size))
                for first in range(0, n, 64):
                    ks = range(first, min(n, first + 64))
                    yield pa.RecordBatch.from_pydict({
                        "row": [row] * len(ks), "doc_id": pa.array([doc] * len(ks), batch.schema.field("doc_id").type), "chunk": list(ks),
                        "final": [(k + 1) * size + overlap >= len(text) for k in ks], "text": [text[k * size : (k + 1) * size + overlap] for k in ks]})

    def pretokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        for batch in batches:
            head, tail = [], []
            for text, final in zip(batch.column("text").to_pylist(), batch.column("final").to_pylist()):
                starts = c.boundaries(text, final)
                head.append(starts[starts < overlap])
                tail.append(starts[starts >= size] - size)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in ("row", "doc_id", "chunk", "text")), pa.array(head, pa.list_(pa.int32())), pa.array(tail, pa.list_(pa.int32()))],
                names=["row", "doc_id", "chunk", "text", "head", "tail"])

    chunks = long.mapInArrow(cut, f"row long, doc_id {kind}, chunk long, final boolean, text string").repartition("row", "chunk")
    marked = chunks.mapInArrow(pretokenise, f"row long, doc_id {kind}, chunk long, text string, head array<int>, tail array<int>")
    w = Window.partitionBy("row").orderBy("chunk")
    common = F.array_min(F.array_intersect("head", F.lag("tail").over(w)))
    cuts = marked.select("row", "doc_id", "chunk", "text", F.when(F.col("chunk") == 0, F.lit(0)).otherwise(common).alias("cut"))
    cuts = cuts.withColumn("is_last", F.lead("chunk").over(w).isNull()).withColumn("next_cut", F.lead("cut").over(w))
    cuts = cuts.withColumn("piece", F.sum(F.col("cut").isNotNull().cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    start = F.coalesce("cut", F.lit(0))
    stop = F.when(F.col("is_last"), F.length("text")).otherwise(size + F.coalesce("next_cut", F.lit(0)))
    parts = cuts.select("row", "doc_id", "piece", "chunk", F.col("text").substr(start + 1, stop - start).alias("part"))
    return parts.repartition("row", "piece").groupBy("row", "piece").agg(
        F.first("doc_id").alias("doc_id"),
        F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("chunk", "part"))), lambda x: x["part"])).alias("text"))


def decode(coded: DataFrame, ranks_path: str, pattern: str, *, ids_col: str = "ids") -> DataFrame:
    """Adds ``decoded``: the raw bytes of the ids of each row, back to back. Null ids give null."""
    fields = [(f.name, f.dataType.simpleString()) for f in coded.schema.fields if f.name != "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        for batch in batches:
            for part in slices(batch, ids_col, 8 << 20):
                raw = [None if v is None else c.decode(v) for v in part.column(ids_col).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n, _ in fields), pa.array(raw, pa.binary())], names=[*(n for n, _ in fields), "decoded"])

    return coded.select(*(n for n, _ in fields)).mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in [*fields, ("decoded", "binary")]))
