"""Operator 5: substring dedup by hashing lines or paragraphs.

Texts are cut into units at line breaks (or blank lines). A unit is normalised (lower case, white space collapsed) and
hashed; of all units with one digest the earliest ranked stays, by (id, place), and the others are removed. Offsets into
the original text are kept. Blank units are never removed, nor, if that is asked for, units of fewer than ``min_words``
words.

The earliest place of a digest is a partial aggregate, and the join that brings it back is salted, so a line that a third
of all documents share is no hot group. Texts are joined once, with the units that they lose.

Null texts count as empty (one empty unit). Rows with a null id rank last; rows with equal ids rank by their place in the
input. Repeated rows come back once each; all units of the later ones go. Other columns are dropped.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices

_SPACE = re.compile(r"[ \t\r\f\v]+")
CUTS = {"line": re.compile(r"\n"), "paragraph": re.compile(r"\n[ \t]*\n\s*")}


def units(text: str, cut: re.Pattern) -> list[tuple[int, int]]:
    """(start, stop) of every unit of a text."""
    out, at = [], 0
    for m in cut.finditer(text):
        out.append((at, m.start()))
        at = m.end()
    return [*out, (at, len(text))]


def normalised(unit: str) -> str:
    return _SPACE.sub(" ", unit.lower().replace("\n", " ")).strip(" ")


def repeated_units(docs: DataFrame, *, unit: str = "line", min_words: int = 1, salts: int = 16) -> DataFrame:
    """``row``, ``places``: the places (numbers of units) that each row of ``docs`` (``doc_id``, ``row``, ``text``) loses."""
    cut = CUTS[unit]
    kind = docs.schema["doc_id"].dataType

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                owner, place, digest = [], [], []
                for i, text in enumerate(part.column("text").to_pylist()):
                    for n, (a, b) in enumerate(units(text or "", cut)):
                        plain = normalised(text[a:b]) if b > a else ""
                        if plain and plain.count(" ") + 1 >= min_words:
                            owner.append(i)
                            place.append(n)
                            digest.append(hashlib.blake2b(plain.encode(), digest_size=16).digest())
                take = pa.array(owner, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(take), part.column("row").take(take), pa.array(place, pa.int64()), pa.array(digest, pa.binary())], names=["doc_id", "row", "place", "digest"])

    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("row", T.LongType()), T.StructField("place", T.LongType()), T.StructField("digest", T.BinaryType())])
    found = docs.select("doc_id", "row", "text").mapInArrow(digests, schema).withColumn("at", F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row", "place"))
    first = found.groupBy("digest").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    # the rows of one digest are dealt over ``salts`` tasks, each of which gets its earliest place
    first = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    found = found.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int"))
    return found.join(first, ["digest", "salt"]).where("at <> first").groupBy("row").agg(F.collect_list("place").alias("places"))


def remove_repeated_units(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", unit: str = "line", min_words: int = 1) -> DataFrame:
    """Per document ``doc_id``, ``n_units``, ``n_removed``, ``removed_chars``, ``removed`` (start and stop in the original text) and ``text`` (the units left, with one break between)."""
    cut, glue = CUTS[unit], {"line": "\n", "paragraph": "\n\n"}[unit]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("row", F.monotonically_increasing_id())
    lost = repeated_units(rows, unit=unit, min_words=min_words)
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                number, gone, chars, spans, kept = [], [], [], [], []
                for text, places in zip(part.column("text").to_pylist(), part.column("places").to_pylist()):
                    text, drop = text or "", set(places or ())
                    all_units = units(text, cut)
                    out = [all_units[p] for p in sorted(drop)]
                    number.append(len(all_units))
                    gone.append(len(out))
                    chars.append(sum(b - a for a, b in out))
                    spans.append([{"start": a, "stop": b} for a, b in out])
                    kept.append(glue.join(text[a:b] for n, (a, b) in enumerate(all_units) if n not in drop) if drop else text)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(v, pa.int64()) for v in (number, gone, chars)), pa.array(spans, span), pa.array(kept, pa.string())],
                                                 names=["doc_id", "n_units", "n_removed", "removed_chars", "removed", "text"])

    removed = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))
    schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), *(T.StructField(n, T.LongType()) for n in ("n_units", "n_removed", "removed_chars")), T.StructField("removed", removed), T.StructField("text", T.StringType())])
    return rows.join(lost, "row", "left").select("doc_id", "text", "places").mapInArrow(apply, schema)
