"""Operator 3: quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` bytes that cover its whole text. A passage is described by the frequencies
of its pairs of byte classes and by how much it repeats itself, and encoded by one tanh layer. Gated attention, a_i ~ exp(w.(tanh(V h_i) * sigmoid(U h_i))),
weighs the passages; the score is a logistic function of the weighted sum. Only documents carry labels; encoder, attention
and score are learned together from them in numpy, on a bounded sample (``sample_docs`` documents with at most
``SAMPLE_PASSAGES`` passages each, evenly spaced; the driver holds them in half precision). Scoring reads every passage.

Null and empty texts are one passage without pairs and get the score the model gives that. Null ids and labels, ids with
contradicting labels and labels other than 0 and 1 are not learned from; of several texts with one id the first in order is. With a single class (or no label at all) there is
nothing to learn: every document gets the share of label 1, or 0.5. Repeated rows are scored once each. Other columns are
dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_buffer, id_bucket, slices
from .sample import Adam, hashed_sample

PASSAGE = 512
SAMPLE_PASSAGES = 64
CLASSES = 20
PAIRS = CLASSES * CLASSES
#: Hashed cells of four-byte strings, for how much a passage repeats itself.
GRAMS = 1024
FEATURES = PAIRS + 3


def _classes() -> np.ndarray:
    """A class for each byte: kinds of letters, digits, spaces, marks of prose, and other symbols."""
    out = np.full(256, 19, dtype=np.uint16)
    groups = [b"aeiou", b"tnsrhld", b"bcfgjkmpqvwxyz", b"AEIOU", bytes(c for c in range(65, 91) if c not in b"AEIOU"), b"0123456789", b" ", b"\n", b"\t\r\x0b\x0c",
              b".", b",", b"!?", b"'\"-:;()", b"|", b"#*", b"$%&", b"<>{}[]=+_~^\\/@`"]
    for n, g in enumerate(groups):
        out[np.frombuffer(g, np.uint8)] = n
    out[128:192] = 17
    out[192:] = 18
    return out


BYTE_CLASS = _classes()


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage, and the document each belongs to."""
    sizes = np.diff(offsets)
    n = np.maximum(1, -(-sizes // PASSAGE))
    first = np.cumsum(n) - n
    owner = np.repeat(np.arange(len(n)), n)
    out = np.zeros((int(n.sum()), FEATURES), dtype=np.float32)
    if len(data) > 4:
        inside = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        place = first.astype(np.int32)[inside] + ((np.arange(len(data)) - offsets[inside]) // PASSAGE).astype(np.int32)
        kind = BYTE_CLASS[data].astype(np.int64)
        cell = place[:-1].astype(np.int64) * PAIRS + kind[:-1] * CLASSES + kind[1:]
        counts = np.bincount(cell[inside[:-1] == inside[1:]], minlength=len(out) * PAIRS).astype(np.float32).reshape(-1, PAIRS)
        out[:, :PAIRS] = np.sqrt(counts / np.maximum(1, counts.sum(axis=1, keepdims=True)))
        wide = data.astype(np.uint32)
        gram = (wide[:-3] * 2654435761 + wide[1:-2] * 2246822519 + wide[2:-1] * 3266489917 + wide[3:] * 668265263) >> 22
        cell = place[:-3].astype(np.int64) * GRAMS + gram
        grams = np.bincount(cell[inside[:-3] == inside[3:]], minlength=len(out) * GRAMS).astype(np.float32).reshape(-1, GRAMS)
        total = np.maximum(1, grams.sum(axis=1))
        out[:, PAIRS] = (grams > 0).sum(axis=1) / total
        out[:, PAIRS + 1] = np.sqrt((grams * grams).sum(axis=1)) / total
        out[:, PAIRS + 2] = grams.max(axis=1) / total
    return out, owner


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class GatedAttention:
    """Encoder, gated attention and score. ``constant``: the score of a model that had nothing to learn."""

    def __init__(self, hidden: int = 32, gate: int = 16, seed: int = 7):
        rng = np.random.default_rng(seed)
        draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"W": draw(FEATURES, hidden) * 4, "b": np.zeros(hidden, np.float32), "V": draw(hidden, gate), "U": draw(hidden, gate), "w": draw(gate, 1), "o": draw(hidden, 1), "c": np.zeros(1, np.float32)}
        self.constant: float | None = None

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.p["W"] + self.p["b"])

    def attend(self, h: np.ndarray) -> np.ndarray:
        return ((np.tanh(h @ self.p["V"]) * _sigmoid(h @ self.p["U"])) @ self.p["w"]).ravel()

    def weights(self, logits: np.ndarray, starts: np.ndarray, owner: np.ndarray) -> np.ndarray:
        e = np.exp(logits - np.maximum.reduceat(logits, starts)[owner])
        return e / np.add.reduceat(e, starts)[owner]

    def scores(self, h: np.ndarray, owner: np.ndarray) -> np.ndarray:
        starts = np.searchsorted(owner, np.arange(owner[-1] + 1))
        a = self.weights(self.attend(h), starts, owner)
        return _sigmoid((np.add.reduceat(h * a[:, None], starts) @ self.p["o"] + self.p["c"]).ravel())

    def fit(self, bags: list[np.ndarray], labels: np.ndarray, epochs: int = 30, batch: int = 64, rate: float = 3e-3, seed: int = 11) -> "GatedAttention":
        if len(labels) == 0 or labels.min() == labels.max():
            self.constant = float(labels.mean()) if len(labels) else 0.5
            return self
        rng, p = np.random.default_rng(seed), self.p
        adam = Adam(p, rate, 1e-5)
        for epoch in range(epochs):
            adam.rate = rate * (1 - epoch / epochs) + 1e-4
            order = rng.permutation(len(bags))
            for at in range(0, len(order), batch):
                pick = order[at : at + batch]
                sizes = np.array([len(bags[i]) for i in pick])
                x, y = np.concatenate([bags[i] for i in pick]).astype(np.float32), labels[pick].astype(np.float32)
                owner, starts = np.repeat(np.arange(len(pick)), sizes), np.cumsum(sizes) - sizes
                h = self.encode(x)
                t, s = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
                a = self.weights(((t * s) @ p["w"]).ravel(), starts, owner)
                z = np.add.reduceat(h * a[:, None], starts)
                g = (_sigmoid((z @ p["o"] + p["c"]).ravel()) - y)[:, None] / len(pick)
                dz = (g @ p["o"].T)[owner]
                da = (dz * h).sum(axis=1)
                de = (a * (da - np.add.reduceat(a * da, starts)[owner]))[:, None]
                dts = de @ p["w"].T
                dt, ds = dts * s * (1 - t * t), dts * t * s * (1 - s)
                dh = (dz * a[:, None] + dt @ p["V"].T + ds @ p["U"].T) * (1 - h * h)
                adam.step({"W": x.T @ dh, "b": dh.sum(axis=0), "V": h.T @ dt, "U": h.T @ ds, "w": (t * s).T @ de, "o": z.T @ g, "c": g.sum(axis=0)})
        return self


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          sample_docs: int = 6000, folds: int = 5, held_out_fold: int = 0) -> GatedAttention:
    """Fit on at most ``sample_docs`` labelled documents outside the held-out fold."""
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).where(F.col("label").isin(0, 1) & (id_bucket("doc_id", folds) != held_out_fold))
    agreed = known.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").drop("other")
    agreed = agreed.join(docs.select(F.col(id_col).alias("doc_id")), "doc_id", "left_semi")  # labels without a document take no places
    picked = F.broadcast(hashed_sample(agreed, sample_docs))  # at most sample_docs rows of two numbers
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(picked, "doc_id")
    rows = rows.groupBy("doc_id", "label").agg(F.min("text").alias("text"))  # of several texts with one id the first in order

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                x, owner = passages(*byte_buffer(part.column("text")))
                ends = np.searchsorted(owner, np.arange(len(part) + 1))
                bags = []
                for i in range(len(part)):
                    n = ends[i + 1] - ends[i]
                    take = ends[i] + (np.arange(n) if n <= SAMPLE_PASSAGES else np.linspace(0, n - 1, SAMPLE_PASSAGES).astype(int))
                    bags.append(x[take].astype("<f2").tobytes())
                yield pa.RecordBatch.from_arrays([part.column("label"), pa.array(bags, pa.binary())], names=["label", "bag"])

    found = sorted((r["label"], bytes(r["bag"])) for r in rows.select("label", "text").mapInArrow(describe, "label int, bag binary").toLocalIterator())
    bags = [np.frombuffer(b, "<f2").reshape(-1, FEATURES) for _, b in found]
    return GatedAttention().fit(bags, np.array([y for y, _ in found]))


def score(docs: DataFrame, model: GatedAttention, *, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of every document, with ``score``: the probability of label 1."""
    fields = [docs.schema[k] for k in (keep or ["doc_id"])]
    rows = docs.select(*(F.col(f.name) for f in fields), F.col(text_col).cast("string").alias("_scored"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_scored", 1 << 19):
                if model.constant is not None:
                    value = np.full(len(part), model.constant)
                else:
                    data, offsets = byte_buffer(part.column("_scored"))
                    hidden, owners = [], []
                    for first, last in _blocks(offsets):
                        x, owner = passages(data[first:last], np.clip(offsets, first, last) - first)
                        has = np.diff(np.clip(offsets, first, last))[owner] > 0
                        hidden.append(model.encode(x[has]))
                        owners.append(owner[has])
                    lacking = np.flatnonzero(np.diff(offsets) == 0)
                    hidden.append(np.repeat(model.encode(np.zeros((1, FEATURES), np.float32)), len(lacking), axis=0))
                    owners.append(lacking)
                    owner = np.concatenate(owners)
                    order = np.argsort(owner, kind="stable")
                    value = model.scores(np.concatenate(hidden)[order], owner[order])
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in fields), pa.array(np.clip(value, 0, 1).astype(np.float64))], names=[*(f.name for f in fields), "score"])

    return rows.mapInArrow(run, T.StructType([*fields, T.StructField("score", T.DoubleType())]))


def _blocks(offsets: np.ndarray, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of the buffer of about ``size`` bytes; a text longer than that is cut where a passage ends."""
    at, end = 0, int(offsets[-1])
    while at < end:
        stop = min(end, at + size)
        if stop < end:
            text = int(np.searchsorted(offsets, stop, side="right")) - 1
            stop = max(int(offsets[text]), at) if offsets[text] > at else at + (stop - at) // PASSAGE * PASSAGE
        yield at, stop
        at = stop


def classify(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, folds: int = 5, held_out_fold: int = 0, sample_docs: int = 6000, keep: list[str] | None = None) -> DataFrame:
    """Train on the labelled documents outside the held-out fold, then score all: ``keep``, ``held_out``, ``score``, ``predicted``."""
    model = train(docs, labels, folds=folds, held_out_fold=held_out_fold, sample_docs=sample_docs)
    scored = score(docs, model, keep=keep or ["doc_id"])
    return scored.withColumn("held_out", F.coalesce(id_bucket("doc_id", folds) == held_out_fold, F.lit(False))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
