"""Operator 9: language identification by a byte convolutional network.

Texts are cut into windows of ``WINDOW`` bytes (the last one padded), each overlapping the one before by the widest
filter. Filters of several widths slide over the folded bytes of a window, max pooling keeps the strongest answer of each,
and a softmax turns the pooled values into probabilities. The network is trained in numpy on labelled windows of a bounded
sample (``sample_docs`` documents, at most ``SAMPLE_WINDOWS`` windows each). A text's prediction is the mean of its
windows' probabilities weighted by their letters, over the whole text.

A filter over one-hot bytes is a sum of one table entry per byte; tables of byte pairs halve the look-ups.

Null texts and texts without a letter are ``und`` with score 0. Null languages are not learned from; with no learned
language every text is ``und``, with one every text with a letter has that one. Repeated rows are predicted once each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_buffer, id_bucket, slices
from .sample import Adam, stratified_sample

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 12
SAMPLE_WINDOWS = 6


def _fold() -> np.ndarray:
    """A class for each byte: padding and other, space, digit, letters without case, and every byte above 127 by itself."""
    out = np.ones(256, dtype=np.uint16)
    out[0] = 0
    out[[9, 10, 11, 12, 13, 32]] = 2
    out[48:58] = 3
    for n in range(26):
        out[65 + n] = out[97 + n] = 4 + n
    out[128:] = 30 + np.arange(128)
    return out


FOLD = _fold()
SYMBOLS = 158


def windows(data: np.ndarray, offsets: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Folded windows that start every ``step`` bytes of each text, padded, and the text each belongs to."""
    sizes = np.diff(offsets)
    n = -(-np.maximum(sizes - (WINDOW - step), np.minimum(sizes, 1)) // step)
    owner = np.repeat(np.arange(len(n)), n)
    start = offsets[:-1][owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)) * step
    folded = np.concatenate([FOLD[data], np.zeros(WINDOW, np.uint16)])
    cut = folded[start[:, None] + np.arange(WINDOW)[None]]
    cut[np.arange(WINDOW)[None] >= (offsets[1:][owner] - start)[:, None]] = 0
    return cut, owner


class ByteNetwork:
    """One table (width, symbol, filter) per width, a bias, and a softmax over the pooled values."""

    def __init__(self, languages: list[str], seed: int = 3):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.p = {f"t{w}": (rng.standard_normal((w, SYMBOLS, FILTERS)) * 0.5).astype(np.float32) for w in WIDTHS}
        pooled = FILTERS * len(WIDTHS)
        self.p |= {"b": np.zeros(pooled, np.float32), "s": (rng.standard_normal((pooled, len(languages))) * 0.2).astype(np.float32), "c": np.zeros(len(languages), np.float32)}
        self.pairs: dict | None = None

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 0.01, seed: int = 5) -> "ByteNetwork":
        rng, p, k = np.random.default_rng(seed), self.p, len(self.languages)
        if k < 2:
            return self
        adam = Adam(p, rate, 1e-5)
        share = np.bincount(y, minlength=k)
        weight = (len(y) / k / np.maximum(share, 1)).astype(np.float32)
        for epoch in range(epochs):
            adam.rate = rate * (1 - epoch / epochs) + 5e-4
            order = rng.permutation(len(x))
            for at in range(0, len(order), batch):
                pick = order[at : at + batch]
                xb, yb = x[pick].astype(np.int64), y[pick]
                pooled, places = [], []
                for w in WIDTHS:
                    n = WINDOW - w + 1
                    conv = p[f"t{w}"][0][xb[:, :n]]
                    for j in range(1, w):
                        conv = conv + p[f"t{w}"][j][xb[:, j : j + n]]
                    place = conv.argmax(axis=1)
                    places.append(place)
                    pooled.append(np.take_along_axis(conv, place[:, None], axis=1)[:, 0])
                raw = np.concatenate(pooled, axis=1) + p["b"]
                act = np.tanh(raw / 4)
                logits = act @ p["s"] + p["c"]
                prob = np.exp(logits - logits.max(axis=1, keepdims=True))
                prob /= prob.sum(axis=1, keepdims=True)
                g = prob.copy()
                g[np.arange(len(yb)), yb] -= 1
                g *= weight[yb][:, None] / len(yb)
                draw = (g @ p["s"].T) * (1 - act * act) / 4
                grads = {"s": act.T @ g, "c": g.sum(axis=0), "b": draw.sum(axis=0)}
                rows, cols = np.arange(len(pick))[:, None], np.arange(FILTERS)[None]
                for i, w in enumerate(WIDTHS):
                    gt = np.zeros_like(p[f"t{w}"])
                    for j in range(w):
                        np.add.at(gt[j], (xb[rows, places[i] + j], np.broadcast_to(cols, places[i].shape)), draw[:, i * FILTERS : (i + 1) * FILTERS])
                    grads[f"t{w}"] = gt
                adam.step(grads)
        return self

    def _pair_tables(self) -> dict:
        """For each width its tables over pairs of neighbouring bytes, by filter: width 3 is a pair and one byte, width 4 two pairs."""
        out = {}
        for w in WIDTHS:
            t = self.p[f"t{w}"]
            both = [(t[j][:, None] + (t[j + 1][None] if j + 1 < w else 0)).reshape(SYMBOLS * SYMBOLS, FILTERS) if j + 1 < w else np.repeat(t[j], SYMBOLS, axis=0) for j in range(0, w, 2)]
            out[w] = [np.ascontiguousarray(b.T) for b in both]
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        if len(self.languages) < 2:
            return np.ones((len(x), len(self.languages)))
        if self.pairs is None:
            self.pairs = self._pair_tables()
        following = np.concatenate([x[:, 1:], np.zeros((len(x), 1), x.dtype)], axis=1)
        pair = x.astype(np.intp) * SYMBOLS + following
        pooled = np.empty((len(x), FILTERS * len(WIDTHS)), np.float32)
        for i, w in enumerate(WIDTHS):
            n = WINDOW - w + 1
            for f in range(FILTERS):
                conv = self.pairs[w][0][f].take(pair[:, :n])
                if w > 2:
                    conv += self.pairs[w][1][f].take(pair[:, 2 : 2 + n])
                pooled[:, i * FILTERS + f] = conv.max(axis=1)
        logits = np.tanh((pooled + self.p["b"]) / 4) @ self.p["s"] + self.p["c"]
        prob = np.exp(logits - logits.max(axis=1, keepdims=True))
        return prob / prob.sum(axis=1, keepdims=True)


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = 4000, folds: int = 4, held_out_fold: int = 2) -> ByteNetwork:
    """Fit on windows of about ``sample_docs`` documents outside the held-out fold, as many of each language that occurs there."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).alias("lang"))
    known = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (id_bucket("doc_id", folds) != held_out_fold))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                x, owner = windows(*byte_buffer(part.column("text")), WINDOW)
                ends = np.searchsorted(owner, np.arange(len(part) + 1))
                taken = [x[ends[i] + np.unique(np.linspace(0, ends[i + 1] - ends[i] - 1, SAMPLE_WINDOWS).astype(int))].tobytes() if ends[i + 1] > ends[i] else b"" for i in range(len(part))]
                yield pa.RecordBatch.from_arrays([part.column("lang"), pa.array(taken, pa.binary())], names=["lang", "cut"])

    found = sorted((r["lang"], bytes(r["cut"])) for r in stratified_sample(known, sample_docs, stratum="lang", text_col="text").mapInArrow(cut, "lang string, cut binary").toLocalIterator())
    languages = sorted({lang for lang, _ in found})
    x = [np.frombuffer(b, np.uint16).reshape(-1, WINDOW) for _, b in found]
    y = np.repeat([languages.index(lang) for lang, _ in found], [len(v) for v in x]).astype(int)
    return ByteNetwork(languages).fit(np.concatenate(x), y) if x else ByteNetwork([])


def predict(docs: DataFrame, model: ByteNetwork, *, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of every document, with ``lang_pred`` and ``score``."""
    fields = [docs.schema[k] for k in (keep or ["doc_id"])]
    text = F.col(text_col).cast("string")
    rows = docs.select(*(F.col(f.name) for f in fields), F.when(text.rlike("\\p{L}"), text).alias("_judged"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = WINDOW - max(WIDTHS) + 1
        names = np.array([*model.languages, "und"], dtype=object)
        for batch in batches:
            for part in slices(batch, "_judged", 1 << 20):
                data, offsets = byte_buffer(part.column("_judged"))
                total = np.zeros((len(part), max(1, len(model.languages))))
                for at, stop in _spans(offsets, step):
                    x, owner = windows(data[at:stop], np.clip(offsets, at, stop) - at, step)
                    if len(x) and model.languages:
                        letters = (x >= 4).sum(axis=1)
                        np.add.at(total, owner, model.probabilities(x) * letters[:, None])
                mass = total.sum(axis=1)
                best = np.where(mass > 0, total.argmax(axis=1), len(model.languages))
                value = np.where(mass > 0, total.max(axis=1) / np.where(mass > 0, mass, 1), 0.0)
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in fields), pa.array(names[best], pa.string()), pa.array(np.clip(value, 0, 1))], names=[*(f.name for f in fields), "lang_pred", "score"])

    return rows.mapInArrow(run, T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def _spans(offsets: np.ndarray, step: int, size: int = 256 << 10) -> Iterator[tuple[int, int]]:
    """Ranges of the buffer of about ``size`` bytes: whole texts, or parts of a longer text cut where a window starts."""
    at, end = 0, int(offsets[-1])
    while at < end:
        stop = min(end, at + size)
        if stop < end:
            text = int(np.searchsorted(offsets, stop, side="right")) - 1
            stop = int(offsets[text]) if offsets[text] > at else at + (stop - at) // step * step
        yield at, stop
        at = stop


def identify(docs: DataFrame, *, folds: int = 4, held_out_fold: int = 2, sample_docs: int = 4000, keep: list[str] | None = None) -> DataFrame:
    """Train outside the held-out fold, then predict all: ``keep``, ``held_out``, ``lang_pred``, ``score``."""
    model = train(docs, folds=folds, held_out_fold=held_out_fold, sample_docs=sample_docs)
    told = predict(docs, model, keep=keep or ["doc_id"])
    return told.withColumn("held_out", F.coalesce(id_bucket("doc_id", folds) == held_out_fold, F.lit(False)))
