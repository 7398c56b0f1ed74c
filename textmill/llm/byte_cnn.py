"""Text quality by a byte-level convolutional network in numpy.

Learned filters ``WIDTH`` bytes wide slide over the UTF-8 bytes of the whole text.
Blocks of ``HALF`` places are max-pooled, and two neighbouring blocks make a chunk,
so chunks overlap by half and cover the text to its last byte.  A document is the
mean and the maximum over its chunks of ``tanh`` of the pooled values, and a
logistic layer turns these into one probability.

A filter over bytes is a sum of table entries, one per place; for scoring, two
neighbouring tables are merged into one over pairs of bytes.

Defined results: null and empty texts are scored as spaces; repeated rows each
give a row; without labels of both kinds every score is the share of label 1 (0.5
without labels); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.llm._common import give_back, slices, text_of
from textmill.llm._sample import labelled_texts

#: Labelled rows used for fitting, at most.
SAMPLE = 4000
FILTERS, WIDTH, HALF = 24, 6, 128
_AT_ONCE = 64


def _layout(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts one after another, where each block starts, and blocks per text.

    A text is filled with spaces up to one block; the last block ends with it.
    """
    need = HALF + WIDTH - 1
    flat, starts, counts, at = [], [], [], 0
    for t in texts:
        t = t.ljust(need, b" ")
        places = len(t) - WIDTH + 1
        n = -(-places // HALF)
        own = at + HALF * np.arange(n)
        own[-1] = at + places - HALF
        flat.append(t)
        starts.append(own)
        counts.append(n)
        at += len(t)
    return np.frombuffer(b"".join(flat), np.uint8), np.concatenate(starts), np.array(counts)


@dataclass
class ByteCNN:
    tables: np.ndarray  # WIDTH x 256 x FILTERS
    bias: np.ndarray  # FILTERS
    out: np.ndarray  # 2 * FILTERS
    out_bias: float

    def merged(self) -> np.ndarray:
        if not hasattr(self, "_pairs"):
            t = self.tables
            self._pairs = np.stack([(t[j][:, None, :] + t[j + 1][None, :, :]).reshape(65536, -1) for j in range(0, WIDTH, 2)]).astype(np.float32)
        return self._pairs

    def pooled(self, flat: np.ndarray, starts: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Maximum of each filter in each block, and where it is."""
        pairs, step = flat[:-1].astype(np.int32) << 8 | flat[1:], np.arange(HALF)
        tables = self.merged()
        most = np.empty((len(starts), self.tables.shape[2]), np.float32)
        where = np.empty(most.shape, np.int64) if places else None
        for at in range(0, len(starts), _AT_ONCE):
            own = starts[at : at + _AT_ONCE, None] + step
            s = tables[0][pairs[own]]
            for j in range(1, WIDTH // 2):
                s += tables[j][pairs[own + 2 * j]]
            if places:
                best = s.argmax(1)
                where[at : at + _AT_ONCE] = best + starts[at : at + _AT_ONCE, None]
                most[at : at + _AT_ONCE] = np.take_along_axis(s, best[:, None, :], 1)[:, 0]
            else:
                s.max(1, out=most[at : at + _AT_ONCE])
        return most + self.bias, where

    @staticmethod
    def _chunks(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and second block of each chunk, and the first chunk of each text."""
        n = np.maximum(counts - 1, 1)
        first = np.repeat(np.cumsum(counts) - counts - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return first, np.where(np.repeat(counts, n) > 1, first + 1, first), np.cumsum(n) - n

    def _document(self, most: np.ndarray, counts: np.ndarray) -> tuple:
        a, b, begin = self._chunks(counts)
        g = np.tanh(np.maximum(most[a], most[b]))
        n = np.diff(np.append(begin, len(g)))
        mean, top = np.add.reduceat(g, begin) / n[:, None], np.maximum.reduceat(g, begin)
        return a, b, begin, n, g, np.concatenate([mean, top], 1)

    def gradients(self, texts: list[bytes], y: np.ndarray, decay: float = 1e-4) -> tuple[dict[str, np.ndarray], float]:
        """Of the mean log loss and half ``decay`` times the squared output weights: by parameter, and by the output's bias."""
        flat, starts, counts = _layout(texts)
        most, where = self.pooled(flat, starts, places=True)
        a, b, begin, n, g, doc = self._document(most, counts)
        p = 1 / (1 + np.exp(-np.clip(doc @ self.out + self.out_bias, -30, 30)))
        dz = ((p - y) / len(texts)).astype(np.float32)
        grads = {"out": doc.T @ dz + decay * self.out}
        d_doc = dz[:, None] * self.out
        text_of_chunk = np.repeat(np.arange(len(texts)), n)
        dg = d_doc[text_of_chunk, :FILTERS] / n[text_of_chunk, None]
        # The first chunk with the maximum gets its gradient.
        top = doc[text_of_chunk, FILTERS:] == g
        seen = np.cumsum(top, 0)
        prior = np.concatenate([np.zeros((1, FILTERS), seen.dtype), seen])[begin][text_of_chunk]
        dg = dg + d_doc[text_of_chunk, FILTERS:] * (top & (seen - prior == 1))
        ds = dg * (1 - g * g)
        src = np.where(most[a] >= most[b], where[a], where[b])
        grads["bias"] = ds.sum(0)
        gt = np.zeros((WIDTH, 256 * FILTERS), np.float32)
        col = np.arange(FILTERS)
        for j in range(WIDTH):
            gt[j] = np.bincount((flat[src + j].astype(np.int64) * FILTERS + col).ravel(), ds.ravel(), 256 * FILTERS)
        grads["tables"] = gt.reshape(WIDTH, 256, FILTERS)
        return grads, float(dz.sum())

    def score(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        flat, starts, counts = _layout(texts)
        most, _ = self.pooled(flat, starts)
        z = self._document(most, counts)[-1] @ self.out + self.out_bias
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))


def fit(texts: list[bytes], y: np.ndarray, *, epochs: int = 14, batch: int = 32, rate: float = 0.02, seed: int = 11) -> ByteCNN:
    """Train by Adam; gradients reach only the bytes at each chunk's maximum."""
    rng = np.random.default_rng(seed)
    share = float(np.mean(y)) if len(y) else 0.5
    net = ByteCNN(rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), np.zeros(2 * FILTERS, np.float32), float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    net.bias -= 1.0
    if not len(y) or y.min() == y.max():
        return net
    net.out = rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32)
    params = {"tables": net.tables, "bias": net.bias, "out": net.out}
    m, v = ({k: np.zeros_like(x) for k, x in params.items()} for _ in range(2))
    mb = vb = 0.0
    t = 0
    # Texts of like length go together, in a new order each time.
    total = epochs * -(-len(texts) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            t += 1
            net.__dict__.pop("_pairs", None)
            grads, gb = net.gradients([texts[i] for i in own], y[own])
            lr = rate * (0.1 + 0.9 * (1 - t / total))
            for k, x in params.items():
                m[k] += 0.1 * (grads[k] - m[k])
                v[k] += 0.01 * (grads[k] ** 2 - v[k])
                x -= (lr * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-6)).astype(np.float32)
            mb, vb = mb + 0.1 * (gb - mb), vb + 0.01 * (gb**2 - vb)
            net.out_bias -= lr * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-6)
    net.__dict__.pop("_pairs", None)
    return net


def fit_quality(docs: DataFrame, labels: DataFrame, *, label: str = "quality", sample: int = SAMPLE, among: Column | None = None, id_col: str = "doc_id", text_col: str = "text", **how) -> ByteCNN:
    """Fit on at most ``sample`` labelled rows."""
    rows = labelled_texts(docs, labels, label, sample, among=among, id_col=id_col, text_col=text_col)
    texts, y = [t.encode("utf-8") for t in rows["text"]], rows["label"].to_numpy(np.float32)
    del rows
    net = fit(texts, y, **how)
    del texts
    give_back()
    return net


def score_quality(docs: DataFrame, net: ByteCNN, *, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted for every row; no shuffle."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        parts = [net.score(part) for _, part in slices(texts, 1 << 18)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    own = text_of(docs, id_col, text_col).select("doc_id", score("text").alias("score"))
    return own.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
