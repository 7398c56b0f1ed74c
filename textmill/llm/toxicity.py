"""Toxicity by a classifier chain.

Categories are predicted one after another.  Each has a logistic model on which
words and beginnings of words a text holds and on the probabilities of the categories before it; in
training these are out-of-fold predictions, so a later model learns from what an
earlier one says of texts that it has not seen.  Models are fitted with an L1
penalty by accelerated proximal gradient steps, on words chosen within the
training rows alone.

Categories come as columns of labels, in any language and number.  Where there is one
label only, its own rows are clustered by the words that go with it, and the clusters
are the categories (``KINDS``); no list of words is built in.  The last link of the
chain is the label itself, and gives the verdict.

Defined results: null and empty texts hold no words, and get the probability of
such a text; repeated rows each give a row; without labels of both kinds all
probabilities are the share of the label (0 without labels); an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.llm._common import fresh, give_back, slices, text_of
from textmill.llm._sample import labelled_texts

#: Labelled rows used for fitting, at most.
SAMPLE = 6000
#: Words in each model, at most.
WORDS = 160
#: Categories that are made where there is one label only.
KINDS = 2
_TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


#: Longer words also count by their beginnings of so many bytes, for forms of a word that no labelled row has.
STEMS = (4, 5, 6)


def word_set(text: bytes) -> set[bytes]:
    """The distinct words of a text and, with a star, their beginnings."""
    words = set(text.translate(_TO_WORDS).split())
    return words.union(*({w[:n] + b"*" for w in words if len(w) > n} for n in STEMS))


@dataclass
class Link:
    """One model of the chain: bias, weight of each word, weights of earlier probabilities."""

    name: str
    bias: float
    words: dict[bytes, float]
    earlier: list[float]

    def predict(self, sets: list[set[bytes]], earlier: np.ndarray) -> np.ndarray:
        keys = self.words.keys()
        z = np.array([sum(map(self.words.__getitem__, s & keys)) for s in sets], np.float64).reshape(len(sets)) + self.bias
        if self.earlier:
            z = z + earlier[:, : len(self.earlier)] @ np.array(self.earlier)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _lasso(x: np.ndarray, y: np.ndarray, free: int, penalty: float, steps: int) -> tuple[np.ndarray, float]:
    """Logistic weights and bias by accelerated proximal gradients; the last ``free`` columns have no penalty."""
    n, d = x.shape
    # Largest curvature, by a few power steps.
    v = np.ones(d + 1) / np.sqrt(d + 1)
    for _ in range(12):
        u = x @ v[:-1] + v[-1]
        w = np.append(x.T @ u, u.sum())
        v = w / max(np.linalg.norm(w), 1e-12)
    size = 4 * n / max(float(np.linalg.norm(w)), 1e-9)
    shrink = np.full(d + 1, penalty * size)
    shrink[d - free :] = 0
    now = at = np.append(np.zeros(d), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    t = 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ at[:-1] + at[-1], -40, 40)))
        g = np.append(x.T @ (p - y), (p - y).sum()) / n
        new = at - size * g
        new = np.sign(new) * np.maximum(np.abs(new) - shrink, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        at = new + (t - 1) / t2 * (new - now)
        now, t = new, t2
    return now[:-1], float(now[-1])


class _Held:
    """Which features each training text holds, as flat arrays: features of fewer than ``least`` texts are left out.

    Most features are rare, so their strings are kept only where a table of
    counts by hash says that they may be common enough.
    """

    def __init__(self, texts: list[bytes], least: int = 5, slots: int = 1 << 22):
        self.n = len(texts)
        seen = np.zeros(slots, np.int32)
        for t in texts:
            np.add.at(seen, np.fromiter(map(hash, word_set(t)), np.int64) & (slots - 1), 1)
        often = seen >= least
        index: dict[bytes, int] = {}
        own = []
        for t in texts:
            own.append(np.array([index.setdefault(w, len(index)) for w in word_set(t) if often[hash(w) & (slots - 1)]], np.int32))
        df, words = np.zeros(len(index), np.int64), list(index)
        for x in own:
            df[x] += 1
        # Ids in order of the words, whatever order the sets gave them in.
        order = sorted((i for i in range(len(words)) if df[i] >= least), key=words.__getitem__)
        place = np.full(len(words), -1, np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        own = [np.sort(y[y >= 0]) for y in (place[x] for x in own)]
        self.words = [words[i] for i in order]
        self.row = np.repeat(np.arange(self.n, dtype=np.int32), [len(x) for x in own])
        self.col = np.concatenate([*own, np.empty(0, np.int32)])

    def predict(self, link: Link, earlier: np.ndarray) -> np.ndarray:
        """Probabilities of a link for all training texts."""
        weight = np.array([link.words.get(w, 0.0) for w in self.words])
        z = np.bincount(self.row, weight[self.col] if len(self.col) else None, self.n) + link.bias
        if link.earlier:
            z = z + earlier[:, : len(link.earlier)] @ np.array(link.earlier)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def chi_squared(row: np.ndarray, col: np.ndarray, y: np.ndarray, n: int, n_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chi-squared of each feature with a label (-1 if no text has it), and how many labelled texts have it: expected, found."""
    df, pos, ones = np.bincount(col, minlength=n_words), np.bincount(col, y[row], n_words), y.sum()
    expected = df * ones / n
    return np.where(df > 0, (pos - expected) ** 2 / np.maximum(expected * (1 - df / n) * (1 - ones / n), 1e-9), -1), expected, pos


def _fit_link(name: str, held: _Held, rows: np.ndarray, labels: np.ndarray, earlier: np.ndarray, most_words: int, penalty: float, steps: int) -> Link:
    n, y = len(rows), labels[rows]
    if not n or y.min() == y.max():
        share = float(y.mean()) if n else 0.0
        return Link(name, float(np.log((share + 1e-9) / (1 - share + 1e-9))), {}, [0.0] * earlier.shape[1])
    place = np.full(held.n, -1, np.int32)
    place[rows] = np.arange(n, dtype=np.int32)
    mine = place[held.row] >= 0
    row, col = place[held.row[mine]], held.col[mine]
    score, _, _ = chi_squared(row, col, y, n, len(held.words))
    chosen = np.argsort(-score, kind="stable")[:most_words]
    # Of features that the same texts hold, such as a word and its beginnings, the longest stands for all.
    best: dict[float, int] = {}
    sign = np.bincount(col, np.random.default_rng(0).random(n)[row], len(held.words))
    for i in chosen.tolist():
        k = best.setdefault(float(sign[i]), i)
        if len(held.words[i]) > len(held.words[k]):
            best[float(sign[i])] = i
    chosen = np.array(list(best.values()), np.int64)
    at = np.full(len(held.words), -1)
    at[chosen] = np.arange(len(chosen))
    x = np.zeros((n, len(chosen) + earlier.shape[1]), np.float32)
    used = at[col] >= 0
    x[row[used], at[col[used]]] = 1
    x[:, len(chosen) :] = earlier[rows]
    weights, bias = _lasso(x, y, earlier.shape[1], penalty, steps)
    return Link(name, bias, {held.words[i]: float(v) for i, v in zip(chosen.tolist(), weights[: len(chosen)], strict=True) if v}, weights[len(chosen) :].tolist())


def fit_chain(texts: list[bytes] | _Held, labels: pd.DataFrame, *, folds: int = 5, most_words: int = WORDS, penalty: float | None = None, steps: int = 500, seed: int = 3) -> list[Link]:
    """A link for each column of ``labels``, in their order; the penalty is half a row's share of them unless given."""
    held = texts if isinstance(texts, _Held) else _Held(texts)
    n, k = held.n, labels.shape[1]
    penalty = 0.5 / max(n, 1) if penalty is None else penalty
    fold, every = np.random.default_rng(seed).permutation(n) % folds, np.arange(n)
    out_of_fold = np.zeros((n, k), np.float64)
    links = []
    for j, name in enumerate(labels.columns):
        y, before = labels[name].to_numpy(np.float64), out_of_fold[:, :j]
        if j + 1 < k:  # the last one's own predictions feed nothing
            for f in range(folds):
                own = np.flatnonzero(fold == f)
                part = _fit_link(name, held, np.flatnonzero(fold != f), y, before, most_words, penalty, steps)
                out_of_fold[own, j] = held.predict(part, before)[own]
        links.append(_fit_link(name, held, every, y, before, most_words, penalty, steps))
    return links


def predict_chain(links: list[Link], texts: list[bytes]) -> np.ndarray:
    """Probabilities, a column for each link."""
    sets = [word_set(t) for t in texts]
    out = np.zeros((len(texts), len(links)))
    for j, link in enumerate(links):
        out[:, j] = link.predict(sets, out)
    return out


def kinds_of_toxic(held: _Held, toxic: np.ndarray, kinds: int = KINDS, *, most_words: int = WORDS, rounds: int = 20) -> np.ndarray:
    """A category for each toxic text, -1 for the others: clusters by the features that go with the label.

    The features are the ``most_words`` with the highest chi-squared among those that are
    commoner in toxic texts.  A text is the unit vector of those that it holds; centres
    start far apart, from the text least like all others, and move to the mean direction
    of their texts.  Categories are numbered from the largest; texts without any of the
    features belong to it.
    """
    y = np.asarray(toxic, bool)
    out, rows = np.full(held.n, -1), np.flatnonzero(y)
    if not len(rows):
        return out
    out[rows] = 0
    score, expected, pos = chi_squared(held.row, held.col, y.astype(float), held.n, len(held.words))
    chosen = np.argsort(np.where(pos > expected, -score, 0), kind="stable")[:most_words]
    at = np.full(len(held.words), -1)
    at[chosen] = np.arange(len(chosen))
    used = (at[held.col] >= 0) & y[held.row]
    x = np.zeros((held.n, len(chosen)))
    x[held.row[used], at[held.col[used]]] = 1
    rows = rows[x[rows].any(1)]
    x = x[rows]
    if len(rows) < kinds:
        return out
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centres = [x[int(np.argmin(x @ x.mean(0)))]]
    while len(centres) < kinds:
        centres.append(x[int(np.argmin((x @ np.array(centres).T).max(1)))])
    for _ in range(rounds):
        own = np.argmax(np.round(x @ np.array(centres).T, 12), 1)
        centres = [m / max(np.linalg.norm(m), 1e-12) for m in (x[own == k].sum(0) for k in range(kinds))]
    rank = np.empty(kinds, int)
    rank[np.argsort(-np.bincount(own, minlength=kinds), kind="stable")] = np.arange(kinds)
    out[rows] = rank[own]
    return out


def category_labels(held: _Held, toxic: np.ndarray, kinds: int = KINDS) -> pd.DataFrame:
    """A column for each category of toxic texts and last ``toxic`` itself."""
    kind = kinds_of_toxic(held, toxic, kinds)
    return pd.DataFrame({f"kind{k + 1}": (kind == k).astype(int) for k in range(kinds)} | {"toxic": np.asarray(toxic, int)}, index=range(held.n))


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", sample: int = SAMPLE, among: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> list[Link]:
    """Fit the chain on at most ``sample`` labelled rows."""
    rows = labelled_texts(docs, labels, label, sample, among=among, id_col=id_col, text_col=text_col)
    texts, toxic = [t.encode("utf-8") for t in rows["text"]], rows["label"].to_numpy() > 0
    # The driver holds the texts once, and not at all while it fits.
    del rows
    held = _Held(texts)
    del texts
    links = fit_chain(held, category_labels(held, toxic))
    del held
    give_back()
    return links


def probabilities(links: list[Link]) -> Callable[[str], Column]:
    """A UDF from a text to a struct with the probability of each category."""
    names = [f"p_{x.name}" for x in links]

    @F.arrow_udf(", ".join(f"{n} double" for n in names))
    def score(texts: pa.Array) -> pa.Array:
        parts = [predict_chain(links, part) for _, part in slices(texts)]
        p = np.concatenate(parts) if parts else np.zeros((0, len(links)))
        return pa.StructArray.from_arrays([pa.array(p[:, j]) for j in range(len(links))], names=names)

    return score


def score_toxicity(docs: DataFrame, links: list[Link], *, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, a probability for each category, toxic for every row; no shuffle."""
    own = text_of(docs, id_col, text_col).select("doc_id", probabilities(links)("text").alias("p")).select("doc_id", "p.*")
    return own.withColumn("toxic", F.col(f"p_{links[-1].name}") >= threshold)


def drop_toxic(docs: DataFrame, links: list[Link], *, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows that are not toxic, with their own columns."""
    p = probabilities(links)(F.col(f"`{text_col}`").cast("string"))
    own = fresh(docs, "__p")
    return docs.withColumn(own, p).where(F.col(own)[f"p_{links[-1].name}"] < threshold).drop(own)
