"""Toxicity by a classifier chain of linear models.

The chain predicts its categories one after the other: low quality, toxic, and toxic in good prose (the categories that
the two labels, quality and toxic, make).  Each link is a logistic regression on hashed features of the whole text (words,
and the first characters of words), each scaled by the log ratio of its frequencies in the two classes, and on the
probabilities of the earlier links.  While training, those probabilities are out-of-fold predictions (``FOLDS`` folds by a
hash of the document), so later links learn from what earlier ones would say about unseen text.

The models are fitted on the driver, on at most about ``SAMPLE`` labelled documents picked by a hash of their doc_id;
what the driver gets of each is its whole feature set, at most ``DIMENSIONS`` numbers.

Defined cases: null and empty texts have no features and score what the intercepts give; labels that are null count as
unlabelled for their category; documents with several labels teach each of them; without labels, or with one class
only, a category's probability is its base rate (0 without labels); a null doc_id keeps its row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHash, map_batches

CHAIN = ("low_quality", "toxic", "toxic_prose")
SCALE, LEAST_DOCS, PRIOR = -0.25, 2, 0.5
DIMENSIONS, SAMPLE, FOLDS, PREFIX = 1 << 18, 6_000, 4, 5
_CUT = str.maketrans({c: " " for c in ".,;:!?\"'()[]{}<>*#%&$|/\\-_=+~^`@"})


def features(text: str | None, known: WordHash) -> np.ndarray:
    """Distinct feature numbers of a text: its words, and the first PREFIX characters of its longer words."""
    words = set((text or "").lower().translate(_CUT).split())
    words |= {f"{w[:PREFIX]}~" for w in words if len(w) > PREFIX}
    return np.unique(known.of(list(words)) % np.uint64(DIMENSIONS)).astype(np.int32)


@dataclass
class Chain:
    """Weights of each link: of the features, of the earlier probabilities, and the intercept."""

    words: np.ndarray
    earlier: np.ndarray
    bias: np.ndarray

    def predict(self, rows: list[np.ndarray]) -> np.ndarray:
        sizes = np.array([len(r) for r in rows])
        flat = np.concatenate([*rows, np.zeros(0, np.int32)])
        owner = np.repeat(np.arange(len(rows)), sizes)
        scale = np.maximum(sizes, 1) ** SCALE
        out = np.zeros((len(rows), len(CHAIN)))
        for k in range(len(CHAIN)):
            z = np.bincount(owner, self.words[k][flat], len(rows)) * scale + self.bias[k] + out[:, :k] @ self.earlier[k, :k]
            out[:, k] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return out


def fit_link(rows: list[np.ndarray], early: np.ndarray, y: np.ndarray, epochs: int = 40, l2: float = 1e-3) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights of the features and of the earlier probabilities, and the intercept: logistic regression by full-batch
    Adam steps on features scaled by their classes' log ratio.  Deterministic."""
    rate = y.mean() if len(y) else 0.0
    if rate in (0.0, 1.0):
        return np.zeros(DIMENSIONS), np.zeros(early.shape[1]), float(np.log((rate + 1e-9) / (1 - rate + 1e-9)))
    sizes = np.array([len(r) for r in rows])
    flat, owner = np.concatenate(rows), np.repeat(np.arange(len(rows)), sizes)
    docs = np.bincount(flat, minlength=DIMENSIONS)
    yes = np.bincount(flat[y[owner] > 0], minlength=DIMENSIONS)
    ratio = np.log((yes + PRIOR) / (y.sum() + 2 * PRIOR)) - np.log((docs - yes + PRIOR) / (len(y) - y.sum() + 2 * PRIOR))
    ratio[docs < LEAST_DOCS] = 0
    held = docs[flat] >= LEAST_DOCS
    flat, owner = flat[held], owner[held]
    used = np.flatnonzero(docs >= LEAST_DOCS)  # the steps work on these only
    x = ratio[flat] * (np.maximum(sizes, 1) ** SCALE)[owner]
    flat = np.searchsorted(used, flat)
    weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    theta = [np.zeros(len(used)), np.zeros(early.shape[1]), np.zeros(1)]
    m, v = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    for t in range(1, epochs + 1):
        z = np.bincount(owner, x * theta[0][flat], len(rows)) + early @ theta[1] + theta[2][0]
        g = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        grads = [np.bincount(flat, g[owner] * x, len(used)) + l2 * theta[0], early.T @ g + l2 * theta[1], np.array([g.sum()])]
        for p, gp, mp, vp in zip(theta, grads, m, v, strict=True):
            mp += 0.1 * (gp - mp)
            vp += 0.001 * (gp * gp - vp)
            p -= 0.1 * (mp / (1 - 0.9**t)) / (np.sqrt(vp / (1 - 0.999**t)) + 1e-8)
    words = np.zeros(DIMENSIONS)
    words[used] = theta[0] * ratio[used]
    return words, theta[1], float(theta[2][0])


def fit(rows: list[np.ndarray], labels: np.ndarray, fold: np.ndarray) -> Chain:
    """A chain from feature sets, labels [row, category] (NaN: unlabelled) and the fold of each row."""
    early = np.zeros((len(rows), 0))
    words, earlier, bias = np.zeros((len(CHAIN), DIMENSIONS), np.float32), np.zeros((len(CHAIN), len(CHAIN))), np.zeros(len(CHAIN))
    for k in range(len(CHAIN)):
        y = labels[:, k]
        have = ~np.isnan(y)

        def on(mask: np.ndarray, k=k, y=y, early=early) -> tuple[np.ndarray, np.ndarray, float]:
            at = np.flatnonzero(mask)
            return fit_link([rows[i] for i in at], early[at], y[at])

        w, e, b = on(have)
        words[k], earlier[k, :k], bias[k] = w, e, b
        out = np.zeros(len(rows))
        for f in range(FOLDS):
            wf, ef, bf = on(have & (fold != f))
            for i in np.flatnonzero(fold == f):
                z = wf[rows[i]].sum() * max(1, len(rows[i])) ** SCALE + early[i] @ ef + bf
                out[i] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        early = np.column_stack([early, out])
    return Chain(words, earlier, bias)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Chain:
    marks = labels.where("doc_id IS NOT NULL").select("doc_id", F.col("quality").cast("int").alias("_q"), F.col("toxic").cast("int").alias("_t"))
    n = max(1, -(-marks.count() // sample))
    marks = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(n)) == 0)
    picked = docs.select("doc_id", "text").join(marks, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHash()
        for b in batches:
            rows = []
            for t in b.column("text"):
                rows.append(features(t.as_py(), known))
            offsets = np.cumsum([0, *map(len, rows)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("_q"), b.column("_t"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*rows, np.zeros(0, np.int32)])))], ["doc_id", "q", "t", "f"])

    got = map_batches(picked, run, "doc_id long, q int, t int, f array<int>").toArrow()
    order = np.lexsort([got["t"].to_numpy(), got["q"].to_numpy(), got["doc_id"].to_numpy()])
    ids = got["doc_id"].to_numpy()[order]
    lists = got["f"].combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    values, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
    rows = [values[offsets[i] : offsets[i + 1]] for i in order]
    q, t = (got[c].to_pandas().to_numpy(np.float64)[order] for c in ("q", "t"))
    fold = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % FOLDS
    return fit(rows, np.column_stack([1 - q, t, t * q]), fold)


def predict(docs: DataFrame, chain: Chain) -> DataFrame:
    """doc_id, p_<category> for each category, and toxic (p_toxic of at least a half)."""
    sent = docs.sparkSession.sparkContext.broadcast(chain)
    names = ["doc_id", *(f"p_{c}" for c in CHAIN), "toxic"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHash()
        for b in batches:
            p = sent.value.predict([features(t.as_py(), known) for t in b.column("text")])
            toxic = p[:, CHAIN.index("toxic")] >= 0.5
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(np.ascontiguousarray(p[:, k])) for k in range(len(CHAIN))), pa.array(toxic)], names)

    return map_batches(docs.select("doc_id", "text"), run, ", ".join(["doc_id long", *(f"p_{c} double" for c in CHAIN), "toxic boolean"]))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return predict(docs, train(docs, labels))
