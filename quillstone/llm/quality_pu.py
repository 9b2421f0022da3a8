"""A quality classifier from trusted positives and unlabelled text.

The non-negative unbiased risk of positive-unlabelled learning: with class prior p, the
risk of a decision function is p times the positives' loss as positives plus the
unlabelled rows' loss as negatives less p times the positives' loss as negatives. The
last two estimate the negatives' risk, which can't be negative; where a batch makes it
so, the step goes up that term instead. Labels of negatives are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.sampling import first_by_hash, fold, one_label

#: Rows of each kind that the model is fitted on; they fix its size, not what is scored.
POSITIVES = UNLABELLED = 8000
HIDDEN, EPOCHS, BATCH, RATE = 24, 40, 256, 2e-3
EXTRA = 7


def features(text: str) -> np.ndarray:
    """Shares of the byte values of the whole text, and how much its words and lines repeat."""
    raw = np.frombuffer(text.encode(), np.uint8)
    out = np.zeros(256 + EXTRA, np.float32)
    if not len(raw):
        return out
    np.sqrt(np.bincount(raw, minlength=256) / len(raw), out=out[:256], casting="unsafe")
    words, lines = text.split(), text.split("\n")
    n = max(1, len(words))
    out[256:] = (
        sum(map(eq, words, islice(words, 1, None))) / n,
        len(set(words)) / n,
        1 - len(set(lines)) / len(lines),
        np.log1p(len(raw)),
        min(len(raw) / n, 100.0),
        np.log1p(len(raw) / len(lines)),
        1.0,
    )
    return out


@dataclass
class Net:
    """One hidden layer on standardised features; scores are logistic."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -5, 5)

    def margin(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(self.standard(x) @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _fit(x: np.ndarray, batches: int, draw, slope, seed: int) -> Net:
    """Adam on batches; draw(rng) gives row numbers, slope(margins) the risk's derivative by each margin."""
    rng = np.random.default_rng(seed)
    scale = x.std(0) + 1e-3
    net = Net(x.mean(0), scale, rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), 0.0)
    z = net.standard(x)
    params = [net.w1, net.b1, net.w2, np.zeros(1)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, batches + 1):
        rows = draw(rng)
        zb = z[rows]
        h = np.maximum(zb @ params[0] + params[1], 0)
        d = slope(h @ params[2] + params[3][0])
        dh = np.outer(d, params[2]) * (h > 0)
        grads = [zb.T @ dh + 1e-4 * params[0], dh.sum(0), h.T @ d, np.array([d.sum()])]
        for p, g, m, v in zip(params, grads, first, second):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Net(net.mean, net.scale, params[0], params[1], params[2], float(params[3][0]))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def class_prior(x: np.ndarray, positives: int, seed: int = 0) -> float:
    """The share of positives among the unlabelled rows, which follow the positives in x.

    A classifier of positives against unlabelled rows is fitted on even rows; on odd rows,
    the share of unlabelled over the share of positives above a threshold can't be less
    than the prior, so that the least such ratio, with a margin for chance, estimates it.
    """
    n = len(x)
    even = np.arange(0, n, 2)
    p, u = even[even < positives], even[even >= positives]
    half = BATCH // 2

    def slope(f: np.ndarray) -> np.ndarray:
        return np.concatenate([_sigmoid(f[:half]) - 1, _sigmoid(f[half:])]) / half

    net = _fit(x, max(200, EPOCHS * len(even) // BATCH), lambda r: np.concatenate([r.choice(p, half), r.choice(u, half)]), slope, seed)
    f = net.margin(x)
    odd = np.arange(1, n, 2)
    fp, fu = np.sort(f[odd[odd < positives]]), np.sort(f[odd[odd >= positives]])
    at = np.quantile(fp, np.linspace(0, 0.95, 96))
    above_p, above_u = 1 - np.searchsorted(fp, at) / len(fp), 1 - np.searchsorted(fu, at) / len(fu)
    margin = np.sqrt(np.log(40) / 2) * (1 / np.sqrt(len(fp)) + 1 / np.sqrt(len(fu)))
    best = np.argmin((above_u + margin) / above_p)
    return float(np.clip(above_u[best] / above_p[best], 0.05, 0.99))


def fit_nnpu(x: np.ndarray, positives: int, prior: float, seed: int = 1) -> Net:
    """A net that minimises the non-negative risk with sigmoid losses; positives come first in x."""
    n, half = len(x), BATCH // 2

    def slope(f: np.ndarray) -> np.ndarray:
        s = _sigmoid(f)
        steep = s * (1 - s)
        fp, fu = slice(0, half), slice(half, None)
        # loss as positive: 1 - s; as negative: s
        negative = s[fu].mean() - prior * s[fp].mean()
        as_negative = np.concatenate([-prior * steep[fp], steep[fu]]) / half
        if negative < 0:
            return -as_negative
        as_positive = np.concatenate([-prior * steep[fp], np.zeros(half)]) / half
        return as_positive + as_negative

    def draw(r: np.random.Generator) -> np.ndarray:
        return np.concatenate([r.integers(0, positives, half), r.integers(positives, n, half)])

    return _fit(x, max(300, EPOCHS * n // BATCH), draw, slope, seed)


def train(docs: DataFrame, positives: DataFrame, allowed, text: str = "text", doc_id: str = "doc_id", n_positive: int = POSITIVES, n_unlabelled: int = UNLABELLED) -> tuple[Net | None, float]:
    """A net and the class prior; positives holds the doc_id of trusted rows, allowed tells which rows may be used.

    Rows are drawn by a hash of their doc_id, up to the stated numbers; those with a null
    doc_id aren't used, and of rows that repeat one the least text counts. What comes to
    the driver is a fixed number of features for each, however long the texts. With too
    few rows, or in an empty table, there is no net and the prior is the share of positives.
    """
    known = docs.filter(F.col(doc_id).isNotNull() & allowed).select(F.col(doc_id).alias("doc_id"))
    trusted = first_by_hash(positives.select("doc_id").distinct(), "doc_id", n_positive).withColumn("trusted", F.lit(1))
    others = first_by_hash(known.distinct(), "doc_id", n_unlabelled).withColumn("trusted", F.lit(0))
    # At most n_positive + n_unlabelled ids.
    drawn = F.broadcast(trusted.unionByName(others))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(drawn, "doc_id")
    rows = rows.groupBy("doc_id", "trusted").agg(F.min("text").alias("text"))

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("trusted"), b.column("doc_id").cast(pa.string()), pa.array(x, pa.binary())], names=["trusted", "ident", "x"])

    table = rows.select("doc_id", "text", "trusted").mapInArrow(described, "trusted int, ident string, x binary").toArrow().sort_by([("trusted", "descending"), ("ident", "ascending"), ("x", "ascending")])
    n = sum(table.column("trusted").to_pylist())
    if n < 4 or len(table) - n < 4:
        return None, n / max(1, len(table))
    x = np.frombuffer(b"".join(table.column("x").to_pylist()), np.float32).reshape(len(table), -1).astype(np.float64)
    prior = class_prior(x, n)
    return fit_nnpu(x, n, prior), prior


SCORED = "doc_id long, score double, predicted int"


def score_quality(docs: DataFrame, net: Net | None, prior: float, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, score and predicted for every row; null texts count as empty, and an empty text scores as any other.

    Without enough rows to fit, every score is the share of positives. Rows are scored one
    by one: null and repeated doc_ids pass through, other columns are ignored.
    """

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            s = net.score(np.array([features(t) for t in texts])) if net is not None and texts else np.full(len(texts), prior)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32), pa.int32())], names=["doc_id", "score", "predicted"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(scored, SCORED)


def quality(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, text: str = "text", doc_id: str = "doc_id", label: str = "quality") -> DataFrame:
    """doc_id, held_out, score, predicted for every row, learnt from positive labels outside the held-out fold.

    Nulls, repeated rows, long texts, empty tables and other columns are handled as train
    and score_quality say.
    """
    positives = one_label(labels, label).filter((F.col("label") == 1) & (fold(F.col("doc_id"), folds) != held))
    net, prior = train(docs, positives, fold(F.col(doc_id), folds) != held, text, doc_id)
    return score_quality(docs, net, prior, text, doc_id).withColumn("held_out", fold(F.col("doc_id"), folds) == held)
