"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text. What the
trainer gets of either is drawn in contrast: of toxic texts the words with pieces that
ordinary text rarely has, of ordinary texts words of like endings, in as many copies as
the texts have them. Both follow the same part of common words. Each window of a text is
compressed with both; where the toxic dictionary saves bytes, the window says something
that toxic texts say. Thresholds on the savings are calibrated on other labelled rows.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from math import log

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.sampling import first_by_hash, fold, one_label

#: Labelled rows that the dictionaries and the thresholds are fitted on at most, and bytes of all their texts.
TOXIC, ORDINARY, CALIBRATION = 3000, 5000, 5000
FIT_BYTES = 48 << 20
WINDOW, STRIDE = 60, 44
#: Words of the shared part, and bytes of a trained part at most.
SHARED_WORDS, OWN_BYTES = 20_000, 48_000
#: Pieces of toxic words: their lengths, how often toxic texts must have them (at least, and for each text), and the log ratio of rates.
PIECES, PIECE_LEAST, PIECE_RATE, PIECE_ODDS = (5, 6, 7), 5, 0.02, 3.0
WORD = re.compile(rb"[^\x00-@\[-`{-\x7f]+")
LEVELS = (2, 3, 4, 5, 6)
PARAMETERS = {"window_log": 20, "chain_log": 18, "hash_log": 18, "search_log": 5, "min_match": 6, "target_length": 16, "strategy": zstandard.STRATEGY_GREEDY}


def plain(text: str) -> bytes:
    return text.lower().encode()


def _word_counts(texts: list[str]) -> Counter:
    """In how many of the distinct texts each word occurs."""
    counts: Counter = Counter()
    for t in dict.fromkeys(texts):
        counts.update(set(WORD.findall(plain(t))))
    return counts


def _pieces(word: bytes) -> set[bytes]:
    w = b" " + word + b" "
    return {w[i : i + n] for n in PIECES for i in range(len(w) - n + 1)}


def _trained(samples: list[bytes]) -> bytes:
    """What the trainer makes of the samples; samples that are too few or too short to train on stand for themselves."""
    try:
        return zstandard.train_dictionary(OWN_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[-OWN_BYTES:]


def _samples(texts: list[str], words: set[bytes]) -> list[bytes]:
    """Every occurrence of the words in the distinct texts, with a blank on either side."""
    return [b" " + w + b" " for t in dict.fromkeys(texts) for w in WORD.findall(plain(t)) if w in words]


def dictionaries(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes]:
    """The contents of the ordinary and of the toxic dictionary, equally long."""
    a, b = _word_counts(toxic), _word_counts(ordinary)
    na, nb = len(dict.fromkeys(toxic)) + 1, len(dict.fromkeys(ordinary)) + 1
    in_toxic, in_ordinary = Counter(), Counter()
    for counts, pieces in ((a, in_toxic), (b, in_ordinary)):
        for word, n in counts.items():
            for p in _pieces(word):
                pieces[p] += n
    least = max(PIECE_LEAST, PIECE_RATE * na)
    hot = {p for p, n in in_toxic.items() if n >= least and log((n + 0.5) / na) - log((in_ordinary[p] + 0.5) / nb) > PIECE_ODDS}
    words = {w for w in a if not hot.isdisjoint(_pieces(w))}
    common = sorted(b, key=lambda w: (-b[w], w))
    spare: dict[bytes, list[bytes]] = defaultdict(list)
    for w in reversed(common):
        if w not in words:
            spare[w[-3:]].append(w)
    twins = {spare[w[-3:]].pop() for w in sorted(words) if spare[w[-3:]]}
    said = _samples(toxic, words)
    own = _trained(_samples(ordinary, twins)[: len(said)]), _trained(said)
    size = min(map(len, own))
    shared = b" " + b" ".join(common[:SHARED_WORDS][::-1]) + b" "
    # The trainer puts what is used most last, nearest to the window.
    return tuple(shared + x[len(x) - size :] for x in own)


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    parameters = zstandard.ZstdCompressionParameters(write_checksum=0, write_content_size=0, write_dict_id=0, **PARAMETERS)
    return zstandard.ZstdCompressor(compression_params=parameters, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT))


class Distance:
    """Features of a text from the bytes that the toxic dictionary saves in each window."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.pair = compressor(ordinary).compress, compressor(toxic).compress

    def savings(self, text: str) -> np.ndarray:
        """Bytes saved in each window of the whole text."""
        raw, (plain_cost, toxic_cost) = plain(text), self.pair
        windows = [raw[i : i + WINDOW] for i in range(0, max(1, len(raw) - (WINDOW - STRIDE)), STRIDE)]
        return np.array([len(plain_cost(w)) - len(toxic_cost(w)) for w in windows], np.float64)

    def features(self, text: str) -> np.ndarray:
        g = self.savings(text)
        n, top = len(g), np.sort(np.concatenate([g, np.zeros(4)]))[::-1]
        over = [np.maximum(g - k, 0).sum() for k in LEVELS]
        return np.array([g.mean(), *(o / n for o in over), *np.log1p(over), *top[:4], *np.log1p([(g > k).sum() for k in LEVELS]), log(n), 1.0])


@dataclass
class Toxicity:
    ordinary: bytes
    toxic: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(((x - self.mean) / self.scale) @ self.weights, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    mean, scale = x.mean(0), x.std(0) + 1e-6
    mean[-1], scale[-1] = 0, 1
    z, w = (x - mean) / scale, np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z.T * (p * (1 - p) + 1e-9)) @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return mean, scale, w


def fit(toxic: list[str], ordinary: list[str], calibration: list[tuple[str, int]]) -> Toxicity:
    """Dictionaries from toxic and ordinary, thresholds from calibration (text, label)."""
    contents = dictionaries(toxic, ordinary)
    distance = Distance(*contents)
    x, y = np.array([distance.features(t) for t, _ in calibration]), np.array([label for _, label in calibration], np.float64)
    return Toxicity(*contents, *_logistic(x, y))


def train(docs: DataFrame, labels: DataFrame, folds: int, held: int, text: str = "text", doc_id: str = "doc_id", label: str = "toxic") -> Toxicity | float:
    """A model from labelled rows outside the held-out fold, or the share of toxic rows where there are too few.

    Rows with a null doc_id or label aren't used. Of rows that repeat a doc_id the least
    text counts, and the greatest label. Rows are drawn by a hash of their doc_id, for each
    use up to the stated number and up to its part of FIT_BYTES: what comes to the driver has
    a bound, however many and however long the labelled documents are. A text of more than
    a quarter of its use's bytes is left out by itself. Without any rows, or in an empty
    table, the share is 0.
    """
    known = one_label(labels, label).filter(fold(F.col("doc_id"), folds) != held)
    # A fifth part calibrates; the rest trains dictionaries.
    part = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(5))
    drawn = first_by_hash(known.filter(part == 0), "doc_id", CALIBRATION).withColumn("use", F.lit(2))
    for use, n in ((1, TOXIC), (0, ORDINARY)):
        drawn = drawn.unionByName(first_by_hash(known.filter((part != 0) & (F.col("label") == use)), "doc_id", n).withColumn("use", F.lit(use)))
    # At most TOXIC + ORDINARY + CALIBRATION ids.
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    sizes = rows.join(F.broadcast(drawn), "doc_id").groupBy("use", "doc_id", "label").agg(F.max(F.octet_length("text")).cast("long").alias("size"))
    allowed = F.when(F.col("use") == 0, FIT_BYTES // 2).otherwise(FIT_BYTES // 4)
    # As many rows as are drawn, one window for each use.
    upto = F.sum("size").over(Window.partitionBy("use").orderBy(F.xxhash64("doc_id"), "doc_id"))
    within = sizes.filter(F.col("size") <= allowed / 4).withColumn("upto", upto).filter(F.col("upto") <= allowed).select("use", "doc_id", "label")
    chosen = rows.join(F.broadcast(within), "doc_id").groupBy("use", "doc_id", "label").agg(F.min("text").alias("text"))
    got = sorted(chosen.toArrow().to_pylist(), key=lambda r: (r["use"], r["doc_id"]))
    by_use = {use: [(r["text"], r["label"]) for r in got if r["use"] == use] for use in (0, 1, 2)}
    if not by_use[0] or not by_use[1] or len({y for _, y in by_use[2]}) < 2:
        return sum(r["label"] for r in got) / max(1, len(got))
    return fit([t for t, _ in by_use[1]], [t for t, _ in by_use[0]], by_use[2])


SCORED = "doc_id long, score double, predicted int"


def score_toxicity(docs: DataFrame, model: Toxicity | float, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, score and predicted for every row; null texts count as empty, and an empty text scores as any other.

    Rows are scored one by one, whole texts window by window: null and repeated doc_ids
    pass through, other columns are ignored, an empty table gives no rows.
    """

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distance = None if isinstance(model, float) else Distance(model.ordinary, model.toxic)
        for b in batches:
            texts = b.column(1).to_pylist()
            s = np.full(len(texts), model) if distance is None else model.score(np.array([distance.features(t) for t in texts])) if texts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32), pa.int32())], names=["doc_id", "score", "predicted"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(scored, SCORED)


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, text: str = "text", doc_id: str = "doc_id", label: str = "toxic") -> DataFrame:
    """doc_id, held_out, score, predicted for every row, learnt from labels outside the held-out fold.

    Nulls, repeated rows, long texts, empty tables and other columns are handled as train
    and score_toxicity say.
    """
    model = train(docs, labels, folds, held, text, doc_id, label)
    model = float(model) if not isinstance(model, Toxicity) else model
    return score_toxicity(docs, model, text, doc_id).withColumn("held_out", fold(F.col("doc_id"), folds) == held)
