"""A quality classifier: a factorisation machine over hashed words, text structure and metadata.

Inputs of a score are the text (hashed words weighted by 1 + log of their count, of unit length together),
statistics of its structure (ratios of upper case, digits, punctuation and other classes, word lengths,
repeated words and lines; each cut into bins, one input per bin) and, as metadata, the length in characters,
in bins too. Labels, language, source and ids are never inputs.

A factorisation machine scores y = b + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j. With k factors the pairs take
linear time, since sum_{i<j} <v_i, v_j> x_i x_j = 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2).

Fitting uses at most ``TRAIN_ROWS`` labelled documents, those with the smallest hash of their id: a bounded sample,
whose sparse rows the driver trains on with AdaGrad. Scoring reads every whole text.

Edge cases: null text counts as empty; empty texts get a score from the bins alone; a doc_id that is null is scored and
never held out or learned from; labels that repeat a doc_id count once (the smaller quality), and so do documents (the least
features); null labels are ignored;
labels of one class, or none, give the constant score of that class (1.0 if there is none); extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAIN_ROWS = 8_000
BITS = 16
BINS = 12
FACTORS = 8
STATS = 14
DIMENSION = (1 << BITS) + STATS * BINS

_CLASS = np.zeros((256, 7))
for _byte in range(256):
    _c = chr(_byte)
    _kind = 0 if "a" <= _c <= "z" else 1 if "A" <= _c <= "Z" else 2 if "0" <= _c <= "9" else 3 if _c in " \t\r" else 4 if _c == "\n" else 5 if _byte >= 128 else 6
    _CLASS[_byte, _kind] = 1
_MARKS = [ord(x) for x in "!|#$%&*{}<>=_~^"]


def _bin(ratio: float) -> int:
    """Bins that are finer near 0, for ratios from 0 to 1."""
    return min(BINS - 1, int(BINS * min(max(ratio, 0.0), 1.0) ** 0.5))


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(indices, values) of a text; values of words have unit length, each statistic sets one index to 0.5."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    lower, upper, digit, space, line, high, other = counts @ _CLASS
    n, n_words = max(len(raw), 1), max(len(words), 1)
    lines = [x for x in raw.split(b"\n") if x]
    letters = max(lower + upper + high, 1)
    stats = [
        upper / letters, digit / n, other / n, high / n, space / n, min(1.0, 20 * line / n),
        counts[_MARKS].sum() / n_words / 2,
        (len(raw) - space - line) / n_words / 25,
        len(set(words)) / n_words,
        1 - len(set(lines)) / max(len(lines), 1),
        counts.max() / n,
        sum(map(bytes.isalpha, words)) / n_words,
        np.log1p(len(words)) / 12,
        np.log1p(len(text or "")) / 14,
    ]
    at = [(1 << BITS) + i * BINS + _bin(float(s)) for i, s in enumerate(stats)]
    if words:
        mask = (1 << BITS) - 1
        index, count = np.unique(np.fromiter((zlib.crc32(w) & mask for w in words), np.int64, len(words)), return_counts=True)
        weight = 1 + np.log(count)
        weight /= np.sqrt((weight * weight).sum())
    else:
        index, weight = np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate([index, at]), np.concatenate([weight, np.full(len(at), 0.5)])


class FactorisationMachine:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.bias = 0.0
        self.linear = np.zeros(DIMENSION, np.float32)
        self.factors = rng.normal(0, 0.02, (DIMENSION, FACTORS)).astype(np.float32)

    def raw(self, index: np.ndarray, value: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores before the logistic function of rows that begin at ``start``, and sum_i v_i x_i of each."""
        vx = self.factors[index] * value[:, None].astype(np.float32)
        total = np.add.reduceat(vx, start, axis=0)
        squares = np.add.reduceat((vx * vx).sum(axis=1), start)
        linear = np.add.reduceat(self.linear[index] * value, start)
        return self.bias + linear + 0.5 * ((total * total).sum(axis=1) - squares), total

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 12, rate: float = 0.08, decay: float = 1e-4, batch: int = 64, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.bias = float(np.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1)))
        seen_linear, seen_factors = np.full(DIMENSION, 1e-6), np.full((DIMENSION, FACTORS), 1e-6)
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for i in range(0, len(order), batch):
                pick = order[i : i + batch]
                size = np.array([len(rows[j][0]) for j in pick])
                index, value = np.concatenate([rows[j][0] for j in pick]), np.concatenate([rows[j][1] for j in pick])
                start = np.cumsum(size) - size
                score, total = self.raw(index, value, start)
                error = np.repeat(1 / (1 + np.exp(-score)) - labels[pick], size)
                distinct, back = np.unique(index, return_inverse=True)
                g_linear = np.bincount(back, error * value) + decay * self.linear[distinct]
                each = (error * value)[:, None] * (np.repeat(total, size, axis=0) - self.factors[index] * value[:, None])
                g_factors = np.stack([np.bincount(back, each[:, f]) for f in range(FACTORS)], axis=1) + decay * self.factors[distinct]
                seen_linear[distinct] += g_linear**2
                seen_factors[distinct] += g_factors**2
                self.linear[distinct] -= (rate * g_linear / np.sqrt(seen_linear[distinct])).astype(np.float32)
                self.factors[distinct] -= (rate * g_factors / np.sqrt(seen_factors[distinct])).astype(np.float32)
                self.bias -= rate * 0.1 * float(error[start].mean())

    def score(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros(len(texts))
        for i in range(0, len(texts), 256):
            rows = [features(t) for t in texts[i : i + 256]]
            size = np.array([len(r[0]) for r in rows])
            score, _ = self.raw(np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]), np.cumsum(size) - size)
            out[i : i + 256] = 1 / (1 + np.exp(-np.clip(score, -60, 60)))
        return out


HELD_OUT = "coalesce(crc32(cast(doc_id AS string)) % 5 = 0, false)"


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", train_rows: int = TRAIN_ROWS) -> FactorisationMachine | float:
    """The machine, or a constant score where the labels have one class only."""
    known = labels.where(f"doc_id IS NOT NULL AND {label} IN (0, 1) AND NOT {HELD_OUT}").groupBy("doc_id").agg(F.min(label).alias("y"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [features(t) for t in batch["text"].where(batch["text"].notna(), None)]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "y": batch["y"], "at": [r[0].astype("<i4").tobytes() for r in rows], "x": [r[1].astype("<f4").tobytes() for r in rows]})

    # Features are made where the texts lie; of a repeated doc_id one row counts, so no more than ``train_rows`` rows are gathered.
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").mapInPandas(run, "doc_id long, y int, at binary, x binary")
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("at", "x", "y")).alias("row")).select("row.*").toPandas()
    y = rows["y"].to_numpy(float)
    if not len(y) or y.min() == y.max():
        return float(y[0]) if len(y) else 1.0
    rows = rows.assign(at_bytes=rows["at"].map(bytes)).sort_values(["at_bytes", "y"], kind="stable")
    sparse = [(np.frombuffer(a, "<i4").astype(np.int64), np.frombuffer(x, "<f4").astype(np.float64)) for a, x in zip(rows["at"], rows["x"], strict=True)]
    machine = FactorisationMachine()
    machine.fit(sparse, rows["y"].to_numpy(float))
    return machine


def score(docs: DataFrame, machine: FactorisationMachine | float, keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """Columns ``keep`` (doc_id if not given) and the score, called ``name``, of every document."""
    keep = [f"`{c}`" for c in keep or ["doc_id"]]
    if isinstance(machine, float):
        return docs.select(*keep, F.lit(machine).alias(name))
    # The machine has a fixed size of DIMENSION * (FACTORS + 1) floats, 2.4 MB.
    shared = docs.sparkSession.sparkContext.broadcast((machine.bias, machine.linear, machine.factors))
    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        own = FactorisationMachine.__new__(FactorisationMachine)
        own.bias, own.linear, own.factors = shared.value
        return pd.Series(own.score(texts.where(texts.notna(), None).tolist()))

    return docs.select(*keep, scored("text").alias(name))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", F.expr(HELD_OUT).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
