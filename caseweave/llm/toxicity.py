"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct hashed words, word pairs and pairs with one word between, of the whole
lower-cased text. The learner keeps its own learning rate per coordinate and an L1 penalty, so
most weights are exactly zero; the rest, two short arrays, go to the tasks.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseweave.llm.common import class_sample, crc_fold

BITS = 20
CHUNK = 1 << 18
ODD = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def _power_tables() -> list[np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64, up to the length of a chunk."""
    if not _powers:
        for base in (ODD, pow(ODD, -1, 1 << 64)):
            p = np.full(CHUNK + 1, base, np.uint64)
            p[0] = 1
            _powers.append(np.multiply.accumulate(p))
    return _powers


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the words of the lower-cased text, in order; words are runs of letters, digits and non-ASCII."""
    up, down = _power_tables()
    raw = text.lower().encode("utf-8", "replace")
    found, at = [], 0
    while at < len(raw):
        end = min(len(raw), at + CHUNK)
        if end < len(raw) and (cut := raw.rfind(b" ", at, end)) > at:
            end = cut
        data = np.frombuffer(raw, np.uint8, end - at, at)
        inside = np.diff(np.concatenate([[0], _WORD[data].view(np.int8), [0]]))
        start, stop = np.flatnonzero(inside == 1), np.flatnonzero(inside == -1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64)])
        found.append(_mix((sums[stop] - sums[start]) * down[start]))
        at = end
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def features(text: str | None, bits: int = BITS) -> np.ndarray:
    """Distinct feature numbers below 2^bits, ascending; null or wordless text has none."""
    h = word_hashes(text or "")
    pair = _mix(h[:-1] * np.uint64(3) + h[1:] * np.uint64(5) + np.uint64(1))
    skip = _mix(h[:-2] * np.uint64(7) + h[2:] * np.uint64(11) + np.uint64(2))
    return np.unique((np.concatenate([h, pair, skip]) >> np.uint64(64 - bits)).astype(np.uint32))


def ftrl(rows: list[np.ndarray], labels: np.ndarray, bits: int = BITS, alpha: float = 2.0, beta: float = 1.0, l1: float = 12.0, l2: float = 1.0, epochs: int = 6) -> tuple[np.ndarray, np.ndarray, float]:
    """Non-zero weights (feature numbers, values) and the intercept.

    Rows are met in one fixed shuffled order per epoch. With no rows, or labels all equal, there
    are no weights and the intercept is the smoothed log odds.
    """
    ones = float(labels.sum())
    bias = float(np.log((ones + 0.5) / (len(labels) - ones + 0.5)))
    if not 0 < ones < len(labels):
        return np.zeros(0, np.uint32), np.zeros(0), bias
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    bias_n = 0.0
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            x = rows[k]
            zx, nx = z[x], n[x]
            root = np.sqrt(nx)
            w = np.where(np.abs(zx) > l1, (np.sign(zx) * l1 - zx) / ((beta + root) / alpha + l2), 0.0)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35))) - labels[k]
            z[x] = zx + g - (np.sqrt(nx + g * g) - root) / alpha * w
            n[x] = nx + g * g
            bias_n += g * g
            bias -= alpha * g / (beta + np.sqrt(bias_n))
    w = np.where(np.abs(z) > l1, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2), 0.0)
    used = np.flatnonzero(w).astype(np.uint32)
    return used, w[used], bias


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 10_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 5, held_out: int = 0):
    """Learn from about ``max_rows`` labelled rows outside the held-out fold, whole texts.

    A label that is rarer than 1 in 20 has a twentieth of ``max_rows`` nevertheless, if there are as
    many; the intercept is then set back to the labels' shares among all rows.
    """
    wanted = labels.where(F.col(label_col).isNotNull() & (crc_fold(id_col, folds) != held_out)).select(F.col(id_col).alias("label_id"), F.col(label_col).cast("int").alias("label"))
    chosen, rates = class_sample(wanted, "label_id", "label", max_rows, max_rows // 20)
    sample = F.broadcast(chosen.limit(max_rows + max_rows // 2))  # bounded by max_rows
    texts = docs.select(F.col(id_col).alias("label_id"), F.col(text_col).alias("text")).join(sample, "label_id").select("label_id", "text", "label")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t.as_py()).astype("<u4").tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.binary()), b.column(2)], ["label_id", "x", "label"])

    got = texts.mapInArrow(extract, "label_id long, x binary, label int").toPandas().sort_values(["label_id", "label"], kind="stable")
    used, weights, bias = ftrl([np.frombuffer(x, "<u4") for x in got.x], got.label.to_numpy(float))
    return used, weights, bias - np.log(rates.get(1, 1.0) / rates.get(0, 1.0))


def scorer(model):
    """Pandas UDF: text to the probability of label 1."""
    used, weights, bias = model

    @F.pandas_udf(T.DoubleType())
    def score(text: pd.Series) -> pd.Series:
        dense = np.zeros(1 << BITS)
        dense[used] = weights
        return pd.Series([1 / (1 + np.exp(-np.clip(dense[features(t)].sum() + bias, -700, 700))) for t in text], dtype=float)

    return score


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Null and empty texts get the score of the intercept. Rows that repeat an id are scored each;
    labels without a document or with a null label are not used; a labelled row that is repeated
    counts as often as it stands there. With no usable labels all scores are equal. Other columns
    are not read.
    """
    score = scorer(train(docs, labels, id_col=id_col, text_col=text_col))
    out = docs.select(F.col(id_col).alias("doc_id"), (crc_fold(id_col, 5) == 0).alias("held_out"), score(F.col(text_col)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
