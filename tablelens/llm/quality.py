"""Quality rules: countable base rules and a trained classifier.

The classifier is a logistic regression over hashed word and character n-grams
(shares of all n-grams of a text, two hashed tables), trained on a bounded
sample of labelled rows, calibrated to probabilities on rows it was not trained
on, and applied in Arrow batches with a fixed threshold.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, ship
from .toxicity import fit_curve

#: Slots of the hashed word and character tables, one after the other.
SLOTS = 1 << 13
#: Character n-grams of 1 to this many code points; words singly and in pairs.
CHARS = 4
_MIX = np.uint32(2654435761)


def words_of(text: str) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` (what bytes.split cuts at is that set)."""
    return text.encode("utf-8", "surrogatepass").split()


def base_counts(text: str, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    symbols = sum(map(text.count, "#*$%&|<>"))
    dup_lines = 0
    if "\n" in text:
        lines = [x for x in text.split("\n") if x and x.strip(" \t\x0b\x0c\r")]
        dup_lines = len(lines) - len(set(lines))
    return len(words), chars, symbols, dup_lines, repeat_words(words)


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more, first included."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    n = len(number)
    pairs = ids[:-1] * n + ids[1:]
    if n > 2_000_000:  # three numbers would not fit into 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
    windows = pairs[:-1] * n + ids[2:]
    order = np.argsort(windows, kind="stable")
    equal = windows[order[1:]] == windows[order[:-1]]
    if not equal.any():
        return 0
    twice = np.zeros(len(words), bool)
    at = np.concatenate([order[1:][equal], order[:-1][equal]])
    for k in range(3):
        twice[at + k] = True
    return int(twice.sum())


def _word_slots(words: list[bytes]) -> np.ndarray:
    h = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
    both = [h]
    if len(h) > 1:
        both.append((h[:-1] * _MIX) ^ (h[1:] + np.uint32(40503)))
    h = np.concatenate(both)
    return (h ^ (h >> np.uint32(15))) & np.uint32(SLOTS - 1)


def _char_slots(text: str) -> Iterator[np.ndarray]:
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint32)
    h = np.zeros(len(c), np.uint32)
    for n in range(1, min(CHARS, len(c)) + 1):
        h = (h[:len(c) - n + 1] * np.uint32(16777619)) ^ (c[n - 1:] + np.uint32(n)) * _MIX
        yield ((h ^ (h >> np.uint32(16))) & np.uint32(SLOTS - 1)) + np.uint32(SLOTS)


def features(text: str, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Slots and their shares; words and characters each add up to one."""
    at, share = [], []
    for slots in ([_word_slots(words)] if words else [], list(_char_slots(text)) if text else []):
        if slots:
            slot, n = np.unique(np.concatenate(slots), return_counts=True)
            at.append(slot.astype(np.int32))
            share.append((n / n.sum()).astype(np.float32))
    return (np.concatenate(at), np.concatenate(share)) if at else (np.zeros(0, np.int32), np.zeros(0, np.float32))


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    curve: tuple[float, float]

    def margin(self, text: str, words: list[bytes]) -> float:
        """The same as with ``features``, without making shares."""
        z = self.bias
        if words:
            z += float(self.weights[_word_slots(words)].mean())
        if text:
            total = n = 0.0
            for slots in _char_slots(text):
                total += float(self.weights[slots].sum(dtype=np.float64))
                n += len(slots)
            z += total / n
        return z

    def probability(self, text: str, words: list[bytes]) -> float:
        z = self.curve[0] + self.curve[1] * self.margin(text, words)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit(slots: list[np.ndarray], shares: list[np.ndarray], y: np.ndarray, share: float, steps: int = 150,
        ridge: float = 1e-6, seed: int = 3) -> Model:
    """Logistic regression by Adam on four fifths, calibrated on the rest."""
    empty = Model(np.zeros(2 * SLOTS, np.float32), 0.0, (math.log((share + 1e-6) / (1 - share + 1e-6)), 0.0))
    if len(y) < 10 or y.min() == y.max():
        return empty
    test = np.random.default_rng(seed).random(len(y)) < 0.2
    own = np.flatnonzero(~test)
    at, val = np.concatenate([slots[i] for i in own]), np.concatenate([shares[i] for i in own])
    row = np.repeat(np.arange(len(own)), [len(slots[i]) for i in own])
    t = y[own]
    balance = np.where(t > 0, 0.5 / max(t.mean(), 1e-9), 0.5 / max(1 - t.mean(), 1e-9))
    w, b = np.zeros(2 * SLOTS), 0.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for k in range(1, steps + 1):
        z = np.bincount(row, val * w[at], len(own)) + b
        err = balance * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - t) / len(own)
        g, gb = np.bincount(at, val * err[row], len(w)) + ridge * w, err.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        rate = 1.0
        w -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        b -= 0.1 * (mb / (1 - 0.9**k)) / (math.sqrt(vb / (1 - 0.99**k)) + 1e-8)
    margins = np.array([b + float(shares[i] @ w[slots[i]]) for i in np.flatnonzero(test)])
    curve = fit_curve(margins[:, None], y[test], share, ridge=0.1)
    return Model(w.astype(np.float32), float(b), (curve[0], curve[1]))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          per_class: int = 1000) -> Model:
    """Learn from the documents that ``labels`` marks; the sample is bounded by
    ``per_class`` rows of each class. Without two classes the probability is the
    share of ones (without labels: one)."""
    ship(docs.sparkSession)
    sample, total = labelled_sample(docs, labels, id_col, text_col, label_col, per_class)
    share = total.get(1, 0) / max(1, sum(total.values())) if total else 1.0
    if not total.get(0) or not total.get(1):
        return fit([], [], np.zeros(0), share)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                text = batch.column(0)[i].as_py()
                at, val = features(text, words_of(text))
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(i, 1), pa.array([at.tobytes()]), pa.array([val.tobytes()]), batch.column(2).slice(i, 1)], ["y", "at", "val", "k"])

    points = sorted(sample.select("t", "y", "k").mapInArrow(hashed, "y int, at binary, val binary, k long").collect(), key=lambda r: (r.k, r.y))
    return fit([np.frombuffer(r["at"], np.int32) for r in points], [np.frombuffer(r["val"], np.float32) for r in points], np.array([r.y for r in points], float), share)


#: Fixed thresholds: fewest words, largest percentage of words in repeated windows, least probability.
MIN_WORDS, MAX_REPEAT_PERCENT, MIN_PROBABILITY = 50, 50, 0.5


def judge(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "quality") -> DataFrame:
    """``docs`` with ``out_col`` (struct): the base counts, ``base_failed``,
    ``probability`` (of good quality) and ``kept``. Whole texts; null counts as
    no words, so it fails the base rules. Repeated rows are judged alike; a
    column of that name is replaced; an empty table gives no rows."""
    ship(docs.sparkSession)

    @F.pandas_udf("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, probability double")
    def rules(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = []
            for t in texts:
                t = t or ""
                words = words_of(t)
                out.append((*base_counts(t, words), model.probability(t, words)))
            yield pd.DataFrame(out, columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "probability"])

    q, out = docs.withColumn(out_col, rules(F.col(text_col))), F.col(out_col)
    failed = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEAT_PERCENT * out["n_words"])
    q = q.withColumn(out_col, out.withField("base_failed", failed))
    return q.withColumn(out_col, out.withField("kept", ~out["base_failed"] & (out["probability"] >= MIN_PROBABILITY)))
