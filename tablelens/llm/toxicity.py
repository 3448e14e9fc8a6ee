"""Toxicity score from a weighted lexicon.

The lexicon is learned from labelled rows: word beginnings and whole words,
after folding homoglyphs and digit substitutions, weighted by the log odds of
the toxic class. An Aho-Corasick automaton finds them in whole texts; hits
inside exception phrases do not count. Two figures, the weight found and its
share per word, go through a logistic curve fitted on the same rows.
"""

from __future__ import annotations

import math
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, labelled_sample, ship

# fixed values: look-alikes of Latin letters, and digits and signs that stand for letters
HOMOGLYPHS = dict(zip("аеорсухіјѕһԁԛѡвкмнтгαβεικνορτυχ", "aeopcyxijshdqwbkmhtraeeiknoptux"))
HOMOGLYPHS["β"] = "b"
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
INVISIBLE = "­​‌‍⁠﻿"


class _Fold(dict):
    """For str.translate: letters in lower case and folded, all else a blank."""

    def __missing__(self, cp: int) -> str:
        ch = unicodedata.normalize("NFKC", chr(cp)).lower()
        ch = "".join(HOMOGLYPHS.get(x, SUBSTITUTES.get(x, x)) for x in ch)
        out = "".join(x if x.isalpha() or unicodedata.combining(x) else " " for x in ch)
        if len(self) < 100_000:
            self[cp] = out
        return out


_fold = _Fold({ord(c): "" for c in INVISIBLE})


def fold(text: str) -> str:
    """Folded words between single blanks, with one at either end."""
    return " " + " ".join(text.translate(_fold).split()) + " "


#: Lengths of word beginnings that can be terms.
PREFIX = range(3, 13)


def terms_of(folded: str) -> set[str]:
    out = set()
    for w in set(folded.split()):
        out.add(f" {w} ")
        for k in PREFIX:
            if k > len(w):
                break
            out.add(" " + w[:k])
    return out


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def automaton(self) -> ahocorasick.Automaton | None:
        if not self.weights:
            return None
        a = ahocorasick.Automaton()
        for t, w in self.weights.items():
            a.add_word(t, (len(t), w))
        for e in self.exceptions:
            if e not in self.weights:
                a.add_word(e, (len(e), None))
        a.make_automaton()
        return a


def measure(folded: str, automaton) -> tuple[float, int]:
    """(weight found, words). Of the terms that begin at one word the heaviest
    counts; a word inside an exception phrase counts nothing."""
    words = folded.count(" ") - 1 if len(folded) > 2 else 0
    if automaton is None:
        return 0.0, words
    best: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    for end, (n, w) in automaton.iter(folded):
        at = end - n + 1
        if w is None:
            spared.append((at, end))
        elif w > best.get(at, 0.0):
            best[at] = w
    if spared:
        starts, ends = [], []
        for a, b in sorted(spared):
            if starts and a <= ends[-1]:
                ends[-1] = max(ends[-1], b)
            else:
                starts.append(a)
                ends.append(b)
        best = {at: w for at, w in best.items() if (i := bisect_right(starts, at)) == 0 or at >= ends[i - 1]}
    return sum(best.values()), words


def _features(weight: float, words: int) -> tuple[float, float]:
    return math.log1p(weight), math.log1p(100 * weight / max(1, words))


def fit_curve(x: np.ndarray, y: np.ndarray, share: float, ridge: float = 1e-2) -> tuple[float, ...]:
    """Logistic curve by Newton steps; ``share``: the true share of ones, to
    which the rows, balanced by sampling, are weighted back."""
    if len(y) == 0 or y.min() == y.max():
        p = min(max(share, 1e-6), 1 - 1e-6)
        return (math.log(p / (1 - p)), *[0.0] * x.shape[1])
    a = np.hstack([np.ones((len(x), 1)), x])
    weight = np.where(y > 0, share / y.mean(), (1 - share) / (1 - y.mean()))
    b, pull = np.zeros(a.shape[1]), ridge * np.r_[0.0, np.ones(x.shape[1])] + 1e-9

    def loss(b):
        z = a @ b
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * (pull * b * b).sum())

    now = loss(b)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        g = a.T @ (weight * (p - y)) + pull * b
        h = (a * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ a + np.diag(pull)
        step = np.linalg.solve(h, g)
        while (new := loss(b - step)) > now and np.abs(step).max() > 1e-10:
            step = step / 2
        if new > now or now - new < 1e-10:
            break
        b, now = b - step, new
    return tuple(float(v) for v in b)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          per_class: int = 1500, min_docs: int = 4, chance: float = 0.05, exceptions: list[str] | None = None) -> Model:
    """Learn from the documents that ``labels`` marks outside the held-out fifth.
    The sample is bounded by ``per_class`` ids of each class, whatever their
    number. A term must stand in ``min_docs`` of the sampled toxic rows, and so
    much oftener there than in clean ones that among all terms tested less than
    ``chance`` one would by luck (Chernoff bound of the binomial tail). So the rarer
    the toxic rows of a sample, the fewer of them a term needs. Rows without a label are left out; without two classes nothing
    is learned and the score is the share of ones. ``exceptions``: phrases to
    spare beside those learned (neighbouring words that the term shows mostly in
    clean rows)."""
    ship(docs.sparkSession)
    sample, total = labelled_sample(docs, labels.where(~held_out(F.col(id_col))), id_col, text_col, label_col, per_class)
    n = {0: 0, 1: 0} | dict(sample.groupBy("y").count().collect())
    if not n[0] or not n[1]:
        p = total.get(1, 0) / max(1, sum(total.values()))
        return Model(curve=(math.log((p + 1e-6) / (1 - p + 1e-6)), 0.0, 0.0))
    share = total[1] / (total[0] + total[1])

    def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                terms = sorted(terms_of(fold(batch.column(0)[i].as_py())))
                yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([batch.column(1)[i].as_py()] * len(terms), pa.int32())], ["term", "y"])

    counts = (sample.select("t", "y").mapInArrow(count_terms, "term string, y int").groupBy("term")
              .agg(F.sum("y").alias("bad"), F.sum(1 - F.col("y")).alias("good")).where(F.col("bad") >= min_docs))
    counts = cut(counts)
    tested, base = counts.count(), n[1] / (n[0] + n[1])
    both = F.col("bad") + F.col("good")
    surprise = F.col("bad") * F.log(F.col("bad") / (both * base)) + F.when(F.col("good") > 0, F.col("good") * F.log(F.col("good") / (both * (1 - base)))).otherwise(0.0)
    sure = surprise >= math.log(max(1, tested) / chance)
    odds = F.log((F.col("bad") + 0.05) / (n[1] + 0.1)) - F.log((F.col("good") + 0.05) / (n[0] + 0.1))
    best = (counts.withColumn("w", odds).where((F.col("w") > 2) & sure).collect())
    model = Model(exceptions=[fold(e) for e in exceptions or []])
    child: dict[str, int] = {}
    for r in best:
        if not r.term.endswith(" "):
            child[r.term[:-1]] = max(child.get(r.term[:-1], 0), r.bad)
    for r in sorted(best, key=lambda r: (len(r.term), r.term)):
        # of word beginnings that stand for the same words the longest is kept;
        # a longer term must weigh clearly more than its beginnings
        if child.get(r.term, 0) >= 0.95 * r.bad:
            continue
        shorter = max((model.weights.get(r.term[:k], 0.0) for k in range(2, len(r.term))), default=0.0)
        if r.w > shorter + 1:
            model.weights[r.term] = float(r.w)

    weights, given = model.weights, list(model.exceptions)

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Model(weights, given).automaton()
        for batch in batches:
            for i in range(batch.num_rows):
                folded, found = fold(batch.column(0)[i].as_py()), set()
                for end, (length, w) in automaton.iter(folded) if automaton else ():
                    at = end - length + 1
                    stop = folded.find(" ", at + 1)
                    before, after = folded.rfind(" ", 0, at) if at else -1, folded.find(" ", stop + 1)
                    if before >= 0:
                        found.add(folded[before:stop + 1])
                    if after >= 0:
                        found.add(folded[at:after + 1])
                terms = sorted(found)
                yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([batch.column(1)[i].as_py()] * len(terms), pa.int32())], ["term", "y"])

    phrases = (sample.select("t", "y").mapInArrow(contexts, "term string, y int").groupBy("term")
               .agg(F.sum("y").alias("bad"), F.sum(1 - F.col("y")).alias("good"))
               .where((F.col("good") >= min_docs) & (F.col("good") / n[0] > 4 * F.col("bad") / n[1])).collect())
    model.exceptions += sorted(r.term for r in phrases)
    spared = model.exceptions

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Model(weights, spared).automaton()
        for batch in batches:
            rows = [_features(*measure(fold(t.as_py()), automaton)) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([r[0] for r in rows], pa.float64()), pa.array([r[1] for r in rows], pa.float64())], ["y", "a", "b"])

    points = sample.select("t", "y").mapInArrow(measured, "y int, a double, b double").collect()
    model.curve = fit_curve(np.array([[p.a, p.b] for p in points]), np.array([p.y for p in points], float), share)
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "toxicity") -> DataFrame:
    """``docs`` with ``out_col`` (0 to 1): the toxicity of each whole text. Null
    and empty texts get the curve's value for no hit; a column of that name is
    replaced; repeated rows get equal scores; an empty table gives no rows."""
    ship(docs.sparkSession)
    weights, exceptions, curve = model.weights, model.exceptions, model.curve

    @F.pandas_udf("double")
    def toxicity(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = Model(weights, exceptions).automaton()
        for texts in batches:
            out = []
            for t in texts:
                a, b = _features(*measure(fold(t or ""), automaton))
                z = curve[0] + curve[1] * a + curve[2] * b
                out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            yield pd.Series(out, dtype="float64")

    return docs.withColumn(out_col, toxicity(F.col(text_col)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))
