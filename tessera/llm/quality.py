"""Quality by ordinal cumulative-link regression over hashed text features.

P(grade <= k) = logistic(threshold_k - score): one score for all grades, whose weights are shared, and ordered
thresholds. The score is the mean of the weights of a text's word features (words, shapes, endings), plus the weights of
a few features of the whole text (repeated lines and words, length, share of letters), all hashed into one table. The
model gives the expected grade and the probability of reaching a grade, by which texts are selected.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage, text_or_empty
from .toxicity import held_out

#: Labelled texts that a model is fitted on, chosen by a hash of their key: a documented bound on a classifier's sample.
SAMPLE = 6_000
#: Grades of a model at most, as each has a threshold and a part of the sample.
GRADES = 256
#: Size of the hashed table.
DIM = 1 << 16
#: Kept words in a worker; beyond it the table starts anew.
CACHE = 400_000


def _hash(feature: str) -> int:
    return zlib.crc32(feature.encode()) & (DIM - 1)


def _shape(word: str) -> str:
    """Runs of upper-case letters, lower-case letters, digits and each other sign, as one sign each."""
    out = ""
    for c in word:
        s = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        if not out.endswith(s):
            out += s
    return out


def word_features(word: str) -> list[int]:
    low = word.lower()
    return [_hash("w " + low), _hash("s " + _shape(word)), _hash("e " + low[-3:])]


def _bucket(x: float, steps: int) -> int:
    return int(round(x * steps))


def text_features(text: str, words: list[str]) -> list[int]:
    """Features of the whole text, each present once."""
    n = len(words)
    lines = [x for x in text.split("\n") if x.strip()]
    letters = sum(map(len, words)) or 1
    plain = len(words) and sum(map(str.isalpha, words)) / n
    return [
        _hash("bias"),
        _hash(f"length {n.bit_length()}"),
        _hash(f"lines again {_bucket(1 - len(set(lines)) / max(1, len(lines)), 8)}"),
        _hash(f"words again {_bucket(1 - len(set(words)) / max(1, n), 8)}"),
        _hash(f"word length {min(20, round(letters / max(1, n)))}"),
        _hash(f"plain words {_bucket(plain, 8)}"),
        _hash(f"upper {_bucket(sum(w.isupper() for w in words) / max(1, n), 8)}"),
    ]


@dataclass
class Model:
    """grades in rising order, thresholds between them, weights of the hashed table."""

    grades: list[int]
    thresholds: np.ndarray
    weights: np.ndarray
    _cache: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {"grades": self.grades, "thresholds": self.thresholds, "weights": self.weights, "_cache": {}}

    def value(self, text: str) -> float:
        words = text.split()
        cache = self._cache
        total = 0.0
        if words:
            try:
                total = sum(map(cache.__getitem__, words))
            except KeyError:
                if len(cache) > CACHE:
                    cache.clear()
                for w in set(words):
                    if w not in cache:
                        cache[w] = float(self.weights[word_features(w)].sum())
                total = sum(map(cache.__getitem__, words))
            total /= len(words)
        return total + float(self.weights[text_features(text, words)].sum())

    def at_least(self, values: np.ndarray) -> np.ndarray:
        """P(grade >= g) for each value and each grade g but the lowest."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - np.asarray(values, float)[:, None], -30, 30)))

    def expected(self, values: np.ndarray) -> np.ndarray:
        return self.grades[0] + self.at_least(values) @ np.diff(self.grades)


def fit_rows(features: list[np.ndarray], shares: list[np.ndarray], y: np.ndarray, n_grades: int, rounds: int = 150, rate: float = 0.3, ridge: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Thresholds and weights by Adam on the whole sample; grades weigh the same. y holds grades' positions."""
    index, value = np.concatenate(features), np.concatenate(shares)
    owner = np.repeat(np.arange(len(y)), [len(f) for f in features])
    weight = (1 / np.maximum(1, np.bincount(y, minlength=n_grades)))[y] / n_grades
    w, first, steps = np.zeros(DIM), 0.0, np.zeros(max(0, n_grades - 2))
    moments: list[list] = [[0.0, 0.0], [0.0, 0.0], [0.0, 0.0]]

    def thresholds() -> np.ndarray:
        return first + np.r_[0.0, np.cumsum(np.exp(steps))]

    for t in range(1, rounds + 1):
        score = np.bincount(owner, value * w[index], minlength=len(y))
        theta = np.r_[-np.inf, thresholds(), np.inf]
        up, down = theta[y + 1] - score, theta[y] - score
        cu, cd = 1 / (1 + np.exp(-np.clip(up, -30, 30))), 1 / (1 + np.exp(-np.clip(down, -30, 30)))
        cu[y == n_grades - 1], cd[y == 0] = 1.0, 0.0
        mass = np.maximum(cu - cd, 1e-9)
        du, dd = cu * (1 - cu) / mass, cd * (1 - cd) / mass
        by_score = weight * (du - dd)  # of the loss -log(mass)
        by_theta = np.zeros(n_grades - 1)
        np.add.at(by_theta, y[y < n_grades - 1], -(weight * du)[y < n_grades - 1])
        np.add.at(by_theta, y[y > 0] - 1, (weight * dd)[y > 0])
        gradients = [np.bincount(index, value * by_score[owner], minlength=DIM) + ridge * w, by_theta.sum(), np.cumsum(by_theta[::-1])[::-1][1:] * np.exp(steps)]
        moves = []
        for m, g in zip(moments, gradients, strict=True):
            m[0], m[1] = 0.9 * m[0] + 0.1 * g, 0.99 * m[1] + 0.01 * g * g
            moves.append(rate * (m[0] / (1 - 0.9**t)) / (np.sqrt(m[1] / (1 - 0.99**t)) + 1e-9))
        w, first, steps = w - moves[0], float(first - moves[1]), steps - moves[2]
    return thresholds(), w


def sparse(text: str) -> tuple[list[int], list[float]]:
    """Hashed features of a text and their values: shares for word features, 1 for the rest."""
    words = text.split()
    counts: dict[int, float] = {}
    share = 1 / max(1, len(words))
    kept: dict[str, list[int]] = {}
    for w in words:
        for f in kept.get(w) or kept.setdefault(w, word_features(w)):
            counts[f] = counts.get(f, 0.0) + share
    for f in text_features(text, words):
        counts[f] = counts.get(f, 0.0) + 1.0
    return list(counts), list(counts.values())


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Model:
    """A model from labelled rows of `docs` that are not held out; `labels` has `key` and the integer grade `label`.

    At most `sample` keys are used, the same number of each grade where there are as many, the first by a hash of the
    key, and of rows of one key the smallest text; so what is sent around, and the one task that fits the model, are bounded. Null keys and grades teach nothing.
    With less than two grades every text gets that grade (or 0). All grades are learnt; more than `GRADES` are an error.
    """
    marks = labels.select(F.col(key).alias("_k"), F.col(label).cast("int").alias("_y")).where(F.col("_k").isNotNull() & F.col("_y").isNotNull() & ~held_out(F.col("_k"))).distinct()
    grades = sorted(r._y for r in marks.select("_y").distinct().limit(GRADES + 1).collect())
    if len(grades) > GRADES:
        raise ValueError(f"{label} has more than {GRADES} grades; bin them first")
    if len(grades) < 2:
        return Model([*grades, *[0] * (1 - len(grades))], np.zeros(0), np.zeros(DIM))
    chosen = None
    for g in grades:
        part = marks.where(F.col("_y") == g).orderBy(F.xxhash64("_k"), "_k").limit(sample // len(grades))
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = docs.select(F.col(key).alias("_key"), text_or_empty(text).alias("_text"))
    known = rows.join(F.broadcast(chosen), F.col("_key") == F.col("_k")).groupBy("_k", "_y").agg(F.min("_text").alias("_text")).select("_text", "_y")

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sparse(t) for t in batch.column(0).to_pylist()]
            for i in range(0, len(found), 500):
                part = found[i : i + 500]
                yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in part], pa.list_(pa.int32())), pa.array([v for _, v in part], pa.list_(pa.float32())), batch.column(1).slice(i, len(part))], names=["f", "v", "y"])

    rows = stage(known.mapInArrow(featured, "f array<int>, v array<float>, y int"), "features")

    def fitted(table: pa.Table) -> pa.Table:
        lists = lambda c: [np.asarray(x.values) for x in table.column(c).combine_chunks()]
        y = np.searchsorted(grades, table.column("y").to_numpy())
        thresholds, weights = fit_rows(lists("f"), lists("v"), y, len(grades))
        return pa.table({"thresholds": pa.array([thresholds.tolist()], pa.list_(pa.float64())), "weights": pa.array([weights.astype("<f4").tobytes()], pa.binary())})

    got = rows.withColumn("one", F.lit(True)).groupBy("one").applyInArrow(fitted, "thresholds array<double>, weights binary").collect()  # one row
    if not got:
        return Model(grades, np.arange(len(grades) - 1, dtype=float), np.zeros(DIM))
    return Model(grades, np.array(got[0].thresholds), np.frombuffer(bytes(got[0].weights), "<f4"))


def score(model: Model, text: Column, reach: int | None = None) -> Column:
    """struct(expected_grade double, tail_probability double) of a text; a null or empty text has no word features.

    tail_probability is that of grade `reach` or more; by default of the upper half of the grades.
    """
    goal = model.grades[len(model.grades) // 2] if reach is None else reach
    at = min((i for i, g in enumerate(model.grades) if g >= goal), default=len(model.grades))

    @F.pandas_udf("expected_grade double, tail_probability double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            values = np.array([model.value(t or "") for t in texts])
            tail = np.ones(len(values)) if at == 0 else np.zeros(len(values)) if at > len(model.thresholds) else model.at_least(values)[:, at - 1]
            yield pd.DataFrame({"expected_grade": model.expected(values) if len(model.thresholds) else np.full(len(values), float(model.grades[0])), "tail_probability": tail})

    return scored(text)


def grade(docs: DataFrame, model: Model, limit: float = 0.5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, expected_grade, tail_probability, selected of each row of `docs`: one row for each, in any order.

    Null and empty texts are graded by their length alone. Repeated rows and null keys give rows of their own; other
    columns are not read. An empty table gives an empty result.
    """
    scored = docs.select(F.col(key), score(model, F.col(text)).alias("_s"))
    return scored.select(key, "_s.expected_grade", "_s.tail_probability", (F.col("_s.tail_probability") >= limit).alias("selected"))
