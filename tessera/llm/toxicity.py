"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton on folded text.

Folding maps characters one to one: look-alikes of other scripts, full-width forms and accented letters to plain
letters, digits and signs that stand for letters to those letters. Entries are whole words or beginnings of words. Their
weights are log odds learnt from labelled texts; so are exceptions: two-word phrases that hold an entry and that texts
labelled clean use, whose hits do not count. The sum of a text's hits, divided by a slowly growing function of its
length, goes through a logistic curve fitted on the same texts.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage, text_or_empty

#: Labelled texts that a model is fitted on, chosen by a hash of their key: a documented bound on a classifier's sample.
SAMPLE = 20_000
#: The toxic texts that must hold an entry, and the chance of one entry or more that mean nothing.
SUPPORT, CHANCE = 4, 0.05
#: The least log odds of an entry: fifteen times as frequent in toxic texts.
ODDS = 2.7
#: Terms that a task counts before it hands them on, and the unit of uses beside texts in a count.
TERMS, _TEXTS = 200_000, 1 << 24
#: Lengths of beginnings of words that are tried as entries.
STEMS = (4, 5, 6, 7)

#: Characters that look like the letters before the colon, and digits and signs that stand for letters.
ALIKE = (
    "a:аɑα@4 b:ьβв8 c:сϲ( e:еєε3 g:ɡ9 h:һн i:іιїɩ1!|l k:кκ m:мт n:пη o:оοσ0 p:рρ q:ԛ s:ѕ5$ t:тτ7+ u:υս v:ѵν w:ԝω x:хχ y:уγү z:2"
)


def _table() -> dict[int, str]:
    table = {}
    for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFD", chr(c))[0].lower()
        if base.isascii() and base.isalpha():
            table[c] = base
    table |= {0xFF01 + k: chr(0x21 + k).lower() for k in range(94)}
    for group in ALIKE.split():
        letter, others = group.split(":", 1)
        for o in others:
            table.setdefault(ord(o), letter)
    return table | {c: "i" for c in (ord("l"), 0xFF4C, 0x13A, 0x13C, 0x13E, 0x142)}  # l, i and 1 fold to one letter


FOLD = _table()
#: Characters without width, which go before folding.
HIDDEN = dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])


def lowered(text: str) -> str:
    if not text.isascii():
        text = text.translate(HIDDEN)
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


#: Words as the contracts have them.
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _spans(low: str, folded: str) -> Iterator[tuple[int, str]]:
    """Where each word that has a letter starts, and its folded form without signs at its ends."""
    for m in _WORD.finditer(low):
        start, end = m.span()
        while start < end and not (low[start].isalpha() or low[start].isdigit()):
            start += 1
        while start < end and not (low[end - 1].isalpha() or low[end - 1].isdigit()):
            end -= 1
        if any(map(str.isalpha, low[start:end])):
            yield m.start(), folded[start:end]


def _words(low: str, folded: str) -> list[str]:
    return [w for _, w in _spans(low, folded)]


@dataclass
class Model:
    """Entries: (folded text, is a whole word) and weight. Exceptions: pairs of folded words. Curve: slope and shift."""

    entries: dict[tuple[str, bool], float]
    exceptions: frozenset[tuple[str, str]]
    slope: float = 1.0
    shift: float = -1.0

    def automaton(self) -> ahocorasick.Automaton:
        found: dict[str, list] = {}
        for (text, whole), weight in self.entries.items():
            found.setdefault(text, [0.0, 0.0])[whole] = weight
        a = ahocorasick.Automaton()
        for text, (stem, whole) in found.items():
            a.add_word(text, (len(text), stem, whole))
        if found:
            a.make_automaton()
        return a

    def measure(self, text: str, automaton: ahocorasick.Automaton) -> float:
        """The weights of the text's hits over 1 + log(1 + words / 50).

        An entry may start wherever no letter goes before it; of several that start at one place the heaviest counts. A
        hit counts for nothing if its word and the word before or after it are an exception.
        """
        if not len(automaton) or not text:
            return 0.0
        low = lowered(text)
        folded = low.translate(FOLD)
        hits: dict[int, float] = {}
        n = len(low)
        for last, (size, stem, whole) in automaton.iter(folded):
            start = last - size + 1
            if start and low[start - 1].isalpha():
                continue
            weight = max(stem, whole if last + 1 == n or not low[last + 1].isalpha() else 0.0)
            if weight > hits.get(start, 0.0):
                hits[start] = weight
        if hits and self.exceptions:
            starts, words = zip(*_spans(low, folded), strict=True) if any(map(str.isalpha, low)) else ((), ())
            hits = {at: weight for at, weight in hits.items() if not self._excepted(words, bisect_right(starts, at) - 1)}
        return sum(hits.values()) / (1 + np.log1p(len(text.encode().split()) / 50)) if hits else 0.0

    def _excepted(self, words: tuple[str, ...], k: int) -> bool:
        """Whether word k and one beside it are an exception."""
        return any(0 <= i < len(words) - 1 and words[i : i + 2] in self.exceptions for i in (k - 1, k))

    def score(self, measure: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * measure + self.shift, -30, 30))))


def fit(labelled: DataFrame, text: str = "text", label: str = "toxic") -> Model:
    """A model from all given rows with a label of 0 or 1 (a bounded sample: see `train`); other labels do not count.

    Words and beginnings of words are counted in the executors: in how many different texts they are, and how many
    different words of a text a beginning stands for; the odds go by the latter. An entry's surplus in toxic
    texts must be significant by a likelihood-ratio test among all terms tried, so the rule goes with the sample. No rows
    give no entries. Without entries, or when no text has a hit, nothing was learnt, and every text scores below 0.5. All
    terms and exceptions that pass are kept; there are no more than the words of the sample.
    """
    rows = labelled.select(text_or_empty(text).alias("text"), F.col(label).cast("int").alias("toxic")).where("toxic in (0, 1)")
    chosen = stage(rows.dropDuplicates(["text", "toxic"]), "labelled")  # a copy is no further evidence

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flushed(counts: tuple[Counter, Counter]) -> Iterator[pa.RecordBatch]:
            for toxic, found in enumerate(counts):
                terms, whole, packed = zip(*((t, w, n) for (t, w), n in found.items()), strict=True) if found else ((), (), ())
                values = np.array(packed, np.int64)
                columns = [pa.array(terms, pa.string()), pa.array(whole, pa.bool_())]
                columns += [pa.array(part * (label == toxic)) for part in (values & (_TEXTS - 1), values // _TEXTS) for label in (0, 1)]
                yield pa.RecordBatch.from_arrays(columns, names=["term", "whole", "clean", "toxic", "clean_uses", "toxic_uses"])
                found.clear()

        # A term's texts in the lower bits, its uses above them. What is counted goes on before it takes much memory.
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for t, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                low = lowered(t)
                mine = counts[toxic]
                words = set(_words(low, low.translate(FOLD)))
                found = Counter((w[:k], False) for w in words for k in STEMS if len(w) >= k)
                found.update((w, True) for w in words)
                for term, uses in found.items():
                    mine[term] += uses * _TEXTS + 1
                if len(mine) > TERMS:
                    yield from flushed(counts)
        yield from flushed(counts)

    nothing = lambda: Model({}, frozenset(), 1.0, -5.0)
    totals = {r.toxic: r.n for r in chosen.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_clean, n_toxic = totals.get(0, 0), totals.get(1, 0)
    if not n_toxic or not n_clean:
        return nothing()
    kinds = "term string, whole boolean, clean bigint, toxic bigint, clean_uses bigint, toxic_uses bigint"
    sums = [F.sum(c).alias(c) for c in ("clean", "toxic", "clean_uses", "toxic_uses")]
    counted = chosen.mapInArrow(terms, kinds).groupBy("term", "whole").agg(*sums)
    odds = F.log((F.col("toxic_uses") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean_uses") + 0.5) / (n_clean + 1))
    least = max(2, min(SUPPORT, n_toxic // 10))
    tried = stage(counted.where(F.col("toxic") >= least), "terms")
    n_tried = tried.count()
    if not n_tried:
        return nothing()
    # A find by chance has few toxic texts and happens to have no clean ones; the more terms are tried, the more of them.
    best = tried.where((odds >= ODDS) & (_evidence(n_clean, n_toxic) >= NormalDist().inv_cdf(CHANCE / n_tried) ** 2)).withColumn("weight", odds)
    rows = best.select("term", "whole", "weight", "toxic").collect()
    # A beginning that stands for one word only would catch other words by accident ("path" for "pathetic").
    single = Counter()
    for r in rows:
        if r.whole:
            for k in STEMS:
                single[r.term[:k]] = max(single[r.term[:k]], r.toxic)
    entries = {(r.term, r.whole): r.weight for r in rows if r.whole or single[r.term] < 0.8 * r.toxic}
    if not entries:
        return nothing()
    model = Model(entries, frozenset())
    model.exceptions = _exceptions(chosen, model)
    x, y = _measured(chosen, model)
    model.slope, model.shift = _curve(x, y)
    return model if x.any() and model.shift < 0 else nothing()


def _evidence(n_clean: int, n_toxic: int) -> Column:
    """Twice the log likelihood ratio of a term's toxic and clean texts against one share of both: chi-squared by chance."""
    n, held = n_clean + n_toxic, F.col("toxic") + F.col("clean")
    part = lambda k, of, total: F.when(k > 0, k * F.log(k * n / (of * total))).otherwise(0.0)
    sides = [part(F.col(c), held, total) + part(total - F.col(c), n - held, total) for c, total in (("toxic", n_toxic), ("clean", n_clean))]
    return 2 * (sides[0] + sides[1])


def _exceptions(chosen: DataFrame, model: Model) -> frozenset[tuple[str, str]]:
    """Two-word phrases with a hit that at least three clean texts use, and ten times as many as toxic ones."""

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = {t for t, w in model.entries if w}
        stems = tuple(t for t, w in model.entries if not w)
        for batch in batches:
            out = []
            for t, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                low = lowered(t)
                words = _words(low, low.translate(FOLD))
                hit = [w in whole or w.startswith(stems) for w in words]
                out += {(words[i], words[i + 1], toxic) for i in range(len(words) - 1) if hit[i] or hit[i + 1]}
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int32() if k == 2 else pa.string()) for k in range(3)], names=["a", "b", "toxic"])

    if not model.entries:
        return frozenset()
    texts = [F.sum(F.lit(1) - F.col("toxic")).alias("clean"), F.sum("toxic").alias("toxic")]
    found = chosen.mapInArrow(phrases, "a string, b string, toxic int").groupBy("a", "b").agg(*texts)
    return frozenset((r.a, r.b) for r in found.where("clean >= 3 and clean >= 10 * toxic").collect())


def _measured(chosen: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = model.automaton()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([model.measure(t, automaton) for t in batch.column(0).to_pylist()], pa.float64()), batch.column(1)], names=["x", "y"])

    got = chosen.mapInArrow(run, "x double, y int").toPandas()  # two numbers for each row of the bounded sample
    return got.x.to_numpy(float), got.y.to_numpy(float)


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve by Newton's method with a small ridge; the classes weigh the same."""
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    design, at = np.stack([x, np.ones_like(x)], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ at, -30, 30)))
        gradient = design.T @ (weight * (p - y)) + 1e-3 * at
        hessian = (design * (weight * p * (1 - p) + 1e-9)[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        at -= np.clip(step, -2, 2)
        if abs(step).max() < 1e-6:
            break
    return max(float(at[0]), 1e-3), float(at[1])


def held_out(key: Column) -> Column:
    """Rows kept from learning: crc32 of the key as text, modulo 5, is 0. A null key counts as the text 'null'."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("null")).cast("binary")) % 5 == 0


def score(model: Model, text: Column) -> Column:
    """The score of a text, 0 to 1. A null or empty text, and one without hits, gets the curve's value at 0."""

    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = model.automaton()
        for texts in parts:
            yield pd.Series([model.score(model.measure(t or "", automaton)) for t in texts], dtype="float64")

    return scored(text)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Model:
    """A model from labelled rows of `docs` that are not held out; `labels` has `key` and `label`.

    Of each label, sample / 2 keys at most are used, the first by a hash of the key, and of rows of one key the smallest
    text; so what is sent to the executors is bounded. Keys that are null, or held out, or in one table only, teach
    nothing.
    """
    marks = labels.select(F.col(key).alias("_k"), F.col(label).cast("int").alias("_toxic"))
    marks = marks.where(F.col("_k").isNotNull() & ~held_out(F.col("_k"))).distinct()
    halves = [marks.where(F.col("_toxic") == v).orderBy(F.xxhash64("_k"), "_k").limit(sample // 2) for v in (0, 1)]
    rows = docs.select(F.col(key).alias("_key"), text_or_empty(text).alias("_text"))
    known = rows.join(F.broadcast(halves[0].unionByName(halves[1])), F.col("_key") == F.col("_k"))
    known = known.groupBy("_k", "_toxic").agg(F.min("_text").alias("_text"))
    return fit(known, "_text", "_toxic")


def without_toxic(docs: DataFrame, model: Model, text: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows of `docs`, all their columns, whose score is below `limit`."""
    return docs.where(score(model, docs[text]) < limit)
