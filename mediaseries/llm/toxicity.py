"""Toxicity by a weighted lexicon.

Texts are lower-cased, look-alike letters of other scripts and digits inside words are folded to the Latin letters they
imitate, and an Aho-Corasick automaton finds the lexicon's words and word beginnings. Each word counts its heaviest
entry, none inside an exception phrase; the sum is put in proportion to the text's length and turned into a probability.

``learn`` takes entries and weights from a bounded sample of labelled texts: the log odds of holding the entry.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..session import stage
from .words import slices

# Letters of other scripts that look like Latin ones, and digits and signs that stand for letters.
LOOK_ALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "н": "h", "і": "i", "ї": "i", "ј": "j", "к": "k",
    "ӏ": "l", "м": "m", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l", "ⅰ": "i", "ⅽ": "c", "ⅾ": "d", "ⅿ": "m",
}
DIGIT_LETTERS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}
#: Phrases in which a word of the lexicon is harmless.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "the clown show", "stupid simple", "sore loser award")

_FOLD = str.maketrans(
    LOOK_ALIKES
    | {chr(0xFF41 + i): chr(97 + i) for i in range(26)}
    | {chr(0xFF10 + i): chr(48 + i) for i in range(10)}
    | {c: None for c in "​‌‍⁠﻿­"}
)
_DIGITS = str.maketrans(DIGIT_LETTERS)
_MIXED = re.compile(r"[@$]?[^\W\d_]+(?:[013-578@$!][^\W\d_]*)+(?=[^\w@$]|$)|[013-578@$]+[^\W\d_][^\W_]*")
_GAPS = re.compile(r"[\W_]+")
#: Word beginnings that may become entries have these many letters.
BEGINNINGS = (4, 5, 6)


def folded(text: str) -> str:
    """The words of a text, folded, each with one blank before and after."""
    text = text.lower()
    if not text.isascii():
        text = text.translate(_FOLD)
    text = _MIXED.sub(lambda m: m[0].rstrip("!").translate(_DIGITS) + " ", text)
    return f" {_GAPS.sub(' ', text).strip()} "


def entries_of(text: str) -> set[str]:
    """All entries a text holds: `` word `` for words and `` wor`` for beginnings."""
    words = set(folded(text).split())
    return {f" {w} " for w in words} | {f" {w[:k]}" for w in words for k in BEGINNINGS if len(w) > k}


def automaton(weights: Mapping[str, float], exceptions: Sequence[str]):
    import ahocorasick

    built = ahocorasick.Automaton()
    for phrase in exceptions:
        built.add_word(folded(phrase), (len(folded(phrase)), None))
    for entry, weight in weights.items():
        built.add_word(entry, (len(entry), weight))
    if len(built):
        built.make_automaton()
    return built


def weigh(built, text: str) -> tuple[float, int]:
    """The summed weight of a text's words and how many words it has."""
    line = folded(text)
    words = line.count(" ") - 1 if line.strip() else 0
    if not words or not len(built):
        return 0.0, words
    heaviest: dict[int, float] = {}
    spared = []
    for end, (length, weight) in built.iter(line):
        begin = end - length + 1
        if weight is None:
            spared.append((begin, end))
        elif weight > heaviest.get(begin, 0.0):
            heaviest[begin] = weight
    for low, high in spared:
        for begin in [b for b in heaviest if low <= b < high]:
            del heaviest[begin]
    return sum(heaviest.values()), words


def density(weight: float, words: int) -> float:
    """The lexicon's share of a text, on a log scale; a few words of nothing keep short texts from extremes."""
    return math.log1p(100 * weight / (words + 20))


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    exceptions: tuple[str, ...]
    offset: float
    slope: float

    def probability(self, weight: float, words: int) -> float:
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, self.offset + self.slope * density(weight, words)))))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Offset and slope of a logistic curve, by Newton's steps."""
    design, coefficients = np.stack([np.ones_like(x), x], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ coefficients, -30, 30)))
        slope = design.T @ (y - p) - ridge * coefficients
        curve = design.T @ (design * (p * (1 - p))[:, None]) + ridge * np.eye(2)
        step = np.linalg.solve(curve, slope)
        coefficients = coefficients + step
        if np.abs(step).max() < 1e-9:
            break
    return float(coefficients[0]), float(coefficients[1])


def _count_entries(only: frozenset[str] | None):
    def count(batches):
        found = Counter()
        for batch in batches:
            for text in batch.column("text"):
                held = entries_of(text.as_py() or "")
                found.update(held if only is None else held & only)
        yield pa.record_batch([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["entry", "n"])

    return count


def _weights_of(model: Model, columns: Sequence[str]):
    def apply(batches):
        built = automaton(model.weights, model.exceptions)
        for batch in slices(batches):
            found = [weigh(built, t.as_py() or "") for t in batch.column("text")]
            kept = [batch.column(batch.schema.get_field_index(c)) for c in columns]
            yield pa.record_batch(
                [*kept, pa.array([w for w, _ in found], pa.float64()), pa.array([n for _, n in found], pa.int64()),
                 pa.array([model.probability(w, n) for w, n in found], pa.float64())],
                [*columns, "toxic_weight", "toxic_words", "score"],
            )

    return apply


def learn(
    docs: DataFrame, labels: DataFrame, sample_rows: int = 12_000, max_entries: int = 4096, exceptions: Sequence[str] = EXCEPTIONS
) -> Model:
    """Entries, weights and the curve, from at most ``sample_rows`` labelled texts.

    docs(doc_id, text) and labels(doc_id, toxic) meet on doc_id; several labels of an id count as toxic if one is.
    The sample is the labelled ids that come first by hash, so its ids may be broadcast, and of their rows, where ids are
    repeated, as many as the sample has. An entry needs toxic texts
    enough to be no accident and odds of at least e^3. NULL ids and labels are ignored; with no toxic or no clean
    text there is no lexicon and every text scores as any other.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    sample = stage(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), "toxicity-sample")
    if sample.count() > sample_rows:  # ids stand in several rows
        by_hash = [F.xxhash64("doc_id"), F.col("doc_id"), F.xxhash64("text")]
        sample = stage(sample.orderBy(*by_hash).limit(sample_rows), "toxicity-sample")
    sizes = {r["toxic"] > 0: r["n"] for r in sample.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(True, 0), sizes.get(False, 0)
    if not toxic or not clean:
        return Model({}, tuple(exceptions), -2.0, 0.0)
    least = max(3, round(0.008 * toxic))

    def counts(rows: DataFrame, only: frozenset[str] | None) -> DataFrame:
        return rows.select("text").mapInArrow(_count_entries(only), "entry string, n long").groupBy("entry").agg(F.sum("n").alias("n"))

    frequent = counts(sample.where("toxic > 0"), None).where(F.col("n") >= least).orderBy(F.desc("n"), "entry").limit(16 * max_entries)
    toxic_counts = {r["entry"]: r["n"] for r in frequent.collect()}
    clean_counts = {r["entry"]: r["n"] for r in counts(sample.where("toxic <= 0"), frozenset(toxic_counts)).collect()}
    odds = {
        e: math.log((n + 0.5) / (toxic + 1)) - math.log((clean_counts.get(e, 0) + 0.5) / (clean + 1)) for e, n in toxic_counts.items()
    }
    heavy = sorted((-round(w, 6), e) for e, w in odds.items() if w >= 3)[:max_entries]
    model = Model({e: -w for w, e in heavy}, tuple(exceptions), 0.0, 0.0)
    rows = sample.mapInArrow(_weights_of(model, ["toxic"]), "toxic int, toxic_weight double, toxic_words long, score double").collect()
    x = np.array([density(r["toxic_weight"], r["toxic_words"]) for r in rows])
    y = np.array([float(r["toxic"] > 0) for r in rows])
    return Model(model.weights, model.exceptions, *fit_logistic(x, y))


def score(docs: DataFrame, model: Model, columns: Sequence[str]) -> DataFrame:
    """``columns`` of every row of docs(text, ...) with toxic_weight, toxic_words and score in (0, 1).

    NULL and empty texts have no words and score as texts without any entry do. Rows with equal ids each give a row; an
    empty table gives none. Columns of ``docs`` with the names of the new ones are left out. A narrow map.
    """
    columns = [c for c in columns if c not in ("toxic_weight", "toxic_words", "score")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*[f"`{c}`" for c in columns]).schema.fields)
    carried = docs.select(*[f"`{c}`" for c in dict.fromkeys([*columns, "text"])])
    return carried.mapInArrow(_weights_of(model, columns), f"{schema}, toxic_weight double, toxic_words long, score double")
