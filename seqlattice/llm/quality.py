"""Quality classifier: ordinal cumulative-link regression on hashed text features.

P(grade >= k) = sigmoid(w . x - theta_k) with one weight vector for all grades and rising thresholds.  The fit takes a
bounded sample of labelled rows; features are made on the executors, and only their hashed numbers reach the driver.
Scoring is one pass over the texts without a shuffle.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import saved
from .words import pieces

_WORD = re.compile(r"\w+")
_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_PLAIN_MARKS = b".,;:'\"-()?"
_MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum() and b not in _PLAIN_MARKS)


def traits(text: str) -> list[str]:
    """Bucketed shares that describe a text as a whole."""
    raw = text.encode()
    words = raw.split()
    n, chars = len(words), max(len(raw), 1)
    share = lambda gone: (len(raw) - len(raw.translate(None, gone))) / chars
    length = int(math.log2(n + 1))
    distinct = len(set(words)) / n if n else 0
    repeats = sum(map(eq, words, words[1:])) / n if n else 0
    return [
        f" length {length}",
        f" distinct {length // 2} {int(10 * distinct)}",
        f" repeats {min(int(20 * repeats), 10)}",
        f" upper {min(int(20 * share(_UPPER)), 10)}",
        f" digits {min(int(40 * share(_DIGITS)), 10)}",
        f" marks {min(int(40 * share(_MARKS)), 10)}",
        f" lines {int(math.log2(raw.count(b'\n') + 1))}",
        f" mean {min(int(chars / (n + 1)), 20)}",
    ]


def _slot(feature: str, bits: int) -> int:
    return zlib.crc32(feature.encode()) & ((1 << bits) - 1)


def features(text: str | None, bits: int) -> list[int]:
    """Hashed slots of the distinct lower-case words and the traits of a text."""
    text = text or ""
    return sorted({_slot(w, bits) for w in [*set(_WORD.findall(text.lower())), *traits(text)]})


@dataclass(frozen=True)
class OrdinalModel:
    """Shared weights (one for each of 2^bits slots) and the thresholds of grades 1, 2, ..."""

    weights: np.ndarray
    thresholds: np.ndarray
    bits: int

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ... in columns."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -50, 50)))


def fit_rows(slots: list[np.ndarray], grades: np.ndarray, n_grades: int, bits: int, **options: float) -> OrdinalModel:
    """:func:`fit_flat` of an array of slots for each row."""
    return fit_flat(np.concatenate([np.asarray(x, np.int32) for x in slots]), np.array([len(x) for x in slots], np.int64), grades, n_grades, bits, **options)


def fit_flat(flat: np.ndarray, counts: np.ndarray, grades: np.ndarray, n_grades: int, bits: int, *, balance: float = 0.5, penalty: float = 2e-4, steps: int = 200, least_documents: int = 4) -> OrdinalModel:
    """Maximum likelihood with an absolute-value penalty by Adam and soft thresholds over all rows; slots seen in fewer than ``least_documents`` rows weigh nothing."""
    size = 1 << bits
    often = np.zeros(size, np.int64)
    for start in range(0, len(flat), 500_000):
        often += np.bincount(flat[start : start + 500_000], minlength=size)
    # rare slots become the one behind the last, which weighs nothing and keeps every row from being empty
    flat = np.insert(np.where(often[flat] >= least_documents, flat, np.int32(size)), np.cumsum(counts), np.int32(size))
    counts = counts + 1
    starts = np.cumsum(counts) - counts
    n_rows = len(counts)
    portions = [(a, min(a + 2000, n_rows)) for a in range(0, n_rows, 2000)]
    slots_of = [flat[starts[a] : starts[z - 1] + counts[z - 1]] for a, z in portions]
    share = np.bincount(grades, minlength=n_grades)[grades] / len(grades)
    weight = share**-balance / np.sum(share**-balance)  # of each row in the likelihood
    above = np.array([(np.sum(grades >= k) + 0.5) / (len(grades) + 1) for k in range(1, n_grades)])
    theta = np.sort(np.log(1 / above - 1)) if len(above) else np.zeros(0)
    gaps = np.log(np.maximum(np.diff(theta), 1e-2))
    w = np.zeros(size + 1, np.float32)
    first = theta[:1].copy()
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (w, first, gaps)]
    for step in range(1, steps + 1):
        theta = np.concatenate([first, first + np.cumsum(np.exp(gaps))])
        score = np.concatenate([np.add.reduceat(w[own], starts[a:z] - starts[a]) for (a, z), own in zip(portions, slots_of, strict=True)]).astype(np.float64)
        cdf = 1 / (1 + np.exp(np.clip(theta[None, :] - score[:, None], -50, 50)))  # P(grade >= k)
        edge = np.hstack([np.ones((n_rows, 1)), cdf, np.zeros((n_rows, 1))])
        here = np.arange(n_rows)
        low, high = edge[here, grades], edge[here, grades + 1]
        p = np.maximum(low - high, 1e-9)
        slope = edge * (1 - edge)
        d_low, d_high = slope[here, grades] / p, slope[here, grades + 1] / p
        d_low, d_high = d_low * weight, d_high * weight
        d_score = -(d_low - d_high)
        d_theta = np.array([np.sum(d_low[grades == k]) - np.sum(d_high[grades == k - 1]) for k in range(1, n_grades)])
        slope_w = np.zeros(size + 1)
        for (a, z), own in zip(portions, slots_of, strict=True):
            slope_w += np.bincount(own, weights=np.repeat(d_score[a:z], counts[a:z]), minlength=size + 1)
        slope_w[size] = 0
        grads = [slope_w, np.array([d_theta.sum()]), np.cumsum(d_theta[::-1])[::-1][1:] * np.exp(gaps)]
        for x, g, (m, v) in zip((w, first, gaps), grads, moments, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            scale = 0.1 / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
            x -= scale * m / (1 - 0.9**step)
            if x is w:
                w[:] = np.sign(w) * np.maximum(np.abs(w) - np.minimum(scale, 1e3) * penalty, 0)
    return OrdinalModel(w[:size], np.concatenate([first, first + np.cumsum(np.exp(gaps))]), bits)


def _slots(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    for rows in pieces(batches):
        slots = [features(t, bits) for t in rows["text"]]
        yield pa.RecordBatch.from_arrays([pa.array(rows["id"], pa.int64()), pa.array(rows["grade"], pa.int32()), pa.array(slots, pa.list_(pa.int32()))], names=["id", "grade", "slots"])


def fit(docs: DataFrame, ratings: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n_grades: int = 3, bits: int = 18, most_labels: int = 20000, most_slots: int = 16_000_000) -> OrdinalModel | None:
    """Fit on ``ratings(id, grade)`` with grades from 0 to ``n_grades - 1``.

    At most ``most_labels`` rated ids take part, those with the smallest hash, and of these the first whose texts have ``most_slots``
    hashed slots together: that bounds what the driver holds and what is broadcast to find their texts.  A text takes part
    with all its slots or not at all, as in scoring.  An id
    that is rated several times has its lowest grade; of rows that share it, one text takes part.  Null ids and null or foreign
    grades are left out.  Without two grades there is no model, and the result is None.
    """
    usable = ratings.select(F.col(id_col).alias("__id"), F.col("grade").cast("int").alias("grade")).where(F.col("__id").isNotNull() & F.col("grade").between(0, n_grades - 1))
    rated = usable.groupBy("__id").agg(F.min("grade").alias("grade")).orderBy(F.xxhash64("__id"), "__id").limit(most_labels)
    texts = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).alias("text"))
    own = texts.join(F.broadcast(rated), F.col("__doc") == F.col("__id")).select(F.col("__id").cast("bigint").alias("id"), "grade", "text")
    slots = own.mapInArrow(lambda it: _slots(it, bits), "id bigint, grade int, slots array<int>")
    found = saved(slots.groupBy("id", "grade").agg(F.min("slots").alias("slots")).withColumn("order", F.xxhash64("id")))
    sizes = sorted(found.select("order", "id", F.size("slots").alias("n")).collect())
    inside = [r for r, filled in zip(sizes, accumulate(r.n for r in sizes), strict=True) if filled <= most_slots]
    if not inside:
        return None
    last = inside[-1]
    rows = found.where((F.col("order") < last.order) | ((F.col("order") == last.order) & (F.col("id") <= last.id))).select("grade", "slots").toArrow()
    grades, slots = rows["grade"].to_numpy().astype(np.int64), rows["slots"].combine_chunks()
    if len(np.unique(grades)) < 2:
        return None
    return fit_flat(slots.flatten().to_numpy(), np.diff(slots.offsets.to_numpy()).astype(np.int64), grades, n_grades, bits)


def _score(batches: Iterator[pa.RecordBatch], model: OrdinalModel) -> Iterator[pa.RecordBatch]:
    known: dict[str, float] = {}
    weights, bits = model.weights, model.bits
    for rows in pieces(batches):
        scores = np.zeros(len(rows["text"]))
        for i, text in enumerate(rows["text"]):
            text = text or ""
            found = set(_WORD.findall(text.lower()))
            fresh = [w for w in found if w not in known]
            for w in fresh:
                known[w] = float(weights[_slot(w, bits)])
            scores[i] = sum(map(known.__getitem__, found)) + sum(float(weights[_slot(t, bits)]) for t in traits(text))
            if len(known) > 400_000:
                known.clear()
        tails = model.tails(scores)
        ids = [pa.array(rows["doc_id"], pa.int64())] if "doc_id" in rows else []
        yield pa.RecordBatch.from_arrays([*ids, pa.array(tails.sum(axis=1)), pa.array(tails[:, -1])], names=[*["doc_id"] * len(ids), "expected_grade", "tail_probability"])


def grade(docs: DataFrame, model: OrdinalModel | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, expected_grade, tail_probability``: one row for each row, the tail being that of the highest grade.

    Null and empty texts are graded as texts without words.  Without a model both numbers are null.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    if model is None:
        return rows.select("doc_id", F.lit(None).cast("double").alias("expected_grade"), F.lit(None).cast("double").alias("tail_probability"))
    return rows.mapInArrow(lambda it: _score(it, model), "doc_id bigint, expected_grade double, tail_probability double")


def tail_of(model: OrdinalModel) -> object:
    """A column function from text to the tail probability of the highest grade, to filter whole rows with."""

    @F.pandas_udf("double")
    def tail(texts):  # noqa: ANN001, ANN202
        import pandas as pd

        batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
        out = [b.column("tail_probability").to_numpy() for b in _score(iter([batch]), model)]
        return pd.Series(np.concatenate(out) if out else np.zeros(0))

    return tail


def grade_of_labels(quality: Column, toxic: Column) -> Column:
    """Ratings of 0 (poor), 1 (good but toxic) and 2 (good) from two labels; a null label gives a null grade."""
    return F.when(quality == 0, 0).when((quality == 1) & (toxic == 1), 1).when((quality == 1) & (toxic == 0), 2)
