"""Toxicity: cumulative-link ordinal regression on sparse text features.

Grades are ordered; one weight per feature is shared by all thresholds:
``P(grade > k) = sigmoid(w.x - theta_k)``. A document's severity is its expected grade, the sum of
these probabilities, and it is rejected from ``cut`` upwards.

Features are present words and word beginnings. The model is fitted on a bounded sample of
labelled rows (``max_rows``, smallest hashes of doc_id first); its features are the ``max_features``
that shift the mean grade of the sample most, counted over the sample's whole texts. Every
document is scored on its whole text.

Defined results: null or empty text has no features and gets the severity of the thresholds alone;
labels that are null are ignored; without labels, or with one grade only, nothing is rejected and
severity is that grade (0 without labels); repeated rows are scored alike; an empty table gives an
empty result; of rows that repeat a labelled doc_id, the smallest text is fitted on; texts may have any
length; other columns, whatever their names, are returned by ``filter_documents`` untouched.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_or_empty

MAX_ROWS = 20_000
MAX_FEATURES = 2_000
MIN_DOCUMENTS = 3
#: Standard errors by which a feature must shift the mean grade: chance alone does so for one in 16,000.
MIN_SHIFT = 4.0
PREFIXES = (4, 6, 8)
RIDGE = 0.5
STEPS = 400
CUT = 0.5

_WORD = re.compile(r"[^\W\d_]+")


def features_of(text: str) -> set[str]:
    words = set(_WORD.findall(text.lower()))
    out = set(words)
    for n in PREFIXES:
        out.update([w[:n] + "-" for w in words if len(w) > n])
    return out


@dataclass
class Model:
    weights: dict[str, float]
    thresholds: list[float]
    low: float = 0.0

    def severity(self, text: str) -> float:
        weights = self.weights
        # in sorted order, so that the sum does not depend on the order of a set
        score = sum([weights[f] for f in sorted(features_of(text) & weights.keys())])
        return self.low + float(sum(1 / (1 + np.exp(np.clip(t - score, -500, 500))) for t in self.thresholds))


def fit_ordinal(rows: list[np.ndarray], grades: np.ndarray, n_features: int, *, ridge: float = RIDGE, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending thresholds by penalised likelihood; grades are 0, 1, ... without gaps."""
    levels = int(grades.max()) + 1
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    w = np.zeros(n_features)
    share = np.array([(grades > k).mean() for k in range(levels - 1)])
    theta = -np.log(share / (1 - share))
    # thresholds as a first one and logs of the steps between them
    free = np.concatenate([theta[:1], np.log(np.maximum(np.diff(theta), 1e-3))])
    m1 = m2 = None
    for step in range(1, steps + 1):
        theta = np.cumsum(np.concatenate([free[:1], np.exp(free[1:])]))
        z = np.bincount(owner, weights=w[flat], minlength=len(rows))
        p = 1 / (1 + np.exp(np.clip(theta - z[:, None], -50, 50)))  # P(grade > k)
        full = np.concatenate([np.ones((len(rows), 1)), p, np.zeros((len(rows), 1))], 1)
        at = np.arange(len(rows))
        chance = np.maximum(full[at, grades] - full[at, grades + 1], 1e-12)
        slope = p * (1 - p)
        sign = np.zeros_like(p)  # d chance / d p
        sign[at[grades > 0], grades[grades > 0] - 1] = 1
        inner = grades < levels - 1
        sign[at[inner], grades[inner]] = -1
        push = sign * slope / chance[:, None]  # d log chance / d (z - theta)
        grad_w = -np.bincount(flat, weights=push.sum(1)[owner], minlength=n_features) + ridge * w
        grad_theta = push.sum(0)
        tail = np.cumsum(grad_theta[::-1])[::-1]
        grad_free = np.concatenate([tail[:1], tail[1:] * np.exp(free[1:])])
        g = np.concatenate([grad_w, grad_free])
        m1 = g if m1 is None else 0.9 * m1 + 0.1 * g
        m2 = g * g if m2 is None else 0.999 * m2 + 0.001 * g * g
        if step == 1:
            m1, m2 = 0.1 * g, 0.001 * g * g
        move = 0.1 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
        w, free = w - move[:n_features], free - move[n_features:]
    return w, np.cumsum(np.concatenate([free[:1], np.exp(free[1:])]))


def fit(docs: DataFrame, labels: DataFrame, *, grade: str = "toxic", max_rows: int = MAX_ROWS, max_features: int = MAX_FEATURES) -> Model:
    sample = (
        labels.where(F.col(grade).isNotNull() & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(grade).cast("int").alias("grade"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    # one text per labelled doc_id, so that repeated doc_ids don't pass max_rows
    known = texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", "grade")).alias("m")).select("m.text", "m.grade")
    known = materialize(docs.sparkSession, known, "sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[str] = Counter()
        total: Counter[str] = Counter()
        for batch in batches:
            for text, g in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = features_of(text)
                n.update(found)
                if g:
                    total.update(dict.fromkeys(found, g))
        names = list(n)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([n[k] for k in names], pa.int64()), pa.array([total[k] for k in names], pa.int64())], ["f", "n", "s"])

    rows = known.groupBy("grade").count().collect()  # one row per grade
    grades = sorted(r.grade for r in rows)
    if len(grades) < 2:
        return Model({}, [], float(grades[0]) if grades else 0.0)
    size = sum(r["count"] for r in rows)
    mean = sum(r.grade * r["count"] for r in rows) / size
    spread = (sum(r.grade**2 * r["count"] for r in rows) / size - mean**2) ** 0.5
    shift = F.abs(F.col("s") - mean * F.col("n")) / (spread * F.sqrt(F.col("n") * (1 - F.col("n") / (size + 1.0))))
    chosen = (
        known.mapInArrow(count, "f string, n long, s long").groupBy("f").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        .where((F.col("n") >= MIN_DOCUMENTS) & (shift >= MIN_SHIFT)).orderBy(F.desc(shift), "f").limit(max_features).select("f")
    )
    names = sorted(r.f for r in chosen.collect())  # at most max_features
    index = {f: k for k, f in enumerate(names)}

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(index[f] for f in features_of(t) & index.keys()) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), batch.column(1)], ["x", "grade"])

    coded = known.mapInArrow(code, "x array<int>, grade int").toArrow()  # at most max_rows, as arrays, which are smaller than rows of Python lists
    found, given = coded["x"].combine_chunks(), coded["grade"].to_numpy()
    ends = np.append(0, np.cumsum(found.value_lengths().to_numpy(zero_copy_only=False)))
    flat = found.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    rows_of = [flat[a:b] for a, b in zip(ends.tolist(), ends[1:].tolist())]  # noqa: B905
    # big-endian bytes sort as the lists of numbers do
    order = sorted(range(len(given)), key=lambda k: (given[k], rows_of[k].astype(">i4").tobytes()))
    level = {g: k for k, g in enumerate(grades)}
    w, theta = fit_ordinal([rows_of[k] for k in order], np.array([level[given[k]] for k in order]), len(names))
    return Model({f: float(v) for f, v in zip(names, w, strict=True) if v}, [float(t) for t in theta], float(grades[0]))


def _scored(docs: DataFrame, model: Model, cut: float) -> DataFrame:
    """row (the document's own columns), severity, rejected."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text_or_empty().alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([round(model.severity(t), 9) for t in batch.column(1).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), found], ["row", "severity"])

    kind = packed.schema["row"].dataType.simpleString()
    scored = packed.mapInArrow(run, f"row {kind}, severity double")
    return scored.withColumn("rejected", (F.col("severity") >= cut) if model.thresholds else F.lit(False))


def score_documents(docs: DataFrame, model: Model, *, cut: float = CUT) -> DataFrame:
    """doc_id, severity (expected grade), rejected."""
    scored = _scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model, cut)
    return scored.select(F.col("row.doc_id").alias("doc_id"), "severity", "rejected")


def filter_documents(docs: DataFrame, labels: DataFrame, *, cut: float = CUT) -> DataFrame:
    """The documents that are not rejected, with their own columns."""
    return _scored(docs, fit(docs, labels), cut).where("not rejected").select(*[F.col("row")[c].alias(c) for c in docs.columns])
