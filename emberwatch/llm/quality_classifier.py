"""Quality classifier: regularised quadratic discriminant analysis on transformed document statistics.

Each class of labels gets a mean and a covariance, shrunk towards the pooled one and then towards a multiple of the
identity. The score is the logistic function of the log-density difference (Mahalanobis distances through Cholesky factors
kept in the model, log-determinants, class shares). Labels, source and language are never inputs of a score.

Empty and null texts have all-zero counts and are scored like any other. With fewer than two labelled rows of either class
every score is the smoothed share of label 1. Null labels and labels of unknown documents are left out; repeated rows are
scored each.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberwatch.llm.common import by_place, pick
from emberwatch.llm.quality_rules import STOP_WORDS, SYMBOLS

TRAINING_ROWS = 20_000  # labelled rows that a fit takes at most, chosen by the hash of doc_id
TOWARDS_POOLED, TOWARDS_IDENTITY = 0.6, 0.01
THRESHOLD = 0.7
HOLD = 6
_STOP = {form.encode() for w in STOP_WORDS for form in (w, w.capitalize())}
_SYMBOLS, _UPPER = SYMBOLS.encode(), bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123))
NAMES = [
    "log_words", "word_length", "symbols", "upper", "distinct", "stop", "exclamations", "equal_lines", "equal_neighbours",
    "lines",
]


def statistics(text: str | None) -> list[float]:
    """Transformed statistics of a whole text: ratios, held back by a few words so that short texts are not outliers, go
    through square roots, sizes through logarithms."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words) + HOLD
    chars = sum(map(len, words))
    letters = len(raw) - len(raw.translate(None, _LETTERS))
    upper = len(raw) - len(raw.translate(None, _UPPER))
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    neighbours = sum(map(operator.eq, words, words[1:]))
    stop = sum(map(_STOP.__contains__, words))
    return [
        np.log1p(len(words)),
        np.log1p((chars + 5 * HOLD) / n),
        (symbols / n) ** 0.5,
        (upper / (letters + 5 * HOLD)) ** 0.5,
        np.log(len(set(words)) + HOLD) / np.log(n),
        ((stop + HOLD / 3) / n) ** 0.5,
        (raw.count(b"!") / n) ** 0.5,
        ((len(lines) - len(set(lines))) / (len(lines) + HOLD)) ** 0.5,
        (neighbours / n) ** 0.5,
        np.log(len(lines) + HOLD) / np.log(n + HOLD),
    ]


@dataclass(frozen=True)
class Discriminant:
    """Fitted densities of the two classes over standardised statistics; ``factors`` are inverse Cholesky factors."""

    constant: float | None
    centre: np.ndarray | None = None
    scale: np.ndarray | None = None
    means: np.ndarray | None = None
    factors: np.ndarray | None = None
    offsets: np.ndarray | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        z = (x - self.centre) / self.scale
        logs = [o - 0.5 * (((z - m) @ f.T) ** 2).sum(1) for m, f, o in zip(self.means, self.factors, self.offsets)]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))


def fit(x: np.ndarray, y: np.ndarray, pooled: float = TOWARDS_POOLED, identity: float = TOWARDS_IDENTITY) -> Discriminant:
    sizes = [int((y == k).sum()) for k in (0, 1)]
    if min(sizes) < 2:
        return Discriminant((sizes[1] + 1) / (sum(sizes) + 2))
    centre, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = (x - centre) / scale
    means = np.stack([z[y == k].mean(0) for k in (0, 1)])
    own = [np.cov(z[y == k].T) for k in (0, 1)]
    common = sum(s * c for s, c in zip(sizes, own)) / sum(sizes)
    factors, offsets = [], []
    for k in (0, 1):
        cov = (1 - pooled) * own[k] + pooled * common
        cov = (1 - identity) * cov + identity * max(np.trace(cov) / len(cov), 1e-6) * np.eye(len(cov))
        root = np.linalg.cholesky(cov)
        factors.append(np.linalg.inv(root))
        offsets.append(np.log(sizes[k] / sum(sizes)) - np.log(np.diag(root)).sum())
    return Discriminant(None, centre, scale, means, np.stack(factors), np.array(offsets))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [statistics(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("quality"), pa.array(rows, pa.list_(pa.float64()))], ["quality", "x"]
        )


def fit_quality(docs: DataFrame, labels: DataFrame, most: int = TRAINING_ROWS) -> Discriminant:
    """Fit on at most ``most`` labelled rows of ``labels(doc_id, quality)``; callers leave held-out rows out of it."""
    chosen = pick(labels, "doc_id", "quality").where("doc_id is not null and quality in (0, 1)")
    chosen = chosen.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(most)
    rows = pick(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "quality")
    # Repeated documents could make more rows than labels were chosen.
    rows = rows.select("quality", "text").mapInArrow(_measure, "quality int, x array<double>").limit(most).toPandas()
    order = sorted(range(len(rows)), key=lambda i: (rows["quality"][i], tuple(rows["x"][i])))
    x = np.array([rows["x"][i] for i in order], float).reshape(len(rows), len(NAMES))
    return fit(x, rows["quality"].to_numpy(int)[order])


def _scores(model: Discriminant, text: str = "text"):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t) for t in batch.column(text).to_pylist()], float).reshape(-1, len(NAMES))
            columns = [batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(model.score(x), pa.float64())], [*batch.schema.names, "__score"]
            )

    return run


def score_quality(docs: DataFrame, model: Discriminant) -> DataFrame:
    """``doc_id, held_out, score, predicted`` per row of ``docs(doc_id, text)``."""
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = rows.mapInArrow(_scores(model), "doc_id long, text string, __score double")
    return scored.select(
        "doc_id", held_out(), F.col("__score").alias("score"), (F.col("__score") >= THRESHOLD).cast("int").alias("predicted")
    )


def held_out():
    """Rows that no fit sees: crc32 of doc_id as text leaves 2 when divided by 4."""
    rest = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 4
    return F.coalesce(rest == 2, F.lit(False)).alias("held_out")


def keep_scored(docs: DataFrame, model: Discriminant, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` with at least ``threshold``, with the columns of ``docs``, whatever else these are called."""
    rows, (text,) = by_place(docs, "text")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields) + ", __score double"
    scored = rows.mapInArrow(_scores(model, text), schema)
    return scored.where(F.col("__score") >= threshold).select(*rows.columns).toDF(*docs.columns)
