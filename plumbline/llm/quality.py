"""Quality scores: a kernel ridge model over document statistics, calibrated.

Random Fourier features approximate a Gaussian kernel over the standardized
statistics of a document. Each partition sums its share of the normal equations, by
fold; ridge weights solve their total. Every training row is then scored by weights
that have not seen its fold, and isotonic regression over those scores calibrates.
"""

from __future__ import annotations

import operator
from collections import Counter
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from plumbline.llm.common import FOLDS, free_names, frugal_batches, held_out, table, written

FEATURES = 256
RIDGE = 1e-3
SEED = 4_242
KEEP_FROM = 0.3
ROWS_A_SUM = 100_000
BINS = 4_096
CLIP = 6.0

CLASSES = np.zeros(256, np.int64)  # lower, upper, digit, blank, line end, stop or comma, other sign, not ASCII
CLASSES[128:] = 7
for _i in range(128):
    _c = chr(_i)
    CLASSES[_i] = 0 if _c.islower() else 1 if _c.isupper() else 2 if _c.isdigit() else 4 if _c == "\n" else 3 if _c.isspace() else 5 if _c in ".,;:'" else 6


def statistics(text: str) -> list[float]:
    """What a whole text looks like; all zeros for an empty one."""
    words = text.split()
    if not words:
        return [0.0] * len(NAMES)
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    n, size = len(words), raw.sum()
    share = raw[raw > 0] / size
    kinds = np.bincount(CLASSES, weights=raw, minlength=8) / size
    lengths = np.fromiter(map(len, words), np.int64, n)
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    same = sum(map(operator.eq, words, islice(words, 1, None)))
    signs = [w for w in words if not w.isalnum()]
    return [
        np.log1p(n), lengths.mean(), min(lengths.std(), 50.0), np.log1p(lengths.max()), *kinds.tolist(),
        len(counts) / n, max(counts.values()) / n, same / n, sum(map(str.isupper, words)) / n, len(signs) / n,
        sum(1 for w in signs if not w[-1].isalnum() and not w[-2:-1].isalnum()) / n, np.log1p(len(lines)), np.log1p(n / max(1, len(lines))),
        1 - len(set(lines)) / max(1, len(lines)), -float((share * np.log2(share)).sum()), len(counts) / n**0.5 / 10, raw[124] / n, float((lengths == 1).mean()),
    ]


NAMES = [
    "words", "mean_length", "spread_of_length", "longest", "lower", "upper", "digits", "blanks", "line_ends", "stops", "signs", "not_ascii",
    "distinct", "most_frequent", "repeats", "capitals", "words_with_signs", "ends_in_signs", "lines", "words_a_line",
    "repeated_lines", "entropy", "richness", "bars", "single",
]


def described(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, x): the statistics of every row's whole text."""

    @frugal_batches
    def describe(batches):
        for batch in batches:
            x = [statistics(t or "") for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "held_out", "x"])

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(held_out(F.col("doc_id")), F.lit(True)).alias("held_out"), F.col("text").cast("string"))
    return rows.mapInArrow(describe, "doc_id long, held_out boolean, x array<double>")


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    project: np.ndarray
    shift: np.ndarray
    weights: np.ndarray  # a column for the final model, then one for each fold left out
    knots: np.ndarray
    levels: np.ndarray

    def lift(self, x: np.ndarray) -> np.ndarray:
        """Random Fourier features, with a constant."""
        z = np.clip((x - self.mean) / self.scale, -CLIP, CLIP)
        z = np.sqrt(2 / len(self.shift)) * np.cos(z @ self.project + self.shift)
        return np.hstack([z, np.ones((len(z), 1))])

    def raw(self, x: np.ndarray, folds: np.ndarray | None = None) -> np.ndarray:
        scores = self.lift(x) @ self.weights
        return scores[:, 0] if folds is None else scores[np.arange(len(x)), folds]

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.knots, self.levels), 0, 1) if len(x) else np.zeros(0)


def isotonic(at: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots and levels of the non-decreasing least-squares fit (pool adjacent violators)."""
    blocks: list[list[float]] = []  # sum of weights, of values, of places
    for p, v, w in zip(at, y, weight, strict=True):
        blocks.append([w, v * w, p * w])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[2] / b[0] for b in blocks]), np.array([b[1] / b[0] for b in blocks])


def _vector_sums(frame: DataFrame) -> pd.DataFrame:
    """(fold, i, v) summed over partitions, for each fold and row i."""
    add = lambda p: pd.DataFrame({"fold": [p["fold"].iloc[0]], "i": [p["i"].iloc[0]], "v": [np.sum(np.stack(p["v"].to_numpy()), axis=0)]})
    return frame.groupBy("fold", "i").applyInPandas(add, "fold int, i int, v array<double>").toPandas()


def fit(features: DataFrame, labels: DataFrame) -> Model:
    """Learns from the labelled rows of ``features`` (doc_id, held_out, x) that are not held out.

    All of them count, none are sampled; what reaches the driver is (FEATURES + 1)^2 numbers
    for each fold and BINS counts. Labels other than 0 and 1 are ignored, repeated labels of a
    document are averaged. Where nothing is labelled every score is 0.5.
    """
    asked = labels.where(F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg("quality").alias("y"))
    fold = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS).cast("int")
    rows = features.where(~F.col("held_out")).join(asked, "doc_id").select("x", "y", fold.alias("fold"))
    train = written(rows, "quality-train")
    width = len(NAMES)
    rng = np.random.default_rng(SEED)
    model = Model(np.zeros(width), np.ones(width), rng.standard_normal((width, FEATURES)) / np.sqrt(width), rng.uniform(0, 2 * np.pi, FEATURES), np.zeros((FEATURES + 1, FOLDS)), np.array([0.0]), np.array([0.5]))
    n = train.count()
    if not n:
        return model
    x = [F.col("x")[i] for i in range(width)]
    moments = train.agg(*(F.avg(c).alias(f"m{i}") for i, c in enumerate(x)), *(F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(x))).first()
    model.mean = np.array([moments[f"m{i}"] for i in range(width)])
    model.scale = np.array([moments[f"s{i}"] if moments[f"s{i}"] > 1e-9 else 1.0 for i in range(width)])

    @frugal_batches
    def equations(batches):
        total = np.zeros((FOLDS, FEATURES + 1, FEATURES + 2))
        for batch in batches:
            z = model.lift(np.array(batch.column(0).to_pylist()))
            y, f = np.array(batch.column(1)), np.array(batch.column(2))
            for k in np.unique(f):
                own = z[f == k]
                total[k] += own.T @ np.hstack([own, y[f == k, None]])
        for k in range(1, FOLDS):
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(total[k]), pa.int32()), pa.array(range(len(total[k])), pa.int32()), pa.array(list(total[k]), pa.list_(pa.float64()))], ["fold", "i", "v"])

    parts = train.repartition(max(1, -(-n // ROWS_A_SUM))).mapInArrow(equations, "fold int, i int, v array<double>")
    sums = np.zeros((FOLDS, FEATURES + 1, FEATURES + 2))
    for r in _vector_sums(parts).itertuples():
        sums[r.fold, r.i] = r.v
    for out in range(FOLDS):  # fold 0 is the held-out one: leaving it out leaves nothing out
        a = sums.sum(0) - (sums[out] if out else 0)
        model.weights[:, out] = np.linalg.solve(a[:, :-1] + RIDGE * max(1.0, a[-1, -2]) * np.eye(FEATURES + 1) / 10, a[:, -1])

    def spread(batches):
        hits, seen = np.zeros(BINS + 1), np.zeros(BINS + 1)
        for batch in batches:
            s = model.raw(np.array(batch.column(0).to_pylist()).reshape(-1, width), np.array(batch.column(2)))
            at = np.rint((np.clip(s, -0.5, 1.5) + 0.5) / 2 * BINS).astype(int)
            hits += np.bincount(at, np.array(batch.column(1)), BINS + 1)
            seen += np.bincount(at, minlength=BINS + 1)
        i = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(hits[i]), pa.array(seen[i])], ["bin", "hits", "seen"])

    bins = train.mapInArrow(spread, "bin int, hits double, seen double").groupBy("bin").agg(F.sum("hits").alias("hits"), F.sum("seen").alias("seen")).toPandas().sort_values("bin")
    model.knots, model.levels = isotonic(bins["bin"].to_numpy() / BINS * 2 - 0.5, (bins["hits"] / bins["seen"]).to_numpy(), bins["seen"].to_numpy())
    return model


def scored(features: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of ``features``."""

    def score(batches):
        for batch in batches:
            s = model.score(np.array(batch.column(2).to_pylist()).reshape(-1, len(NAMES)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= KEEP_FROM).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return features.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``; see ``fit`` for what it learns from.

    A score depends on the text alone. Null and empty texts are scored like any other, by
    statistics that are all zero. Repeated rows are scored each; a row without doc_id is
    scored but never learned from; an empty table gives no rows; other columns are ignored.
    """
    features = written(described(docs), "quality-features")
    return scored(features, fit(features, labels))


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, as they are, whose text scores KEEP_FROM or more."""
    at, (name,) = docs.columns.index("text"), free_names(["x"], docs.columns)

    @frugal_batches
    def describe(batches):
        for batch in batches:
            x = [statistics(t or "") for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(x, pa.list_(pa.float64()))], [*batch.schema.names, name])

    schema = StructType([*docs.schema.fields, StructField(name, ArrayType(DoubleType()))])
    rows = written(docs.mapInArrow(describe, schema), "quality-rows")
    model = fit(rows.select(F.col("doc_id").cast("long"), F.coalesce(held_out(F.col("doc_id")), F.lit(True)).alias("held_out"), F.col(name).alias("x")), labels)

    @frugal_batches
    def keep(batches):
        for batch in batches:
            x = np.array(batch.column(batch.num_columns - 1).to_pylist()).reshape(-1, len(NAMES))
            some = batch.filter(pa.array(model.score(x) >= KEEP_FROM))
            yield pa.RecordBatch.from_arrays(some.columns[:-1], some.schema.names[:-1])

    return rows.mapInArrow(keep, docs.schema)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
