"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

1. ``statistics`` turns every whole text into a short vector of document statistics (shares of
   byte classes, repetition of words and shingles, lengths), with numpy over slices of texts.
2. Random Fourier features ``sqrt(2 / D) * cos(x W + b)`` of the standardised statistics
   approximate a Gaussian kernel; W and b come from a seed.
3. Each partition of labelled rows adds up its normal equations (D x D and D), by fold; Spark
   sums them, and the driver solves systems of that fixed size.  Equations are additive, so the
   scores that calibration needs are out of fold: the system without a fold is the difference.
4. Isotonic regression (pool adjacent violators) over the out-of-fold scores, counted on a fixed
   grid of ``GRID`` steps, maps raw scores to probabilities; between the blocks' centres it is
   interpolated, so that it keeps the order of raw scores.

All labelled rows outside the held-out fifth are used.  Label, lang, source and doc_id are no
inputs.

Defined results: a null text is the empty text, which is scored like any other; labels other
than 0 and 1 and labels without a document are ignored, repeated labels count each; without any
usable label every score is 0.5; repeated rows are scored one by one; a null doc_id is never held
out nor learnt from; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from leadlens.session import materialize

from .common import column, materialize_texts, slices, table, texts, utf8
from .shingles import shingles, words

FEATURES = 256  # D
RIDGE = 1e-3  # per labelled row
WIDTH = 1.5  # standard deviations: the kernel's width per dimension, times sqrt(dimensions)
SEED = 7
FOLDS = 5  # remainder 0 is held out
GRID = 2000  # steps of raw score between -0.5 and 1.5
THRESHOLD = 0.3

_CLASSES = {"lower": range(97, 123), "upper": range(65, 91), "digit": range(48, 58), "blank": b" \t\r\v\f", "line": b"\n",
            "stop": b".,;:'\"-()", "shout": b"!?", "bar": b"|", "symbol": b"#$%&*@^~=+<>{}[]\\_`/", "high": range(128, 256)}
_CLASS_OF = np.full(256, len(_CLASSES), np.int64)
for _i, _bytes in enumerate(_CLASSES.values()):
    _CLASS_OF[list(_bytes)] = _i
N_STATISTICS = len(_CLASSES) + 9


def _per_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(values)))
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _repetition(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Share of distinct values, and share of the commonest value, by text."""
    n = np.diff(offsets)
    ordered = hashes.copy()
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        ordered[a:b].sort()
    new = np.ones(len(ordered), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    new[offsets[:-1][n > 0]] = True
    runs = np.flatnonzero(new)
    lengths = np.diff(np.append(runs, len(ordered)))
    most = np.zeros(len(n), np.int64)
    np.maximum.at(most, np.searchsorted(offsets, runs, side="right") - 1, lengths)
    return _per_text(new, offsets) / np.maximum(n, 1), most / np.maximum(n, 1)


def statistics_of(array: pa.Array) -> np.ndarray:
    """(texts, N_STATISTICS) of a null-free string array."""
    raw, offsets = utf8(array)
    n = len(array)
    size = np.diff(offsets)
    k = len(_CLASSES) + 1
    counts = np.bincount(np.repeat(np.arange(n) * k, size) + _CLASS_OF[raw], minlength=n * k).reshape(n, k)
    word, at = words(array)
    n_words = np.diff(at)
    same = np.zeros(len(word), bool)
    same[1:] = word[1:] == word[:-1]
    same[at[:-1][n_words > 0]] = False
    three, three_at = shingles(array, 3)
    distinct_words, top_word = _repetition(word, at)
    distinct_three, top_three = _repetition(three, three_at)
    letters = np.maximum(counts[:, 0] + counts[:, 1], 1)
    total = np.maximum(size, 1)
    shares = np.sqrt(counts[:, :len(_CLASSES)] / total[:, None])
    others = [np.log1p(size) / 10, np.log1p(n_words) / 8, distinct_words, top_word, distinct_three, top_three,
              _per_text(same, at) / np.maximum(n_words, 1), counts[:, 1] / letters,
              np.minimum((size - counts[:, 3] - counts[:, 4]) / np.maximum(n_words, 1), 40) / 10]
    return np.column_stack([shares, *others])


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, x array<double>) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, ids = texts(batch), column(batch, "doc_id").cast(pa.int64())
            for lo, hi in slices(text):
                x = statistics_of(text.slice(lo, hi - lo))
                lists = pa.ListArray.from_arrays(np.arange(0, x.size + 1, N_STATISTICS, dtype=np.int32), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), lists], names=["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, x array<double>")


def _matrix(lists: pa.Array) -> np.ndarray:
    return np.asarray(lists.flatten()).reshape(len(lists), N_STATISTICS)


class Fourier:
    """Random features of a Gaussian kernel over standardised statistics."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, features: int = FEATURES, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.mean, self.deviation = mean, np.where(deviation > 1e-9, deviation, 1.0)
        self.w = rng.normal(size=(len(mean), features)) / (WIDTH * np.sqrt(len(mean)))
        self.b = rng.uniform(0, 2 * np.pi, features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.deviation, -8, 8)
        return np.column_stack([np.ones(len(x)), np.sqrt(2 / len(self.b)) * np.cos(z @ self.w + self.b)])


def fold(doc_id) -> F.Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)).cast("int")


def normal_equations(train: DataFrame, fourier: Fourier) -> dict[int, tuple[np.ndarray, np.ndarray, int]]:
    """Per fold: Z'Z, Z'y and the rows, summed by Spark over the partitions' sums."""
    width = len(fourier.b) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            y, folds = np.asarray(column(batch, "y")).astype(float), np.asarray(column(batch, "fold"))
            z = np.column_stack([fourier(_matrix(column(batch, "x"))), y])
            for f in np.unique(folds).tolist():
                part = z[folds == f]
                sums[f] = sums.get(f, 0) + part.T @ part
        for f, m in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(m.size, f), pa.int32()), pa.array(np.arange(m.size), pa.int32()), pa.array(m.ravel())],
                names=["fold", "cell", "v"])

    cells = train.select("x", "y", "fold").mapInArrow(run, "fold int, cell int, v double")
    out: dict[int, tuple[np.ndarray, np.ndarray, int]] = {}
    total: dict[int, np.ndarray] = {}
    # FOLDS * (D + 2)**2 numbers, whatever the input
    summed = cells.groupBy("fold", "cell").agg(F.sum("v").alias("v")).toPandas()
    for f, part in summed.groupby("fold"):
        m = np.zeros((width + 1) ** 2)
        m[part["cell"].to_numpy()] = part["v"].to_numpy()
        total[int(f)] = m.reshape(width + 1, width + 1)
    for f, m in total.items():
        out[f] = m[:width, :width], m[:width, width], int(round(m[0, 0]))
    return out


def solve(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    penalty = np.full(len(b), RIDGE * max(n, 1))
    penalty[0] = 1e-9
    return np.linalg.solve(a + np.diag(penalty), b)


def isotonic(x: np.ndarray, n: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over ascending x with n rows and y ones each: block centres and
    levels, the latter with half a row of each class so that no block is certain."""
    blocks: list[list[float]] = []  # sum of x, rows, ones
    for xi, ni, yi in zip(x.tolist(), n.tolist(), y.tolist()):
        blocks.append([xi * ni, ni, yi])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    centres = np.array([b[0] / b[1] for b in blocks])
    levels = np.array([(b[2] + 0.5) / (b[1] + 1) for b in blocks])
    return centres, np.maximum.accumulate(levels)


class Model:
    def __init__(self, fourier: Fourier | None, weights: np.ndarray | None, centres: np.ndarray, levels: np.ndarray):
        self.fourier, self.weights, self.centres, self.levels = fourier, weights, centres, levels

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.fourier is None:
            return np.full(len(x), 0.5)
        raw = self.fourier(x) @ self.weights
        # beyond the outermost centres towards 0 and 1, so that the order is kept
        centres = np.concatenate(([min(self.centres[0], -0.5) - 1e-6], self.centres, [max(self.centres[-1], 1.5) + 1e-6]))
        levels = np.concatenate(([self.levels[0] * 0.9], self.levels, [1 - (1 - self.levels[-1]) * 0.9]))
        return np.clip(np.interp(raw, centres, levels), 0.0, 1.0)


def fit(stats: DataFrame, labels: DataFrame) -> Model:
    """Learn from ``labels`` (doc_id, label 0/1) outside the held-out fold."""
    usable = labels.filter(F.col("label").isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("y"))
    train = stats.join(usable, "doc_id").withColumn("fold", fold(F.col("doc_id"))).filter("fold <> 0")
    train = materialize(train.select("x", "y", "fold"), "labelled")
    aggs = [f(F.get("x", F.lit(i))).alias(f"{k}{i}") for i in range(N_STATISTICS) for k, f in (("m", F.avg), ("s", F.stddev_pop))]
    row = train.agg(F.count(F.lit(1)).alias("n"), *aggs).first()
    if not row.n:
        return Model(None, None, np.zeros(1), np.full(1, 0.5))
    fourier = Fourier(np.array([row[f"m{i}"] for i in range(N_STATISTICS)]), np.array([row[f"s{i}"] for i in range(N_STATISTICS)]))
    parts = normal_equations(train, fourier)
    whole = [sum(p[i] for p in parts.values()) for i in range(3)]
    weights = solve(*whole)
    out_of_fold = {f: solve(*(w - v for w, v in zip(whole, p))) if whole[2] > p[2] else weights for f, p in parts.items()}

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z, folds = fourier(_matrix(column(batch, "x"))), np.asarray(column(batch, "fold"))
            raw = np.zeros(len(z))
            for f, w in out_of_fold.items():
                raw[folds == f] = z[folds == f] @ w
            step = np.clip(np.round((raw + 0.5) / 2 * GRID), 0, GRID)
            yield pa.RecordBatch.from_arrays([pa.array(step.astype(np.int32)), column(batch, "y")], names=["step", "y"])

    grid = train.mapInArrow(score, "step int, y int").groupBy("step").agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").alias("ones")).orderBy("step").toPandas()  # GRID + 1 rows at most
    centres, levels = isotonic(grid["step"].to_numpy() / GRID * 2 - 0.5, grid["n"].to_numpy(), grid["ones"].to_numpy())
    return Model(fourier, weights, centres, levels)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted.  ``labels``: (doc_id, label 0/1)."""
    stats = materialize_texts(statistics(docs), "statistics")
    model = fit(stats, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(model.score(_matrix(column(batch, "x"))))],
                                             names=["doc_id", "score"])

    scored = stats.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


def measured(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with all its columns and, as ``name``, the statistics of its text."""
    schema = StructType([*docs.schema.fields, StructField(name, ArrayType(DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = texts(batch)
            parts = [statistics_of(text.slice(lo, hi - lo)).ravel() for lo, hi in slices(text)]
            ends = np.arange(batch.num_rows + 1, dtype=np.int32) * N_STATISTICS
            yield batch.append_column(name, pa.ListArray.from_arrays(ends, pa.array(np.concatenate(parts) if parts else np.zeros(0))))

    return docs.mapInArrow(run, schema)


def keep(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more: texts are read once, and their statistics,
    written beside them, serve the fit and the scores."""
    name = "statistics"
    while name in docs.columns:
        name += "_"
    table = materialize_texts(measured(docs, name), "statistics")
    model = fit(table.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(name).alias("x")), labels)

    def score(x: pa.Array) -> pa.Array:
        return pa.array(model.score(_matrix(x)))

    return table.filter(F.arrow_udf(score, "double")(F.col(name)) >= threshold).drop(name)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return classify(table(spark, sf_dir, "documents"), labels)
