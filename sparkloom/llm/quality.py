"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

The features of labelled rows (a bounded sample in ``classify``, all in ``keep_good``) go through cosines with random
frequencies (an approximate Gaussian kernel). Each partition sums its part of the normal equations, one sum per fold;
tasks add the sums and the driver solves them. Scores of left-out folds are calibrated by isotonic regression: each
range of scores is pooled in a task, and the pools of all ranges on the driver. Scoring is one narrow pass.

Defined cases: a null or empty text is scored by its (zero) statistics; a null ``doc_id`` stays null, is not held
out and never learnt from; a null label is not learnt from; repeated rows are each scored, and kept or rejected, alike;
without any usable label every score is 0.5; an empty table gives an empty result. Only the id and the text are read
from ``docs``, whatever else it holds; ``keep_good`` hands all columns on, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .common import release, settle, small_batches
from .decontaminate import add_up
from .labelled import fold, held_out, training_sample, usable_labels
from .repetition import line_spans

#: Labelled rows that ``classify`` fits on, about; chosen by a hash of the id.
MAX_LABELLED = 30_000
FREQUENCIES = 160
#: Kernel width and ridge, for standardised statistics.
GAMMA = 0.25
RIDGE = 1e-3
FIT_FOLDS = 4
THRESHOLD = 0.3


def _class(chars: bytes) -> np.ndarray:
    t = np.zeros(256, np.uint8)
    t[list(chars)] = 1
    return t


_CLASSES = [
    _class(b"#*$%&<>@^~="),
    _class(b"!"),
    _class(b"|"),
    _class(bytes(range(65, 91))),
    _class(bytes(range(97, 123))),
    _class(b"0123456789"),
    _class(b".,;:?"),
    _class(bytes(range(0x80, 0xC0))),
    _class(bytes(range(0xC0, 0x100))),
]
N_STATISTICS = 16


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of N_STATISTICS numbers for each text of a chunk."""
    texts = len(offsets) - 1
    starts, ends, ranges = K.spans(~K.WHITE[data], offsets)
    n_words = np.diff(ranges)
    words = np.maximum(n_words, 1)
    size = np.diff(offsets)
    counts = [K.per_text(c[data], offsets) for c in _CLASSES]
    symbols, bangs, bars, upper, lower, digits, stops, inner, lead = counts
    chars = np.maximum(size - inner, 1)
    letters = np.maximum(upper + lower + lead, 1)
    sums = K.prefix_sums(data, lower=True)
    hashes = K.hash_spans(sums, starts, ends)
    owner = np.repeat(np.arange(texts), n_words)
    same = np.zeros(len(hashes), bool)
    if len(hashes) > 1:
        same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    keys = np.sort(K.mix(hashes ^ K.mix(owner.astype(np.uint64))))
    distinct = np.zeros(texts)
    if len(keys):
        repeats = np.zeros(len(hashes), bool)
        own = K.mix(hashes ^ K.mix(owner.astype(np.uint64)))
        order = np.argsort(own, kind="stable")
        repeats[order[1:]] = own[order[1:]] == own[order[:-1]]
        distinct = 1 - K.per_text(repeats, ranges) / words
    at, text = K.window_owner(ranges, 3)
    keys = K.mix(K.windows(hashes, 3)[at] ^ K.mix(text.astype(np.uint64))) if len(at) else np.zeros(0, np.uint64)
    twice = np.bincount(text[K.repeated(keys)], minlength=texts) / words
    first, last, line_owner = line_spans(data, offsets)
    lines = np.bincount(line_owner, minlength=texts)
    return np.stack(
        [
            np.log1p(n_words),
            np.log1p((size - inner) / words),
            np.sqrt(symbols / chars),
            np.sqrt(bangs / words),
            np.sqrt(bars / words),
            upper / letters,
            digits / chars,
            stops / words,
            K.per_text(same, ranges) / words,
            distinct,
            np.minimum(twice, 1),
            np.log1p(n_words / np.maximum(lines, 1)),
            lead / letters,
            np.log1p(bangs),
            np.log1p(bars),
            np.log1p(symbols),
        ],
        1,
    ).astype(np.float64)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # of all rows, or one row per fold left out
    steps: np.ndarray  # isotonic: raw scores and calibrated values
    values: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        rng = np.random.Generator(np.random.PCG64(7))
        freq = rng.normal(0, np.sqrt(2 * GAMMA / N_STATISTICS), (N_STATISTICS, FREQUENCIES))
        phase = rng.uniform(0, 2 * np.pi, FREQUENCIES)
        wave = np.cos(z @ freq + phase) * np.sqrt(2 / FREQUENCIES)
        return np.hstack([np.ones((len(x), 1)), z * 0.1, wave])

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.steps):
            return np.full(len(x), 0.5)
        raw = self.features(x) @ self.weights
        return np.clip(np.interp(raw, self.steps, self.values), 0, 1)


def isotonic(raw: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The non-decreasing least-squares fit, as points to interpolate between."""
    return _points(_pooled(_scores(raw, label)))


def _scores(raw: np.ndarray, label: np.ndarray) -> list[tuple[float, float, float]]:
    """Sum of labels, rows and sum of raw scores of each distinct score, in order."""
    scores, place = np.unique(raw, return_inverse=True)  # equal scores have one value
    rows, ones = np.bincount(place, minlength=len(scores)), np.bincount(place, label, minlength=len(scores))
    return list(zip(ones.tolist(), rows.astype(float).tolist(), (scores * rows).tolist(), strict=True))


def _pooled(found: list[tuple[float, float, float]]) -> list[list[float]]:
    """The blocks with adjacent violators pooled; those of a part of the scores may be pooled on with the others'."""
    blocks: list[list[float]] = []
    for block in found:
        blocks.append(list(block))
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            y1, n1, r1 = blocks.pop()
            blocks[-1][0] += y1
            blocks[-1][1] += n1
            blocks[-1][2] += r1
    return blocks


def _points(blocks: list[list[float]]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([r / n for _, n, r in blocks]), np.array([(y + 0.5) / (n + 1) for y, n, _ in blocks])


def _statistics_batches(batches):
    release()
    for batch in batches:
        for i, j, data, offsets in K.chunks(batch.column(1)):
            x = statistics(data, offsets)
            arrays = [batch.column(0).slice(i, j - i), *(c.slice(i, j - i) for c in batch.columns[2:])]
            rows = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * N_STATISTICS), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*arrays, rows], names=["key", *batch.schema.names[2:], "x"])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), N_STATISTICS)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", bound: int | None = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The model of about ``bound`` labelled rows, or of all of them."""
    small_batches(docs.sparkSession)
    if bound is None:  # the statistics are joined, not the texts
        rows = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).alias("text")).filter(fold("key") != 0)
        sample = rows.mapInArrow(_statistics_batches, "key long, x array<double>").join(usable_labels(labels, label, id_col), "key").select("key", "label", "x")
    else:
        rows = training_sample(docs, labels, label, bound, id_col, text_col).select("key", "text", "label")
        sample = rows.mapInArrow(_statistics_batches, "key long, label int, x array<double>")
    sample = settle(sample, "quality-sample")
    moments = sample.select(*[F.struct(F.avg(F.col("x")[i]), F.stddev_pop(F.col("x")[i])) for i in range(N_STATISTICS)]).first()
    empty = Model(np.zeros(N_STATISTICS), np.ones(N_STATISTICS), np.zeros(0), np.zeros(0), np.zeros(0))
    if moments is None or moments[0][0] is None:
        return empty
    model = Model(np.array([m[0] for m in moments]), np.array([max(m[1], 1e-6) for m in moments]), np.zeros(0), np.zeros(0), np.zeros(0))
    folded = sample.withColumn("part", F.pmod(F.xxhash64("key", F.lit(1)), F.lit(FIT_FOLDS)).cast("int"))
    size = 1 + N_STATISTICS + FREQUENCIES

    def sums(batches):
        total = np.zeros((FIT_FOLDS, size, size + 1))
        for batch in batches:
            f, y, part = model.features(_matrix(batch.column(2))), batch.column(1).to_numpy(), batch.column(3).to_numpy()
            for k in range(FIT_FOLDS):
                g = f[part == k]
                total[k] += g.T @ np.hstack([g, y[part == k][:, None]])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    total = add_up(folded.mapInArrow(sums, "sums binary"), (FIT_FOLDS, size, size + 1), "<f8")
    ridge = lambda g: np.linalg.solve(g[:, :-1] + RIDGE * max(g[0, 0], 1) * np.eye(size) / size, g[:, -1])
    left_out = np.stack([ridge(total.sum(0) - total[k]) for k in range(FIT_FOLDS)])
    model.weights = ridge(total.sum(0))

    def scored(batches):
        for batch in batches:
            f, part = model.features(_matrix(batch.column(2))), batch.column(3).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array((f * left_out[part]).sum(1)), batch.column(1)], names=["raw", "label"])

    def pool(batches):
        table = pa.Table.from_batches(list(batches), pa.schema([("raw", pa.float64()), ("label", pa.int32())]))
        blocks = _pooled(_scores(table["raw"].to_numpy(), table["label"].to_numpy()))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.float64()) for x in np.array(blocks).reshape(-1, 3).T], names=["ones", "n", "raw"])

    # equal scores are in one range; a range's pools are far fewer than its rows
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = settle(folded.mapInArrow(scored, "raw double, label int"), "quality-scores").repartitionByRange(parts, "raw")
    blocks = sorted(ranges.mapInArrow(pool, "ones double, n double, raw double").collect(), key=lambda b: b.raw / b.n)
    model.steps, model.values = _points(_pooled(blocks))
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) of every row."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for i, j, data, offsets in K.chunks(batch.column(1)):
                s = model.score(statistics(data, offsets))
                predicted = pa.array((s >= THRESHOLD).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(s), predicted], names=["doc_id", "score", "predicted"])

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, "doc_id long, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    model = fit(docs, labels, id_col=id_col, text_col=text_col)
    return score(docs, model, id_col, text_col).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not rejected, all columns as they were, by a model of all labelled rows. One narrow
    pass after the fit."""
    model = fit(docs, labels, bound=None, id_col=id_col, text_col=text_col)
    at = docs.columns.index(text_col)

    def run(batches):
        release()
        for batch in batches:
            keep = [model.score(statistics(data, offsets)) >= THRESHOLD for _, _, data, offsets in K.chunks(batch.column(at))]
            if keep:
                yield batch.filter(pa.array(np.concatenate(keep)))

    return docs.mapInArrow(run, docs.schema)
