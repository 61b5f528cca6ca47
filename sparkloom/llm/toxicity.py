"""Toxicity: a second-order factorization machine over hashed terms.

A term is a lower-cased word (a run of letters, ASCII or not) or the opening bytes of a longer one, so that a word
and its inflections share a term; pairs of terms interact through low-rank factors. Which terms count is decided by
their association with the label in a bounded sample of labelled rows, or in the rows of it that hold a term that
speaks for the label already, for a mention that is neutral by itself; the machine is then fitted to that sample.
Scoring is one narrow pass over whole texts.

Defined cases: a null or empty text has no terms and is scored by the bias alone; a null ``doc_id`` stays null, is
not held out and never learnt from; a null label is not learnt from; repeated rows are each scored; without any
usable label every score is 0; labels that are all alike give all texts one score near that label. Only the id and the text are read from ``docs``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .common import settle, small_batches
from .labelled import held_out, training_sample

#: Labelled rows to fit on, about; chosen by a hash of the id.
MAX_LABELLED = 24_000
#: Hashed terms that count, at most: those most associated with the label either way.
MAX_TERMS = 8_192
#: A term must be in so many rows of the sample.
MIN_ROWS = 3
#: Least association (a signed root of chi squared) for a term to count.
MIN_ASSOCIATION = 3.0
FACTORS = 6
STEPS = 160
L2_LINEAR, L2_FACTOR = 2e-4, 2e-3
#: Bytes of the openings that are terms beside the whole word.
OPENINGS = (6, 8)

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[0x80:] = True


def term_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text of a chunk, its distinct terms: (text of each term, term)."""
    if len(data):
        low = data.copy()
        upper = np.flatnonzero((data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97) & (data[:-1] == 0xC3)) + 1
        low[upper] += 0x20
        data = low
    starts, ends, ranges = K.spans(_LETTER[data], offsets)
    sums = K.prefix_sums(data, lower=True)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(ranges)).astype(np.uint64)
    terms, owners = [K.hash_spans(sums, starts, ends)], [owner]
    for n in OPENINGS:
        longer = np.flatnonzero(ends - starts > n)
        terms.append(K.mix(K.hash_spans(sums, starts[longer], starts[longer] + n), n))
        owners.append(owner[longer])
    term, owner = np.concatenate(terms), np.concatenate(owners)
    # 40 bits of term under 24 of text: one sort finds each text's distinct terms
    key = np.unique((owner << np.uint64(40)) | (term >> np.uint64(24)))
    return (key >> np.uint64(40)).astype(np.int64), (key & np.uint64((1 << 40) - 1)).astype(np.int64)


@dataclass
class Machine:
    terms: np.ndarray  # sorted
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def margin(self, owner: np.ndarray, at: np.ndarray, texts: int) -> np.ndarray:
        """owner, at: for each active term its text and its place in ``terms``."""
        out = np.full(texts, self.bias) + np.bincount(owner, self.linear[at], minlength=texts)
        for f in range(self.factors.shape[1]):
            v = self.factors[at, f]
            out += 0.5 * (np.bincount(owner, v, minlength=texts) ** 2 - np.bincount(owner, v * v, minlength=texts))
        return out

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        texts = len(offsets) - 1
        owner, at = self.active(*term_hashes(data, offsets))
        return 1 / (1 + np.exp(-np.clip(self.margin(owner, at, texts), -30, 30)))

    def active(self, owner: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.terms):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.terms, term), len(self.terms) - 1)
        hit = self.terms[at] == term
        return owner[hit], at[hit]


def train(owner: np.ndarray, at: np.ndarray, label: np.ndarray, terms: np.ndarray) -> Machine:
    """Full-batch Adam on the logistic loss; the rows are few enough to hold."""
    n, size = len(label), len(terms)
    rate = (label.sum() + 1) / (n + 2)
    rng = np.random.Generator(np.random.PCG64(11))
    params = [np.array([np.log(rate / (1 - rate))]), np.zeros(size), rng.normal(0, 0.02, (size, FACTORS))]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, STEPS + 1):
        m = Machine(terms, params[0][0], params[1], params[2])
        sums = np.stack([np.bincount(owner, params[2][at, f], minlength=n) for f in range(FACTORS)], 1)
        error = (1 / (1 + np.exp(-np.clip(m.margin(owner, at, n), -30, 30))) - label) / n
        e = error[owner]
        pull = np.stack(
            [np.bincount(at, e * (sums[owner, f] - params[2][at, f]), minlength=size) for f in range(FACTORS)], 1
        )
        grads = [np.array([error.sum()]), np.bincount(at, e, minlength=size) + L2_LINEAR * params[1] / 10, pull + L2_FACTOR * params[2] / 10]
        for p, g, a, b in zip(params, grads, first, second, strict=True):
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            p -= 0.08 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-9)
    return Machine(terms, float(params[0][0]), params[1], params[2])


def _terms_batches(batches):
    for batch in batches:
        for i, j, data, offsets in K.chunks(batch.column(1)):
            owner, term = term_hashes(data, offsets)
            edges = np.searchsorted(owner, np.arange(j - i + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.ListArray.from_arrays(pa.array(edges), pa.array(term))],
                names=["key", "label", "terms"],
            )


def _associated(each: DataFrame, n: float, ones: float):
    """(term, strength) of the terms most associated with the label, at most MAX_TERMS. ``each``: (label, term)."""
    counts = each.groupBy("term").agg(F.count("*").alias("rows"), F.sum("label").alias("hits"))
    expected = F.col("rows") * (ones / n)
    strength = (F.col("hits") - expected) / F.sqrt(expected * (1 - ones / n) + 0.5)
    counts = counts.filter(F.col("rows") >= MIN_ROWS).select("term", strength.alias("strength")).filter(F.abs("strength") >= MIN_ASSOCIATION)
    return counts.orderBy(F.abs("strength").desc(), "term").limit(MAX_TERMS).toPandas()


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", bound: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text") -> Machine:
    small_batches(docs.sparkSession)
    sample = training_sample(docs, labels, label, bound, id_col, text_col).select("key", "text", "label")
    sample = settle(sample.mapInArrow(_terms_batches, "key long, label int, terms array<long>"), "toxicity-sample")
    total = sample.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("ones")).first()
    constant = lambda bias: Machine(np.zeros(0, np.int64), bias, np.zeros(0), np.zeros((0, FACTORS)))
    if not total.n:
        return constant(-30.0)
    known = constant(float(np.log((total.ones + 0.5) / (total.n - total.ones + 0.5))))
    if not total.ones or total.n == total.ones:
        return known
    each = sample.select("key", "label", F.explode("terms").alias("term"))
    alone = _associated(each, float(total.n), float(total.ones))
    speaking = alone[alone["strength"] > 0]
    chosen = alone
    if len(speaking):
        found = each.join(F.broadcast(docs.sparkSession.createDataFrame([(t,) for t in speaking["term"].tolist()], "term long")), "term", "left_semi").select("key").distinct()
        near = sample.join(found, "key", "left_semi")  # rows of the bounded sample
        few = near.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("ones")).first()
        if 0 < few.ones < few.n:
            beside = _associated(near.select("key", "label", F.explode("terms").alias("term")), float(few.n), float(few.ones))
            chosen = pd.concat([alone, beside]).drop_duplicates("term")
    terms = np.sort(chosen["term"].to_numpy(np.int64)[:MAX_TERMS])
    if not len(terms):
        return known
    machine = Machine(terms, 0.0, np.zeros(len(terms)), np.zeros((len(terms), FACTORS)))

    def places(batches):
        for batch in batches:
            lists = batch.column(2)
            owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            owner, at = machine.active(owner, lists.flatten().to_numpy())
            edges = np.searchsorted(owner, np.arange(len(lists) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(edges), pa.array(at.astype(np.int32)))], names=["key", "label", "at"])

    rows = sample.mapInArrow(places, "key long, label int, at array<int>").toPandas().sort_values("key")  # bounded by the sample's bound
    owner = np.repeat(np.arange(len(rows)), [len(a) for a in rows["at"]])
    at = np.concatenate([np.asarray(a, np.int64) for a in rows["at"]]) if len(rows) else np.zeros(0, np.int64)
    return train(owner, at, rows["label"].to_numpy(float), terms)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    machine = fit(docs, labels, id_col=id_col, text_col=text_col)

    def run(batches):
        for batch in batches:
            for i, j, data, offsets in K.chunks(batch.column(1)):
                s = machine.score(data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"]
                )

    scored = docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")
