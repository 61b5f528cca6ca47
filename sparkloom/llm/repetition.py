"""Quality rules by repetition coverage.

``repetition_coverage`` measures, for every whole text, the characters inside repeated word n-grams of several
lengths and inside repeated lines, from rolling hashes in numpy, beside the base counts. One narrow pass: no
shuffle, memory bounded by a chunk of texts (or one longer text).

Defined cases: a null or empty text has no words, zero counts and shares of 0 and fails the base rule; a null
``doc_id`` stays null; repeated rows are each judged; other columns are not read. Lines are compared byte by byte.
Windows are compared by hashes modulo a prime under two random bases (see ``textkernel``), so two given unlike windows
of words of n bytes at most count as equal with a probability of about (n / 2**31)**2 + 2**-62.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textkernel as K
from .common import small_batches

#: n-gram length -> largest share of a text's word characters inside n-grams that it repeats.
NGRAM_LIMITS = {5: 0.40, 6: 0.38, 8: 0.35, 10: 0.30}
#: Largest share of a text's word characters in lines that it repeats.
LINE_LIMIT = 0.40
MIN_WORDS = 20
REPEAT_WINDOW = 8
REPEAT_PERCENT = 30
SYMBOLS = b"#*$%&|<>"

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, dup_line_share double, dup_ngram_shares array<double>"
)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_POINT = np.ones(256, bool)
_POINT[0x80:0xC0] = False


def line_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the lines of each text, and each line's text."""
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    ends = np.sort(np.concatenate([breaks, offsets[1:]]))
    per = np.diff(np.searchsorted(breaks, offsets)) + 1
    return starts, ends, np.repeat(np.arange(len(offsets) - 1), per)


def line_keys(data: np.ndarray, sums: list[np.ndarray], first: np.ndarray, last: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """A key for each line, equal for equal lines of one text alone: the bytes of those with equal hashes are compared."""
    keys = K.mix(K.hash_spans(sums, first, last) ^ K.mix(owner.astype(np.uint64)))
    line = lambda k: (owner[k], data[first[k] : last[k]].tobytes())
    seen: dict[int, tuple] = {}
    for k in np.flatnonzero(K.repeated(keys)).tolist():
        if line(k) != seen.setdefault(int(keys[k]), line(k)):
            numbers: dict[tuple, int] = {}
            return np.array([numbers.setdefault(line(k), len(numbers)) for k in range(len(keys))], np.uint64)
    return keys


def covered(at: np.ndarray, keys: np.ndarray, n: int, total: int) -> np.ndarray:
    """Of ``total`` words, those inside a window (its first word at ``at``) whose key occurs twice or more."""
    if not len(keys):
        return np.zeros(total, bool)
    hit = at[K.repeated(keys)]
    if not len(hit):
        return np.zeros(total, bool)
    edge = np.zeros(total + 1, np.int32)
    edge[hit] += 1
    np.subtract.at(edge, hit + n, 1)
    return np.cumsum(edge[:-1]) > 0


def measure(data: np.ndarray, offsets: np.ndarray, lengths: tuple[int, ...] = tuple(NGRAM_LIMITS)) -> dict[str, np.ndarray]:
    """Counts and shares for each text of a chunk."""
    texts = len(offsets) - 1
    starts, ends, ranges = K.spans(~K.WHITE[data], offsets)
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_POINT[data], out=points[1:])
    chars = points[ends] - points[starts]
    sums = K.prefix_sums(data)
    words = K.hash_spans(sums, starts, ends)
    word_chars = K.per_text(chars, ranges)
    out = {
        "n_words": np.diff(ranges),
        "word_chars": word_chars,
        "n_symbols": K.per_text(_SYMBOL[data], offsets),
    }
    first, last, owner = line_spans(data, offsets)
    in_line = np.searchsorted(starts, last) - np.searchsorted(starts, first)
    real = np.flatnonzero(in_line > 0)
    keys = line_keys(data, sums, first[real], last[real], owner[real])
    twice = K.repeated(keys)
    again = np.ones(int(twice.sum()), bool)
    if len(again):
        again[np.unique(keys[twice], return_index=True)[1]] = False
    out["n_dup_lines"] = np.bincount(owner[real][twice][again], minlength=texts)
    safe = np.maximum(word_chars, 1)
    line_chars = np.zeros(len(real), np.int64)
    if len(real):
        sums_chars = np.zeros(len(chars) + 1, np.int64)
        np.cumsum(chars, out=sums_chars[1:])
        line_chars = sums_chars[np.searchsorted(starts, last[real])] - sums_chars[np.searchsorted(starts, first[real])]
    out["dup_line_share"] = np.bincount(owner[real][twice], line_chars[twice], minlength=texts) / safe
    shares = []
    for n in (*lengths, REPEAT_WINDOW):
        at, text = K.window_owner(ranges, n)
        keys = K.mix(K.windows(words, n)[at] ^ K.mix(text.astype(np.uint64))) if len(at) else np.zeros(0, np.uint64)
        inside = covered(at, keys, n, len(words))
        shares.append(K.per_text(np.where(inside, chars, 0), ranges) / safe)
        if n == REPEAT_WINDOW:
            out["n_repeat_words"] = K.per_text(inside, ranges)
    out["dup_ngram_shares"] = np.stack(shares[: len(lengths)], 1)
    return out


def verdict(m: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > REPEAT_PERCENT * m["n_words"])
    over = (m["dup_ngram_shares"] > np.array(list(NGRAM_LIMITS.values()))).any(1) | (m["dup_line_share"] > LINE_LIMIT)
    return failed, ~failed & ~over


def repetition_coverage(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: base counts, the shares of duplicated characters, and the verdict."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            text = batch.column(1)
            for i, j, data, offsets in K.chunks(text):
                m = measure(data, offsets)
                failed, kept = verdict(m)
                ids = batch.column(0).slice(i, j - i)
                long = lambda k: pa.array(m[k].astype(np.int64))  # noqa: B023, E731
                shares = m["dup_ngram_shares"]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.cast(pa.int64()),
                        *(long(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
                        pa.array(failed),
                        pa.array(kept),
                        pa.array(m["dup_line_share"]),
                        pa.ListArray.from_arrays(
                            pa.array(np.arange(len(shares) + 1, dtype=np.int32) * shares.shape[1]), pa.array(shares.ravel())
                        ),
                    ],
                    names=[x.split()[0] for x in SCHEMA.split(", ")],
                )

    return docs.select(id_col, text_col).mapInArrow(run, SCHEMA)
