"""Benchmark decontamination by latent semantic retrieval.

The vocabulary is that of the benchmark; the counts behind its inverse frequencies cover all documents. A randomised
SVD of TF-IDF passages (the benchmark's items and the windows of all documents) is built from sums over partitions:
the passages' known words are written once, packed, and each step reads them and sends back a matrix of vocabulary by
rank. Every window of every document is then compared
with all items by the cosine in the latent space, unless the length of its latent vector rules all of them out. A text that has SHORT_WORDS words in a row of an item is a candidate too, whatever its
cosine, so no literal copy is missed. Candidates are checked where they are found, on whole texts: the longest common
subsequence of words with the item, and, for the less than literal ones, the words of the item's answer (its last
sentence). Nothing but results is shuffled.

The benchmark is taken in blocks of ITEM_BLOCK items, which bounds what is broadcast; a block's items share the passes
over the documents, and each BASIS_ITEMS of them have a basis of their own, whose rank keeps most of their energy.
Items under SHORT_WORDS words have no useful direction; they must occur word by word, which hashes of word runs decide.

Defined cases: a null or empty text, or item, has no words and no leak; a null ``doc_id`` or ``item_id`` is carried;
repeated rows of documents or items give results for each; empty tables give none; of equal windows the first counts.
``contamination`` reads no other column; ``drop_leaks`` hands all columns on, whatever their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .common import release, settle, small_batches

BLOCK_WORDS = 16
#: Windows, in blocks; each starts at every block.
WINDOWS = (1, 2, 4)
RANK, OVERSAMPLE, POWER_STEPS = 192, 8, 2
#: Words of a passage that the basis is fitted on; passages that are multiplied at a time.
PASSAGE, PASSAGES = 64, 32
ITEM_BLOCK = 2_000
#: Items that share a basis: hardly more than its rank, or an item keeps only a small part of its energy.
BASIS_ITEMS = 200
SHORT_WORDS = 8
#: Blocks whose words' latent vectors are gathered at a time.
PIECE = 128
#: Least cosine in the latent space; least dot product against the whole norms, times the part of the item's energy
#: that the basis keeps.
LEAST_COSINE, LEAST_DOT = 0.45, 0.2
#: A leak has so much of the item's words in order; below LITERAL, its answer's words as well.
LEAST_LCS, LITERAL, LEAST_ANSWER = 0.62, 0.7, 0.4

_IN_WORD = np.zeros(256, bool)
_IN_WORD[48:58] = _IN_WORD[65:91] = _IN_WORD[97:123] = True
_IN_WORD[0x80:] = True
SCHEMA = "doc_id long, item_id long, cosine double, lcs_share double, answer_share double"


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words (runs of letters and digits) of a chunk, and each text's range of them."""
    if len(data) > 1:
        upper = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        if len(upper):
            data = data.copy()
            data[upper] += 0x20
    starts, ends, ranges = K.spans(_IN_WORD[data], offsets)
    return K.hash_spans(K.prefix_sums(data, lower=True), starts, ends), ranges


def text_words(text: str) -> np.ndarray:
    for _, _, data, offsets in K.chunks(pa.array([text])):
        return words_of(data, offsets)[0]
    return np.zeros(0, np.uint64)


@dataclass
class Item:
    item_id: int | None
    words: np.ndarray
    answer: np.ndarray
    masks: dict[int, int] = field(default_factory=dict)

    @classmethod
    def of(cls, item_id: int | None, text: str | None) -> Item:
        words = text_words(text or "")
        sentences = [s for s in re.split(r"(?<=[.!?])\s+|\n", text or "") if len(text_words(s))]
        answer = np.unique(text_words(sentences[-1])) if len(sentences) > 1 else np.unique(words)
        item = cls(item_id, words, answer)
        for i, w in enumerate(words.tolist()):
            item.masks[w] = item.masks.get(w, 0) | 1 << i
        return item

    def lcs(self, other: list[int]) -> int:
        """Length of the longest common subsequence, bit-parallel over the item's words."""
        full = (1 << len(self.words)) - 1
        row, masks = full, self.masks
        for w in other:
            m = masks.get(w)
            if m:
                u = row & m
                row = ((row + u) | (row - u)) & full
        return len(self.words) - row.bit_count()


class Vocabulary:
    """Places of known word hashes: two probes of fixed tables instead of a search."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.unique(hashes)
        bits = max(12, int(np.ceil(np.log2(max(len(self.hashes), 1) * 32))))
        self.mask = np.uint64((1 << bits) - 1)
        self.tables = [np.full(1 << bits, -1, np.int32) for _ in range(3)]
        left = np.arange(len(self.hashes), dtype=np.int32)
        for k, table in enumerate(self.tables):
            at = self._at(self.hashes[left], k)
            table[at] = left
            left = left[table[at] != left]
        self.rest = left  # almost surely none

    def _at(self, h: np.ndarray, k: int) -> np.ndarray:
        return ((h >> np.uint64(k * 20)) & self.mask).astype(np.int64)

    def places(self, h: np.ndarray) -> np.ndarray:
        """The place of each word, or -1."""
        out = np.full(len(h), -1, np.int32)
        if not len(self.hashes):
            return out
        todo = None
        for k, table in enumerate(self.tables):
            some = h if todo is None else h[todo]
            found = table[self._at(some, k)]
            good = (found >= 0) & (self.hashes[found] == some)
            if todo is None:
                out[good] = found[good]
                todo = np.flatnonzero(~good & (found >= 0))
            else:
                out[todo[good]] = found[good]
                todo = todo[~good & (found >= 0)]
            if not len(todo):
                return out
        for r in self.rest:
            out[h == self.hashes[r]] = r
        return out


def _blocks(ranges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word of each block, and each text's range of blocks."""
    counts = -(-np.diff(ranges) // BLOCK_WORDS)
    block_ranges = np.concatenate([[0], np.cumsum(counts)])
    within = np.arange(block_ranges[-1]) - np.repeat(block_ranges[:-1], counts)
    return np.repeat(ranges[:-1], counts) + within * BLOCK_WORDS, block_ranges


@dataclass
class Retriever:
    vocabulary: Vocabulary
    items: list[Item]
    idf: np.ndarray | None = None
    other: float = 0.0  # weight of a word outside the vocabulary
    scaled: np.ndarray | None = None  # vocabulary by rank: orthonormal columns, weighed
    latent: np.ndarray | None = None  # items by rank
    norms: np.ndarray | None = None
    energy: np.ndarray | None = None  # part of each item's energy that the basis keeps
    runs: Vocabulary | None = None  # the items' runs of SHORT_WORDS words
    run_edges: np.ndarray | None = None  # each run's range of the places below
    run_places: np.ndarray | None = None  # (item, first word) of each run
    item_places: list[np.ndarray] | None = None  # the places of each item's words

    def index_runs(self) -> None:
        found = [(h, k, at) for k, item in enumerate(self.items) for at, h in enumerate(K.windows(item.words, SHORT_WORDS).tolist())]
        hashes = np.array([h for h, _, _ in found], np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.runs = Vocabulary(hashes)
        self.item_places = [self.vocabulary.places(i.words).astype(np.int64) for i in self.items]
        self.run_edges = np.append(np.searchsorted(hashes[order], self.runs.hashes), len(hashes))
        self.run_places = np.array([x[1:] for x in found], np.int64).reshape(-1, 2)[order]

    def weigh(self, counts: np.ndarray, total: float) -> None:
        self.idf = np.log((total + 1) / (counts + 1)).astype(np.float32)
        # not the greatest: that is of words that no document has, and grows with the corpus
        self.other = float(np.median(self.idf)) if len(self.idf) else 1.0

    def vector(self, places: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.idf), np.float32)
        np.add.at(out, places[places >= 0], self.idf[places[places >= 0]])
        return out

    def project(self, basis: np.ndarray) -> None:
        self.scaled = (basis * self.idf[:, None]).astype(np.float32)
        self.latent, self.norms = np.zeros((len(self.items), basis.shape[1]), np.float32), np.ones(len(self.items), np.float32)
        self.energy = np.ones(len(self.items), np.float32)
        for k, item in enumerate(self.items):
            if len(item.words):
                places = self.vocabulary.places(item.words)
                self.latent[k] = self.scaled[places].sum(0)
                self.norms[k] = np.sqrt((self.idf[places] ** 2).sum())
                self.energy[k] = min(1.0, (self.latent[k] ** 2).sum() / max((self.vector(places) ** 2).sum(), 1e-6))

    def candidates(self, words: np.ndarray, ranges: np.ndarray) -> np.ndarray:
        """Rows of (text, first word, end, item, cosine) of all windows near an item."""
        places = self.vocabulary.places(words)
        known = places >= 0
        weight = np.full(len(words), self.other**2, np.float64)
        weight[known] = self.idf[places[known]].astype(np.float64) ** 2
        sums = np.zeros((len(words) + 1, 2))
        np.cumsum(weight, out=sums[1:, 0])
        np.cumsum(weight * known, out=sums[1:, 1])
        first, block_ranges = _blocks(ranges)
        text = np.repeat(np.arange(len(ranges) - 1), np.diff(block_ranges))
        near, needed = [], np.zeros(len(first) + max(WINDOWS), bool)
        for size in WINDOWS:
            end = np.minimum(first + size * BLOCK_WORDS, ranges[1:][text])
            both = sums[end] - sums[first]
            some = np.flatnonzero((both[:, 1] > 0) & (both[:, 0] > 0))
            near.append((size, some, end[some], np.sqrt(both[some, 0]).astype(np.float32)))
            for k in range(size):
                needed[some + k] = True
        # the latent vector of each block that a near window needs, from its known words
        last = np.minimum(first + BLOCK_WORDS, ranges[1:][text])
        word_block = np.repeat(np.arange(len(first)), last - first)
        index = np.flatnonzero(known & needed[word_block])
        out = [np.zeros((0, 5))]
        if not len(index):
            return out[0]
        blocks, edges = np.unique(word_block[index], return_index=True)
        row = np.zeros(len(first) + max(WINDOWS), np.int64)  # 0: a block without known words
        row[blocks] = np.arange(1, len(blocks) + 1)
        vectors = np.zeros((len(blocks) + 1, self.scaled.shape[1]), np.float32)
        bounds, at = np.append(edges, len(index)), places[index]
        for lo in range(0, len(blocks), PIECE):  # pieces that stay in the processor's cache
            hi = min(lo + PIECE, len(blocks))
            vectors[lo + 1 : hi + 1] = np.add.reduceat(self.scaled[at[bounds[lo] : bounds[hi]]], bounds[lo:hi] - bounds[lo], axis=0)
        owner = np.concatenate([text, np.full(max(WINDOWS), -1)])
        lengths = np.maximum(np.linalg.norm(self.latent, axis=1), 1e-6)
        # the dot product is at most that of the lengths; a shorter window reaches LEAST_DOT with no item
        least = LEAST_DOT * float((self.energy * self.norms / lengths).min()) * 0.999
        # items scaled so that LEAST_DOT, a little less, is a comparison with the window's norm; exact tests follow
        scale = np.maximum(LEAST_DOT * 0.999 * self.energy * self.norms, 1e-6).astype(np.float32)
        scaled = self.latent / scale[:, None]
        for size, some, ends, norms in near:
            for at in range(0, len(some), 8 * PIECE):
                b = some[at : at + 8 * PIECE]
                z = vectors[row[b]]
                for k in range(1, size):
                    z = z + vectors[np.where(owner[b + k] == text[b], row[b + k], 0)]
                length, norm, end = np.linalg.norm(z, axis=1), norms[at : at + 8 * PIECE], ends[at : at + 8 * PIECE]
                keep = np.flatnonzero(length >= least * norm)
                b, z, length, norm, end = b[keep], z[keep], length[keep], norm[keep], end[keep]
                dot = z @ scaled.T
                w, item = np.divmod(np.flatnonzero(dot >= norm[:, None]), len(scale))
                dot = dot[w, item] * scale[item]
                cosine, whole = dot / (np.maximum(length[w], 1e-6) * lengths[item]), dot / (norm[w] * self.norms[item])
                good = (cosine >= LEAST_COSINE) & (whole >= LEAST_DOT * self.energy[item])
                w, item, cosine = w[good], item[good], cosine[good]
                out.append(np.stack([text[b[w]], first[b[w]], end[w], item, cosine], 1))
        return np.concatenate(out)

    def literal(self, words: np.ndarray, ranges: np.ndarray, at: np.ndarray, text: np.ndarray, runs: np.ndarray) -> list[tuple[int, int, int, int, float]]:
        """Rows of (text, first word, end, item, cosine) where a text has a run of an item, once for each start of the item."""
        run = self.runs.places(runs)
        hit = np.flatnonzero(run >= 0)
        if not len(hit):
            return []
        counts = np.diff(self.run_edges)[run[hit]]
        index = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(self.run_edges[run[hit]], counts)
        item, offset = self.run_places[index].T
        start = np.repeat(at[hit], counts) - offset
        out = []
        for t, first, k in np.unique(np.stack([np.repeat(text[hit], counts), start, item], 1), axis=0).tolist():
            a, b = max(int(ranges[t]), first), min(int(ranges[t + 1]), first + len(self.items[k].words))
            places = self.vocabulary.places(words[a:b])
            z = self.scaled[places[places >= 0]].sum(0)
            length = float(np.linalg.norm(z) * np.linalg.norm(self.latent[k]))
            out.append((t, a, b, k, float(z @ self.latent[k]) / max(length, 1e-6)))
        return out

    def regions(self, words: np.ndarray, ranges: np.ndarray, at: np.ndarray, text: np.ndarray, runs: np.ndarray):
        """(text, first word, end, item, cosine) of the regions around candidates that hold enough of the item's words:
        no common subsequence has more words than occur there at all."""
        found = np.concatenate([self.candidates(words, ranges), np.array(self.literal(words, ranges, at, text, runs)).reshape(-1, 5)])
        text, first, end, k = found[:, :4].T.astype(np.int64)
        sizes = np.array([len(i.words) for i in self.items])
        a, b = np.maximum(ranges[text], first - sizes[k]), np.minimum(ranges[text + 1], end + sizes[k])
        # where each word of the vocabulary is, in order: the first place from a on tells whether it is in the region
        places, total = self.vocabulary.places(words), len(words)
        known = np.flatnonzero(places >= 0)
        keys = np.append(np.sort(places[known].astype(np.int64) * total + known), np.iinfo(np.int64).max)
        some = np.flatnonzero(sizes[k] >= SHORT_WORDS)
        some = some[np.lexsort((a[some], k[some]))]  # neighbours in the search look near each other
        enough = []
        for at in range(0, len(some), 4096):
            c = some[at : at + 4096]
            word = np.concatenate([self.item_places[x] for x in k[c].tolist()]) * total
            n = sizes[k[c]]
            inside = keys[np.searchsorted(keys, word + np.repeat(a[c], n))] < word + np.repeat(b[c], n)
            enough.append(c[np.add.reduceat(inside, np.cumsum(n) - n) >= LEAST_LCS * n])
        c = np.sort(np.concatenate([some[:0], *enough]))
        yield from zip(text[c].tolist(), a[c].tolist(), b[c].tolist(), k[c].tolist(), found[c, 4].tolist(), strict=True)

    def leaks(self, words: np.ndarray, ranges: np.ndarray, at: np.ndarray, text: np.ndarray, runs: np.ndarray) -> list[tuple[int, int, float, float, float]]:
        """(text, item, cosine, LCS share, answer share) of the leaks of a chunk, the best of each text and item. The
        last three are the places, texts and hashes of the chunk's runs of SHORT_WORDS words."""
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        for text, a, b, k, cosine in self.regions(words, ranges, at, text, runs):
            have = best.get((text, k))
            if have and have[1] >= 1:
                continue
            item = self.items[k]
            n = len(item.words)
            region = words[a:b]
            share = item.lcs(region.tolist()) / n
            if share < LEAST_LCS or (have and share <= have[1]):
                continue
            answer = float(np.isin(item.answer, region).mean())
            if share >= LITERAL or answer >= LEAST_ANSWER:
                best[text, k] = (cosine, share, answer)
        for k, item in enumerate(self.items):
            n = len(item.words)
            if 0 < n < SHORT_WORDS and len(words) >= n:
                at, text = K.window_owner(ranges, n)
                hit = K.windows(words, n)[at] == K.windows(item.words, n)[0]
                for t in np.unique(text[hit]).tolist():
                    best[t, k] = (1.0, 1.0, 1.0)
        return [(t, k, *v) for (t, k), v in sorted(best.items())]


def pack(x: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(x.tobytes())


def add_up(df: DataFrame, shape: tuple[int, ...], kind: str = "<f4", packed: bool = False) -> np.ndarray:
    """The sum of the matrices of a column of binaries, a row for each partition: summed by tasks of 16 matrices until one is
    left, which alone goes to the driver. The tasks that make the matrices keep their parallelism. ``packed``: the
    binaries are compressed by ``pack``, and so is what the tasks send on."""

    def read(x: bytes, given: str) -> np.ndarray:
        if packed:
            import zstandard

            x = zstandard.ZstdDecompressor().decompress(x)
        return np.frombuffer(x, given).reshape(shape)

    def sums(batches, given: str, wanted: str):
        total = np.zeros(shape, "<f8")
        for batch in batches:
            for x in batch.column(0):
                total += read(x.as_buffer(), given)
        total = total.astype(wanted)
        yield pa.RecordBatch.from_arrays([pa.array([pack(total) if packed else total.tobytes()], pa.binary())], names=["m"])

    parts = df.rdd.getNumPartitions()
    wider = "<i8" if kind[1] in "iu" else kind
    while parts > 1:
        parts = -(-parts // 16)
        df = df.repartition(parts).mapInArrow(lambda batches, given=kind: sums(batches, given, wider), "m binary")
        kind = wider
    total = np.zeros(shape, "<f8")
    for row in df.collect():
        total += read(row[0], kind)
    return total


def _binary(x: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary())], names=["m"])


def pack_passages(places: np.ndarray, ranges: np.ndarray, size: int) -> np.ndarray:
    """The known words of a chunk's passages as bytes: for each passage that has any their number, then their places
    and how often each occurs. ``places``: of all words among ``size``, or -1; ``ranges``: each text's range of words."""
    n_words = np.diff(ranges)
    n_passages = -(-n_words // PASSAGE)
    within = np.arange(len(places)) - np.repeat(ranges[:-1], n_words)
    passage = np.repeat(np.cumsum(n_passages) - n_passages, n_words) + within // PASSAGE
    known = np.flatnonzero(places >= 0)
    keys, times = np.unique(passage[known] * size + places[known], return_counts=True)
    passage, at = np.divmod(keys, size)
    sizes = np.unique(passage, return_counts=True)[1]
    numbers = np.concatenate([[len(n_words), len(places), len(sizes)], sizes, at, times]).astype("<i4")
    return np.frombuffer(pack(numbers), np.uint8)


def unpack_passages(packed) -> tuple[int, int, np.ndarray, np.ndarray, np.ndarray]:
    """Documents and words of the chunk; its passages' numbers of known words, these words' places and their counts."""
    import zstandard

    x = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), "<i4")
    documents, words, n = x[:3].tolist()
    return documents, words, x[3 : 3 + n], *np.split(x[3 + n :], 2)


def fit(docs: DataFrame, items: list[Item]) -> list[Retriever]:
    """``docs``: (doc_id, text). A retriever for each BASIS_ITEMS of the items."""
    spark = docs.sparkSession
    vocabulary = Vocabulary(np.concatenate([i.words for i in items] or [np.zeros(0, np.uint64)]))
    size = len(vocabulary.hashes)
    parts = [items[k : k + BASIS_ITEMS] for k in range(0, len(items), BASIS_ITEMS)]
    found = [Retriever(Vocabulary(np.concatenate([i.words for i in part])), part) for part in parts]
    if not size:
        return []
    shared = spark.sparkContext.broadcast(vocabulary)

    def write(batches):
        known = shared.value
        for batch in batches:
            for _, _, data, offsets in K.chunks(batch.column(0)):
                words, ranges = words_of(data, offsets)
                yield _binary(pack_passages(known.places(words), ranges, size))

    def count(batches):
        counts = np.zeros(size + 2, np.int64)  # each word of the vocabulary, all words, documents
        for batch in batches:
            for x in batch.column(0):
                documents, words, _, places, times = unpack_passages(x.as_buffer())
                counts[:size] += np.bincount(places, times, size).astype(np.int64)
                counts[size:] += words, documents
        yield _binary(counts)

    passages = settle(docs.select("text").mapInArrow(write, "m binary"), "passages")
    counts = add_up(passages.mapInArrow(count, "m binary"), (size + 2,), "<i8")
    for retriever in found:
        retriever.weigh(counts[vocabulary.places(retriever.vocabulary.hashes)], counts[size])
        retriever.index_runs()
        if len(retriever.vocabulary.hashes):
            retriever.project(_basis(passages, retriever, vocabulary, max(counts[size + 1], 1)))
    return [r for r in found if len(r.vocabulary.hashes)]


def _basis(passages: DataFrame, retriever: Retriever, known: Vocabulary, n_docs: float) -> np.ndarray:
    """The basis of a retriever's items and of all passages, which hold places of ``known``."""
    spark = passages.sparkSession
    idf, size = retriever.idf, len(retriever.idf)
    mine = retriever.vocabulary.places(known.hashes)
    own = np.stack([retriever.vector(retriever.vocabulary.places(i.words)) for i in retriever.items])
    own /= np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-6)

    def step(basis: np.ndarray) -> np.ndarray:
        """A'A basis, the passages' part summed over partitions; a passage weighs as much as an item."""
        sent = spark.sparkContext.broadcast(basis)

        def multiply(batches):
            q = sent.value
            total = np.zeros_like(q)
            for batch in batches:
                for m in batch.column(0):
                    _, _, sizes, places, times = unpack_passages(m.as_buffer())
                    places = mine[places]
                    some = np.flatnonzero(places >= 0)
                    places, passage = places[some], np.repeat(np.arange(len(sizes)), sizes)[some]
                    x = idf[places] * times[some]
                    x = (x / np.maximum(np.sqrt(np.bincount(passage, x * x, len(sizes))), 1e-6)[passage]).astype(np.float32)
                    edges = np.searchsorted(passage, np.arange(0, len(sizes) + PASSAGES, PASSAGES))
                    for k, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
                        used, column = np.unique(places[a:b], return_inverse=True)
                        dense = np.zeros((PASSAGES, len(used)), np.float32)
                        dense[passage[a:b] - k * PASSAGES, column] = x[a:b]
                        total[used] += dense.T @ (dense @ q[used])
            yield _binary(total)

        return own.T @ (own @ basis) + add_up(passages.mapInArrow(multiply, "m binary"), basis.shape) / n_docs * 0.05

    rank = min(RANK + OVERSAMPLE, size)
    q = np.linalg.qr(np.random.Generator(np.random.PCG64(5)).normal(size=(size, rank)).astype(np.float32))[0]
    for _ in range(POWER_STEPS):
        q = np.linalg.qr(step(q).astype(np.float32))[0]
    values, vectors = np.linalg.eigh(q.T @ step(q))
    return (q @ vectors[:, np.argsort(-values)[: min(RANK, rank)]]).astype(np.float32)


def _blocks_of_items(benchmark: DataFrame, item_col: str, item_text: str):
    """The items in order, ITEM_BLOCK at a time; one empty block if there are none."""
    block: list[Item] = []
    seen = False
    for r in benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text).alias("t")).orderBy("i", "t").toLocalIterator():
        block.append(Item.of(r.i, r.t))
        if len(block) == ITEM_BLOCK:
            yield block
            block, seen = [], True
    if block or not seen:
        yield block


def _leaks(retrievers: list[Retriever], column: pa.Array):
    """(first row, row after the last, retriever, leaks) of the chunks of a column."""
    release()
    for i, j, data, offsets in K.chunks(column):
        words, ranges = words_of(data, offsets)
        at, owner = K.window_owner(ranges, SHORT_WORDS)
        runs = K.windows(words, SHORT_WORDS)[at]
        for retriever in retrievers:
            yield i, j, retriever, retriever.leaks(words, ranges, at, owner, runs)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, cosine, lcs_share, answer_share) of every document that holds an item, for each such item."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    total = None
    for items in _blocks_of_items(benchmark, item_col, item_text):
        shared = spark.sparkContext.broadcast(fit(rows, items))

        def run(batches, shared=shared):
            for batch in batches:
                for i, j, retriever, leaks in _leaks(shared.value, batch.column(1)):
                    if leaks:
                        text, item, *numbers = zip(*leaks, strict=True)
                        ids = batch.column(0).slice(i, j - i).take(pa.array(text, pa.int64()))
                        named = pa.array([retriever.items[k].item_id for k in item], pa.int64())
                        yield pa.RecordBatch.from_arrays([ids, named, *(pa.array(n, pa.float64()) for n in numbers)], names=[c.split()[0] for c in SCHEMA.split(", ")])

        found = rows.mapInArrow(run, SCHEMA)
        total = found if total is None else total.union(found)
    return total


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text holds no item, each judged by its own text. Nothing is shuffled; what a block of
    items leaves is written before the next block."""
    spark = docs.sparkSession
    small_batches(spark)
    at, left = docs.columns.index(text_col), None
    for items in _blocks_of_items(benchmark, item_col, item_text):
        kept = docs if left is None else settle(left, "without-leaks")
        shared = spark.sparkContext.broadcast(fit(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")), items))

        def run(batches, shared=shared):
            for batch in batches:
                keep = np.ones(len(batch), bool)
                for i, _, _, leaks in _leaks(shared.value, batch.column(at)):
                    keep[[i + text for text, *_ in leaks]] = False
                yield batch.filter(pa.array(keep))

        left = kept.mapInArrow(run, kept.schema)
    return left
