"""Byte-level BPE encoding and decoding by per-prefix dynamic programming.

For every prefix of a piece the last token of its encoding is unique. A suffix automaton of the vocabulary, run over
the piece, gives all tokens that end at a position; of those, the one that starts the piece or is compatible with
the last token of the prefix before it is stored. Following the back-pointers from the end gives the exact ids,
without any merge queue. Two tokens are compatible if no merge across their border would come before the merges
that build them, which is read off the right edge of the one and the left edge of the other.

Encodings of pieces are kept in a table of fixed size per worker, as most pieces recur; texts that need more of the
pre-tokenizer than byte classes are parted by its pattern.

Defined cases: a null or empty text has no ids and decodes to the empty text; special tokens in a text become their
ids, as in the library's plain ``encode``; a null ``doc_id`` stays null; repeated rows are each encoded; texts of any
length are encoded whole. Only the id and the text are read from ``docs``.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .common import cache, small_batches
from .pieces import PieceTable, gpt_pieces

#: White space of Unicode, as the pre-tokenizer sees it.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECES = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
)
#: Pieces of a generation of the memory for texts that are parted by the pattern.
CACHE_PIECES = 100_000


def byte_alphabet() -> dict[str, int]:
    """Character of a byte-level vocabulary -> byte: printable Latin-1 stands for itself, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class SuffixAutomaton:
    """The suffix automaton of all tokens; a state's longest string is a token if ``token`` has it."""

    def __init__(self, tokens: dict[bytes, int]):
        self.size, self.link, step = [0], [-1], [{}]
        size, link = self.size, self.link
        token = [-1]

        def state(length: int, up: int, edges: dict) -> int:
            size.append(length)
            link.append(up)
            step.append(edges)
            token.append(-1)
            return len(size) - 1

        def split(p: int, c: int, q: int) -> int:
            twin = state(size[p] + 1, link[q], dict(step[q]))
            while p >= 0 and step[p].get(c) == q:
                step[p][c] = twin
                p = link[p]
            link[q] = twin
            return twin

        for word, number in tokens.items():
            last = 0
            for c in word:
                q = step[last].get(c)
                if q is not None:
                    last = q if size[q] == size[last] + 1 else split(last, c, q)
                    continue
                new, p = state(size[last] + 1, 0, {}), last
                while p >= 0 and c not in step[p]:
                    step[p][c] = new
                    p = link[p]
                if p >= 0:
                    q = step[p][c]
                    link[new] = q if size[q] == size[p] + 1 else split(p, c, q)
                last = new
            token[last] = number
        self.step = {s << 8 | c: t for s, edges in enumerate(step) for c, t in edges.items()}
        self.token = token
        #: For each state (token, length), longest first, of all tokens that are suffixes of its longest string.
        self.ending: list[tuple[tuple[int, int], ...]] = [()] * len(size)
        for s in sorted(range(1, len(size)), key=size.__getitem__):
            rest = self.ending[link[s]]
            self.ending[s] = ((token[s], size[s]), *rest) if token[s] >= 0 else rest


class _Fits(dict):
    """Token pairs (first << 32 | second) -> whether they are compatible; computed when first asked for."""

    def __init__(self, test):
        self.test = test

    def __missing__(self, key: int) -> bool:
        if len(self) > 2_000_000:
            self.clear()
        self[key] = found = self.test(key >> 32, key & 0xFFFFFFFF)
        return found


class Codec:
    """Encodes and decodes with the byte-level BPE of a tokenizer file's text."""

    def __init__(self, definition: str):
        spec = json.loads(definition)
        alphabet = byte_alphabet()
        text = lambda t: bytes(alphabet[c] for c in t)
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", []) if t.get("special")}
        tokens = {text(t): i for t, i in vocab.items() if t not in self.special}
        self.bytes = {i: t for t, i in tokens.items()} | {i: t.encode() for t, i in self.special.items()}
        self.pair_rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}  # token -> left, right, rank
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            left, right = vocab[a], vocab[b]
            self.pair_rank[left, right] = rank
            self.parts.setdefault(vocab[a + b], (left, right, rank))
        self.automaton = SuffixAutomaton(tokens)
        self._spines: dict[tuple[int, int], tuple[tuple[int, float], ...]] = {}
        self._fits = _Fits(self.fits)
        self._special = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))) if self.special else None
        # two generations: what is not asked for while one fills is forgotten
        self.pieces: dict[str, bytes] = {}
        self.older_pieces: dict[str, bytes] = {}
        self.table = PieceTable(lambda pieces: [self.encode_piece(p) for p in pieces], "<u4")

    def spine(self, token: int, side: int) -> tuple[tuple[int, float], ...]:
        """The tokens that stand at the token's left (0) or right (1) edge while it is built, each with the rank of
        the merge that ends it."""
        found = self._spines.get((token, side))
        if found is None:
            out, until, at = [], float("inf"), token
            while True:
                out.append((at, until))
                parts = self.parts.get(at)
                if parts is None:
                    break
                until, at = parts[2], parts[side]
            found = self._spines[token, side] = tuple(out)
        return found

    def fits(self, a: int, b: int) -> bool:
        """Whether the encoding of both tokens' bytes is the two tokens: no merge takes their border first. Of equal
        merges the leftmost comes first."""
        ranks, left = self.pair_rank, self.spine(b, 0)
        for x, x_until in self.spine(a, 1):
            for y, y_until in left:
                r = ranks.get((x, y))
                if r is not None and r < x_until and r <= y_until:
                    return False
        return True

    def encode_piece(self, piece: bytes) -> array:
        auto, fits = self.automaton, self._fits
        step, size, link, ending = auto.step.get, auto.size, auto.link, auto.ending
        last, back = [-1] * (len(piece) + 1), [0] * (len(piece) + 1)
        s = length = end = 0
        for c in piece:
            end += 1
            t = step(s << 8 | c)
            while t is None and s:
                s = link[s]
                length = size[s]
                t = step(s << 8 | c)
            if t is None:
                s = length = 0
            else:
                s = t
                length += 1
            for token, n in ending[s if length == size[s] else link[s]]:
                start = end - n
                if not start or ((before := last[start]) >= 0 and fits[before << 32 | token]):
                    last[end] = token
                    back[end] = start
                    break
        out, at = array("I"), len(piece)
        while at:
            if last[at] < 0:
                raise ValueError("a byte of the text is not in the vocabulary")
            out.append(last[at])
            at = back[at]
        out.reverse()
        return out

    def _pieces(self, text: str) -> bytes:
        out = []
        for piece in PIECES.findall(text):
            ids = self.pieces.get(piece)
            if ids is None:
                ids = self.older_pieces.get(piece)
                if ids is None:
                    ids = self.encode_piece(piece.encode()).tobytes()
                if len(self.pieces) >= CACHE_PIECES:
                    self.older_pieces, self.pieces = self.pieces, {}
                if len(piece) <= 64:
                    self.pieces[piece] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> np.ndarray:
        """The ids of a whole text."""
        if self._special is None or not any(t in text for t in self.special):
            return np.frombuffer(self._pieces(text), "<u4")
        out, at = [], 0
        for m in self._special.finditer(text):
            out += [self._pieces(text[at : m.start()]), np.array([self.special[m[0]]], "<u4").tobytes()]
            at = m.end()
        return np.frombuffer(b"".join([*out, self._pieces(text[at:])]), "<u4")

    def encode_column(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text of an Arrow column."""
        column = K.strings(column)
        for i, _, data, offsets in K.chunks(column):
            for k, ids in enumerate(self.table.texts(gpt_pieces, data, offsets)):
                yield self.encode(column[i + k].as_py()) if ids is None else ids

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


_codecs: dict[str, Codec] = cache()


def codec(definition: str) -> Codec:
    """The worker's codec of this tokenizer file's text, built once."""
    key = hashlib.sha256(definition.encode()).hexdigest()
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(definition)
    return _codecs[key]


def read_definition(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def _ids_array(rows: list[np.ndarray]) -> pa.Array:
    edges = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate([*rows, np.zeros(0, "<u4")]).astype(np.int32)))


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of every row; ``vocabulary`` is the path of a byte-level BPE tokenizer file, read on the driver."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(read_definition(vocabulary))

    def run(batches):
        own = codec(shared.value)
        for batch in batches:
            rows = list(own.encode_column(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), _ids_array(rows)], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) from (doc_id, ids); a null list decodes to the empty text."""
    shared = rows.sparkSession.sparkContext.broadcast(read_definition(vocabulary))

    def run(batches):
        own = codec(shared.value)
        for batch in batches:
            texts = [own.decode(ids or ()) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select(F.col(id_col).cast("long"), ids_col).mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every text with the operator's codec, in one pass that keeps only digests of both."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(read_definition(vocabulary))

    def run(batches):
        own = codec(shared.value)
        for batch in batches:
            counts, hashes, decoded = [], [], []
            for row in own.encode_column(batch.column(1)):
                ids = row.tolist()
                counts.append(len(ids))
                hashes.append(hashlib.sha256(str(ids)[1:-1].replace(" ", "").encode()).hexdigest())
                decoded.append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, schema)
