"""Token-id files: one zstandard frame per document under a shared dictionary, with an offset index.

``write`` encodes every text, appends the end id and writes shards in ascending order of ``doc_id``; ``read`` reads
the shards back; ``fetch`` decodes a single document by its index entry alone.

A shard is, little-endian: the magic ``SLTK1\\n``; 32 bytes, the SHA-256 of the dictionary; 1 byte, the bytes of an
id (2 or 4); the frames one after another; the index, an array each of doc_id (int64), null mark (uint8), frame
offset (uint64), frame length (uint32) and number of ids (uint32); then 8 bytes, the offset of the index, and 8
bytes, the number of documents. The dictionary is a file of its own, named by its hash.

Rows are dealt out by ranges of ``doc_id`` (null first), so a task holds a range and the files are in order as a
whole. Shards are written under another name and renamed, so a task that runs again leaves one whole file; only the
shards that finished tasks report are read.

Defined cases: a null or empty text is the end id alone; null ids come first; repeated rows are written each, in any
order among themselves; an empty table gives no shard. Only the id and the text are read from ``docs``.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import textkernel as K
from .common import cache, fresh_path, open_bytes, settle, small_batches, write_bytes
from .pieces import PieceTable, word_pieces

MAGIC = b"SLTK1\n"
END_ID = 1
LEVEL = 3
#: The dictionary: its size, and the documents it is trained on (chosen by a hash of the id), each by its first ids.
DICTIONARY_BYTES = 64 << 10
SAMPLE_DOCS = 1_000
SAMPLE_IDS = 2_048
#: Bytes of frames at which a shard is closed: bounds the memory of writer and reader.
SHARD_BYTES = 32 << 20
_INDEX = (("doc_id", "<i8"), ("null", "u1"), ("offset", "<u8"), ("length", "<u4"), ("ids", "<u4"))


class Encoder:
    """The library's tokenizer, asked once for each piece of a table of fixed size: the pre-tokenizer's pieces are encoded
    independently of each other. Texts that need more of it than byte classes go to the library whole."""

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(definition)
        self.library.no_truncation()
        self.library.no_padding()
        self.wide = self.library.get_vocab_size() > 65_535
        self.kind = "<u4" if self.wide else "<u2"
        self.table = PieceTable(self._pieces, self.kind)

    def _pieces(self, pieces: list[bytes]) -> list[list[int]]:
        out = []
        for i in range(0, len(pieces), 20_000):
            out += [e.ids for e in self.library.encode_batch_fast([p.decode() for p in pieces[i : i + 20_000]], add_special_tokens=False)]
        return out

    def encode(self, texts: pa.Array | list[str]) -> Iterator[np.ndarray]:
        """The ids of each text, with the end id."""
        texts = K.strings(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()))
        end = np.array([END_ID], self.kind)
        for i, _, data, offsets in K.chunks(texts):
            for k, ids in enumerate(self.table.texts(word_pieces, data, offsets)):
                if ids is None:
                    ids = np.array(self.library.encode(texts[i + k].as_py(), add_special_tokens=False).ids, self.kind)
                yield np.concatenate([ids, end])


_encoders: dict[str, Encoder] = cache()


def encoder(definition: str) -> Encoder:
    key = hashlib.sha256(definition.encode()).hexdigest()
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(definition)
    return _encoders[key]


def train_dictionary(docs: DataFrame, definition, id_col: str, text_col: str) -> bytes:
    """A dictionary from the serialized ids of a bounded sample of documents; empty if there are too few."""
    import zstandard

    n = docs.count()
    share = min(1.0, SAMPLE_DOCS / n) if n else 1.0
    chosen = docs.filter(F.pmod(F.xxhash64(id_col), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select(text_col)

    def run(batches):
        own = encoder(definition.value)
        for batch in batches:
            rows = [r[:SAMPLE_IDS].tobytes() for r in own.encode(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["ids"])

    samples = sorted(r.ids for r in chosen.mapInArrow(run, "ids binary").limit(2 * SAMPLE_DOCS).collect())
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _pack(frames: list[bytes], entries: list[tuple], digest: bytes, wide: bool):
    head = MAGIC + digest + bytes([4 if wide else 2])
    offset = len(head) + sum(map(len, frames))
    yield head
    yield from frames
    for i, (_, kind) in enumerate(_INDEX):
        yield np.array([e[i] for e in entries], kind).tobytes()
    yield struct.pack("<QQ", offset, len(entries))


def write(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Writes the shards of all documents below ``path`` and returns the manifest: (part, number, shard, docs, ids), ordered
    by the first two."""
    import zstandard

    spark = docs.sparkSession
    small_batches(spark)
    path = path or fresh_path(spark, "tokens")
    with open(vocabulary, encoding="utf-8") as f:
        definition = spark.sparkContext.broadcast(f.read())
    trained = train_dictionary(docs, definition, id_col, text_col)
    digest = hashlib.sha256(trained).digest()
    write_bytes(f"{path}/{digest.hex()}.dict", [trained])

    def run(batches):
        import uuid

        own = encoder(definition.value)
        shared = zstandard.ZstdCompressionDict(trained) if trained else None
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_checksum=False)
        frames, entries, size, at = [], [], 0, 39
        part, numbers = TaskContext.get().partitionId(), itertools.count()

        def close():
            shard = f"{path}/{uuid.uuid4().hex}.tok"
            write_bytes(shard, _pack(frames, entries, digest, own.wide))
            row = ((part, pa.int32()), (next(numbers), pa.int32()), (shard, pa.string()), (len(entries), pa.int64()), (sum(e[4] for e in entries), pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in row], names=["part", "number", "shard", "docs", "ids"])

        for batch in batches:
            for key, row in zip(batch.column(0).to_pylist(), own.encode(batch.column(1)), strict=True):
                frame = press.compress(row.tobytes())
                entries.append((key or 0, key is None, at, len(frame), len(row)))
                frames.append(frame)
                at += len(frame)
                size += len(frame)
                if size >= SHARD_BYTES:
                    yield close()
                    frames, entries, size, at = [], [], 0, 39
        if entries:
            yield close()

    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = docs.select(F.col(id_col).cast("long"), F.col(text_col)).repartitionByRange(parts, F.col(id_col).asc_nulls_first())
    ordered = ordered.sortWithinPartitions(F.col(id_col).asc_nulls_first())
    return settle(ordered.mapInArrow(run, "part int, number int, shard string, docs long, ids long"), "tokens-manifest")


class Shard:
    """Reads a shard: its index at once, its frames one by one."""

    def __init__(self, path: str, dictionary: bytes | None = None):
        import zstandard

        self.file = open_bytes(path)
        head = self.file.read(39)
        if head[:6] != MAGIC:
            raise ValueError(f"{path} is not a token file")
        self.digest, self.kind = head[6:38], "<u4" if head[38] == 4 else "<u2"
        if dictionary is None:
            with open_bytes(f"{path.rpartition('/')[0]}/{self.digest.hex()}.dict") as f:
                dictionary = f.read()
        if hashlib.sha256(dictionary).digest() != self.digest:
            raise ValueError("the dictionary is not the one that the shard was written with")
        self._open = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        size = self.file.seek(0, 2)
        self.file.seek(size - 16)
        offset, n = struct.unpack("<QQ", self.file.read(16))
        self.file.seek(offset)
        self.index = {name: np.frombuffer(self.file.read(n * np.dtype(kind).itemsize), kind) for name, kind in _INDEX}

    def ids(self, k: int) -> np.ndarray:
        self.file.seek(int(self.index["offset"][k]))
        frame = self.file.read(int(self.index["length"][k]))
        return np.frombuffer(self._open.decompress(frame, max_output_size=int(self.index["ids"][k]) * int(self.kind[2])), self.kind)


def fetch(shard: str, k: int) -> np.ndarray:
    """The ids of document k of a shard: reads the index and one frame."""
    return Shard(shard).ids(k)


def _starts(manifest: DataFrame) -> DataFrame:
    """(shard, start): the ids before each shard. Only sums of whole parts, of which there are as many as partitions of
    the shuffle, are put in one row after the other."""
    parts = manifest.groupBy("part").agg(F.sum("ids").alias("ids"))
    before = lambda w: F.coalesce(F.sum("ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", before(Window.orderBy("part")).alias("base"))
    within = manifest.withColumn("start", before(Window.partitionBy("part").orderBy("number")))
    return within.join(parts, "part").select("shard", (F.col("base") + F.col("start")).alias("start"))


def read(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, ids) of every document of the files, ids as an array."""
    return _read(spark, manifest, lambda rows: pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]).astype(np.int32)), pa.array(np.concatenate(rows).astype(np.int32))), "ids array<int>")


def summary(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files; the ids themselves stay in the task."""
    return _read(spark, manifest, lambda rows: pa.array([zlib.crc32(r.astype("<u4").tobytes()) for r in rows], pa.int64()), "ids_crc32 long")


def _read(spark: SparkSession, manifest: DataFrame, column, declared: str) -> DataFrame:
    shards = _starts(manifest).repartition(max(1, min(manifest.count(), int(spark.conf.get("spark.sql.shuffle.partitions")))), "shard")

    def run(batches):
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = Shard(path)
                counts = shard.index["ids"].astype(np.int64)
                starts = start + np.cumsum(counts) - counts
                for a in range(0, len(counts), 500):
                    rows = [shard.ids(k) for k in range(a, min(a + 500, len(counts)))]
                    here = slice(a, a + 500)
                    ids = pa.array(shard.index["doc_id"][here], mask=shard.index["null"][here] == 1)
                    yield pa.RecordBatch.from_arrays(
                        [ids, pa.array(starts[here]), pa.array(counts[here]), column(rows)], names=["doc_id", "start", "n_tokens", declared.split()[0]]
                    )

    return shards.mapInArrow(run, f"doc_id long, start long, n_tokens long, {declared}")
