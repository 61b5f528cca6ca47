import random

import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from sparkloom.functions import bits

R = random.Random(3)
WORDS = ["x" * n + "é" * m for n in range(40) for m in range(3)] + [chr(R.randrange(1, 5000)) * R.randrange(12) for _ in range(500)]


def by_hand(words):
    sums = [sum(1 if xxhash.xxh64_intdigest(w) >> k & 1 else -1 for w in words) for k in range(64)]
    return bits.signed(sum(1 << k for k in range(64) if sums[k] > 0))


def test_hashes_are_xxh64_and_made_on_arrays(monkeypatch):
    want = [[bits.signed(xxhash.xxh64_intdigest(w, seed=k)) for k in range(4)] for w in WORDS]
    assert bits._minhashes(pa.array([[w] for w in WORDS]), 4).to_pylist() == want
    monkeypatch.setattr(bits, "_xx", None)  # a call for each word and seed took too long
    short = [i for i, w in enumerate(WORDS) if len(w.encode()) < 32]
    assert bits._minhashes(pa.array([[WORDS[i]] for i in short]), 4).to_pylist() == [want[i] for i in short]


def test_fingerprints_of_texts(spark):
    texts = [" ".join(R.choices(WORDS[:9], k=n)) for n in range(30)] + ["", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    rows = df.select("id", bits.minhash_signature(F.split("t", " "), 5).alias("m"), bits.simhash(F.col("t")).alias("s")).orderBy("id").collect()
    assert [r.m for r in rows] == [None if t is None else [bits.signed(min(xxhash.xxh64_intdigest(w, seed=k) for w in t.split(" "))) for k in range(5)] for t in texts]
    assert [r.s for r in rows] == [None if t is None else by_hand(t.split()) for t in texts]
    assert bits._simhashes(pa.array(texts), 3).to_pylist() == [r.s for r in rows]
    assert bits._minhashes(pa.array([[], None, ["a", None]], pa.list_(pa.string())), 1).to_pylist() == [[-1], None, [bits.signed(xxhash.xxh64_intdigest("a", seed=0))]]
