"""Exact n-gram Jaccard join with filters under several global token orders.

A document's set is its distinct 5-word shingles, as 64-bit hashes; documents with equal sets are one node. Sets of n
and m tokens with a Jaccard similarity of 80/100 share ``ceil(0.8 (n + m) / 1.8)`` tokens, so under any global order of
tokens their prefixes of ``n - ceil(0.8 n) + l`` tokens share ``shared_needed(n, m)`` at least, never under l. The first
order puts frequent tokens last, by counts over all documents in a table of COUNTERS counters; the others are by hash.
Any order gives the same result; the first one keeps common passages out of the prefixes.

The filters are intersected before a set is read: nodes that share enough prefix tokens under the first order, found by
token, are candidates; for them alone the short prefixes under the other orders are dealt out by pair, and only the
sets of pairs that pass all three are compared.

A group of near copies is not expanded into pairs. Each node is first paired with the most central node that it shares
enough with (the one with the highest counts in its prefix, for what edits add is rare), its hub. A hub's nodes that
turn out similar to it are done with each other; the other ones are compared with all nodes of the hub, in blocks, as
products of membership matrices. Then nodes of different hubs that are still in different components are compared
where they share enough. So every link either is found or lies within a component, and components are exact. Prefixes
are shuffled by token; prefixes under other orders and texts, compressed, only of nodes that are candidates.

Defined cases: a null or empty text, or one without words, has an empty set and links with nothing; a null ``doc_id``
stays null and is never a component's id unless all of it are null; repeated rows have equal sets and one component;
other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import textkernel as K
from .common import release, settle, settle_counted, small_batches
from .components import components
from .decontaminate import add_up, pack

WIDTH = 5
PERCENT = 80
#: Orders beside the first; each is a hash with its own salt.
OTHER_ORDERS = (2, 3)
#: Tokens that prefixes under the first order share at least.
DEPTH = 5
#: Nodes compared with one node in a task, about; a node compared with more is sent to several tasks.
STAR_NODES = 400
#: Nodes, and bytes of sets, of a block of a hub's nodes, about.
BLOCK_NODES, BLOCK_BYTES = 2000, 32 << 20
#: Columns of a membership matrix at a time.
COLUMNS = 2048
#: Counters of the table of token counts; a token is frequent if its counter is so many deviations above the mean.
COUNTERS = 1 << 20
FREQUENT_DEVIATIONS = 6.0
#: Tasks that a frequent token's nodes are dealt out to.
SALTS = 16
#: Bits for each document of the filter of candidates, and of the whole filter at most; beyond, it lets more pass.
BITS_EACH, FILTER_BITS = 16, 1 << 26


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """For each text of a chunk, its set as sorted distinct hashes."""
    starts, ends, ranges = K.spans(~K.WHITE[data], offsets)
    words = K.hash_spans(K.prefix_sums(data, lower=True), starts, ends)
    whole = K.windows(words, WIDTH)
    out = []
    for a, b in zip(ranges[:-1].tolist(), ranges[1:].tolist(), strict=True):
        if b - a >= WIDTH:
            s = np.sort(whole[a : b - WIDTH + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        else:
            out.append(K.windows(words[a:b], b - a) if b > a else words[:0])
    return out


def node_of(s: np.ndarray) -> int | None:
    """A number for the set: equal for equal sets, None for the empty one."""
    return int(K.mix(s, 5).sum(dtype=np.uint64).astype(np.int64)) if len(s) else None


def prefix_length(n: int, depth: int = 1) -> int:
    least = -(-PERCENT * n // 100)
    return n - least + min(depth, least)


def shared_needed(n: int, m: int, depth: int = 1) -> int:
    """Tokens that the prefixes of similar sets of n and m tokens share at least, under any order: of the set whose
    prefix ends first, all but ``n - overlap`` tokens of the prefix are in the other set, and so in its prefix."""
    overlap = -(-PERCENT * (n + m) // (100 + PERCENT))
    return min(prefix_length(n, depth) - n, prefix_length(m, depth) - m) + overlap


def _needed(n: str, m: str, depth: int) -> Column:
    least = lambda x: f"(({PERCENT} * {x} + 99) div 100)"
    short = lambda x: f"(least({depth}, {least(x)}) - {least(x)})"
    return F.expr(f"least({short(n)}, {short(m)}) + (({PERCENT} * ({n} + {m}) + {100 + PERCENT - 1}) div {100 + PERCENT})")


def _fits(a: str, b: str) -> Column:
    return 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)


def sketch(s: np.ndarray) -> np.ndarray:
    """The set's prefixes under the other orders, one after the other, by the upper halves of the orders' keys."""
    size = prefix_length(len(s))
    return np.concatenate([(np.partition(K.mix(s, salt), size - 1)[:size] >> np.uint64(32)).astype(np.uint32) for salt in OTHER_ORDERS])


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    both = np.sort(np.concatenate([a, b]))
    return int((both[1:] == both[:-1]).sum())


def sketches_meet(n: int, a: np.ndarray, m: int, b: np.ndarray) -> bool:
    """Whether sets of n and m tokens with these sketches can be similar. Keys with equal halves only count as more."""
    least, orders = shared_needed(n, m), len(OTHER_ORDERS)
    return all(_shared(x, y) >= least for x, y in zip(np.split(a, orders), np.split(b, orders), strict=True))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    small, large = sorted((len(a), len(b)))
    if not small or 100 * small < PERCENT * large:
        return False
    shared = _shared(a, b)
    return 100 * shared >= PERCENT * (len(a) + len(b) - shared)


def _product(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """For two lists of sets, how many tokens each pair shares."""
    out = np.zeros((len(left), len(right)), np.int64)
    both = left + right
    sizes = [len(s) for s in both]
    if not sum(sizes):
        return out
    tokens, place = np.unique(np.concatenate(both), return_inverse=True)
    counts = np.bincount(place, minlength=len(tokens))
    number = np.cumsum(counts > 1) - 1
    row = np.repeat(np.arange(len(both)), sizes)
    shared = counts[place] > 1
    row, column = row[shared], number[place[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for at in range(0, int(number[-1]) + 1, COLUMNS):
        a, b = np.searchsorted(column, [at, at + COLUMNS])
        m = np.zeros((len(both), COLUMNS), np.float32)
        m[row[a:b], column[a:b] - at] = 1
        out += (m[: len(left)] @ m[len(left) :].T).astype(np.int64)  # at most COLUMNS: exact
    return out


def similar_pairs(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """A matrix of whether each pair is similar."""
    n, m = np.array([len(s) for s in left], np.int64)[:, None], np.array([len(s) for s in right], np.int64)[None, :]
    good = 100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m)
    if good.any():
        shared = _product(left, right)
        good &= (shared > 0) & (100 * shared >= PERCENT * (n + m - shared))
    return good


def spanning_links(nodes: list[int], others: list[int], good: np.ndarray) -> list[tuple[int, int]]:
    """Links enough to join what the matrix joins: a tree of each component."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for a, b in zip(*np.nonzero(good), strict=True):
        x, y = nodes[a], others[b]
        p, q = find(x), find(y)
        if p != q:
            root[max(p, q)] = min(p, q)
            out.append((min(x, y), max(x, y)))
    return out


def _sets(batches, at: int = 1):
    """(ids, sets) chunk by chunk."""
    release()
    for batch in batches:
        for i, j, data, offsets in K.chunks(batch.column(at)):
            yield batch.slice(i, j - i), shingle_sets(data, offsets)


def _counter(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(20)).astype(np.int64) & (COUNTERS - 1)


def _members(batches):
    """kind 0: (doc_id, text_key, n, node) of each document; kind 1: a task's table of counts of its nodes' tokens."""
    seen: set[int] = set()
    counts = np.zeros(COUNTERS, np.int64)
    names = ["kind", "doc_id", "text_key", "n", "node", "counts"]
    for batch, sets in _sets(batches, 2):
        nodes = [node_of(s) for s in sets]
        fresh = []
        for s, node in zip(sets, nodes, strict=True):
            if node is not None and node not in seen:
                seen.add(node)
                fresh.append(s)
        if fresh:
            np.add.at(counts, _counter(np.concatenate(fresh)), 1)
        rows = len(sets)
        arrays = [pa.array(np.zeros(rows, np.int32)), batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.int64()), pa.nulls(rows, pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, names=names)
    yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), *(pa.nulls(1, pa.int64()) for _ in range(4)), pa.array([pack(counts.astype("<u4"))], pa.binary())], names=names)


class FirstOrder:
    """Tokens in the order of their counts, as far as the table tells them apart, then of a hash."""

    def __init__(self, counts: np.ndarray):
        mean = float(counts.mean())
        self.counts = counts.astype(np.uint32)
        self.frequent = mean + FREQUENT_DEVIATIONS * mean**0.5 + 2

    def prefix(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The tokens of the set's prefix, which of them are frequent, and how high their counts are."""
        counts = self.counts[_counter(s)]
        key = (counts.astype(np.uint64) << np.uint64(32)) | (K.mix(s, 1) >> np.uint64(32))
        size = prefix_length(len(s), DEPTH)
        first = np.argpartition(key, size - 1)[:size]
        return s[first], counts[first] > self.frequent, int(16 * min(float(counts[first].mean()), 1e8))


def _buckets(tokens: DataFrame) -> DataFrame:
    """(token, node, n, best) of the tokens that nodes of fitting sizes share, once for each token and node; best is the
    bucket's most central node with its size. A token's nodes are sorted by size, so a node has a fitting one if the
    one before or after it fits. A frequent token's nodes are dealt out to SALTS tasks, and what they say of the token
    is put together; of them only buckets of one node go."""
    w = Window.partitionBy("token", "salt")
    beside = w.orderBy("n", "node")
    aggs = {"low": F.min("node"), "high": F.max("node"), "best": F.max(F.struct("central", "node", "n"))}
    near = {"below": F.lag("n").over(beside), "last": F.lag("node").over(beside), "above": F.lead("n").over(beside), "next": F.lead("node").over(beside)}
    fitting = F.coalesce(_fits("n", "below"), F.lit(False)) | F.coalesce(_fits("n", "above"), F.lit(False)) | F.col("next").eqNullSafe(F.col("node"))
    dealt = tokens.withColumns({"n": F.expr("weight & 4294967295L"), "central": F.expr("shiftright(weight, 32)")}).withColumns(near)
    dealt = dealt.withColumns({k: a.over(w) for k, a in aggs.items()}).filter(~F.col("last").eqNullSafe(F.col("node")) & ((F.col("salt") > 0) | ((F.col("low") != F.col("high")) & fitting)))
    dealt = settle(dealt.select("token", "node", "n", "salt", *aggs), "dealt-buckets")
    common = dealt.filter("salt > 0")
    merged = {"low": F.min("low"), "high": F.max("high"), "best": F.max("best")}
    common = common.drop(*aggs).join(common.groupBy("token").agg(*[a.alias(k) for k, a in merged.items()]), "token")
    columns = ["token", "node", "n", "best", "low", "high"]
    return dealt.filter("salt = 0").select(*columns).union(common.select(*columns)).filter("low <> high").drop("low", "high")


def _filter_words(keys: DataFrame, column: str, count: int) -> np.ndarray:
    """A Bloom filter over the column's hashes, of at most FILTER_BITS bits, from a row for each of its words."""
    bits = min(FILTER_BITS, max(1 << 12, 1 << (BITS_EACH * count - 1).bit_length()))
    bit = F.explode(F.array(*[F.pmod(F.xxhash64(column, F.lit(k)), F.lit(bits)) for k in range(3)]))
    one = F.expr("bit_or(shiftleft(1L, cast(pmod(bit, 64) as int)))").alias("bits")
    found = keys.select(bit.alias("bit")).groupBy(F.expr("cast(bit div 64 as int)").alias("word")).agg(one).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy()
    return out.view(np.uint64)


class Join:
    """The steps of the join over one table; ``run`` gives (doc_id, text_key, n_shingles, node, root, component_id)."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
        self.spark = docs.sparkSession
        small_batches(self.spark)
        self.docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))

    def members(self) -> DataFrame:
        return settle(self.docs.mapInArrow(_members, "kind int, doc_id long, text_key long, n long, node long, counts binary"), "members")

    def tokens(self, members: DataFrame) -> DataFrame:
        order = FirstOrder(add_up(members.filter("kind = 1").select("counts"), (COUNTERS,), "<u4", packed=True))
        shared = self.spark.sparkContext.broadcast(order)

        def run(batches):
            order, seen = shared.value, set()
            for _, sets in _sets(batches, 0):
                rows = []
                for s in sets:
                    node = node_of(s)
                    if node is not None and node not in seen:
                        seen.add(node)
                        rows.append((node, len(s), *order.prefix(s)))
                if rows:
                    sizes = [len(r[2]) for r in rows]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.concatenate([r[2] for r in rows]).astype(np.int64)),
                            pa.array(np.repeat(np.array([r[0] for r in rows], np.int64), sizes)),
                            pa.array(np.repeat(np.array([r[4] << 32 | r[1] for r in rows], np.int64), sizes)),
                            # tasks that a frequent token's nodes are dealt out to, from 1 on
                            pa.array(np.concatenate([np.where(r[3], r[0] % SALTS + 1, 0) for r in rows]).astype(np.int32)),
                        ],
                        names=["token", "node", "weight", "salt"],
                    )

        return self.docs.select("text").mapInArrow(run, "token long, node long, weight long, salt int")

    def gathered(self, places: DataFrame, nodes: DataFrame, keys: list[str], sketches: bool) -> DataFrame:
        """(*keys, turn, node, data) of the nodes at their places, dealt out by ``keys`` and sorted by turn within them;
        data is the node's sketch, or its text, compressed.

        What is sent is made from the documents that a filter lets through, goes to the nodes' places once, and from
        there to the keys. ``nodes``: (node, doc_id) of one document of each node."""
        import zstandard

        places, found = settle_counted(places, "places", n=F.count("*"))
        words = _filter_words(nodes.join(places.select("node").distinct(), "node"), "doc_id", max(found["n"], 1))
        bits = self.spark.sparkContext.broadcast(words)
        hashes = [F.pmod(F.xxhash64("doc_id", F.lit(k)), F.lit(64 * len(words))).cast("int").alias(f"h{k}") for k in range(3)]

        def build(batches):
            words, seen = bits.value, set()
            press = zstandard.ZstdCompressor(level=3, write_checksum=False)
            for batch in batches:
                hit = np.ones(len(batch), bool)
                for k in range(3):
                    at = batch.column(1 + k).to_numpy()
                    hit &= (words[at // 64] >> (at % 64).astype(np.uint64)) & np.uint64(1) == 1
                batch = batch.filter(pa.array(hit))
                for part, sets in _sets([batch], 0):
                    rows = {}
                    for k, s in enumerate(sets):
                        node = node_of(s)
                        if node is not None and node not in seen:
                            seen.add(node)
                            rows[node] = sketch(s).tobytes() if sketches else press.compress(part.column(0)[k].as_py().encode())
                    yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(rows.values(), pa.binary())], names=["node", "data"])

        made = self.docs.select("text", *hashes).mapInArrow(build, "node long, data binary")
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        met = made.join(places, "node").select(*keys, "turn", "n", "node", "data")
        return met.repartition(parts, *keys).sortWithinPartitions(*keys, "turn")

    def stars(self, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
        """Of the pairs (a, n, b, m) of nodes and their sizes, (a, b) with similar sets. Each ``a`` meets its ``b``s in
        turn: first their sketches, then, if any pass, the sets."""

        salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR_NODES).cast("int").alias("salts"))
        pairs = pairs.join(salts, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int"))

        def places(pairs: DataFrame) -> DataFrame:
            center = pairs.select(F.col("a").alias("node"), "n", "a", "salt", F.lit(0).alias("turn")).distinct()
            return center.union(pairs.select(F.col("b").alias("node"), F.col("m").alias("n"), "a", "salt", F.lit(1).alias("turn")))

        def check(read, meet):
            def run(batches):
                key, own, size = None, None, 0
                for batch in batches:
                    good = []
                    for a, salt, turn, n, node, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                        if turn == 0:
                            key, own, size = (a, salt), read(data), n
                        elif (a, salt) == key and meet(size, own, n, read(data)):
                            good.append((a, size, node, n, salt))
                    types = [pa.int64()] * 4 + [pa.int32()]
                    yield pa.RecordBatch.from_arrays([pa.array([g[k] for g in good], t) for k, t in enumerate(types)], names=["a", "n", "b", "m", "salt"])

            return run

        schema = "a long, n long, b long, m long, salt int"
        left = self.gathered(places(pairs), nodes, ["a", "salt"], True).mapInArrow(check(lambda x: np.frombuffer(x, np.uint32), sketches_meet), schema)
        left = settle(left, "pairs")
        found = self.gathered(places(left), nodes, ["a", "salt"], False).mapInArrow(check(_unpack, lambda n, x, m, y: similar(x, y)), schema)
        return settle(found.select("a", "b"), "links")

    def hubs(self, buckets: DataFrame) -> DataFrame:
        """(node, n, hub, hub_n): the most central of the nodes that a node shares DEPTH tokens with, in its buckets; if
        it shares enough with any, one of those. A hub that has a hub itself passes its nodes on."""
        pairs = buckets.filter("node <> best.node").filter(_fits("n", "best.n")).groupBy("node", "n", "best").agg(F.count("*").alias("shared"))
        least = F.least(F.lit(DEPTH), _needed("n", "best.n", DEPTH))
        near = F.col("shared") >= _needed("n", "best.n", DEPTH)
        best = pairs.filter(F.col("shared") >= least).groupBy("node", "n").agg(F.max(F.struct(near.alias("near"), "best")).alias("x"))
        hubs = settle(best.select("node", "n", F.col("x.best.node").alias("hub"), F.col("x.best.n").alias("hub_n")), "hubs")
        up = hubs.select(F.col("node").alias("hub"), F.col("hub").alias("up"), F.col("hub_n").alias("up_n"))
        passed = hubs.join(up, "hub", "left")
        return settle(passed.select("node", "n", F.coalesce("up", "hub").alias("hub"), F.coalesce("up_n", "hub_n").alias("hub_n")), "hubs")

    def blocks(self, hubs: DataFrame, links: DataFrame, nodes: DataFrame) -> DataFrame:
        """(a, b) that join what is similar among a hub's nodes: those that don't link with the hub, in blocks of their
        own, meet the blocks of all."""
        of = hubs.select("node", "n", "hub").union(hubs.select("hub", "hub_n", "hub")).distinct()  # a hub is one of its own nodes
        own = links.select(F.col("a").alias("hub"), F.col("b").alias("node")).union(hubs.select("hub", "hub")).distinct().withColumn("linked", F.lit(1))
        linked = of.join(own, ["hub", "node"], "left")
        sizes = linked.groupBy("hub").agg(*[F.ceil(F.greatest(F.count(x) / BLOCK_NODES, F.sum(F.when(x.isNotNull(), F.col("n"))) * 8 / BLOCK_BYTES)).cast("int").alias(c)
                                            for c, x in (("left", F.when(F.col("linked").isNull(), 1)), ("right", F.lit(1)))], F.count("*").alias("m"))
        own = linked.join(sizes.filter("left > 0 and m > 2"), "hub").select("node", "n", F.col("hub").alias("a"), F.col("linked").isNull().alias("alone"), "left", "right")
        block = lambda of: F.pmod(F.xxhash64("node"), F.col(of)).cast("int")
        each = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
        left = own.filter("alone").select("node", "n", "a", block("left").alias("i"), each("right").alias("j"), F.lit(0).alias("turn"))
        right = own.select("node", "n", "a", each("left").alias("i"), block("right").alias("j"), F.lit(1).alias("turn"))
        met = self.gathered(left.union(right), nodes, ["a", "i", "j"], False)

        def check(batches):
            key, sides = None, ([], [])

            def links():
                left, right = sides
                if not left or not right:
                    return []
                good = similar_pairs([s for _, s in left], [s for _, s in right])
                return spanning_links([x for x, _ in left], [x for x, _ in right], good)

            for batch in batches:
                out = []
                for a, i, j, turn, _, node, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if (a, i, j) != key:
                        out += links()
                        key, sides = (a, i, j), ([], [])
                    sides[turn].append((node, _unpack(data)))
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(2)], names=["a", "b"])
            out = links()
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(2)], names=["a", "b"])

        return settle(met.mapInArrow(check, "a long, b long").distinct(), "links")

    def cross(self, buckets: DataFrame, hubs: DataFrame, roots: DataFrame) -> tuple[DataFrame, dict]:
        """(a, n, b, m): pairs of nodes that share enough and are neither of one hub nor in one component yet; and how
        many."""
        known = hubs.select("node", "hub").join(roots, "node", "full")
        rest = buckets.select("token", "node", "n").join(known, "node", "left").withColumns({"root": F.coalesce("root", "node"), "hub": F.coalesce("hub", "node")})
        rest = settle(rest, "named-buckets")
        for _ in range(2):
            mixed = rest.groupBy("token").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.min("hub").alias("h0"), F.max("hub").alias("h1"))
            rest = rest.join(mixed.filter("r0 <> r1 AND h0 <> h1").select("token"), "token", "left_semi")
            rest = settle(_enough(rest), "mixed-buckets")
        met = _meetings(rest)
        met = met.groupBy(F.col("x.node").alias("a"), F.col("x.n").alias("n"), F.col("y.node").alias("b"), F.col("y.n").alias("m")).agg(F.count("*").alias("shared"))
        return settle_counted(met.filter(F.col("shared") >= _needed("n", "m", DEPTH)).drop("shared"), "cross-pairs", n=F.count("*"))

    def run(self) -> DataFrame:
        members = self.members()
        docs = members.filter("kind = 0").select("doc_id", "text_key", F.col("n").alias("n_shingles"), "node")
        nodes = settle(docs.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id")), "nodes")
        buckets = settle(_buckets(self.tokens(members)), "buckets")
        hubs = self.hubs(buckets)
        links = self.stars(hubs.select(F.col("hub").alias("a"), F.col("hub_n").alias("n"), F.col("node").alias("b"), F.col("n").alias("m")), nodes)
        links = links.union(self.blocks(hubs, links, nodes))
        roots = settle(components(links), "roots")
        cross, found = self.cross(buckets, hubs, roots)
        joined = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        if found["n"]:
            # a few links among components: only their roots are joined anew
            named = roots.union(nodes.select("node", F.col("node").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))
            new = self.stars(cross, nodes).join(named.toDF("a", "ra"), "a").join(named.toDF("b", "rb"), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
            again = settle(components(new), "roots").toDF("root", "top")
            joined = joined.join(again, "root", "left").withColumn("root", F.coalesce("top", "root")).drop("top")
        least = joined.groupBy("root").agg(F.min("doc_id").alias("component_id"))
        named = joined.join(least, "root").select("node", "root", "component_id")
        component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
        return docs.join(named, "node", "left").select("doc_id", "text_key", "n_shingles", "node", "root", component.alias("component_id"))


def _unpack(data: bytes) -> np.ndarray:
    """The set of a compressed text."""
    import zstandard

    text = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return shingle_sets(text, np.array([0, len(text)]))[0]


def _meetings(rest: DataFrame) -> DataFrame:
    """x, y: the rows of ``rest`` with one token, but different hubs and components, that may share enough: all that
    two such nodes share are mixed tokens, so neither may have fewer than they need."""
    x, y = rest.alias("x"), rest.alias("y")
    apart = (F.col("x.root") < F.col("y.root")) & (F.col("x.hub") != F.col("y.hub")) & _fits("x.n", "y.n")
    return x.join(y, (F.col("x.token") == F.col("y.token")) & apart & (_needed("x.n", "y.n", DEPTH) <= F.least("x.rows", "y.rows")))


def _enough(rows: DataFrame) -> DataFrame:
    """The rows of nodes with as many shared tokens as a similar pair shares at least; with that number."""
    counts = F.count("*").over(Window.partitionBy("node"))
    least = F.least(F.lit(DEPTH), F.expr(f"({PERCENT} * n + 99) div 100"))
    return rows.withColumn("rows", counts).filter(F.col("rows") >= least)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document."""
    return Join(docs, id_col, text_col).run().select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, of each component only one: that with the smallest id (ids that are null come last), of
    equal ids that with the smallest hash of the text. Rows without a word stay. Other columns may have any name."""
    found = Join(docs, id_col, text_col).run()
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("first")
    stay = found.filter("node is not null").groupBy("root").agg(first).select("first.doc_id", "first.text_key")
    empty = found.filter("node is null").select("doc_id", "text_key").distinct()
    stay = settle(stay.withColumn("one", F.lit(True)).union(empty.withColumn("one", F.lit(False))), "stay")
    # the row as one struct: its columns can't clash with the operator's own
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.select("row", F.col(f"row.`{id_col}`").cast("long").alias("id"), F.xxhash64(F.col(f"row.`{text_col}`")).alias("key"))
    same = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("key") == F.col("text_key"))
    number = F.row_number().over(Window.partitionBy("id", "key").orderBy("id"))
    kept = rows.join(stay, same).withColumn("number", number).filter("number = 1 or not one")
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
