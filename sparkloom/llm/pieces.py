"""Vectorised encoding of pre-tokenized pieces: each distinct piece is encoded once and kept in a table of fixed size.

A scheme parts plain texts (Latin letters, digits, ASCII punctuation, single blanks and line ends, without what a
pre-tokenizer treats specially) into pieces by byte classes alone. Pieces are looked up by hash in an open-addressing
table of numpy arrays and compared byte by byte with what the table holds; its memory is fixed, and a full table starts
anew. Texts that are not plain are left to the caller.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from . import textkernel as K

#: Longest piece that a table holds; texts with a longer one are left to the caller.
LONGEST = 8192
#: Bytes of pieces that a table holds before it starts anew.
RAW_BYTES = 64 << 20
BLANK, BREAK, LETTER, DIGIT, MARK, OTHER = range(6)


def _classes() -> np.ndarray:
    t = np.full(256, OTHER, np.uint8)
    t[0x21:0x7F] = MARK
    t[0x30:0x3A] = DIGIT
    t[0x41:0x5B] = t[0x61:0x7B] = LETTER
    t[0x20], t[0x0A] = BLANK, BREAK
    t[ord("'")] = OTHER  # contractions
    t[0xC3] = t[0x80:0xC0] = LETTER  # Latin-1 letters; other lead bytes are OTHER
    return t


_CLASS = _classes()


def _plain_classes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class of each byte, and where a byte makes its text not plain."""
    kind = _CLASS[data]
    bad = kind == OTHER
    if len(data) > 1:
        before = data[:-1]
        bad[1:] |= (before == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))  # multiplication and division signs
        bad[1:] |= (before == ord("<")) & (data[1:] == ord("|"))  # special tokens
    return kind, bad


def _runs(kind: np.ndarray, offsets: np.ndarray, alone: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of one class within a text; bytes of class ``alone`` are runs of their own."""
    n = len(kind)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    if n:
        edge[1:n] |= kind[1:] != kind[:-1]
        edge[:n] |= kind == alone
    starts = np.flatnonzero(edge[:n])
    return starts, np.append(starts[1:], n)


def gpt_pieces(data: np.ndarray, offsets: np.ndarray):
    """Pieces of the byte-level scheme: runs of letters, of digits, of marks, each with one blank before it; line ends."""
    kind, bad = _plain_classes(data, offsets)
    n = len(data)
    white = kind <= BREAK
    if n:
        bad[1:] |= white[1:] & white[:-1]
        first = offsets[:-1][offsets[:-1] < offsets[1:]]
        bad[first] |= white[first]
        last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
        bad[last] |= white[last]
    starts, ends = _runs(kind, offsets, BREAK)
    what = kind[starts]
    joined = np.zeros(len(starts), bool)
    joined[1:] = (what[:-1] == BLANK) & (what[1:] != BREAK)
    joined &= ~np.isin(starts, offsets)
    keep = what != BLANK
    ranges = np.searchsorted(starts[keep], offsets)
    bad[starts[ends - starts > LONGEST]] = True
    return data, (starts - joined)[keep], ends[keep], ranges, K.per_text(bad, offsets) == 0


def word_pieces(data: np.ndarray, offsets: np.ndarray):
    """Pieces of the word scheme, lower-cased: runs of letters, single digits, runs of marks; white space goes."""
    low = data.copy()
    upper = (data >= 65) & (data <= 90)
    low[upper] += 32
    if len(data) > 1:
        two = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)) + 1
        low[two] += 0x20
    kind, bad = _plain_classes(data, offsets)
    kind = np.where(kind == BREAK, np.uint8(BLANK), kind)
    starts, ends = _runs(kind, offsets, DIGIT)
    bad[starts[ends - starts > LONGEST]] = True
    keep = kind[starts] != BLANK
    ranges = np.searchsorted(starts[keep], offsets)
    return low, starts[keep], ends[keep], ranges, K.per_text(bad, offsets) == 0


class PieceTable:
    def __init__(self, encode: Callable[[list[bytes]], list], kind: str, bits: int = 20):
        """``encode`` gives the ids of each of a list of pieces."""
        self.encode, self.kind, self.bits = encode, kind, bits
        self.clear()

    def clear(self) -> None:
        size = 1 << self.bits
        self.keys, self.first, self.count = np.zeros(size, np.uint64), np.zeros(size, np.int32), np.zeros(size, np.uint16)
        self.pool, self.used, self.held = np.zeros(1 << 18, self.kind), 0, 0
        self.begin, self.size = np.zeros(size, np.uint32), np.zeros(size, np.uint16)  # each piece's bytes
        self.raw, self.raw_used = np.zeros(1 << 20, np.uint8), 0

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each hash, or -1."""
        mask = np.int64((1 << self.bits) - 1)
        slot = (hashes >> np.uint64(40)).astype(np.int64) & mask
        keys = self.keys[slot]
        out = np.where(keys == hashes, slot, -1)
        todo = np.flatnonzero((keys != hashes) & (keys != 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & mask
            keys = self.keys[slot[todo]]
            hit = keys == hashes[todo]
            out[todo[hit]] = slot[todo[hit]]
            todo = todo[~hit & (keys != 0)]
        return out

    def learn(self, hashes: np.ndarray, pieces: list[bytes]) -> None:
        """Distinct new pieces with their hashes."""
        if len(pieces) > 0.6 * (1 << self.bits):
            raise ValueError(f"{len(pieces)} pieces do not fit a table of {1 << self.bits}")
        if self.held + len(pieces) > 0.6 * (1 << self.bits) or self.raw_used > RAW_BYTES:
            self.clear()
        rows = self.encode(pieces)
        counts = np.array([len(r) for r in rows], np.int64)
        ids = np.concatenate([np.asarray(r, self.kind) for r in rows]) if rows else np.zeros(0, self.kind)
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), self.kind)])
        self.pool[self.used : self.used + len(ids)] = ids
        first = self.used + np.cumsum(counts) - counts
        self.used += len(ids)
        sizes = np.array([len(p) for p in pieces], np.int64)
        while self.raw_used + int(sizes.sum()) > len(self.raw):
            self.raw = np.concatenate([self.raw, np.zeros(len(self.raw), np.uint8)])
        begin = self.raw_used + np.cumsum(sizes) - sizes
        self.raw[self.raw_used : self.raw_used + int(sizes.sum())] = np.frombuffer(b"".join(pieces), np.uint8)
        self.raw_used += int(sizes.sum())
        self.held += len(pieces)
        mask = np.int64((1 << self.bits) - 1)
        slot = (hashes >> np.uint64(40)).astype(np.int64) & mask
        todo = np.arange(len(hashes))
        while len(todo):
            free = todo[self.keys[slot[todo]] == 0]
            _, one = np.unique(slot[free], return_index=True)
            won = free[one]
            at = slot[won]
            self.keys[at], self.first[at], self.count[at] = hashes[won], first[won], counts[won]
            self.begin[at], self.size[at] = begin[won], sizes[won]
            todo = np.setdiff1d(todo, won, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & mask

    def ids(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pieces' ids in a row, and how many each has."""
        hashes = K.hash_spans(K.prefix_sums(data), starts, ends) | np.uint64(1)
        size = 1 << self.bits - 1  # so many always fit, known and new ones
        found = [self._slice(data, hashes[k : k + size], starts[k : k + size], ends[k : k + size]) for k in range(0, max(len(hashes), 1), size)]
        return tuple(map(np.concatenate, zip(*found, strict=True))) if len(found) > 1 else found[0]

    def _slice(self, data: np.ndarray, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        slots = self.find(hashes)
        for _ in range(2):  # a table that starts anew has lost the known ones, which then fit
            missing = np.flatnonzero(slots < 0)
            if not len(missing):
                break
            fresh, at = np.unique(hashes[missing], return_index=True)
            at = missing[at]
            self.learn(fresh, [data[a:b].tobytes() for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
            slots = self.find(hashes)
        if len(slots) and slots.min() < 0:
            raise RuntimeError("a piece is missing from the table")
        counts = self.count[slots].astype(np.int64)
        ends_at = np.cumsum(counts)
        index = np.repeat(self.first[slots] - (ends_at - counts), counts) + np.arange(ends_at[-1] if len(ends_at) else 0)
        ids = self.pool[index]
        other = self._unlike(data, slots, starts, ends)
        if len(other):  # pieces whose hash is that of other bytes
            rows = np.split(ids, ends_at[:-1])
            for k, row in zip(other.tolist(), self.encode([data[starts[k] : ends[k]].tobytes() for k in other.tolist()]), strict=True):
                rows[k] = np.asarray(row, self.kind)
            ids, counts = np.concatenate(rows), np.array([len(r) for r in rows], np.int64)
        return ids, counts

    def _unlike(self, data: np.ndarray, slots: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The pieces whose bytes are not those that their slot was filled with."""
        sizes = ends - starts
        wrong = self.size[slots] != sizes
        sizes = np.where(wrong, 0, sizes)
        edges = np.concatenate([[0], np.cumsum(sizes)])
        at = np.arange(edges[-1])
        differ = np.flatnonzero(data[at + np.repeat(starts - edges[:-1], sizes)] != self.raw[at + np.repeat(self.begin[slots].astype(np.int64) - edges[:-1], sizes)])
        wrong[np.searchsorted(edges, differ, "right") - 1] = True
        return np.flatnonzero(wrong)

    def texts(self, scheme, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray | None]:
        """The ids of each text of a chunk; None for a text that is not plain."""
        data, starts, ends, ranges, plain = scheme(data, offsets)
        mine = np.repeat(plain, np.diff(ranges))
        ids, counts = self.ids(data, starts[mine], ends[mine])
        edges = np.concatenate([[0], np.cumsum(counts)])
        at = np.concatenate([[0], np.cumsum(np.where(plain, np.diff(ranges), 0))])
        return [ids[edges[at[k]] : edges[at[k + 1]]] if plain[k] else None for k in range(len(plain))]
