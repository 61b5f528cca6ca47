"""Bit fields, digests, checksums, encodings, colours and fingerprints."""

from __future__ import annotations

import base64
import hashlib
import hmac
import struct
import zlib

import numpy as np
import pyarrow as pa
import xxhash as _xx
from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import vectorized

_M64 = (1 << 64) - 1


def _bit(p: Column | int) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(p).cast("int") if isinstance(p, int) else p.cast("int"))


def bitfield_set(x: Column, p) -> Column:
    return x.bitwiseOR(_bit(p))


def bitfield_clear(x: Column, p) -> Column:
    return x.bitwiseAND(F.bitwise_not(_bit(p)))


def bitfield_toggle(x: Column, p) -> Column:
    return x.bitwiseXOR(_bit(p))


def bitfield_test(x: Column, p) -> Column:
    return x.bitwiseAND(_bit(p)) != 0


def bitfield_count(x: Column) -> Column:
    return F.bit_count(x)


def bitfield_all(x: Column, mask: Column) -> Column:
    return x.bitwiseAND(mask) == mask


def bitfield_any(x: Column, mask: Column) -> Column:
    return x.bitwiseAND(mask) != 0


def bitfield_and(a: Column, b: Column) -> Column:
    return a.bitwiseAND(b)


def bitfield_or(a: Column, b: Column) -> Column:
    return a.bitwiseOR(b)


def bitfield_xor(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b)


def bitfield_not(x: Column) -> Column:
    return F.bitwise_not(x)


def bitfield_to_positions(x: Column) -> Column:
    return F.filter(F.sequence(F.lit(0), F.lit(63)), lambda p: x.bitwiseAND(_bit(p)) != 0)


def bitfield_from_positions(positions: Column) -> Column:
    return F.aggregate(positions, F.lit(0).cast("long"), lambda acc, p: acc.bitwiseOR(_bit(p)))


def sha256(x: Column) -> Column:
    return F.unhex(F.sha2(x.cast("binary"), 256))


def sha384(x: Column) -> Column:
    return F.unhex(F.sha2(x.cast("binary"), 384))


def sha512(x: Column) -> Column:
    return F.unhex(F.sha2(x.cast("binary"), 512))


@vectorized("binary")
def hmac_sha256(key, data):
    """HMAC with SHA-256; key and data as bytes or text."""
    return hmac.new(_bytes(key), _bytes(data), hashlib.sha256).digest()


def _bytes(x) -> bytes:
    return x.encode() if isinstance(x, str) else bytes(x)


def signed(x: int, bits: int = 64) -> int:
    """An unsigned number of so many bits as the signed one with the same bits."""
    return x - (1 << bits) if x >> (bits - 1) else x


@vectorized("long")
def hash_combine(a, b):
    """The seed's hash folded with another by the golden ratio of 64 bits."""
    a, b = a & _M64, b & _M64
    return signed(a ^ ((b + 0x9E3779B97F4A7C15 + (a << 6 & _M64) + (a >> 2)) & _M64))


@vectorized("int")
def consistent_hash(key, buckets):
    """Jump consistent hash (Lamping and Veach) of the key's xxhash64."""
    k, b, j = _xx.xxh64_intdigest(_bytes(key)), -1, 0
    while j < buckets:
        b = j
        k = (k * 2862933555777941757 + 1) & _M64
        j = int((b + 1) * (float(1 << 31) / float((k >> 33) + 1)))
    return b


def hex_encode(x: Column) -> Column:
    return F.lower(F.hex(x.cast("binary")))


def hex_decode(x: Column) -> Column:
    return F.unhex(x)


def base64url_encode(x: Column) -> Column:
    return F.rtrim(F.translate(F.base64(x.cast("binary")), "+/", "-_"), F.lit("="))


def base64url_decode(x: Column) -> Column:
    return F.unbase64(F.translate(x, "-_", "+/"))


@vectorized("string")
def base32_encode(x):
    return base64.b32encode(_bytes(x)).decode()


@vectorized("binary")
def base32_decode(x):
    return base64.b32decode(x + "=" * (-len(x) % 8), casefold=True)


_B58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"


@vectorized("string")
def base58_encode(x):
    data = _bytes(x)
    number, out = int.from_bytes(data, "big"), ""
    while number:
        number, r = divmod(number, 58)
        out = _B58[r] + out
    return "1" * (len(data) - len(data.lstrip(b"\0"))) + out


@vectorized("binary")
def base58_decode(x):
    number = 0
    for c in x:
        number = number * 58 + _B58.index(c)
    body = number.to_bytes((number.bit_length() + 7) // 8, "big")
    return b"\0" * (len(x) - len(x.lstrip("1"))) + body


def crc32(x: Column) -> Column:
    return F.crc32(x.cast("binary"))


def _crc32c_table() -> list[int]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ 0x82F63B78 * (n & 1)
        out.append(n)
    return out


_CRC32C = _crc32c_table()


@vectorized("long")
def crc32c(x):
    """The Castagnoli checksum."""
    crc = 0xFFFFFFFF
    for b in _bytes(x):
        crc = _CRC32C[(crc ^ b) & 255] ^ crc >> 8
    return crc ^ 0xFFFFFFFF


@vectorized("long")
def adler32(x):
    return zlib.adler32(_bytes(x))


@vectorized("long")
def xxhash32(x):
    return _xx.xxh32_intdigest(_bytes(x))


@vectorized("long")
def xxhash64(x):
    """xxHash64 with seed 0 (the builtin uses another seed), as a signed number."""
    return signed(_xx.xxh64_intdigest(_bytes(x)))


@vectorized("string")
def xxhash128(x):
    return _xx.xxh3_128_hexdigest(_bytes(x))


@vectorized("long")
def fnv1a_64(x):
    h = 0xCBF29CE484222325
    for b in _bytes(x):
        h = (h ^ b) * 0x100000001B3 & _M64
    return signed(h)


fnvhash = fnv1a_64


def _rotl(x: int, r: int, bits: int) -> int:
    return (x << r | x >> (bits - r)) & ((1 << bits) - 1)


@vectorized("long")
def murmur3_32(x, seed):
    data, h, m = _bytes(x), seed & 0xFFFFFFFF, 0xFFFFFFFF
    scramble = lambda k: _rotl(k * 0xCC9E2D51 & m, 15, 32) * 0x1B873593 & m
    whole = len(data) // 4 * 4
    for (k,) in struct.iter_unpack("<I", data[:whole]):
        h = (_rotl(h ^ scramble(k), 13, 32) * 5 + 0xE6546B64) & m
    if data[whole:]:
        h ^= scramble(int.from_bytes(data[whole:], "little"))
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & m
    h = (h ^ h >> 13) * 0xC2B2AE35 & m
    return h ^ h >> 16


@vectorized("long")
def siphash(x):
    """SipHash-2-4 with a zero key, as a signed number."""
    data = _bytes(x)
    v = [0x736F6D6570736575, 0x646F72616E646F6D, 0x6C7967656E657261, 0x7465646279746573]

    def rounds(n):
        for _ in range(n):
            v[0] = (v[0] + v[1]) & _M64
            v[1] = _rotl(v[1], 13, 64) ^ v[0]
            v[0] = _rotl(v[0], 32, 64)
            v[2] = (v[2] + v[3]) & _M64
            v[3] = _rotl(v[3], 16, 64) ^ v[2]
            v[0] = (v[0] + v[3]) & _M64
            v[3] = _rotl(v[3], 21, 64) ^ v[0]
            v[2] = (v[2] + v[1]) & _M64
            v[1] = _rotl(v[1], 17, 64) ^ v[2]
            v[2] = _rotl(v[2], 32, 64)

    padded = data + b"\0" * (7 - len(data) % 8) + bytes([len(data) & 255])
    for (m,) in struct.iter_unpack("<Q", padded):
        v[3] ^= m
        rounds(2)
        v[0] ^= m
    v[2] ^= 255
    rounds(4)
    return signed(v[0] ^ v[1] ^ v[2] ^ v[3])


# ---- colours: 0xRRGGBBAA in a bigint


def color_from_rgba(r: Column, g: Column, b: Column, a: Column) -> Column:
    return sum((c.cast("long") * F.lit(1 << k) for c, k in ((r, 24), (g, 16), (b, 8))), a.cast("long"))


def color_from_rgb(r: Column, g: Column, b: Column) -> Column:
    return color_from_rgba(r, g, b, F.lit(255))


def color_from_hex(x: Column) -> Column:
    """#RGB, #RRGGBB or #RRGGBBAA."""
    body = F.regexp_replace(x, "^#", "")
    full = F.when(F.length(body) == 3, F.regexp_replace(body, "(.)", "$1$1")).otherwise(body)
    return F.conv(F.when(F.length(full) == 6, F.concat(full, F.lit("ff"))).otherwise(full), 16, 10).cast("long")


def _channel(c: Column, shift: int) -> Column:
    return F.shiftrightunsigned(c, shift).bitwiseAND(F.lit(255))


def color_to_hex(c: Column) -> Column:
    opaque = _channel(c, 0) == 255
    whole = F.lower(F.lpad(F.hex(c), 8, "0"))
    return F.concat(F.lit("#"), F.when(opaque, F.left(whole, F.lit(6))).otherwise(whole))


def color_blend(a: Column, b: Column, t: Column) -> Column:
    mix = [F.round(_channel(a, s) * (1 - t) + _channel(b, s) * t) for s in (24, 16, 8, 0)]
    return color_from_rgba(*mix)


def _luminance(c: Column) -> Column:
    def linear(s: int) -> Column:
        v = _channel(c, s) / 255
        return F.when(v <= 0.03928, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))

    return 0.2126 * linear(24) + 0.7152 * linear(16) + 0.0722 * linear(8)


def wcag_contrast_ratio(a: Column, b: Column) -> Column:
    x, y = _luminance(a), _luminance(b)
    return (F.greatest(x, y) + 0.05) / (F.least(x, y) + 0.05)


def wcag_compliant(a: Column, b: Column, level: str = "AA") -> Column:
    return wcag_contrast_ratio(a, b) >= (7.0 if level.upper() == "AAA" else 4.5)


# ---- fingerprints


def shingle(text: Column, n: int) -> Column:
    """Character n-grams, in order."""
    count = F.length(text) - (n - 1)
    return F.when(count > 0, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def word_shingle(text: Column, n: int) -> Column:
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    count = F.size(words) - (n - 1)
    return F.when(count > 0, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    return x << np.uint64(by) | x >> np.uint64(64 - by)


def _xx64(words: pa.Array, seeds: range) -> np.ndarray:
    """XXH64 of each text under each seed, as seeds by texts: texts of one length up to 31 bytes at once, by the
    algorithm's steps on arrays; longer ones one at a time. A null has the greatest hash."""
    raw = words.cast(pa.large_binary())
    ends, data = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset :][: len(raw) + 1], np.frombuffer(raw.buffers()[2] or b"", np.uint8)
    sizes, out = ends[1:] - ends[:-1], np.full((len(seeds), len(raw)), _M64, np.uint64)
    valid = words.is_valid().to_numpy(zero_copy_only=False)
    for size in np.unique(sizes[valid]).tolist():
        at = np.flatnonzero(valid & (sizes == size))
        if size > 31:
            for i in at.tolist():
                word = data[ends[i] : ends[i + 1]].tobytes()
                out[:, i] = [_xx.xxh64_intdigest(word, seed=k) for k in seeds]
            continue
        chars = data[ends[at][:, None] + np.arange(size)]
        whole = np.ascontiguousarray(chars[:, : size // 8 * 8]).view("<u8")
        eights = _rotated(whole * _P2, 31) * _P1
        four = np.ascontiguousarray(chars[:, size // 8 * 8 :][:, :4]).view("<u4")[:, 0].astype(np.uint64) * _P1 if size % 8 > 3 else None
        ones = chars[:, size // 4 * 4 :].astype(np.uint64) * _P5
        for row, k in enumerate(seeds):
            h = np.full(len(at), (k + int(_P5) + size) & _M64, np.uint64)
            for c in range(eights.shape[1]):
                h = _rotated(h ^ eights[:, c], 27) * _P1 + _P4
            if four is not None:
                h = _rotated(h ^ four, 23) * _P2 + _P3
            for c in range(ones.shape[1]):
                h = _rotated(h ^ ones[:, c], 11) * _P1
            h = (h ^ h >> np.uint64(33)) * _P2
            h = (h ^ h >> np.uint64(29)) * _P3
            out[row, at] = h ^ h >> np.uint64(32)
    return out


def _minhashes(tokens: pa.Array, size: int) -> pa.Array:
    sizes = tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    words = tokens.flatten().dictionary_encode(null_encoding="encode")
    codes, out = words.indices.to_numpy(zero_copy_only=False), np.full((size, len(tokens)), _M64, np.uint64)
    starts = (np.cumsum(sizes) - sizes)[sizes > 0]
    for k, hashes in enumerate(_xx64(words.dictionary, range(size)) if len(codes) else ()):
        out[k, sizes > 0] = np.minimum.reduceat(hashes[codes], starts)
    offsets = np.arange(0, size * len(tokens) + 1, size, dtype=np.int32)
    return pa.ListArray.from_arrays(offsets, out.T.ravel().view(np.int64), mask=tokens.is_null())


def minhash_signature(tokens: Column, size: int) -> Column:
    """The least hash of the tokens for each of so many seeds, as signed numbers. A batch's unlike tokens are hashed once."""

    def batch(t: pa.Array) -> pa.Array:
        return _minhashes(t, size)

    return F.arrow_udf(batch, "array<long>")(tokens)


def minhash_similarity(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.size(a)


def _simhashes(texts: pa.Array, step: int = 1 << 18) -> pa.Array:
    sums, held, places = np.zeros((len(texts), 64), np.int64), [], []

    def add():
        each = pa.array(held, pa.string()).dictionary_encode()
        ones = np.unpackbits(_xx64(each.dictionary, range(1))[0].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        codes, at = each.indices.to_numpy(), 0
        for row, n in places:
            sums[row] += 2 * ones[codes[at : at + n]].sum(axis=0, dtype=np.int64) - n
            at += n
        held.clear(), places.clear()

    for row, text in enumerate(texts):
        words = (text.as_py() or "").split()
        for at in range(0, len(words), step):  # a long text is summed in pieces
            part = words[at : at + step]
            held.extend(part)
            places.append((row, len(part)))
            if len(held) >= step:
                add()
    if held:
        add()
    return pa.array(np.packbits(sums > 0, axis=1, bitorder="little").view("<i8").ravel(), pa.int64(), mask=texts.is_null().to_numpy(zero_copy_only=False))


def simhash(text: Column) -> Column:
    """64-bit simhash of the words."""

    def batch(t: pa.Array) -> pa.Array:
        return _simhashes(t)

    return F.arrow_udf(batch, "long")(text)


def simhash_distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def simhash_similar(a: Column, b: Column, most: int) -> Column:
    return simhash_distance(a, b) <= most
