"""Hash functions with fixed results, computed for a whole Arrow batch at a time.

Values of a batch are sorted into one byte matrix and hashed position by position, so the Python
loop runs over positions, not over rows. CRC-32 is the engine's own function.
"""

from __future__ import annotations

import binascii
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Seed and constants of the 64-bit hashes.
BUCKET_SEED = 19780211
MURMUR_MUL, MURMUR_SHIFT = 0xC6A4A7935BD1E995, 47
FNV_BASIS, FNV_MUL = 14695981039346656037, 109951162811
# Moduli of the checksums and of the small Adler sums (with the bits of a half).
CHECKSUM_MODULUS = {6: 61, 8: 251}
ADLER_MODULUS = {6: 7, 8: 13, 16: 251}

_U = np.uint64


def _matrix(values: list[bytes], multiple: int = 1) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(v) for v in values], dtype=np.int64)
    width = -(-max(1, int(sizes.max(initial=0))) // multiple) * multiple
    return np.frombuffer(b"".join(v.ljust(width, b"\0") for v in values), dtype=np.uint8).reshape(len(values), width), sizes


def _in_classes(values: list[bytes], fn) -> np.ndarray:
    """Apply ``fn`` to values of similar length together, so that one long value pads no others."""
    out = np.zeros(len(values), dtype=np.uint64)
    classes: dict[int, list[int]] = {}
    for i, v in enumerate(values):
        classes.setdefault(len(v).bit_length(), []).append(i)
    for at in classes.values():
        out[at] = fn([values[i] for i in at])
    return out


def fnv(values: list[bytes]) -> np.ndarray:
    def block(vs):
        m, sizes = _matrix(vs)
        h = np.full(len(vs), FNV_BASIS, dtype=np.uint64)
        for j in range(m.shape[1]):
            h = np.where(j < sizes, (h ^ m[:, j]) * _U(FNV_MUL), h)
        return h

    with np.errstate(over="ignore"):
        return _in_classes(values, block)


def murmur(values: list[bytes], seed: int = BUCKET_SEED) -> np.ndarray:
    mul, shift = _U(MURMUR_MUL), _U(MURMUR_SHIFT)

    def block(vs):
        m, sizes = _matrix(vs, 8)
        words = np.ascontiguousarray(m).view("<u8")
        h = _U(seed) ^ sizes.astype(np.uint64) * mul
        whole = sizes // 8
        for j in range(words.shape[1]):
            w = words[:, j] * mul
            w = (w ^ w >> shift) * mul
            mixed = h * mul ^ w
            tail = (h ^ words[:, j]) * mul
            h = np.where(j < whole, mixed, np.where((j == whole) & (sizes % 8 > 0), tail, h))
        h = (h ^ h >> shift) * mul
        return h ^ h >> shift

    with np.errstate(over="ignore"):
        return _in_classes(values, block)


def _folded(h: np.ndarray, n: int) -> np.ndarray:
    """Hash to ``n`` places: for 32-bit counts the halves are xor-ed and rotated by 16 bits first."""
    if n <= 2**32 - 1:
        x = (h >> _U(32)) ^ (h & _U(0xFFFFFFFF))
        h = (x >> _U(16)) | (x << _U(16) & _U(0xFFFFFFFF))
    return h % _U(n)


def _adler(v: bytes, modulus: int, half: int) -> int:
    b = np.frombuffer(v, dtype=np.uint8).astype(object if len(v) > 1 << 20 else np.int64)
    a = 1 + int(b.sum())
    s = len(v) + int((b * np.arange(len(v), 0, -1)).sum())
    return (s % modulus) << half | a % modulus


def _crc_table(bits: int, poly: int, reflected: bool) -> np.ndarray:
    """Register after one byte; reflected registers shift right, the others stand at the byte's top."""
    table = []
    for c in range(256):
        for _ in range(8):
            if reflected:
                c = c >> 1 ^ (poly if c & 1 else 0)
            else:
                c = c << 1 & 0xFF ^ (poly << 8 - bits if c & 0x80 else 0)
        table.append(c)
    return np.array(table, dtype=np.uint64)


# Polynomials of the short CRCs; the one of 4 bits is reflected.
_CRC = {4: _crc_table(4, 0xC, True), 8: _crc_table(8, 0x7, False)}


def _short_crc(values: list[bytes], bits: int) -> np.ndarray:
    def block(vs):
        m, sizes = _matrix(vs)
        c = np.zeros(len(vs), dtype=np.uint64)
        for j in range(m.shape[1]):
            c = np.where(j < sizes, _CRC[bits][(c ^ m[:, j]).astype(np.int64)], c)
        return c

    return _in_classes(values, block)


def _hash_udf(fn) -> Column:
    @F.pandas_udf("long")
    def run(s: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(s), index=s.index, dtype="Int64")
        at = np.flatnonzero(s.notna().to_numpy())
        if len(at):
            out.iloc[at] = np.asarray(fn([bytes(v) for v in s.iloc[at]]), dtype=np.uint64).view(np.int64)
        return out

    return run


def hash_murmur(b: Column, seed: int = BUCKET_SEED) -> Column:
    """64-bit pattern as a long; :func:`keyweave.functions.codecs.unsigned` gives the number."""
    return _hash_udf(lambda v: murmur(v, seed))(b.cast("binary"))


def hash_fnv(b: Column) -> Column:
    return _hash_udf(fnv)(b.cast("binary"))


def bucket_of(b: Column, n: int) -> Column:
    """Bucket of a key among ``n``; as a long (its bit pattern beyond 2**63)."""
    return _hash_udf(lambda v: _folded(murmur(v), n))(b.cast("binary"))


def shard_of(b: Column, n: int) -> Column:
    return _hash_udf(lambda v: _folded(fnv(v), n))(b.cast("binary"))


def cache_slot_of(b: Column, n: int = 32) -> Column:
    """Slot of a key in a cache of ``n`` slots: the low byte of its bucket hash."""
    return _hash_udf(lambda v: (murmur(v) & _U(0xFF)) % _U(n))(b.cast("binary"))


def checksum(b: Column, bits: int = 8) -> Column:
    return _hash_udf(lambda vs: [sum(v) % CHECKSUM_MODULUS[bits] for v in vs])(b.cast("binary"))


def checksum_pair(a: Column, b: Column, bits: int = 8) -> Column:
    return checksum(F.concat(a.cast("binary"), b.cast("binary")), bits)


def adler(b: Column, bits: int = 32) -> Column:
    if bits == 32:
        return _hash_udf(lambda vs: [zlib.adler32(v) for v in vs])(b.cast("binary"))
    return _hash_udf(lambda vs: [_adler(v, ADLER_MODULUS[bits], bits // 2) for v in vs])(b.cast("binary"))


def crc(b: Column, bits: int = 32) -> Column:
    if bits == 32:
        return F.crc32(b.cast("binary"))
    if bits == 16:
        return _hash_udf(lambda vs: [binascii.crc_hqx(v, 0) for v in vs])(b.cast("binary"))
    return _hash_udf(lambda vs: _short_crc(vs, bits))(b.cast("binary"))
