"""Byte codecs: big-endian numbers, variable-length integers, serialised pairs, lists and maps."""

from __future__ import annotations

import math
import struct
from collections.abc import Iterable
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Plain Python codecs, used in Arrow batches and by the file formats.


def put_varint(n: int) -> bytes:
    """Seven bits a byte, most significant first, all but the last byte with the high bit set."""
    n &= 2**64 - 1
    out = [n & 0x7F]
    while n := n >> 7:
        out.append(n & 0x7F | 0x80)
    return bytes(reversed(out))


def get_varint(data: bytes, at: int = 0) -> tuple[int, int]:
    """(value, position after it); position equals ``at`` if the number is cut off."""
    n = 0
    for i in range(at, len(data)):
        n = n << 7 | data[i] & 0x7F
        if data[i] < 0x80:
            return n & (2**64 - 1), i + 1
    return 0, at


def zigzag(n: int) -> int:
    return n << 1 if n >= 0 else (-n << 1) - 1


def unzigzag(n: int) -> int:
    return -(n + 1 >> 1) if n & 1 else n >> 1


def _signed(n: int) -> int:
    return n - 2**64 if n >= 2**63 else n


def put_strings(values: Iterable[bytes]) -> bytes:
    return b"".join(put_varint(len(v)) + v for v in values)


def get_strings(data: bytes) -> list[bytes]:
    """Values up to the first that is cut off."""
    out, at = [], 0
    while at < len(data):
        n, start = get_varint(data, at)
        if start == at or start + n > len(data):
            break
        out.append(data[start : start + n])
        at = start + n
    return out


# Columns


def int_to_big_endian(n: Column, size: int = 8) -> Column:
    """``size`` low bytes (1 to 8) of a long, most significant first."""
    return F.unhex(F.right(F.lpad(F.hex(n.cast("long")), 16, "0"), F.lit(2 * size)))


def big_endian_to_int(b: Column) -> Column:
    """Unsigned value of the first eight bytes at most, as a long with its bit pattern; empty is 0."""
    h = F.hex(F.substring(b, 1, 8))
    return F.when(b.isNotNull(), F.when(F.length(b) == 0, F.lit(0)).otherwise(F.conv(h, 16, -10).cast("long")))


def unsigned(n: Column) -> Column:
    """A long's bit pattern as an unsigned decimal."""
    d = n.cast("decimal(20,0)")
    return F.when(n < 0, d + F.lit(Decimal(2**64))).otherwise(d).cast("decimal(20,0)")


def _udf(kind: str, fn):
    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else fn(x))

    return run


def _number_udf(kind: str, fn):
    """For long input: null would turn a batch of longs into floats, so it is passed beside."""

    @F.pandas_udf(kind)
    def run(s: pd.Series, known: pd.Series) -> pd.Series:
        return pd.Series([fn(int(v)) if k else None for v, k in zip(s, known)], dtype=object)

    return lambda n: run(F.coalesce(n.cast("long"), F.lit(0)), n.isNotNull())


def _extended(v: float) -> bytes:
    """A double as sign, 15 bits of exponent and 64 of significand, in the last 10 of 16 bytes."""
    bits = struct.unpack(">Q", struct.pack(">d", v))[0]
    sign, exponent, fraction = bits >> 63, bits >> 52 & 0x7FF, bits & (1 << 52) - 1
    if exponent == 0x7FF:
        wide, significand = 0x7FFF, 1 << 63 | fraction << 11
    elif exponent:
        wide, significand = exponent + 16383 - 1023, 1 << 63 | fraction << 11
    elif fraction:
        shift = 64 - fraction.bit_length()
        wide, significand = 16383 - 1011 - shift, fraction << shift
    else:
        wide = significand = 0
    return b"\0" * 6 + struct.pack(">HQ", sign << 15 | wide, significand)


def _from_extended(b: bytes) -> float:
    head, significand = struct.unpack(">HQ", b[6:])
    sign, wide = (-1.0 if head >> 15 else 1.0), head & 0x7FFF
    if wide == 0x7FFF:
        return math.nan if significand << 1 & 2**64 - 1 else sign * math.inf
    try:
        return sign * math.ldexp(significand, max(wide, 1) - 16383 - 63)
    except OverflowError:
        return sign * math.inf


def float_to_big_endian(x: Column, size: int = 8) -> Column:
    """4 or 8 bytes, or 16 with the extended format in the last 10; NaN keeps its pattern, null stays null."""
    code = {4: ">f", 8: ">d", 16: ""}[size]
    pack = (lambda v: _extended(v)) if size == 16 else (lambda v: struct.pack(code, v))

    @F.pandas_udf("binary")
    def run(values: pd.Series, known: pd.Series) -> pd.Series:
        return pd.Series([pack(v) if k else None for v, k in zip(values, known)], dtype=object)

    return run(x.cast("double"), x.isNotNull())


def big_endian_to_float(b: Column) -> Column:
    """4, 8 or 16 bytes; any other length gives 0."""

    def one(v: bytes) -> float:
        if len(v) == 16:
            return _from_extended(v)
        return struct.unpack(">d", v)[0] if len(v) == 8 else struct.unpack(">f", v)[0] if len(v) == 4 else 0.0

    return _udf("double", one)(b)


def int_to_varint(n: Column, signed: bool = False) -> Column:
    return _number_udf("binary", lambda v: put_varint(zigzag(v) if signed else v))(n)


def varint_to_int(b: Column, signed: bool = False) -> Column:
    return _udf("long", lambda v: unzigzag(get_varint(v)[0]) if signed else _signed(get_varint(v)[0]))(b)


def _bytes(x) -> bytes:
    return x.encode() if isinstance(x, str) else b"" if x is None else bytes(x)


def serialize_pair(first: Column, second: Column) -> Column:
    return serialize_list(F.array(first.cast("binary"), second.cast("binary")))


def deserialize_pair(b: Column) -> Column:
    """Struct of two byte strings; a missing part is null."""
    parts = deserialize_list(b)
    return F.struct(F.get(parts, F.lit(0)).alias("first"), F.get(parts, F.lit(1)).alias("second"))


def first_of_pair(b: Column) -> Column:
    return F.get(deserialize_list(b), F.lit(0))


def serialize_list(values: Column) -> Column:
    """Byte strings or strings; null elements become empty."""
    return _udf("binary", lambda v: put_strings(map(_bytes, v)))(values)


def deserialize_list(b: Column) -> Column:
    return _udf("array<binary>", get_strings)(b)


def serialize_map(m: Column) -> Column:
    """Entries in the order of their keys' bytes."""
    entries = F.map_entries(m)
    flat = F.flatten(F.transform(F.array_sort(F.transform(entries, lambda e: F.struct(e["key"].cast("binary").alias("k"), e["value"].cast("binary").alias("v")))), lambda e: F.array(e["k"], e["v"])))
    return serialize_list(flat)


def deserialize_map(b: Column) -> Column:
    """Of equal keys the last counts; a cut-off entry is dropped."""

    def one(data: bytes) -> dict[bytes, bytes]:
        parts = get_strings(data)
        return dict(zip(parts[::2], parts[1::2]))

    return _udf("map<binary,binary>", one)(b)


_KINDS = {"byte": ">i1", "short": ">i2", "int": ">i4", "long": ">i8", "float": ">f4", "double": ">f8"}


def serialize_numbers(values: Column, kind: str = "long") -> Column:
    """Fixed-width big-endian array."""
    return _udf("binary", lambda v: np.asarray(v, dtype=_KINDS[kind]).tobytes())(values)


def deserialize_numbers(b: Column, kind: str = "long") -> Column:
    """A cut-off last element is dropped."""
    width = np.dtype(_KINDS[kind]).itemsize
    return _udf(f"array<{kind}>", lambda v: np.frombuffer(v[: len(v) // width * width], dtype=_KINDS[kind]).astype(_KINDS[kind][1:]).tolist())(b)


def serialize_varints(values: Column, signed: bool = False) -> Column:
    return _udf("binary", lambda v: b"".join(put_varint(zigzag(int(n)) if signed else int(n)) for n in v))(values)


def deserialize_varints(b: Column, signed: bool = False) -> Column:
    def one(data: bytes) -> list[int]:
        out, n = [], 0
        for i, c in enumerate(data):
            n = n << 7 | c & 0x7F
            if c < 0x80 or i == len(data) - 1:
                n &= 2**64 - 1
                out.append(unzigzag(n) if signed else _signed(n))
                n = 0
        return out

    return _udf("array<long>", one)(b)


def compress(b: Column, codec: str = "zlib") -> Column:
    """Per-value compression: none, zlib, zstd, lz4 or lzma."""
    return _udf("binary", _codec(codec)[0])(b.cast("binary"))


def decompress(b: Column, codec: str = "zlib") -> Column:
    """Broken data gives null."""
    undo = _codec(codec)[1]

    def one(v: bytes) -> bytes | None:
        try:
            return undo(v)
        except Exception:
            return None

    return _udf("binary", one)(b)


def _codec(name: str):
    if name == "none":
        import binascii

        def check(v: bytes) -> bytes:
            if struct.unpack(">I", v[:4])[0] != binascii.crc32(v[4:]):
                raise ValueError("checksum")
            return v[4:]

        return (lambda v: struct.pack(">I", binascii.crc32(v)) + v), check
    if name == "zlib":
        import zlib

        return zlib.compress, zlib.decompress
    if name == "lzma":
        import lzma

        # A dictionary no larger than the value: small values would else cost megabytes each.
        fit = lambda v: [{"id": lzma.FILTER_LZMA2, "preset": 6, "dict_size": max(4096, min(len(v), 1 << 23))}]
        return (lambda v: lzma.compress(v, filters=fit(v))), lzma.decompress
    if name == "zstd":
        import zstandard

        return (lambda v: zstandard.ZstdCompressor().compress(v)), (lambda v: zstandard.ZstdDecompressor().decompress(v, max_output_size=1 << 31))
    if name == "lz4":
        from pyarrow import compress as pack
        from pyarrow import decompress as unpack

        # The block format does not tell the size, so it stands in front. No block grows more than
        # 255-fold, so that broken data cannot ask for memory at will.
        def undo(v: bytes) -> bytes:
            size = struct.unpack(">I", v[:4])[0]
            if size > 255 * len(v):
                raise ValueError("size")
            return unpack(v[4:], size, "lz4_raw", asbytes=True) if len(v) > 4 else v[4:]

        return (lambda v: struct.pack(">I", len(v)) + (pack(v, "lz4_raw", asbytes=True) if v else b"")), undo
    raise ValueError(f"no such codec: {name}")


def encrypt(b: Column, key: bytes) -> Column:
    """AES in GCM mode with a random start; the key has 16, 24 or 32 bytes."""
    return F.aes_encrypt(b.cast("binary"), F.lit(bytearray(key)))


def decrypt(b: Column, key: bytes) -> Column:
    """Null for what was not encrypted with the key."""
    return F.try_aes_decrypt(b, F.lit(bytearray(key)))
