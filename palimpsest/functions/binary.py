"""Hashes, byte-wise exclusive or, compression, and tensor element types."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import BinaryType

# Element types of the tensor file format: (bytes, NumPy type); BF16 has no NumPy type (fixed values).
DTYPES = {
    "F64": (8, "<f8"), "F32": (4, "<f4"), "F16": (2, "<f2"), "BF16": (2, None),
    "I64": (8, "<i8"), "I32": (4, "<i4"), "I16": (2, "<i2"), "I8": (1, "i1"),
    "U64": (8, "<u8"), "U32": (4, "<u4"), "U16": (2, "<u2"), "U8": (1, "u1"), "BOOL": (1, "?"),
}


def content_hash(data: Column) -> Column:
    """SHA-256 in hex; null for null."""
    return F.sha2(data, 256)


def item_size(dtype: str) -> int:
    if dtype not in DTYPES:
        raise ValueError(f"unknown element type {dtype!r}")
    return DTYPES[dtype][0]


def decode(raw: bytes, dtype: str, shape) -> np.ndarray:
    """Tensor bytes as numbers; BF16 becomes single precision."""
    item_size(dtype)
    if dtype == "BF16":
        flat = (np.frombuffer(raw, dtype="<u2").astype(np.uint32) << 16).view(np.float32)
    else:
        flat = np.frombuffer(raw, dtype=DTYPES[dtype][1])
    return flat.reshape([int(n) for n in shape])


def encode(values: np.ndarray, dtype: str) -> bytes:
    """Numbers as tensor bytes; BF16 is rounded to the nearest, ties to even."""
    item_size(dtype)
    if dtype == "BF16":
        bits = np.ascontiguousarray(values, dtype="<f4").view(np.uint32)
        return ((bits + 0x7FFF + (bits >> 16 & 1)) >> 16).astype("<u2").tobytes()
    return np.ascontiguousarray(values).astype(DTYPES[dtype][1]).tobytes()


def exclusive_or(a: bytes, b: bytes) -> bytes:
    if len(a) != len(b):
        raise ValueError(f"lengths differ: {len(a)} and {len(b)}")
    return np.bitwise_xor(np.frombuffer(a, dtype=np.uint8), np.frombuffer(b, dtype=np.uint8)).tobytes()


#: What the first byte of compressed bytes says.
STORED, ZSTANDARD, DEFLATE = 0, 1, 2


def compress(data: bytes, level: int = 3) -> bytes:
    """The shorter of the bytes and their compressed form, behind a byte that says which it is."""
    try:
        import zstandard
    except ImportError:
        codec, packed = DEFLATE, zlib.compress(data, level)
    else:
        codec, packed = ZSTANDARD, zstandard.compress(data, level)
    return bytes([codec]) + packed if len(packed) < len(data) else bytes([STORED]) + data


def decompress(data: bytes) -> bytes:
    """The inverse of ``compress``."""
    codec, packed = data[0], data[1:]
    if codec == ZSTANDARD:
        import zstandard

        return zstandard.decompress(packed)
    if codec not in (STORED, DEFLATE):
        raise ValueError(f"unknown codec {codec}")
    return packed if codec == STORED else zlib.decompress(packed)


def pack_u64(n: int) -> bytes:
    return struct.pack("<Q", n)


def unpack_u64(raw: bytes) -> int:
    return struct.unpack("<Q", raw[:8])[0]


def _each(function, data: pa.Array) -> pa.Array:
    return pa.array([None if x is None else function(x) for x in data.to_numpy(zero_copy_only=False)], pa.binary())


def _bytes_of(data: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The rows' bytes end to end, and their bounds."""
    bounds = np.frombuffer(data.buffers()[1], dtype=np.int32)[data.offset : data.offset + len(data) + 1]
    raw = data.buffers()[2]
    return (np.frombuffer(raw, dtype=np.uint8) if raw else np.zeros(0, np.uint8))[bounds[0] : bounds[-1]], bounds - bounds[0]


@arrow_udf(BinaryType())
def xor_column(a: pa.Array, b: pa.Array) -> pa.Array:
    """Byte-wise exclusive or of columns of equal lengths, a batch at once; null for null."""
    valid = pc.and_(a.is_valid(), b.is_valid())
    x, y = (pc.if_else(valid, z, pa.scalar(b"", pa.binary())) for z in (a, b))
    (p, bounds), (q, others) = _bytes_of(x), _bytes_of(y)
    if not np.array_equal(bounds, others):
        raise ValueError("lengths differ")
    mixed = pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.bitwise_xor(p, q))])
    return pc.if_else(valid, mixed, pa.scalar(None, pa.binary()))


@arrow_udf(BinaryType())
def compress_column(data: pa.Array) -> pa.Array:
    return _each(compress, data)


@arrow_udf(BinaryType())
def decompress_column(data: pa.Array) -> pa.Array:
    return _each(decompress, data)
