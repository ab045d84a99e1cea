"""Vector and hash columns, all inside whole-stage codegen."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, functions as F

from .paths import _col


def quantize_unit(vec) -> Column:
    """Unit vector to signed bytes: x*127, halves to even, clamped to +-127."""
    return F.transform(_col(vec), lambda x: F.greatest(
        F.lit(-127), F.least(F.lit(127), F.bround(x.cast("double") * 127, 0).cast("int"))).cast("tinyint"))


def int_dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("int") * y.cast("int")),
                       F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0)))


def int8_cosine(a, b) -> Column:
    """Dot product of quantised vectors over 127^2, clamped to +-1."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), int_dot(a, b) / F.lit(127.0 * 127.0)))


def sign_words(vec, dim: int) -> Column:
    """One bit per negative component, packed into 64-bit words."""
    def word(w: int) -> Column:
        part = F.slice(_col(vec), w * 64 + 1, 64)
        bits = F.transform(part, lambda x, i: F.when(
            x < 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint")))
        return F.aggregate(bits, F.lit(0).cast("bigint"), lambda s, x: s.bitwiseOR(x))
    return F.array(*[word(w) for w in range((dim + 63) // 64)])


def hamming(a, b) -> Column:
    return F.bit_count(_col(a).bitwiseXOR(_col(b)))


def hamming_words(a, b) -> Column:
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: F.bit_count(x.bitwiseXOR(y))),
                       F.lit(0), lambda s, x: s + x)


def sign_bound(threshold: float, dim: int) -> int:
    """Largest sign-pattern distance still worth a dot product (expected distance + 4.6 sigma)."""
    p = math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    return math.ceil(dim * p + 4.6 * math.sqrt(dim * p * (1 - p)))


def allowed_bits(percent: float) -> int:
    """Bits of a 64-bit hash that may differ at a percent threshold (single-precision ratio, floored)."""
    ratio = float(np.float32(percent) / np.float32(100.0))
    return int(math.floor((1.0 - ratio) * 64))


def required_matches(samples: int, ratio: float) -> int:
    """Positions that must pass: ceil(n * ratio) in single precision, at least one."""
    clipped = np.float32(min(max(np.float32(ratio), np.float32(0.01)), np.float32(1.0)))
    return max(1, int(math.ceil(float(np.float32(samples) * clipped))))


def unsigned_text(word) -> Column:
    """Signed 64-bit pattern as its unsigned decimal."""
    w = _col(word).cast("decimal(20,0)")
    return F.when(w < 0, w + F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(w)
