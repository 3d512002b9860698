"""A rotation that needs no matrix: random signs, then the Walsh-Hadamard transform, as column expressions.

Vectors are filled up with zeros to a power of two. The signs follow from a rule, so that SQL can say them too.
"""

from __future__ import annotations

import functools
import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .scoring import CENTROIDS, quantize_scalar
from .vectors import let


def padded(dim: int) -> int:
    return 1 << max(0, dim - 1).bit_length()


def signs(dim: int, seed: int) -> list[int]:
    """A sign for each place: bit 16 of a multiple of the place, shifted by the seed, in 32 bits."""
    return [1 - 2 * (((j + 1) * 2654435761 + seed * 40503) % 2**32 >> 16 & 1) for j in range(padded(dim))]


@functools.lru_cache(maxsize=8)
def matrix(dim: int, seed: int) -> np.ndarray:
    """The rotation of vectors of a length that is a power of two, as a matrix (for searches in batches)."""
    n = padded(dim)
    i = np.arange(n)
    return (1.0 - 2.0 * (np.bitwise_count(i[:, None] & i) & 1)) * np.array(signs(dim, seed)) / math.sqrt(n)


def _transform(x: Column, n: int) -> Column:
    """Sums and differences of entries 1, 2, 4, .. places apart."""

    def step(acc: Column, h: Column) -> Column:
        lower = lambda i: i.bitwiseAND(h) == 0
        return F.transform(acc, lambda v, i: F.when(lower(i), v + F.get(acc, i + h)).otherwise(F.get(acc, i - h) - v))

    steps = [F.lit(1 << b) for b in range(n.bit_length() - 1)]
    return F.aggregate(F.array(*steps), x, step) if steps else x


def _signed(x: Column, dim: int, seed: int, factor: float = 1.0) -> Column:
    return F.zip_with(x, F.array(*[F.lit(s * factor) for s in signs(dim, seed)]), lambda a, b: a * b)


def rotate(vector: Column | str, dim: int, seed: int = 42) -> Column:
    n = padded(dim)
    x = F.transform(vector, lambda v: v.cast("double"))
    if n > dim:
        x = F.concat(x, F.array_repeat(F.lit(0.0), n - dim))
    return _transform(_signed(x, dim, seed, 1 / math.sqrt(n)), n)


def rotate_back(rotated: Column | str, dim: int, seed: int = 42) -> Column:
    n = padded(dim)
    x = _signed(_transform(F.transform(rotated, lambda v: v / math.sqrt(n)), n), dim, seed)
    return F.slice(x, 1, dim) if n > dim else x


def codes(rotated: Column | str, bits: int, dim: int) -> Column:
    """Cells of the entries of a rotated unit vector."""
    scale = F.lit(math.sqrt(padded(dim)))
    return F.transform(rotated, lambda v: quantize_scalar(v * scale, bits))


def centroids(code: Column | str, bits: int, dim: int) -> Column:
    """What codes stand for: the entries of a rotated vector of about unit length."""
    table = F.array(*[F.lit(c / math.sqrt(padded(dim))) for c in CENTROIDS[bits]])
    return F.transform(code, lambda c: F.get(table, c))


def pack(code: Column | str, bits: int, dim: int) -> Column:
    """Codes as bytes, low bit first, running over byte borders."""
    powers = F.array(*[F.lit(1 << b) for b in range(8)])
    flat = F.flatten(F.transform(code, lambda c: F.transform(F.slice(powers, 1, bits), lambda p: (c.bitwiseAND(p) > 0).cast("int"))))
    places = F.sequence(F.lit(0), F.lit(-(-padded(dim) * bits // 8) - 1))
    # eight bits make a byte; what is missing at the end is zero
    byte = lambda all_bits, k: F.aggregate(F.zip_with(F.slice(all_bits, k * 8 + 1, 8), powers, lambda b, p: F.coalesce(b, F.lit(0)) * p), F.lit(0), lambda acc, x: acc + x)
    return F.unhex(F.array_join(let(flat, lambda all_bits: F.transform(places, lambda k: F.lpad(F.hex(byte(all_bits, k)), 2, "0"))), ""))
