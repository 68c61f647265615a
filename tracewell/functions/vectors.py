"""Vector functions over arrays of numbers, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine clamped to 0 .. 1; 0 if a vector has no length."""
    lengths = norm(a) * norm(b)
    return F.when(lengths == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), dot(a, b) / lengths)))


def min_max(score: Column, low: Column, high: Column) -> Column:
    """Null is 0, a channel of one value 1, otherwise the place between the least and the largest."""
    return F.when(score.isNull(), F.lit(0.0)).when(high == low, F.lit(1.0)).otherwise((score - low) / F.nullif(high - low, F.lit(0.0)))


def digest_embedding(text: Column, dimension: int = 8, normalize: bool = True) -> Column:
    """A vector made of the text's SHA-256, for tests without a model: bytes of the digests of digest and block number, over 255, with length 1. Null texts have none."""
    if dimension <= 0:
        raise ValueError("dimension must be above 0")
    seed = F.unhex(F.sha2(text, 256))
    blocks = [F.sha2(F.concat(seed, F.unhex(F.lit(f"{i:08x}"))), 256) for i in range(-(-dimension // 32))]
    byte = lambda i: F.conv(F.substring(blocks[i // 32], i % 32 * 2 + 1, 2), 16, 10).cast("double") / 255.0
    values = F.array(*[byte(i) for i in range(dimension)])
    if not normalize:
        return values
    length = F.sqrt(F.aggregate(values, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(length == 0, values).otherwise(F.transform(values, lambda x: x / length))
