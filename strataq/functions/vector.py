"""Vectors and 256-bit fingerprints as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORDS = 4


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if either has no length."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def l2_normalize(a: Column) -> Column:
    """Unit length; a vector whose squared length is 1e-12 or less stays as it is."""
    return F.when(dot(a, a) <= 1e-12, a.cast("array<double>")).otherwise(F.transform(a, lambda x: x.cast("double") / norm(a)))


def hamming(a: str, b: str, words: int = WORDS) -> Column:
    """Differing bits of the fingerprints in columns a0 a1 .. and b0 b1 .."""
    total = F.lit(0)
    for k in range(words):
        total = total + F.bit_count(F.col(f"{a}{k}").bitwiseXOR(F.col(f"{b}{k}")))
    return total


def hamming_channels(a: str, b: str, words: int = WORDS) -> Column:
    """Differing bits of each 64-bit channel."""
    return F.array(*[F.bit_count(F.col(f"{a}{k}").bitwiseXOR(F.col(f"{b}{k}"))) for k in range(words)])


def hamming_masked(a: str, b: str, mask: str, words: int = WORDS) -> Column:
    """Differing bits among those that the mask has."""
    total = F.lit(0)
    for k in range(words):
        total = total + F.bit_count(F.col(f"{a}{k}").bitwiseXOR(F.col(f"{b}{k}")).bitwiseAND(F.col(f"{mask}{k}")))
    return total


def similarity_weighted(a: str, b: str, weights: tuple[float, ...]) -> Column:
    """Mean over channels of 1 - distance / 64, weighted; 0 without weight."""
    total = sum(weights)
    if not total:
        return F.lit(0.0)
    parts = [w * (1 - F.bit_count(F.col(f"{a}{k}").bitwiseXOR(F.col(f"{b}{k}"))) / 64.0) for k, w in enumerate(weights)]
    return sum(parts[1:], parts[0]) / total


def pack_signs(values: Column, first: int) -> Column:
    """64 bits as a long: bit i is set if values[first + i] is positive."""
    part = F.slice(values, first + 1, 64)
    indexed = F.transform(part, lambda x, i: F.struct(i.alias("i"), (x > 0).alias("up")))
    return F.aggregate(indexed, F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(F.when(x["up"], F.call_function("shiftleft", F.lit(1).cast("long"), x["i"])).otherwise(F.lit(0).cast("long"))))


#: Flags of an entity and the factor each brings to its score.
PUBLIC, ROUTE, FUNCTION, TYPE, ROOT, TEST = 1, 2, 4, 8, 16, 32


def prior_multiplier(flags: Column) -> Column:
    """Public 1.15; route 1.20, else function 1.10, else type 1.05; root scope 1.05; test or mock 0.75."""

    def has(bit: int) -> Column:
        return flags.bitwiseAND(F.lit(bit)) != 0

    kind = F.when(has(ROUTE), 1.20).when(has(FUNCTION), 1.10).when(has(TYPE), 1.05).otherwise(1.0)
    return F.when(has(PUBLIC), 1.15).otherwise(1.0) * kind * F.when(has(ROOT), 1.05).otherwise(1.0) * F.when(has(TEST), 0.75).otherwise(1.0)
