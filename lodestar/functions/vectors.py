"""Vector kernels as Column expressions over array<double>, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_doubles(vector: Column) -> Column:
    """Accumulate in double whatever the stored type."""
    return vector.cast("array<double>")


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def magnitude(a: Column) -> Column:
    return F.sqrt(total(F.transform(a, lambda x: x * x)))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector has no length."""
    norms = magnitude(a) * magnitude(b)
    return F.when(norms > 0, dot(a, b) / norms).otherwise(F.lit(0.0))


def squared_l2(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(squared_l2(a, b))


def scale(a: Column, by: Column) -> Column:
    return F.transform(a, lambda x: x * by)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def normalize(a: Column) -> Column:
    """The unit vector; a vector without length stays as it is."""
    size = magnitude(a)
    return F.when(size > 0, F.transform(a, lambda x: x / size)).otherwise(a)


def gaussian_kernel(a: Column, b: Column, sigma: float) -> Column:
    """Affective distance: exp(-|a - b|^2 / (2 sigma^2))."""
    return F.exp(-squared_l2(a, b) / F.lit(2.0 * sigma * sigma))


def gaussian_kl(mean_q: Column, precision_q: Column, mean_p: Column, precision_p: Column) -> Column:
    """KL divergence of diagonal Gaussians given by means and precisions."""
    pairs = F.arrays_zip(mean_q.alias("m"), precision_q.alias("p"), mean_p.alias("n"), precision_p.alias("r"))
    each = F.transform(pairs, lambda e: 0.5 * (F.log(e["p"] / e["r"]) + e["r"] / e["p"] + e["r"] * (e["m"] - e["n"]) * (e["m"] - e["n"]) - 1.0))
    return total(each)


def gaussian_nll(value: Column, mean: Column, precision: Column) -> Column:
    """Negative log-likelihood under a diagonal Gaussian."""
    rows = F.arrays_zip(value.alias("v"), mean.alias("m"), precision.alias("p"))
    return total(F.transform(rows, lambda e: 0.5 * (e["p"] * (e["v"] - e["m"]) * (e["v"] - e["m"]) - F.log(e["p"]) + F.lit(1.8378770664093453))))


def fused_precision_mean(mean_a: Column, precision_a: Column, mean_b: Column, precision_b: Column) -> Column:
    """Precision-weighted fusion of two estimates."""
    rows = F.arrays_zip(mean_a.alias("a"), precision_a.alias("p"), mean_b.alias("b"), precision_b.alias("q"))
    return F.transform(rows, lambda e: (e["a"] * e["p"] + e["b"] * e["q"]) / (e["p"] + e["q"]))


def weighted_error(actual: Column, predicted: Column, precision: Column) -> Column:
    """Precision-weighted prediction error of predictive coding."""
    rows = F.arrays_zip(actual.alias("a"), predicted.alias("b"), precision.alias("p"))
    return F.transform(rows, lambda e: e["p"] * (e["a"] - e["b"]))


def error_energy(actual: Column, predicted: Column, precision: Column) -> Column:
    rows = F.arrays_zip(actual.alias("a"), predicted.alias("b"), precision.alias("p"))
    return 0.5 * total(F.transform(rows, lambda e: e["p"] * (e["a"] - e["b"]) * (e["a"] - e["b"])))


def manifold_squared(a: Column, b: Column, diagonal: Column, components: list[Column]) -> Column:
    """Squared distance under a diagonal plus low-rank metric."""
    gap = F.zip_with(a, b, lambda x, y: x - y)
    own = total(F.zip_with(gap, diagonal, lambda d, s: s * d * d))
    for component in components:
        part = total(F.zip_with(gap, component, lambda d, c: d * c))
        own = own + part * part
    return own


def to_codes(vector: Column, minimum: Column, inverse: Column) -> Column:
    """INT8 codes: round((x - min) * inverse), clamped to 0..255."""
    rows = F.arrays_zip(vector.alias("x"), minimum.alias("m"), inverse.alias("i"))
    return F.transform(rows, lambda e: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((e["x"] - e["m"]) * e["i"] + 0.5))).cast("int"))


def from_codes(codes: Column, minimum: Column, step: Column) -> Column:
    rows = F.arrays_zip(codes.alias("q"), minimum.alias("m"), step.alias("s"))
    return F.transform(rows, lambda e: e["q"] * e["s"] + e["m"])


def packed(codes: Column, bits: int) -> Column:
    """Several small codes in one byte, the first in the low bits; as ints."""
    per = 8 // bits
    places = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(codes) / F.lit(per)).cast("int") - 1, F.lit(0)))

    def byte(i: Column) -> Column:
        value = F.lit(0)
        for k in range(per):
            value = value.bitwiseOR(F.shiftleft(F.coalesce(F.get(codes, i * per + k), F.lit(0)), bits * k))
        return value

    return F.transform(places, byte)


def unpacked(bytes_: Column, bits: int) -> Column:
    """The codes of packed bytes, with the padding of the last byte."""
    mask = (1 << bits) - 1
    parts = F.transform(bytes_, lambda b: F.array(*[F.shiftright(b, bits * k).bitwiseAND(F.lit(mask)) for k in range(8 // bits)]))
    return F.flatten(parts)
