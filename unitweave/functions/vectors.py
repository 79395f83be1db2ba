"""Column expressions over dense vectors (array<double>); all stay in the JVM."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the data model.
UNVOICED, UNVOICED_STDS, LOG_FLOOR, PROHIBITED, EMERGENCY = -1000.0, -20.0, -1.0e10, 1.0e15, 5.0e8


def as_doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dist2(a: Column, b: Column) -> Column:
    """Squared Euclidean distance."""
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def distance(a: Column, b: Column, order: float = 1.0) -> Column:
    """Join distance: the Euclidean one over the order."""
    return F.sqrt(dist2(a, b)) / order


def literal(values: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in values))


def weighted(v: Column, w: Column) -> Column:
    return F.zip_with(v, w, lambda x, y: x * y)


def deweighted(v: Column, w: Column) -> Column:
    return F.zip_with(v, w, lambda x, y: F.try_divide(x, y))


def stream_slice(v: Column, start: int, width: int) -> Column:
    """Coefficients [start, start + width) of a composed vector."""
    return F.slice(v, start + 1, width)


def truncated(v: Column, widths: Sequence[int], keep: Sequence[int]) -> Column:
    """The first keep[i] coefficients of each stream; -1 keeps all."""
    parts, at = [], 0
    for width, n in zip(widths, keep):
        parts.append(stream_slice(v, at, width if n < 0 else min(n, width)))
        at += width
    return F.concat(*parts)


def expanded_weights(stream_weights: Sequence[float], widths: Sequence[int], side_weight: float = 1.0, repeat: int = 1) -> list[float]:
    """A weight for each coefficient from one for each stream; repeat tiles it (several frames in a vector)."""
    return [w * side_weight for w, n in zip(stream_weights, widths) for _ in range(n)] * repeat


def standardised(v: Column, mean: Column, std: Column) -> Column:
    """(v - mean) / std for each coefficient; unvoiced entries become -20 stds."""
    z = F.arrays_zip(v.alias("v"), mean.alias("m"), std.alias("s"))
    return F.transform(z, lambda x: F.when(x["v"] == UNVOICED, x["s"] * UNVOICED_STDS).otherwise(F.try_divide(x["v"] - x["m"], x["s"])))


def destandardised(v: Column, mean: Column, std: Column) -> Column:
    z = F.arrays_zip(v.alias("v"), mean.alias("m"), std.alias("s"))
    return F.transform(z, lambda x: x["v"] * x["s"] + x["m"])


def unvoiced_marked(x: Column) -> Column:
    """F0 values that are not above 0 become the unvoiced sentinel."""
    return F.when(x <= 0, F.lit(UNVOICED)).otherwise(x)


def outliers_zeroed(v: Column, bound: float = 100.0) -> Column:
    return F.transform(v, lambda x: F.when(F.abs(x) > bound, F.lit(0.0)).otherwise(x))


def finite(v: Column) -> Column:
    return ~F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))


def streams_summed(squares: Column, widths: Sequence[int]) -> list[Column]:
    """The sum of a vector of squared errors for each stream."""
    at, out = 0, []
    for n in widths:
        out.append(total(stream_slice(squares, at, n)))
        at += n
    return out


def hann(size: int) -> list[float]:
    """Symmetric Hann window; its end weights are 0."""
    return [1.0] if size == 1 else [0.5 - 0.5 * math.cos(2 * math.pi * i / (size - 1)) for i in range(size)]


def window_weights(kind: str, size: int) -> list[float]:
    """Named windows: flat, hanning, hamming, bartlett, blackman."""
    at = [i / (size - 1) if size > 1 else 0.5 for i in range(size)]
    makers = {
        "flat": lambda x: 1.0, "hanning": lambda x: 0.5 - 0.5 * math.cos(2 * math.pi * x), "hamming": lambda x: 0.54 - 0.46 * math.cos(2 * math.pi * x),
        "bartlett": lambda x: 1 - abs(2 * x - 1), "blackman": lambda x: 0.42 - 0.5 * math.cos(2 * math.pi * x) + 0.08 * math.cos(4 * math.pi * x),
    }
    return [makers[kind](x) for x in at]


def taper_in(position: Column, length: int) -> Column:
    """The rising half of a taper at position 1..length: sin^2(pi i / (2 (length + 1)))."""
    return F.pow(F.sin(position * F.lit(math.pi / (2 * (length + 1)))), 2)


def taper(position: Column, size: Column, length: int) -> Column:
    """The weight at 0-based position of a fragment whose both ends are tapered."""
    if length == 0:
        return F.lit(1.0)
    rise, fall = position + 1, size - position
    return F.when(rise <= length, taper_in(rise, length)).when(fall <= length, taper_in(fall, length)).otherwise(F.lit(1.0))
