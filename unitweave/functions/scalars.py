"""Scalar expressions: companding, decibels, frequencies, phases, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from unitweave.functions.vectors import LOG_FLOOR


def mu_law(x: Column, mu: float = 255.0) -> Column:
    """Mu-law companding of [-1, 1], without quantisation."""
    return F.signum(x) * F.log1p(F.abs(x) * mu) / F.log1p(F.lit(mu))


def mu_law_inverse(y: Column, mu: float = 255.0) -> Column:
    return F.signum(y) * (F.pow(F.lit(1.0 + mu), F.abs(y)) - 1) / mu


def decibels(x: Column) -> Column:
    return 20 * F.log10(x)


def from_decibels(x: Column) -> Column:
    return F.pow(F.lit(10.0), x / 20)


def protected_log(x: Column) -> Column:
    """Natural logarithm; the log floor for what is not above 0."""
    return F.when(x <= 0, F.lit(LOG_FLOOR)).otherwise(F.log(F.when(x > 0, x)))


def lf0_to_f0(x: Column) -> Column:
    return F.when(x <= LOG_FLOOR, F.lit(0.0)).otherwise(F.exp(x))


def next_power_of_two(x: Column) -> Column:
    return F.pow(F.lit(2.0), F.ceil(F.log2(x))).cast("long")


def hz_to_bin(hz: Column, rate: int, fft: int) -> Column:
    """The nearest bin, half to even."""
    return F.rint(hz * fft / rate).cast("int")


def bin_to_hz(b: Column, rate: int, fft: int) -> Column:
    return b * F.lit(rate / fft)


def shift_to_f0(shift: Column, rate: int, voiced: Column) -> Column:
    """F0 from a pitch-synchronous shift in samples; 0 where unvoiced."""
    return F.when(voiced, F.try_divide(F.lit(float(rate)), shift)).otherwise(F.lit(0.0))


def f0_to_shift(f0: Column, rate: int, unvoiced_sec: float = 0.005) -> Column:
    return F.when(f0 > 0, F.try_divide(F.lit(float(rate)), f0)).otherwise(F.lit(rate * unvoiced_sec))


def phase_parts(phase: Column) -> tuple[Column, Column]:
    return F.cos(phase), F.sin(phase)


def phase(real: Column, imag: Column) -> Column:
    return F.atan2(imag, real)


def unit_spectrum(real: Column, imag: Column) -> tuple[Column, Column, Column]:
    """(magnitude, real part and imaginary part on the unit circle; 0 where the magnitude is 0)"""
    mag = F.hypot(real, imag)
    return mag, F.coalesce(F.try_divide(real, mag), F.lit(0.0)), F.coalesce(F.try_divide(imag, mag), F.lit(0.0))


def clipped_sample(x: Column) -> Column:
    """A 16-bit sample."""
    return F.least(F.greatest(x, F.lit(-32768.0)), F.lit(32767.0)).cast("short")


def stem(path: Column) -> Column:
    """The file name without folders and its last extension."""
    return F.regexp_replace(F.regexp_replace(path, r"^.*/", ""), r"\.[^.]*$", "")
