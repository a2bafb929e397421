"""Numeric column helpers: array-style rounding, safe casts, the normal tail."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Abramowitz & Stegun 7.1.26 coefficients for erf (absolute error <= 1.5e-7).
AS_P = 0.3275911
AS_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def np_round(c, digits: int = 2) -> Column:
    """Round half to even on the binary value, as array libraries do.

    ``round``/``bround`` work on the decimal text (0.575 -> 0.58); scaling and
    ``rint`` gives 0.57 like the reference's numeric rounding.
    """
    scale = float(10 ** digits)
    return F.rint(_c(c) * F.lit(scale)) / F.lit(scale)


def stable_round(c, digits: int = 2) -> Column:
    """``np_round`` after snapping to 10 decimals, so that sums taken in a
    different order cannot flip a tie at the rounding digit."""
    return np_round(np_round(c, 10), digits)


def py_round(c, digits: int = 2) -> Column:
    """Round as Python's ``round`` does: by the exact binary value, an exact tie to the even digit.

    ``scale * x`` is taken as a sum of products with powers of two, which are exact, and the errors of
    the additions are carried along, so its distance from the nearest half is known exactly.
    """
    x = F.abs(_c(c))
    scale = 10 ** digits
    floor = F.floor(x * F.lit(float(scale))).cast("double")
    half = 2 * floor + 1.0                                   # the tie, doubled
    total, error = F.lit(0.0), F.lit(0.0)
    for bit in [b for b in range(scale.bit_length() + 1) if 2 * scale >> b & 1][::-1]:
        term = x * F.lit(float(1 << bit))
        new = total + term
        back = new - total
        error = error + ((total - (new - back)) + (term - back))
        total = new
    over = (total - half) + error
    up = (over > 0) | ((over == 0) & (floor % 2 == 1))
    out = F.when(up, floor + 1).otherwise(floor) / F.lit(float(scale))
    return F.when(_c(c) < 0, -out).otherwise(out)


def stable_py_round(c, digits: int = 2) -> Column:
    """``py_round`` after snapping to 10 decimals, against noise of the order of summation."""
    return py_round(np_round(c, 10), digits)


def to_double(c) -> Column:
    """Numeric coercion: anything that is not a number becomes NULL (never NaN)."""
    v = _c(c).cast("string").try_cast("double")
    return F.when(F.isnan(v), F.lit(None).cast("double")).otherwise(v)


def erfc_nonneg(x) -> Column:
    """erfc(x) for x >= 0 as a column expression (A&S 7.1.26)."""
    x = _c(x)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(AS_P) * x)
    poly = t * (F.lit(AS_A[0]) + t * (F.lit(AS_A[1]) + t * (F.lit(AS_A[2]) + t * (F.lit(AS_A[3]) + t * F.lit(AS_A[4])))))
    return poly * F.exp(-(x * x))


def two_sided_normal_p(z) -> Column:
    """2 * (1 - Phi(|z|)) = erfc(|z| / sqrt 2)."""
    return erfc_nonneg(F.abs(_c(z)) / F.lit(math.sqrt(2.0)))


def erfc_nonneg_py(x: float) -> float:
    """Same polynomial in plain Python (used by tests and brute-force checks)."""
    t = 1.0 / (1.0 + AS_P * x)
    a1, a2, a3, a4, a5 = AS_A
    return t * (a1 + t * (a2 + t * (a3 + t * (a4 + t * a5)))) * math.exp(-x * x)
