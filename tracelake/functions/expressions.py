"""Column expressions shared by the operators, which stay inside the JVM, and the inverse
normal distribution over arrays."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_number(c: Column) -> Column:
    """Text to double; anything that is not a finite number becomes NULL.

    The last-letter guard rejects Java literals such as ``1.5d``, which a cast accepts.
    """
    suffix = F.lower(F.right(F.rtrim(c), F.lit(1)))
    return finite_or_null(F.when(~suffix.isin("d", "f"), c.try_cast("double")))


def is_finite(c: Column) -> Column:
    """True for a present, non-NaN, non-infinite value; never NULL. NaN sorts above inf."""
    return F.coalesce(F.abs(c.cast("double")) < F.lit(float("inf")), F.lit(False))


def finite_or_null(c: Column) -> Column:
    return F.when(is_finite(c), c)


def seeded_hash(seed: int | str, *cols: Column) -> Column:
    """Reproducible pseudo-random order: hex md5 of the key and the seed."""
    return F.md5(F.concat_ws("|", *[c.cast("string") for c in cols], F.lit(str(seed))))


def half_even_count(n: Column, frac: float) -> Column:
    """``n * frac`` rounded half to even, as a row count."""
    return F.bround(n.cast("double") * F.lit(float(frac)), 0).cast("long")


def int_div(a: Column, b: Column) -> Column:
    """Exact integer division of two non-negative longs."""
    return F.call_function("div", a.cast("long"), b.cast("long"))


def ceil_div(a: Column, b: int) -> Column:
    """Exact ``ceil(a / b)`` for a non-negative long."""
    return int_div(a + F.lit(b - 1), F.lit(b))


def double_array(values) -> Column:
    """Constant array of finite doubles.

    Written as one text that the optimizer folds into a single literal: an array of a
    thousand literals would be walked by every analyzer rule.
    """
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")


def count_below(values: Column, size: int, x: Column, or_equal: bool = False) -> Column:
    """How many elements of an ascending array lie below ``x``, by binary search.

    ``size`` is the array length, known when the plan is built; the fold visits
    log2(size) elements rather than all of them.
    """
    steps = []
    step = 1
    while step <= size:
        steps.insert(0, step)
        step *= 2

    def visit(acc, width):
        probe = F.get(values, acc + width - 1)
        hit = (probe <= x) if or_equal else (probe < x)
        return F.when(hit, acc + width).otherwise(acc)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), visit)


def clip(z: Column, lo: float, hi: float) -> Column:
    """Clamp to [lo, hi]; NaN stays NaN as a numeric clip leaves it."""
    return F.when(F.isnan(z), z).otherwise(F.greatest(F.lit(lo), F.least(F.lit(hi), z)))


# Algorithm AS241 (Wichura 1988), central and first tail branch,
# highest power first. The far tail (p < 1.4e-11) lies outside the clip below.
CENTRAL_NUM = (
    2.5090809287301226727e+3, 3.3430575583588128105e+4, 6.7265770927008700853e+4,
    4.5921953931549871457e+4, 1.3731693765509461125e+4, 1.9715909503065514427e+3,
    1.3314166789178437745e+2, 3.3871328727963666080e+0,
)
CENTRAL_DEN = (
    5.2264952788528545610e+3, 2.8729085735721942674e+4, 3.9307895800092710610e+4,
    2.1213794301586595867e+4, 5.3941960214247511077e+3, 6.8718700749205790830e+2,
    4.2313330701600911252e+1, 1.0,
)
TAIL_NUM = (
    7.74545014278341407640e-4, 2.27238449892691845833e-2, 2.41780725177450611770e-1,
    1.27045825245236838258e+0, 3.64784832476320460504e+0, 5.76949722146069140550e+0,
    4.63033784615654529590e+0, 1.42343711074968357734e+0,
)
TAIL_DEN = (
    1.05075007164441684324e-9, 5.47593808499534494600e-4, 1.51986665636164571966e-2,
    1.48103976427480074590e-1, 6.89767334985100004550e-1, 1.67638483018380384940e+0,
    2.05319162663775882187e+0, 1.0,
)
# Tie tolerance of the quantile transform and the resulting clip.
QUANTILE_EPS = 1e-7
NORMAL_CLIP = 5.199337582605575


def normal_quantile(p: np.ndarray) -> np.ndarray:
    """Inverse normal CDF of many probabilities, clipped to +-NORMAL_CLIP."""
    q = p - 0.5
    r = 0.180625 - q * q
    out = q * np.polyval(CENTRAL_NUM, r) / np.polyval(CENTRAL_DEN, r)
    ends = np.clip(np.where(q < 0, p, 1.0 - p), 1e-9, 0.5)
    r = np.sqrt(-np.log(ends)) - 1.6
    tail = np.sign(q) * np.polyval(TAIL_NUM, r) / np.polyval(TAIL_DEN, r)
    out = np.where(np.abs(q) <= 0.425, out, np.clip(tail, -NORMAL_CLIP, NORMAL_CLIP))
    return np.where(p < 1e-9, -NORMAL_CLIP, np.where(p > 1.0 - 1e-9, NORMAL_CLIP, out))
