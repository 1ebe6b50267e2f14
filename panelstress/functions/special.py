"""Gamma and normal distribution functions.

Closed forms are column expressions. The likelihood equation of the gamma fit, solved once per
(entity, month), and the incomplete gamma function, evaluated once per row, are vectorised functions on
Arrow batches.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_SHIFT = 10
_HALF_LOG_2PI = 0.5 * math.log(2.0 * math.pi)

# Coefficients of the asymptotic series in odd powers of 1/x.
_LGAMMA_SERIES = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360)
_DIGAMMA_SERIES = (-1 / 12, 1 / 120, -1 / 252, 1 / 240, -1 / 132, 691 / 32760)
_TRIGAMMA_SERIES = (1 / 6, -1 / 30, 1 / 42, -1 / 30, 5 / 66, -691 / 2730)

# Rational approximation of the normal quantile, Wichura (1988), algorithm AS 241.
_CENTRAL_NUM = (3.3871328727963666080, 133.14166789178437745, 1971.5909503065514427, 13731.693765509461125,
                45921.953931549871457, 67265.770927008700853, 33430.575583588128105, 2509.0809287301226727)
_CENTRAL_DEN = (1.0, 42.313330701600911252, 687.18700749205790830, 5394.1960214247511077,
                21213.794301586595867, 39307.895800092710610, 28729.085735721942674, 5226.4952788528545610)
_TAIL_NUM = (1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504,
             1.27045825245236838258, 0.241780725177450611770, 0.0227238449892691845833, 0.000774545014278341407640)
_TAIL_DEN = (1.0, 2.05319162663775882187, 1.67638483018380384940, 0.689767334985100004550,
             0.148103976427480074590, 0.0151986665636164571966, 0.000547593808499534494600, 1.05075007164441684324e-9)
_FAR_NUM = (6.65790464350110377720, 5.46378491116411436990, 1.78482653991729133580, 0.296560571828504891230,
            0.0265321895265761230930, 0.00124266094738807843860, 0.0000271155556874348757815, 2.01033439929228813265e-7)
_FAR_DEN = (1.0, 0.599832206555887937690, 0.136929880922735805310, 0.0148753612908506148525,
            0.000786869131145613259100, 0.0000184631831751005468180, 1.42151175831644588870e-7, 2.04426310338993978564e-15)

# Above this shape the cube-root normal approximation is used instead of the power series.
LARGE_SHAPE = 1000000.0


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.get(F.transform(F.array(value), body), 0)


def polynomial(coefficients, x: Column) -> Column:
    """Horner evaluation, coefficients from the constant upwards."""
    result = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        result = result * x + F.lit(c)
    return result


def log_gamma(x: Column) -> Column:
    def body(v: Column) -> Column:
        product = v
        for k in range(1, _SHIFT):
            product = product * (v + float(k))
        big = v + float(_SHIFT)
        tail = polynomial(_LGAMMA_SERIES, 1.0 / (big * big)) / big
        return (big - 0.5) * F.ln(big) - big + _HALF_LOG_2PI + tail - F.ln(product)

    return let(x, body)


def digamma(x: Column) -> Column:
    def body(v: Column) -> Column:
        shifted = sum((1.0 / (v + float(k)) for k in range(1, _SHIFT)), 1.0 / v)
        big = v + float(_SHIFT)
        inv2 = 1.0 / (big * big)
        return F.ln(big) - 0.5 / big + polynomial(_DIGAMMA_SERIES, inv2) * inv2 - shifted

    return let(x, body)


def trigamma(x: Column) -> Column:
    def body(v: Column) -> Column:
        shifted = sum((1.0 / ((v + float(k)) * (v + float(k))) for k in range(1, _SHIFT)), 1.0 / (v * v))
        big = v + float(_SHIFT)
        inv2 = 1.0 / (big * big)
        return 1.0 / big + 0.5 * inv2 + polynomial(_TRIGAMMA_SERIES, inv2) * inv2 / big + shifted

    return let(x, body)


def _digamma_values(x: np.ndarray) -> np.ndarray:
    big = x + _SHIFT
    inv2 = 1.0 / (big * big)
    return np.log(big) - 0.5 / big + np.polyval(_DIGAMMA_SERIES[::-1], inv2) * inv2 - sum(1.0 / (x + k) for k in range(_SHIFT))


def _trigamma_values(x: np.ndarray) -> np.ndarray:
    big = x + _SHIFT
    inv2 = 1.0 / (big * big)
    shifted = sum(1.0 / ((x + k) * (x + k)) for k in range(_SHIFT))
    return 1.0 / big + 0.5 * inv2 + np.polyval(_TRIGAMMA_SERIES[::-1], inv2) * inv2 / big + shifted


def gamma_shape_mle(log_mean_gap: Column, steps: int = 6) -> Column:
    """Shape ``a`` solving ln(a) - digamma(a) = s, where s = ln(mean) - mean(ln) > 0; Newton steps on Arrow batches."""

    @F.pandas_udf(DoubleType())
    def shape(gap: pd.Series) -> pd.Series:
        s = gap.to_numpy(float)
        with np.errstate(all="ignore"):
            a = (3.0 - s + np.sqrt((s - 3.0) * (s - 3.0) + 24.0 * s)) / (12.0 * s)
            for _ in range(steps):
                rest = np.log(a) - _digamma_values(a) - s
                a = 1.0 / (1.0 / a + rest / (a * a * (1.0 / a - _trigamma_values(a))))
        return pd.Series(a)

    return shape(log_mean_gap)


def _log_gamma_values(x: np.ndarray) -> np.ndarray:
    product = np.prod([x + k for k in range(_SHIFT)], axis=0)
    big = x + _SHIFT
    tail = sum(c / big ** (2 * i + 1) for i, c in enumerate(_LGAMMA_SERIES))
    return (big - 0.5) * np.log(big) - big + _HALF_LOG_2PI + tail - np.log(product)


def lower_gamma(x: np.ndarray, shape: np.ndarray) -> np.ndarray:
    """Regularised lower incomplete gamma function P(shape, x), element by element.

    Power series; the prefactor uses a form without cancelling large terms for larger shapes. Far in the
    upper tail the value is 1, beyond ``LARGE_SHAPE`` the cube-root normal approximation takes over.
    """
    x, shape = np.asarray(x, float), np.asarray(shape, float)
    out = np.full(x.shape, np.nan)
    known = np.isfinite(x) & np.isfinite(shape)
    out[known & (x <= 0.0)] = 0.0
    high = known & (x > shape + 40.0 * np.sqrt(np.abs(shape)) + 200.0)
    out[high] = 1.0
    todo = known & (x > 0.0) & ~high
    large = todo & (shape > LARGE_SHAPE)
    if large.any():
        a = shape[large]
        out[large] = normal_cdf_values(3.0 * np.sqrt(a) * (np.cbrt(x[large] / a) - 1.0 + 1.0 / (9.0 * a)))
    todo &= ~large
    z, a = x[todo], shape[todo]
    if not len(z):
        return out
    with np.errstate(divide="ignore"):
        stirling = 0.5 * np.log(a) + _HALF_LOG_2PI + sum(
            c / np.maximum(a, 1.0) ** (2 * i + 1) for i, c in enumerate(_LGAMMA_SERIES)
        )
    log_term = np.where(
        a < _SHIFT, a * np.log(z) - z - _log_gamma_values(a + 1.0), a * np.log1p((z - a) / a) - (z - a) - stirling
    )
    term, total = np.ones_like(z), np.ones_like(z)
    active = np.arange(len(z))
    k = 0
    while len(active):
        k += 1
        term[active] *= z[active] / (a[active] + k)
        total[active] += term[active]
        active = active[(term[active] > 1e-17 * total[active]) | (a[active] + k < z[active])]
    out[todo] = np.minimum(np.exp(log_term) * total, 1.0)
    return out


def normal_cdf_values(z: np.ndarray) -> np.ndarray:
    z = np.asarray(z, float)
    return 0.5 + 0.5 * np.sign(z) * lower_gamma(z * z / 2.0, np.full(z.shape, 0.5))


@F.pandas_udf(DoubleType())
def gamma_cdf(x: pd.Series, shape: pd.Series) -> pd.Series:
    """P(shape, x) on Arrow batches: Spark has no incomplete gamma function, and a series evaluated by
    higher-order functions runs interpreted, term by term and row by row."""
    return pd.Series(lower_gamma(x.to_numpy(), shape.to_numpy()))


@F.pandas_udf(DoubleType())
def normal_cdf(z: pd.Series) -> pd.Series:
    return pd.Series(normal_cdf_values(z.to_numpy()))


def normal_two_sided_p(z: Column) -> Column:
    """2 * (1 - Phi(|z|))."""
    return 2.0 * (1.0 - normal_cdf(F.abs(z)))


def normal_quantile(p: Column) -> Column:
    """Plain arithmetic, so it stays inside generated code; ``p`` should be a stored column."""
    q = p - 0.5
    r0 = F.lit(0.180625) - q * q
    central = q * polynomial(_CENTRAL_NUM, r0) / polynomial(_CENTRAL_DEN, r0)
    r = F.sqrt(-F.ln(F.least(p, 1.0 - p)))
    near = polynomial(_TAIL_NUM, r - 1.6) / polynomial(_TAIL_DEN, r - 1.6)
    far = polynomial(_FAR_NUM, r - 5.0) / polynomial(_FAR_DEN, r - 5.0)
    return F.when(F.abs(q) <= 0.425, central).otherwise(F.signum(q) * F.when(r <= 5.0, near).otherwise(far))
