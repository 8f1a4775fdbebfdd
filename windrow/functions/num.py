"""Numeric column expressions that Spark has no built-in for."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, functions as F

# fixed values: Lanczos approximation (g = 7, nine terms)
LANCZOS_G = 7.0
LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028,
    771.32342877765313, -176.61502916214059, 12.507343278686905,
    -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)


def clip(c: Column, lo=None, hi=None) -> Column:
    """Bounds `c`; NULL stays NULL (greatest/least alone would skip it)."""
    out = c
    if lo is not None:
        out = F.greatest(out, F.lit(float(lo)))
    if hi is not None:
        out = F.least(out, F.lit(float(hi)))
    return F.when(c.isNotNull(), out)


def gamma(x: Column) -> Column:
    """Gamma function for x >= 0.5."""
    z = x - 1.0
    series = reduce(lambda acc, kc: acc + kc[1] / (z + float(kc[0])),
                    enumerate(LANCZOS[1:], start=1), F.lit(LANCZOS[0]))
    t = z + (LANCZOS_G + 0.5)
    return F.lit(math.sqrt(2 * math.pi)) * F.pow(t, z + 0.5) * F.exp(-t) * series


def weibull_shape(mean: Column, sd: Column, lo: float = 0.35, hi: float = 6.0,
                  steps: int = 60) -> Column:
    """Weibull k from mean and standard deviation, by bisection on the moment equation."""
    cv2 = F.pow(sd / mean, 2)

    def excess(k):
        return gamma(1 + 2 / k) / F.pow(gamma(1 + 1 / k), 2) - (1 + cv2)

    def halve(state, _):
        mid = (state["lo"] + state["hi"]) / 2
        # excess falls with k: a positive value means the root lies above mid
        above = excess(mid) > 0
        return F.struct(F.when(above, mid).otherwise(state["lo"]).alias("lo"),
                        F.when(above, state["hi"]).otherwise(mid).alias("hi"))

    root = F.aggregate(F.sequence(F.lit(1), F.lit(steps)),
                       F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi")),
                       halve, lambda s: (s["lo"] + s["hi"]) / 2)
    bracketed = (excess(F.lit(lo)) > 0) & (excess(F.lit(hi)) < 0)
    return F.when(bracketed, root).otherwise(F.pow(sd / mean, -1.086))


def weibull_pdf(v: Column, a: Column, k: Column) -> Column:
    return (k / a) * F.pow(v / a, k - 1) * F.exp(-F.pow(v / a, k))


def wrap180(deg: Column) -> Column:
    """Angle difference in (-180, 180]."""
    m = F.pmod(deg, F.lit(360.0))
    return F.when(m > 180.0, m - 360.0).otherwise(m)


def angle(deg: Column) -> Column:
    """Angle within 0..360."""
    return F.pmod(deg, F.lit(360.0))


def sector(deg: Column, width: float) -> Column:
    return (F.floor(deg / float(width)) * int(width)).cast("int")


def air_density_ratio(temp_c: Column, pressure_kpa: float | None) -> Column:
    """Density relative to 1.225 kg/m3."""
    p = pressure_kpa or 101.325
    return F.lit(p * 1000.0) / (287.05 * (temp_c + 273.15)) / 1.225


def site_density_ratio(elevation_m: float, temp_c: Column) -> Column:
    """Density ratio with the barometric pressure at the site elevation."""
    return air_density_ratio(temp_c, 101.325 * (1.0 - 2.25577e-5 * elevation_m) ** 5.25588)


def density_correct(ws: Column, ratio: Column) -> Column:
    return ws * F.pow(clip(ratio, 0.5, 1.5), F.lit(1.0 / 3.0))


def shear(ws: Column, height: float, ref_height: float, alpha: float = 0.2) -> Column:
    return ws * F.pow(F.lit(height / ref_height), F.lit(alpha))


def det3(m) -> Column:
    (a, b, c), (d, e, f), (g, h, i) = m
    return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)


def piecewise_linear(x: Column, nodes) -> Column:
    """Linear interpolation on a short constant table, held at both ends."""
    out = F.when(x <= nodes[0][0], F.lit(float(nodes[0][1])))
    for (x0, y0), (x1, y1) in zip(nodes, nodes[1:]):
        out = out.when(x <= x1, F.lit(y0) + (x - x0) * ((y1 - y0) / (x1 - x0)))
    return out.when(x.isNotNull(), F.lit(float(nodes[-1][1])))


TERMS = [float(m) for m in range(201, 1, -2)]  # odd divisors of the series, the last first
LEVELS = 40


def normal_cdf(z: Column) -> Column:
    """Distribution function of the standard normal law: a series up to |z| = 6, a continued fraction beyond."""
    x = F.abs(z)
    phi = F.exp(-x * x / 2.0) / math.sqrt(2.0 * math.pi)
    series = x * F.aggregate(F.array(*map(F.lit, TERMS)), F.lit(1.0), lambda acc, m: 1.0 + x * x / m * acc)
    below = F.aggregate(F.array(*[F.lit(float(k)) for k in range(LEVELS, 0, -1)]), x, lambda acc, k: x + k / acc)
    upper = F.when(x <= 6.0, 0.5 - phi * series).otherwise(phi / below)
    return F.when(z < 0, upper).otherwise(1.0 - upper)
