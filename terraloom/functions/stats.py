"""Distribution functions and significance scores as column expressions."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terraloom.constants import BASELINE_MEAN, BASELINE_STD, SENSOR_WEIGHTS

# Lanczos approximation of the gamma function, g = 7, nine terms (fixed values).
_LANCZOS = [
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
]


def erf(x: Column) -> Column:
    """Error function from the all-positive series exp(-x^2) * sum((2x)^... / (2n+1)!!)."""
    z = F.least(F.abs(x), F.lit(6.0))
    z2 = z * z
    state = F.struct(z.alias("term"), z.alias("total"))

    def step(acc, n):
        term = acc["term"] * 2 * z2 / (2 * n + 1)
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    total = F.aggregate(F.sequence(F.lit(1), F.lit(140)), state, step, lambda acc: acc["total"])
    return F.signum(x) * F.least(F.lit(1.0), 2 / math.sqrt(math.pi) * F.exp(-z2) * total)


def normal_cdf(x: Column) -> Column:
    return (1 + erf(x / math.sqrt(2))) / 2


def two_sided_z_p(z: Column) -> Column:
    return 1 - erf(F.abs(z) / math.sqrt(2))


def log_gamma(x: Column) -> Column:
    """Natural log of gamma for positive arguments."""
    y = x - 1
    series = F.lit(_LANCZOS[0])
    for i, c in enumerate(_LANCZOS[1:], 1):
        series = series + c / (y + i)
    t = y + 7.5
    return 0.5 * math.log(2 * math.pi) + (y + 0.5) * F.log(t) - t + F.log(series)


def _beta_fraction(a: Column, b: Column, x: Column, rounds: int = 120) -> Column:
    """Continued fraction of the incomplete beta function, evaluated forward for a fixed number of rounds, all rows of a batch at once; NULL where an argument is."""

    def guard(v):
        return np.where(np.abs(v) < 1e-300, 1e-300, v)

    @F.arrow_udf(T.DoubleType())
    def fraction(a: pa.Array, b: pa.Array, x: pa.Array) -> pa.Array:
        missing = np.zeros(len(a), bool)
        for v in (a, b, x):
            missing |= v.is_null().to_numpy(zero_copy_only=False)
        a, b, x = (v.to_numpy(zero_copy_only=False).astype(np.float64) for v in (a, b, x))
        with np.errstate(all="ignore"):
            c, d = np.ones(len(a)), 1 / guard(1 - (a + b) * x / (a + 1))
            h = d
            for half in range(2, 2 * rounds + 2):
                m = float(half // 2)
                if half % 2 == 0:
                    k = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
                else:
                    k = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
                c, d = guard(1 + k / c), 1 / guard(1 + k * d)
                h = h * c * d
        return pa.array(h, pa.float64(), mask=missing)

    return fraction(a, b, x)


def incomplete_beta(a: Column, b: Column, x: Column) -> Column:
    """Regularised incomplete beta function; the smaller tail is expanded."""
    flip = x > (a + 1) / (a + b + 2)
    p, q = F.when(flip, b).otherwise(a), F.when(flip, a).otherwise(b)
    y = F.when(flip, 1 - x).otherwise(x)
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + p * F.log(y) + q * F.log(1 - y)) / p
    tail = F.when(y <= 0, F.lit(0.0)).otherwise(front * _beta_fraction(p, q, y))
    return F.when(flip, 1 - tail).otherwise(tail)


def t_two_sided_p(t: Column, df: Column) -> Column:
    """Two-sided p of Student's t; from 20000 degrees of freedom on, through a normal transform."""
    df = F.when(df > 0, df)  # undefined without degrees of freedom, also where a filter is evaluated early
    z = F.abs(t) * (1 - 1 / (4 * df)) / F.sqrt(1 + t * t / (2 * df))
    return F.when(df > 20000, two_sided_z_p(z)).otherwise(incomplete_beta(df / 2, F.lit(0.5), df / (df + t * t)))


def f_one_predictor_p(f: Column, df: Column) -> Column:
    """Upper-tail p of F with one numerator degree of freedom, which is a squared t."""
    return t_two_sided_p(F.sqrt(f), df)


def significance_level(p: Column, d: Column, n: Column) -> Column:
    return (
        F.when(n < 3, "INSUFFICIENT_DATA")
        .when((p < 0.01) & (F.abs(d) >= 0.5), "HIGH")
        .when((p < 0.05) & (F.abs(d) >= 0.3), "MEDIUM")
        .otherwise("LOW")
    )


# --- site confidence from sensor means
def combined_site_score(lidar: Column, spectral: Column, temporal: Column) -> Column:
    w = SENSOR_WEIGHTS
    bonus = F.when((lidar > 0.4) & (spectral > 0.4), w["bonus"]).otherwise(0.0)
    return F.least(F.lit(1.0), lidar * w["lidar"] + spectral * w["spectral"] + temporal * w["temporal"] + bonus)


def effect_size(score: Column) -> Column:
    return (score - BASELINE_MEAN) / BASELINE_STD


def confidence_level(d: Column, p: Column) -> Column:
    return (
        F.when((d >= 0.8) & (p < 0.001), "EXCEPTIONAL")
        .when((d >= 0.5) & (p < 0.01), "HIGH")
        .when((d >= 0.3) & (p < 0.05), "MEDIUM")
        .otherwise("LOW")
    )


def site_probability(level: Column) -> Column:
    return (
        F.when(level == "EXCEPTIONAL", 0.95).when(level == "HIGH", 0.85).when(level == "MEDIUM", 0.65).otherwise(0.25)
    )


def quality_metrics(lidar: Column, spectral: Column, temporal: Column, combined: Column) -> Column:
    """struct(sensor_agreement, detection_reliability, signal_to_noise, overall_quality)."""
    mean = (lidar + spectral + temporal) / 3
    var = ((lidar - mean) * (lidar - mean) + (spectral - mean) * (spectral - mean) + (temporal - mean) * (temporal - mean)) / 3
    agreement = F.when(mean > 0, 1 - F.sqrt(var) / mean).otherwise(0.0)
    hits = sum((s > 0.4).cast("int") for s in (lidar, spectral, temporal))
    reliability = hits / 3
    snr = combined / BASELINE_STD
    return F.struct(
        agreement.alias("sensor_agreement"),
        reliability.alias("detection_reliability"),
        snr.alias("signal_to_noise"),
        ((agreement + reliability + F.least(snr / 5, F.lit(1.0))) / 3).alias("overall_quality"),
    )
