"""Poisson upper tail P(X >= k | lam): a fixed number of plain steps, which Spark compiles."""
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIRECT = 14  # up to here the terms below k are summed one by one
NODES = 22  # beyond, of the quadrature; absolute error below 1e-12


def _below() -> str:
    """The sum of tail_y^j / j! for j < tail_k, tail_k up to ``DIRECT``, nested from the innermost term."""
    out = "0D"
    for j in reversed(range(DIRECT)):
        out = f"if(tail_k > {j}, 1D + tail_y / {j + 1}D * {out}, 0D)"
    return out


def _quadrature() -> str:
    """P(X >= k) = the integral of t^m e^-t / m! from 0 to lam, m = k - 1, by Gauss-Legendre from lam away from
    the peak at m, as far as anything is left to add. With u = t / m - 1 the integrand is
    exp(m (ln(1 + u) - u)) over Stirling's series of m! e^m / m^m. Written as SQL text: u begins at tail_u, its
    whole way is tail_w."""
    u = [f"(tail_u + tail_w * {(x + 1) / 2!r}D)" for x in np.polynomial.legendre.leggauss(NODES)[0].tolist()]
    total = " + ".join(f"{w / 2!r}D * exp(tail_m * (log1p({at}) - {at}))" for w, at in zip(np.polynomial.legendre.leggauss(NODES)[1].tolist(), u))
    series = "exp(-1 / (12 * tail_m) + 1 / (360 * pow(tail_m, 3)) - 1 / (1260 * pow(tail_m, 5)) + 1 / (1680 * pow(tail_m, 7)))"
    part = f"abs(tail_w) * tail_m * ({total}) * {series} / sqrt({2 * math.pi!r}D * tail_m)"
    return f"if(tail_u > 0, 1D - {part}, {part})"


def with_poisson_tail(df: DataFrame, k: Column, lam: Column, out: str) -> DataFrame:
    """``df`` with P(X >= k) at the rate ``lam``: 1 for k of 0 or less, 0 for a rate of 0. What many steps read is
    a column of its own, so that the code stays short."""
    d = df.select("*", k.cast("double").alias("tail_k"), F.greatest(lam.cast("double"), F.lit(1e-300)).alias("tail_x"))
    d = d.selectExpr("*", "least(tail_x, 700D) AS tail_y", f"greatest(tail_k, {DIRECT + 1}D) - 1D AS tail_m").selectExpr("*", "sqrt(tail_m) AS tail_s")
    d = d.selectExpr("*", "(tail_x - tail_m) / tail_m AS tail_u", "(if(tail_x > tail_m, greatest(tail_m + 12D * tail_s, tail_x + 7D * tail_s), greatest(0D, least(tail_m - 8D * tail_s, tail_x - 7D * tail_s))) - tail_x) / tail_m AS tail_w")
    few = f"if(tail_x > 700D, 1D, 1D - exp(-tail_x) * ({_below()}))"
    tail = f"CASE WHEN tail_k <= 0 THEN 1D WHEN tail_k <= {DIRECT} THEN greatest(0D, {few}) ELSE least(1D, greatest(0D, {_quadrature()})) END"
    return d.selectExpr("*", f"CASE WHEN tail_k IS NOT NULL AND tail_x IS NOT NULL THEN {tail} END AS `{out}`").drop("tail_k", "tail_x", "tail_y", "tail_m", "tail_s", "tail_u", "tail_w")
