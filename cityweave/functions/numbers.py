"""Rounding of doubles that is exact on their binary value."""
from pyspark.sql import Column
from pyspark.sql import functions as F

_SPLIT = 134217729.0  # 2^27 + 1, splits a double into halves whose products are exact


def round_exact(x, n: int) -> Column:
    """Round to n decimals, half-even on the exact value. The built-in roundings look at the
    shortest decimal text, which can sit on a tie the value itself is not on. Here the product
    with 2*10^n is compared with the tie and its exact rounding error decides."""
    x = x if isinstance(x, Column) else F.col(x)
    x = x.cast("double")
    b, ten = F.lit(float(2 * 10 ** n)), F.lit(float(10 ** n))
    p = x * b
    big = x * F.lit(_SPLIT)
    hi = big - (big - x)
    err = (hi * b - p) + (x - hi) * b
    m = F.floor(p)
    on_tie = (p == m) & (F.pmod(m, F.lit(2)) == 1)
    low = F.floor((p - 1) / 2)
    even_up = F.pmod(low, F.lit(2)) == 1
    k = F.when(on_tie, low + F.when((err > 0) | ((err == 0) & even_up), 1).otherwise(0)).otherwise(F.floor((p + 1) / 2))
    return k / ten
