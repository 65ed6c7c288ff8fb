"""Severity, confidence and pulse arithmetic as Columns."""
from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocabulary as v
from .numbers import round_exact

_RAMPS = {c: (lo, hi) for c, _, lo, hi in v.CATEGORIES}
_INTERVALS = {f[0]: f[1] for f in v.FEEDS}


def _lookup(col, mapping: dict) -> Column:
    """CASE over a constant mapping (closed vocabulary, so a fixed number of branches)."""
    out = None
    for k, val in mapping.items():
        out = F.when(col == k, F.lit(val)) if out is None else out.when(col == k, F.lit(val))
    return out


def floor_of(category) -> Column:
    return _lookup(category, {c: r[0] for c, r in _RAMPS.items()})


def ceiling_of(category) -> Column:
    return _lookup(category, {c: r[1] for c, r in _RAMPS.items()})


def interval_of(feed) -> Column:
    return _lookup(feed, _INTERVALS)


def severity(category, measure, cap=None) -> Column:
    """Linear ramp clamped to 0..1 at 4 decimals, half-even; an optional cap (null = none)."""
    share = None
    for lo, hi in dict.fromkeys(_RAMPS.values()):  # one branch per distinct ramp
        on = category.isin(*[c for c, r in _RAMPS.items() if r == (lo, hi)])
        val = (measure - F.lit(lo)) / F.lit(hi - lo)
        share = F.when(on, val) if share is None else share.when(on, val)
    ramp = round_exact(F.least(F.lit(1.0), F.greatest(F.lit(0.0), share)), 4)
    return ramp if cap is None else F.least(ramp, cap)


def crosses_floor(category, measure) -> Column:
    return measure >= floor_of(category)


def confidence(base, mult, extra=None) -> Column:
    """Half-up to 2 decimals, never under the floor. F.round is half-up on the decimal text."""
    val = base * mult if extra is None else base * mult * extra
    return F.greatest(F.lit(v.CONF_FLOOR), F.round(val, 2))


def received_at(start, interval_sec, observed=None) -> Column:
    modelled = F.timestamp_seconds(F.unix_timestamp(start) + interval_sec)
    return modelled if observed is None else F.when(observed.isNotNull(), F.greatest(observed, start)).otherwise(modelled)


def freshness(received, start) -> Column:
    return F.greatest(F.lit(0), F.unix_timestamp(received) - F.unix_timestamp(start))


def alert_level(pulse, is_decoy=None) -> Column:
    out = F.lit(v.ALERT_CUTOFFS[0][1])
    for cutoff, name in v.ALERT_CUTOFFS[1:]:
        out = F.when(pulse >= cutoff, F.lit(name)).otherwise(out)
    return out if is_decoy is None else F.when(
        is_decoy & out.isin("orange", "red"), F.lit("yellow")).otherwise(out)


def pulse(max_severity, mean_confidence, n_sources) -> Column:
    score = max_severity * 0.6 + mean_confidence * 0.2 + F.least(n_sources, F.lit(3)) / 3 * 0.2
    return F.bround(score * 100, 0).cast("bigint")


def heat_index(temp_c, rh) -> Column:
    """Rothfusz regression in Fahrenheit space; below 80 F the air temperature stands."""
    t, c = temp_c * 9 / 5 + 32, v.ROTHFUSZ
    hi = (F.lit(c[0]) + c[1] * t + c[2] * rh + c[3] * t * rh + c[4] * t * t + c[5] * rh * rh
          + c[6] * t * t * rh + c[7] * t * rh * rh + c[8] * t * t * rh * rh)
    return F.when(t < 80, temp_c).otherwise((hi - 32) * 5 / 9)
