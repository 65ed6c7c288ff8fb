"""Time normalisers. Columns hold real timestamps; text is made only at the edge.

The session time zone must be UTC (see ``sources.ready``)."""
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..vocabulary import CITY_TZ

ISO = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def from_epoch(c) -> Column:
    return F.timestamp_seconds(c)


def from_iso_z(c) -> Column:
    return F.try_to_timestamp(c, F.lit(ISO))


def from_local_iso(c, tz=CITY_TZ) -> Column:
    return F.to_utc_timestamp(F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ss")), tz)


def from_complaint(c, tz=CITY_TZ) -> Column:
    return F.to_utc_timestamp(F.try_to_timestamp(F.trim(c), F.lit("d/M/yyyy h:mm a")), tz)


def from_scada(c, tz=CITY_TZ) -> Column:
    return F.to_utc_timestamp(F.try_to_timestamp(F.trim(c), F.lit("d/M/yyyy H:mm")), tz)


def iso(c) -> Column:
    return F.date_format(c, ISO)


def epoch(c) -> Column:
    return F.unix_timestamp(c)


def local_hour(c, tz=CITY_TZ) -> Column:
    return F.hour(F.from_utc_timestamp(c, tz))


def local_clock(c, tz=CITY_TZ) -> Column:
    """"6:42 pm" in local time."""
    return F.coalesce(F.lower(F.date_format(F.from_utc_timestamp(c, tz), "h:mm a")), F.lit(""))


def _plural(n: Column, word: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s"))


def duration_text(sec) -> Column:
    s = F.greatest(F.lit(0), F.floor(sec + F.lit(0.5)))
    mins = F.floor(s / 60 + F.lit(0.5))
    hrs, rem = F.floor(mins / 60), mins % 60
    return (F.when(s < 60, F.lit("less than a minute"))
            .when(mins < 60, _plural(mins, "minute"))
            .when(rem == 0, _plural(hrs, "hour"))
            .otherwise(F.concat_ws(" ", _plural(hrs, "hour"), _plural(rem, "minute"))))


def time_ago(start, now) -> Column:
    d = F.greatest(F.lit(0), epoch(now) - epoch(start))
    return F.coalesce(
        F.when(start.isNull() | now.isNull(), F.lit(""))
        .when(d < 5, "just now")
        .when(d < 60, F.concat(_plural(d, "second"), F.lit(" ago")))
        .otherwise(F.concat(duration_text(d), F.lit(" ago"))), F.lit(""))
