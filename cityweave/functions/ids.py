"""Derived identifiers: name-based UUIDs, short hashes and record references."""
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..vocabulary import EVENT_NAMESPACE
from . import times


def uuid5(name, namespace: str = EVENT_NAMESPACE) -> Column:
    """RFC 4122 version 5: SHA-1 over namespace bytes + UTF-8 name, version and variant bits set."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.element_at(F.array(*[F.lit(x) for x in "89ab"]),
                           (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4),
                       F.concat(F.lit("5"), F.substring(h, 14, 3)),
                       F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def event_id(raw_ref, category, namespace: str = EVENT_NAMESPACE) -> Column:
    return uuid5(F.concat_ws("|", raw_ref, category), namespace)


def short_id(prefix: str, n: int, *parts) -> Column:
    """``prefix`` + first n hex digits of the SHA-1 of the pipe-joined parts."""
    return F.concat(F.lit(prefix), F.substring(F.sha1(F.concat_ws("|", *parts).cast("binary")), 1, n))


def set_id(prefix: str, n: int, ids) -> Column:
    return short_id(prefix, n, F.array_join(F.sort_array(ids), "|"))


# Tables are joined on whole keys of 40 digits; what is shown is their first digits.
KEY = 40
ID_COLUMNS = ("anomaly_id", "situation_id", "rejected_id")


def set_key(prefix: str, n: int, keys) -> Column:
    """The whole key of a set of whole keys: the ``n`` digits to be shown, made of the keys' shown texts,
    then digits of the whole keys. Sets of different keys whose texts clash stay apart."""
    return F.concat(set_id(prefix, n, F.transform(keys, public)), set_id("", KEY - n, keys))


SHOWN = "^(SIT-[0-9a-f]{6}|(?:ANOM|REJ)-[0-9a-f]{8})[0-9a-f]+$"


def public(c) -> Column:
    """The shown text of a key: 6 digits for situations, 8 for anomalies and rejected links."""
    return F.regexp_replace(c, SHOWN, "$1")


def public_text(key: str) -> str:
    return re.sub(SHOWN, r"\1", key)


def with_public(df):
    """A table as it is shown: keys in id columns, and in arrays of them, in their shown text."""
    out = {c: public(F.col(c)) for c in df.columns if c in ID_COLUMNS}
    out |= {c + "s": F.transform(c + "s", public) for c in ID_COLUMNS if dict(df.dtypes).get(c + "s") == "array<string>"}
    return df.withColumns(out) if out else df


# one grammar per feed: feed:entity@instant, or feed:record
def ref_at_epoch(feed: str, entity, ts) -> Column:
    return F.concat(F.lit(f"{feed}:"), entity, F.lit("@"), times.epoch(ts).cast("string"))


def ref_verbatim(feed: str, entity, text) -> Column:
    return F.concat(F.lit(f"{feed}:"), entity, F.lit("@"), text)


def ref_record(feed: str, record_id) -> Column:
    return F.concat(F.lit(f"{feed}:"), record_id)


def record_identity(feed: str) -> tuple:
    """(raw_ref, entity_ref, t_utc) Columns over a raw feed row; null pieces stay null/empty. The
    register's rows are named by their own id and have no entity or time of reading."""
    if feed == "civic_complaints":
        return F.coalesce(ref_record(feed, F.col("complaint_id")), F.lit("")), F.lit(""), F.lit(None).cast("string")
    spec = {
        "weather_imd": ("station_id", times.from_epoch(F.col("ts")) if feed == "weather_imd" else None),
        "air_sensors": ("sensor", times.from_iso_z("captured") if feed == "air_sensors" else None),
        "power_discom": ("feeder_id", times.from_local_iso("reported_time") if feed == "power_discom" else None),
        "drain_scada": ("rtu", times.from_scada("polled") if feed == "drain_scada" else None),
    }
    entity, ts = spec[feed]
    ent = F.concat(F.lit(f"{feed}:"), F.col(entity), F.lit("@"))
    tail = F.col("captured") if feed == "air_sensors" else times.epoch(ts).cast("string")
    t_utc = F.col("captured") if feed == "air_sensors" else times.iso(ts)
    ok = ent.isNotNull() & tail.isNotNull()
    return (F.when(ok, F.concat(ent, tail)).otherwise(F.lit("")),
            F.when(ok, ent).otherwise(F.lit("")), F.when(ok, t_utc))
