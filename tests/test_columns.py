import math
import random
import uuid

import pytest
from pyspark.sql import functions as F

from cityweave import vocabulary as v
from cityweave.functions import hexgrid, ids, poisson, severity as sv, text as tx, times
from cityweave.functions.numbers import round_exact


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_register_time_golden(spark):
    assert one(spark, times.iso(times.from_complaint(F.lit("24/09/2026 6:42 PM"))))[0] == "2026-09-24T13:12:00Z"
    assert one(spark, times.iso(times.from_local_iso(F.lit("2026-09-24T18:44:00"))))[0] == "2026-09-24T13:14:00Z"
    assert one(spark, times.iso(times.from_scada(F.lit("24/09/2026 18:40"))))[0] == "2026-09-24T13:10:00Z"
    assert one(spark, times.from_complaint(F.lit("2026-09-24")))[0] is None


def test_confidence_golden(spark):
    assert one(spark, sv.confidence(F.lit(v.CONF_RESIDENT), F.lit(v.MULT_LANDMARK)))[0] == 0.60
    assert one(spark, sv.confidence(F.lit(0.6), F.lit(1.0), F.lit(0.5)))[0] == 0.30


def test_uuid5_equals_library(spark):
    names = ["weather_imd:IMD-1@1758719520|weather.rain", "x", "नमस्ते|a", "civic_complaints:JPR-1|complaint.smoke"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", ids.uuid5(F.col("n"))).collect()
    assert all(r[1] == str(uuid.uuid5(uuid.UUID(v.EVENT_NAMESPACE), r[0])) for r in rows)


def test_round_exact_is_python_round(spark):
    rnd = random.Random(1)
    xs = [rnd.uniform(-5, 5) for _ in range(2000)] + [k / 2 ** 7 for k in range(-300, 300)] + [round(rnd.uniform(0, 1), 5) for _ in range(2000)]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", round_exact("x", 4), round_exact("x", 2)).collect()
    bad = [tuple(r) for r in rows if r[1] != round(r[0], 4) or r[2] != round(r[0], 2)]
    assert not bad, bad[:5]


@pytest.mark.parametrize("k,lam", [(1, 1e-6), (1, 0.01), (3, 0.2), (12, 40.0), (40, 12.0), (1000, 900.0), (900, 1000.0), (200000, 199000.0), (0, 3.0)])
def test_poisson_tail(spark, k, lam):
    got = poisson.with_poisson_tail(spark.range(1), F.lit(k), F.lit(lam), "p").first()["p"]
    lg = lambda i: -lam + i * math.log(lam) - math.lgamma(i + 1)
    span = int(60 + 14 * math.sqrt(max(k, lam)))
    want = (sum(math.exp(lg(i)) for i in range(k, k + span)) if lam < k else 1 - sum(math.exp(lg(i)) for i in range(max(0, k - span), k)))
    assert got == pytest.approx(want, rel=1e-7, abs=1e-12)


def test_hex_ring_and_distance(spark):
    g = hexgrid.HexGrid()
    c = g.cell_of(26.9124, 75.7873)
    r = one(spark, g.cell(F.lit(26.9124), F.lit(75.7873)), hexgrid.ring(F.lit(c), 1), hexgrid.ring(F.lit(c), 2))
    assert r[0] == c and len(set(r[1])) == 7 and len(set(r[2])) == 19
    d = spark.createDataFrame([(x,) for x in r[2]], "x bigint").select(hexgrid.distance(F.lit(c), F.col("x")).alias("d")).groupBy("d").count().collect()
    assert {x["d"]: x["count"] for x in d} == {0: 1, 1: 6, 2: 12}


def test_masking_register_text(spark):
    cases = {
        "Ramesh Kumar 98290 12345 paani": ("[name] [phone] paani", 2), "call +91 98290-12345": ("call [phone]", 1),
        "0 9829 012 345 ok": ("[phone] ok", 1), "id 12345 67890": ("id 12345 67890", 0), "Near Ramesh gate": ("Near Ramesh gate", 0),
        "Sindhi Camp pe Suresh": ("Sindhi Camp pe [name]", 1), "": ("", 0), None: ("", 0), "x9829012345": ("x9829012345", 0),
    }
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", tx.scrub(F.col("t")).alias("s")).collect()
    assert {r["t"]: (r["s"]["masked"], r["s"]["items"]) for r in rows} == cases


def test_masking_hand_made_cases(spark):
    """Texts written out by hand with the result each must have."""
    cases = {
        "Suresh ne call kiya 9829012345 par": ("[name] ne call kiya [phone] par", 2),
        "+919829012345, 0091 98290 12345; 09829012345": ("[phone], [phone]; [phone]", 3),
        "5829012345 is no mobile": ("5829012345 is no mobile", 0),
        "982901234 is short, 98290123456 long": ("982901234 is short, 98290123456 long", 0),
        "ref9829012345 and 9829012345ref": ("ref9829012345 and 9829012345ref", 0),
        "Mohan Lal aur Ravi": ("[name] aur [name]", 2), "Mohan  Lal": ("[name]", 1), "MOHAN Al": ("MOHAN Al", 0),
        "Water near The Gate": ("Water near The Gate", 0), "Ravi Road": ("Ravi Road", 0),
        "पानी 9829012345 भर गया": ("पानी [phone] भर गया", 1), "मोहन Ravi जी": ("मोहन [name] जी", 1),
        "सड़क९८२९": ("सड़क९८२९", 0), "कRavi": ("कRavi", 0), "किRavi": ("किRavi", 0), "Raviकि": ("Raviकि", 0),
        "Élan Ravié Tom": ("Élan Ravié [name]", 1),
        "98290\n12345": ("[phone]", 1), "98-29-01-23-45 9829012345": ("[phone] [phone]", 2),
    }
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", tx.scrub(F.col("t")).alias("s")).collect()
    assert {r["t"]: (r["s"]["masked"], r["s"]["items"]) for r in rows} == cases


def test_duration_words(spark):
    got = spark.createDataFrame([(5,), (90,), (60,), (3600,), (3900,), (7260,)], "s int").select(times.duration_text(F.col("s"))).collect()
    assert [r[0] for r in got] == ["less than a minute", "2 minutes", "1 minute", "1 hour", "1 hour 5 minutes", "2 hours 1 minute"]
