"""Records and the events they belong to, with references of several lengths."""
from pyspark.sql import functions as F

from cityweave.operators import serve


def test_prefixes_are_of_the_same_entity(spark):
    """References of long and short names: only those of one entity shorten or extend each other, and no others are tried."""
    names = [f"f:F-{10 ** k}" for k in range(6)]
    full = [(n, f"{n}@{100000 + i}") for n in names for i in range(4)]
    rec = spark.createDataFrame([(i, r, n + "@", i) for i, (n, r) in enumerate(full)] + [(100, "f:F-10@1000", "f:F-10@", None), (101, "f:F-10@", "f:F-10@", None), (102, "f:F-1@1000019", "f:F-1@", None), (103, "", "", 5)],
                                "record_id bigint, raw_ref string, entity_ref string, t bigint")
    ev = spark.createDataFrame([(f"e{i}", r, 10 ** 9) for i, (_, r) in enumerate(full) if i % 2] + [("x", "f:F-1@100001", 10 ** 9)], "event_id string, raw_ref string, s bigint")
    ev = ev.select("event_id", "raw_ref", F.timestamp_seconds("s").alias("start_utc"), F.lit(None).cast("timestamp").alias("end_utc"))
    r, e = rec.collect(), ev.collect()
    want = set()
    for x in r:
        kinds = {}
        for y in e:
            a, b = x.raw_ref, y.raw_ref
            if a and a == b:
                kinds.setdefault(0, set()).add(y.event_id)
            elif a and (b.startswith(a) or a.startswith(b)) and min(len(a), len(b)) > a.index("@") + 1:
                kinds.setdefault(1, set()).add(y.event_id)
        want |= {(x.record_id, y, min(kinds)) for y in (kinds[min(kinds)] if kinds else ())}
    got = [(x.record_id, x.event_id, x.kind) for x in serve.lineage(rec, ev).collect()]
    assert set(got) == want and len(got) == len(want) and {k for _, _, k in got} == {0, 1}
    sides = rec.filter("record_id < 100"), ev.withColumnRenamed("raw_ref", "ev_ref")
    assert serve._prefixes(sides[0], "raw_ref", sides[1], "ev_ref").count() == 0  # before: one for each shorter name
