import random

import pytest
from pyspark.sql import functions as F

from cityweave.operators import link, raster, scale, score


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_running_before_by_chunks(spark, width):
    rnd = random.Random(3)
    rows = [("hot" if rnd.random() < 0.6 else f"k{rnd.randrange(4)}", i, rnd.randrange(3)) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, o bigint, x bigint")
    got = {(r["k"], r["o"]): r["s"] for r in scale.running_before(df, ["k"], ["o"], F.floor(F.col("o") / width), F.col("x"), "s").collect()}
    seen = {}
    for k, o, x in rows:
        assert got[(k, o)] == seen.get(k, 0)
        seen[k] = seen.get(k, 0) + x


@pytest.mark.parametrize("width", [3, 50])
def test_running_last_by_chunks(spark, width):
    rnd = random.Random(4)
    rows = [(f"k{rnd.randrange(3)}", i, rnd.randrange(9) if rnd.random() < 0.2 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, o bigint, x bigint")
    got = {(r["k"], r["o"]): r["s"] for r in scale.running_last(df, ["k"], ["o"], F.floor(F.col("o") / width), F.col("x"), "s").collect()}
    last = {}
    for k, o, x in rows:
        last[k] = x if x is not None else last.get(k)
        assert got[(k, o)] == last[k]


@pytest.mark.parametrize("reverse", [False, True])
def test_latest_within_against_all_pairs(spark, reverse):
    rnd = random.Random(5)
    pts = sorted({(rnd.choice("ab"), rnd.randrange(-500, 2000)) for _ in range(150)})
    prb = [(rnd.choice("ab"), rnd.randrange(-500, 2000), i) for i in range(200)]
    got = scale.latest_within(spark.createDataFrame(prb, "k string, t bigint, id bigint"), spark.createDataFrame(pts, "k string, t bigint"),
                              ["k"], "t", [], 40, reverse).collect()
    assert len(got) == len(prb)
    for r in got:
        near = [t for k, t in pts if k == r["k"] and 0 <= ((t - r["t"]) if reverse else (r["t"] - t)) <= 40]
        want = (min(near) if reverse else max(near)) if near else None
        assert (r["hit"]["t"] if r["hit"] else None) == want


def test_components_against_union_find(spark):
    rnd = random.Random(6)
    n = 400
    edges = [(f"n{a:04d}", f"n{b:04d}") for a, b in ((rnd.randrange(n), rnd.randrange(n)) for _ in range(300)) if a != b]
    edges += [(f"n{a:04d}", f"n{a + 1:04d}") for a in range(100, 180)]  # a long chain
    parent = {f"n{i:04d}": f"n{i:04d}" for i in range(n)}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = link.connected_components(spark.createDataFrame([(x,) for x in parent], "episode_id string"),
                                    spark.createDataFrame(edges, "i string, j string")).collect()
    assert len(got) == n and all(r["component"] == find(r["episode_id"]) for r in got)


def test_components_without_links(spark):
    nodes = spark.createDataFrame([("a",), ("b",)], "episode_id string")
    none = spark.createDataFrame([], "i string, j string")
    assert sorted(tuple(r) for r in link.connected_components(nodes, none).collect()) == [("a", "a"), ("b", "b")]


def test_id_pages_keep_every_member(spark):
    rows = [("big", f"e{i:05d}") for i in range(1000)] + [("small", "x"), ("small", "a")]
    pages = scale.id_pages(spark.createDataFrame(rows, "k string, e string"), "k", "e", 100).collect()
    assert sorted(x for p in pages if p["k"] == "big" for x in p["ids"]) == [f"e{i:05d}" for i in range(1000)]
    assert [p["ids"] for p in pages if p["k"] == "small"] == [["a", "x"]]


def test_greedy_match_equals_sequential(spark):
    rnd = random.Random(7)
    for trial in range(3):
        sits = {f"S{j:02d}": {f"e{rnd.randrange(40)}" for _ in range(rnd.randrange(2, 12))} for j in range(12)}
        truths = {f"T{i:02d}": {f"e{rnd.randrange(40)}" for _ in range(rnd.randrange(1, 8))} for i in range(10)}
        made = {s: f"2024-01-01 00:00:{rnd.randrange(3):02d}" for s in sits}
        used, want = set(), {}
        for t in sorted(truths):
            best = max(((len(truths[t] & m) / len(truths[t]), [-ord(c) for c in made[s]], [-ord(c) for c in s], s) for s, m in sits.items() if s not in used), default=None)
            o, s = (best[0], best[3]) if best else (0.0, None)
            want[t] = (s if o >= 0.5 else None, o)
            if o >= 0.5:
                used.add(s)
        tm = spark.createDataFrame([(t, e) for t, m in truths.items() for e in m], "truth_id string, event_id string")
        sm = spark.createDataFrame([(s, e) for s, m in sits.items() for e in m], "situation_id string, event_id string")
        got = score.match(spark.createDataFrame([(t, i) for i, t in enumerate(sorted(truths))], "truth_id string, pos bigint"), tm,
                          spark.createDataFrame(list(made.items()), "situation_id string, c string").select("situation_id", F.to_timestamp("c").alias("created_utc")), sm).collect()
        assert {r["truth_id"]: (r["situation_id"], r["overlap"]) for r in got} == want


def test_flow_on_small_grid(spark):
    z = [[9, 8, 7, 6], [9, 5, 5, 5], [9, 5, 1, 5], [9, 9, 9, 0]]
    dem = spark.createDataFrame([(r, c, float(z[r][c])) for r in range(4) for c in range(4)], "row bigint, col bigint, value double")
    acc = {(r["row"], r["col"]): r["upstream"] for r in raster.flow_accumulation(dem).collect()}
    down = {}
    for r in range(4):
        for c in range(4):
            best = 0.0
            for dr, dc in raster.D8:
                if 0 <= r + dr < 4 and 0 <= c + dc < 4:
                    drop = (z[r][c] - z[r + dr][c + dc]) / (1.414 if dr and dc else 1)
                    if drop > best:
                        best, down[(r, c)] = drop, (r + dr, c + dc)
    want = {k: 0 for k in acc}
    for k in acc:
        while True:
            want[k] += 1
            if k not in down:
                break
            k = down[k]
    assert acc == want


def test_flat_ground_has_no_outflow(spark):
    dem = spark.createDataFrame([(r, c, 5.0) for r in range(3) for c in range(3)], "row bigint, col bigint, value double")
    assert raster.flow_direction(dem).count() == 0
    assert {r["upstream"] for r in raster.flow_accumulation(dem).collect()} == {1}


def test_depth_series_drops_leading_dry_frames(spark):
    b = spark.createDataFrame([(i, 0, 0, m) for i, m in enumerate([0.0, 0.0, 0.05, 0.02])], "frame bigint, brow bigint, bcol bigint, mean double")
    r = raster.depth_series(b, 4, 0.03).first()
    assert (r["offset"], r["depth_cm"], r["peak_frame"]) == (2, [5, 2], 2)


def test_broadcast_only_when_counted_small(spark):
    small = scale.broadcast_if_small(spark.range(5), 10)
    large = scale.broadcast_if_small(spark.range(50), 10)
    hinted = lambda d: "broadcast" in d._jdf.queryExecution().logical().toString().lower()
    assert hinted(small) and not hinted(large)


def test_staged_tables_are_dropped_by_their_owner(spark):
    import os
    with scale.staging(spark):
        kept = scale.stage(spark.range(5), "owned")
        path = scale._staged[-1]
        assert kept.count() == 5 and os.path.isdir(path.removeprefix("file:"))
    assert not os.path.exists(path.removeprefix("file:"))


def test_a_group_of_1500_contending_truths_settles(spark):
    """All truths want the same situations; both ways of solving it agree with one after the other."""
    n = 1500
    o = spark.range(n).selectExpr("concat('T', lpad(id, 5, '0')) as truth_id", "id as pos")
    tm = spark.range(n).selectExpr("concat('T', lpad(id, 5, '0')) as truth_id", "id % 3 as event_id")
    sm = spark.range(4 * 3).selectExpr("concat('S', cast(id % 4 as string)) as situation_id", "floor(id / 4) as event_id")
    sits = spark.range(4).selectExpr("concat('S', cast(id as string)) as situation_id", "timestamp_seconds(0) as created_utc")
    want = {"T00000": "S0", "T00001": "S1", "T00002": "S2", "T00003": "S3"}
    for group_pairs in (10 ** 6, 10):
        got = score.match(o, tm, sits, sm, group_pairs=group_pairs).filter("situation_id is not null").collect()
        assert {r["truth_id"]: r["situation_id"] for r in got} == want


def test_arrival_order_over_files_of_unequal_size(spark, tmp_path):
    from cityweave.sources import readers
    lines = []
    for k, n in enumerate((3, 400, 1, 50, 7)):
        rows = [f"{k}-{i}" for i in range(n)]
        (tmp_path / f"2026-01-{k + 1:02d}.txt").write_text("\n".join(rows) + "\n")
        lines += rows
    got = readers.with_arrival(spark.read.text(str(tmp_path))).collect()
    assert [r["value"] for r in sorted(got, key=lambda r: r["seq"])] == lines and sorted(r["seq"] for r in got) == list(range(len(lines)))


def test_off_type_values_stay_parsed(spark):
    from cityweave.sources import readers
    ok = '{"station_id": "A", "ts": 5, "lat": 26.9, "lon": 75.8, "rain_mm_15min": 1.5, "temp_c": 20.0, "rh_pct": 50, "wind_kph": 1}'
    cases = [ok, ok.replace('"rh_pct": 50', '"rh_pct": 88.5'), ok.replace('"rh_pct": 50', '"rh_pct": "wet"'), ok[:-1], "[1]", "5"]
    d = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, value string")
    got = {r["i"]: r for r in readers.parse_json_lines(d, "weather_imd").collect()}
    assert [got[i]["parsed_ok"] for i in range(6)] == [True, True, True, False, False, False]
    assert [got[i]["rh_pct"] for i in range(3)] == [50, 88, None] and all(got[i]["station_id"] == "A" and got[i]["rain_mm_15min"] == 1.5 for i in range(3))
    assert got[3]["reason"] == "Invalid JSON" and got[3]["raw"] == ok[:-1] and got[1]["raw"] is None


def test_gazetteers_of_any_size_and_length(spark):
    import math

    from cityweave.functions.hexgrid import HexGrid
    from cityweave.operators import places
    rnd = random.Random(4)
    marks = [(i, f"Place {i} Gate", f"P{i}", 26.8 + rnd.random() / 5, 75.7 + rnd.random() / 5) for i in range(300)]
    marks.append((300, "Seth Govind Das Memorial Public Library Ground", "L", -33.0, 151.0))
    table = spark.createDataFrame(marks, "pos int, name string, name_hi string, lat double, lon double")
    texts = spark.createDataFrame([("Near Seth Govind Das Memorial Public Library Ground depot",), ("opp place 7 gate",), ("nowhere at all",)], "t string")
    by_join = {r["t"]: r["pos"] for r in places.resolve_by_join(texts, "t", table).collect()}
    assert [by_join[t] for t in ("Near Seth Govind Das Memorial Public Library Ground depot", "opp place 7 gate", "nowhere at all")] == [300, 7, None]
    inline = [(n, h, a, o) for _, n, h, a, o in marks]
    assert {r["t"]: r["p"] for r in texts.select("t", places.landmark_position(F.col("t"), inline).alias("p")).collect()} == by_join

    def km(a, b, c, d):
        x = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
        return math.asin(math.sqrt(x))

    points = [(26.8 + rnd.random() / 5, 75.7 + rnd.random() / 5) for _ in range(40)] + [(0.0, 0.0), (-35.0, 149.0), (89.0, -179.9), (27.9, 179.9)]
    got = places.nearest_by_join(spark.createDataFrame(points + [(None, 1.0)], "lat double, lon double"), table).collect()
    assert {(r["lat"], r["lon"]): r["pos"] for r in got} == {(a, b): min(marks, key=lambda m: (km(a, b, m[3], m[4]), m[0]))[0] for a, b in points} | {(None, 1.0): None}
    grid = HexGrid()
    cells = spark.createDataFrame(points[:40], "lat double, lon double").select(grid.cell(F.col("lat"), F.col("lon")).alias("c"))
    a = sorted(map(str, places.zone_labels(cells, "c", grid, table).collect()))
    assert a == sorted(map(str, places.zone_labels(cells, "c", grid, inline).collect()))


def test_keys_that_share_their_shown_text_stay_apart(spark):
    from cityweave.functions import ids
    from cityweave.operators import situations as st
    a, b = "SIT-abcdef" + "0" * 34, "SIT-abcdef" + "1" * 34
    m = spark.createDataFrame([(a, "e1"), (a, "e2"), (b, "e3")], "situation_id string, event_id string")
    pages = scale.id_pages(m, "situation_id", "event_id")
    assert sorted(len(r["ids"]) for r in pages.collect()) == [1, 2]
    assert {r["situation_id"] for r in ids.with_public(pages).collect()} == {"SIT-abcdef"} and st.ids is ids


def test_keys_of_sets_whose_members_share_their_shown_text_stay_apart(spark):
    from cityweave.functions import ids
    from cityweave.operators import situations as st
    anomalies = [["ANOM-01234567" + "a" * 32], ["ANOM-01234567" + "b" * 32]]
    rows = spark.createDataFrame([(k, k, a) for k, a in enumerate(anomalies)], "component int, episode_id int, anomaly_ids array<string>")
    d = st.situation_ids(spark.createDataFrame([(0, True), (1, True)], "component int, standalone boolean"), rows.select("component", "episode_id"),
                         rows.select("episode_id", "anomaly_ids", F.timestamp_seconds(F.lit(0)).alias("window_end_utc")))
    got = [r["situation_id"] for r in d.collect()]
    old = rows.select(ids.set_id("SIT-", 6, F.transform("anomaly_ids", ids.public)).alias("s")).first()["s"]
    assert sorted(got) == sorted(r[0] for r in rows.select(ids.set_key("SIT-", 6, F.col("anomaly_ids"))).collect())
    assert len(set(got)) == 2 and {len(x) for x in got} == {44}
    assert {r["situation_id"] for r in ids.with_public(d).collect()} == {old}


def test_keys_of_large_sets_stream_through_the_hash(spark):
    """50,000 ids in batches of 100: the key is that of the sorted array."""
    from cityweave.functions import ids
    m = spark.range(50_000).select(F.concat(F.lit("ANOM-"), F.sha1(F.col("id").cast("string"))).alias("member"), F.when(F.col("id") % 50 < 48, 1).otherwise(F.col("id") % 50).cast("int").alias("k"),
                                   F.lit("x").alias("j"))
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = scale.set_keys(m, ["k", "j"], "member", "SIT-", 6, "key").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    want = m.groupBy("k", "j").agg(F.collect_list("member").alias("a")).select("k", "j", ids.set_key("SIT-", 6, F.col("a")).alias("key"))
    assert sorted(map(tuple, got)) == sorted(map(tuple, want.collect())) and len(got) == 3
    assert scale.set_keys(m.limit(0), ["k", "j"], "member", "SIT-", 6, "key").count() == 0


def test_a_long_name_multiplies_no_text(spark):
    """Texts meet names by one rare word: a name of 40 words costs its occurrences, and containment holds both ways."""
    from cityweave.operators import places
    rnd = random.Random(3)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}x" for i in range(300)]
    long_name = " ".join(words[:40])
    names = [long_name, "nagar", "wolf nagar", r"odd\Ename here", *(" ".join(rnd.sample(words[40:], 2)) for _ in range(60))]
    texts = [" ".join(rnd.sample(words, 12)) + rnd.choice([" nagar", " nagarx", ", " + names[5], " (" + names[9] + ")", ""]) for _ in range(300)]
    texts += ["at " + long_name + " road", " ".join(words[10:20]), " ".join(words[10:20]) + " q", r"odd\Ename here", "nagar wolf"]
    around, inside = (spark.createDataFrame([(x,) for x in xs], f"{c} string") for xs, c in ((sorted(set(texts)), "around"), (names, "inside")))
    import re
    holds = lambda a, b: re.search(r"\b" + re.escape(b) + r"\b", a) is not None
    want = {(b, a) for a in texts for b in names if holds(a, b)}
    assert {(r.inside, r.around) for r in places.contained(inside, around).collect()} == want
    back = {(a, b) for a in texts for b in names if holds(b, a)}
    got = places.contained(around.select(F.col("around").alias("inside")), inside.select(F.col("inside").alias("around"))).collect()
    assert {(r.inside, r.around) for r in got} == back and (" ".join(words[10:20]), long_name) in back
    seen = {}
    for t in set(texts):
        for w in set(re.findall(r"\w+", t)):
            seen[w] = seen.get(w, 0) + 1
    bound = sum(min((seen.get(w, 0) for w in re.findall(r"\w+", n)), default=0) for n in names)
    assert len(want) <= places.word_candidates(inside, around).count() <= bound
