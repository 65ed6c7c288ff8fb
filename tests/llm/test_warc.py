import base64
import hashlib
import random

import pytest

from cityweave.llm import warc


def test_loser_tree_merges_any_number_of_runs():
    rng = random.Random(2)
    for k in range(0, 12):
        runs = [sorted((rng.choice("abc"), rng.choice("xy"), rng.randrange(9), (i, j)) for j in range(rng.randrange(0, 9))) for i in range(k)]
        assert [x[:3] for x in warc.LoserTree([iter(r) for r in runs])] == sorted(x[:3] for r in runs for x in r)


def expected(rows, least=0):
    first = {}
    for p, _, h in rows:
        h = (h or "").encode()
        if p is not None:
            first[h] = min(first.get(h, p), p)
    out = []
    for p, _, h in rows:
        h = (h or "").encode()
        again = len(h) >= least and h in first and p != first[h]
        out.append((p, len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(), "revisit" if again else "response", first[h] if again else None))
    return sorted(out, key=str)


ROWS = [(i * 13 % 200, f"http://{'www.' * (i % 2)}Host{i % 7}.example.org/p/{i % 5}?q={i}", f"<p>{i % 40} é</p>" * (i % 3)) for i in range(120)]
ROWS += [(300, None, None), (301, "", ""), (302, "http://[bad", "x"), (303, "https://a.b/c\r\nEvil: 1", "x\r\n\r\ny"), (None, "http://a.b/", "x"), (None, None, "only"),
         (304, "http://a.b/", "long " * 200_000), (305, "http://a.b/", "x"), (305, "http://a.b/", "x"), (302, "http://a.b/", "x")]


@pytest.mark.parametrize("least,fan_in", [(0, 64), (10, 2)])
def test_round_trip(spark, tmp_path, least, fan_in):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string").repartition(7).selectExpr("*", "1 as sha1", "2 as first", "3 as size")
    index = warc.capture_index(df, f"file://{tmp_path}/w", least, fan_in)
    entries = [tuple(r) for r in index.collect()]
    keys = [(e[0], e[1], -1 if e[2] is None else e[2]) for e in entries]
    assert len(entries) == len(ROWS) and sorted(keys) == sorted((warc.url_key(u), f"{warc.capture_time(p):%Y%m%d%H%M%S}", -1 if p is None else p) for p, u, _ in ROWS)
    parts = index.rdd.mapPartitions(lambda it: [[(r.urlkey, r.timestamp, -1 if r.page_id is None else r.page_id) for r in it]]).collect()
    assert all(p == sorted(p) for p in parts)
    spans = sorted((p[0], p[-1]) for p in parts if p)
    assert all(a[1][:2] < b[0][:2] for a, b in zip(spans, spans[1:]))
    assert sorted((tuple(r) for r in warc.read(index, f"file://{tmp_path}/w").collect()), key=str) == expected(ROWS, least)


def test_empty(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    index = warc.capture_index(df, f"{tmp_path}/w")
    assert index.count() == 0 and warc.read(index, f"{tmp_path}/w").count() == 0


def test_url_keys():
    assert warc.url_key("https://www.A.example.com:8080/b?c#d") == "com,example,a:8080)/b?c"
    assert warc.url_key(None) == "" and warc.url_key("http://x.y") == "y,x)/"
