import numpy as np
from pyspark.sql import functions as F

from cityweave.llm import langid

PARTS = {"xa": ["th", "er", "on", "ing", "ha"], "xb": ["ch", "en", "ge", "ung", "ver"], "xc": ["ci", "ón", "que", "ado", "ll"]}


def made(spark, n=60):
    rows = []
    for k, (lang, parts) in enumerate(PARTS.items()):
        rng = np.random.default_rng(k)
        for i in range(n):
            words = ["".join(rng.choice(parts, rng.integers(1, 4))) for _ in range(rng.integers(4, 60))]
            rows.append((k * 1000 + i, " ".join(words).capitalize(), lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_held_out_accuracy(spark):
    docs = made(spark).repartition(4)
    out = langid.predict(docs, langid.fit_on(docs)).filter(langid.held_out(F.col("doc_id"))).collect()
    assert len(out) > 20 and np.mean([r.lang == r.lang_pred for r in out]) >= 0.95
    assert all(0 <= r.score <= 1 for r in out)


def test_edges(spark):
    docs = made(spark, 20)
    model = langid.fit_on(docs.unionByName(spark.createDataFrame([(1, None, "xa"), (None, "th er", "xa"), (2, "ch", None), (3, "", "xb")], docs.schema)))
    assert model.languages == ("xa", "xb", "xc")
    rows = [(1, None), (2, ""), (3, "12 :;"), (4, "Ж"), (5, "Therha therha " * 20_000), (6, "Therha"), (6, "Therha"), (None, "ciquella ón")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'q' as lang_pred", "5 as score", "text as lang")
    got = langid.predict(df, model)
    assert got.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    found = {(r.doc_id, r.lang_pred, r.score) for r in got.collect()}
    assert {(1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0)} <= found
    named = {d: p for d, p, _ in found}
    assert named[4] in model.languages and named[5] == named[6] == "xa" and named[None] == "xc"
    assert got.count() == len(rows) and langid.predict(df.limit(0), model).count() == 0


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b", None), (2, "1", None), (3, None, None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in langid.predict(docs, langid.fit_on(docs)).orderBy("doc_id").collect()] == [None, "und", "und"]


def test_filter_answers_for_all_languages_at_once(spark):
    """Every n-gram that was put in is found, in its language's slice; the correction takes chance hits off."""
    model = langid.fit_on(made(spark))
    data = np.frombuffer("qxzjqx wvkqzx".encode(), np.uint8)
    strange = langid.scores(model, data, np.array([0, len(data)]))
    known = np.frombuffer("therha oning".encode(), np.uint8)
    assert strange.max() <= 2 and langid.scores(model, known, np.array([0, len(known)]))[0, 0] > 20
    many = langid.Model(tuple(f"l{i:03d}" for i in range(70)), np.zeros((1024, 2), np.uint64), np.zeros(70))
    many.slots[:, 1] |= np.uint64(1 << 5)
    assert langid.scores(many, known, np.array([0, len(known)])).argmax() == 69


def plain_grams(text):
    low = bytearray(text.encode())
    for i, c in enumerate(low):
        low[i] = c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32
    for i in range(len(low) - 1):
        if low[i] == 0xC3 and 0x80 <= low[i + 1] <= 0x9E and low[i + 1] != 0x97:
            low[i + 1] += 32
    buf = bytes([32, *low, 32])
    return [(n, buf[i:i + n]) for n in langid.ORDERS for i in range(len(buf) - n + 1) if 32 not in buf[i + 1:i + n - 1] and buf[i:i + n] != b"  "]


def test_counts_are_those_of_plain_sets(spark):
    """Against sets of n-grams without a filter: counts differ by chance hits alone, and the winner is the same."""
    from collections import Counter
    docs = made(spark, 40)
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    rows += [(9000, "ÉÑ Çon über-ing 12 the", "xa"), (9001, "", "xb"), (9002, "ciÓn", "xc")]
    docs = spark.createDataFrame(rows, docs.schema)
    model = langid.fit_on(docs)
    kept = {r.doc_id for r in docs.filter(~langid.held_out(F.col("doc_id"))).select("doc_id").collect()}
    counts = {lang: Counter(g for d, t, x in rows if x == lang and d in kept for g in plain_grams(t)) for lang in model.languages}
    total = {(lang, n): sum(c for (m, _), c in counts[lang].items() if m == n) for lang in counts for n in langid.ORDERS}
    rate = {lang: {g: c / total[lang, g[0]] for g, c in counts[lang].items()} for lang in counts}
    most = Counter()
    for lang in rate:
        for g, r in rate[lang].items():
            most[g] = max(most[g], r)
    sets = {lang: {g for g, r in rate[lang].items() if r >= langid.MIN_RATE and r >= langid.SHARE * most[g]} for lang in rate}
    found = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs.select("doc_id", "text"), model).collect()}
    close = 0
    for d, text, _ in rows:
        grams = plain_grams(text)
        plain = [sum(g in sets[lang] for g in grams) for lang in model.languages]
        raw = text.encode()
        got = langid.scores(model, np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]
        slack = 2 + 6 * np.sqrt(len(grams) * model.false_positive + 1) + len(grams) * 0.02
        assert (np.abs(got - plain) <= slack).all(), (text, got, plain)
        best = sorted(plain)[-1]
        if text and best - sorted(plain)[-2] > 2 * slack.max():
            close += 1
            assert found[d][0] == model.languages[plain.index(best)]
    assert close > 60
