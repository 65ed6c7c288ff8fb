import random

import pytest

from . import brute


@pytest.fixture
def tables(spark, prose, tmp_path):
    rng = random.Random(8)
    items = [(i, " ".join(prose(25, 100 + i))) for i in range(4)]
    rows, common = [], " ".join(prose(60, 1))
    for i in range(60):
        w = prose(rng.randint(20, 120), 200 + i % 25)
        if i >= 25:
            w[rng.randrange(len(w))] = f"z{i}"
        body = [" ".join(w)]
        if i % 9 == 0:
            body.append(common)
        if i % 13 == 0:
            body.append("Start " + items[i % 4][1])
        rows.append((i, "\n".join(body), ("xa", "xb")[i % 2], f"s{i % 3}", 0))
    rows += [(90, None, None, None, None), (91, "12 34", "xa", "s", 5), (92, "", None, "s", 0), (93, "Ж", None, "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), rows, items


def test_against_brute_force(spark, tables):
    import corpus_pipeline
    sf_dir, rows, items = tables
    docs = [(r[0], r[1]) for r in rows if any(c.isalpha() for c in r[1] or "") and r[0] != 93]  # of 93 no n-gram is known
    kept = {d: t for d, t in brute.without_lines(docs, 80).items() if brute.WORD.findall(t)}
    assert len(kept) < len(docs)  # documents whose every line came before go
    named = brute.groups(sorted(kept.items()), 80)
    kept = [(d, t) for (d, t), (_, c) in zip(sorted(kept.items()), named) if d == c]
    kept = {d: t for d, t in kept if not brute.hit(t, items)[1]}
    out = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in out) == sorted(kept) and 0 < len(kept) < len(docs)
    assert {r.doc_id: r.length for r in out} == {d: len(brute.WORD.findall(t)) for d, t in kept.items()}


def test_stages_return_documents(spark, tables):
    import corpus_pipeline
    sf_dir, rows, _ = tables
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, f in corpus_pipeline.STAGES[:-1]:
        out = f(spark, docs, sf_dir)
        assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]
        assert f(spark, docs.limit(0), sf_dir).count() == 0
    assert corpus_pipeline.packed(spark, docs, sf_dir).count() == len(rows)
