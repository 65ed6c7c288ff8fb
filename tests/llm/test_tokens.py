import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cityweave.llm import tokens
from cityweave.operators.scale import stage_root

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", "a", "Hello, world.", "don't stop...", "  two  spaces", "line\nline", "line \n line", "x\n\ny\n", "tab\there", "é ñ ß 中文", "a b", "42nd street!!",
         "word's end.", "¿qué?", "l'été", " lead", "trail ", "<|endoftext|> x", " ", "a\x1cb", "x²,", "٣,"]


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(PATH)


def test_words_remembered_are_the_whole_texts_ids(tok, prose):
    enc = tokens.Encoder(PATH)
    texts = [*TEXTS, "\n".join(" ".join(prose(30, i)) for i in range(5)), "A b, c! D's e;f g?h (i) j\nk-l m_n 3,4 5. ,x"]
    for _ in range(2):
        for t in texts:
            assert np.frombuffer(enc.ids(t), enc.dtype).tolist() == tok.encode(t, add_special_tokens=False).ids, t


def expected(tok, rows):
    start, out = 0, []
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_round_trip_and_random_access(spark, tok, prose, tmp_path):
    rows = [(i * 37 % 1000, t) for i, t in enumerate(TEXTS)] + [(5000, None), (5001, " ".join(prose(40_000, 1)))]
    rows += [(6000 + i, " ".join(prose(50, i))) for i in range(100)] + [(None, "nobody")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).selectExpr("*", "1 as id", "2 as shard")
    shards = tokens.write(df, PATH, f"file://{tmp_path}/t", length=16)
    want = expected(tok, rows)
    got = sorted((tuple(r) for r in tokens.read(shards).collect()), key=lambda r: r[1])
    assert got == want
    flat = []
    for r in shards.orderBy("shard").collect():
        seq = tokens.Sequences(r.path)
        for k in range(len(seq)):
            ids, mask = seq[k]
            assert len(ids) == len(mask) == 16 and not ids.flags.writeable
            flat += ids[np.asarray(mask)].tolist()
    every = [i for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)) for i in (*tok.encode(t or "", add_special_tokens=False).ids, 2)]
    assert flat == every


def test_repeated_rows_and_empty_table(spark, tok, tmp_path):
    rows = [(1, "same"), (1, "same"), (1, "same")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.start for r in tokens.read(tokens.write(df, PATH, f"{tmp_path}/a")).collect()) == [0, 2, 4]
    assert tokens.read(tokens.write(df.limit(0), PATH, f"{tmp_path}/b")).count() == 0
    assert stage_root(spark)
