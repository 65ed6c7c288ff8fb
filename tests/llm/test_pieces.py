import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from cityweave.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", " ", "  ", "▁", "▁▁ ", "a", "Hello  world", " lead", "trail ", "a\n b\n\n  c", "\t\x00\x1f", "é é ﬁ ①", "梦☃\U0001f600 中文", "<s> </s> <0x0A> <unk>",
         "aaaa" * 50, "ab" * 4000, "the" * 500, " " * 300, "don't stop... ", "é" * 130, "x y z"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def texts(prose):
    r = random.Random(3)
    odd = ["".join(r.choice("ab  \n\tZé梦☃▁̀\U0001f600.,the ing \x00 ﬁ①") for _ in range(r.randint(1, 60))) for _ in range(1500)]
    return TEXTS + odd + [" ".join(prose(60, i)) + ".\n" + ", ".join(prose(9, i)).upper() for i in range(40)]


@pytest.fixture(scope="module")
def prose():
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdefghijklmnopéßñ") for _ in range(r.randint(2, 11))) for _ in range(900)]
    return lambda n, seed: random.Random(seed).choices(vocabulary, k=n)


def test_ids_spans_and_text_are_the_librarys(library, texts):
    enc = pieces.Encoder(open(PATH, "rb").read())
    for _ in range(2):  # words unknown, words remembered
        for text, (ids, begins, ends) in zip(texts, enc.encode(texts)):
            want = library.encode(text, return_type="proto").pieces
            assert ids.tolist() == [1, *(p.id for p in want), 2], text
            assert list(zip(begins[1:-1].tolist(), ends[1:-1].tolist())) == [(p.begin, p.end) for p in want], text
            assert (begins[0], ends[0], begins[-1], ends[-1]) == (0, 0, len(text.encode()), len(text.encode()))
            assert enc.decode(ids).decode() == library.decode(ids.tolist())
    assert [x[0].tolist() for x in enc.encode(texts[:1])] == [[1, 2]]


def test_any_ids_decode_as_in_the_library(library):
    enc, r = pieces.encoder(PATH), random.Random(1)
    few = [0, 1, 2, 3, 259, 260, 262, 28705]
    for _ in range(2000):
        ids = [r.choice([r.choice(few), r.randrange(3, 259), r.randrange(32000)]) for _ in range(r.randint(0, 12))]
        assert enc.decode(np.array(ids, "<u4")).decode() == library.decode(ids), ids


@pytest.mark.parametrize("squeeze", [False, True])
@pytest.mark.parametrize("prefix", [False, True])
def test_character_map_takes_the_longest_entry_and_keeps_the_place(texts, squeeze, prefix):
    blob = dict(f for n, m in pieces._fields(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()) if n == 3 for f in pieces._fields(m))[2]
    library = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc", add_dummy_prefix=prefix, escape_whitespaces=True, remove_extra_whitespaces=squeeze)
    enc = pieces.encoder(PATH)
    own = object.__new__(pieces.Encoder)
    own.__dict__.update(enc.__dict__, map=pieces.CharacterMap(blob), squeeze=squeeze, prefix=prefix)
    for text in [*texts, "  ﬁ  Ａ é ①  ", "ｱﾞ  ㍿ x", "é 　 a\r\n b", "ﷺ"]:
        made, at = own.normalise(text)
        want, where = library.Normalize(text, with_offsets=True)
        assert (made, [len(text.encode()[:x].decode("utf-8", "ignore")) for x in at]) == (want, where), text


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        pieces.Encoder(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto())  # no pieces, no byte fallback


def test_tables(spark, library, prose):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100, None), (None, "nobody"), (7, "a"), (7, "a"), (101, " ".join(prose(60_000, 1))), (102, "q" * 40_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id", "'x' as ids").repartition(4)
    encoded = pieces.encode(df, PATH)
    for r in encoded.filter("id = 6").collect():
        assert list(zip(r.begins, r.ends)) == [(0, 0), (0, 5), (5, 6), (6, 12), (12, 12)]
    digest = lambda ids: hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    want = []
    for d, t in rows:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        want.append((d, len(ids), digest(ids), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert sorted(map(tuple, pieces.digests(encoded, PATH).collect()), key=key) == sorted(want, key=key)
    assert pieces.digests(pieces.encode(df.limit(0), PATH), PATH).count() == 0


def test_memory_of_words_starts_anew(library, texts, monkeypatch):
    monkeypatch.setattr(pieces, "MEMO_BYTES", 10_000)
    enc = pieces.Encoder(open(PATH, "rb").read())
    for i in range(0, 600, 20):
        for t, (ids, _, _) in zip(texts[i:i + 20], enc.encode(texts[i:i + 20])):
            assert ids.tolist() == library.encode(t, add_bos=True, add_eos=True)
    assert enc.held < 10_000 + 330 * 2000
