import numpy as np
import pytest
from pyspark.sql import functions as F

from cityweave.llm import chat


def rows(n=60):
    rng = np.random.default_rng(1)
    out = []
    for c in range(n):
        for t in range(rng.integers(2, 9)):
            role = ("user", "assistant")[t % 2]
            text = ("word " * rng.integers(3, 10)).strip() + "?" if role == "user" else "\n".join(("longer words " * rng.integers(12, 40)).strip() + "." for _ in range(rng.integers(1, 4)))
            out.append((c, t, role, text))
    return out


def frame(spark, data):
    return spark.createDataFrame(data, "conv_id long, turn long, role string, text string")


def model_of(spark, data):
    return chat.train(chat.transcript_lines(chat.raw_transcripts(frame(spark, data))))


def test_held_out_roles(spark):
    data = rows()
    raw = chat.raw_transcripts(frame(spark, data)).repartition(4)
    model = chat.train(chat.transcript_lines(raw.filter(~chat.held_out(F.col("conv")))))
    lines = chat.transcript_lines(raw.filter(chat.held_out(F.col("conv"))))
    truth = {(r.conv, r.line): r.role for r in lines.collect()}
    got = chat.recover_roles(lines, model).collect()
    assert len(got) == len(truth) and np.mean([chat.ROLES[r.state // 2] == truth[r.conv, r.line] for r in got]) > 0.9


@pytest.mark.parametrize("size", [3, 7])
def test_chunks_decode_as_the_whole(spark, monkeypatch, size):
    """The path through chunks scores as much as the best path of the whole transcript."""
    model = model_of(spark, rows())
    monkeypatch.setattr(chat, "CHUNK", size)
    lines = chat.transcript_lines(chat.raw_transcripts(frame(spark, rows(8))).withColumn("conv", F.when(F.col("conv") > 4, F.col("conv"))))
    seen = {}
    for r in lines.collect():
        seen.setdefault(r.conv, {})[r.line] = r.symbol
    got = {}
    for r in chat.recover_roles(lines, model).collect():
        got.setdefault(r.conv, {})[r.line] = r.state

    def score(symbols, states):
        return model.start[states[0]] + sum(model.move[a, b] for a, b in zip(states, states[1:])) + sum(model.show[o, s] for o, s in zip(symbols, states))

    assert got.keys() == seen.keys() and "n" in got
    for conv, symbols in seen.items():
        o, s = [symbols[k] for k in range(len(symbols))], [got[conv][k] for k in range(len(symbols))]
        assert score(o, s) == score(o, list(chat.decode(model, np.array(o), None, None)))


def test_viterbi_against_all_paths():
    from itertools import product
    rng = np.random.default_rng(3)
    m = chat.Model(rng.integers(-50, 0, 4), rng.integers(-50, 0, (4, 4)), rng.integers(-50, 0, (5, 4)))
    for _ in range(20):
        o = rng.integers(0, 5, 5)
        value = lambda p: m.start[p[0]] + sum(m.move[a, b] for a, b in zip(p, p[1:])) + sum(m.show[x, s] for x, s in zip(o, p))
        assert value(chat.decode(m, o, None, None)) == max(map(value, product(range(4), repeat=5)))


def test_markers_are_read_and_taken_off(spark):
    said = ["User: hi there?", "### AI: fine", "**Human:** q", "[SYSTEM] be kind", "<|assistant|> yes", "Note: x", "plain", "A: b", "http://a.b"]
    df = spark.createDataFrame([(s,) for s in said], "t string")
    state = F.greatest((chat.marker(F.col("t")) - 1) * 2, F.lit(0))
    got = [tuple(r) for r in df.select(chat.marker(F.col("t")), chat.unmarked(F.col("t"), state, F.col("t").startswith("Note"))).collect()]
    assert [g[0] for g in got] == [3, 1, 3, 2, 1, 4, 0, 1, 4] and [g[1] for g in got] == ["hi there?", "fine", "q", "be kind", "yes", "x", "plain", "A: b", "http://a.b"]


def test_a_turn_loses_one_marker_alone(spark):
    """What is said may begin with 'word:' or a URL; a name is a speaker's if it opens several turns of one role."""
    same = lambda *lines: [(x, x) for x in lines]
    said = {"a": [("User: In short: yes", "In short: yes"), *same("Steps: 1", "http://a.b", "Question: Q: why?", "plain")],
            "b": [("Bob: Note: x", "Note: x"), ("Ann: y", "y"), ("BOB: http://c", "http://c"), ("Ann: Steps: 2", "Steps: 2"), ("Once: z", "Once: z"), ("http://d", "http://d"), ("User: w", "w"), ("http://e", "http://e")],
            "c": [("Note: u", "Note: u"), ("Note: v", "Note: v"), ("Ann: y", "Ann: y")],
            "d": same("Question: what is it?", "what", "Context: the law of 1990", "Instructions: mix well"), "e": same("hm", "Answer: 42"), "f": same("so", "A: first option"),
            "g": same("User", "Assistant", "assistant: wrong role", "User: wrong role"), "h": [("Q: why?", "why?"), ("A: so", "so")],
            "i": [("Question: a", "a"), ("Answer: b", "b"), ("Question: c", "c"), ("Answer: d", "d")], "j": same("Answer: x", "Question: y", "Answer: z", "Question: w"),
            "k": [("Q: x", "x"), ("so", "so"), ("q: y", "y")], "l": same("word: x", "word : y", "10:30 it was", "a/b: c")}
    data = [(conv, 0, k, line, 4 if k % 2 == 0 else 0) for conv, lines in said.items() for k, (line, _) in enumerate(lines)]
    got = chat.render(spark.createDataFrame(data, "conv string, chunk long, line long, text string, state long")).collect()
    bodies = {(r.conv, r.turn_no): r.rendered.split("\n", 1)[1].removesuffix("\n<|end|>\n") for r in got}
    assert bodies == {(conv, k): left for conv, lines in said.items() for k, (_, left) in enumerate(lines)}


def test_edges(spark):
    model = model_of(spark, rows())
    data = [(1, 0, None), (2, None, "x"), (2, 0, ""), (None, 0, "User: a word?"), (None, 1, "Assistant: " + "longer words " * 20 + "."), (3, 0, "same"), (3, 0, "same"), (4, 0, "w " * 50_000)]
    df = spark.createDataFrame(data, "conv long, turn long, text string").selectExpr("*", "1 as line", "2 as chunk", "3 as state")
    got = chat.format_chats(df, model).collect()
    by = {}
    for r in got:
        by.setdefault(r.conv, []).append(r)
    assert set(by) == {2, 3, 4, None} and sum(r.n_lines for r in by[2]) == 2 and sum(r.n_lines for r in by[3]) == 2
    turns = sorted(by[None], key=lambda r: r.turn_no)
    assert [(t.role, t.rendered) for t in turns] == [("user", "<|user|>\na word?\n<|end|>\n"), ("assistant", "<|assistant|>\n" + "longer words " * 20 + ".\n<|end|>\n")]
    assert chat.format_chats(df.limit(0), model).count() == 0
    assert chat.train(chat.transcript_lines(df.limit(0).withColumn("role", F.lit("user")))).move.shape == (6, 6)
