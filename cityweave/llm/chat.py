"""Chat transcripts to canonical turns by a hidden Markov model over lines.

States are (role, begins or goes on). A line shows a speaker marker, a length class, whether it asks,
whether it opens the transcript and whether it opens one of its texts; emission and transition tables are counted on labelled
transcripts, as whole numbers of thousandths of a nat. Viterbi runs over chunks of lines: a chunk's
best scores between any two states form a matrix, matrices of a transcript compose to the states at
the chunks' edges, and each chunk is then decoded between its edges. So the best path is that of the
whole transcript, though one transcript may be a third of all lines."""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.scale import rank_in, running_before
from .common import broadcast_if_small, stage, table

ROLES = ("assistant", "system", "user")
CHUNK = 2048
NEVER = -10 ** 12
#: names that are nobody's word for anything else; the others of NAMES are also words that one says
SURE = {"assistant": "assistant|ai|bot|gpt", "system": "system", "user": "user|human|prompter"}
PARTNERS = {"q": "a", "question": "answer", "a": "q", "answer": "question"}
NAMES = {"assistant": "assistant|ai|bot|model|answer|a|gpt", "system": "system|instructions?|context", "user": "user|human|prompter|customer|question|q"}
MARKER = r"^\s*(?:#{1,4}\s*|\*\*|\[|<\|)?(?i:NAMES)(?:\s*(?:\*\*)?\s*:(?:\*\*)?|\]|\|>)\s*"
OTHER = r"^\s*(?:#{1,4}\s*|\*\*|\[|<\|)?[\p{L}][\p{L} .]{0,20}(?:\s*(?:\*\*)?\s*:(?:\*\*)?|\]|\|>)\s*"
LENGTHS = (1, 40, 80, 160, 320, 640)
KINDS, SIZES = 5, len(LENGTHS) + 1


def marker(line: Column) -> Column:
    """0 none, 1 to 3 the role of that name, 4 another name."""
    kind = F.when(line.rlike(OTHER), 4).otherwise(0)
    for k, role in reversed(list(enumerate(ROLES, 1))):
        kind = F.when(line.rlike(MARKER.replace("NAMES", NAMES[role])), k).otherwise(kind)
    return kind


def _once(pattern: str) -> str:
    """The pattern of a marker to take off: the colon of a URL ends none."""
    return pattern.replace(r":(?:\*\*)?", r":(?!//)(?:\*\*)?")


def unmarked(line: Column, state: Column, speaker: Column) -> Column:
    """The line that opens a turn without its speaker marker: a sure name of the turn's role, or any name where
    ``speaker``. One marker at most is taken off."""
    out = F.when(speaker, F.regexp_replace(line, _once(OTHER), "")).otherwise(line)
    for k, role in enumerate(ROLES):
        sure = _once(MARKER.replace("NAMES", SURE[role]))
        out = F.when((state == 2 * k) & line.rlike(sure), F.regexp_replace(line, sure, "")).otherwise(out)
    return out


def name_of(line: Column) -> Column:
    """The name in a line's marker that is no sure one, in small letters; null without one."""
    name = F.lower(F.trim(F.regexp_extract(line, _once(OTHER).replace(r"[\p{L}][\p{L} .]{0,20}", r"([\p{L}][\p{L} .]{0,20})"), 1)))
    return F.when((name != "") & ~name.rlike("^(" + "|".join(SURE.values()) + ")$"), name)


def own_role(name: Column) -> Column:
    """The state that begins a turn of the role that a name stands for; null for a person's."""
    out = F.lit(None).cast("int")
    for k, role in enumerate(ROLES):
        out = F.when(name.rlike(f"^({NAMES[role]})$"), 2 * k).otherwise(out)
    return out


def symbol(line: Column, first: Column, opens: Column) -> Column:
    """What a line shows, as one number below ``SYMBOLS``: ``first`` of its transcript, ``opens`` a text."""
    size = F.lit(0)
    for n in LENGTHS:
        size = size + (F.length(line) >= n).cast("int")
    out = marker(line) * SIZES + size
    for shown in (line.rlike(r"\?\s*$"), first, opens):
        out = out * 2 + shown.cast("int")
    return out


SYMBOLS = KINDS * SIZES * 8


@dataclass(frozen=True)
class Model:
    """Scores: ``start`` by state, ``move`` (from, to), ``show`` (symbol, state). State 2 r begins a
    turn of role r, 2 r + 1 goes on with it."""
    start: np.ndarray
    move: np.ndarray
    show: np.ndarray


def _scores(counts: np.ndarray, allowed: np.ndarray) -> np.ndarray:
    smooth = np.where(allowed, counts + 1.0, 0.0)
    with np.errstate(divide="ignore"):
        out = 1000 * np.log(smooth / smooth.sum(axis=-1, keepdims=True))
    return np.where(allowed, np.rint(np.where(allowed, out, 0)), NEVER).astype(np.int64)


def conv_key(conv: Column) -> Column:
    """A transcript's id as a string that is never null."""
    return F.coalesce(F.concat(F.lit("c"), conv.cast("string")), F.lit("n"))


def transcript_lines(texts: DataFrame) -> DataFrame:
    """(conv, line, text, symbol and the other columns) of rows (conv, turn, text, ...): a transcript is
    its texts in order of turn (nulls first, then by text), parted at line feeds; a null text has no
    line. ``line`` counts from 0 within the transcript; ``conv`` is a string made by ``conv_key``."""
    texts = texts.withColumn("conv", conv_key(F.col("conv")))
    rows = stage(texts.filter("text is not null").withColumn("_h", F.xxhash64("text")).withColumn("_row", F.monotonically_increasing_id()), "chat-rows")
    chunk = F.coalesce(F.floor(F.col("turn") / 1024), F.lit(-(1 << 62)))
    counted = running_before(rows, ["conv"], ["turn", "_h", "_row"], chunk, F.size(F.split("text", "\n", -1)), "_before")
    keep = [F.col(c) for c in texts.columns if c not in ("conv", "text")]
    out = counted.select("conv", *keep, "_before", F.posexplode(F.split("text", "\n", -1)).alias("_at", "text"))
    out = out.withColumn("line", F.col("_before") + F.col("_at")).withColumn("inner", F.col("_at") > 0).drop("_before", "_at")
    return out.withColumn("symbol", symbol(F.col("text"), F.col("line") == 0, ~F.col("inner"))).withColumn("chunk", F.floor(F.col("line") / CHUNK))


def train(lines: DataFrame) -> Model:
    """From ``transcript_lines`` with a ``role``; lines of other roles or none teach nothing."""
    role = F.lit(None).cast("int")
    for k, r in enumerate(ROLES):
        role = F.when(F.col("role") == r, k).otherwise(role)
    d = lines.withColumn("state", role * 2 + F.col("inner").cast("int"))
    show = np.zeros((2 * len(ROLES), SYMBOLS))
    for r in d.filter("state is not null").groupBy("state", "symbol").agg(F.count("*").alias("n")).collect():
        show[r["state"], r["symbol"]] = r["n"]
    w = Window.partitionBy("conv", "chunk").orderBy("line")
    inside = d.select("state", F.lag("state").over(w).alias("before"), "line")
    last = d.filter(F.col("line") % CHUNK == CHUNK - 1).select("conv", (F.col("chunk") + 1).alias("chunk"), F.col("state").alias("before"))
    edge = d.filter((F.col("line") % CHUNK == 0) & (F.col("line") > 0)).join(last, ["conv", "chunk"]).select("state", "before", "line")
    move = np.zeros((2 * len(ROLES), 2 * len(ROLES)))
    start = np.zeros(2 * len(ROLES))
    counts = inside.unionByName(edge).filter("state is not null and (before is not null or line = 0)").groupBy("before", "state").agg(F.count("*").alias("n"))
    for r in counts.collect():
        if r["before"] is None:
            start[r["state"]] += r["n"]
        else:
            move[r["before"], r["state"]] += r["n"]
    state = np.arange(2 * len(ROLES))
    begins = state % 2 == 0
    allowed = begins[None, :] | (state[None, :] // 2 == state[:, None] // 2)
    return Model(_scores(start, begins), _scores(move, allowed), _scores(show, np.ones_like(show, bool)).T.copy())


# ------------------------------------------------------------------ decoding ---------------
def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of rows of one (conv, chunk) from batches sorted by them."""
    held: list[pa.Table] = []
    key = None
    for batch in batches:
        part = pa.Table.from_batches([batch])
        keys = list(zip(part.column("conv").to_pylist(), part.column("chunk").to_pylist()))
        a = 0
        while a < len(keys):
            b = a
            while b < len(keys) and keys[b] == keys[a]:
                b += 1
            if held and keys[a] != key:
                yield pa.concat_tables(held).combine_chunks()
                held = []
            key = keys[a]
            held.append(part.slice(a, b - a))
            a = b
    if held:
        yield pa.concat_tables(held).combine_chunks()


def span_matrix(model: Model, symbols: np.ndarray, first: bool) -> np.ndarray:
    """Best scores from the state before a span to its last state; of a first span, row 0 alone."""
    show = model.show[symbols]
    if first:
        best = (model.start + show[0])[None, :]
    else:
        best = model.move + show[0][None, :]
    for t in range(1, len(show)):
        best = (best[:, :, None] + model.move[None, :, :]).max(axis=1) + show[t][None, :]
    return np.maximum(best, 2 * NEVER)


def decode(model: Model, symbols: np.ndarray, before: int | None, last: int | None) -> np.ndarray:
    """Best states of a span after state ``before`` (None: it opens the transcript) that end in ``last``
    (None: in the best). Of equal choices the lower state is taken."""
    show = model.show[symbols]
    best = (model.start if before is None else model.move[before]) + show[0]
    back = np.zeros(show.shape, dtype=np.int64)
    for t in range(1, len(show)):
        ways = best[:, None] + model.move
        back[t] = ways.argmax(axis=0)
        best = np.maximum(ways.max(axis=0), 2 * NEVER) + show[t]
    out = np.empty(len(show), dtype=np.int64)
    out[-1] = int(best.argmax()) if last is None else last
    for t in range(len(show) - 1, 0, -1):
        out[t - 1] = back[t, out[t]]
    return out


def _edges(model: Model, matrices: list[np.ndarray]) -> list[tuple[int | None, int]]:
    """(state before, last state) of each span, from the matrices of a transcript's spans in order."""
    reach = [matrices[0][0]]
    for m in matrices[1:]:
        reach.append((reach[-1][:, None] + m).max(axis=0))
    last = int(reach[-1].argmax())
    out: list[tuple[int | None, int]] = []
    for k in range(len(matrices) - 1, 0, -1):
        before = int((reach[k - 1] + matrices[k][:, last]).argmax())
        out.append((before, last))
        last = before
    return [(None, last), *reversed(out)]


def recover_roles(lines: DataFrame, model: Model) -> DataFrame:
    """(conv, line, text, state) of ``transcript_lines``: the most likely states of each transcript."""
    lines = stage(lines.select("conv", "chunk", "line", "text", "symbol"), "chat-lines")
    long_ = lines.filter(F.col("line") == CHUNK).select("conv").distinct()

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches):
            m = span_matrix(model, g.column("symbol").to_numpy(), g.column("chunk")[0].as_py() == 0)
            yield pa.RecordBatch.from_arrays([g.column("conv").combine_chunks()[:1], g.column("chunk").combine_chunks()[:1], pa.array([m.ravel().tolist()], pa.list_(pa.int64()))], ["conv", "chunk", "m"])

    def edges(t: pa.Table) -> pa.Table:
        t = t.sort_by("chunk")
        width = len(model.start)
        found = _edges(model, [np.array(x, dtype=np.int64).reshape(-1, width) for x in t.column("m").to_pylist()])
        return pa.table([t.column("conv"), t.column("chunk"), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())],
                        names=["conv", "chunk", "before", "last"])

    some = lines.select("conv", "chunk", "line", "symbol")
    wide = some.join(long_, "conv", "left_semi")
    spans = wide.repartition("conv", "chunk").sortWithinPartitions("conv", "chunk", "line").mapInArrow(matrices, "conv string, chunk long, m array<long>")
    ends = stage(spans.groupBy("conv").applyInArrow(edges, "conv string, chunk long, before long, last long"), "chat-edges")  # a row a chunk

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches):
            s = decode(model, g.column("symbol").to_numpy(), g.column("before")[0].as_py(), g.column("last")[0].as_py())
            out = g.select(["conv", "chunk", "line", "text"]).append_column("state", pa.array(s))
            yield from out.to_batches()

    both = lines.join(ends, ["conv", "chunk"], "left").select("conv", "chunk", "line", "text", "symbol", "before", "last")
    return both.repartition("conv", "chunk").sortWithinPartitions("conv", "chunk", "line").mapInArrow(states, "conv string, chunk long, line long, text string, state long")


def render(decoded: DataFrame) -> DataFrame:
    """(conv, turn_no, role, n_lines, first_line, rendered): one row a recovered turn, its marker taken off.

    A sure name (user, assistant, ...) is a marker if it is the turn's role. Any other word before a colon is
    one if it is a speaker's: it opens two turns of the transcript or more, all of one role, its own if it
    stands for one, or one turn where its partner (question and answer) opens another. Any other
    beginning of a line is part of what is said."""
    d = stage(decoded, "chat-states").withColumn("begins", (F.col("state") % 2 == 0).cast("long"))
    d = d.withColumn("_name", F.when(F.col("begins") == 1, name_of(F.col("text"))))
    named = (d.filter("_name is not null").groupBy("conv", "_name").agg(F.count("*").alias("n"), F.min("state").alias("a"), F.max("state").alias("b"))
             .filter((F.col("a") == F.col("b")) & F.coalesce(own_role(F.col("_name")) == F.col("a"), F.lit(True))))
    named = stage(named, "chat-names")
    partner = F.create_map(*[F.lit(x) for pair in PARTNERS.items() for x in pair])
    met = named.select("conv", F.element_at(partner, F.col("_name")).alias("_name"), F.lit(True).alias("_met")).filter("_name is not null")
    speakers = named.join(met, ["conv", "_name"], "left").filter("n > 1 or _met").select("conv", "_name", F.lit(True).alias("_speaker"))
    speakers = broadcast_if_small(stage(speakers, "chat-speakers"))
    d = running_before(d, ["conv"], ["line"], F.col("chunk"), F.col("begins"), "_turns").withColumn("turn_no", F.col("_turns") + F.col("begins") - 1)
    d = d.withColumn("_name", F.coalesce("_name", F.concat(F.lit("\n"), F.col("line").cast("string"))))  # lines without a name stay spread
    d = d.join(speakers, ["conv", "_name"], "left")
    said = F.when(F.col("begins") == 1, unmarked(F.col("text"), F.col("state"), F.coalesce("_speaker", F.lit(False)))).otherwise(F.col("text"))
    turns = d.groupBy("conv", "turn_no").agg(F.min_by("state", "line").alias("state"), F.count("*").alias("n_lines"), F.min("line").alias("first_line"),
                                             F.sort_array(F.collect_list(F.struct("line", said.alias("said")))).alias("lines"))
    role = F.element_at(F.array(*map(F.lit, ROLES)), (F.floor(F.col("state") / 2) + 1).cast("int"))
    body = F.array_join(F.transform("lines", lambda x: x["said"]), "\n")
    return turns.select("conv", "turn_no", role.alias("role"), "n_lines", "first_line", F.concat(F.lit("<|"), role, F.lit("|>\n"), body, F.lit("\n<|end|>\n")).alias("rendered"))


def conv_of(conv: Column, kind) -> Column:
    """The id that ``conv_key`` made a string of."""
    return F.when(conv != "n", F.substring(conv, 2, 1 << 30)).cast(kind)


def format_chats(texts: DataFrame, model: Model) -> DataFrame:
    """(conv, turn_no, role, n_lines, first_line, rendered) of transcripts (conv, turn, text), whose texts hold
    speaker markers or not, and any number of turns each.

    A turn loses one speaker marker at most (see ``render``) and nothing else. Null texts add nothing; an empty text is one empty line; rows of a null conv are one transcript.
    Repeated rows are said twice. Extra columns are ignored; an empty table gives no rows."""
    out = render(recover_roles(transcript_lines(texts.select("conv", "turn", "text")), model))
    return out.withColumn("conv", conv_of(F.col("conv"), texts.schema["conv"].dataType))


def raw_transcripts(conversations: DataFrame) -> DataFrame:
    """(conv, turn, role, text): the table's turns as a raw transcript would have them. The marker of a
    turn depends on a checksum: of 20 turns, 11 name the speaker in the transcript's style, 2 bear
    an unrelated name and 7 none."""
    style = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(3))
    draw = F.pmod(F.crc32(F.concat_ws(":", "conv_id", "turn").cast("binary")), F.lit(20))
    words = F.when(style == 0, F.initcap("role")).when(style == 1, F.when(F.col("role") == "user", "### Human").when(F.col("role") == "assistant", "### AI").otherwise("### System")) \
             .otherwise(F.when(F.col("role") == "user", "Q").when(F.col("role") == "assistant", "A").otherwise("Context"))
    mark = F.when((draw < 11) & F.col("role").isNotNull(), F.concat(words, F.lit(": "))).when(draw < 13, F.lit("Note: ")).otherwise(F.lit(""))
    return conversations.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"),
                                F.concat(mark, F.col("text").cast("string")).alias("text"))


def held_out(conv: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(conv.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def op5_chat_formatting(spark, sf_dir: str) -> DataFrame:
    """With the role that the table gives a turn's first line, and whether a turn of the table begins there."""
    raw = raw_transcripts(table(spark, sf_dir, "conversations"))
    model = train(transcript_lines(raw.filter(~held_out(F.col("conv")))))
    lines = stage(transcript_lines(raw), "chat-transcripts")
    out = render(recover_roles(lines, model))
    truth = lines.select("conv", F.col("line").alias("first_line"), F.col("role").alias("true_role"), (~F.col("inner")).alias("true_begin"))
    out = out.join(truth, ["conv", "first_line"], "left").withColumn("conv_id", conv_of(F.col("conv"), "long"))
    return out.select("conv_id", held_out(F.col("conv_id")).alias("held_out"), "turn_no", "role", "n_lines", "rendered", "true_role", "true_begin")
