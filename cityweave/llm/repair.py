"""Repair of a conversation's structure: the cheapest edits that make its roles alternate.

The roles' initials must spell ``(s?(ua)+)?``, which an automaton of four states reads: 0 nothing yet, 1 after
the system's turn, 2 a user has spoken, 3 an assistant has answered. A node is (row, state); from it a row is
deleted, kept or given the role that the state asks for, or a turn of that role is inserted before it.

Cost goes backwards over chunks of rows: a chunk is a (min, +) matrix of the states, matrices of a
conversation compose to the costs at the chunks' edges, so one conversation may be a third of all rows.
Among the arcs of cheapest paths the audit (the edits' initials) decides: arcs are ranked by the first 1, 2,
4, ... letters of the least audit that begins with them, a rank of twice the length being the pair of the
ranks here and where the pointer leads; then the pointers along the arcs of least rank are doubled, and step t
of a path is found from the bits of t."""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scale import rank_by_range
from .common import broadcast_if_small, ready, stage, table

CHUNK = 1024
SPACE = " \t\n\x0b\x0c\r"
ROLES = ("user", "assistant")
DELETE, INSERT, KEEP, REROLE = range(4)  # in the order of their initials
LETTERS = "DIKR"
COSTS = {DELETE: 2, INSERT: 5, KEEP: 0, REROLE: 1}
CUT_OFF = 5  # an undeleted truncated row
FAR = np.int64(1) << 50
INITIALS = "sua"  # a role's code is its place here, 3 for others
ASKED = np.array([2, 2, 3, 2])  # the state that an inserted or re-roled turn leads to
READ = np.array([[1, -1, -1, -1], [2, 2, -1, 2], [-1, -1, 3, -1], [-1, -1, -1, -1]])  # by code and state
ENDS = np.array([0, 2 * COSTS[INSERT], COSTS[INSERT], 0])  # cost to go from the states after the last row
FINE, TRUNCATED, LOST = range(3)  # as it is; costs more undeleted; must be deleted


# ------------------------------------------------------------------ rows ---------------------
def conv_key(conv: Column) -> Column:
    """A conversation's id as a string that is never null."""
    return F.coalesce(F.concat(F.lit("c"), conv.cast("string")), F.lit("n"))


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows (conv_id, turn, role, text) after damage by a checksum of id and turn, out of 20: one is
    dropped, one loses its text, one its ``.!?``, one is repeated, one is the user's. Nulls are one space, but
    a turn stays null."""
    spaced = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    draw = F.pmod(F.crc32(F.concat(spaced[0], F.lit(":"), spaced[1]).cast("binary")), F.lit(20))
    d = conversations.select(F.col("conv_id"), F.col("turn").cast("long").alias("turn"), spaced[2].alias("role"), spaced[3].alias("text"), draw.alias("_draw"))
    text = F.when(F.col("_draw") == 1, "").when(F.col("_draw") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_draw") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("_draw") == 3, 2).otherwise(1)
    return d.filter("_draw <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), times)).alias("_copy")).drop("_copy")


def judged(rows: DataFrame) -> DataFrame:
    """(conv, pos, chunk, turn, role, text, code, fault, blank, duplicate, truncated) of rows (conv_id, turn,
    role, text) without nulls in role and text. ``pos`` counts a conversation's rows by turn (nulls first),
    role and text."""
    d = rows.withColumn("conv", conv_key(F.col("conv_id"))).select("conv", "turn", "role", "text")
    d = rank_by_range(d, ["conv"], ["turn", "role", "text"], "pos")
    d = stage(d.withColumn("_same", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)), "repair-rows")
    firsts = d.groupBy("conv", "_same").agg(F.min("pos").alias("_first"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    d = d.join(broadcast_if_small(stage(firsts, "repair-firsts")), ["conv", "_same"], "left")
    trimmed = F.rtrim("text", F.lit(SPACE))
    d = d.withColumn("blank", trimmed == "")
    d = d.withColumn("duplicate", ~F.col("blank") & F.coalesce(F.col("pos") > F.col("_first"), F.lit(False)))
    d = d.withColumn("truncated", ~F.col("blank") & ~F.col("duplicate") & ~F.right(trimmed, F.lit(1)).isin(".", "!", "?"))
    code = F.lit(len(INITIALS))
    for k, letter in enumerate(INITIALS):
        code = F.when(F.substring("role", 1, 1) == letter, k).otherwise(code)
    fault = F.when(F.col("blank") | F.col("duplicate"), LOST).when(F.col("truncated"), TRUNCATED).otherwise(FINE)
    return d.select("conv", "pos", F.floor(F.col("pos") / CHUNK).alias("chunk"), "turn", "role", "text", code.alias("code"), fault.alias("fault"),
                    *[F.col(c).cast("long").alias(c) for c in ("blank", "duplicate", "truncated")])


# ------------------------------------------------------------------ costs --------------------
def _inserted(base: np.ndarray) -> np.ndarray:
    """Cost to go by state, once turns may be inserted first."""
    step = COSTS[INSERT]
    return np.stack([np.minimum(base[:, 0], np.minimum(step + base[:, 2], 2 * step + base[:, 3])), np.minimum(base[:, 1], np.minimum(step + base[:, 2], 2 * step + base[:, 3])),
                     np.minimum(base[:, 2], step + base[:, 3]), np.minimum(base[:, 3], step + base[:, 2])], axis=1)


def _ways(code: np.ndarray, fault: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cost to go, next state) by row, state and edit of the row; ``after`` is the cost to go by state after
    each row. Inserting is left far."""
    n = len(code)
    cost, to = np.full((n, 4, 4), FAR), np.zeros((n, 4, 4), dtype=np.int64)
    more = np.where(fault == TRUNCATED, CUT_OFF, 0)[:, None]
    read, alive = READ[code], (fault != LOST)[:, None]
    to[:, :, DELETE], to[:, :, KEEP], to[:, :, REROLE] = np.arange(4), np.maximum(read, 0), ASKED
    cost[:, :, DELETE] = COSTS[DELETE] + after
    cost[:, :, KEEP] = np.where(alive & (read >= 0), COSTS[KEEP] + more + np.take_along_axis(after, to[:, :, KEEP], 1), FAR)
    cost[:, :, REROLE] = np.where(alive, COSTS[REROLE] + more + after[:, ASKED], FAR)
    return np.minimum(cost, FAR), to


def costs_to_go(code: np.ndarray, fault: np.ndarray, start: np.ndarray, count: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cost to go before each row, after each row), by state, of runs of rows; ``ends`` is that after a run."""
    before, after = np.empty((len(code), 4), dtype=np.int64), np.empty((len(code), 4), dtype=np.int64)
    order = np.argsort(-count, kind="stable")
    start, count, now = start[order], count[order], ends[order].astype(np.int64)
    for back in range(1, int(count.max(initial=0)) + 1):
        live = int(np.searchsorted(-count, -back, "right"))
        rows = start[:live] + count[:live] - back
        after[rows] = now[:live]
        now[:live] = np.minimum(_inserted(_ways(code[rows], fault[rows], now[:live])[0].min(axis=2)), FAR)
        before[rows] = now[:live]
    return before, after


# ------------------------------------------------------------------ least audits -------------
class Paths:
    """The least audits of runs of rows, with the cost after each run. Nodes are row * 4 + state, and after
    them those after each run; after a conversation's last row turns may still be inserted."""

    def __init__(self, code: np.ndarray, fault: np.ndarray, start: np.ndarray, count: np.ndarray, ends: np.ndarray, last: np.ndarray):
        n, runs = len(code), len(start)
        before, after = costs_to_go(code, fault, start, count, ends)
        self.start, self.rows, self.cost = start, n, before
        follows = np.arange(1, n + 1)
        follows[start + count - 1] = n + np.arange(runs)  # the node after a run's last row
        go = np.concatenate([before, np.minimum(ends.astype(np.int64), FAR)])
        cost, to = np.full((n + runs, 4, 4), FAR), np.zeros((n + runs, 4, 4), dtype=np.int64)
        cost[:n], to[:n] = _ways(code, fault, after)
        to[:n] += 4 * follows[:, None, None]
        cost[:, :, INSERT], to[:, :, INSERT] = np.minimum(COSTS[INSERT] + go[:, ASKED], FAR), 4 * np.arange(n + runs)[:, None] + ASKED
        best = (cost == go[:, :, None]) & (go < FAR)[:, :, None]
        over = np.zeros(runs, dtype=bool) if not len(last) else ~last
        best[n:][over] = False  # what comes after the run is another chunk's
        best[n:, [0, 3]] = False  # accepted
        self._rank(best.reshape(-1, 4), to.reshape(-1, 4))

    def _rank(self, best: np.ndarray, to: np.ndarray) -> None:
        final = ~best.any(axis=1)
        here = np.arange(len(best))
        rank = np.where(best, 1 + np.arange(4), np.iinfo(np.int64).max)  # of the first letter
        lead = np.where(best, to, here[:, None])  # where that many letters lead
        while True:
            pick = rank.argmin(axis=1)
            node_rank = np.where(final, 0, rank[here, pick])
            node_lead = np.where(final, here, lead[here, pick])
            arcs = np.flatnonzero(best.ravel())
            if not len(arcs) or final[lead.ravel()[arcs]].all():
                break
            pair = rank.ravel()[arcs] * (node_rank.max() + 1) + node_rank[lead.ravel()[arcs]]
            rank = rank.copy()
            rank.ravel()[arcs] = 1 + np.unique(pair, return_inverse=True)[1]
            lead = lead.copy()
            lead.ravel()[arcs] = node_lead[lead.ravel()[arcs]]
        self.letter = np.where(final, -1, pick)
        self.pointers, self.steps = [np.where(final, here, to[here, pick])], (~final).astype(np.int64)
        while not final[self.pointers[-1]].all():
            p = self.pointers[-1]
            self.steps = self.steps + self.steps[p]
            self.pointers.append(p[p])
        p = self.pointers[-1]
        self.steps = self.steps + self.steps[p]

    def walk(self, state: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(run, node, letter) of every step of the runs' paths from the given states, in order."""
        first = 4 * self.start + state
        steps = self.steps[first]
        run = np.repeat(np.arange(len(first)), steps)
        t = np.arange(len(run)) - np.repeat(np.cumsum(steps) - steps, steps)
        node = first[run]
        for k, p in enumerate(self.pointers):
            odd = (t >> k & 1).astype(bool)
            node[odd] = p[node[odd]]
        return run, node, self.letter[node]

    def exits(self) -> np.ndarray:
        """The state after each run, by the state before it."""
        node = (4 * self.start[:, None] + np.arange(4)).ravel()
        for _ in range(2):  # the last pointer leads to the end from its own length on
            node = self.pointers[-1][node]
        return (node % 4).reshape(-1, 4)


# ------------------------------------------------------------------ on tables ----------------
def _runs(batches: Iterator[pa.RecordBatch], rows: int = 1 << 14, size: int = 1 << 23) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """(rows, start and count of the runs) of batches sorted by (conv, chunk); no run is parted."""
    held: list[pa.Table] = []

    def cut(t: pa.Table) -> np.ndarray:
        conv, chunk = t.column("conv").combine_chunks().dictionary_encode(), t.column("chunk").to_numpy()
        which = (conv.chunk(0) if isinstance(conv, pa.ChunkedArray) else conv).indices.to_numpy()
        return np.flatnonzero(np.concatenate([[True], (which[1:] != which[:-1]) | (chunk[1:] != chunk[:-1])]))

    for b in batches:
        if b.num_rows:
            held.append(pa.Table.from_batches([b]))
        if sum(t.num_rows for t in held) >= rows or sum(t.nbytes for t in held) >= size:
            t = pa.concat_tables(held).combine_chunks()
            start = cut(t)
            if len(start) > 1:
                yield t.slice(0, int(start[-1])), start[:-1], np.diff(start)
            held = [t.slice(int(start[-1]))]
    if held:
        t = pa.concat_tables(held).combine_chunks()
        start = cut(t)
        yield t, start, np.diff(np.append(start, t.num_rows))


def _column(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).to_numpy()


def edges(rows: DataFrame) -> DataFrame:
    """(conv, chunk, last, ends, state, code_before) of conversations of more than one chunk: whether the chunk
    is the last, the cost to go after it by state, the state of the least path before it and the code of
    the row before it."""
    narrow = rows.select("conv", "chunk", "pos", "code", "fault")
    wide = narrow.join(rows.filter(F.col("pos") == CHUNK).select("conv"), "conv", "left_semi")
    dealt = lambda d: d.repartition("conv", "chunk").sortWithinPartitions("conv", "chunk", "pos")
    lists = lambda m: pa.array([x.ravel().tolist() for x in m], pa.list_(pa.int64()))

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, start, count in _runs(batches):
            code, fault = _column(t, "code"), _column(t, "fault")
            m = np.stack([costs_to_go(code, fault, start, count, np.tile(np.where(np.arange(4) == q, 0, FAR), (len(start), 1)))[0][start] for q in range(4)], axis=2)
            some = t.take(start)
            yield pa.RecordBatch.from_arrays([some.column("conv").combine_chunks(), some.column("chunk").combine_chunks(), lists(m), pa.array(code[start + count - 1], pa.int64())],
                                             ["conv", "chunk", "m", "code"])

    def backwards(t: pa.Table) -> pa.Table:
        t = t.sort_by("chunk")
        m, ends = [np.array(x, dtype=np.int64).reshape(4, 4) for x in t.column("m").to_pylist()], [ENDS]
        for x in reversed(m[1:]):
            ends.append(np.minimum((x + ends[-1][None, :]).min(axis=1), FAR))
        last = np.arange(len(m)) == len(m) - 1
        before = [None, *t.column("code").to_pylist()[:-1]]
        return pa.table([t.column("conv"), t.column("chunk"), pa.array(last), lists(reversed(ends)), pa.array(before, pa.int64())], names=["conv", "chunk", "last", "ends", "code_before"])

    spans = dealt(wide).mapInArrow(matrices, "conv string, chunk long, m array<long>, code long")
    costs = stage(spans.groupBy("conv").applyInArrow(backwards, "conv string, chunk long, last boolean, ends array<long>, code_before long"), "repair-costs")  # a row a chunk

    def exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, start, count in _runs(batches):
            some = t.take(start)
            ends = np.array(some.column("ends").to_pylist(), dtype=np.int64).reshape(-1, 4)
            paths = Paths(_column(t, "code"), _column(t, "fault"), start, count, ends, np.zeros(len(start), dtype=bool))
            yield pa.RecordBatch.from_arrays([some.column("conv").combine_chunks(), some.column("chunk").combine_chunks(), lists(paths.exits())], ["conv", "chunk", "out"])

    def forwards(t: pa.Table) -> pa.Table:
        t = t.sort_by("chunk")
        state = [0]
        for x in t.column("out").to_pylist()[:-1]:
            state.append(x[state[-1]])
        return pa.table([t.column("conv"), t.column("chunk"), pa.array(state, pa.int64())], names=["conv", "chunk", "state"])

    through = dealt(wide.join(costs.select("conv", "chunk", "ends"), ["conv", "chunk"])).mapInArrow(exits, "conv string, chunk long, out array<long>")
    states = through.groupBy("conv").applyInArrow(forwards, "conv string, chunk long, state long")  # a row a chunk
    return stage(costs.join(states, ["conv", "chunk"]), "repair-edges")


EDITED = "conv string, pos long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired string"


def edited(rows: DataFrame) -> DataFrame:
    """(conv, pos, blank, duplicate, truncated, illegal, cost, audit, repaired) of ``judged`` rows: a row's part of
    the audit and the lines ``role:text`` that come of it, null where none do. Turns inserted before a
    row belong to it, those at the end to the last row; the cost stands at a conversation's first row."""
    legal = np.zeros((4, 4), dtype=bool)
    legal[[0, 1, 2], [1, 2, 1]] = True  # su, ua, au

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, start, count in _runs(batches):
            code, fault, n = _column(t, "code"), _column(t, "fault"), t.num_rows
            some = t.take(start).select(["last", "ends", "state", "code_before"]).to_pydict()
            ends = np.array([e or ENDS for e in some["ends"]], dtype=np.int64).reshape(-1, 4)
            last = np.array([x is not False for x in some["last"]])
            paths = Paths(code, fault, start, count, ends, last)
            before = np.concatenate([[3], code[:-1]])
            alone = np.zeros(n, dtype=bool)
            before[start] = [3 if c is None else c for c in some["code_before"]]
            alone[start] = [c is None for c in some["code_before"]]
            cost = np.zeros(n, dtype=np.int64)
            first = _column(t, "pos")[start] == 0
            cost[start[first]] = paths.cost[start[first], 0]
            audit, lines = [""] * n, [None] * n
            role, text = t.column("role").to_pylist(), t.column("text").to_pylist()
            which, node, letter = paths.walk(np.array([s or 0 for s in some["state"]], dtype=np.int64))
            tail = (start + count - 1)[which]
            at = np.where(node < 4 * n, node // 4, tail)
            asked = ASKED[node % 4] - 2
            for r, k, a in zip(at.tolist(), letter.tolist(), asked.tolist()):
                audit[r] += LETTERS[k]
                if k != DELETE:
                    line = f"{ROLES[a]}:" if k == INSERT else f"{role[r] if k == KEEP else ROLES[a]}:{text[r]}"
                    lines[r] = line if lines[r] is None else f"{lines[r]}\n{line}"
            yield pa.RecordBatch.from_arrays(
                [*(t.column(c).combine_chunks() for c in ("conv", "pos", "blank", "duplicate", "truncated")), pa.array((~legal[before, code] & ~alone).astype(np.int64)), pa.array(cost),
                 pa.array(audit, pa.string()), pa.array(lines, pa.string())], [x.split()[0] for x in EDITED.split(", ")])

    d = rows.join(broadcast_if_small(edges(rows)), ["conv", "chunk"], "left")
    d = d.select("conv", "chunk", "pos", "role", "text", "code", "fault", "blank", "duplicate", "truncated", "last", "ends", "state", "code_before")
    return stage(d.repartition("conv", "chunk").sortWithinPartitions("conv", "chunk", "pos").mapInArrow(run, EDITED), "repair-edited")


def digests(rows: DataFrame) -> DataFrame:
    """(conv, audit, repaired_sha256) of ``edited`` rows. A digest takes a conversation's lines one after
    another, so they stream through one task, which holds none of them but the audit's letters."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, audits, sums = [], [], []
        now, digest, letters, empty = None, None, [], True
        for b in batches:
            for conv, audit, lines in zip(b.column("conv").to_pylist(), b.column("audit").to_pylist(), b.column("repaired").to_pylist()):
                if conv != now:
                    if now is not None:
                        names.append(now), audits.append("".join(letters)), sums.append(digest.hexdigest())
                    now, digest, letters, empty = conv, hashlib.sha256(), [], True
                letters.append(audit)
                if lines is not None:
                    digest.update((lines if empty else "\n" + lines).encode("utf-8", "surrogatepass"))
                    empty = False
            if len(names) >= 1000:
                yield pa.RecordBatch.from_pydict({"conv": names, "audit": audits, "repaired_sha256": sums})
                names, audits, sums = [], [], []
        if now is not None:
            yield pa.RecordBatch.from_pydict({"conv": [*names, now], "audit": [*audits, "".join(letters)], "repaired_sha256": [*sums, digest.hexdigest()]})

    dealt = rows.select("conv", "pos", "audit", "repaired").repartition("conv").sortWithinPartitions("conv", "pos")
    return dealt.mapInArrow(run, "conv string, audit string, repaired_sha256 string")


def repair(rows: DataFrame, conv_ids: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), one row for each
    of ``conv_ids`` (conv_id); ``rows`` are their turns (conv_id, turn, role, text).

    A null id is a conversation; a null role or text is one space, a null turn comes first and makes no
    gap; rows of one turn are taken by role and text; repeated rows are duplicates. A conversation
    without rows has zeros, an empty audit and the digest of nothing. Other columns are ignored; an empty table
    gives no rows."""
    d = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    marked = stage(judged(d), "repair-judged")
    done = edited(marked)
    turns = marked.groupBy("conv", "turn").agg(F.count("*").alias("_n")).groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    sums = done.groupBy("conv").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")])
    out = conv_ids.select("conv_id").distinct().withColumn("conv", conv_key(F.col("conv_id")))
    for part in (turns, sums, digests(done)):
        out = out.join(part, "conv", "left")
    return out.select("conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                      F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op13_conversation_repair(spark, sf_dir: str) -> DataFrame:
    conversations = table(ready(spark), sf_dir, "conversations")
    return repair(damaged(conversations), conversations)


def _oracle() -> str:
    """The costs forwards: by state the least (cost, audit, lines) of a conversation's first rows."""
    least = lambda *s: "list_sort([" + ", ".join(s) + "], 'ASC', 'NULLS LAST')[1]"
    way = lambda s, cost, letter, line: f"CASE WHEN {s} IS NOT NULL THEN {{'c': {s}.c + {cost}, 'a': {s}.a || '{letter}', 't': {s}.t || {line}}} END"
    put = lambda s, role: way(s, 5, "I", f"chr(10) || '{role}:'")
    cut = lambda s: way(s, 2, "D", "''")
    keep = lambda s, i: f"CASE WHEN initial = '{i}' AND NOT lost THEN {way(s, '5 * truncated', 'K', 'chr(10) || role || chr(58) || text')} END"
    turn = lambda s, role: f"CASE WHEN NOT lost THEN {way(s, '1 + 5 * truncated', 'R', f'chr(10) || {chr(39)}{role}:{chr(39)} || text')} END"
    opened = f"s0, s1, {least('s2', put('s0', 'user'), put('s1', 'user'), put('s3', 'user'))} AS s2, {least('s3', put('s2', 'assistant'), put('i0', 'assistant'), put('i1', 'assistant'))} AS s3"
    step = f"""{cut('s0')} AS s0, {least(cut('s1'), keep('s0', 's'))} AS s1,
           {least(cut('s2'), *[keep(s, 'u') for s in ('s0', 's1', 's3')], *[turn(s, 'user') for s in ('s0', 's1', 's3')])} AS s2,
           {least(cut('s3'), keep('s2', 'a'), turn('s2', 'assistant'))} AS s3"""
    free = f"SELECT conv, k, {opened} FROM (SELECT *, {put('s0', 'user')} AS i0, {put('s1', 'user')} AS i1 FROM reached)"
    return f"""
WITH RECURSIVE crc AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
given AS (SELECT conv_id, coalesce(CAST(conv_id AS VARCHAR), ' ') AS name, CAST(turn AS BIGINT) AS turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
          list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: unicode(c)::BIGINT) AS b FROM conversations),
drawn AS (SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]))) % 20 AS d FROM given, crc),
hurt AS (SELECT conv_id, name, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE WHEN d = 3 THEN 2 ELSE 1 END)) AS copy FROM drawn WHERE d <> 0),
placed AS (SELECT *, coalesce('c' || CAST(conv_id AS VARCHAR), 'n') AS conv, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos FROM hurt),
seen AS (SELECT *, left(role, 1) AS initial, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank, row_number() OVER (PARTITION BY conv, role, text ORDER BY pos) > 1 AS again,
         lag(left(role, 1)) OVER (PARTITION BY conv ORDER BY pos) AS before FROM placed),
rows_ AS (SELECT *, blank OR again AS lost, CAST(NOT blank AND NOT again AND NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') AS BIGINT) AS truncated FROM seen),
told AS (SELECT conv, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate, sum(truncated) AS truncated,
         count(*) FILTER (pos > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM rows_ GROUP BY conv),
reached AS (SELECT conv, 0::BIGINT AS k, {{'c': 0::BIGINT, 'a': '', 't': ''}} AS s0, NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR) AS s1, NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR) AS s2,
            NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR) AS s3 FROM told
            UNION ALL SELECT f.conv, f.k + 1, {step} FROM ({free}) f JOIN rows_ r ON f.conv = r.conv AND r.pos = f.k + 1),
best AS (SELECT f.conv, {least('s0', 's3')} AS b FROM ({free}) f JOIN told ON f.conv = told.conv AND f.k = told.n)
SELECT g.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
       CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(b.c, 0) AS BIGINT) AS cost, coalesce(b.a, '') AS audit,
       sha256(substr(coalesce(b.t, ''), 2)) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) g LEFT JOIN told ON coalesce('c' || CAST(g.conv_id AS VARCHAR), 'n') = told.conv LEFT JOIN best ON told.conv = best.conv
"""


ORACLE_SQL = _oracle()
