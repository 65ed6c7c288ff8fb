"""SentencePiece ids with the bytes of the original text that each piece stands for.

A text is normalised through the model's compiled character map, the longest entry first, and each
normalised character keeps where in the original its entry began. Merges by score then make pieces, and
a piece's span is what lies between the beginnings of its first character and of the one after it."""
from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready, table

SPACE, LOST = "▁", "�"
MEMO_BYTES = 80 << 20  # of words whose pieces a worker remembers, by an estimate; beyond that it starts anew
SLICE_CHARS = 1 << 20  # about so many characters are worked on at once, one text at least
LONG = 64  # runs of more characters are merged one by one
NO_RANK = (1 << 31) - 1
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
_encoders: dict[str, Encoder] = {}


# ------------------------------------------------------------------ the model file ----------
def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message."""
    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            shift, at = shift + 7, at + 1
            if data[at - 1] < 128:
                return value, at

    i = 0
    while i < len(data):
        tag, i = varint(i)
        if tag & 7 == 0:
            value, i = varint(i)
        else:
            n, i = varint(i) if tag & 7 == 2 else (8 if tag & 7 == 1 else 4, i)
            value, i = data[i:i + n], i + n
        yield tag >> 3, value


class CharacterMap:
    """A compiled character map: a double-array trie over UTF-8 bytes, whose values are places in a
    block of zero-ended replacements. Without a map every character stands for itself."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4) if blob else ()
        self.strings = blob[4 + size:]
        starts = bytes(b for b in range(256) if self._step(0, b) is not None) if blob else b""
        #: characters that begin no entry
        self.plain = re.compile(b"(?:[^" + re.escape(starts) + b"])+") if starts else None

    @staticmethod
    def _offset(unit: int) -> int:
        return unit >> 10 << ((unit & 1 << 9) >> 6)

    def _step(self, node: int, byte: int) -> int | None:
        to = node ^ self._offset(self.units[node]) ^ byte
        return to if to < len(self.units) and self.units[to] & (1 << 31 | 255) == byte else None

    def longest(self, data: bytes, at: int) -> tuple[str, int] | None:
        """(replacement, bytes taken) of the longest entry that begins at ``at``."""
        node, found = 0, None
        for i in range(at, len(data)):
            to = self._step(node, data[i])
            if to is None:
                break
            node = to
            if self.units[node] >> 8 & 1:
                found = self.units[node ^ self._offset(self.units[node])] & 0x7FFFFFFF, i + 1 - at
        if found is None:
            return None
        return self.strings[found[0]:self.strings.index(b"\0", found[0])].decode(), found[1]


def _width(byte: int) -> int:
    return 1 if byte < 0xC0 else 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4


class Encoder:
    """A BPE model with byte fallback, read from its file."""

    def __init__(self, model: bytes):
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        scores, norm, trained = [], {}, {}
        for n, value in _fields(model):
            if n == 1:
                f = dict(_fields(value))
                self.pieces.append(f[1].decode())
                scores.append(struct.unpack("<f", f.get(2, b"\0\0\0\0"))[0])
                self.kinds.append(f.get(3, NORMAL))
            elif n in (2, 3):
                (trained if n == 2 else norm).update(_fields(value))
        if trained.get(3, 1) != 2 or not trained.get(35, 0) or trained.get(24, 0):
            raise ValueError("a BPE model with byte fallback and leading spaces is needed")
        if USER in self.kinds or UNUSED in self.kinds:
            raise ValueError("models with user-defined or unused pieces are not supported")
        self.map = CharacterMap(norm.get(2, b""))
        self.prefix, self.squeeze = bool(norm.get(3, 1)), bool(norm.get(4, 1))
        self.space = SPACE if norm.get(5, 1) else " "
        self.unknown_text = trained.get(44, " ⁇ ".encode()).decode()
        self.begin, self.end = trained.get(41, 1), trained.get(42, 2)
        self.bytes = {int(p[3:-1], 16): i for i, p in enumerate(self.pieces) if self.kinds[i] == BYTE}
        self.id = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] == NORMAL}
        self.score = {p: scores[i] for p, i in self.id.items()}
        inside = {p[i:i + 2] for p in self.id for i in range(len(p) - 1)}
        #: neighbours that some piece holds side by side; a text may be cut between any others
        self.inside = inside
        self.by_space = not any(b == self.space and a != self.space for a, b in inside)
        self.memo: dict[str, tuple[bytes, bytes]] = {}
        self.held = 0
        self.around = [struct.pack("<I", i) for i in (self.begin, self.end)]
        self._tables()
        self._pairs()

    # -------------------------------------------------------------- normalisation
    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text and, for each of its characters and for its end, where in the UTF-8 bytes
        of ``text`` what it stands for begins."""
        data = text.encode("utf-8", "surrogatepass")
        if not self.map.units and not self.squeeze:
            if not text:
                return "", np.zeros(1, dtype=np.int64)
            raw = np.frombuffer(data, dtype=np.uint8)
            at = np.concatenate([[0] * self.prefix, np.flatnonzero(raw & 0xC0 != 0x80), [len(data)]])
            return self.space * self.prefix + text.replace(" ", self.space), at
        out, at, i = [], [], 0

        def take(i: int) -> tuple[str, int]:
            found = self.map.longest(data, i) if self.map.units else None
            return found or (data[i:i + _width(data[i])].decode("utf-8", "replace"), _width(data[i]))

        if self.squeeze:
            while i < len(data):
                made, n = take(i)
                if made != " ":
                    break
                i += n
        if i == len(data):
            return "", np.zeros(1, dtype=np.int64)
        if self.prefix:
            out.append(self.space)
            at.append(i)
        spaced = self.squeeze
        while i < len(data):
            run = self.map.plain.match(data, i) if self.map.plain and data[i] != 32 else None
            if run and b" " not in run.group():
                made = run.group().decode("utf-8", "replace")
                out.append(made)
                widths = np.flatnonzero(np.frombuffer(run.group(), dtype=np.uint8) & 0xC0 != 0x80)
                at.extend((widths + i).tolist())
                i, spaced = run.end(), False
                continue
            made, n = take(i)
            if spaced:
                made = made.lstrip(" ")
            if made:
                out.append(made.replace(" ", self.space))
                at.extend([i] * len(made))
                spaced = made.endswith(" ")
            i += n
            spaced = spaced and self.squeeze
        made = "".join(out)
        if self.squeeze:
            short = made.rstrip(self.space)
            at = [*at[:len(short)], at[len(short)] if len(short) < len(made) else len(data)]
            return short, np.array(at, dtype=np.int64)
        return made, np.array([*at, len(data)], dtype=np.int64)

    # -------------------------------------------------------------- merges
    def _pairs(self) -> None:
        """What two neighbours merge to, as a hash table from both symbols to (rank of the score, piece). A
        symbol is a piece's id or, of a character without a piece, its code point above all ids."""
        rank = {s: i for i, s in enumerate(sorted(set(self.score.values()), reverse=True))}
        base = len(self.pieces)
        symbol = lambda x: self.id.get(x, base + ord(x) if len(x) == 1 else None)
        rows = [(symbol(p[:i]), symbol(p[i:]), rank[self.score[p]], n) for p, n in self.id.items() for i in range(1, len(p))]
        rows = np.array([r for r in rows if None not in r] or [(0, 0, NO_RANK, 0)], dtype=np.int64)
        keys = rows[:, 0] << 21 | rows[:, 1]
        self.bits = max(int(2 * len(keys)).bit_length(), 4)
        self.slot = np.full((1 << self.bits) + len(keys), -1, dtype=np.int64)
        self.rank, self.joined = np.full(len(self.slot), NO_RANK, dtype=np.int32), np.zeros(len(self.slot), dtype=np.int32)
        for key, at, r, n in zip(keys.tolist(), self._place(keys).tolist(), rows[:, 2].tolist(), rows[:, 3].tolist()):
            while self.slot[at] >= 0:
                at += 1
            self.slot[at], self.rank[at], self.joined[at] = key, r, n
        self.symbols = np.arange(base, base + 0x110000, dtype=np.int32)
        for p, n in self.id.items():
            if len(p) == 1:
                self.symbols[ord(p)] = n
        ends = np.array([[ord(x) for x in p] for p in self.inside] or np.zeros((0, 2)), dtype=np.int64)
        self.side_by_side = np.unique(ends[:, 0] << 21 | ends[:, 1])

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _merges(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, piece) of neighbours; the rank is ``NO_RANK`` where they merge to nothing."""
        keys = left.astype(np.int64) << 21 | right
        at = self._place(keys)
        open_ = np.flatnonzero((self.slot[at] != keys) & (self.slot[at] >= 0))
        while len(open_):
            at[open_] += 1
            now = self.slot[at[open_]]
            open_ = open_[(now != keys[open_]) & (now >= 0)]
        hit = self.slot[at] == keys
        return np.where(hit, self.rank[at], NO_RANK), self.joined[at]

    def _merge_long(self, symbols: np.ndarray) -> tuple[list[int], list[int]]:
        """(symbols, characters by symbol) of one long run, with a heap of the neighbours that merge."""
        n, base, score = len(symbols), len(self.pieces), self.score
        part: list[str | None] = [self.pieces[x] if x < base else chr(x - base) for x in symbols.tolist()]
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(-score[part[i] + part[i + 1]], i, 2) for i in range(n - 1) if part[i] + part[i + 1] in score]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = right[i]
            if part[i] is None or j >= n or len(part[i]) + len(part[j]) != size:
                continue
            part[i] += part[j]
            part[j] = None
            right[i] = right[j]
            if right[i] < n:
                left[right[i]] = i
            for x, y in ((i, right[i]), (left[i], i)):
                if x >= 0 and y < n and part[x] + part[y] in score:
                    heapq.heappush(heap, (-score[part[x] + part[y]], x, len(part[x]) + len(part[y])))
        kept = [p for p in part if p is not None]
        return [self.id.get(p, base + ord(p[0])) for p in kept], [len(p) for p in kept]

    def _merge(self, symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(symbols, characters by symbol, first character of each) of the runs that begin at ``starts``, after
        all merges. In a round every run joins its best-scored neighbours, of equal ones the leftmost."""
        n = len(symbols)
        sizes_of = np.diff(np.append(starts, n))
        done = []
        wide = sizes_of > LONG
        for s, m in zip(starts[wide].tolist(), sizes_of[wide].tolist()):
            sym, size = self._merge_long(symbols[s:s + m])
            done.append((np.array(sym, dtype=np.int32), np.array(size, dtype=np.int64), s + np.cumsum([0, *size[:-1]])))
        keep = np.repeat(~wide, sizes_of)
        sym, at = symbols[keep], np.flatnonzero(keep)
        size, run = np.ones(len(sym), dtype=np.int64), np.repeat(np.arange(len(starts)), sizes_of)[keep]
        rank, to = np.full(len(sym), NO_RANK, dtype=np.int32), np.zeros(len(sym), dtype=np.int32)
        if len(sym):
            pair = np.flatnonzero(run[:-1] == run[1:])
            rank[pair], to[pair] = self._merges(sym[pair], sym[pair + 1])
        while len(sym):
            head = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
            least = np.minimum.reduceat(rank, head)
            count = np.diff(np.append(head, len(sym)))
            live = np.repeat(least < NO_RANK, count)
            if not live.all():
                done.append((sym[~live], size[~live], at[~live]))
                sym, size, at, run, rank, to = (x[live] for x in (sym, size, at, run, rank, to))
                continue
            first = np.flatnonzero(rank == np.repeat(least, count))
            first = first[np.concatenate([[True], run[first[1:]] != run[first[:-1]]])]
            sym[first] = to[first]
            size[first] += size[first + 1]
            stay = np.ones(len(sym), dtype=bool)
            stay[first + 1] = False
            now = first - np.arange(len(first))  # a symbol is gone for each run before
            sym, size, at, run, rank, to = (x[stay] for x in (sym, size, at, run, rank, to))
            rank[now] = NO_RANK
            after = now[now + 1 < len(sym)]
            after = after[run[after] == run[after + 1]]
            before = now[now > 0]
            before = before[run[before] == run[before - 1]] - 1
            pair = np.concatenate([after, before])
            rank[pair], to[pair] = self._merges(sym[pair], sym[pair + 1])
        sym, size, at = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(at, kind="stable")
        return sym[order], size[order], at[order]

    def _learn(self, words: list[str]) -> None:
        """Remember (ids, characters by id) of words, as little-endian 32-bit integers. Of the bytes that
        stand for a character without a piece, the last has its character."""
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        edges = np.concatenate([[0], np.cumsum([len(w) for w in words])])
        cut = np.ones(len(chars), dtype=bool)
        keys = chars[:-1] << 21 | chars[1:]
        place = np.minimum(np.searchsorted(self.side_by_side, keys), max(len(self.side_by_side) - 1, 0))
        cut[1:] = self.side_by_side[place] != keys if len(self.side_by_side) else True
        cut[edges[:-1]] = True
        sym, size, at = self._merge(self.symbols[chars], np.flatnonzero(cut))
        lost = sym >= len(self.pieces)
        if lost.any():
            kinds, which = np.unique(sym[lost], return_inverse=True)
            raw = [chr(k - len(self.pieces)).encode("utf-8", "replace") for k in kinds.tolist()]
            spelt = np.array([[self.bytes[x] for x in r.ljust(4, b"\0")] for r in raw], dtype=np.int32)
            width = np.ones(len(sym), dtype=np.int64)
            width[lost] = np.array([len(r) for r in raw])[which]
            row = np.zeros(len(sym), dtype=np.int64)
            row[lost] = which
            from_ = np.repeat(np.arange(len(sym)), width)
            nth = np.arange(len(from_)) - np.repeat(np.cumsum(width) - width, width)
            sym, size, at = np.where(lost[from_], spelt[row[from_], nth], sym[from_]), np.where(nth + 1 == width[from_], size[from_], 0), at[from_]
        ids, sizes = sym.astype("<u4").tobytes(), size.astype("<u4").tobytes()
        ends = (4 * np.searchsorted(at, edges)).tolist()
        self.memo.update(zip(words, [(ids[a:b], sizes[a:b]) for a, b in zip(ends, ends[1:])]))
        self.held += 330 * len(words) + 12 * len(chars)

    def _words(self, made: str) -> list[str]:
        """Parts of a normalised text that no merge joins: each with the spaces before it."""
        if not made:
            return []
        if not self.by_space:
            return [made]
        head, *rest = made.split(self.space)
        if "" not in rest:
            return [head] * (head != "") + [self.space + w for w in rest]
        words, run = [head] if head else [], self.space
        for w in rest:
            if w:
                words.append(run + w)
                run = self.space
            else:
                run += self.space
        return words + [run[1:]] * (len(run) > 1)

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(ids, begin, end) of each text's pieces, with the model's begin and end ids around them; begin and
        end are byte offsets in the text's UTF-8, those of the two ids around are empty."""
        if self.held > MEMO_BYTES:
            self.memo.clear()
            self.held = 0
        plans, fresh = [], set()
        for text in texts:
            made, at = self.normalise(text)
            words = self._words(made)
            fresh.update(w for w in words if w not in self.memo)
            plans.append((words, at))
        if fresh:
            self._learn(list(fresh))
        out = []
        for words, at in plans:
            found = list(map(self.memo.__getitem__, words))
            ids = np.frombuffer(b"".join([self.around[0], *[f[0] for f in found], self.around[1]]), dtype="<u4")
            ends = np.cumsum(np.frombuffer(b"".join([f[1] for f in found]), dtype="<u4"), dtype=np.int64)
            edge = at[ends]
            out.append((ids, np.concatenate([[0], at[:1] if len(ends) else at[:0], edge[:-1], at[-1:]]), np.concatenate([[0], edge, at[-1:]])))
        return out

    # -------------------------------------------------------------- decoding
    def _tables(self) -> None:
        byte = {i: b for b, i in self.bytes.items()}
        self.spoken = [bytes([byte[i]]) if k == BYTE else b"" if k == CONTROL else self.unknown_text.encode() if k == UNKNOWN
                       else p.replace(SPACE, " ").encode() for i, (p, k) in enumerate(zip(self.pieces, self.kinds))]
        self.silent = np.array([k == CONTROL for k in self.kinds])

    def decode(self, ids: np.ndarray) -> bytes:
        """The UTF-8 text of ids: bytes in a row that are no UTF-8 become U+FFFD one by one, and the space
        that leads the first word is left out."""
        numbers = ids.tolist()
        out = b"".join(map(self.spoken.__getitem__, numbers))
        parted = len(numbers) > 2 and self.silent[ids[1:-1]].any()  # bytes on both sides of a silent id are no character
        first = next((i for i in numbers if self.kinds[i] != CONTROL), None)
        lead = 1 if first is not None and self.prefix | self.squeeze and self.pieces[first].startswith(SPACE) and self.kinds[first] == NORMAL else 0
        if self.squeeze and lead:
            lead = len(out) - len(out.lstrip(b" "))
        try:
            out.decode()
        except UnicodeDecodeError:
            parted = True
        return (b"".join(self._repaired(numbers)) if parted else out)[lead:]

    def _repaired(self, ids: list[int]) -> Iterator[bytes]:
        run = b""
        for i in ids:
            if self.kinds[i] == BYTE:
                run += self.spoken[i]
            else:
                yield _valid(run)
                yield self.spoken[i]
                run = b""
        yield _valid(run)


def _valid(run: bytes) -> bytes:
    out, i = [], 0
    while i < len(run):
        piece = run[i:i + _width(run[i])]
        try:
            piece.decode()
        except UnicodeDecodeError:
            piece = run[i:i + 1]
            out.append(LOST.encode())
        else:
            out.append(piece)
        i += len(piece)
    return b"".join(out)


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        with open(path, "rb") as f:
            _encoders[path] = Encoder(f.read())
    return _encoders[path]


# ------------------------------------------------------------------ on tables ----------------
PIECES = "id long, ids array<int>, begins array<int>, ends array<int>"


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, begins, ends), one row a row of ``docs``: the ids of its text between the begin and the
    end id, and the bytes of the original text that each stands for.

    Null and empty texts have the two ids around alone. Null ids and repeated rows stay as they are,
    every row is encoded for itself; other columns are ignored; an empty table gives no rows. A text is
    encoded whole, however long. ``model`` is a path that every executor can read."""
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model)
        for b in batches:
            texts = b.column("text").to_pylist()
            size = np.cumsum([len(t) for t in texts])
            first = 0
            while first < len(texts):
                last = max(first + 1, int(np.searchsorted(size, (size[first - 1] if first else 0) + SLICE_CHARS, "right")))
                held = enc.encode(texts[first:last])
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(h[0]) for h in held])]), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([h[c] for h in held]).astype(np.int32))) for c in range(3)]
                yield pa.RecordBatch.from_arrays([b.column("id").slice(first, len(held)), *lists], ["id", "ids", "begins", "ends"])
                first = last

    return d.mapInArrow(run, PIECES)


def digests(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of ``encode``'s rows, the texts decoded from their ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model)
        for b in batches:
            col = b.column("ids")
            flat, offs = col.values.to_numpy().astype("<u4"), col.offsets.to_numpy()
            rows = [flat[i:j] for i, j in zip(offs[:-1], offs[1:])]
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array([len(r) for r in rows], pa.int64()), pa.array([hashlib.sha256(r.tobytes()).hexdigest() for r in rows], pa.string()),
                 pa.array([hashlib.sha256(enc.decode(r)).hexdigest() for r in rows], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encoded.select("id", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op11_sentencepiece(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers
    model = public_tokenizers.path("piece_bpe_32k.model")
    return digests(encode(table(ready(spark), sf_dir, "documents"), model), model)
