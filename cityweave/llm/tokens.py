"""Token ids in Arrow files of equal-length sequences.

A shard is an Arrow IPC file: record batches of ``ROWS`` rows, each row a fixed-size list of ids and
one of its mask, uncompressed, so row r lies in batch r // ROWS and is read from a memory map without
a copy. Beside it lies an Arrow file with the shard's documents and their numbers of ids. Shards are
ranges of doc_id in order; a shard's last row is padded, which its mask tells."""
from __future__ import annotations

import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs, ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.scale import stage_root
from .common import ready, stage, table

LENGTH = 2048  # ids in a sequence
ROWS = 64  # sequences in a record batch
END = 2
MEMO = 800_000  # words whose ids a worker remembers, about 200 MB; beyond that it starts anew
SPACES = [chr(c) for c in (9, 11, 12, 13, *range(28, 32), 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288)]
ODD = ["  ", "\n\n", " \n", "\n ", *SPACES]  # white space other than a lone space or line feed
MARKS = ",.;:!?"
_encoders: dict[str, Encoder] = {}


class Encoder:
    """Ids of texts with the tokenizers library. Its byte-level splitter always cuts before a lone
    space, around a lone line feed and between a letter or digit and the marks that end a word, so
    ids are remembered by word; texts with any other white space are encoded as a whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.kind = "H" if self.dtype.itemsize == 2 else "I"
        self.first, self.later = _Memo(self, ""), _Memo(self, " ")
        self.feed = self.whole("\n")

    def whole(self, text: str) -> bytes:
        return array(self.kind, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def ids(self, text: str) -> bytes:
        if not text or text[0] in " \n" or text[-1] in " \n" or any(x in text for x in ODD):
            return self.whole(text)
        lines = []
        for line in text.split("\n"):
            head, *rest = line.split(" ")
            lines.append(self.first[head] + b"".join(map(self.later.__getitem__, rest)))
        return self.feed.join(lines)


class _Memo(dict):
    def __init__(self, encoder: Encoder, before: str):
        super().__init__()
        self.encoder, self.before = encoder, before

    def __missing__(self, word: str) -> bytes:
        if len(self) >= MEMO:
            self.clear()
        core = word.rstrip(MARKS)
        if core and len(core) < len(word) and core[-1].isalnum():
            ids = self[core] + self.encoder.first[word[len(core):]]
        else:
            ids = self.encoder.whole(self.before + word)
        self[word] = ids
        return ids


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _schema(dtype: np.dtype, length: int) -> pa.Schema:
    return pa.schema([("input_ids", pa.list_(pa.from_numpy_dtype(dtype), length)), ("mask", pa.list_(pa.bool_(), length))])


class _Writer:
    """Sequences of a shard, in batches, as ids come in."""

    def __init__(self, sink, dtype: np.dtype, length: int):
        self.schema, self.length, self.dtype = _schema(dtype, length), length, dtype
        self.file = ipc.new_file(sink, self.schema)
        self.held, self.n = [], 0

    def add(self, ids: bytes) -> None:
        self.held.append(np.frombuffer(ids, dtype=self.dtype))
        self.n += len(self.held[-1])
        if self.n >= ROWS * self.length:
            flat = np.concatenate(self.held)
            full = len(flat) // (ROWS * self.length) * ROWS * self.length
            for at in range(0, full, ROWS * self.length):
                self._write(flat[at:at + ROWS * self.length], ROWS * self.length)
            self.held, self.n = [flat[full:]], len(flat) - full

    def _write(self, ids: np.ndarray, valid: int) -> None:
        mask = pa.array(np.arange(len(ids)) < valid)
        self.file.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(ids), self.length),
                                               pa.FixedSizeListArray.from_arrays(mask, self.length)], schema=self.schema))

    def close(self) -> None:
        if self.n:
            flat = np.concatenate(self.held)
            self._write(np.pad(flat, (0, -len(flat) % self.length)), len(flat))
        self.file.close()


def write(docs: DataFrame, tokenizer: str, root: str, length: int = LENGTH, end: int = END,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, append ``end`` to each document and write shards below the folder ``root``, in order
    of id (nulls first, then by text). Returns (shard, path, n_docs, n_ids).

    A null or empty text is its end id alone; repeated rows are written as often as they come; other
    columns are ignored; an empty table makes no shard. A shard is written under a name of the
    attempt and then renamed, so a repeated or lost task leaves one whole file."""
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    d = d.repartitionByRange("id", F.xxhash64("text")).sortWithinPartitions("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        store, folder = fs.FileSystem.from_uri(root)
        task = TaskContext.get()
        shard = task.partitionId()
        out = ids = None
        tail, names, counts, total = np.array([end], dtype=enc.dtype).tobytes(), [], [], 0
        path = f"{folder}/shard-{shard:06d}.arrow"
        tried = f"{path}.{task.taskAttemptId()}"
        for batch in batches:
            if out is None and batch.num_rows:
                store.create_dir(folder, recursive=True)
                out = store.open_output_stream(tried)
                ids = _Writer(out, enc.dtype, length)
            for text in batch.column("text").to_pylist():
                made = enc.ids(text) + tail
                ids.add(made)
                counts.append(len(made) // enc.dtype.itemsize)
            names.append(batch.column("id"))
        if out is None:
            return
        ids.close()
        out.close()
        total = int(np.sum(counts))
        with store.open_output_stream(f"{tried}.docs") as sink:
            index = pa.table([pa.chunked_array(names), pa.array(counts, pa.int64())], names=["id", "n_ids"])
            with ipc.new_file(sink, index.schema) as f:
                f.write_table(index, max_chunksize=1 << 16)
        store.move(f"{tried}.docs", f"{path}.docs")
        store.move(tried, path)
        yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [f"{root}/shard-{shard:06d}.arrow"], "n_docs": [len(counts)], "n_ids": [total]})

    return stage(d.mapInArrow(run, "shard long, path string, n_docs long, n_ids long"), "token-shards")


class Sequences:
    """Random access to a shard: ``seq[r]`` is (ids, mask) of row r, views of the mapped file."""

    def __init__(self, path: str):
        store, at = fs.FileSystem.from_uri(path)
        self.source = pa.memory_map(at) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(at)
        self.file = ipc.open_file(self.source)
        self.batches = self.file.num_record_batches

    def batch(self, i: int) -> tuple[pa.Array, pa.Array]:
        """(ids, mask) of batch i, flat."""
        b = self.file.get_batch(i)
        return b.column(0).flatten(), b.column(1).flatten()

    def __getitem__(self, row: int) -> tuple[np.ndarray, pa.Array]:
        b = self.file.get_batch(row // ROWS)
        return b.column(0)[row % ROWS].values.to_numpy(), b.column(1)[row % ROWS].values

    def __len__(self) -> int:
        if not self.batches:
            return 0
        return (self.batches - 1) * ROWS + self.file.get_batch(self.batches - 1).num_rows


def read(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the shards' files alone."""
    before = F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))  # a row a shard
    places = stage(shards.select("shard", "path", F.coalesce(before, F.lit(0)).alias("before")), "token-places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(b.column("path").to_pylist(), b.column("before").to_pylist()):
                yield from _documents(path, start)

    return places.repartitionByRange(max(places.count(), 1), "shard").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _documents(path: str, start: int) -> Iterator[pa.RecordBatch]:
    seq = Sequences(path)
    stream = (ids.to_numpy().astype("<u4")[np.asarray(mask)] for ids, mask in map(seq.batch, range(seq.batches)))
    held, at = next(stream, np.zeros(0, "<u4")), 0
    store, index = fs.FileSystem.from_uri(f"{path}.docs")
    with store.open_input_file(index) as f:
        docs = ipc.open_file(f)
        for i in range(docs.num_record_batches):
            part = docs.get_batch(i)
            counts = part.column("n_ids").to_numpy()
            sums = []
            for n in counts.tolist():
                crc = 0
                while n:
                    if at == len(held):
                        held, at = next(stream), 0
                    piece = held[at:at + n]
                    crc = zlib.crc32(piece.tobytes(), crc)
                    at, n = at + len(piece), n - len(piece)
                sums.append(crc)
            starts = start + np.concatenate([[0], np.cumsum(counts)[:-1]])
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(starts, pa.int64()), pa.array(counts), pa.array(sums, pa.int64())],
                                             ["doc_id", "start", "n_tokens", "ids_crc32"])
            start += int(counts.sum())


def op2_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers
    root = f"{stage_root(ready(spark))}/tokens-{uuid.uuid4().hex}"
    return read(write(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), root))
