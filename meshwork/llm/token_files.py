"""Token ids in Arrow files of fixed-size-list batches.

Documents are range-partitioned by (doc_id, hash of the text); each partition becomes one shard: ``shard-NNNNN.tokens.arrow`` (Arrow IPC file; the
columns input_ids, a fixed-size list of 16- or 32-bit unsigned ids, and mask, a fixed-size list of bits that are 1 for ids and 0 for padding) and
``shard-NNNNN.index.arrow`` (doc_id, start in the shard, n_tokens).  A shard's ids are one stream cut into equal sequences;
only its last sequence is padded, which its mask shows.  Memory-mapped, a sequence is read at random without copying; its mask is unpacked to one boolean for each id.

A file is written under a temporary name and then moved, and its content depends on its rows only, so a task that
runs again after a lost executor replaces it by the same.

Defined cases: null text is empty and has the end id only; a null doc_id comes first; rows that repeat a doc_id are ordered by
the hash of their text, and equal rows as they were read; a text of any length is encoded whole; other columns, whatever their names, don't matter; an empty table gives no file.
"""
from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import tokenizer
from .util import Scratch, slices, slim

SEQUENCE = 2048
_INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def _open(uri: str):
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class ShardWriter:
    """Writes one shard of sequences; holds at most a batch of them."""

    def __init__(self, root: str, shard: int, size: int, length: int = SEQUENCE, batch: int = 256):
        self.fs, folder = _open(root)
        self.fs.create_dir(folder, recursive=True)
        self.names = [f"{folder}/shard-{shard:05d}.{kind}.arrow" for kind in ("tokens", "index")]
        self.temp = [f"{folder}/.{uuid.uuid4().hex}.{kind}" for kind in ("tokens", "index")]
        self.dtype, self.length, self.batch = np.uint16 if size <= 1 << 16 else np.uint32, length, batch
        schema = pa.schema([("input_ids", pa.list_(pa.from_numpy_dtype(self.dtype), length)), ("mask", pa.list_(pa.bool_(), length))])
        self.sinks = [self.fs.open_output_stream(t) for t in self.temp]
        self.writers = [pa.ipc.new_file(self.sinks[0], schema), pa.ipc.new_file(self.sinks[1], _INDEX)]
        self.schema, self.held, self.n_held, self.at = schema, [], 0, 0

    def add(self, doc_ids: list, ids: list[np.ndarray]) -> list[int]:
        """Appends documents; returns their starts."""
        starts = []
        for x in ids:
            starts.append(self.at)
            self.at += len(x)
            self.held.append(x.astype(self.dtype))
            self.n_held += len(x)
        self.writers[1].write_batch(pa.record_batch([pa.array(doc_ids, pa.int64()), pa.array(starts, pa.int64()), pa.array([len(x) for x in ids], pa.int64())], schema=_INDEX))
        if self.n_held >= self.batch * self.length:
            self._flush(False)
        return starts

    def _flush(self, last: bool) -> None:
        flat = np.concatenate(self.held) if self.held else np.zeros(0, self.dtype)
        step = self.batch * self.length
        unit = self.length if last else step  # every batch but the last is full
        n = len(flat) // unit * unit
        rest = flat[n:]
        mask = np.ones(n, bool)
        if last and len(rest):
            flat = np.concatenate([flat, np.zeros(self.length - len(rest), self.dtype)])
            n += self.length
            mask = np.arange(n) < n - self.length + len(rest)
            rest = rest[:0]
        for a in range(0, n, step):
            b = min(n, a + step)
            cols = [pa.FixedSizeListArray.from_arrays(pa.array(x[a:b]), self.length) for x in (flat, mask)]
            self.writers[0].write_batch(pa.record_batch(cols, schema=self.schema))
        self.held, self.n_held = [rest], len(rest)

    def close(self) -> None:
        self._flush(True)
        for w, s, t, name in zip(self.writers, self.sinks, self.temp, self.names, strict=True):
            w.close()
            s.close()
            self.fs.move(t, name)


class ShardReader:
    """Random access to the sequences and documents of one shard."""

    def __init__(self, root: str, shard: int):
        fs, folder = _open(root)
        names = [f"{folder}/shard-{shard:05d}.{kind}.arrow" for kind in ("tokens", "index")]
        local = isinstance(fs, pafs.LocalFileSystem)
        self.tokens, self.index = (pa.ipc.open_file(pa.memory_map(n) if local else fs.open_input_file(n)) for n in names)
        self.length = self.tokens.schema.field("input_ids").type.list_size
        self.batch = self.tokens.get_batch(0).num_rows if self.tokens.num_record_batches else 1

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of sequence i, a view of the file, and its mask."""
        b, k = self.tokens.get_batch(i // self.batch), i % self.batch
        ids, mask = (b.column(c).slice(k, 1).flatten() for c in range(2))
        return ids.to_numpy(zero_copy_only=True), mask.to_numpy(zero_copy_only=False)

    def span(self, start: int, n: int) -> np.ndarray:
        """n ids from position start of the shard's stream."""
        step, out = self.batch * self.length, []
        while n > 0:
            flat = self.tokens.get_batch(start // step).column(0).flatten().to_numpy(zero_copy_only=True)
            part = flat[start % step : start % step + n]
            out.append(part)
            start, n = start + len(part), n - len(part)
        return np.concatenate(out) if out else np.zeros(0, np.uint16)

    def documents(self):
        for i in range(self.index.num_record_batches):
            b = self.index.get_batch(i)
            yield from zip(*(b.column(c).to_pylist() for c in range(3)), strict=True)


def write_token_files(docs: DataFrame, root: str, vocab: str, kind: str, end_id: int, length: int = SEQUENCE) -> DataFrame:
    """Writes the shards of docs under root and returns shard, n_tokens, n_docs of each, in order (lazily: written as it is evaluated)."""

    def write(batches):
        tok, out, shard, n_docs = tokenizer(vocab, kind), None, TaskContext.get().partitionId(), 0
        end = np.array([end_id], np.uint32)
        for batch in batches:
            for part in slices(batch):
                if not part.num_rows:
                    continue
                out = out or ShardWriter(root, shard, tok.size, length)
                ids = [np.concatenate([np.frombuffer(x, "<u4"), end]) for x in tok.encode(part.column("text").to_pylist())]
                out.add(part.column("doc_id").to_pylist(), ids)
                n_docs += part.num_rows
        if out:
            out.close()
            yield pa.record_batch([pa.array([shard], pa.int64()), pa.array([out.at], pa.int64()), pa.array([n_docs], pa.int64())], names=["shard", "n_tokens", "n_docs"])

    order = ["doc_id", F.xxhash64("text"), "salt"]  # so the rows of one doc_id, or of none, are dealt too
    ordered = slim(docs).withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    return ordered.select("doc_id", "text").mapInArrow(write, "shard long, n_tokens long, n_docs long")


def read_token_files(spark, root: str, shards: list[tuple[int, int]]) -> DataFrame:
    """doc_id, start (ids before the document over all shards), n_tokens, ids_crc32, read back from the files.

    shards: (shard, n_tokens) of each file in order; one pair for each partition that was written, so it grows with the number of files alone.
    """
    base, rows = 0, []
    for shard, n in sorted(shards):
        rows.append((shard, base))
        base += n
    todo = spark.createDataFrame(rows, "shard long, base long").repartition(max(1, len(rows)))

    def read(batches):
        for batch in batches:
            for shard, base in zip(batch.column("shard").to_pylist(), batch.column("base").to_pylist(), strict=True):
                reader, out = ShardReader(root, shard), []
                for doc_id, start, n in reader.documents():
                    out.append((doc_id, base + start, n, zlib.crc32(reader.span(start, n).astype("<u4").tobytes())))
                    if len(out) == 4096:
                        yield _rows(out)
                        out = []
                yield _rows(out)

    return todo.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(out: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
    return pa.record_batch([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def query(spark, sf_dir: str) -> DataFrame:
    from .util import table

    scratch = Scratch(spark, "token-files")
    shards = write_token_files(table(spark, sf_dir, "documents"), scratch.path("files"), "byte_bpe_50k.json", "byte", 0)
    shards = scratch.write(shards, "shards")
    return read_token_files(spark, scratch.path("files"), [(r.shard, r.n_tokens) for r in shards.collect()])
