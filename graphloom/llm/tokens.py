"""Token-ID output: fixed-size-list batches in Arrow IPC files, for zero-copy random access.

Documents go in ascending id order (ties by text hash, null ids last). One range exchange on
the id brings each task a run of documents; the task encodes them, packs the ids end to end
into rows of ``length`` ids, and writes one file: a stream of record batches of equal shape with
a footer, so batch k starts at a known offset and a memory map reads any row without a copy.
The last row of a file is padded; ``mask`` tells ids from padding. Beside each file lies an
index (document, first id, number of ids). A file gets its final name by one rename when it is
whole, so a task that runs again, or twice, does no harm.

Encoding caches pieces: the tokenizer's pattern always has a boundary before a space that
follows a non-space, and after a run of letters, so a text is cut there and each distinct piece
is encoded once a worker process. Texts with other letters, marks or spaces than ASCII's and
Latin ones are encoded whole.

Edge cases: a null text is an empty document of one end id; repeated rows are documents of
their own; an empty table gives an empty table; a document longer than a row spans rows.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import textkit as T
from .workspace import new_folder, stash


@dataclass(frozen=True)
class Layout:
    tokenizer: str
    length: int = 2048
    end_id: int = 0
    rows_per_batch: int = 256
    cache: int = 1_000_000


#: Texts with other letters, marks or spaces than these are encoded whole.
_OTHER = r"[^\x00-\x1b\x20-\x7f\x{00c0}-\x{00d6}\x{00d8}-\x{00f6}\x{00f8}-\x{024f}]"
_IS_SPACE, _IS_LETTER = np.zeros(256, bool), np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_IS_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


class Encoder:
    """Ids of texts, each distinct piece encoded once until the cache is full."""

    def __init__(self, path: str, most: int):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.clear()

    def clear(self) -> None:
        self.place: dict[int, int] = {}  # piece hash -> row of ``first``/``size``
        self.ids, self.n_ids = np.zeros(1 << 16, self.dtype), 0
        self.first, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)

    def learn(self, hashes: list[int], pieces: list[str]) -> None:
        for lo in range(0, len(pieces), 8192):
            for h, e in zip(hashes[lo : lo + 8192], self.tokenizer.encode_batch_fast(pieces[lo : lo + 8192], add_special_tokens=False)):
                k, n = len(self.place), len(e.ids)
                while self.n_ids + n > len(self.ids):
                    self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
                if k == len(self.first):
                    self.first, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.size))
                self.ids[self.n_ids : self.n_ids + n] = e.ids
                self.first[k], self.size[k], self.place[h] = self.n_ids, n, k
                self.n_ids += n

    def __call__(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, an end id after each text's, and the number of ids of each text."""
        data, at = T.raw(texts)
        n = len(at) - 1
        space, letter = _IS_SPACE[data], _IS_LETTER[data]
        begins = np.zeros(len(data), bool)
        begins[1:] = (space[1:] & ~space[:-1]) | (letter[:-1] & ~letter[1:])
        odd = pc.match_substring_regex(texts, _OTHER).fill_null(False).to_numpy(zero_copy_only=False)
        for s in self.special:
            odd |= pc.match_substring(texts, s).fill_null(False).to_numpy(zero_copy_only=False)
        for k in np.flatnonzero(odd):
            begins[at[k] : at[k + 1]] = False
        full = np.flatnonzero(np.diff(at))
        begins[at[full]] = True
        start = np.flatnonzero(begins)
        stop = np.append(start[1:], len(data))
        uniq, first, back = np.unique(T.span_hashes(data, start, stop), return_index=True, return_inverse=True)
        if len(self.place) > self.most:
            self.clear()
        keys = uniq.tolist()
        new = [k for k, h in enumerate(keys) if h not in self.place]
        raw = data.tobytes()
        self.learn([keys[k] for k in new], [raw[start[first[k]] : stop[first[k]]].decode() for k in new])
        piece = np.array([self.place[h] for h in keys], np.int64)[back] if keys else np.zeros(0, np.int64)
        size, begin = self.size[piece].astype(np.int64), self.first[piece]
        ends = np.searchsorted(start, at[1:])
        per_text = np.diff(np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], ends])]) + 1
        out = np.full(int(per_text.sum()), end_id, self.dtype)
        real = np.ones(len(out), bool)
        real[np.cumsum(per_text) - 1] = False
        out[real] = self.ids[np.repeat(begin - T.split_offsets(size)[:-1], size) + np.arange(size.sum())]
        return out, per_text


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, most: int) -> Encoder:
    """This process's encoder: what one task has learnt serves the next."""
    if (path, most) not in _ENCODERS:
        _ENCODERS[path, most] = Encoder(path, most)
    return _ENCODERS[path, most]


def _fs(path: str):
    return pafs.FileSystem.from_uri(path)


class _File:
    """An Arrow file under a name of its own until it is whole."""

    def __init__(self, path: str, schema: pa.Schema, attempt: str):
        self.fs, self.path = _fs(path)
        self.temp = f"{os.path.dirname(self.path)}/.{os.path.basename(self.path)}.{attempt}"
        self.fs.create_dir(os.path.dirname(self.path), recursive=True)
        self.out = self.fs.open_output_stream(self.temp)
        self.writer = pa.ipc.new_file(self.out, schema)

    def close(self) -> None:
        self.writer.close()
        self.out.close()
        self.fs.move(self.temp, self.path)


class _Packer:
    """Ids end to end in rows of equal length."""

    def __init__(self, path: str, layout: Layout, dtype, attempt: str):
        self.length, self.rows, self.dtype, self.held, self.n = layout.length, layout.rows_per_batch, np.dtype(dtype), [], 0
        item = pa.uint16() if dtype == np.uint16 else pa.uint32()
        self.schema = pa.schema([("input_ids", pa.list_(pa.field("item", item, False), self.length)), ("mask", pa.list_(pa.field("item", pa.bool_(), False), self.length))])
        self.file = _File(path, self.schema, attempt)

    def add(self, ids: bytes) -> None:
        self.held.append(ids)
        self.n += len(ids)
        if self.n >= self.rows * self.length * self.dtype.itemsize:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.held), self.dtype)
        full, block = len(ids) // self.length, self.length * self.rows
        for lo in range(0, full * self.length - block + 1, block):
            self._write(ids[lo : lo + block], block)
        done = len(ids) // block * block
        rest = ids[done:]
        if last and len(rest):
            size = -(-len(rest) // self.length) * self.length
            self._write(np.concatenate([rest, np.zeros(size - len(rest), self.dtype)]), len(rest))
            rest = rest[:0]
        self.held, self.n = [rest.tobytes()], rest.nbytes

    def _write(self, ids: np.ndarray, real: int) -> None:
        kinds = [f.type for f in self.schema]
        mask = np.arange(len(ids)) < real
        self.file.writer.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(a), type=k) for a, k in zip((ids, mask), kinds)], schema=self.schema))

    def close(self) -> None:
        self._flush(True)
        self.file.close()


_INDEX = pa.schema([("doc_id", pa.int64()), ("at", pa.int64()), ("n", pa.int64())])


def _write(folder: str, layout: Layout):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        name, attempt, packer, at = f"part-{context.partitionId():06d}", str(context.taskAttemptId()), None, 0
        for batch in batches:
            if packer is None:
                encode = encoder(layout.tokenizer, layout.cache)
                packer = _Packer(f"{folder}/{name}.arrow", layout, encode.dtype, attempt)
                index = _File(f"{folder}/{name}.index.arrow", _INDEX, attempt)
            for lo, hi in T.slices(batch["text"], 2 << 20):
                ids, sizes = encode(batch["text"].slice(lo, hi - lo), layout.end_id)
                packer.add(ids.tobytes())
                starts = at + T.split_offsets(sizes)
                index.writer.write_batch(pa.RecordBatch.from_arrays([batch["doc_id"].slice(lo, hi - lo).cast(pa.int64()), pa.array(starts[:-1]), pa.array(sizes)], schema=_INDEX))
                at = int(starts[-1])
        if packer is not None:
            packer.close()
            index.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([context.partitionId()], pa.int64()), "file": [f"{folder}/{name}.arrow"], "ids": pa.array([at], pa.int64())})

    return run


def write(docs: DataFrame, folder: str, layout: Layout, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write all documents under ``folder``; returns its files in order: ``part``, ``file``, ``ids``."""
    ordered = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    parts = ordered.repartitionByRange(F.col("doc_id").asc_nulls_last()).sortWithinPartitions(F.col("doc_id").asc_nulls_last(), F.xxhash64("text"))
    return stash(parts.mapInArrow(T.tidy(_write(folder, layout)), "part long, file string, ids long"), "token-files")


def open_rows(file: str):
    """Reader of one file: ``get_batch(k)`` is a view into the file where the file system can map it."""
    fs, path = _fs(file)
    return pa.ipc.open_file(pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path))


def _stream(file: str) -> Iterator[np.ndarray]:
    rows = open_rows(file)
    for k in range(rows.num_record_batches):
        batch = rows.get_batch(k)
        ids, mask = batch["input_ids"].flatten().to_numpy(zero_copy_only=True), batch["mask"].flatten().to_numpy(zero_copy_only=False)
        yield ids if mask.all() else ids[mask]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file, base in zip(batch["file"].to_pylist(), batch["base"].to_pylist()):
            index, stream, held = open_rows(file.removesuffix(".arrow") + ".index.arrow"), _stream(file), np.zeros(0, np.uint16)
            for k in range(index.num_record_batches):
                part = index.get_batch(k)
                sums = []
                for n in part["n"].to_pylist():
                    crc, left = 0, n
                    while left:
                        if not len(held):
                            held = next(stream)
                        ids, held = held[:left], held[left:]
                        crc, left = zlib.crc32(ids.astype("<u4").tobytes(), crc), left - len(ids)
                    sums.append(crc)
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(part["at"].to_numpy() + base), part["n"], pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read(files: DataFrame) -> DataFrame:
    """A row for each document in the files: its first id's place among all ids, its ids' number and checksum."""
    upto = F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # one row a file
    placed = files.withColumn("base", F.coalesce(upto, F.lit(0).cast("long")))
    # a task for a few files; the list of files is small, so its size asks for no more than that
    return placed.repartition(placed.sparkSession.sparkContext.defaultParallelism * 2, "file").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def default_layout() -> Layout:
    import public_tokenizers

    return Layout(public_tokenizers.path("byte_bpe_50k.json"))


def encode_all(docs: DataFrame) -> DataFrame:
    return read(write(docs, new_folder(docs.sparkSession, "tokens"), default_layout()))


def op8_token_output(spark, sf_dir: str) -> DataFrame:
    """Every document's place in the written files, read back from them."""
    return encode_all(spark.read.parquet(f"{sf_dir}/documents.parquet"))
