"""Token ids on disk as compressed byte planes with a chunk index.

File format, one shard per range of ``doc_id`` (all integers little-endian)::

    magic  8 bytes  b"PLBITPL1"
    chunk*          for each of the 4 byte planes of a block of BLOCK_IDS ids: one zstandard frame
    index           zstandard frame of int64 rows: chunk offset, first id, number of ids, 4 plane sizes
    docs            zstandard frame of three int64 planes: doc_id, first id in the shard, number of ids
    nulls           zstandard frame of one byte per document: 1 where its id is null
    footer          5 x int64: index offset, docs offset, nulls offset, footer offset, number of ids; then the magic

A block is transposed so that equal-weight bytes of its ids lie together; the two high planes are
almost constant and shrink to nothing. A reader finds a chunk through the index without touching
the rest of the file.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import shared_encoder
from .common import filesystem, n_partitions, ship

MAGIC = b"PLBITPL1"
BLOCK_IDS = 1 << 16
PLANES = 4
#: Words and pieces that a worker remembers, each in two generations.
WORDS = 400_000


class _ShardWriter:
    def __init__(self, out, block_ids: int):
        self.out, self.block = out, block_ids
        self.comp = zstandard.ZstdCompressor(level=3)
        self.at = self.out.write(MAGIC)
        self.pending: list[np.ndarray] = []
        self.waiting = self.n_ids = 0
        self.index: list[tuple[int, ...]] = []
        self.docs: list[tuple[int, int, int]] = []
        self.nulls = bytearray()

    def _put(self, data: bytes) -> int:
        self.out.write(data)
        self.at += len(data)
        return len(data)

    def _chunk(self, ids: np.ndarray, first: int) -> None:
        at = self.at
        planes = np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, PLANES).T)
        self.index.append((at, first, len(ids), *(self._put(self.comp.compress(p.tobytes())) for p in planes)))

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id or 0, self.n_ids, len(ids)))
        self.nulls.append(doc_id is None)
        self.n_ids += len(ids)
        self.pending.append(ids)
        self.waiting += len(ids)
        if self.waiting >= self.block:
            self._drain(whole=False)

    def _drain(self, *, whole: bool) -> None:
        ids = np.concatenate(self.pending) if self.pending else np.empty(0, "<u4")
        first = self.n_ids - len(ids)
        end = len(ids) if whole else len(ids) // self.block * self.block
        for k in range(0, end, self.block):
            self._chunk(ids[k : min(k + self.block, end)], first + k)
        self.pending, self.waiting = [ids[end:]], len(ids) - end

    def close(self) -> None:
        self._drain(whole=True)
        marks = [self.at]
        self._put(self.comp.compress(np.array(self.index, "<i8").reshape(-1, 3 + PLANES).tobytes()))
        marks.append(self.at)
        self._put(self.comp.compress(np.array(self.docs, "<i8").reshape(-1, 3).T.tobytes()))
        marks.append(self.at)
        self._put(self.comp.compress(bytes(self.nulls)))
        marks += [self.at, self.n_ids]
        self._put(np.array(marks, "<i8").tobytes() + MAGIC)


class ShardReader:
    """Random access to one shard: ``ids(first, n)`` reads only the chunks that hold those ids."""

    def __init__(self, source):
        self.f = source
        size = source.size()
        source.seek(size - 5 * 8 - len(MAGIC))
        tail = source.read()
        if tail[-len(MAGIC) :] != MAGIC:
            raise ValueError("not a token shard, or cut off")
        index, docs, nulls, foot, self.n_ids = (int(x) for x in np.frombuffer(tail[: 5 * 8], "<i8"))
        self.dec = zstandard.ZstdDecompressor()
        self.index = np.frombuffer(self._at(index, docs - index), "<i8").reshape(-1, 3 + PLANES)
        self.doc_ids, self.starts, self.counts = np.frombuffer(self._at(docs, nulls - docs), "<i8").reshape(3, -1)
        self.nulls = np.frombuffer(self._at(nulls, foot - nulls), np.uint8)
        self._held: tuple[int, np.ndarray] = (-1, np.empty(0, "<u4"))

    def _at(self, offset: int, n: int) -> bytes:
        self.f.seek(offset)
        return self.dec.decompress(self.f.read(n))

    def _chunk(self, k: int) -> np.ndarray:
        if self._held[0] != k:
            at, _, n, *sizes = (int(x) for x in self.index[k])
            planes = np.empty((PLANES, n), np.uint8)
            for p, size in enumerate(sizes):
                planes[p] = np.frombuffer(self._at(at, size), np.uint8)
                at += size
            self._held = (k, np.ascontiguousarray(planes.T).view("<u4").reshape(-1))
        return self._held[1]

    def ids(self, first: int, n: int) -> np.ndarray:
        got, k = [], int(np.searchsorted(self.index[:, 1], first, "right")) - 1 if n else 0
        while n > 0:
            off = first - int(self.index[k, 1])
            part = self._chunk(k)[off : off + n]
            got.append(part)
            first, n, k = first + len(part), n - len(part), k + 1
        return np.concatenate(got) if got else np.empty(0, "<u4")


def _writer(path: str, tokenizer: str, end_id: int, block_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, out, name, shard, low = shared_encoder(tokenizer, WORDS), None, "", None, None
        fs, root = filesystem(path)
        end = np.array([end_id], "<u4")
        for b in batches:
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), enc.encode_many(b.column("text").to_pylist()), strict=True):
                if shard is None:
                    from pyspark import TaskContext

                    low = TaskContext.get().partitionId()
                    fs.create_dir(root, recursive=True)
                    name = f"{root}/.{low:08d}-{uuid.uuid4().hex}"
                    out = fs.open_output_stream(name)
                    shard = _ShardWriter(out, block_ids)
                shard.add(doc_id, np.concatenate([ids, end]))
        if shard is not None:
            shard.close()
            out.close()
            final = f"{root}/shard-{low:08d}.tok"
            fs.move(name, final)  # a second attempt of the task replaces the file with the same bytes
            yield pa.RecordBatch.from_arrays([pa.array([low]), pa.array([final.rsplit("/", 1)[1]]), pa.array([len(shard.docs)]), pa.array([shard.n_ids])], ["shard", "file", "n_docs", "n_ids"])

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", *, end_id: int = 2, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Encodes every whole text and writes the shards below ``path`` in ascending id order.

    Returns the shard index, one row per file: ``shard, file, n_docs, n_ids, first`` (ids in all
    shards before it). A null text counts as empty and gets the end id alone; null ids come first;
    rows that repeat an id follow each other, ordered by text; an empty table gives no shard. Extra
    columns are not read. ``path`` must be in storage that all executors share. A task keeps one
    block of ids, its word cache (bounded) and three integers per document. Files follow the size of the
    input: as many as shuffle partitions, and more from 256 MB of input a file on.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    dealt = rows.repartitionByRange(n_partitions(spark, docs), "doc_id").sortWithinPartitions("doc_id", "text")
    shards = dealt.mapInArrow(_writer(path, tokenizer, end_id, block_ids), "shard long, file string, n_docs long, n_ids long").collect()
    schema = T.StructType([T.StructField(n, t) for n, t in (("shard", T.LongType()), ("file", T.StringType()), ("n_docs", T.LongType()), ("n_ids", T.LongType()), ("first", T.LongType()))])
    first, out = 0, []
    for s in sorted(shards, key=lambda r: r.shard):  # one row per file, as many as partitions
        out.append((s.shard, s.file, s.n_docs, s.n_ids, first))
        first += s.n_ids
    return spark.createDataFrame(out, schema)


def _reader(path: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(path)
        for b in batches:
            for name, first in zip(b.column("file").to_pylist(), b.column("first").to_pylist(), strict=True):
                with fs.open_input_file(f"{root}/{name}") as f:
                    r = ShardReader(f)
                    for k in range(0, len(r.starts), 2048):
                        part = slice(k, k + 2048)
                        ids = [r.ids(int(s), int(n)) for s, n in zip(r.starts[part], r.counts[part], strict=True)]
                        cols = [
                            pa.array(r.doc_ids[part], pa.int64(), mask=r.nulls[part].astype(bool)), pa.array(r.starts[part] + first), pa.array(r.counts[part]),
                            pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
                        ]
                        yield pa.RecordBatch.from_arrays(cols + ([pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64()))] if with_ids else []), ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)

    return run


def read_tokens(spark: SparkSession, path: str, shards: DataFrame, *, with_ids: bool = False) -> DataFrame:
    """Documents read back from the shards: ``doc_id, start, n_tokens, ids_crc32`` and, if asked for, ``ids``.

    One row per row written, repeated ids and null ids included; no shard gives no rows. A file is one
    task's work, a few chunks of it in memory at a time.
    """
    ship(spark)
    n = max(1, shards.count())
    return shards.select("file", "first").repartition(n).mapInArrow(_reader(path, with_ids), "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)
