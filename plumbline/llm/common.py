"""Helpers that the corpus operators share: tables, scratch space and shipping code to executors."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys of a few dozen bytes that a broadcast may hold; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Rows of an Arrow batch at most: rows of long texts lie in JVM and Python memory a batch at a time.
BATCH_ROWS = 2_000
#: What empties the memories of this Python worker, and the work it was last given.
_forget: list[Callable[[], object]] = []
_work = ""
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The whole parquet table ``name`` below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z and nothing else; null becomes the empty string."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def fresh(name: str, taken: list[str]) -> str:
    """``name``, with underscores before it until no column of ``taken`` is called so."""
    known = {c.lower() for c in taken}
    while name.lower() in known:
        name = f"_{name}"
    return name


def _scratch_root(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\[\]]*\])?", master):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all machines share; a local one loses data with the master {master}")
        base = os.path.join(tempfile.gettempdir(), "plumbline-scratch")
    return f"{base.rstrip('/')}/plumbline/{spark.sparkContext.applicationId}"


def scratch_dir(spark: SparkSession) -> str:
    """A new folder name of this application in the shared folder of ``spark.checkpoint.dir``.

    Only where that setting is missing on a single machine a local folder takes its place; a cluster
    without it is an error.
    """
    return f"{_scratch_root(spark)}/{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared scratch folder and reads it back, which cuts its lineage.

    The files outlive the executors that wrote them. They stay until :func:`clear_scratch`, since a
    lazy result may read them at any later time.
    """
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> None:
    """Deletes what :func:`materialise` and the writers of this application have left; other applications keep theirs."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_scratch_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def sized(table: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A written table of short keys, marked for broadcast only if its counted rows are at most ``most``."""
    return F.broadcast(table) if table.count() <= most else table


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """The Arrow file system and path of a URI or a plain path."""
    return fs.FileSystem.from_uri(uri) if ":/" in uri else (fs.LocalFileSystem(), uri)


def write_once(root: str, name: str, data: bytes) -> None:
    """Writes a file under another name and moves it, so readers see all of it, and a repeated task replaces it by the same bytes."""
    fs, top = filesystem(root)
    fs.create_dir(top, recursive=True)
    own = f"{top}/.{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(own) as f:
        f.write(data)
    fs.move(own, f"{top}/{name}")


def read_file(root: str, name: str) -> bytes:
    fs, top = filesystem(root)
    with fs.open_input_file(f"{top}/{name}") as f:
        return f.read()


def bundle(parts: list[bytes], level: int = 3) -> bytes:
    """Several byte strings, each compressed, after their sizes."""
    comp = zstandard.ZstdCompressor(level=level)
    done = [comp.compress(p) for p in parts]
    return np.array([len(p) for p in done], "<i8").tobytes() + b"".join(done)


def unbundle(data: bytes, n: int) -> list[bytes]:
    sizes = np.frombuffer(data[: 8 * n], "<i8")
    ends = np.cumsum(sizes) + 8 * n
    dec = zstandard.ZstdDecompressor()
    return [dec.decompress(data[e - s : e]) for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]


def remembers(forget: Callable[[], object]) -> None:
    """Names a function that empties a memory of this Python worker when it turns to other work."""
    _forget.append(forget)


def turn_to(work: str) -> None:
    """Where a task of some work begins: a worker that did other work before forgets it and gives free memory back.

    Spark keeps Python workers from one stage to the next, so memories of all stages would add up.
    """
    global _work
    if work == _work:
        return
    _work = work
    for forget in _forget:
        forget()
    give_back()


def give_back() -> None:
    """Gives what this process has freed back to the machine."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
        trim(0)


def ship(spark: SparkSession) -> None:
    """Gives executors this package once per context, so that workers can import it anywhere; bounds the session's Arrow batches to ``BATCH_ROWS``."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    sc = spark.sparkContext
    if getattr(sc, "_plumbline_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    name = os.path.join(tempfile.mkdtemp(), "plumbline_pkg.zip")
    with zipfile.ZipFile(name, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, str(f.relative_to(top.parent)))
    sc.addPyFile(name)
    sc._plumbline_shipped = True


def n_partitions(spark: SparkSession, sized_by: DataFrame | None = None, task_bytes: int = 256 << 20) -> int:
    """The session's shuffle partitions, or more where the optimiser's estimate of ``sized_by`` asks for tasks of ``task_bytes``."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if sized_by is None:
        return n
    estimate = int(sized_by._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(n, -(-estimate // task_bytes)) if estimate < 1 << 60 else n  # beyond: unknown
