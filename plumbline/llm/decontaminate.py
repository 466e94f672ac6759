"""Benchmark decontamination by size-partitioned MinHash containment search.

A short item inside a long document has a tiny Jaccard similarity to the whole, so documents are cut
into windows made for each size class of items: class ``u`` holds items of ``u/2 + 1`` to ``u``
shingles, its windows hold ``2u`` shingles and start every ``u``, so a passage of at most ``u``
shingles lies whole in some window and has a similarity of at least about a fifth to it. Each window's
MinHash values are compared with those of the class's items, coordinate by coordinate, and every
candidate is confirmed by the exact share of the item's shingles found in the whole document.

Documents are read once and never shuffled. Items are the stated query set: they are dealt to blocks
of bounded size and sketched in the cluster, a file for each block in the shared folder, which tasks
read. The driver knows the number of blocks only; a larger benchmark means more blocks, not larger
ones, and an item longer than a block is a block's work.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read_file, remembers, scratch_dir, ship, turn_to, write_once
from .textkit import U, mix64, rolling, word_hashes

COORDINATES = 64
#: Shingles of all items in one block at most (8 bytes each, and as much again for sketches).
BLOCK_SHINGLES = 2_000_000
#: Shingles worked on at once; a power of two.
_STEP = 1 << 12
#: Bits of a value that a table of those seen among the items is indexed by, after spreading.
_BITS = 20
_SPREAD = U(0x9E3779B97F4A7C15)
#: ASCII marks become spaces and A-Z lower case, so changed punctuation hides nothing.
_PLAIN = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


def _words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_PLAIN).split()


def _shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    return rolling(hashes, min(k, len(hashes))) if len(hashes) else np.empty(0, U)


def _seeds(n: int) -> np.ndarray:
    """Odd multipliers: shingle hashes are mixed already, so a product orders them anew."""
    return mix64(np.arange(1, n + 1, dtype=U) * U(0xA24BAED4963EE407)) | U(1)


@dataclass
class Items:
    """A block of benchmark items: their shingle sets, and for each size class the sketches."""

    ids: list[int]
    sets: list[np.ndarray]
    classes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # u -> sorted values, their items, a bit for each leading part seen
    short: dict[int, dict[int, list[tuple[int, list[bytes]]]]]  # words of items of fewer than k, by their number and hash

    @classmethod
    def build(cls, rows: list[tuple[int, str | None]], k: int, coordinates: int) -> Items:
        ids, sets, short = [], [], {}
        for i, text in rows:
            words = _words(text.encode() if text else b"")
            s = np.unique(_shingles(word_hashes(words), k)) if words else ()
            if len(s):
                if len(words) < k:
                    short.setdefault(len(words), {}).setdefault(int(s[0]), []).append((len(ids), words))
                ids.append(i)
                sets.append(s)
        seeds, classes = _seeds(coordinates), {}
        for i, s in enumerate(sets):
            u = 1 << max(0, (len(s) - 1).bit_length())
            low = np.array([(s * x).min() for x in seeds])
            classes.setdefault(u, []).append((low, np.full(coordinates, i)))
        out = {}
        for u, parts in classes.items():
            v, i = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(v, kind="stable")
            seen = np.zeros(1 << _BITS, bool)
            seen[(v * _SPREAD) >> U(64 - _BITS)] = True
            out[u] = (v[order], i[order], seen)
        return cls(ids, sets, out, short)


def _halved(x: np.ndarray) -> np.ndarray:
    """Minima of neighbouring columns, two by two."""
    n = x.shape[1]
    half = np.minimum(x[:, : n - 1 : 2], x[:, 1::2])
    return half if n % 2 == 0 else np.concatenate([half, x[:, -1:]], axis=1)


def _sketches(h: np.ndarray, classes: list[int], seeds: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each class ``u``, the MinHash values of its windows for all coordinates.

    Windows hold ``2u`` shingles and start every ``u``; a document of at most ``2u`` is one window.
    Minima of small blocks give those of larger ones, so each coordinate hashes a shingle once.
    """
    parts, step = [], max(_STEP, classes[0])
    for i in range(0, len(h), step):
        x, have = h[None, i : i + step] * seeds[:, None], 1
        while have < classes[0]:
            x, have = _halved(x), have * 2
        parts.append(x)
    low, have = (parts[0] if len(parts) == 1 else np.concatenate(parts, axis=1)), classes[0]
    for u in classes:
        while have < u:
            low, have = _halved(low), have * 2
        yield u, (np.minimum(low[:, :-1], low[:, 1:]) if 2 * u < len(h) else low.min(axis=1)).ravel()


def found_in(h: np.ndarray, items: Items, seeds: np.ndarray, share: tuple[int, int]) -> list[tuple[int, int, int]]:
    """``(item index, item shingles, common shingles)`` of the items that a document contains."""
    if not len(h):
        return []
    candidates: set[int] = set()
    for u, x in _sketches(h, sorted(items.classes), seeds):
        values, index, seen = items.classes[u]
        x = x[seen[(x * _SPREAD) >> U(64 - _BITS)]]  # most values are no item's; the rest is looked up
        lo, hi = np.searchsorted(values, x, "left"), np.searchsorted(values, x, "right")
        for a, b in zip(lo[lo < hi].tolist(), hi[lo < hi].tolist(), strict=True):
            candidates.update(index[a:b].tolist())
    if not candidates:
        return []
    own = np.unique(h)
    out = []
    for i in sorted(candidates):
        s = items.sets[i]
        at = np.minimum(np.searchsorted(own, s), len(own) - 1)
        both = int((own[at] == s).sum())
        if share[1] * both >= share[0] * len(s):
            out.append((i, len(s), both))
    return out


def found_in_text(text: bytes | None, k: int, items: Items, seeds: np.ndarray, share: tuple[int, int]) -> list[tuple[int, int, int]]:
    """:func:`found_in` for a text; items of fewer than ``k`` words are compared with all its runs of as many words."""
    words = _words(text)
    if not words:
        return []
    hashes = word_hashes(words)
    out = found_in(_shingles(hashes, k), items, seeds, share)
    if len(words) >= k:
        known = {i for i, _, _ in out}
        for n, wanted in items.short.items():
            runs = rolling(hashes, n)
            for p in np.flatnonzero(np.isin(runs, np.fromiter(wanted, U, len(wanted)))).tolist():
                known.update(i for i, own in wanted[int(runs[p])] if words[p : p + n] == own)
        out += [(i, 1, 1) for i in sorted(known - {x[0] for x in out})]
    return out


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str, k: int, coordinates: int, block_shingles: int) -> Blocks:
    """Sketches items where they are; blocks of about ``block_shingles``, by the hash of id and text."""
    spark = benchmark.sparkSession
    root = scratch_dir(spark)
    rows = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).where("i IS NOT NULL")
    words = rows.agg(F.sum(F.size(F.split("t", r"[^\w]+")).cast("long")).alias("n")).first()["n"] or 0
    n = max(1, -(-words // block_shingles))

    def build(key: tuple, group: pa.Table) -> pa.Table:
        items = Items.build(list(zip(group.column("i").to_pylist(), group.column("t").to_pylist(), strict=True)), k, coordinates)
        write_once(root, f"items-{key[0].as_py()}", pickle.dumps(items))
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32())})

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("i", "t"), F.lit(n)).cast("int"))
    return Blocks(root, sorted(r.block for r in dealt.groupBy("block").applyInArrow(build, "block int").collect()))


@dataclass(frozen=True)
class Blocks:
    """Files of sketched items; a worker keeps a few of them in memory."""

    root: str
    numbers: list[int]

    def __iter__(self) -> Iterator[Items]:
        return (_read_items(self.root, k) for k in self.numbers)


@lru_cache(maxsize=2)
def _read_items(root: str, block: int) -> Items:
    return pickle.loads(read_file(root, f"items-{block}"))  # noqa: S301  written by item_blocks


remembers(_read_items.cache_clear)


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, item_col: str = "item_id", item_text: str = "text",
    shingle_words: int = 5, share: tuple[int, int] = (80, 100), coordinates: int = COORDINATES, block_shingles: int = BLOCK_SHINGLES,
) -> DataFrame:
    """Pairs ``doc_id, item_id, item_shingles, found, containment`` of documents that contain an item.

    Words are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased; a set is the
    distinct five-word shingles of the whole text, or the whole word sequence where there are fewer. An
    item of fewer words is also looked for, word for word, anywhere in a text of five or more. A pair counts when the document holds at least ``share`` of the item's shingles. Null and empty
    texts contain nothing and are found nowhere; null item ids are skipped; a null ``doc_id`` is
    kept. Rows that repeat an id give their pairs each, repeated items too. Extra columns are not
    read; an empty table on either side gives no rows.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = f"doc_id {dict(docs.dtypes)[id_col]}, item_id long, item_shingles long, found long"

    blocks = item_blocks(benchmark, item_col, item_text, shingle_words, coordinates, block_shingles)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to("decontaminate")
        seeds = _seeds(coordinates)
        for b in batches:
            texts = pc.cast(b.column("text"), pa.binary()).to_pylist()
            for items in blocks:
                hits = [(r, items.ids[i], n, both) for r, t in enumerate(texts) for i, n, both in found_in_text(t, shingle_words, items, seeds, share)]
                at, ids, n, both = (list(x) for x in zip(*hits, strict=True)) if hits else ([], [], [], [])
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(at, pa.int64())), *(pa.array(x, pa.int64()) for x in (ids, n, both))], ["doc_id", "item_id", "item_shingles", "found"])

    pairs = rows.mapInArrow(search, out) if blocks.numbers else docs.sparkSession.createDataFrame([], out)
    return pairs.withColumn("containment", F.col("found") / F.col("item_shingles"))


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", *, item_col: str = "item_id", item_text: str = "text",
    shingle_words: int = 5, share: tuple[int, int] = (80, 100), coordinates: int = COORDINATES, block_shingles: int = BLOCK_SHINGLES,
) -> DataFrame:
    """``docs`` with all its columns, without the rows whose text contains a benchmark item.

    Nulls, empty and long texts, ties, repeats and empty tables count as in :func:`contaminated`: a
    null or empty text stays, repeated rows get one answer each, without items all rows stay. Columns
    may have any name. Rows are judged where they are read, so no text is shuffled.
    """
    ship(docs.sparkSession)
    at = docs.columns.index(text_col)

    blocks = item_blocks(benchmark, item_col, item_text, shingle_words, coordinates, block_shingles)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to("decontaminate")
        seeds = _seeds(coordinates)
        for b in batches:
            texts = pc.cast(b.column(at), pa.binary()).to_pylist()
            clean = np.ones(len(texts), bool)
            for items in blocks:
                for r in np.flatnonzero(clean).tolist():
                    clean[r] = not found_in_text(texts[r], shingle_words, items, seeds, share)
            yield b.filter(pa.array(clean))

    return docs.mapInArrow(keep, docs.schema) if blocks.numbers else docs
