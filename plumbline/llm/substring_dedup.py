"""Repeated passages: confirm recurring windows, compile automata shard by shard, stream all documents.

Documents are read once into packs of a few megabytes, compressed word numbers with the pack's own
words, in the shared folder; after that only hashes and passages move.

1. Every window of ``window`` words owns an anchor, the phrase of ``phrase`` words in it with the
   least hash. Anchors of all packs are counted; those seen in two documents go back to their packs.
2. Windows that own such an anchor are counted; one that starts in two documents recurs, and the
   smallest of them owns it. Each pack that holds it in a later document asks the owner's pack.
3. The owner's pack answers with words: runs of windows asked for by one pack are one passage.
4. A pack compiles its passages into one Aho-Corasick automaton (a phrase in every window of each),
   streams its documents through it, and compares document and passage word by word where it stops.
   Places come from the automata and the words alone; hashes have only chosen the passages.

A pack's passages are no longer than what recurs in it, so every automaton is bounded, and a
document meets one automaton at any size of the corpus.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bundle, materialise, n_partitions, read_file, scratch_dir, ship, sized, unbundle, write_once
from .textkit import U, member, rolling, sliding_min, word_hashes

SHARD_BYTES = 4 << 20
#: Packs of one task at most, in the mean.
PACKS_A_TASK = 32
#: An anchor in more packs than this has its windows counted by key and joined back, not gathered by key.
HOT_PACKS = 10_000
#: Windows that one task cuts from a pack for others.
REQUESTS = 1_000_000
#: Words compared at once.
_COMPARED = 1 << 22


def _planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes()


class Pack:
    """Documents as numbers of the pack's distinct words."""

    def __init__(self, ids: np.ndarray, null: np.ndarray, counts: np.ndarray, digests: bytes, codes: np.ndarray, words: list[bytes]):
        self.ids, self.null, self.counts, self.digests, self.codes, self.words = ids, null, counts, digests, codes, words
        self.ends = np.cumsum(counts)
        self.starts = self.ends - counts
        self.doc = np.repeat(np.arange(len(ids), dtype=np.int32), counts)

    @classmethod
    def build(cls, ids: list[int | None], texts: list[bytes | None]) -> Pack:
        known: defaultdict = defaultdict()
        known.default_factory = known.__len__
        codes, counts, digests = [], [], []
        for t in texts:
            words = (t or b"").split()
            codes.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
            counts.append(len(words))
            digests.append(hashlib.sha256(b" ".join(words)).digest())
        null = np.array([i is None for i in ids], bool)
        return cls(np.array([i or 0 for i in ids], np.int64), null, np.array(counts, np.int64), b"".join(digests), np.concatenate(codes or [np.empty(0, np.int32)]), list(known))

    def to_bytes(self) -> bytes:
        return bundle([self.ids.astype("<i8").tobytes(), self.null.astype(np.uint8).tobytes(), self.counts.astype("<i8").tobytes(), self.digests, _planes(self.codes), b" ".join(self.words)])

    @classmethod
    def load(cls, root: str, key: int) -> Pack:
        ids, null, counts, digests, codes, words = unbundle(read_file(root, _file(key)), 6)
        codes = np.ascontiguousarray(np.frombuffer(codes, np.uint8).reshape(4, -1).T).view("<i4").reshape(-1)
        return cls(np.frombuffer(ids, "<i8"), np.frombuffer(null, np.uint8).astype(bool), np.frombuffer(counts, "<i8"), digests, codes, words.split(b" ") if words else [])

    def windows(self, window: int) -> np.ndarray:
        """Where windows start: inside one document, which has an id."""
        n = len(self.codes) - window + 1
        if n <= 0:
            return np.empty(0, np.int64)
        return np.flatnonzero((self.doc[:n] == self.doc[window - 1 :]) & ~self.null[self.doc[:n]])

    def hashes(self) -> np.ndarray:
        return word_hashes(self.words)[self.codes] if len(self.codes) else np.empty(0, U)


def _file(key: int) -> str:
    return f"pack-{key & (1 << 64) - 1:016x}"


def _least_most(h: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes with their smallest and largest document."""
    if not len(h):
        e = np.empty(0, np.int64)
        return e, e, e
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])])
    h, d = h[new], d[new]
    order = np.lexsort((d, h))
    h, d = h[order], d[order]
    starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    return h[starts].view(np.int64), d[starts], d[np.concatenate([starts[1:], [len(h)]]) - 1]


def _anchors(w: np.ndarray, at: np.ndarray, window: int, phrase: int) -> np.ndarray:
    """The anchor of each window that starts at one of ``at``."""
    return sliding_min(rolling(w, phrase), window - phrase + 1)[at] if len(at) else np.empty(0, U)


def _pack_pass(root: str, window: int, phrase: int, shard_bytes: int) -> Callable:
    """Writes packs; a row for each pack, without a hash, and one for each of its anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int | None] = []
        texts: list[bytes | None] = []
        size = made = 0
        task = TaskContext.get().partitionId()

        def flush() -> pa.RecordBatch:
            pack = Pack.build(ids, texts)
            data = pack.to_bytes()
            # equal packs of different tasks stay apart; the rows below are written once, so a repeated task leaves no other key behind
            key = int.from_bytes(hashlib.sha256(data + f"{task} {made}".encode()).digest()[:8], "little", signed=True)
            write_once(root, _file(key), data)
            at = pack.windows(window)
            h, lo, hi = _least_most(_anchors(pack.hashes(), at, window, phrase), pack.ids[pack.doc[at]])
            none = pa.nulls(1, pa.int64())
            cols = [pa.array(np.full(len(h) + 1, key)), *(pa.concat_arrays([none, pa.array(x, pa.int64())]) for x in (h, lo, hi))]
            return pa.RecordBatch.from_arrays(cols, ["pack", "h", "lo", "hi"])

        for b in batches:
            for i, t in zip(b.column("doc_id").to_pylist(), pc.cast(b.column("text"), pa.binary()).to_pylist(), strict=True):
                ids.append(i)
                texts.append(t)
                size += len(t or b"") + 32
                if size >= shard_bytes:
                    yield flush()
                    ids, texts, size, made = [], [], 0, made + 1
        if ids:
            yield flush()

    return run


def _window_pass(root: str, window: int, phrase: int) -> Callable:
    """The windows of a pack that own one of the given anchors, with their smallest and largest document."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        pack = Pack.load(root, key[0].as_py())
        w, at = pack.hashes(), pack.windows(window)
        at = at[member(_anchors(w, at, window, phrase), np.sort(group.column("h").to_numpy().view(U)))]
        h, lo, hi = _least_most(rolling(w, window)[at], pack.ids[pack.doc[at]])
        return pa.table({"pack": np.full(len(h), key[0].as_py()), "h": h, "lo": lo, "hi": hi})

    return run


def _passage_pass(root: str, window: int) -> Callable:
    """Cuts what other packs ask for: ``pack`` (who asks), ``owner`` and the words of each run of windows."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        pack = Pack.load(root, key[0].as_py())
        asked, asker = group.column("h").to_numpy().view(U), group.column("pack").to_numpy()
        own = np.isin(pack.ids, np.unique(group.column("owner").to_numpy()))
        at = pack.windows(window)
        at = at[own[pack.doc[at]]]
        h = rolling(pack.hashes(), window)[at]
        # the owner is the smallest document with the window; its first place will do
        order = np.lexsort((at, pack.ids[pack.doc[at]], h))
        place = at[order][np.searchsorted(h[order], asked)]
        order = np.lexsort((place, asker))
        place, asker = place[order], asker[order]
        new = np.concatenate([[True], (place[1:] != place[:-1] + 1) | (asker[1:] != asker[:-1])])
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:], [len(place)]]) - 1
        words, codes = pack.words, pack.codes
        text = [b" ".join([words[c] for c in codes[a : b + window].tolist()]) for a, b in zip(place[first].tolist(), place[last].tolist(), strict=True)]
        return pa.table({"pack": pa.array(asker[first]), "owner": pa.array(pack.ids[pack.doc[place[first]]]), "passage": pa.array(text, pa.binary())})

    return run


class _Letters:
    """Word numbers as strings of few letters: a node of the automaton has few children to look through, and each digit has letters of its own, so no match can start inside a word."""

    def __init__(self, n_words: int):
        self.digits = 1
        while (250 // self.digits) ** self.digits < n_words:
            self.digits += 1
        self.base = 250 // self.digits

    def write(self, codes: np.ndarray) -> str:
        out = np.empty((len(codes), self.digits), np.uint8)
        for i in range(self.digits):
            out[:, i] = codes // self.base ** (self.digits - 1 - i) % self.base + i * self.base + 1
        return out.tobytes().decode("latin-1")


def _ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``start, start + 1, ...`` of each length, one after another."""
    return np.arange(int(lengths.sum())) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)


def locate(pack: Pack, passages: list[tuple[int, bytes]], window: int, phrase: int) -> np.ndarray:
    """Which words of the pack lie in a window of a passage whose owner has a smaller id."""
    import ahocorasick

    gone = np.zeros(len(pack.codes) + 1, np.int32)
    least: dict[bytes, int] = {}
    for owner, text in passages:
        least[text] = min(owner, least.get(text, owner))
    number = {w: i for i, w in enumerate(pack.words)}
    letters = _Letters(len(pack.words))
    auto = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    phrases: dict[str, int] = {}
    where: list[list[tuple[int, int]]] = []
    codes, sizes = [], []
    step = window - phrase + 1  # so that every window holds one whole phrase
    for k, text in enumerate(least):
        c = np.array([number.get(w, -1) for w in text.split(b" ")], np.int32)
        codes.append(c)
        sizes.append(len(c))
        for off in range(0, len(c) - phrase + 1, step):
            if c[off : off + phrase].min() >= 0:
                p = letters.write(c[off : off + phrase])
                n = phrases.setdefault(p, len(where))
                if n == len(where):
                    where.append([])
                    auto.add_word(p, n)
                where[n].append((k, off))
    if not phrases:
        return gone[:-1] > 0
    auto.make_automaton()
    hits = np.array(list(auto.iter(letters.write(pack.codes))), np.int64).reshape(-1, 2)
    if not len(hits):
        return gone[:-1] > 0
    place = (hits[:, 0] + 1) // letters.digits - phrase
    each = np.array([len(x) for x in where])
    flat = np.array([x for own in where for x in own], np.int64)
    pick = _ragged((np.cumsum(each) - each)[hits[:, 1]], each[hits[:, 1]])
    place = np.repeat(place, each[hits[:, 1]])
    # a passage laid over a document: the passage, the document, and where the passage would start
    over = np.unique(np.stack([flat[pick, 0], pack.doc[place].astype(np.int64), place - flat[pick, 1]], axis=1), axis=0)
    owners = np.array(list(least.values()), np.int64)
    over = over[(owners[over[:, 0]] < pack.ids[over[:, 1]]) & ~pack.null[over[:, 1]]]
    flat_codes, size = np.concatenate(codes), np.array(sizes, np.int64)
    base = np.cumsum(size) - size
    left = np.maximum(over[:, 2], pack.starts[over[:, 1]])
    length = np.minimum(over[:, 2] + size[over[:, 0]], pack.ends[over[:, 1]]) - left
    some = length >= window
    over, left, length = over[some], left[some], length[some]
    part = np.cumsum(length) // _COMPARED
    for p in np.unique(part):
        own = part == p
        doc_at = _ragged(left[own], length[own])
        same = pack.codes[doc_at] == flat_codes[_ragged(base[over[own, 0]] + left[own] - over[own, 2], length[own])]
        begins = np.zeros(len(same) + 1, bool)
        begins[np.cumsum(length[own]) - length[own]] = True
        same = np.concatenate([same, [False]])
        opens = np.flatnonzero(same & (begins | ~np.concatenate([[False], same[:-1]])))
        shut = np.flatnonzero(~same | begins)
        closes = shut[np.searchsorted(shut, opens, "right")]
        long = closes - opens >= window
        np.add.at(gone, doc_at[opens[long]], 1)
        np.add.at(gone, doc_at[closes[long] - 1] + 1, -1)
    return np.cumsum(gone[:-1]) > 0


def _remove_pass(root: str, window: int, phrase: int, with_text: bool) -> Callable:
    def run(key: tuple, group: pa.Table) -> pa.Table:
        pack = Pack.load(root, key[0].as_py())
        passages = [(o, p) for o, p in zip(group.column("owner").to_pylist(), group.column("passage").to_pylist(), strict=True) if p is not None]
        lost = locate(pack, passages, window, phrase) if passages else np.zeros(len(pack.codes), bool)
        upto = np.concatenate([[0], np.cumsum(lost)])
        removed = upto[pack.ends] - upto[pack.starts]
        digests = [pack.digests[32 * k : 32 * k + 32].hex() for k in range(len(pack.ids))]
        kept, spans = [], []
        for k in range(len(pack.ids)) if with_text else np.flatnonzero(removed).tolist():
            own = slice(pack.starts[k], pack.ends[k])
            text = b" ".join([pack.words[c] for c in pack.codes[own][~lost[own]].tolist()])
            digests[k] = hashlib.sha256(text).hexdigest()
            if with_text:
                edge = np.flatnonzero(np.diff(np.concatenate([[0], lost[own].astype(np.int8), [0]])))
                kept.append(text.decode())
                spans.append(edge.reshape(-1, 2).tolist())
        out = {"doc_id": pa.array(pack.ids, pa.int64(), mask=pack.null), "n_words": pa.array(pack.counts), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
        if with_text:
            out |= {"kept": pa.array(kept, pa.string()), "spans": pa.array(spans, pa.list_(pa.list_(pa.int64())))}
        return pa.table(out)

    return run


def _requests(windows: DataFrame, *, hot: bool) -> DataFrame:
    """``owned, owner, h, pack``: each pack asks the pack of a recurring window's smallest document for it."""
    least = F.min(F.struct("lo", "pack"))
    if hot:  # too many packs for one task: counted with partial sums, then joined back, which can be split
        windows = materialise(windows)
        owners = windows.groupBy("h").agg(least.alias("o"), F.max("hi").alias("z")).where("z > o.lo").select("h", "o")
        told = windows.join(materialise(owners), "h")
    else:
        told = windows.withColumn("o", least.over(Window.partitionBy("h")))
    return told.where("hi > o.lo").select(F.col("o.pack").alias("owned"), F.col("o.lo").alias("owner"), "h", "pack")


def substring_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, window: int = 50, phrase: int = 12, shard_bytes: int = SHARD_BYTES,
    hot_packs: int = HOT_PACKS, requests: int = REQUESTS, with_text: bool = True,
) -> DataFrame:
    """Removes each word covered by a ``window``-word window that also starts in a document with a smaller id.

    One row per input row: ``doc_id, n_words, n_removed, kept_sha256`` and, with ``with_text``,
    ``kept`` (words joined by one space) and ``spans`` (removed word ranges, end excluded). Words are
    runs without ASCII white space, unchanged; windows are judged on the input. A null or empty text
    has no words; long texts are read whole, and one longer than a pack is a pack of its own. Rows
    that repeat an id count as one document: they lose nothing to each other and the same to smaller
    ids. A null id is smaller than nothing: its row neither loses words nor takes any. ``id_col`` must
    hold integers; extra columns are not read; an empty table gives no rows. Only equal words are
    removed; a recurring window could be overlooked where another of a smaller document has the same
    64-bit hash.
    """
    spark = docs.sparkSession
    ship(spark)
    root = scratch_dir(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = "pack long, h long, lo long, hi long"
    packs = materialise(rows.mapInArrow(_pack_pass(root, window, phrase, shard_bytes), found))
    listed = packs.where("h IS NULL").select("pack")
    n = max(n_partitions(spark), -(-listed.count() // PACKS_A_TASK))
    by_pack = lambda df: df.repartition(n, "pack").groupBy("pack")  # noqa: E731  few bytes a pack: a given number of tasks, else they would be merged

    anchors = packs.where("h IS NOT NULL")
    shared = anchors.groupBy("h").agg(F.min("lo").alias("a"), F.max("hi").alias("z"), F.count(F.lit(1)).alias("c")).where("a < z")
    shared = materialise(shared.select("h", (F.col("c") > hot_packs).alias("hot")))
    wanted = materialise(anchors.select("pack", "h").join(shared, "h").select("pack", "h", "hot"))
    counted = lambda hot: _requests(by_pack(wanted.where(F.col("hot") == hot)).applyInArrow(_window_pass(root, window, phrase), found), hot=hot)
    asked = counted(False) if wanted.where("hot").isEmpty() else counted(False).union(counted(True))
    asked = materialise(asked)

    # what many packs ask one pack for is cut by several tasks, since each can read the pack
    many = asked.groupBy("owned").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > requests).select("owned", F.ceil(F.col("c") / requests).cast("int").alias("parts"))
    dealt = asked.join(sized(materialise(many)), "owned", "left").withColumn("part", F.pmod(F.xxhash64("pack"), F.coalesce("parts", F.lit(1))))
    cut = dealt.repartition(n, "owned", "part").groupBy("owned", "part").applyInArrow(_passage_pass(root, window), "pack long, owner long, passage binary")
    own = cut.union(listed.select("pack", F.lit(None).cast("long"), F.lit(None).cast("binary")))
    out = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string, spans array<array<long>>" * with_text
    return by_pack(own).applyInArrow(_remove_pass(root, window, phrase, with_text), out)
