"""Near duplicates by fast similarity sketches, banding and exact verification.

A sketch has ``t`` coordinates. In round ``i`` every shingle of a text is hashed to a bin and a
value; a bin takes the least value of the first round that reaches it. The first ``t`` rounds hash
to any bin, rounds ``t`` to ``2t - 1`` send all shingles to one bin each, so every coordinate fills,
and long texts fill all in a round or two. Equal coordinates estimate the Jaccard similarity with
the concentration of ``t`` samples without replacement.

Texts with one and the same shingle set form a class at once and only its first row goes on. Bands
of coordinates give buckets; a bucket's members are compared with a hub, not with each other. Where
a bucket still holds several components, its members are compared across components, by their
rarest shingles and so without missing a pair. Links inside a group of many copies thus take about
one comparison per member, and no link between components is left out.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, materialise, ship, sized, turn_to
from .textkit import U, mix64, shingle_set

ROWS_PER_BAND = 5
#: Pairs of one node, or texts of one shingle, that a task takes.
PART = 1000


def bands_for(share: float, rows: int = ROWS_PER_BAND, miss: float = 1e-6) -> int:
    """Bands so that a pair at the threshold shares none with a probability below ``miss``."""
    return math.ceil(math.log(miss) / math.log1p(-(share**rows)))


def sketch(shingles: np.ndarray, t: int) -> np.ndarray:
    """The ``t`` coordinates of a set of shingle hashes (at least one)."""
    out = np.full(t, np.iinfo(U).max, U)
    done, n = 0, len(shingles)
    while done < 2 * t:
        rounds = np.arange(done, min(2 * t, done + max(1, 4096 // n)), dtype=U)
        h = mix64(shingles[None, :] + mix64(rounds + U(1))[:, None])
        bins = np.where(rounds[:, None] < U(t), h % U(t), rounds[:, None] - U(t)).astype(np.int64)
        # a round is the high byte(s): an earlier one always wins; 2t < 2**16
        value = (rounds[:, None] << U(48)) | (h >> U(16))
        np.minimum.at(out, bins.ravel(), value.ravel())
        done += len(rounds)
        if out.max() < U(done) << U(48):
            break
    return out


def band_hashes(coords: np.ndarray, bands: int, rows: int) -> np.ndarray:
    h = mix64(np.arange(1, bands + 1, dtype=U))
    for column in coords[: bands * rows].reshape(bands, rows).T:
        h = mix64(h ^ column)
    return h.view(np.int64)


def _words(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()  # bytes: lowers A-Z only and splits at the six ASCII white spaces


def _sketcher(k: int, bands: int, rows: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to("near_dedup")
        for b in batches:
            n, sig, band = [], [], []
            for text in pc.cast(b.column("text"), pa.binary()).to_pylist():
                s = shingle_set(_words(text), k)
                n.append(len(s))
                sig.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                band.append(band_hashes(sketch(s, bands * rows), bands, rows) if len(s) else np.empty(0, np.int64))
            flat = np.concatenate(band) if band else np.empty(0, np.int64)
            lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(x) for x in band])]).astype(np.int32), pa.array(flat, pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), lists], ["doc_id", "th", "n", "sig", "bands"])

    return run


def _verifier(k: int, num: int, den: int) -> Callable:
    """Passes the pairs whose full shingle sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to("near_dedup")
        held: tuple[bytes | None, np.ndarray] = (None, np.empty(0, U))
        for b in batches:
            keep = []
            for left, right in zip(pc.cast(b.column("left_text"), pa.binary()).to_pylist(), pc.cast(b.column("right_text"), pa.binary()).to_pylist(), strict=True):
                if left != held[0]:
                    held = (left, shingle_set(_words(left), k))
                x, y = held[1], shingle_set(_words(right), k)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(den * both >= num * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def components(pairs: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, comp`` for every node of the edges ``a, b``: the smallest node reachable.

    Each round every node hears the least component next to it, the component takes the least that
    its members have heard, and pointers are followed one step further, so distances halve. A written
    table cuts the lineage of each round; the driver sees only the number of changes.
    """
    edges = materialise(pairs.select("a", "b").union(pairs.select(F.col("b"), F.col("a"))).where("a <> b").distinct())
    state = materialise(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("comp")))
    for _ in range(max_rounds):
        near = edges.join(state.select(F.col("node").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("near"))
        told = state.join(near, state["node"] == near["a"]).select("node", "comp", F.least("comp", "near").alias("low"))
        heard = told.groupBy("comp").agg(F.min("low").alias("down"))
        new = materialise(told.join(heard, "comp").select("node", F.col("comp").alias("old"), F.least("low", "down").alias("comp")))
        if new.where("old <> comp").isEmpty():
            return new.select("node", "comp")
        ahead = new.select(F.col("node").alias("comp"), F.col("comp").alias("next"))
        state = materialise(new.select("node", "comp").join(ahead, "comp").select("node", F.col("next").alias("comp")))
    raise RuntimeError(f"components have not settled in {max_rounds} rounds")


def _verified(pairs: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs that are similar enough; a node of many pairs has its text sent to several tasks, each with a part of them."""
    often = materialise(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("c")).where(f"c > {PART}").select("a", F.ceil(F.col("c") / PART).cast("int").alias("parts")))
    left = texts.select(F.col("rep").alias("a"), F.col("text").alias("left_text")).join(often, "a", "left")
    left = left.select("a", "left_text", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    right = texts.select(F.col("rep").alias("b"), F.col("text").alias("right_text"))
    dealt = materialise(pairs.join(often, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).cast("int").alias("part")))
    return dealt.join(right, "b").join(left, ["a", "part"]).select("a", "b", "left_text", "right_text").mapInArrow(_verifier(k, num, den), "a long, b long")


def _shingle_rows(k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to("near_dedup")
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held, strict=True)], ["s", "rep", "n"])

        size = 0
        for b in batches:
            for rep, text in zip(b.column("rep").to_pylist(), pc.cast(b.column("text"), pa.binary()).to_pylist(), strict=True):
                s = shingle_set(_words(text), k).view(np.int64)
                held.append((s, np.full(len(s), rep), np.full(len(s), len(s))))
                size += len(s)
                if size > 200_000:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return run


def _rare_pairs(texts: DataFrame, members: DataFrame, comps: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """``a, b``: members of different components that can be similar enough, without missing any.

    Shingles are ordered from rare to common. Two similar sets share one of their first
    ``n - ceil(t * n) + 1`` shingles, of the smaller set even of the first ``n - ceil(2t / (1 + t) * n) + 1``,
    and from the first shared one on enough must be left in both. A text with many shingles of its
    own begins with those and so meets nobody, however large its bucket.
    """
    shingles = materialise(texts.join(members, "rep", "left_semi").mapInArrow(_shingle_rows(k), "s long, rep long, n long"))
    often = materialise(shingles.groupBy("s").agg(F.count(F.lit(1)).alias("df")).where("df > 1"))  # written, so that the join below can be split
    at = F.row_number().over(Window.partitionBy("rep").orderBy("own", "df", "s"))
    up_to = lambda top, low: F.expr(f"n - ((({top}) * n + {low} - 1) div ({low})) + 1")
    # a shingle of one text alone takes its place in the order but can be shared with nobody
    ranked = shingles.join(often, "s", "left").withColumn("own", F.col("df").isNotNull()).withColumn("at", at)
    first = ranked.where(F.col("own") & (F.col("at") <= up_to(num, den))).withColumn("short", F.col("at") <= up_to(2 * num, num + den))
    first = materialise(first.join(comps, "rep", "left").select("s", "rep", "n", "at", "short", F.coalesce("comp", "rep").alias("comp")))
    mixed = first.groupBy("s").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count_if("short").alias("c")).where("lo <> hi AND c > 0")
    mixed = materialise(mixed.select("s", F.ceil(F.col("c") / PART).cast("int").alias("parts")))
    # the texts of a common shingle are dealt out in parts, and each part meets all of them
    first = materialise(first.join(mixed, "s"))
    small = first.where("short").select("s", F.pmod(F.xxhash64("rep"), "parts").cast("int").alias("part"), *[F.col(c).alias(f"{c}2") for c in ("rep", "n", "at", "comp")])
    met = first.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).join(small, ["s", "part"]).where(
        f"comp <> comp2 AND n2 <= n AND {den} * n2 >= {num} * n AND {den + num} * (1 + least(n - at, n2 - at2)) >= {num} * (n + n2)"
    )
    return met.select(F.least("rep", "rep2").alias("a"), F.greatest("rep", "rep2").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle_words: int = 5, similarity: tuple[int, int] = (80, 100),
    rows_per_band: int = ROWS_PER_BAND, bands: int | None = None,
) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, kept``.

    Words are runs without ASCII white space, A-Z lower-cased. A text's set is its distinct
    ``shingle_words``-word shingles; with fewer words it is the whole sequence as one. Null and empty
    texts have an empty set and are linked with nothing; long texts are read whole. Two texts are
    linked when ``den * intersection >= num * union`` on the full sets; components are the transitive
    closure, named by their smallest id, and rows with that id are kept. Rows of one id and set are
    one node and appear as often as in the input; rows that repeat an id with another set are another
    node, which may lie in another component. A null id is a component of its own, null and kept.
    ``id_col`` must hold integers. Extra columns are not read. An empty table gives no rows.
    """
    keys, named = _components(docs, id_col, text_col, shingle_words, similarity, rows_per_band, bands)
    out = keys.where("sig IS NOT NULL").select("doc_id", "n", "sig").join(named.select("sig", "component"), "sig", "left").select("doc_id", "n", "component")
    out = out.union(keys.where("sig IS NULL").select("doc_id", "n", F.lit(None).cast("long")))
    comp = F.when(F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), comp.alias("component_id"), comp.eqNullSafe(F.col("doc_id")).alias("kept"))


def _components(docs: DataFrame, id_col: str, text_col: str, shingle_words: int, similarity: tuple[int, int], rows_per_band: int, bands: int | None) -> tuple[DataFrame, DataFrame]:
    """``doc_id, th, n, sig`` of each row, and ``sig, component`` of each class of equal sets.

    A class is a node with a number of its own, so ids that repeat with other texts mix nothing up;
    its text is that of its smallest id, known by id and text hash.
    """
    ship(docs.sparkSession)
    num, den = similarity
    bands = bands or bands_for(num / den, rows_per_band)
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    keys = materialise(rows.mapInArrow(_sketcher(shingle_words, bands, rows_per_band), "doc_id long, th long, n long, sig binary, bands array<long>"))
    # classes of equal sets, each with its smallest id; the numbers last because they are written
    classes = keys.where("sig IS NOT NULL AND doc_id IS NOT NULL").groupBy("sig").agg(F.min(F.struct("doc_id", "th", "n", "bands")).alias("m"))
    classes = materialise(classes.select("sig", F.monotonically_increasing_id().alias("rep"), F.col("m.doc_id").alias("least"), F.col("m.th").alias("th"), F.col("m.bands").alias("bands")))
    members = classes.select("rep", F.explode("bands").alias("h"))
    shared = members.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("h")
    buckets = materialise(members.join(shared, "h").select("h", "rep"))
    wanted = classes.join(buckets.select("rep").distinct(), "rep", "left_semi").select("rep", F.col("least").alias("doc_id"), "th")
    texts = materialise(rows.join(wanted, ["doc_id", "th"]).groupBy("rep").agg(F.min("text").alias("text")))

    # every member meets the hub of each of its buckets: the one that shares most buckets with most others
    sizes = buckets.groupBy("h").agg(F.count(F.lit(1)).alias("c"))
    central = buckets.join(sizes, "h").groupBy("rep").agg(F.sum("c").alias("weight"))
    hubs = buckets.join(central, "rep").groupBy("h").agg(F.max(F.struct("weight", F.xxhash64("rep").alias("x"), "rep")).alias("hub"))
    pairs = buckets.join(hubs, "h").where("rep <> hub.rep").select(F.col("hub.rep").alias("a"), F.col("rep").alias("b")).distinct()
    pairs = materialise(pairs)
    edges = comps = None
    if not pairs.isEmpty():
        edges = materialise(_verified(pairs, texts, shingle_words, num, den))
        comps = components(edges)
        # buckets that still hold several components, and their members
        now = buckets.join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("h", "rep", F.coalesce("comp", "rep").alias("comp"))
        mixed = now.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("c")).where("lo <> hi AND c > 2").select("h")
        still = now.join(mixed, "h", "left_semi").select("rep").distinct()
        rest = _rare_pairs(texts, still, comps.withColumnRenamed("node", "rep"), shingle_words, num, den)
        rest = materialise(rest.join(pairs, ["a", "b"], "left_anti").join(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_anti"))
        if not rest.isEmpty():
            comps = components(edges.union(materialise(_verified(rest, texts, shingle_words, num, den))))
    named = classes.select("sig", "rep", "least")
    if comps is None:
        return keys, named.select("sig", F.col("least").alias("component"))
    lowest = named.join(comps.withColumnRenamed("node", "rep"), "rep").groupBy("comp").agg(F.min("least").alias("component"))
    known = comps.join(lowest, "comp").select(F.col("node").alias("rep"), "component")
    return keys, named.join(known, "rep", "left").select("sig", F.coalesce("component", "least").alias("component"))


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle_words: int = 5, similarity: tuple[int, int] = (80, 100),
    rows_per_band: int = ROWS_PER_BAND, bands: int | None = None,
) -> DataFrame:
    """``docs`` with all its columns and, of each component, only the rows with the smallest id.

    Null and empty texts, null ids, long texts, ties, repeated rows and empty tables count as in
    :func:`near_duplicates`: rows that repeat the smallest id of their component all stay, a null id
    or a text without words always stays. Columns may have any name. Rows are dropped by id and text
    hash, so a row that repeats a dropped id with a text of its own stays; the list of them is
    broadcast where it is short by count, so texts are not shuffled, and joined by a shuffle else.
    """
    keys, named = _components(docs, id_col, text_col, shingle_words, similarity, rows_per_band, bands)
    away = keys.where("sig IS NOT NULL AND doc_id IS NOT NULL").join(named, "sig").where("component <> doc_id")
    key, th = fresh("_drop_id", docs.columns), fresh("_drop_th", docs.columns)
    listed = sized(materialise(away.select(F.col("doc_id").alias(key), F.col("th").alias(th)).distinct()))
    return docs.join(listed, (docs[id_col].cast("long") == F.col(key)) & (F.xxhash64(docs[text_col]) == F.col(th)), "left_anti")
