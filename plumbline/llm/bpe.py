"""Byte-level BPE through a table of distinct words, joined back by position.

Spark splits texts into words at single spaces between two visible characters, where the
vocabulary's own pattern always cuts too, so encoding word by word gives the library's ids. A pack
holds many documents as positions in the pack's list of distinct words and lies compressed in the
shared folder; only the list is shuffled. Sorted by word, each distinct word is encoded once, the
ids return to the pack, and positions turn into ids. Decoding joins ids with the id-to-piece table
of the vocabulary.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BATCH_ROWS, bundle, give_back, n_partitions, read_file, remembers, scratch_dir, ship, turn_to, unbundle, write_once

#: A space between two characters that are no white space, separator or control.
WORD_SPLIT = r"(?<=[^\s\p{Z}\p{C}]) (?=[^\s\p{Z}\p{C}])"
PACK_BYTES = 48 << 20
#: Bytes of ids and texts that a pack is restored by at a time; a longer document is one part.
PART_BYTES = 4 << 20
#: Lists of ids that are turned into strings at a time.
WORDS_AT_ONCE = 100_000
#: Rows that the encoder holds back to send a pack's ids together.
HOLD_ROWS = 200_000
#: Pieces remembered while words come in order.
SORTED_PIECES = 60_000
#: Characters of the texts whose words are looked up together.
BATCH_CHARS = 8 << 20
#: The pre-tokenizer pattern of the vocabulary file; a fixed value.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {b: chr(b) for b in visible} | {b: chr(0x100 + k) for k, b in enumerate(hidden)}


@lru_cache(maxsize=4)
def load_tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


#: What a tokenizer file must say for its texts to be cut by PRE_TOKENS and decoded piece by piece; fixed values.
CUTS = {
    "normalizer": {}, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}, "decoder": {"type": "ByteLevel"},
    "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "byte_fallback": False, "ignore_merges": False},
}


@lru_cache(maxsize=4)
def cuts_words(path: str) -> bool:
    """Whether the file is a byte-level BPE as this module cuts it; texts of other tokenizers are encoded and decoded whole by the library."""
    d = json.loads(load_tokenizer(path).to_str())
    plain = all(not t[k] for t in d["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
    # an empty string is how the library writes an unset prefix or suffix
    return plain and all((d.get(part) or {}).get(k, v) in (v, "" if v is None else v) for part, wants in CUTS.items() for k, v in wants.items()) and not d["normalizer"] and bool(d["pre_tokenizer"]) and bool(d["decoder"])


@lru_cache(maxsize=4)
def vocabulary_pieces(path: str) -> pa.Array:
    """The id-to-piece table: bytes of each id, null for ids that the vocabulary lacks. Its size is the file's."""
    t = load_tokenizer(path)
    bytes_of = {c: b for b, c in _byte_letters().items()}
    special = set(t.get_added_tokens_decoder())
    vocab = t.get_vocab(with_added_tokens=True)
    out: list[bytes | None] = [None] * (max(vocab.values(), default=-1) + 1)
    for piece, i in vocab.items():
        plain = i in special or any(c not in bytes_of for c in piece)
        out[i] = piece.encode() if plain else bytes(bytes_of[c] for c in piece)
    return pa.array(out, pa.binary())


class Recent(dict):
    """A cache of two generations: what was used since the last turn-over survives the next."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value


class WordEncoder:
    """Ids of words and texts by the tokenizers library, the same as encoding the text at once.

    Where :func:`cuts_words` fails, texts go through ``encode`` whole. Words without a special token's string are cut by the vocabulary's pattern, and the library's
    BPE model encodes each piece; pieces and words are remembered. All else goes through ``encode``.
    """

    def __init__(self, path: str, most: int = 500_000):
        import regex

        self.tok = load_tokenizer(path)
        self.plain = cuts_words(path)
        special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.special = (lambda text, s=special[0]: s in text) if len(special) == 1 else re.compile("|".join(map(re.escape, special)) or r"(?!)").search
        self.cut = regex.compile(PRE_TOKENS).findall
        self.letters = {b: c for b, c in _byte_letters().items()}
        self.model = self.tok.model
        self.pieces = Recent(self._piece, most)
        self.words = Recent(self._word, most)  # without the space before them

    def _word(self, word: str) -> bytes:
        """Ids of a word after a space; one of ASCII letters is a piece by itself and need not be remembered as such too."""
        if self.plain and word.isascii() and word.isalpha() and not self.special(" " + word):
            return array("I", [t.id for t in self.model.tokenize("\u0120" + word)]).tobytes()
        return self.ids(" " + word)

    def _piece(self, piece: str) -> bytes:
        text = piece.replace(" ", "\u0120") if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(text)]).tobytes()

    def ids(self, word: str) -> bytes:
        """Ids of a word that may have a space before it, as little-endian unsigned 32-bit numbers."""
        if not self.plain or self.special(word):
            return np.array(self.tok.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        got = self.pieces
        if word[1:-1].isalpha():  # letters, with a space before and a mark behind at most: most words
            at = -1 if not word[-1].isalnum() and word[-1] not in "' " and not word[-1].isspace() else None
            if (word[0] == " " or word[0].isalpha()) and (at or word[-1].isalpha()):
                return got[word[:at]] + got[word[-1:]] if at else got[word]
        return b"".join([got[p] for p in self.cut(word)])

    def encode(self, text: str) -> np.ndarray:
        if not self.plain or self.special(text):
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4")
        # words lie between single spaces unless white space meets white space there
        if "  " in text or " \n" in text or "\n " in text or not text.replace("\n", "").isprintable():
            got = self.pieces
            return np.frombuffer(b"".join([got[p] for p in self.cut(text)]), "<u4")
        got = self.words
        head, *rest = text.split(" ")
        return np.frombuffer(self.ids(head) + b"".join([got[w] for w in rest]), "<u4")

    def encode_many(self, texts: list[str], most_chars: int = BATCH_CHARS) -> Iterator[np.ndarray]:
        """Ids of each text in turn, as :meth:`encode` gives them; each word of a batch is looked up once for all its texts."""
        start = size = 0
        for k, text in enumerate(texts):
            if k > start and size + len(text) > most_chars:
                yield from self._batch(texts[start:k])
                start, size = k, 0
            size += len(text)
        if start < len(texts):
            yield from self._batch(texts[start:])

    def _batch(self, texts: list[str]) -> list[np.ndarray]:
        # a single long text stays with encode, which needs no 32-bit offsets
        easy = [self.plain and len(t) <= BATCH_CHARS and not self.special(t) and "  " not in t and " \n" not in t and "\n " not in t and t.replace("\n", "").isprintable() for t in texts]
        if not any(easy):
            return [self.encode(t) for t in texts]
        lists = pc.split_pattern(pa.array([t if e else None for t, e in zip(texts, easy, strict=True)], pa.string()), " ")
        coded = lists.flatten().dictionary_encode()
        got = self.words
        blobs = [got[w] for w in coded.dictionary.to_pylist()]
        ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        # a text's first word has no space before it: it takes a place of its own
        at = coded.indices.to_numpy().copy()
        heads = np.flatnonzero(easy)
        at[starts[heads]] = len(blobs) + np.arange(len(heads))
        blobs += [self.ids(texts[k].partition(" ")[0]) for k in heads.tolist()]
        offsets = np.zeros(len(blobs) + 1, np.int32)
        np.cumsum(np.fromiter(map(len, blobs), np.int64, len(blobs)), out=offsets[1:])
        taken = pa.Array.from_buffers(pa.binary(), len(blobs), [None, pa.py_buffer(offsets), pa.py_buffer(b"".join(blobs))]).take(pa.array(at))
        _, cuts, data = taken.buffers()
        ids, cuts = np.frombuffer(data or b"", "<u4"), np.frombuffer(cuts, "<i4")[: len(at) + 1] >> 2
        return [ids[cuts[a] : cuts[b]] if e else self.encode(t) for t, e, a, b in zip(texts, easy, starts.tolist(), ends.tolist(), strict=True)]


@lru_cache(maxsize=2)
def shared_encoder(path: str, most: int) -> WordEncoder:
    """One encoder for all tasks of a Python worker."""
    return WordEncoder(path, most)


remembers(shared_encoder.cache_clear)


def split_words(text: Column) -> Column:
    """Words without the space that stands before all but the first; null counts as empty."""
    return F.split(F.coalesce(text, F.lit("")), WORD_SPLIT, -1)


def _file(key: int) -> str:
    return f"pack-{key & (1 << 64) - 1:016x}"


def _packer(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to("bpe pack")
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, pa.DictionaryArray]] = []
        size = made = 0
        task = TaskContext.get().partitionId()

        def flush() -> pa.RecordBatch:
            nonlocal made
            made += 1
            doc, null, lengths = (np.concatenate(x) for x in list(zip(*held, strict=True))[:3])
            coded = pa.chunked_array([h[3] for h in held]).unify_dictionaries().combine_chunks()
            held.clear()
            coded = coded.chunk(0) if isinstance(coded, pa.ChunkedArray) else coded
            at = coded.indices.to_numpy().astype("<i4", copy=False)
            data = bundle([doc.tobytes(), null.tobytes(), lengths.tobytes(), np.ascontiguousarray(at.view(np.uint8).reshape(-1, 4).T).tobytes()])
            digest = hashlib.sha256(data)
            for b in coded.dictionary.buffers():
                digest.update(b or b"")
            digest.update(f"{task} {made}".encode())  # equal packs of different tasks stay apart
            key = int.from_bytes(digest.digest()[:8], "little", signed=True)
            write_once(root, _file(key), data)
            n = len(coded.dictionary)
            bare = np.zeros(n, np.int32)
            bare[at[np.concatenate([[0], np.cumsum(lengths)[:-1]])]] = 1
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, key, np.int64)), pa.array(np.arange(n, dtype=np.int32) * 2 + bare), coded.dictionary], ["pack", "at", "word"])

        for b in batches:
            if b.num_rows:
                ids, lists = b.column("doc_id"), b.column("words")
                doc, null = ids.fill_null(0).to_numpy().astype("<i8"), ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8)
                # the first word of a document has no space before it, all others have
                lengths = np.diff(lists.offsets.to_numpy()).astype("<i8")
                # of the words themselves, what follows needs the distinct ones alone
                held.append((doc, null, lengths, lists.flatten().dictionary_encode()))
                size += b.nbytes
                del ids, lists
            del b
            if size >= PACK_BYTES:
                out = flush()
                size = 0
                yield from (out.slice(k, 20_000) for k in range(0, out.num_rows, 20_000))
        if held:
            out = flush()
            yield from (out.slice(k, 20_000) for k in range(0, out.num_rows, 20_000))

    return run


def _encoder(path: str):
    """Encodes each distinct word once; sends the ids of many words to their packs in one row.

    ``at`` is a position times two, plus one where a document starts with the word. A row holds
    positions and, for each, the ids after a space and, if needed, those at a text's start.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to("bpe encode")
        enc = shared_encoder(path, SORTED_PIECES)
        held: dict[int, list] = {}
        count = 0
        last, spaced, bare = None, b"", None

        def flush() -> pa.RecordBatch:
            keys, blobs = [], []
            for key, rows in held.items():
                rows.sort()
                at = np.array([r[0] for r in rows], "<i4")
                sizes = np.array([[len(r[1]) >> 2, len(r[2]) >> 2] for r in rows], "<i4")
                body = [np.diff(at, prepend=np.int32(0)).astype("<i4"), sizes.reshape(-1), np.frombuffer(b"".join([x for r in rows for x in r[1:]]), "<i4")]
                keys.append(key)
                blobs.append(bundle([np.ascontiguousarray(x.view(np.uint8).reshape(-1, 4).T).tobytes() for x in body], level=1))
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(blobs, pa.binary())], ["pack", "blob"])

        for b in batches:
            for pack, at, word in zip(b.column("pack").to_pylist(), b.column("at").to_pylist(), b.column("word").to_pylist(), strict=True):
                if word != last:
                    last, spaced, bare = word, enc.ids(" " + word), None
                if at & 1 and bare is None:
                    bare = enc.ids(word)
                held.setdefault(pack, []).append((at >> 1, bare if at & 1 else b"", spaced))
                count += 1
            if count >= HOLD_ROWS:
                yield flush()
                held, count = {}, 0
        if held:
            yield flush()

    return run


def _ints(plane: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(plane, np.uint8).reshape(4, -1).T).view("<i4").reshape(-1)


_FIELDS = {"doc_id": ("long", pa.int64()), "n_tokens": ("long", pa.int64()), "ids": ("string", pa.string()), "decoded": ("string", pa.string()), "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string())}


def _restorer(root: str, path: str, fields: list[str], most_bytes: int = PART_BYTES):
    """Turns the positions of a pack into ids and texts, ``most_bytes`` and ``BATCH_ROWS`` rows at a time."""
    comma, nothing = pa.scalar(",", pa.large_string()), pa.scalar(b"", pa.large_binary())

    def run(key: tuple, group: pa.Table) -> Iterator[pa.RecordBatch]:
        turn_to("bpe restore")
        at, sizes, ids = [], [], []
        for blob in group.column("blob").to_pylist():
            a, s, i = map(_ints, unbundle(blob, 3))
            at.append(np.cumsum(a))
            sizes.append(s)
            ids.append(i)
        # two lists of ids for each word: at a text's start, and after a space
        at = np.concatenate(at)
        counts = np.concatenate(sizes)
        flat = np.concatenate(ids)
        del sizes, ids
        ends = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        csv, raw = (pa.concat_arrays(x) for x in zip(*(strings(flat, ends[k : k + WORDS_AT_ONCE + 1]) for k in range(0, len(counts), WORDS_AT_ONCE)), strict=True))
        del flat, ends
        doc, null, lengths, words = unbundle(read_file(root, _file(key[0].as_py())), 4)
        words = _ints(words)
        where = np.full(int(max(at.max(), words.max(initial=0))) + 1, -1, np.int32)
        where[at] = np.arange(len(at), dtype=np.int32)  # an id list sent twice by a retried task is the same list
        words = where[words]
        if words.min(initial=0) < 0:
            raise RuntimeError("a pack lacks the ids of some of its words: its rows were dealt out in another order when a task was repeated")
        del at, where
        docs = pa.array(np.frombuffer(doc, "<i8"), mask=np.frombuffer(null, np.uint8).astype(bool))
        cuts = np.concatenate([[0], np.cumsum(np.frombuffer(lengths, "<i8"))])
        weights = (pc.binary_length(csv).to_numpy() + pc.binary_length(raw).to_numpy())[1::2].astype(np.int32)
        return parts(docs, words, cuts, counts, csv, raw, np.cumsum(np.add.reduceat(weights[words], cuts[:-1], dtype=np.int64)))

    def strings(flat: np.ndarray, ends: np.ndarray) -> tuple[pa.Array, pa.Array]:
        """For lists of ids: the ids joined by commas, and the bytes they stand for."""
        flat, offsets = pa.array(flat[ends[0] : ends[-1]]), pa.array((ends - ends[0]).astype(np.int32))
        csv = pc.binary_join(pa.ListArray.from_arrays(offsets, pc.cast(flat, pa.large_string())), comma)
        if cuts_words(path):
            return csv, pc.binary_join(pa.ListArray.from_arrays(offsets, pc.take(vocabulary_pieces(path), flat).cast(pa.large_binary())), nothing)
        # a word is a text
        return csv, pa.array([load_tokenizer(path).decode(x, skip_special_tokens=False).encode() for x in pa.ListArray.from_arrays(offsets, flat).to_pylist()], pa.large_binary())

    def parts(docs: pa.Array, words: np.ndarray, cuts: np.ndarray, counts: np.ndarray, csv: pa.Array, raw: pa.Array, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
        start = 0
        while start < len(docs):
            before = sizes[start - 1] if start else 0
            end = min(max(start + 1, int(np.searchsorted(sizes, before + most_bytes, "right"))), start + BATCH_ROWS, len(docs))
            yield part(docs[start:end], words[cuts[start] : cuts[end]], cuts[start : end + 1] - cuts[start], counts, csv, raw)
            start = end
        give_back()

    def part(docs: pa.Array, words: np.ndarray, cuts: np.ndarray, counts: np.ndarray, csv: pa.Array, raw: pa.Array) -> pa.RecordBatch:
        own = 2 * words.astype(np.int64) + 1
        own[cuts[:-1][np.diff(cuts) > 0]] -= 1
        k = counts[own]
        out: dict[str, pa.Array] = {"doc_id": docs, "n_tokens": pa.array(np.diff(np.concatenate([[0], np.cumsum(k, dtype=np.int64)])[cuts]))}
        if {"ids", "ids_sha256"} & set(fields):
            told = np.concatenate([[0], np.cumsum(k > 0)])[cuts].astype(np.int32)  # words without ids have no place between commas
            out["ids"] = pc.binary_join(pa.ListArray.from_arrays(pa.array(told), csv.take(pa.array(own[k > 0]))), comma)
        if {"decoded", "decoded_sha256"} & set(fields):
            texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), raw.take(pa.array(own))), nothing)
            out["decoded"] = pa.array([t.as_py().decode("utf-8", "replace") for t in texts], pa.large_string())
        for c in set(fields) - set(out):
            out[c] = pa.array([hashlib.sha256(t.as_buffer()).hexdigest() for t in out[c.removesuffix("_sha256")]])
        return pa.RecordBatch.from_arrays([out[c].cast(_FIELDS[c][1]) for c in fields], fields)

    return run


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", *, fields: tuple[str, ...] = tuple(_FIELDS)) -> DataFrame:
    """Encodes and decodes every whole text; one row per input row with the columns named in ``fields``.

    ``ids`` is the decimal ids joined by commas, ``decoded`` the text they stand for. A null text
    counts as empty and has no ids; rows that repeat an id give a row each; a null id stays null; an
    empty table gives no rows. Strings of special tokens inside a text become their ids, as in the
    library. ``id_col`` must hold integers. Extra columns are not read. Memory is bounded by a pack
    (about 48 MB of words, of which the distinct ones are kept, or one document where that is longer);
    results leave a pack in parts of about ``PART_BYTES``. Pack files are named by their
    content and lie in the shared scratch folder, so a retried task writes the same file again.
    """
    spark = docs.sparkSession
    ship(spark)
    root = scratch_dir(spark)
    text = F.col(text_col)
    words = split_words(text) if cuts_words(path) else F.array(F.coalesce(text, F.lit("")))
    split = docs.select(F.col(id_col).cast("long").alias("doc_id"), words.alias("words"))
    names = split.mapInArrow(_packer(root), "pack long, at int, word string")
    sorted_names = names.repartition(n_partitions(spark, docs), "word").sortWithinPartitions("word")
    encoded = sorted_names.mapInArrow(_encoder(path), "pack long, blob binary")
    restored = _restorer(root, path, list(fields))

    def restore(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return restored(key, pa.Table.from_batches(batches))

    # by number, since ids lie compressed in the shuffle: joined partitions would be many times larger once restored
    return encoded.repartition(n_partitions(spark, docs), "pack").groupBy("pack").applyInArrow(restore, ", ".join(f"{f} {_FIELDS[f][0]}" for f in fields))
