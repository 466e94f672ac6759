"""Text quality by a regularised quadratic discriminant over document statistics.

Statistics of a text are counted with byte operations, transformed to be roughly normal, and summed
per class as moments (count, sum, sum of products), so a fit moves a few numbers per task. Class
covariances shrink towards the pooled one and towards its diagonal; their Cholesky factors are kept,
and a score is the logistic of the difference of the Mahalanobis log-densities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, fresh, materialise, ship

_LOWER = bytes(range(0x61, 0x7B))
_UPPER = bytes(range(0x41, 0x5B))
_DIGIT = b"0123456789"
_HIGH = bytes(range(0x80, 0x100))
_SENTENCE = b".,;:'-()\""
_SPACE = b" \t\n\r\x0b\x0c"
_KNOWN = _LOWER + _UPPER + _DIGIT + _HIGH + _SENTENCE + _SPACE
FEATURES = (
    "log_bytes", "upper", "digit", "sentence_marks", "exclaim", "odd_marks", "odd_runs", "word_length", "word_length_sd",
    "distinct_words", "distinct_pairs", "same_neighbour", "top_word", "short_words", "mark_words", "distinct_lines",
)


def statistics(text: bytes | None) -> np.ndarray:
    """The transformed statistics of one whole text; an empty one gives zeros."""
    x = np.zeros(len(FEATURES))
    text = text or b""
    words = text.split()
    n, m = len(text), len(words)
    if not m:
        return x
    lower = n - len(text.translate(None, _LOWER))
    upper = n - len(text.translate(None, _UPPER))
    odd = text.translate(None, _KNOWN)
    lengths = np.fromiter(map(len, words), np.int64, m)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    after = words[1:]
    lines = text.split(b"\n")
    share = lambda k, of: np.sqrt(k / of) if of else 0.0
    x[:] = (
        np.log1p(n), share(upper, upper + lower), share(n - len(text.translate(None, _DIGIT)), n), share(n - len(text.translate(None, _SENTENCE)), n),
        share(text.count(b"!"), m), share(len(odd), n), share(sum(odd.count(c * 2) for c in (b"!", b"*", b"$", b"%", b"&", b"#", b"|", b"=", b"_", b"~")), m),
        np.log(lengths.mean()), np.log1p(lengths.std()), share(len(counts), m), share(len(set(zip(words, after, strict=False))), max(m - 1, 1)),
        share(sum(map(bytes.__eq__, words, after)), m), share(max(counts.values()), m), share(int((lengths <= 3).sum()), m),
        share(sum(counts[w] for w in counts if not w.translate(None, odd + b"!|")), m), share(len(set(lines)), len(lines)),
    )
    return x


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = [statistics(t) for t in pc.cast(b.column("text"), pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([r.tolist() for r in x], pa.list_(pa.float64()))], ["doc_id", "x"])


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, x`` (array in the order of FEATURES) for every row, by its whole text.

    Null, empty and blank texts have statistics of zero; repeated rows give a row each, null ids stay
    null, extra columns are not read, and an empty table gives no rows.
    """
    ship(docs.sparkSession)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_features, f"doc_id {dict(docs.dtypes)[id_col]}, x array<double>")


@dataclass(frozen=True)
class Quadratic:
    """Class means, Cholesky factors of the inverse-ready covariances and log priors."""

    mean: np.ndarray
    chol: np.ndarray
    log_prior: np.ndarray

    @classmethod
    def from_moments(cls, n: np.ndarray, s: np.ndarray, ss: np.ndarray, *, to_pooled: float, to_diagonal: float, ridge: float) -> Quadratic:
        d = s.shape[1]
        mean = s / np.maximum(n, 1)[:, None]
        scatter = ss - n[:, None, None] * mean[:, :, None] * mean[:, None, :]
        pooled = scatter.sum(0) / max(n.sum() - 2, 1)
        out = []
        for k in (0, 1):
            c = scatter[k] / max(n[k] - 1, 1) if n[k] > 1 else pooled
            c = (1 - to_pooled) * c + to_pooled * pooled
            c = (1 - to_diagonal) * c + to_diagonal * np.diag(np.diag(c))
            out.append(np.linalg.cholesky(c + ridge * np.eye(d)))
        if not n.min():
            mean[n.argmin()] = mean[n.argmax()]  # a class without rows: only the priors speak
            out[n.argmin()] = out[n.argmax()]
        return cls(mean, np.array(out), np.log((n + 1) / (n.sum() + 2)))

    def scores(self, x: np.ndarray) -> np.ndarray:
        log = []
        for k in (0, 1):
            z = np.linalg.solve(self.chol[k], (x - self.mean[k]).T)
            log.append(self.log_prior[k] - np.log(np.diag(self.chol[k])).sum() - 0.5 * (z * z).sum(0))
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    d = len(FEATURES)
    total = np.zeros((2, 1 + d + d * d))
    for b in batches:
        x = np.array(b.column("x").to_pylist(), float).reshape(-1, d)
        y = b.column("label").to_numpy(zero_copy_only=False)
        for k in (0, 1):
            own = x[y == k]
            total[k] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
    yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], ["k", "m"])


def training_rows(id_col: Column) -> Column:
    """Rows that a model may learn from: four in five, by the CRC-32 of the id as text."""
    return F.crc32(id_col.cast("string").cast("binary")) % 5 != 0


def fit(stats: DataFrame, labels: DataFrame, *, label_id: str = "doc_id", label: str = "quality", to_pooled: float = 0.05, to_diagonal: float = 0.05, ridge: float = 1e-4) -> Quadratic:
    """Fits on every labelled training row of ``stats``; moments are summed in the cluster.

    Labels other than 0 and 1, null ids and unlabelled rows are not used. An id with two labels
    counts once for each. Without any label the scores are 0.5.
    """
    known = labels.where(training_rows(F.col(label_id)) & F.col(label).isin(0, 1)).select(F.col(label_id).alias("_label_id"), F.col(label).cast("int").alias("label"))
    rows = stats.join(known, stats["doc_id"] == known["_label_id"]).select("x", "label")
    parts = rows.mapInArrow(_moments, "k int, m array<double>").select("k", F.posexplode("m").alias("i", "v")).groupBy("k", "i").agg(F.sum("v").alias("v"))
    d = len(FEATURES)
    total = np.zeros((2, 1 + d + d * d))
    for r in parts.collect():  # two rows of a few hundred numbers each
        total[r.k, r.i] = r.v
    return Quadratic.from_moments(total[:, 0], total[:, 1 : 1 + d], total[:, 1 + d :].reshape(2, d, d), to_pooled=to_pooled, to_diagonal=to_diagonal, ridge=ridge)


def score(stats: DataFrame, model: Quadratic) -> DataFrame:
    """``doc_id, score`` for every row of ``stats``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array(b.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.scores(x))], ["doc_id", "score"])

    return stats.mapInArrow(run, f"doc_id {dict(stats.dtypes)['doc_id']}, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, threshold: float = 0.3) -> DataFrame:
    """One row per input row: ``doc_id, held_out, score, predicted``; ``predicted`` is 1 from ``threshold`` on.

    Only the text enters a score. Null and empty texts are scored by statistics of zero. Rows that
    repeat an id are scored each by its own text; a null id is scored and not held out. Extra columns
    are not read; an empty table gives no rows.
    """
    stats = materialise(document_statistics(docs, id_col, text_col))
    scored = score(stats, fit(stats, labels))
    held_out = F.coalesce(~training_rows(F.col("doc_id")), F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, threshold: float = 0.3, label_id: str = "doc_id", label: str = "quality",
) -> DataFrame:
    """``docs`` with all its columns, without the rows that the classifier rejects.

    Every row is scored by its own whole text where it is read, so no text is shuffled; a null or
    empty text has statistics of zero and stays or goes by their score, repeated rows get one answer,
    a null id is scored like any other. Columns of both tables may have any name; an empty table
    gives no rows, and without labels all rows score 0.5. The model learns from the labelled rows of
    :func:`fit`.
    """
    key = fresh("_label_id", docs.columns)
    known = materialise(labels.where(training_rows(F.col(label_id)) & F.col(label).isin(0, 1)).select(F.col(label_id).alias(key)).distinct())
    rows = docs.where(training_rows(docs[id_col]))
    if known.count() <= BROADCAST_ROWS:  # else the statistics of all rows meet the labels, not their texts
        rows = rows.join(F.broadcast(known), docs[id_col] == F.col(key), "left_semi")
    model = fit(materialise(document_statistics(rows, id_col, text_col)), labels, label_id=label_id, label=label)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.array([statistics(t) for t in pc.cast(b.column(at), pa.binary()).to_pylist()])
                yield b.filter(pa.array(model.scores(x) >= threshold))

    at = docs.columns.index(text_col)
    return docs.mapInArrow(run, docs.schema)
