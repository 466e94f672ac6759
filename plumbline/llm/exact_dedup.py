"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash.

Everything here is DataFrame expressions. One pass over the texts counts lengths and, within a
length, prefix hashes, combined before the shuffle, so a group that holds a third of all rows is one
small row per task. Texts whose length and prefix occur once are unique; the whole of a text is
hashed only above the join that keeps the others. That join broadcasts the surviving keys where
they are few by count, so texts stay where they are read; more keys are joined by a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, lower_ascii, materialise, sized

PREFIX_CHARS = 256


def _length(text: Column) -> Column:
    """Bytes of the text, which lower-casing A-Z leaves as they are."""
    return F.octet_length(F.coalesce(text, F.lit("")))


def _head(text: Column, prefix_chars: int) -> Column:
    return F.xxhash64(lower_ascii(F.substring(text, 1, prefix_chars)))


def _full(text: Column) -> Column:
    # never null, so no join on it makes the optimiser test the hash below the refinement
    return F.coalesce(F.sha2(lower_ascii(text), 256), F.lit(""))


def surviving_heads(docs: DataFrame, text_col: str = "text", *, prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """Rounds 1 and 2: ``_len, _head`` of lengths and, within them, prefix hashes that two rows or more share.

    A null text counts as empty; repeated rows count each; an empty table gives no rows.
    """
    text = F.col(text_col)
    counted = docs.select(_length(text).alias("_len"), _head(text, prefix_chars).alias("_head")).groupBy("_len", "_head").agg(F.count(F.lit(1)).alias("n"))
    return sized(materialise(counted.where("n > 1").select("_len", "_head")))


def _rows(docs: DataFrame, id_col: str, text_col: str, prefix_chars: int) -> DataFrame:
    text = F.col(text_col)
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), _length(text).alias("_len"), _head(text, prefix_chars).alias("_head"))


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """Round 3: groups of two or more equal texts, ``text_sha256, keep_id, group_size, id_rows``; ``id_rows`` counts those of the kept id.

    Only rows that survive the first two rounds get the SHA-256 of their whole text. Nulls, empty
    texts, repeats, empty tables and extra columns count as in :func:`exact_dedup`.
    """
    heads = surviving_heads(docs, text_col, prefix_chars=prefix_chars)
    alike = _rows(docs, id_col, text_col, prefix_chars).join(heads, ["_len", "_head"], "left_semi")
    return _groups(alike.select("doc_id", _full(F.col("text")).alias("text_sha256")))


def _groups(alike: DataFrame) -> DataFrame:
    ids = alike.groupBy("text_sha256", "doc_id").agg(F.count(F.lit(1)).alias("c"))
    # the rows of the largest id, which sort last; nulls sort first
    out = ids.groupBy("text_sha256").agg(F.max(F.struct("doc_id", "c")).alias("m"), F.sum("c").alias("group_size")).where("group_size > 1")
    return out.select("text_sha256", F.col("m.doc_id").alias("keep_id"), "group_size", F.col("m.c").alias("id_rows"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after lower-casing A-Z. A null text counts as empty, and empty
    texts equal each other; long texts are read whole. The largest id of a group stays. Rows that
    repeat an id are rows of their own and count in ``group_size``; each repeat of the largest id is
    marked kept. A null id stays only where every id of its group is null. Extra columns are not
    read; an empty table gives no rows. Rows that the first two rounds tell apart are hashed for the
    output column alone, after the join that tells them so.
    """
    heads = surviving_heads(docs, text_col, prefix_chars=prefix_chars)
    told = _rows(docs, id_col, text_col, prefix_chars).join(heads.withColumn("_twice", F.lit(True)), ["_len", "_head"], "left")
    told = materialise(told.select("doc_id", F.unhex(_full(F.col("text"))).alias("sha"), F.coalesce("_twice", F.lit(False)).alias("twice")))
    alike = told.where("twice").select("doc_id", F.lower(F.hex("sha")).alias("text_sha256"))
    groups = materialise(_groups(alike).select(F.unhex("text_sha256").alias("sha"), "keep_id", "group_size"))
    out = told.join(groups, "sha", "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        keep.eqNullSafe(F.col("doc_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, prefix_chars: int = PREFIX_CHARS, one_row: bool = False) -> DataFrame:
    """``docs`` with all its columns, without the rows that :func:`exact_dedup` does not keep.

    Nulls, empty and long texts, ties and empty tables count as there; columns may have any name.
    Rows that repeat the kept id with the kept text all stay, or one of them with ``one_row``; only
    such rows are shuffled for it. Dropped rows are known by id, length, prefix hash and full hash;
    their list is broadcast where it is short by count, so texts are not shuffled, and joined by a
    shuffle else.
    """
    heads = surviving_heads(docs, text_col, prefix_chars=prefix_chars)
    alike = _rows(docs, id_col, text_col, prefix_chars).join(heads, ["_len", "_head"], "left_semi")
    alike = materialise(alike.select("doc_id", "_len", "_head", _full(F.col("text")).alias("text_sha256")))
    groups = materialise(_groups(alike))
    key, size, head, shas, sha = (fresh(n, docs.columns) for n in ("_drop_id", "_drop_len", "_drop_head", "_drop_shas", "_sha"))

    def listed(rows: DataFrame) -> DataFrame:
        keys = (F.col("doc_id").alias(key), F.col("_len").alias(size), F.col("_head").alias(head))
        return sized(materialise(rows.groupBy(*keys).agg(F.collect_set("text_sha256").alias(shas))))

    text = docs[text_col]
    # the whole text is hashed only where id, length and prefix are listed
    same = docs[id_col].eqNullSafe(F.col(key)) & (_length(text) == F.col(size)) & (_head(text, prefix_chars) == F.col(head)) & F.array_contains(F.col(shas), _full(text))
    told = alike.join(groups, "text_sha256")
    away = told.where("NOT (doc_id <=> keep_id)")
    if not one_row or groups.where("id_rows > 1").isEmpty():
        return docs.join(listed(away), same, "left_anti")
    again = told.where("doc_id <=> keep_id AND id_rows > 1")
    once = docs.join(listed(again), same, "left_semi").withColumn(sha, _full(F.col(text_col))).dropDuplicates([id_col, sha]).drop(sha)
    return docs.join(listed(away.union(again)), same, "left_anti").union(once)
