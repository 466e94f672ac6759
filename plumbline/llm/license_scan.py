"""License notices by diagonal voting, with Spark expressions only.

Every word position joins the positions of templates by the hash of its k-gram: of two words for
phrases and short templates, of four for longer ones. A hit votes for the diagonal
``position - template position`` with the words that agree there, compared one by one; neighbouring
diagonals, which insertions and deletions cause, are merged; a span counts when enough of its
template's words lie on it, the word that names the license among them. Templates are a small fixed
table that is broadcast; rows without a hit never reach a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lower_ascii

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words in a text that is not lower-cased yet.
RAW_WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
KGRAM = 4
#: Templates of fewer words have k-grams of two words and look at the words around a hit.
SHORT = 15
#: Diagonals this far apart belong to one span.
SLACK = 3
#: Share of a template's words that a span needs.
COVERAGE = 0.75

# Phrases whose every place is counted, with their labels.
BASE = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
# Opening words and whole texts of common notices, with their labels.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2.0"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc", "licensed under cc by nc"),
    ("cc-by-sa", "licensed under cc by sa"),
    ("cc-by", "this work is licensed under a creative commons attribution"),
    ("gpl", "this work is licensed under the gnu general public license version"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "under the terms of the gnu lesser general public license"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license"),
    ("public-domain", "this is free and unencumbered software released into the public domain"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("apache-2.0", "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2.0"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details you should have received a copy of the gnu general public license along with this program if not see"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the license or at your option any later version"),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2.0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2.0"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("public-domain", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
)
#: Words that tell a license from others with the same wording.
NAMING = {"apache-2.0": "apache", "cc-by-nc": "nc", "cc-by-sa": "sa", "cc-by": "attribution", "lgpl": "lesser", "agpl": "affero", "mit": "mit", "mpl-2.0": "mozilla", "public-domain": "domain"}


def gram_hash(w0: str, w1: str, w2: str, w3: str, whole: Column) -> Column:
    """Hash of a k-gram of four words or of its first two, which never meet each other."""
    return F.when(whole, F.xxhash64(F.lit(KGRAM), w0, w1, w2, w3)).otherwise(F.xxhash64(F.lit(2), w0, w1))


def templates() -> list[tuple[str, bool, list[str], int, int | None]]:
    """Of each phrase and template: label, whether it is a base phrase, words, words of its k-grams, and where the naming word stands."""
    out = []
    for label, phrase, base in [*((v, k, True) for k, v in BASE.items()), *((k, v, False) for k, v in TEMPLATES)]:
        w = phrase.replace(".", " ").split()
        k = 2 if base or len(w) < SHORT else KGRAM
        out.append((label, base, w, k, None if base or NAMING.get(label) not in w else w.index(NAMING[label])))
    return out


def template_table(spark: SparkSession) -> DataFrame:
    """One row per k-gram of each phrase and template: a few hundred, whatever the corpus."""
    rows = []
    for t, (label, base, w, k, name) in enumerate(templates()):
        around = lambda q: w[q] if not base and k == 2 and 0 <= q < len(w) else None  # noqa: B023, E731
        rows += [(t, label, base, len(w), k, name, p, *w[p : p + k], *[None] * (KGRAM - k), around(p - 2), around(p + 2), around(p + 3)) for p in range(len(w) - k + 1)]
    names = ", ".join(f"_t{i} string" for i in range(KGRAM))
    return spark.createDataFrame(rows, f"tpl int, label string, base boolean, size int, k int, name int, tpl_pos int, {names}, _o0 string, _o2 string, _o3 string").withColumn("_th", gram_hash("_t0", "_t1", "_t2", "_t3", F.col("k") == KGRAM))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, slack: int = SLACK, coverage: float = COVERAGE) -> DataFrame:
    """One row per input row: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans``.

    Words are runs of digits, letters a-z after lower-casing A-Z, and all non-ASCII characters.
    ``n_base`` counts every place of a base phrase; ``labels`` adds those of spans that cover
    ``coverage`` of a template's words and its naming word; ``score`` is the largest share of a phrase or template found. A null
    or empty text has no words, empty labels and score 0. Rows that repeat id and text get the same
    answer each; a null id is kept. Extra columns are not read; an empty table gives no rows.
    """
    raw = F.coalesce(F.col(text_col), F.lit(""))
    text, key = lower_ascii(raw), F.xxhash64(raw).alias("_key")
    rows = docs.select(F.col(id_col).alias("doc_id"), key, F.regexp_extract_all(text, F.lit(WORDS), F.lit(0)).alias("_w"))
    back = F.concat(F.array(F.lit(None), F.lit(None)).cast("array<string>"), "_w")
    grams = F.arrays_zip(*[F.slice("_w", k + 1, F.greatest(F.size("_w"), F.lit(1))).alias(f"_w{k}") for k in range(KGRAM)], back.alias("_b2"))
    places = rows.select("doc_id", "_key", F.posexplode(grams).alias("pos", "g")).select("doc_id", "_key", "pos", *[F.col(f"g._w{k}") for k in range(KGRAM)], F.col("g._b2"))
    words = ("_w0", "_w1", "_w2", "_w3")
    rolling = F.array(gram_hash(*words, F.lit(False)), F.when(F.col("_w3").isNotNull(), gram_hash(*words, F.lit(True))))
    places = places.where("_w1 IS NOT NULL").select("*", F.explode(rolling).alias("_h"))
    same = F.col("_h") == F.col("_th")
    for k in range(KGRAM):
        same &= F.col(f"_t{k}").isNull() | (F.col(f"_w{k}") == F.col(f"_t{k}"))
    hits = places.join(F.broadcast(template_table(docs.sparkSession)), same)
    at = F.col("tpl_pos")
    before, after, third = F.col("_b2") == F.col("_o0"), F.col("_w2") == F.col("_o2"), F.col("_w3") == F.col("_o3")
    skipped = F.col("_w3") == F.col("_o2")  # one word is inserted before the template's next one
    full = F.col("k") == KGRAM
    around = [F.when(c, at + d) for c, d in ((before, -2), (after | skipped | full, 2), (third | full, 3))]
    tail = F.when(third | skipped | full, 3).when(after, 2).otherwise(1)
    votes = (
        hits.withColumn("diag", F.col("pos") - at).withColumn("agree", F.array_compact(F.array(at, at + 1, *around)))
        .withColumn("head", F.col("pos") - F.when(before, 2).otherwise(0)).withColumn("tail", F.col("pos") + tail)
        .groupBy("doc_id", "_key", "tpl", "label", "base", "size", "name", "diag")
        .agg(F.array_distinct(F.flatten(F.collect_set("agree"))).alias("seen"), F.min("head").alias("head"), F.max("tail").alias("tail"))
    )
    order = Window.partitionBy("doc_id", "_key", "tpl").orderBy("diag")
    step = F.when(F.col("diag") - F.lag("diag").over(order) <= slack, 0).otherwise(1)
    whole = F.col("base") & (F.size("seen") == F.col("size"))
    spans = (
        votes.withColumn("step", step).withColumn("island", F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("doc_id", "_key", "tpl", "label", "base", "size", "name", "island")
        .agg(
            F.array_distinct(F.flatten(F.collect_list("seen"))).alias("words"),
            F.min("head").alias("first"), F.max("tail").alias("last"),
            F.count_if(whole).alias("n_base"), F.min(F.when(whole, F.col("diag"))).alias("lo"), F.max(F.when(whole, F.col("diag"))).alias("hi"),
        )
        .withColumn("share", F.when(F.col("base"), (F.size("words") - 1) / (F.col("size") - 1)).otherwise(F.size("words") / F.col("size")))
    )
    counts = F.when(F.col("base"), F.col("n_base") > 0).otherwise((F.col("share") >= coverage) & (F.col("name").isNull() | F.array_contains("words", F.col("name"))))
    found = spans.groupBy("doc_id", "_key").agg(
        F.sum("n_base").alias("n_base"), F.min("lo").alias("first_word"), F.max("hi").alias("last_word"),
        F.array_sort(F.collect_set(F.when(F.col("base") & (F.col("n_base") > 0), F.col("label")))).alias("base_labels"),
        F.array_sort(F.collect_set(F.when(counts, F.col("label")))).alias("labels"), F.max("share").alias("score"),
        F.array_sort(F.collect_set(F.when(counts, F.struct("first", "last", "label")))).alias("spans"),
    ).withColumnRenamed("doc_id", "_id").withColumnRenamed("_key", "_k")
    # words are counted without lower-casing the text a second time
    n = docs.select(F.col(id_col).alias("doc_id"), key, F.size(F.regexp_extract_all(raw, F.lit(RAW_WORDS), F.lit(0))).cast("long").alias("n_words"))
    out = n.join(found, n["doc_id"].eqNullSafe(found["_id"]) & (n["_key"] == found["_k"]), "left")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"),
        F.coalesce(F.array_join("base_labels", ","), F.lit("")).alias("base_labels"), F.coalesce(F.array_join("labels", ","), F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("spans", F.array().cast("array<struct<first:int,last:int,label:string>>")).alias("spans"),
    )
