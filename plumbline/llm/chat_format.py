"""Chat templates written with Spark expressions only, and read back from the text.

A conversation is::

    <|im_start|>role\\ntext<|turn|>text<|im_end|>\\n ...

where neighbouring turns of one role share a block and ``<|turn|>`` stands between their texts.
Inside roles and texts a ``<``, any number of ``!``, then ``|`` gets one more ``!``, so no text can
hold a control string and taking one ``!`` away gives the text back. A line break in a role becomes
``<|nl|>``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, TURN, BREAK = "<|im_start|>", "<|im_end|>\n", "<|turn|>", "<|nl|>"
#: Turns that one fold appends to its array; a longer conversation is folded in parts, so the copies made stay few.
FOLDED = 512
_PIECES = "array<struct<piece:string,start:bigint,size:bigint,loss:boolean>>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(!*)\|", "<!$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<!(!*)\|", "<$1|")


def format_conversations(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: ``conv_id, formatted, loss_spans``.

    Turns are ordered by turn, then role, then text; a null turn comes first, a null role or text
    counts as empty, and rows with a null conversation form one conversation. Repeated rows are turns
    of their own. An empty table gives no rows. ``loss_spans`` holds the byte ranges (start, length)
    of the texts of ``loss_role`` in ``formatted``, without any control string. Extra columns are not
    read. The collected turns of a conversation are sorted and merged as one array, and its text is one
    value, so a conversation is one task's work; very long texts and conversations are taken whole.
    """
    text = escape(F.coalesce(F.col(text_col), F.lit("")))
    role = F.regexp_replace(escape(F.coalesce(F.col(role_col), F.lit(""))), "\n", BREAK)
    turn = F.struct(F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    grouped = turns.groupBy(F.col(conv_col).alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("t"))
    # parts of the sorted array, each folded by itself: the role before it stands in the array
    starts = F.sequence(F.lit(0), F.size("t") - 1, F.lit(FOLDED))
    before = lambda k: F.when(k > 0, F.get(F.col("t.role"), k - 1))
    parts = grouped.select("conv_id", F.transform(starts, lambda k: _merged(F.slice("t", k + 1, FOLDED), before(k), escape(F.lit(loss_role)))).alias("p"))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))
    offsets = F.aggregate("p", zero, lambda acc, x: F.struct((acc["at"] + x["at"]).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")))["out"]
    spans = F.zip_with("p", offsets, lambda x, o: F.transform(F.filter(x["out"], lambda y: y["loss"]), lambda y: F.struct((y["start"] + o).alias("start"), y["size"].alias("size"))))
    pieces = F.flatten(F.transform("p", lambda x: x["out"]["piece"]))
    return parts.select("conv_id", F.concat(F.array_join(pieces, ""), F.lit(END)).alias("formatted"), F.flatten(spans).alias("loss_spans"))


def _merged(turns: Column, before: Column, loss_role: Column) -> Column:
    """Folds sorted turns: a turn of the role before it joins that one's block, any other opens its own.

    ``before`` (role of the last turn), ``at`` (bytes so far) and ``out``: each turn's piece of the
    text, and where its own text lies.
    """

    def step(acc: Column, x: Column) -> Column:
        opening = F.concat(F.lit(START), x["role"], F.lit("\n"))
        lead = F.when(acc["before"].isNull(), opening).when(acc["before"] == x["role"], F.lit(TURN)).otherwise(F.concat(F.lit(END), opening))
        start, size = acc["at"] + F.octet_length(lead), F.octet_length(x["text"]).cast("long")
        piece = F.struct(F.concat(lead, x["text"]).alias("piece"), start.alias("start"), size.alias("size"), (x["role"] == loss_role).alias("loss"))
        return F.struct(x["role"].alias("before"), (start + size).alias("at"), F.array_append(acc["out"], piece).alias("out"))

    zero = F.struct(before.alias("before"), F.lit(0).cast("long").alias("at"), F.array().cast(_PIECES).alias("out"))
    return F.aggregate(turns, zero, step)


def parse_conversations(formatted: DataFrame) -> DataFrame:
    """Reads the texts back: ``conv_id, turns`` (role and text of each original turn) and ``loss`` (text under the mask).

    Rows are those of :func:`format_conversations`, repeated ones each for itself: a null id stays
    null, nulls that counted as empty come back empty, an empty table gives no rows.
    """
    blocks = F.filter(F.split("formatted", r"<\|im_end\|>\n", -1), lambda b: F.startswith(b, F.lit(START)))
    role_of = lambda b: unescape(F.replace(F.substring_index(F.substr(b, F.lit(len(START) + 1)), "\n", 1), F.lit(BREAK), F.lit("\n")))
    texts = lambda b: F.split(F.regexp_replace(b, r"^[^\n]*\n", ""), r"<\|turn\|>", -1)
    turns = F.flatten(F.transform(blocks, lambda b: F.transform(texts(b), lambda t: F.struct(role_of(b).alias("role"), unescape(t).alias("text")))))
    raw = F.col("formatted").cast("binary")
    masked = F.transform("loss_spans", lambda s: unescape(F.substr(raw, s["start"].cast("int") + 1, s["size"].cast("int")).cast("string")))
    return formatted.select("conv_id", turns.alias("turns"), F.array_join(masked, "").alias("loss"), "formatted")
