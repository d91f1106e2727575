"""Chat formatting by prefix-target expansion.

Each assistant turn becomes one training example: all turns before it as context and its reply as the
only trainable part. A turn is written ``<s>[INST]role[/INST]text</s>``. Where a role or text holds a
control string, with any number of backslashes after its first character, one more backslash is put
there; taking one away restores the text, so formatting is reversible for every text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TAIL = r"(/?(?:s>|INST\]))"
_END = "</s>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + _TAIL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _TAIL, "$1$2$3")


def expand(conversations: DataFrame) -> DataFrame:
    """(conv_id, example, n_turns, text, loss_start, loss_end) from (conv_id, turn, role, text).

    Examples are numbered from 1 in each conversation. The characters [loss_start, loss_end) of ``text``,
    counted in code points from 0, are trainable. Turns after the last reply, or a conversation without
    one, give a last example with nothing trainable (both offsets at its end), so that no turn is lost.
    Turns are ordered by turn, role and text, nulls first; repeated turns stay. A null role or text is
    empty; rows with a null conv_id form one conversation. Other columns don't matter. An empty table
    gives an empty result. A conversation's turns meet in one row, as its longest example, which is one row
    of the result, holds them all anyway; texts are written whole however long they are.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = conversations.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t"), _in_order).alias("turns"))
    head = F.transform("turns", lambda t: F.concat(F.lit("<s>[INST]"), escape(t["role"]), F.lit("[/INST]")))
    turns = turns.withColumn("head", head)
    turns = turns.withColumn("piece", F.transform(F.arrays_zip("turns", "head"), lambda p: F.concat(p["head"], escape(p["turns"]["text"]), F.lit(_END))))
    ends = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: (F.element_at("turns", i)["role"] == "assistant") | (i == F.size("turns")))
    out = turns.select("*", F.posexplode(ends).alias("at", "i"))
    text = F.array_join(F.slice("piece", F.lit(1), F.col("i")), "")
    size = F.length("text")
    before = size - F.length(F.element_at("piece", F.col("i")))
    reply = F.element_at("turns", F.col("i"))["role"] == "assistant"
    return out.withColumn("text", text).select(
        "conv_id",
        (F.col("at") + 1).alias("example"),
        F.col("i").alias("n_turns"),
        "text",
        F.when(reply, before + F.length(F.element_at("head", F.col("i")))).otherwise(size).alias("loss_start"),
        F.when(reply, size - len(_END)).otherwise(size).alias("loss_end"),
    )


def _in_order(x: Column, y: Column) -> Column:
    """Compares two turns; nulls come first."""
    equal = F.lit(0)
    for c in ("text", "role", "turn"):
        a, b = x[c], y[c]
        less = (a < b) | (a.isNull() & b.isNotNull())
        more = (a > b) | (a.isNotNull() & b.isNull())
        equal = F.when(F.coalesce(less, F.lit(False)), -1).when(F.coalesce(more, F.lit(False)), 1).otherwise(equal)
    return equal


def read_back(examples: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_texts, formatted_chars) parsed from the formatted text of ``expand``.

    ``turns`` are the (role, text) of the conversation's longest example, ``loss_texts`` the unescaped
    trainable parts in the order of the examples, ``formatted_chars`` the characters of all examples.
    """
    loss = unescape(F.substring("text", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))
    rows = examples.select("conv_id", "example", "text", F.struct("example", loss.alias("loss")).alias("l"), F.length("text").cast("long").alias("chars"), (F.col("loss_end") > F.col("loss_start")).alias("some"))
    out = rows.groupBy("conv_id").agg(
        F.max_by("text", "example").alias("text"),
        F.array_sort(F.collect_list(F.when(F.col("some"), F.col("l")))).alias("losses"),
        F.sum("chars").alias("formatted_chars"),
    )
    turn = r"(?s)<s>\[INST\](.*?)\[/INST\](.*?)</s>"
    parts = F.arrays_zip(F.regexp_extract_all("text", F.lit(turn), 1).alias("role"), F.regexp_extract_all("text", F.lit(turn), 2).alias("text"))
    return out.select(
        "conv_id",
        F.transform(parts, lambda p: F.struct(unescape(p["role"]).alias("role"), unescape(p["text"]).alias("text"))).alias("turns"),
        F.transform("losses", lambda x: x["loss"]).alias("loss_texts"),
        "formatted_chars",
    )
