"""Multi-party chat formatting by perspective rotation.

Each dialogue is rendered once for every participant: that speaker's turns become
``assistant`` turns that are trained on, all other speakers become named ``user`` turns,
and ``system`` turns stay. A message is ::

    <|system|>\\n TEXT <|end|>\\n
    <|assistant|>\\n TEXT <|end|>\\n
    <|user|>NAME\\n TEXT <|end|>\\n

(without the blanks). ``<|`` in a text becomes ``< |``, so that no text can end a message.
The mask are the code point spans ``start-end`` of the assistant texts with their
``<|end|>``, counted from the start of the segment.

A dialogue is cut into segments of ``SEGMENT_TURNS`` turn numbers, so that no row grows
with a dialogue; a third of all rows in one dialogue is spread over its segments. Texts are
shuffled once, by dialogue and segment; repeated rows go before and behind that shuffle.
The perspectives of a segment come to it through the same grouping, as rows without
text: the pairs of a dialogue's segments and participants, of which the result has one row
each. Only behind the grouping is a segment repeated for its perspectives.

Results. Messages follow turn, speaker, text (nulls first). Exact repetitions of a row
count once. A null or empty speaker takes part as a user without a name and gets no
perspective; a null text is empty; null turns form segment -1, before the others. A
dialogue of system or nameless turns alone gives no rows. A null conv_id is a dialogue
like any other. An empty table gives no rows; further columns are not read, whatever their
names. A text is held once in a task with the other texts of its segment, and one rendering
at a time, however many speakers there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEGMENT_TURNS = 256
END = "<|end|>"


def rotate(turns: DataFrame, segment_turns: int = SEGMENT_TURNS) -> DataFrame:
    """``conv_id, perspective, segment, n_turns, n_trained, rendered, spans`` from
    ``conv_id, turn, role, text`` rows."""
    turn = F.col("turn").cast("bigint")
    segment = F.when(turn.isNull(), F.lit(-1)).otherwise(F.floor(F.greatest(F.lit(0), turn) / segment_turns)).cast("bigint")
    message = F.struct(turn.alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    texts = turns.select("conv_id", segment.alias("segment"), message.alias("message"), F.lit(None).cast("string").alias("perspective"))
    segments = texts.select("conv_id", "segment").distinct()
    speakers = turns.select(F.col("conv_id").alias("_conv"), F.col("role").cast("string").alias("perspective")).where("perspective <> '' and perspective <> 'system'").distinct()
    views = segments.join(speakers, F.col("conv_id").eqNullSafe(F.col("_conv"))).select("conv_id", "segment", F.lit(None).cast(texts.schema["message"].dataType).alias("message"), "perspective")
    together = texts.union(views).groupBy("conv_id", "segment").agg(F.array_sort(F.collect_set("message")).alias("messages"), F.collect_set("perspective").alias("perspectives"))
    viewed = together.select("conv_id", "segment", "messages", F.explode("perspectives").alias("perspective"))

    def shown(m):
        own = F.coalesce(m["role"] == F.col("perspective"), F.lit(False))
        header = (
            F.when(m["role"] == "system", "<|system|>\n")
            .when(own, "<|assistant|>\n")
            .otherwise(F.concat(F.lit("<|user|>"), F.coalesce(m["role"], F.lit("")), F.lit("\n")))
        )
        return F.struct(header.alias("header"), F.replace(F.coalesce(m["text"], F.lit("")), F.lit("<|"), F.lit("< |")).alias("body"), own.alias("own"))

    grouped = viewed.select("conv_id", "perspective", "segment", F.transform("messages", shown).alias("m"))

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(state, m):
        begin = state["at"] + F.length(m["header"])
        end = begin + F.length(m["body"]) + len(END)
        span = F.concat(begin.cast("string"), F.lit("-"), end.cast("string"))
        spans = F.when(m["own"], F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct((end + 1).cast("bigint").alias("at"), spans.alias("spans"))

    return grouped.select(
        "conv_id",
        "perspective",
        "segment",
        F.size("m").cast("bigint").alias("n_turns"),
        F.size(F.filter("m", lambda m: m["own"])).cast("bigint").alias("n_trained"),
        F.array_join(F.transform("m", lambda m: F.concat(m["header"], m["body"], F.lit(END + "\n"))), "").alias("rendered"),
        F.array_join(F.aggregate("m", start, step)["spans"], ",").alias("spans"),
    )
