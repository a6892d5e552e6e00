"""Chat formatting by perspective rotation, with DataFrame functions only.

For every participant of a conversation the dialogue is rendered with that speaker as the assistant, every other speaker
as a user with a name, and narrators (`system`) as system. The result has one row per message and perspective: the
rendered segment, where it starts and ends in the perspective's whole text, and the part a loss may see: the assistant's
words with the end mark. The segments of a perspective, joined by position, are its text, so a conversation of any
length is formatted without being gathered.

Offsets are running sums. Rows are range-partitioned by (conversation, perspective, order), summed inside the pieces of a
partition and shifted by the totals of earlier pieces: a conversation that holds a third of all rows spans many pieces.

Order is turn (nulls first), speaker, text; rows equal in all three are repeated messages and all stay. A null text is an
empty message, a null or empty role the speaker `unknown`; rows with a null conversation id take no part; a conversation
with narrators only has no perspective. `<|` in texts and names is written `<\\|`, line feeds in names are spaces, so
content never makes a mark. Other columns of the input, whatever their names, are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casegraph.llm.common import cut

HEADS = {"assistant": "<|assistant|>\n", "user": "<|user|>\n", "system": "<|system|>\n"}
END = "<|end|>"


def _safe(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("<\\|"))


def messages(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    name = F.when(F.length(F.col(role)) > 0, F.col(role)).otherwise(F.lit("unknown"))
    return df.select(
        F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.replace(_safe(name), F.lit("\n"), F.lit(" ")).alias("speaker"),
        _safe(F.coalesce(F.col(text), F.lit(""))).alias("said"),
    ).filter(F.col("conv_id").isNotNull())


def perspectives(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                 narrators: tuple[str, ...] = ("system",)) -> DataFrame:
    """(conv_id, perspective, position, turn, speaker, shown_as, segment, seg_start, seg_end, mask_start, mask_end)."""
    said = messages(df, conv, turn, role, text)
    people = cut(said.filter(~F.col("speaker").isin(*narrators)).select("conv_id", F.col("speaker").alias("perspective")).distinct())
    shown = F.when(F.col("speaker").isin(*narrators), "system").when(F.col("speaker") == F.col("perspective"), "assistant").otherwise("user")
    head = F.when(F.col("shown_as") == "assistant", HEADS["assistant"]).when(F.col("shown_as") == "system", HEADS["system"]).otherwise(
        F.concat(F.lit(HEADS["user"]), F.col("speaker"), F.lit(": ")))
    rendered = said.join(people, "conv_id").withColumn("shown_as", shown).withColumn("segment", F.concat(head, "said", F.lit(END + "\n")))

    group, order = ["conv_id", "perspective"], ["turn", "speaker", "said"]
    ranged = cut(
        rendered.withColumn("size", F.length("segment").cast("long"))
        .repartitionByRange(*group, *order).withColumn("piece", F.spark_partition_id()))
    inside = Window.partitionBy(*group, "piece").orderBy(*order)
    earlier = Window.partitionBy(*group).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = ranged.groupBy(*group, "piece").agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n")).select(
        *group, "piece", F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("shift"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("skip"))
    placed = (
        ranged.withColumn("rank", F.row_number().over(inside))
        .withColumn("upto", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .join(pieces, [*group, "piece"])
    )
    end = F.col("shift") + F.col("upto")
    own = F.col("shown_as") == "assistant"
    return placed.select(
        "conv_id", "perspective", (F.col("skip") + F.col("rank") - 1).alias("position"), "turn", "speaker", "shown_as", "segment",
        (end - F.col("size")).alias("seg_start"), end.alias("seg_end"),
        F.when(own, end - F.col("size") + len(HEADS["assistant"])).alias("mask_start"), F.when(own, end - 1).alias("mask_end"))
