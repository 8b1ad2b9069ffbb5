"""Chat formatting by perspective rotation: every participant of a dialogue becomes the assistant once, the others named users.

A message is rendered as ``OPEN`` + header + line feed + text + ``CLOSE`` + line feed. The header is ``assistant`` for the speaker of
the perspective, ``user name=<role>`` for other participants, and ``system`` for ``SYSTEM``, which gets no perspective of its own. The
mask lists the [start, end) code points to learn: the speaker's texts with their ``CLOSE``. ``<|`` inside a text becomes ``<\\|``, so that
texts cannot hold markers; names are reduced to letters, digits, ``_`` and ``-``.

Dialogues are cut into parts of ``PART`` turn numbers, ``part`` = turn / PART, so that no dialogue, however long, has to fit one row or
one task; shorter ones are a single part 0. Spark functions only: one join of messages with their dialogue's participants, one grouping.

Nulls and edges: a null conv_id is a dialogue of its own; a null role is the participant ``unknown``; a null text is empty; messages
with a null turn form the part null; rows equal in conv_id, turn, role and text are deliveries of one message, and within one turn
messages go by role and text; a dialogue with only system messages has no perspective. Extra columns are ignored.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, SYSTEM = "<|im_start|>", "<|im_end|>", "system"
PART = 64


def perspectives(messages: DataFrame, part: int = PART) -> DataFrame:
    """(conv_id, speaker, part, text, mask, n_messages, n_learned): one row per participant and part of a dialogue."""
    role = F.coalesce(F.col("role"), F.lit("unknown"))
    clean = F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("<\\|"))
    rows = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), clean.alias("text")).distinct()
    speakers = rows.where(F.col("role") != SYSTEM).select(F.col("conv_id").alias("c"), F.col("role").alias("speaker")).distinct()
    joined = rows.join(speakers, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    name = F.regexp_replace("role", r"[^\p{L}\p{N}_-]+", "_")
    own = F.col("role") == F.col("speaker")
    header = F.when(own, "assistant").when(F.col("role") == SYSTEM, SYSTEM).otherwise(F.concat(F.lit("user name="), name))
    head = F.concat(F.lit(OPEN), header, F.lit("\n"))
    message = F.struct(F.col("turn").isNull().alias("late"), "turn", "role", F.col("text").alias("raw"), F.concat(head, "text", F.lit(CLOSE + "\n")).alias("shown"), F.when(own, F.length(head)).alias("skip"))
    whole = joined.groupBy("conv_id", "speaker", F.floor(F.col("turn") / part).cast("long").alias("part")).agg(F.sort_array(F.collect_list(message)).alias("m"))
    spans = F.aggregate(
        "m", F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("mask")),
        lambda a, m: F.struct((a["at"] + F.length(m["shown"])).alias("at"), F.when(m["skip"].isNull(), a["mask"]).otherwise(F.concat(a["mask"], F.array(F.struct(
            (a["at"] + m["skip"]).alias("start"), (a["at"] + F.length(m["shown"]) - 1).alias("end"))))).alias("mask")), lambda a: a["mask"])
    return whole.select("conv_id", "speaker", "part", F.concat_ws("", F.transform("m", lambda m: m["shown"])).alias("text"), spans.alias("mask"),
                        F.size("m").cast("long").alias("n_messages")).withColumn("n_learned", F.size("mask").cast("long"))
