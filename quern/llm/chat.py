"""Chat formatting by perspective rotation (operator 1), with DataFrame functions only.

For each participant of a conversation the dialogue is rendered with that speaker as the assistant, all
others as users with their names, and system messages as they are. The mask trains on the speaker's own
words and end marks only. A rendering comes in parts of TURNS turn numbers, in order, so that no row or
group grows with the length of a conversation; parts are concatenated to the whole.

Messages of a part are ordered by turn, role, text; repeated rows stay. A part of over MOST messages (many rows of
one turn number, say, or of no turn or conversation) comes in pieces, so that none is collected whole: by turn, then by
a hash of role and text, then by MOST copies of the same message. Pieces are concatenated in the order of `piece`
(empty for a whole part); within one, messages are ordered as in a part.

Null role: "unknown"; null text: empty; null turn: the last part, numbered -1. Null conversation ids are one
conversation. Marks inside a text or name are broken up, so that no message can forge a header. Only-system
conversations give no rows, and neither does an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import stored

TURNS, MOST, SYSTEM = 64, 4096, "system"
BROADCAST_ROWS = 100_000
START, END = "<|im_start|>", "<|im_end|>"


def safe(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def _parts(said: DataFrame, most: int) -> DataFrame:
    """conv_id, part, piece, messages from conv_id, part, m."""
    whole = lambda df: df.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list("m")).alias("messages")).withColumn("piece", F.expr("array()").cast("array<bigint>"))
    large = stored(said.groupBy("conv_id", "part").agg(F.count("*").alias("size")).filter(F.col("size") > most)).withColumnsRenamed({"conv_id": "__conv", "part": "__part"})
    n = large.count()
    if not n:
        return whole(said)
    sized = said.join(F.broadcast(large) if n <= BROADCAST_ROWS else large, F.col("conv_id").eqNullSafe(F.col("__conv")) & (F.col("part") == F.col("__part")), "left")
    copies = sized.filter("size is not null").groupBy("conv_id", "part", "size", "m").agg(F.count("*").alias("copies"))
    copies = copies.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / most))))
    each = F.array_repeat("m", F.least(F.lit(most).cast("long"), F.col("copies") - F.col("chunk") * most).cast("int"))
    bucket = F.pmod(F.xxhash64("m.role", "m.text"), F.ceil(F.col("size") / most))
    piece = F.array(F.coalesce("m.turn", F.lit(-1).cast("long")), bucket, F.col("chunk"))
    pieces = copies.select("conv_id", "part", piece.alias("piece"), each.alias("each")).groupBy("conv_id", "part", "piece").agg(F.sort_array(F.flatten(F.collect_list("each"))).alias("messages"))
    return whole(sized.filter("size is null")).unionByName(pieces)


def rotate(conversations: DataFrame, turns: int = TURNS, most: int = MOST) -> DataFrame:
    """conv_id, perspective, part, piece, n_messages, text, mask (runs of characters: n, train)."""
    said = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.coalesce(F.floor(F.col("turn") / turns).cast("long"), F.lit(-1)).alias("part"),
        F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("m"),
    )
    speakers = said.select(F.col("conv_id").alias("__conv"), F.col("m.role").alias("perspective")).filter(F.col("perspective") != SYSTEM).distinct()
    each = _parts(said, most).join(speakers, F.col("conv_id").eqNullSafe(F.col("__conv"))).drop("__conv")

    def pieces(m: Column) -> Column:
        own = m.role == F.col("perspective")
        name = F.when(own, F.lit("assistant")).when(m.role == SYSTEM, F.lit(SYSTEM)).otherwise(F.concat(F.lit("user name="), F.translate(safe(m.role), "\n", " ")))
        head, body = F.concat(F.lit(START), name, F.lit("\n")), F.concat(safe(m.text), F.lit(END))
        return F.array(F.struct(head.alias("text"), F.lit(False).alias("train")), F.struct(body.alias("text"), own.alias("train")), F.struct(F.lit("\n").alias("text"), F.lit(False).alias("train")))

    rendered = each.withColumn("pieces", F.flatten(F.transform("messages", pieces)))
    return rendered.select(
        "conv_id",
        "perspective",
        "part",
        "piece",
        F.size("messages").cast("long").alias("n_messages"),
        F.array_join(F.transform("pieces", lambda p: p.text), "").alias("text"),
        F.transform("pieces", lambda p: F.struct(F.length(p.text).alias("n"), p.train.alias("train"))).alias("mask"),
    )
