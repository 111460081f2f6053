"""Chat formatting by multi-party perspective rotation.

For every participant of a conversation the whole dialogue is rendered once with that participant as the assistant and
all others as named users. A dialogue of any length stays rows: one per turn and perspective, with its rendered text and
the character places of the text and of the part that counts for the loss, so no task ever holds a conversation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assay.llm.registry import query, table
from assay.llm.storage import partitions, written

# The marks of the rendered form.
HEAD_ASSISTANT, HEAD_OTHER, HEAD_CLOSE, TURN_CLOSE = "<|assistant|>\n", "<|user ", "|>\n", "<|end|>\n"
SYSTEM = "system"


def rotated(conversations: DataFrame) -> DataFrame:
    """Every turn of every conversation under every perspective.

    ``conversations`` needs (conv_id, turn, role, text). Result: conv_id, perspective (the participant rendered as
    assistant), seq (from 0 in the dialogue), turn, chat_role (assistant, user or system), name (of the speaker),
    segment (rendered text), start and end (its characters in the dialogue), loss_start and loss_end (characters the
    loss counts: text and end mark of the assistant's turns; equal where there are none).

    Participants are the distinct roles but "system", whose turns are instructions in every perspective. A null role is
    named "unknown", a null text is empty, rows without conv_id form one conversation. Turns are in the order of
    ``turn`` (nulls first), ties in the order of the rows, repeated rows stay. A conversation without participants has
    no perspective.
    """
    spark = conversations.sparkSession
    speaker = F.coalesce("role", F.lit("unknown"))
    text = F.coalesce("text", F.lit(""))
    base = conversations.select(
        F.col("conv_id").alias("conv"), "turn", speaker.alias("speaker"), text.alias("body"), F.monotonically_increasing_id().alias("row")
    )
    # Ranges of (conversation, turn): a conversation of any size spreads over many. Written, as ranges may differ if drawn again.
    base = base.repartitionByRange(partitions(spark), "conv", "turn", "row").withColumn("part", F.spark_partition_id())
    as_other = F.when(F.col("speaker") == SYSTEM, F.lit("<|system|>\n")).otherwise(F.concat(F.lit(HEAD_OTHER), "speaker", F.lit(HEAD_CLOSE)))
    tail = F.length("body") + len(TURN_CLOSE)
    base = written(base.withColumn("other", (F.length(as_other) + tail).cast("long")).withColumn("own", (F.lit(len(HEAD_ASSISTANT)) + tail).cast("long")), "turns")
    people = base.where(F.col("speaker") != SYSTEM).select(F.col("conv").alias("c"), F.col("speaker").alias("perspective")).distinct()
    people = written(people, "participants")

    # What lies before each part of a conversation, by perspective: sums per part, never rows.
    sums = [F.sum("other").alias("other"), F.sum("own").alias("own"), F.count("*").alias("n")]
    spoken = base.groupBy("part", "conv", "speaker").agg(*sums)
    parts = spoken.groupBy("part", "conv").agg(F.sum("other").alias("size"), F.sum("n").alias("n"))
    seen = parts.join(people, F.col("conv").eqNullSafe(F.col("c"))).drop("c")
    mine = spoken.select(F.col("part").alias("p"), F.col("conv").alias("c"), F.col("speaker").alias("s"), (F.col("own") - F.col("other")).alias("more"))
    seen = seen.join(mine, (F.col("part") == F.col("p")) & F.col("conv").eqNullSafe(F.col("c")) & (F.col("perspective") == F.col("s")), "left")
    before = Window.partitionBy("conv", "perspective").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    size = F.col("size") + F.coalesce("more", F.lit(0))
    carries = seen.select(
        F.col("part").alias("p"), F.col("conv").alias("c"), F.col("perspective").alias("s"),
        F.coalesce(F.sum(size).over(before), F.lit(0)).alias("offset"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rank"),
    )

    turned = base.join(people, F.col("conv").eqNullSafe(F.col("c"))).drop("c")
    is_own = F.col("speaker") == F.col("perspective")
    turned = turned.withColumn("len", F.when(is_own, F.col("own")).otherwise(F.col("other")))
    within = Window.partitionBy("part", "conv", "perspective").orderBy("turn", "row")
    turned = turned.withColumn("upto", F.sum("len").over(within.rowsBetween(Window.unboundedPreceding, 0))).withColumn("at", F.row_number().over(within) - 1)
    placed = turned.join(carries, (F.col("part") == F.col("p")) & F.col("conv").eqNullSafe(F.col("c")) & (F.col("perspective") == F.col("s")))
    end = F.col("offset") + F.col("upto")
    return placed.select(
        F.col("conv").alias("conv_id"),
        "perspective",
        (F.col("rank") + F.col("at")).alias("seq"),
        "turn",
        F.when(is_own, F.lit("assistant")).when(F.col("speaker") == SYSTEM, F.lit(SYSTEM)).otherwise(F.lit("user")).alias("chat_role"),
        F.col("speaker").alias("name"),
        F.concat(F.when(is_own, F.lit(HEAD_ASSISTANT)).otherwise(as_other), "body", F.lit(TURN_CLOSE)).alias("segment"),
        (end - F.col("len")).alias("start"),
        end.alias("end"),
        F.when(is_own, end - F.length("body") - len(TURN_CLOSE)).otherwise(end).alias("loss_start"),
        end.alias("loss_end"),
    )


@query(
    "op2_perspective_rotation",
    """
    WITH turns AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS body FROM conversations),
    people AS (SELECT DISTINCT conv_id, speaker AS perspective FROM turns WHERE speaker <> 'system'),
    told AS (SELECT conv_id, perspective, turn, speaker, body, speaker = perspective AS own,
        CASE WHEN speaker = perspective THEN '<|assistant|>' || chr(10) WHEN speaker = 'system' THEN '<|system|>' || chr(10)
            ELSE '<|user ' || speaker || '|>' || chr(10) END || body || '<|end|>' || chr(10) AS segment
        FROM turns JOIN people USING (conv_id)),
    placed AS (SELECT *, row_number() OVER w - 1 AS seq, sum(length(segment)) OVER w AS upto
        FROM told WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn ROWS UNBOUNDED PRECEDING))
    SELECT conv_id, perspective, seq, turn, CASE WHEN own THEN 'assistant' WHEN speaker = 'system' THEN 'system' ELSE 'user' END AS chat_role,
        speaker AS name, segment, (upto - length(segment))::BIGINT AS start, upto::BIGINT AS "end",
        (CASE WHEN own THEN upto - length(body) - 8 ELSE upto END)::BIGINT AS loss_start, upto::BIGINT AS loss_end
    FROM placed
    """,
)
def op2_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotated(table(spark, sf_dir, "conversations"))
