"""Chat formatting by multi-party perspective rotation, in DataFrame operations alone.

For every participant of a dialogue the dialogue is rendered once, with that speaker as the assistant and the others as named users.
The rendering has a row for each message, so a dialogue of any length is never gathered in one task: a message's place among its
dialogue's characters is summed in blocks of messages first, then over the blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

SYSTEM, END = "system", "<|end|>"
#: Turns of a dialogue in a block: a task orders the messages of one block, and the sums of a dialogue's blocks.
BLOCK = 256
NO_TURN = -(2**62)


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row for each message and perspective of its dialogue.

    perspective (the speaker who is the assistant), conv_id, turn, nth (from 0; order of turn, nulls first, then speaker and text),
    role, name, rendered, start (its first character in the dialogue's rendering), loss (whether the message is learnt from) and
    loss_start, loss_end (the characters of the rendering that are, else -1). A message is rendered as ``<|role|>`` or ``<|user name=NAME|>``,
    a line feed, the text, ``<|end|>`` and a line feed; text and end of the perspective's own messages are learnt from.

    Participants are the dialogue's speakers but ``system``, whose messages stay as they are. A null speaker takes part under the
    name ``unknown``, a null text is empty. A dialogue of system messages alone has no rendering. Repeated rows are messages of their
    own; rows without a dialogue form one. Extra columns are ignored.
    """
    said = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(speaker_col), F.lit("unknown")).alias("speaker"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        F.coalesce(F.floor(F.col(turn_col) / BLOCK), F.lit(NO_TURN)).alias("block"),
    )
    parts = said.where(F.col("speaker") != SYSTEM).select(F.col("conv_id").alias("own"), F.col("speaker").alias("perspective")).distinct()
    rows = said.join(parts, F.col("conv_id").eqNullSafe(F.col("own"))).drop("own")

    is_system, loss = F.col("speaker") == SYSTEM, F.col("speaker") == F.col("perspective")
    role = F.when(is_system, SYSTEM).when(loss, "assistant").otherwise("user")
    name = F.when(~is_system & ~loss, F.col("speaker"))
    head = F.concat(F.lit("<|"), role, F.coalesce(F.concat(F.lit(" name="), name), F.lit("")), F.lit("|>\n"))
    rows = rows.withColumns({"role": role, "name": name, "loss": loss, "head": head})
    rows = rows.withColumn("rendered", F.concat("head", "text", F.lit(f"{END}\n"))).withColumn("chars", F.length("rendered").cast("long"))

    here = ["conv_id", "perspective", "block"]
    order = Window.partitionBy(*here).orderBy(F.col("turn").asc_nulls_first(), "speaker", "text")
    rows = rows.withColumns({"at": F.sum("chars").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("chars"), "k": F.row_number().over(order) - 1})
    blocks = Window.partitionBy("conv_id", "perspective").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*here).agg(F.sum("chars").alias("chars"), F.count("*").alias("n"))
    first = lambda c: F.coalesce(F.sum(c).over(blocks), F.lit(0).cast("long"))
    sums = sums.select(F.col("conv_id").alias("c"), F.col("perspective").alias("p"), F.col("block").alias("b"), first("chars").alias("chars_before"), first("n").alias("before"))
    rows = rows.join(sums, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("perspective") == F.col("p")) & (F.col("block") == F.col("b")))

    start = F.col("chars_before") + F.col("at")
    return rows.select(
        "conv_id",
        "perspective",
        "turn",
        (F.col("before") + F.col("k")).alias("nth"),
        "role",
        "name",
        "rendered",
        start.alias("start"),
        "loss",
        F.when(F.col("loss"), start + F.length("head")).otherwise(-1).alias("loss_start"),
        F.when(F.col("loss"), start + F.length("rendered") - 1).otherwise(-1).alias("loss_end"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, for every participant."""
    return rotate(table(spark, sf_dir, "conversations"))


#: The same rows, without blocks: one running sum over each dialogue and perspective.
SQL = """
with said as (
  select conv_id, turn, coalesce(role, 'unknown') as speaker, coalesce(text, '') as text from conversations
), parts as (
  select distinct conv_id as own, speaker as perspective from said where speaker <> 'system'
), shown as (
  select conv_id, perspective, turn, speaker, text, speaker = perspective as loss,
    case when speaker = 'system' then 'system' when speaker = perspective then 'assistant' else 'user' end as role,
    case when speaker <> 'system' and speaker <> perspective then speaker end as name
  from said join parts on conv_id is not distinct from own
), headed as (
  select *, '<|' || role || coalesce(' name=' || name, '') || '|>' || chr(10) as head from shown
), rendered as (
  select *, head || text || '<|end|>' || chr(10) as rendered from headed
), placed as (
  select *, row_number() over w - 1 as nth, cast(sum(length(rendered)) over w - length(rendered) as bigint) as start
  from rendered window w as (partition by conv_id, perspective order by turn nulls first, speaker, text rows unbounded preceding)
)
select conv_id, perspective, turn, nth, role, name, rendered, start, loss,
  case when loss then start + length(head) else -1 end as loss_start,
  case when loss then start + length(rendered) - 1 else -1 end as loss_end
from placed
"""
