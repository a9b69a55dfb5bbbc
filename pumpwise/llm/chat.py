"""Chat formatting by perspective rotation: each participant in turn is the assistant, the others are named users."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pumpwise.llm.common import read_table

#: Roles that set the scene and are never anyone's own voice.
SCENE_ROLES = ("system",)
#: Marks around a message.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: What starts a mark; in a text or name a bar more follows it, so that neither can hold a mark.  Taking that bar away gives the text back.
MARK_START, ESCAPED_START = "<|", "<||"
#: Turns whose lengths are summed together before the offsets of a dialogue are.
TURNS_PER_BLOCK = 64


def escaped(text: Column) -> Column:
    """A text in which nothing reads as a mark."""
    return F.replace(text, F.lit(MARK_START), F.lit(ESCAPED_START))


def escaped_name(name: Column) -> Column:
    """A name that neither holds a mark nor ends its line: a backslash is doubled, line breaks are \\n and \\r."""
    for raw, written in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r")):
        name = F.replace(name, F.lit(raw), F.lit(written))
    return escaped(name)


def rotate_perspectives(
    messages: DataFrame, scene_roles: tuple[str, ...] = SCENE_ROLES,
    conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """One row per dialogue, perspective and message, with the rendered text and its place in the rendered dialogue.

    Columns conv, perspective, turn, role, name, rendered, start, stop, mask_start,
    mask_stop.  For every participant (a role of the dialogue that is not a
    scene role) the dialogue is rendered once: the participant's messages as assistant, those of
    others as user with their name, scene messages as they are.  Joined in the order of
    start, the rows' rendered texts are the dialogue; start and stop are offsets in
    code points.  The loss mask is [mask_start, mask_stop): the participant's own words and the closing
    mark; null for other messages.  Texts and names are escaped where they are rendered (see escaped, escaped_name), so that no message can
    forge a turn; name has the speaker as it is.

    Messages are ordered by turn, then role, then text; equal rows are all kept.  A null turn comes
    first, a null role is the participant 'unknown', a null text is empty; messages of a null conv are one dialogue.  A dialogue of scene messages only has no participants and gives no rows.  Offsets
    are summed per block of turns and then over blocks, so a long dialogue is not gathered in
    one task; the messages of one block, and those of one dialogue without a turn, are put in order in one.  Very long texts are taken whole.
    An empty table gives no rows.  Other columns are ignored.
    """
    rows = messages.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("unknown")).alias("speaker"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    voices = rows.where(~F.col("speaker").isin(*scene_roles)).select(
        F.col("conv").alias("c"), F.col("speaker").alias("perspective")
    ).distinct()
    both = rows.join(voices, F.col("conv").eqNullSafe(F.col("c"))).drop("c")
    own, scene = F.col("speaker") == F.col("perspective"), F.col("speaker").isin(*scene_roles)
    role = F.when(own, "assistant").when(scene, F.col("speaker")).otherwise("user")
    name = F.when(~own & ~scene, F.col("speaker"))
    head = F.concat(F.lit(OPEN), role, F.coalesce(F.concat(F.lit(" name="), escaped_name(name)), F.lit("")), F.lit("\n"))
    both = both.select(
        "conv", "perspective", "turn", "speaker", "text", role.alias("role"), name.alias("name"), own.alias("own"),
        F.length(head).alias("head"), F.concat(head, escaped(F.col("text")), F.lit(CLOSE)).alias("rendered"),
        F.coalesce(F.floor(F.col("turn") / TURNS_PER_BLOCK), F.lit(-(2**62))).alias("block"),
    ).withColumn("size", F.length("rendered").cast("long"))

    dialogue = "PARTITION BY conv, perspective"
    earlier = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    blocks = both.groupBy("conv", "perspective", "block").agg(F.sum("size").alias("n"))
    blocks = blocks.withColumn("before", F.expr(f"coalesce(sum(n) OVER ({dialogue} ORDER BY block {earlier}), 0L)"))
    blocks = blocks.select(F.col("conv").alias("c"), F.col("perspective").alias("p"), F.col("block").alias("b"), "before")
    at = F.col("conv").eqNullSafe(F.col("c")) & (F.col("perspective") == F.col("p")) & (F.col("block") == F.col("b"))
    order = f"PARTITION BY conv, perspective, block ORDER BY turn NULLS FIRST, speaker, text {earlier}"
    placed = both.join(blocks, at).withColumn("start", F.expr(f"before + coalesce(sum(size) OVER ({order}), 0L)"))
    return placed.select(
        F.col("conv").alias(conv_col), "perspective", F.col("turn").alias(turn_col), "role", "name", "rendered", "start",
        (F.col("start") + F.col("size")).alias("stop"),
        F.when(F.col("own"), F.col("start") + F.col("head")).alias("mask_start"),
        F.when(F.col("own"), F.col("start") + F.col("size") - (len(CLOSE) - len(CLOSE.rstrip()))).alias("mask_stop"),
    )


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message of every dialogue as rendered from each participant's perspective, with offsets and loss masks."""
    return rotate_perspectives(read_table(spark, sf_dir, "conversations"))


_NAME = rf"replace(replace(replace(replace(name, '\', '\\'), chr(10), '\n'), chr(13), '\r'), '{MARK_START}', '{ESCAPED_START}')"
_SCENE = ", ".join(f"'{x}'" for x in SCENE_ROLES)
SQL = f"""
WITH m AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations),
v AS (SELECT DISTINCT conv_id, speaker AS perspective FROM m WHERE speaker NOT IN ({_SCENE})),
b AS (SELECT conv_id, perspective, turn, speaker, text, speaker = perspective AS own,
             CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker IN ({_SCENE}) THEN speaker ELSE 'user' END AS role,
             CASE WHEN speaker <> perspective AND speaker NOT IN ({_SCENE}) THEN speaker END AS name
      FROM m JOIN v USING (conv_id)),
h AS (SELECT *, '{OPEN}' || role || coalesce(' name=' || {_NAME}, '') || chr(10) AS head FROM b),
r AS (SELECT *, head || replace(text, '{MARK_START}', '{ESCAPED_START}') || '{CLOSE.rstrip()}' || chr(10) AS rendered FROM h),
s AS (SELECT *, CAST(sum(length(rendered)) OVER (PARTITION BY conv_id, perspective ORDER BY turn, speaker, text ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stop FROM r)
SELECT conv_id, perspective, turn, role, name, rendered, stop - length(rendered) AS start, stop,
       CASE WHEN own THEN stop - length(rendered) + length(head) END AS mask_start, CASE WHEN own THEN stop - 1 END AS mask_stop
FROM s
"""
