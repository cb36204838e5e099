"""Multi-party dialogues from the perspective of every participant, with loss masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Marks of the chat template.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def rotate_perspectives(turns: DataFrame, narrator: str = "system") -> DataFrame:
    """One row per turn and participant of ``turns(conv_id, turn, role, text)``.

    Participants are the different speakers of a conversation but the narrator, null speakers among
    them as one named ``unknown``; each becomes the assistant once (``perspective``), and the others are
    users who carry their names. The narrator's turns stay system turns; a conversation with none but
    the narrator has no perspective. ``rendered`` is the turn in chat markup; a dialogue is the
    concatenation over ``turn`` (ties: by speaker and text). ``mask`` has a 1 where the loss counts, as a
    start and a length in characters of ``rendered``: the assistant's words and end mark. Null texts are
    empty; null conversations belong together; repeated rows are separate turns; other columns are
    ignored, and an empty table gives no rows.
    """
    speaker = F.coalesce(F.col("role").cast("string"), F.lit("unknown"))
    lines = turns.select("conv_id", "turn", speaker.alias("speaker"), F.coalesce("text", F.lit("")).alias("text"))
    # a null id is a conversation of its own; the set of speakers is combined before the shuffle
    people = (lines.where(F.col("speaker") != narrator).groupBy("conv_id")
              .agg(F.array_sort(F.collect_set("speaker")).alias("people"))
              .withColumnRenamed("conv_id", "_llm_conv"))
    same = F.col("conv_id").eqNullSafe(F.col("_llm_conv"))
    rotated = lines.join(people, same).withColumn("perspective", F.explode("people"))
    own, told = F.col("speaker") == F.col("perspective"), F.col("speaker") == narrator
    role = F.when(told, "system").when(own, "assistant").otherwise("user")
    name = F.when(~told & ~own, F.col("speaker"))
    head = F.concat(F.lit(OPEN), role, F.coalesce(F.concat(F.lit(" name="), name), F.lit("")), F.lit("\n"))
    return rotated.select(
        "conv_id", "perspective", "turn", "speaker", role.alias("role"), name.alias("name"),
        F.concat(head, F.col("text"), F.lit(CLOSE)).alias("rendered"),
        F.when(own, F.char_length(head)).otherwise(0).alias("mask_start"),
        F.when(own, F.char_length("text") + len(CLOSE) - 1).otherwise(0).alias("mask_length"))


def loss_mask(rendered: Column, start: Column, length: Column) -> Column:
    """The mask as a string of 0 and 1, one per character."""
    return F.concat(F.repeat(F.lit("0"), start), F.repeat(F.lit("1"), length),
                    F.repeat(F.lit("0"), F.char_length(rendered) - start - length))
