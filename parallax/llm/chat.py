"""Multi-party perspective rotation of conversations.

Every participant of a conversation gets a rendering in which their own turns are the
assistant's and all others are named users. A rendering is a sequence of segments, one row per
turn, with character offsets and loss masks, so that a conversation of any length is spread
over many tasks and no rendering is ever gathered in one; joined in order, the segments are
the rendered text.

A segment is `<|im_start|>role name=speaker\\n` + text + `<|im_end|>\\n`, without the name for the
assistant and for system turns. System turns are shown to all and are nobody's perspective.
The mask covers the text and end mark of the assistant's segments.

Nothing that is said can forge a segment: a mark inside a text or name gets one more bar
(`<||im_end|>`; a mark that had n bars has n + 1, so that the original can be restored), and line
breaks inside a name become blanks.

Defined cases: a null text is empty; a null or empty role speaks as `unknown`; null conv_id or
turn count as conversation or turn -1; turns of equal number are ordered by a hash of speaker and
text; repeated rows are repeated turns, counted before anything is numbered; a conversation with
system turns only has no renderings; a text of any length is one segment; an empty table gives no
rows; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parallax.llm.common import materialise, prefix_sum

SYSTEM, UNKNOWN = "system", "unknown"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: A mark with one bar or more. Turn numbers of one block of the offset sums; repeated rows that are written out at once.
MARK, BLOCK, REPEATS = r"<(\|+im_(?:start|end)\|>)", 4096, 1 << 16


def unforged(said: Column) -> Column:
    return F.regexp_replace(said, MARK, "<|$1")


def rotate(turns: DataFrame) -> DataFrame:
    """(conv_id, perspective, seq, turn, role, name, segment, start_char, end_char, mask_start, mask_end) of each turn in each rendering.

    Masks are character offsets in the rendering, null where nothing is learned. Equal rows travel
    as one row with their number; offsets are summed over turn numbers, then over hashes within a
    turn, so that neither a conversation nor a turn number with a third of all rows meets in one task.
    """
    said = turns.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(-1)).alias("conv_id"), F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"),
        F.coalesce(F.nullif(F.col("role").cast("string"), F.lit("")), F.lit(UNKNOWN)).alias("speaker"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    said = materialise(said.groupBy("conv_id", "turn", "speaker", "text").agg(F.count(F.lit(1)).alias("_n")), "turns")
    # speakers are few; a speaker's turns collapse before the shuffle
    cast = said.where(F.col("speaker") != SYSTEM).select("conv_id", F.col("speaker").alias("perspective")).distinct()
    shown = said.join(cast, "conv_id")
    own, system = F.col("speaker") == F.col("perspective"), F.col("speaker") == SYSTEM
    name = F.regexp_replace(unforged(F.col("speaker")), r"[\r\n]", " ")
    head = F.when(own, F.lit(f"{OPEN}assistant\n")).when(system, F.lit(f"{OPEN}{SYSTEM}\n")).otherwise(F.concat(F.lit(f"{OPEN}user name="), name, F.lit("\n")))
    hashed = F.md5(F.concat("speaker", F.lit(":"), "text"))
    rows = shown.select(
        "conv_id", "perspective", "turn", F.when(own, "assistant").when(system, SYSTEM).otherwise("user").alias("role"), F.when(~own & ~system, F.col("speaker")).alias("name"), "_n",
        F.length(head).cast("long").alias("_head"), F.concat(head, unforged(F.col("text")), F.lit(CLOSE)).alias("segment"),
        F.floor(F.col("turn") / BLOCK).cast("long").alias("_block"), F.substring(hashed, 1, 3).alias("_salt"), hashed.alias("_hash"),
    )
    size = F.length("segment").cast("long")
    out = prefix_sum(rows, ["conv_id", "perspective"], ["_block", "turn", "_salt"], ["_hash"], {"seq": F.col("_n"), "start_char": F.col("_n") * size})
    # repeated turns, in runs of bounded size
    out = out.withColumn("_run", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / REPEATS).cast("long")), lambda k: k * REPEATS)))
    out = out.withColumn("_k", F.explode(F.sequence(F.col("_run"), F.least(F.col("_n"), F.col("_run") + REPEATS) - 1)))
    start = F.col("start_char") + F.col("_k") * size
    mask = lambda c: F.when(F.col("role") == "assistant", c).cast("long")
    return out.select(
        "conv_id", "perspective", (F.col("seq") + F.col("_k")).alias("seq"), "turn", "role", "name", "segment", start.alias("start_char"), (start + size).alias("end_char"),
        mask(start + F.col("_head")).alias("mask_start"), mask(start + size).alias("mask_end"),
    )
