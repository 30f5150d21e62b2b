"""Chat formatting by multi-party perspective rotation.

Every participant of a conversation gets a rendering in which their own turns are the
assistant's and everyone else speaks as a user with a name; only the assistant's words
are trained on, so each rendering has the spans of exactly those. Turns the role
`system` wrote open every rendering as system turns; the system is no participant.

A conversation may be longer than a task can hold. It is therefore rendered in pieces of
`PIECE` turn numbers; the pieces of a rendering, joined by piece and part, are the whole
dialogue, and one below `PIECE` turns has one piece. Where many rows crowd one piece
(equal or missing turn numbers), they are numbered in the dialogue's order, and each
`PART_ROWS` of them make a part. Participants come from a distinct list per conversation,
with partial aggregation before the shuffle.

No turn can forge another: `<` and `|` of a text or name that stand together, or with
backslashes between, get one backslash more between them, and line ends in a name become
spaces. `plain_text` undoes the former.

Defined results: turns are ordered by number (nulls first), role and text; rows that
repeat all of conv_id, turn, role and text count once; a null text is empty; a null
role is a participant called `unknown`; a conversation of system turns only has no
rendering; rows without conv_id form one conversation; an empty table gives an empty
result; extra columns are ignored. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.shared import checkpoint, join_small
from eventloom.operators.sequences import number_rows

#: Turn numbers of a piece, and rows that a piece holds before it is split.
PIECE, PART_ROWS = 256, 1024

#: What opens and closes a turn.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
NO_ROLE, SYSTEM = "unknown", "system"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def plain_text(text: Column) -> Column:
    """What `escaped` was given."""
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def rotate_perspectives(turns: DataFrame, piece: int = PIECE, part_rows: int = PART_ROWS) -> DataFrame:
    """One row per conversation, participant and piece.

    conv_id, speaker, piece, part, n_turns, text, and masks: the spans of `text` to train on.
    """
    clean = turns.select(
        F.col("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.translate(escaped(F.coalesce(F.col("role").cast("string"), F.lit(NO_ROLE))), "\r\n", "  ").alias("role"),
        escaped(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"),
    ).distinct()
    placed = clean.withColumn("piece", F.coalesce(F.floor(F.col("turn") / piece), F.lit(-1)).cast("long"))
    crowd = checkpoint(
        placed.groupBy("conv_id", "piece").agg(F.count(F.lit(1)).alias("crowd")).where(F.col("crowd") > part_rows)
        .select(F.col("conv_id").alias("c"), F.col("piece").alias("p"))
    )
    crowded = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("piece") == F.col("p"))
    parted = join_small(placed, crowd, crowded, "left_anti").withColumn("part", F.lit(0))
    if not crowd.isEmpty():
        numbered = number_rows(join_small(placed, crowd, crowded, "left_semi"), ["conv_id", "piece"], ["turn", "role", "text"])
        parted = parted.unionByName(numbered.withColumn("part", F.floor((F.col("number") - 1) / part_rows).cast("int")).drop("number"))
    speakers = clean.where(F.col("role") != SYSTEM).select(F.col("conv_id").alias("c"), F.col("role").alias("speaker")).distinct()
    pieces = (
        parted.select("conv_id", "turn", "role", "text", "piece", "part")
        .groupBy("conv_id", "piece", "part")
        .agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("said"))
    )
    seen = pieces.join(speakers, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")

    def head(role):
        return (
            F.when(role == SYSTEM, F.lit(f"{OPEN}system\n"))
            .when(role == F.col("speaker"), F.lit(f"{OPEN}assistant\n"))
            .otherwise(F.concat(F.lit(f"{OPEN}user name="), role, F.lit("\n")))
        )

    rendered = F.transform(
        "said",
        lambda s: F.struct(
            (s["role"] == F.col("speaker")).alias("own"),
            F.length(head(s["role"])).alias("head"),
            F.length(s["text"]).alias("body"),
            F.concat(head(s["role"]), s["text"], F.lit(CLOSE)).alias("turn"),
        ),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, end: int>>").alias("masks"))
    # The mask of an own turn covers its words and the mark that closes it.
    walked = F.aggregate(
        "rendered",
        start,
        lambda so_far, t: F.struct(
            (so_far["at"] + F.length(t["turn"])).alias("at"),
            F.when(
                t["own"],
                F.concat(
                    so_far["masks"],
                    F.array(F.struct((so_far["at"] + t["head"]).alias("start"), (so_far["at"] + F.length(t["turn"]) - 1).alias("end"))),
                ),
            )
            .otherwise(so_far["masks"])
            .alias("masks"),
        ),
        lambda so_far: so_far["masks"],
    )
    return (
        seen.withColumn("rendered", rendered)
        .select(
            "conv_id", "speaker", "piece", "part", F.size("said").alias("n_turns"),
            F.array_join(F.transform("rendered", lambda t: t["turn"]), "").alias("text"), walked.alias("masks"),
        )
    )
