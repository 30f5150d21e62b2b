"""Mixing sources to target weights by capped water-filling.

Every source asks for its weight's share of the whole budget. A source cannot be
repeated more than `max_epochs` times, so sources whose share is beyond that are
clamped and the excess goes to the others by weight, until none is above its cap.
Sorting by cap per unit of weight makes the clamped sources a prefix, so one pass of
running sums finds the level instead of a loop.

Within a source every document gets the whole part of target / size repetitions. The
fractional part is one more repetition of the documents whose seeded hash is below a
threshold, the largest that stays within the target, and of a few documents that fill
the rest best. The threshold comes from a histogram of the leading hash bits, then
from the documents of a single histogram cell, so that no task sees a whole source.

Defined results: a null text has size 0; a null source is a source of its own, sorted
last; rows that share an id share the hash and so the decision; an empty table gives
an empty result; a source of size 0 has target 0 and its rows are taken `0` times
or more without adding words; extra columns are kept or ignored, never read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm.shared import checkpoint, join_small, text_or_empty

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Hex digits of the hash that are used, and how many bits of it are left within a histogram cell.
HASH_DIGITS, CELL_BITS = 15, 44
#: Documents of a source that may fill what the threshold leaves.
FILL_ROUNDS = 3


def word_count(column: str) -> Column:
    return F.regexp_count(text_or_empty(column), F.lit(WORD)).cast("long")


def seeded_hash(id_col: str, seed: int) -> Column:
    """A 60-bit number that depends on the id and the seed only."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, HASH_DIGITS), 16, 10).cast("long")


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """One slim row per document: id, source, words and hash."""
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("mix_source"),
        word_count(text_col).alias("size"),
        seeded_hash(id_col, seed).alias("mix_hash"),
    )


def water_fill(sources: DataFrame, weights: Sequence[float], budget_ratio: float, max_epochs: float) -> DataFrame:
    """Add `target` to one row per source (mix_source, source_size).

    Weights are dealt to the sources in code point order, nulls last, and repeat.
    The windows have no partition: the table has one row per source.
    """
    order = Window.orderBy(F.col("mix_source").asc_nulls_last())
    everything = Window.partitionBy()
    before = Window.orderBy("fill_ratio", F.col("mix_source").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, -1
    )
    dealt = F.array(*[F.lit(float(w)) for w in weights])
    level = (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.col("all_weights") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    filled = (
        sources.withColumn("weight", F.element_at(dealt, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
        .withColumn("cap", F.lit(float(max_epochs)) * F.col("source_size"))
        .withColumn("budget", F.lit(float(budget_ratio)) * F.sum("source_size").over(everything))
        .withColumn("all_weights", F.sum("weight").over(everything))
        .withColumn("fill_ratio", F.col("cap") / F.col("weight"))
        .withColumn("clamped", F.col("fill_ratio") <= level)
    )
    rest = F.sum(F.when(~F.col("clamped"), F.col("weight")).otherwise(0.0)).over(everything)
    used = F.sum(F.when(F.col("clamped"), F.col("cap")).otherwise(0.0)).over(everything)
    return filled.withColumn(
        "target",
        F.when(F.col("clamped"), F.col("cap")).otherwise(F.col("weight") * ((F.col("budget") - used) / F.nullif(rest, F.lit(0.0)))),
    ).select("mix_source", "source_size", "target")


def _beside(rows: DataFrame, by_source: DataFrame, how: str = "inner") -> DataFrame:
    """`rows` with the columns of a checkpointed table that has one row per source."""
    named = by_source.withColumnRenamed("mix_source", "joined_source")
    same = F.col("mix_source").eqNullSafe(F.col("joined_source"))
    return join_small(rows, named, same, how).drop("joined_source")


def plan_mix(
    rows: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    budget_ratio: float = 1.5,
    max_epochs: float = 2.0,
) -> DataFrame:
    """One row per source: size, target, whole repetitions and the hash threshold of one more.

    `rows` is a checkpointed `sized` table. The histogram has at most 65,536 rows a source.
    """
    cell = F.shiftright("mix_hash", CELL_BITS)
    histogram = checkpoint(
        rows.groupBy("mix_source", cell.alias("cell")).agg(F.sum("size").alias("cell_size"))
    )
    sources = histogram.groupBy("mix_source").agg(F.sum("cell_size").alias("source_size"))
    plan = checkpoint(
        water_fill(sources, weights, budget_ratio, max_epochs)
        .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("need", F.col("target") - F.col("whole") * F.col("source_size"))
    )
    running = Window.partitionBy("mix_source").orderBy("cell")
    cells = (
        _beside(histogram, plan.select("mix_source", "need"))
        .withColumn("upto", F.sum("cell_size").over(running))
    )
    cut = checkpoint(
        cells.where((F.col("need") > 0) & (F.col("upto") >= F.col("need")))
        .groupBy("mix_source", "need")
        .agg(F.min(F.struct("cell", (F.col("upto") - F.col("cell_size")).alias("below"))).alias("at"))
        .select("mix_source", "need", "at.cell", "at.below")
    )
    inside = _beside(rows, cut).where(cell == F.col("cell"))
    ranked = inside.withColumn("upto", F.col("below") + F.sum("size").over(Window.partitionBy("mix_source").orderBy("mix_hash")))
    start = F.shiftleft(F.col("cell").cast("long"), CELL_BITS) - 1
    fits = cut.select("mix_source", "need", start.alias("mix_hash"), F.col("below").alias("upto")).unionByName(
        ranked.where(F.col("upto") <= F.col("need")).select("mix_source", "need", "mix_hash", "upto")
    )
    filled = checkpoint(
        fits.groupBy("mix_source", "need")
        .agg(F.max(F.struct("mix_hash", "upto")).alias("at"))
        .select(
            "mix_source", F.col("at.mix_hash").alias("threshold"), (F.col("need") - F.col("at.upto")).alias("gap"),
            F.array().cast("array<bigint>").alias("fillers"),
        )
    )
    # Documents beyond the threshold fill what is left, each the one that comes nearest to the target.
    off = F.abs(F.col("gap") - F.col("size"))
    for _ in range(FILL_ROUNDS):
        best = (
            _beside(rows, filled)
            .where((F.col("mix_hash") > F.col("threshold")) & ~F.array_contains("fillers", F.col("mix_hash")) & (off < F.col("gap")))
            .groupBy("mix_source")
            .agg(F.min(F.struct(off.alias("off"), "mix_hash", "size")).alias("best"))
        )
        more = _beside(filled, checkpoint(best), "left")
        filled = checkpoint(
            more.select(
                "mix_source", "threshold", (F.col("gap") - F.coalesce("best.size", F.lit(0))).alias("gap"),
                F.when(F.col("best").isNull(), F.col("fillers")).otherwise(F.array_append("fillers", F.col("best.mix_hash"))).alias("fillers"),
            )
        )
    planned = _beside(plan, filled, "left")
    return checkpoint(
        planned.select(
            "mix_source", "source_size", "target", "whole",
            F.coalesce("threshold", F.lit(-1).cast("long")).alias("threshold"),
            F.coalesce("fillers", F.array().cast("array<bigint>")).alias("fillers"),
        )
    )


def copies() -> Column:
    """How often a row with `mix_hash` is taken, beside its source's plan."""
    return F.col("whole") + ((F.col("mix_hash") <= F.col("threshold")) | F.array_contains("fillers", F.col("mix_hash"))).cast("long")


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    budget_ratio: float = 1.5,
    max_epochs: float = 2.0,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The mixed corpus: each row of `docs` as often as the mix takes it, columns unchanged."""
    plan = plan_mix(checkpoint(sized(docs, id_col, text_col, source_col, seed)), weights, budget_ratio, max_epochs)
    rows = docs.select(
        F.struct("*").alias("row"), F.col(source_col).alias("mix_source"), seeded_hash(id_col, seed).alias("mix_hash")
    )
    return _beside(rows, plan).select("row", F.explode(F.array_repeat(F.lit(1), copies().cast("int")))).select("row.*")


def mix_report(docs: DataFrame, seed: int = 17, **how) -> DataFrame:
    """Per document: doc_id, size, its source's size and target, and the words taken."""
    rows = checkpoint(sized(docs, "doc_id", "text", "source", seed))
    plan = plan_mix(rows, **how)
    return _beside(rows, plan).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * copies()).alias("taken")
    )
