"""Row numbers in order, without a task that sorts all rows of a key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.storage import checkpoint, join_small


def number_rows(rows: DataFrame, keys: list[str], order: list[str], name: str = "number") -> DataFrame:
    """Add `name`: 1, 2, 3 ... within each key, by `order`.

    Rows are dealt to partitions by ranges of key and order. A row's number is its number within
    its partition and key, plus the rows of its key in the partitions before, of
    which there is one count for each partition and key. So a key of any size is
    spread over many tasks; equal rows share one.
    """
    ranged = checkpoint(rows.repartitionByRange(*keys, *order).withColumn("range_part", F.spark_partition_id()))
    alike = [F.col(k).eqNullSafe(F.col(f"counted_{k}")) for k in keys]
    before = Window.partitionBy(*keys).orderBy("range_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = checkpoint(
        ranged.groupBy(*keys, "range_part").agg(F.count(F.lit(1)).alias("rows_here"))
        .withColumn("rows_before", F.sum("rows_here").over(before))
        .where("rows_before IS NOT NULL")
        .select(*[F.col(k).alias(f"counted_{k}") for k in keys], F.col("range_part").alias("counted_part"), "rows_before")
    )
    same = F.col("range_part") == F.col("counted_part")
    for one in alike:
        same = same & one
    within = Window.partitionBy("range_part", *keys).orderBy(*order)
    numbered = join_small(ranged.withColumn(name, F.row_number().over(within)), starts, same, "left")
    return numbered.withColumn(name, (F.coalesce("rows_before", F.lit(0)) + F.col(name)).cast("long")).drop(
        *[f"counted_{k}" for k in keys], "counted_part", "rows_before", "range_part"
    )


def assign_sequences(arrivals: DataFrame, last: DataFrame, order: str = "arrival") -> DataFrame:
    """Add `sequence`: each origin counts on from its last one (origin_service, max_sequence)."""
    numbered = number_rows(arrivals, ["origin_service"], [order], "sequence")
    return (
        numbered.join(last, "origin_service", "left")
        .withColumn("sequence", F.coalesce("max_sequence", F.lit(0)).cast("long") + F.col("sequence"))
        .drop("max_sequence")
    )
