"""Exact top-k search by inner product with vector-approximation files.

The approximation of a vector is one byte per component: the number of its cell, of
`CELLS` equal ones between the least and greatest value that any vector has there. Only
these bytes meet the queries: they are dealt by hash into blocks, queries likewise, and
every block of queries meets every block of rows once. As all cells of a dimension are
equally wide, one product with the cell numbers gives both bounds of all inner products of
a query, which lie the same `spread` apart. A row whose upper bound is below the k-th
greatest lower bound of its query can't enter the result and goes no further.

The rows left are read in the order of their bounds in two steps: the exact vectors of
the best 2 k of each query, fetched by id, give a k-th best score, and then those of all
others whose upper bound reaches it. What is unread is certain to score less.

Of equal vectors only the k + 1 smallest ids are searched, each k times at most, as no
other can be among the best k; so a vector that a third of all rows has is a few rows.

Scores are integer inner products of floor(scale * x).

Defined results: vectors that are null, or hold null or non-finite components, take no
part, nor do rows without an id; only vectors of the query's own length are candidates;
rows that repeat a vec_id are candidates of their own, and a query id that repeats is
asked once, with its greatest vector; equal scores go to the smaller vec_id; empty tables give empty
results; extra columns are ignored. Scores must fit 53 bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm.shared import checkpoint, join_small, release_memory
from eventloom.session import ship_package

#: Rows of a block, queries of a block, queries bounded at once, and cells per dimension.
BLOCK_ROWS, BLOCK_QUERIES, SLICE, CELLS = 65_536, 4_096, 64, 256


def sound_vectors(vectors: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, vector (whole numbers as doubles) and dim of the rows that take part."""
    sound = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf))
    whole = F.transform(F.col(vector_col).cast("array<double>"), lambda x: F.floor(F.lit(scale) * x).cast("double"))
    return vectors.where(
        F.col(vector_col).isNotNull() & F.col(id_col).isNotNull() & F.coalesce(sound, F.lit(False)) & (F.size(vector_col) > 0)
    ).select(F.col(id_col).alias("vec_id"), whole.alias("vector"), F.size(vector_col).alias("dim"))


def without_surplus_copies(rows: DataFrame, k: int) -> DataFrame:
    """Of each vector the k + 1 smallest ids, and of each of these k rows."""
    same = F.row_number().over(Window.partitionBy("vector", "vec_id").orderBy("dim"))
    least = F.dense_rank().over(Window.partitionBy("vector").orderBy("vec_id"))
    few = rows.withColumn("copy_rank", same).where(F.col("copy_rank") <= k).drop("copy_rank")
    return few.withColumn("id_rank", least).where(F.col("id_rank") <= k + 1).drop("id_rank")


def cell_edges(rows: DataFrame) -> DataFrame:
    """Per length of vectors (dim): the low end `lows` and the width `widths` of each dimension's cells."""
    ends = rows.select("dim", F.posexplode("vector").alias("at", "x")).groupBy("dim", "at").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    cells = F.array_sort(F.collect_list(F.struct("at", "low", ((F.col("high") - F.col("low")) / CELLS).alias("width"))))
    return ends.groupBy("dim").agg(cells.alias("cells")).select(
        "dim", F.transform("cells", lambda c: c["low"]).alias("lows"), F.transform("cells", lambda c: c["width"]).alias("widths")
    )


def cell_numbers(vectors: np.ndarray, lows: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """The cell of each component."""
    some = np.where(widths > 0, widths, 1.0)
    return np.clip(np.floor((vectors - lows) / some), 0, CELLS - 1).astype(np.uint8)


def _approximations(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
    for vectors, lows, widths in batches:
        yield pd.Series([cell_numbers(v, low, width).tobytes() for v, low, width in zip(vectors, lows, widths)], dtype=object)
    release_memory()


def bounded(queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> Iterator[pd.DataFrame]:
    """Of each query the rows that its bounds in this block don't exclude, with their upper bound."""
    numbers = np.frombuffer(b"".join(rows.cells), np.uint8).reshape(len(rows), -1).astype("f8")
    ids, row_ids = rows.vec_id.to_numpy(), rows.row_id.to_numpy()
    asked, spreads, bases = queries.vec_id.to_numpy(), queries.spread.to_numpy(), queries.base.to_numpy()
    for at in range(0, len(queries), SLICE):
        some = slice(at, at + SLICE)
        upper = np.stack(queries.weights.to_numpy()[some]) @ numbers.T + bases[some, None]
        # Edges aren't whole numbers: a small slack keeps the bounds safe.
        upper += 1e-9 * np.abs(upper) + 1e-3
        spread = spreads[some] * (1 + 1e-9) + 1e-2 + 4e-9 * np.abs(upper).max(axis=1, initial=0)
        upper[asked[some, None] == ids[None, :]] = -np.inf
        if upper.shape[1] > k:
            floor = np.partition(upper, -k, axis=1)[:, -k] - spread
        else:
            floor = np.full(len(upper), -np.inf)
        query, row = np.nonzero((upper >= floor[:, None]) & (upper > -np.inf))
        yield pd.DataFrame({"query_id": asked[some][query], "row_id": row_ids[row], "bound": upper[query, row], "spread": spread[query]})


def exact_top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    scale: int = 256,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    block_rows: int = BLOCK_ROWS,
    block_queries: int = BLOCK_QUERIES,
    reads: list | None = None,
) -> DataFrame:
    """Per query row the k best other rows: query_id, rank, vec_id, score.

    `is_query` is a condition on the id, under the name vec_id. `reads` gets the number of exact
    vectors that each step reads (for tests; it counts them with jobs of its own).
    """
    ship_package(vectors.sparkSession)
    rows = sound_vectors(vectors, scale, id_col, vector_col)
    table = checkpoint(without_surplus_copies(rows, k).withColumn("row_id", F.monotonically_increasing_id()))
    edges = checkpoint(cell_edges(table))
    asked = checkpoint(
        rows.where(is_query).groupBy("vec_id").agg(F.max(F.struct("dim", "vector")).alias("q")).select("vec_id", "q.vector", "q.dim")
    )
    weights = F.zip_with("vector", "widths", lambda q, w: q * w)
    total = lambda xs, of: F.aggregate(xs, F.lit(0.0), lambda so_far, x: so_far + of(x))
    left = join_small(asked, edges, "dim").withColumn("weights", weights).select(
        "vec_id", "dim", "weights", total("weights", F.abs).alias("spread"),
        (total(F.zip_with("vector", "lows", lambda q, low: q * low), lambda x: x) + total("weights", lambda x: F.greatest(x, F.lit(0.0)))).alias("base"),
    )
    cells = F.pandas_udf(_approximations, "binary")("vector", "lows", "widths")
    right = join_small(table, edges, "dim").select("row_id", "vec_id", "dim", cells.alias("cells"))
    row_blocks, query_blocks = max(1, math.ceil(table.count() / block_rows)), max(1, math.ceil(asked.count() / block_queries))

    def dealt(df: DataFrame, by: str, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        block = F.pmod(F.xxhash64(by), F.lit(n_own)).cast("int")
        return df.withColumn(own, block).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))))

    def search(queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": [], "row_id": [], "bound": [], "spread": []}).astype({"query_id": "int64", "row_id": "int64"})
        return pd.concat([none, *bounded(queries, block, k)], ignore_index=True) if len(queries) and len(block) else none

    keys = ["dim", "query_block", "row_block"]
    met = dealt(left, "vec_id", "query_block", query_blocks, "row_block", row_blocks).groupBy(*keys).cogroup(
        dealt(right, "row_id", "row_block", row_blocks, "query_block", query_blocks).groupBy(*keys)
    )
    by_bound = Window.partitionBy("query_id").orderBy(F.desc("bound"), "row_id")
    ranked = met.applyInPandas(search, "query_id long, row_id long, bound double, spread double").withColumn("place", F.row_number().over(by_bound))
    floor = F.max(F.when(F.col("place") == k, F.col("bound") - F.col("spread"))).over(Window.partitionBy("query_id"))
    left_over = checkpoint(ranked.withColumn("floor", floor).where(F.col("floor").isNull() | (F.col("bound") >= F.col("floor"))).drop("floor", "spread"))

    exact = table.select("row_id", "vec_id", F.col("vector").alias("row_vector"))
    question = asked.select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query_vector"))

    def read(some: DataFrame) -> DataFrame:
        """Exact scores of pairs (query_id, row_id); each exact vector that is asked for is fetched once."""
        if reads is not None:
            reads.append(some.select("row_id").distinct().count())
        fetched = join_small(exact, checkpoint(some.select("row_id").distinct()), "row_id")
        scored = some.join(fetched, "row_id").join(question, "query_id")
        product = total(F.zip_with("query_vector", "row_vector", lambda a, b: a * b), lambda x: x)
        return scored.select("query_id", "row_id", "vec_id", product.cast("long").alias("score"))

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    first = checkpoint(read(left_over.where(F.col("place") <= 2 * k).select("query_id", "row_id")))
    known = checkpoint(
        first.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k).select("query_id", F.col("score").alias("kth_score"))
    )
    rest = join_small(left_over.where(F.col("place") > 2 * k), known, "query_id").where(F.col("bound") >= F.col("kth_score"))
    found = first.unionByName(read(checkpoint(rest.select("query_id", "row_id"))))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
