"""SimHash near-duplicates by multi-index hashing.

A fingerprint has a bit for each bit position of the shingles' hashes: 1 if it is set in
over half of them. Fingerprints are cut into segments, and a table maps each segment's
value to the fingerprints that have it. Two fingerprints that differ in few bits agree,
up to a small Hamming ball, in some segment: every fingerprint looks up all values in
such a ball around its own, and what the table returns is kept if the complete distance
is small enough. Linked fingerprints form components.

Work is done on distinct fingerprints, so any number of copies is one node. A segment
value that more than `CAP` fingerprints share is not joined pair by pair: its members
are compared block by block, and each pair of blocks reports only a spanning forest of
its links, which has the same components.

`EXACT_64` finds every pair of 64-bit fingerprints within 2 bits. With one 32-bit half
differing in at most 1 bit, or else the other half equal, no link is lost. For similarity
of shingle sets there are wider fingerprints in `near_copies`.

Defined results: a null text counts as empty; a text without words has fingerprint zero
and is linked like any other; fewer words than a shingle has make one shingle; rows
that repeat share a result; ids that are null never become a component's id unless all
are null; empty tables give empty results; extra columns are passed through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.shared import checkpoint, join_small, release_memory
from eventloom.session import ship_package

#: Fingerprints per segment value up to which pairs are joined, and rows of a block beyond.
CAP, BLOCK = 64, 2_048
SEED = 42
#: Constants of the SplitMix64 generator, which makes more hash words from one.
GOLDEN, MIX_1, MIX_2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


@dataclass(frozen=True)
class Index:
    """How fingerprints are cut and compared.

    n_words: 64-bit words of a fingerprint. segments: (word, shift, bits, ball radius 0 or 1).
    limit: greatest distance of a link.
    """

    n_words: int
    segments: tuple[tuple[int, int, int, int], ...]
    limit: int


EXACT_64 = Index(1, ((0, 32, 32, 1), (0, 0, 32, 0)), 2)


def hash_words(hashes: np.ndarray, n_words: int) -> np.ndarray:
    """(n, n_words): the hashes themselves, then words derived from them."""
    steps = np.arange(n_words, dtype=np.uint64) * np.uint64(GOLDEN)
    x = hashes[:, None] + steps
    if n_words > 1:
        y = x[:, 1:]
        y = (y ^ (y >> np.uint64(30))) * np.uint64(MIX_1)
        y = (y ^ (y >> np.uint64(27))) * np.uint64(MIX_2)
        x[:, 1:] = y ^ (y >> np.uint64(31))
    return x


def fingerprint(text: str, shingle: int, n_words: int, chunk: int = 2_040) -> np.ndarray:
    """The fingerprint's words. Chunks bound the memory for long texts."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII case and ASCII white space
    if not words:
        return np.zeros(n_words, np.uint64)
    n = max(1, len(words) - shingle + 1)
    counts = np.zeros(64 * n_words, np.int64)
    for at in range(0, n, chunk):
        own = [xxhash.xxh64_intdigest(b" ".join(words[i : i + shingle]), SEED) for i in range(at, min(at + chunk, n))]
        counts += bit_counts(np.array(own, np.uint64), n_words)
    return np.packbits(2 * counts > n, bitorder="little").view(np.uint64)


def bit_counts(hashes: np.ndarray, n_words: int) -> np.ndarray:
    """How many of the hashes have each bit."""
    bits = np.unpackbits(hash_words(hashes, n_words).view(np.uint8), axis=1, bitorder="little")
    # Eight counters ride in one 64-bit word, so at most 255 rows are added at a time.
    sums = np.add.reduceat(bits.view(np.uint64), np.arange(0, len(hashes), 255), axis=0)
    return sums.view(np.uint8).reshape(len(sums), -1).sum(axis=0, dtype=np.int64)


def majority(hashes: np.ndarray, n_words: int, chunk: int = 2_040) -> np.ndarray:
    """The fingerprint's words of a set of shingle hashes."""
    parts = [bit_counts(hashes[at : at + chunk], n_words) for at in range(0, len(hashes), chunk)]
    return np.packbits(2 * sum(parts, np.zeros(64 * n_words, np.int64)) > len(hashes), bitorder="little").view(np.uint64)


def fingerprints(docs: DataFrame, text_col: str, shingle: int, n_words: int) -> Column:
    """A column of fingerprints as array<bigint>."""
    ship_package(docs.sparkSession)

    def batches(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([fingerprint(t or "", shingle, n_words).view(np.int64) for t in batch])
        release_memory()

    return F.pandas_udf(batches, "array<bigint>")(F.col(text_col).cast("string"))


def _keys(index: Index, ball: bool) -> Column:
    """Table keys of a fingerprint `print`, or all it looks up."""
    keys = []
    for n, (word, shift, bits, radius) in enumerate(index.segments):
        value = F.shiftrightunsigned(F.col("print")[word], shift).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
        own = value.bitwiseOR(F.lit(n << 32).cast("long"))
        keys.append(own)
        if ball and radius:
            keys += [own.bitwiseXOR(F.lit(1 << bit).cast("long")) for bit in range(bits)]
    return F.explode(F.array(*keys))


def _distance(a: Column, b: Column, n_words: int) -> Column:
    return reduce(lambda x, y: x + y, [F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(n_words)])


def spanning_forest(ids: np.ndarray, prints: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Links within `limit` bits that connect whatever such links connect."""
    links, left = [], np.arange(len(ids))
    while left.size:
        queue, left = [left[0]], left[1:]
        while queue and left.size:
            at = queue.pop()
            near = np.bitwise_count(prints[left] ^ prints[at]).sum(axis=1) <= limit
            found, left = left[near], left[~near]
            links += [(ids[at], ids[x]) for x in found]
            queue += list(found)
    return links


def _block_links(limit: int):
    def links(members: pd.DataFrame) -> pd.DataFrame:
        prints = np.stack(members.print.to_numpy()).view(np.uint64)
        found = spanning_forest(members.node.to_numpy(), prints, limit)
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    return links


def _crowded_links(nodes: DataFrame, index: Index, members: DataFrame) -> DataFrame:
    """A spanning forest of the links among the members (key, node) of each crowded value."""
    ship_package(nodes.sparkSession)
    sizes = members.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    dealt = (
        members.join(sizes, "key").join(nodes, "node")
        .withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", "node", "print", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    )
    return dealt.groupBy("key", "low", "high").applyInPandas(_block_links(index.limit), "a long, b long").distinct()


def links(nodes: DataFrame, index: Index) -> DataFrame:
    """Links (a, b) of nodes (node, print) with distinct prints; they connect whatever all links connect."""
    table = nodes.select(_keys(index, False).alias("key"), "node", "print")
    balls = any(radius for *_, radius in index.segments)
    probes = nodes.select(_keys(index, True).alias("key"), "node", "print") if balls else table
    crowded = checkpoint(table.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CAP))
    some_crowded = not crowded.isEmpty()
    thin = lambda df: join_small(df, crowded.select("key"), "key", "left_anti") if some_crowded else df
    t = thin(table).select("key", F.col("node").alias("b"), F.col("print").alias("print_b"))
    p = thin(probes).select("key", F.col("node").alias("a"), F.col("print").alias("print_a"))
    near = _distance(F.col("print_a"), F.col("print_b"), index.n_words) <= index.limit
    pairs = p.join(t, (p["key"] == t["key"]) & (F.col("a") < F.col("b")) & near).select("a", "b").distinct()
    if some_crowded:
        met = join_small(table.select("key", "node"), crowded.select("key"), "key")
        if balls:
            met = met.union(join_small(probes.select("key", "node"), crowded.select("key"), "key")).distinct()
        pairs = pairs.union(_crowded_links(nodes, index, checkpoint(met)))
    return pairs


def least_members(n: int, ends: np.ndarray) -> np.ndarray:
    """The least member of each one's component among 0 to n - 1, by links (two rows of ends)."""
    least = np.arange(n)
    while True:
        low = np.minimum(least[ends[0]], least[ends[1]])
        now = least.copy()
        for end in ends:
            np.minimum.at(now, end, low)
            np.minimum.at(now, least[end], low)
        now = now[now]
        if (now == least).all():
            return least
        least = now


def components(pairs: DataFrame) -> DataFrame:
    """(node, root) for all nodes of the links (a, b); the root is the component's least node.

    Large-star and small-star steps in turn: each points nodes at smaller neighbours until
    every component is a star. A checkpoint cuts the lineage after each round.
    """
    edges = checkpoint(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    state = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(
            low.select("u", F.col("m").alias("v"))
        ).distinct()
        edges = checkpoint(small)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now


def near_groups(prints: DataFrame, index: Index) -> DataFrame:
    """(print, component_id) of checkpointed rows (doc_id, print): the least id of the component."""
    nodes = checkpoint(
        prints.groupBy("print").agg(F.min("doc_id").alias("least_id")).withColumn("node", F.monotonically_increasing_id())
    )
    roots = components(links(nodes.select("node", "print"), index))
    member = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = member.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return member.join(ids, "root").select("print", "component_id")


def simhash_components(docs: DataFrame, shingle: int = 3, index: Index = EXACT_64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, print and component_id."""
    prints = checkpoint(
        docs.select(F.col(id_col).alias("doc_id"), fingerprints(docs, text_col, shingle, index.n_words).alias("print"))
    )
    return prints.join(near_groups(prints, index), "print").select("doc_id", "print", "component_id")
