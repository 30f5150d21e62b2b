"""Near copies by shingle similarity: SimHash finds candidates, shingle sets decide.

The similarity of two texts is the Jaccard similarity of their sets of word shingles.
Texts with equal sets are one node. A node's fingerprint has the majority bits of its
shingles' hashes, and two sets of similarity s differ in each bit with a probability of
acos(2s / (1 + s)) / pi, 0.15 at 0.8. Multi-index hashing finds pairs of near fingerprints:
a fingerprint is cut into segments, and a segment's nodes are dealt by its upper bits to
groups. In a group, the table of the segment's other bits is looked up for the Hamming
ball of radius `RADIUS` around every value, and of the pairs that it gives those count whose
complete fingerprints differ in at most a quarter of the bits (0.15 of them at 0.8,
half of them for unrelated texts).

`index_for` sets the number of segments so that a pair at the similarity is found with
the stated probability at any size of the corpus; more texts get more upper bits, so
that a group stays small, and more segments. These pairs are only candidates. In each of
their components the shingle sets are compared, and they alone decide what is a link.

A group may hold a third of all nodes. It is cut into blocks, each pair of blocks is one
unit of work, and each unit reports a spanning forest of its links instead of all pairs,
which has the same components. Where sets are compared, all members of a large component first
meet a few of them, its hubs: what is similar to the best hub is linked already and is only
compared with the rest, so a component of copies of one text takes time in proportion to it.

Defined results: a null text counts as empty; texts without words are copies of each
other and of nothing else; fewer words than a shingle has make one shingle; of a component the
row with the least id stays, and so do rows without an id and rows that repeat its id and
text; empty tables give empty results; extra columns are passed through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm.shared import checkpoint, join_small, release_memory, sorted_groups
from eventloom.llm.simhash import GOLDEN, SEED, components, least_members, majority, spanning_forest
from eventloom.session import ship_package

#: Bits of a segment whose balls are looked up in a group, and the balls' radius.
WINDOW, RADIUS = 16, 2
#: Least upper bits of a segment, and nodes of a group beyond which there are more.
MIN_UPPER, GROUP_BITS = 5, 18
#: Probability with which a pair at the similarity becomes a candidate.
RECALL = 0.998
#: Nodes and shingles of a block in which sets are compared; nodes of a block of a group.
BLOCK, BLOCK_HASHES, GROUP_BLOCK = 2_048, 1 << 20, 1 << 18
#: Members that all members of a component beyond a block are compared with first.
HUBS = 8
#: Pairs of two table entries up to which each is compared; beyond, a forest is grown.
LISTED = 1_024
#: Distinct words whose hashes a task remembers.
WORDS_HELD = 1 << 16


@dataclass(frozen=True)
class WideIndex:
    """Words of a fingerprint, upper bits and number of the segments, and the greatest distance of a candidate."""

    n_words: int
    upper: int
    n_segments: int
    limit: int

    @property
    def bits(self) -> int:
        return self.upper + WINDOW


def chance(similarity: float, upper: int, segments: int) -> float:
    """Probability that a pair of the similarity meets in a segment."""
    off = math.acos(2 * similarity / (1 + similarity)) / math.pi
    ball = sum(math.comb(WINDOW, r) * off**r * (1 - off) ** (WINDOW - r) for r in range(RADIUS + 1))
    return 1 - (1 - (1 - off) ** upper * ball) ** segments


def index_for(rows: int, similarity: float = 0.8, recall: float = RECALL) -> WideIndex:
    """The index of a corpus of so many rows."""
    upper = max(MIN_UPPER, (rows >> GROUP_BITS).bit_length())
    a_word = 64 // (upper + WINDOW)
    n_words = 1
    while chance(similarity, upper, n_words * a_word) < recall:
        n_words += 1
    return WideIndex(n_words, upper, n_words * a_word, 16 * n_words)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_HELD:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word, SEED)
        return found


def shingle_set(text: str, shingle: int, known: dict[bytes, int]) -> np.ndarray:
    """Distinct hashes of the text's shingles, sorted."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII case and ASCII white space
    if not words:
        return np.zeros(0, np.uint64)
    own = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = max(1, len(words) - shingle + 1)
    mixed = np.full(n, len(words) if len(words) < shingle else shingle, np.uint64)
    for i in range(min(shingle, len(words))):
        mixed = (mixed ^ own[i : i + n]) * np.uint64(GOLDEN)
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def _cut(texts: DataFrame, shingle: int, n_words: int):
    """A column of each text's set: its id, and its fingerprint."""
    ship_package(texts.sparkSession)

    def batches(rows: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = _WordHashes()
        for batch in rows:
            names, prints = [], []
            for text in batch:
                own = shingle_set(text or "", shingle, known)
                names.append(xxhash.xxh128_hexdigest(own.tobytes()))
                prints.append(majority(own, n_words).view(np.int64))
            yield pd.DataFrame({"set_id": names, "print": prints})
        del known
        release_memory()

    return F.pandas_udf(batches, "set_id string, print array<bigint>")


def _balls() -> np.ndarray:
    """Differences within `RADIUS` bits, none first."""
    every = np.arange(1 << WINDOW)
    return every[np.bitwise_count(every.astype(np.uint64)) <= RADIUS]


def _blocked(rows: DataFrame, keys: list[str], sizes: DataFrame) -> DataFrame:
    """`rows` (with node) once for each pair of blocks, `low` and `high`, that theirs is in.

    `sizes` has the number of `blocks` of those keys that have several.
    """
    joined = join_small(rows, checkpoint(sizes), keys, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    return (
        joined.withColumn("own_block", own)
        .withColumn("other_block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("low", F.least("own_block", "other_block")).withColumn("high", F.greatest("own_block", "other_block"))
        .drop("blocks", "own_block", "other_block")
    )


def ball_forest(nodes: np.ndarray, values: np.ndarray, prints: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that connect what pairs within `limit` bits, whose values are in each other's balls, connect.

    Each end but the least of a component is linked to it.
    """
    order = np.lexsort((nodes, values))
    nodes, values, prints = nodes[order], values[order], prints[order]
    runs, first, size = np.unique(values, return_index=True, return_counts=True)
    entry = np.full(1 << WINDOW, -1, np.int64)
    entry[runs] = np.arange(len(runs))
    ends = []

    def near(a: np.ndarray, b: np.ndarray) -> None:
        hit = np.bitwise_count(prints[a] ^ prints[b]).sum(axis=1) <= limit
        ends.append(np.stack((a[hit], b[hit])))

    balls = _balls()
    for low in range(0, len(runs), 4_096):
        # Each pair of entries once: from the lower one, and an entry with itself if it has several nodes.
        two = entry[runs[low : low + 4_096, None] ^ balls]
        own = np.arange(low, low + len(two))[:, None]
        one, way = np.nonzero((two > own) | ((two == own) & (size[own] > 1)))
        two, one = two[one, way], one + low
        product = size[one] * size[two]
        few = np.flatnonzero(product <= LISTED)
        for part in np.array_split(few, product[few].sum() // 500_000 + 1):
            n, wide = product[part], size[two[part]]
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            a = np.repeat(first[one[part]], n) + place // np.repeat(wide, n)
            b = np.repeat(first[two[part]], n) + place % np.repeat(wide, n)
            apart = a < b
            near(a[apart], b[apart])
        for at in np.flatnonzero(product > LISTED):
            u, v = one[at], two[at]
            both = np.concatenate([np.arange(first[x], first[x] + size[x]) for x in ((u,) if u == v else (u, v))])
            ends.append(np.array(spanning_forest(both, prints[both], limit), np.int64).reshape(-1, 2).T)
    ends = np.concatenate(ends, axis=1)
    touched, ends = np.unique(ends, return_inverse=True)
    by_node = np.argsort(nodes[touched])
    place = np.empty(len(touched), np.int64)
    place[by_node] = np.arange(len(touched))
    least = least_members(len(touched), place[ends.reshape(2, -1)])
    ids = nodes[touched][by_node]
    moved = np.flatnonzero(least != np.arange(len(ids)))
    return ids[moved], ids[least[moved]]


def candidate_links(nodes: DataFrame, index: WideIndex) -> DataFrame:
    """Links (a, b) of checkpointed nodes (node, print) that connect whatever pairs within `index` connect."""
    ship_package(nodes.sparkSession)
    a_word, cells = 64 // index.bits, []
    for n in range(index.n_segments):
        value = F.shiftrightunsigned(F.col("print")[n // a_word], index.bits * (n % a_word))
        group = F.shiftrightunsigned(value, WINDOW).bitwiseAND(F.lit((1 << index.upper) - 1).cast("long"))
        cells.append(F.struct(
            group.bitwiseOR(F.lit(n << index.upper).cast("long")).cast("int").alias("place"),
            value.bitwiseAND(F.lit((1 << WINDOW) - 1).cast("long")).cast("int").alias("value"),
        ))
    names = [f"p{i}" for i in range(index.n_words)]
    cut = nodes.select(F.explode(F.array(*cells)).alias("cell"), "node", *[F.col("print")[i].alias(n) for i, n in enumerate(names)]).select(
        "cell.place", "cell.value", "node", *names
    )
    sizes = cut.groupBy("place").agg(F.ceil(F.count(F.lit(1)) / GROUP_BLOCK).cast("int").alias("blocks")).where("blocks > 1")
    limit = index.limit

    def forest(rows: pd.DataFrame) -> pd.DataFrame:
        prints = np.stack([rows[n].to_numpy() for n in names], axis=1).view(np.uint64)
        a, b = ball_forest(rows.node.to_numpy(), rows.value.to_numpy(), prints, limit)
        return pd.DataFrame({"a": a, "b": b})

    dealt = _blocked(cut, ["place"], sizes)
    return dealt.groupBy("place", "low", "high").applyInPandas(forest, "a long, b long").distinct()


def similar_forest(ids: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Pairs of at least the Jaccard similarity that connect whatever such pairs connect.

    Each step finds all unvisited neighbours of one set by counting the shingles that it shares
    with each. Sets of common shingles come first, as they have many neighbours.
    """
    sizes = np.array([len(own) for own in sets])
    values, places = np.unique(np.concatenate(sets), return_inverse=True)
    starts, owner, left = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(ids)), sizes), np.ones(len(ids), bool)
    shared = np.bincount(owner, np.bincount(places)[places] if len(places) else None, len(ids))

    def table() -> tuple[np.ndarray, np.ndarray, int]:
        """Unvisited owners of each shingle, one shingle after the other, and where each ends."""
        some = left[owner]
        order = np.argsort(places[some], kind="stable")
        return owner[some][order], np.cumsum(np.bincount(places[some], minlength=len(values))), left.sum()

    owners, high, held = table()
    links = []
    for first in np.argsort(-shared / (sizes + sizes.mean() + 1), kind="stable"):
        queue = [first] if left[first] else []
        left[first] = False
        while queue and left.any():
            if 2 * left.sum() < held:
                owners, high, held = table()
            at = queue.pop()
            mine = places[starts[at] : starts[at] + sizes[at]]
            low = np.where(mine > 0, high[mine - 1], 0)
            n = high[mine] - low
            both = np.bincount(owners[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())], minlength=len(ids))
            found = np.flatnonzero(left & (both >= similarity * (sizes[at] + sizes - both) - 1e-9))
            left[found] = False
            links += [(ids[at], ids[x]) for x in found]
            queue += found.tolist()
    return links


def _blocks() -> Column:
    """Blocks of a group of sets `own`."""
    return F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum(F.size("own")) / BLOCK_HASHES)).cast("int")


def hub_stars(sets: DataFrame, large: DataFrame, similarity: float) -> DataFrame:
    """(key, node, hub) of the members that are similar to the best hub of their component.

    `sets` has key, node and own, and `large` the number of `blocks` of each large component. Of
    `HUBS` members the best hub is the one with most similar members.
    """
    rows = join_small(sets, large, "key")
    drawn = F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("node"), "node"))
    hubs = checkpoint(rows.select("key", "node", drawn.alias("drawn")).where(F.col("drawn") <= HUBS).drop("drawn"))
    # A hub goes to every block of its component, and each member to its own.
    hubs = join_small(rows, hubs, ["key", "node"]).select(
        "key", F.col("node").alias("hub"), F.col("own").alias("hub_own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    )
    both = F.size(F.array_intersect("own", "hub_own"))
    near = both >= similarity * (F.size("own") + F.size("hub_own") - both) - 1e-9
    met = checkpoint(
        rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .join(hubs, ["key", "block"]).where(near).select("key", "node", "hub")
    )
    counted = met.groupBy("key", "hub").agg(F.count(F.lit(1)).alias("n"))
    best = counted.groupBy("key").agg(F.max(F.struct("n", "hub")).alias("best")).select("key", F.col("best.hub").alias("hub"))
    return join_small(met, checkpoint(best), ["key", "hub"]).select("key", "node", "hub")


def _blocked_around(sets: DataFrame, large: DataFrame, stars: DataFrame) -> DataFrame:
    """The sets of large components once for each pair of blocks, `low` and `high`, that theirs is in.

    What is in a star has blocks of its own behind those of the rest, and no pairs among them.
    """
    rows = checkpoint(join_small(sets, large.select("key"), "key").join(stars, ["key", "node"], "left").withColumn("starred", F.col("hub").isNotNull()))
    counted = rows.groupBy("key", "starred").agg(_blocks().alias("n"))
    of = lambda starred: F.coalesce(F.max(F.when(F.col("starred") == starred, F.col("n"))), F.lit(0))
    blocks = counted.groupBy("key").agg(of(False).alias("rest_blocks"), of(True).alias("star_blocks")).where("rest_blocks > 0")
    place = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    last = F.col("rest_blocks") - 1
    return (
        join_small(rows, checkpoint(blocks), "key")
        .withColumn("own_block", F.when(F.col("starred"), F.col("rest_blocks") + place("star_blocks")).otherwise(place("rest_blocks")))
        .withColumn("other_block", F.explode(F.sequence(F.lit(0), F.when(F.col("starred"), last).otherwise(last + F.col("star_blocks")))))
        .select("key", "node", "own", F.least("own_block", "other_block").alias("low"), F.greatest("own_block", "other_block").alias("high"))
    )


def similar_links(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Links (a, b) of similar nodes within each component of the candidate pairs (a, b), as forests.

    `nodes` has the content of each node and `texts` the text of each content. Only texts of
    candidates are cut into shingles again.
    """
    ship_package(pairs.sparkSession)

    def cut(rows: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = _WordHashes()
        for batch in rows:
            yield pd.Series([shingle_set(t or "", shingle, known).view(np.int64) for t in batch])
        del known
        release_memory()

    roots = components(pairs)
    members = roots.select(F.col("root").alias("key"), "node").union(roots.select("root", F.col("root").alias("node"))).distinct()
    asked = checkpoint(nodes.join(members, "node").select("key", "node", "content"))
    sets = checkpoint(
        join_small(texts, asked, "content").dropDuplicates(["node"]).select("key", "node", F.pandas_udf(cut, "array<bigint>")("text").alias("own"))
    )
    large = checkpoint(sets.groupBy("key").agg(_blocks().alias("blocks")).where("blocks > 1"))
    whole = join_small(sets, large.select("key"), "key", "left_anti")
    dealt = whole.select("key", "node", "own", F.lit(0).alias("low"), F.lit(0).alias("high"))
    stars = None
    if not large.isEmpty():
        stars = checkpoint(hub_stars(sets, large, similarity))
        dealt = dealt.union(_blocked_around(sets, large, stars))
    keys = ["key", "low", "high"]

    def forests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: list = []
        for group in sorted_groups(batches, keys):
            own = [x.view(np.uint64) for x in group.own]
            found += similar_forest(group.node.to_numpy(), own, similarity)
            if len(found) > 10_000:
                yield pd.DataFrame(found, columns=["a", "b"])
                found = []
        yield pd.DataFrame(found, columns=["a", "b"]).astype("int64")
        release_memory()

    links = dealt.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(forests, "a long, b long")
    if stars is not None:
        links = links.union(stars.where("node <> hub").select("node", "hub"))
    return links.distinct()


def near_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", index: WideIndex | None = None) -> DataFrame:
    """Per distinct doc_id and content: doc_id, content (the text's MD5) and component_id."""
    text = F.col(text_col).cast("string")
    content = F.md5(F.coalesce(text, F.lit("")))
    index = index or index_for(docs.count(), similarity)
    rows = checkpoint(
        docs.select(F.col(id_col).alias("doc_id"), content.alias("content"), _cut(docs, shingle, index.n_words)(text).alias("own")).select(
            "doc_id", "content", "own.*"
        )
    )
    nodes = checkpoint(
        rows.groupBy("set_id").agg(F.min("doc_id").alias("least_id"), F.min("content").alias("content"), F.first("print").alias("print"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    candidates = candidate_links(nodes.select("node", "print"), index)
    texts = docs.select(content.alias("content"), text.alias("text"))
    roots = components(similar_links(candidates, nodes.select("node", "content"), texts, shingle, similarity))
    member = nodes.select("node", "set_id", "least_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = member.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = member.join(ids, "root").select("set_id", "component_id")
    return rows.select("doc_id", "content", "set_id").join(named, "set_id").select("doc_id", "content", "component_id").distinct()


def drop_near_copies(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, columns unchanged."""
    groups = near_groups(docs, shingle, similarity, id_col, text_col)
    gone = checkpoint(groups.where(F.col("doc_id") != F.col("component_id")).select("doc_id", "content"))
    keyed = docs.select(
        F.struct("*").alias("row"), F.col(id_col).alias("doc_id"), F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("content")
    )
    return join_small(keyed, gone, ["doc_id", "content"], "left_anti").select("row.*")
