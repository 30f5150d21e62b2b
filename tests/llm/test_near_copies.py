"""Near copies by similarity of shingle sets against all pairs."""

import random

import numpy as np
import pytest
from near_brute import kept_by_brute_force, similar_pairs

from eventloom.llm import exact_dedup, near_copies


def near_copy(words, changes, rng):
    words = list(words)
    for at in rng.sample(range(len(words)), changes):
        words[at] = f"new{rng.getrandbits(30)}"
    return words


def kept(spark, rows):
    return {r.doc_id for r in near_copies.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def changed_at(words, places, rng):
    words = list(words)
    for at in places:
        words[at] = f"new{rng.getrandbits(30)}"
    return words


def test_threshold_repeats_and_short_texts(spark):
    """Pairs just above and below 0.8, texts that repeat lines, and short texts, in one corpus."""
    rng, rows = random.Random(11), []
    words = lambda n: [f"w{rng.randrange(9000)}" for _ in range(n)]
    for i in range(0, 800, 10):
        own = words(300)
        rows += [(i, " ".join(own)), (i + 1, " ".join(changed_at(own, range(10, 290, 40)[: 6 + i % 20 // 10], rng)))]
    for i in range(1000, 1400, 10):
        line, text = words(12), words(100)
        if i % 20:
            rows += [(i, " ".join(text + 20 * line)), (i + 1, " ".join(words(100) + 20 * line))]
        else:
            rows += [(i, " ".join(2 * line + text)), (i + 1, " ".join(6 * line + text))]
    for i in range(2000, 2400, 10):
        own = words(9)
        rows += [(i, " ".join(own)), (i + 1, " ".join(own[:8]))]
    want, got = kept_by_brute_force(rows), kept(spark, rows)
    pairs = len(rows) - len(want)
    assert pairs == 40 + 20 + 40
    assert not want - got and len(got - want) <= 0.05 * pairs


def test_recall_on_the_given_documents(spark):
    """sf0.1: every text of a pair at 0.8 or more goes, nothing else."""
    docs = exact_dedup.drop_copies(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = kept_by_brute_force(rows)
    got = {r.doc_id for r in near_copies.drop_near_copies(docs).collect()}
    low = [p for p in similar_pairs(rows) if p[2] < 0.85]
    lost = [p for p in low if p[0] in got and p[1] in got]
    assert not want - got and len(got - want) <= 0.02 * (len(rows) - len(want)) and len(lost) <= 0.05 * len(low)


@pytest.mark.parametrize("block", [16, 2048])
def test_one_rule_at_every_size(spark, block, monkeypatch):
    """Groups around one text in one block or many: members above and below 0.8, and chains."""
    monkeypatch.setattr(near_copies, "BLOCK", block)
    monkeypatch.setattr(near_copies, "GROUP_BLOCK", 4 * block)
    rng, rows = random.Random(5), []
    for i in range(0, 300, 100):
        words = rng.choices([f"w{n}" for n in range(3000)], k=300)
        for k in range(40):
            rows.append((i + (7 * k) % 40, " ".join(changed_at(words, rng.sample(range(10, 290, 6), k % 10), rng))))
    assert kept(spark, rows) == kept_by_brute_force(rows)


def test_hubs_leave_little_to_compare(spark, monkeypatch):
    """Of 60 members 50 are similar to a hub: they meet the other ten only, and nobody in a component without others."""
    monkeypatch.setattr(near_copies, "BLOCK", 10)
    monkeypatch.setattr(near_copies, "HUBS", 60)
    rows = [(1, n, [*range(100), 1000 + n]) for n in range(50)] + [(1, n, [*range(n * 100, n * 100 + 100)]) for n in range(50, 60)]
    rows += [(2, n, [*range(100), n]) for n in range(100, 130)]
    sets = near_copies.checkpoint(spark.createDataFrame(rows, "key long, node long, own array<bigint>"))
    large = near_copies.checkpoint(sets.groupBy("key").agg(near_copies._blocks().alias("blocks")))
    stars = near_copies.checkpoint(near_copies.hub_stars(sets, large, 0.8))
    assert sorted({(r.key, r.node) for r in stars.collect()}) == [(1, n) for n in range(50)] + [(2, n) for n in range(100, 130)]
    assert stars.select("key", "hub").distinct().count() == 2
    dealt = near_copies._blocked_around(sets, large, stars)
    # One block of ten others meets itself and the five blocks of the star.
    assert dealt.where("key = 1").count() == 50 + 10 * 6 and dealt.where("key = 2").count() == 0
    assert {(r.low, r.high) for r in dealt.collect()} == {(0, n) for n in range(6)}


def test_columns_and_odd_rows(spark):
    text = "some words that are here in a row of ten words"
    rows = [(1, text, "x"), (2, text + " again", "y"), (2, text + " again", "y"), (3, None, None), (4, "", "z"), (None, text, "x"), (5, "!", "z"), (6, " \t", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, content string")
    got = near_copies.drop_near_copies(docs)
    assert got.columns == docs.columns
    assert sorted(str(r.doc_id) for r in got.collect()) == ["1", "3", "5", "None"]
    assert near_copies.drop_near_copies(docs.limit(0)).count() == 0


def test_index_keeps_its_promise():
    for rows in (0, 10**5, 10**7, 10**10):
        index = near_copies.index_for(rows)
        assert near_copies.chance(0.8, index.upper, index.n_segments) >= near_copies.RECALL
        assert rows / 2**index.upper <= 2**near_copies.GROUP_BITS and index.bits * (index.n_segments // index.n_words) <= 64


@pytest.mark.parametrize("listed", [0, 1024])
def test_balls_lose_nothing(listed, monkeypatch):
    monkeypatch.setattr(near_copies, "LISTED", listed)
    rng = np.random.default_rng(listed)
    for n_values in (3, 40, 500):
        nodes = rng.permutation(10_000)[:300]
        values = rng.choice(rng.integers(0, 1 << 16, n_values), 300) ^ (1 << rng.integers(0, 16, 300))
        prints = rng.choice(rng.integers(0, 1 << 63, (60, 2), np.uint64), 300) ^ (np.uint64(1) << rng.integers(0, 63, (300, 2), np.uint64))
        a, b = near_copies.ball_forest(nodes, values, prints, 4)
        assert len(a) < 300 and (a > b).all()
        near = lambda i, j: int(values[i] ^ values[j]).bit_count() <= 2 and np.bitwise_count(prints[i] ^ prints[j]).sum() <= 4
        want = [(nodes[i], nodes[j]) for i in range(300) for j in range(i) if near(i, j)]
        assert want and component_sets(zip(a.tolist(), b.tolist()), nodes.tolist()) == component_sets(want, nodes.tolist())


def component_sets(links, nodes):
    group = {n: {n} for n in nodes}
    for a, b in links:
        if group[a] is not group[b]:
            group[a] |= group[b]
            for n in group[b]:
                group[n] = group[a]
    return [group[n] for n in nodes]
