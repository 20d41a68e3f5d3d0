"""Overlaps of dataset pairs against all pairs by hand, whatever the blocks."""

import itertools
import random
import statistics

import pytest

from chartloom.operators import compare

COLUMNS = "dataset string, field string, c double"


def by_hand(rows, k):
    best = {}
    for d in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == d), key=lambda r: (-r[2], r[1]))[:k]
        best[d] = {f for _, f, _ in own}
    return {(a, b): (len(best[a] & best[b]), len(best[a] | best[b])) for a, b in itertools.combinations(sorted(best), 2)}


@pytest.mark.parametrize("block", [2, 2000])
def test_overlaps_equal_all_pairs(spark, block):
    rng = random.Random(6)
    # every dataset has the field "hot" in front; some share nothing else
    rows = [(f"D{d}", "hot", 0.99) for d in range(8)]
    rows += [(f"D{d}", f"f{rng.randint(0, 30)}_{i}", rng.random() * 0.9) for d in range(11) for i in range(6)]
    df = spark.createDataFrame(rows, COLUMNS)
    ks = [1, 3, 7]
    pairs = {(r["k"], r["a"], r["b"]): (r["shared"], r["jaccard"]) for r in compare.pair_overlap(df, ks, block).collect()}
    summary = {r["k"]: r for r in compare.overlap_summary(df, ks, block).collect()}
    for k in ks:
        hand = by_hand(rows, k)
        assert {p: s for p, (s, _) in hand.items() if s} == {(a, b): v[0] for (x, a, b), v in pairs.items() if x == k}
        shares = [s / k for s, _ in hand.values()]
        got = summary[k]
        assert got["n_pairs"] == len(hand) and got["n_empty_pairs"] == shares.count(0)
        assert (got["min_overlap"], got["max_overlap"]) == (min(shares), max(shares))
        assert got["mean_overlap"] == pytest.approx(statistics.mean(shares))
        assert got["median_overlap"] == pytest.approx(statistics.median(shares))
        assert got["mean_jaccard"] == pytest.approx(statistics.mean(s / u for s, u in hand.values()))


def test_overlaps_of_few_datasets(spark):
    apart = spark.createDataFrame([("A", "x", 0.5), ("B", "y", 0.5)], COLUMNS)
    row = compare.overlap_summary(apart, [2]).first()
    assert (row["n_pairs"], row["n_empty_pairs"], row["median_overlap"], row["min_overlap"]) == (1, 1, 0.0, 0.0)
    alone = compare.overlap_summary(apart.where("dataset = 'A'"), [2]).first()
    assert (alone["n_pairs"], alone["mean_overlap"], alone["n_union_fields"]) == (0, None, 1)
    assert compare.overlap_summary(apart.where("false"), [2]).count() == 0
