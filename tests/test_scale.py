"""Oversized groups: the cut path must equal the plain one."""

import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chartloom import scale
from chartloom.operators import encode, inference, survival
from chartloom.scale import exact_quantiles, next_at_or_after, ordered_columns, value_ranks


def skewed(spark, n=400, seed=1):
    rng = random.Random(seed)
    rows = [("hot" if i % 3 else f"k{i % 5}", rng.randint(0, 40), i, rng.choice([None, 1.0, 2.5, -3.0])) for i in range(n)]
    return spark.createDataFrame(rows, "g string, v long, id long, x double")


def test_ordered_columns_cut_equals_plain(spark):
    df = skewed(spark)
    spec = {"r": ("row",), "s": ("sum", "v"), "m": ("max", "x"), "l": ("lag", "v"), "lo": ("min", "v")}
    plain = ordered_columns(df, ["g"], ["v", "id"], spec, rows=400)
    cut = ordered_columns(df, ["g"], ["v", "id"], spec, rows=None, limit=30)
    a = sorted(map(tuple, plain.select(*sorted(plain.columns)).collect()), key=str)
    b = sorted(map(tuple, cut.select(*sorted(cut.columns)).collect()), key=str)
    assert a == b and len(a) == 400


def test_no_key_group_is_cut(spark):
    df = skewed(spark)
    out = ordered_columns(df, [], ["id"], {"r": ("row",)}, rows=None, limit=50).orderBy("id").collect()
    assert [r["r"] for r in out] == list(range(1, 401))


def test_exact_quantiles_both_paths(spark):
    df = skewed(spark).where("v is not null")
    probs = {"q1": 0.25, "q5": 0.5, "q9": 0.9}
    truth = {}
    for r in df.collect():
        truth.setdefault(r["g"], []).append(r["v"])
    for kwargs in ({"rows": 400}, {"rows": None, "limit": 20}):
        for r in exact_quantiles(df, ["g"], "v", probs, **kwargs).collect():
            for name, p in probs.items():
                assert r[name] == pytest.approx(np.quantile(truth[r["g"]], p))


def test_value_ranks_share_ties(spark):
    df = spark.createDataFrame([("a", x) for x in (1, 2, 2, 5)], "g string, v long")
    got = {r["v"]: r["avg_rank"] for r in value_ranks(df, ["g"], "v").collect()}
    assert got == {1: 1.0, 2: 2.5, 5: 4.0}


def brute_pairs(rows):
    comparable = concordant = tied = 0
    for t, e, r in rows:
        if not e:
            continue
        for u, f, s in rows:
            if u > t or (u == t and not f):
                comparable += 1
                if abs(r - s) <= 1e-8:
                    tied += 1
                elif r > s:
                    concordant += 1
    return comparable, concordant, tied


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 6), st.booleans(), st.integers(-3, 3)), min_size=1, max_size=60))
def test_pair_counts_equal_brute_force(rows):
    import pandas as pd

    pdf = pd.DataFrame(rows, columns=["time", "event", "risk"])
    pdf = pdf.groupby(["time", "event", "risk"]).size().reset_index(name="n")
    pdf["weight"] = 1.0
    concordant, tied = survival._pairs(pdf)
    _, c, t = brute_pairs(rows)
    assert (concordant, tied) == (c, t)


@pytest.mark.parametrize("seed", [3, 4])
def test_concordance_cut_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    # one time holds a third of all rows
    rows = [(1 if rng.random() < 0.7 else 2, 7.0 if rng.random() < 0.33 else float(rng.randint(0, 30)), rng.random() < 0.5, rng.randint(0, 25) / 5) for _ in range(500)]
    df = spark.createDataFrame(rows, "g int, time double, event boolean, risk double")
    cut = {r["g"]: r for r in survival.concordance(df, ["g"], rows=None, limit=40).collect()}
    plain = {r["g"]: r for r in survival.concordance(df, ["g"], rows=500).collect()}
    for g in (1, 2):
        comparable, concordant, tied = brute_pairs([r[1:] for r in rows if r[0] == g])
        for got in (cut[g], plain[g]):
            assert (got["comparable"], got["concordant"], got["tied"]) == (comparable, concordant, tied)


def test_neighbours_do_not_depend_on_blocks(spark):
    rng = np.random.default_rng(0)
    rows = [(i % 2, i, [float(x) for x in rng.normal(size=6)]) for i in range(60)]
    df = spark.createDataFrame(rows, "g int, id int, v array<double>")
    one = {tuple(r) for r in encode.neighbour_pairs(df, "g", "id", "v", 3).collect()}
    many = {tuple(r) for r in encode.neighbour_pairs(df, "g", "id", "v", 3, block=7).collect()}
    assert one == many and one


def test_bootstrap_interval_and_repeatability(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(1.0, 2.0, 300)
    df = spark.createDataFrame([("a", i, float(x)) for i, x in enumerate(v)], "g string, i int, v double")
    whole = inference.bootstrap_mean(df, ["g"], "v", ["i"], 1000).first()
    again = inference.bootstrap_mean(df, ["g"], "v", ["i"], 1000).first()
    half = 1.96 * v.std(ddof=1) / np.sqrt(len(v))
    assert whole == again
    assert whole["n"] == 300
    assert whole["ci_lo"] == pytest.approx(v.mean() - half, abs=0.06)
    assert whole["ci_hi"] == pytest.approx(v.mean() + half, abs=0.06)


def test_bootstrap_over_blocks(spark):
    rng = np.random.default_rng(8)
    v = rng.normal(-2.0, 1.5, 330)
    df = spark.createDataFrame([("a", i, float(x)) for i, x in enumerate(v)] + [("b", 0, 4.5), ("c", 0, None)], "g string, i int, v double")
    got = {r["g"]: r for r in inference.bootstrap_mean(df, ["g"], "v", ["i"], 2000, block=64).collect()}
    half = 1.96 * v.std(ddof=1) / np.sqrt(len(v))
    assert got["a"]["ci_lo"] == pytest.approx(v.mean() - half, abs=0.04)
    assert got["a"]["ci_hi"] == pytest.approx(v.mean() + half, abs=0.04)
    assert (got["b"]["n"], got["b"]["ci_lo"], got["b"]["ci_hi"]) == (1, 4.5, 4.5) and "c" not in got


def test_draws_of_blocks_are_multinomial():
    n, block, replicates = 330, 64, 4000
    counts = np.array([inference.draws_of_block("a", n, block, at, replicates) for at in range(6)])
    assert (counts.sum(axis=0) == n).all() and (counts >= 0).all()
    share = np.array([64] * 5 + [10]) / n
    assert counts.mean(axis=1) == pytest.approx(n * share, rel=0.03)
    assert counts.var(axis=1) == pytest.approx(n * share * (1 - share), rel=0.1)
    # what one block gets the others lose
    assert np.cov(counts[0], counts[4])[0, 1] == pytest.approx(-n * share[0] * share[4], rel=0.2)
    assert (inference.draws_of_block("a", 64, 64, 0, 3) == 64).all()


@pytest.mark.parametrize("limit", [4_000_000, 15])
def test_next_event_at_or_after(spark, limit):
    rng, inf, nan = random.Random(4), float("inf"), float("nan")
    days = [None, nan, inf, -inf, -7.0, *[float(d) for d in range(0, 60, 7)]]
    asks = [("hot" if i % 3 else rng.choice(["x", "y", None]), i, rng.choice([*days, 1.5, 13.0, 99.0])) for i in range(150)]
    events = [(rng.choice(["hot", "x", None]), rng.choice(days)) for _ in range(60)]
    got = next_at_or_after(
        spark.createDataFrame(asks, "k string, i int, ask double"), spark.createDataFrame(events, "k string, day double"),
        ["k"], "ask", "day", "next", limit=limit,
    )
    assert got.columns == ["k", "i", "ask", "next"]
    expect = {}
    for k, i, ask in asks:
        later = [d for g, d in events if g == k and d is not None and d == d and ask is not None and d >= ask]
        expect[i] = min(later) if later and ask != -inf else None
    assert {r["i"]: r["next"] for r in got.collect()} == expect
    none = spark.createDataFrame([], "k string, day double")
    alone = next_at_or_after(spark.createDataFrame(asks, "k string, i int, ask double"), none, ["k"], "ask", "day", "next", limit=limit)
    assert alone.count() == len(asks) and alone.where("next is not null").count() == 0


def test_asks_of_one_place_are_cut_and_sizes_come_from_measured(spark):
    asks = spark.createDataFrame([("hot", i, None if i % 2 else 5.0) for i in range(400)], "k string, i int, ask double").repartition(4)
    _, cut = scale._split(asks, ["k"], ["ask"], None, 50, measured=asks.select("k"), ties=True)
    sizes = [r["count"] for r in cut.groupBy("_range").count().collect()]
    assert sum(sizes) == 400 and max(sizes) < 150
    events = spark.createDataFrame([("hot", 4.0), ("hot", 9.0), ("hot", 5.0)], "k string, day double")
    got = next_at_or_after(asks, events, ["k"], "ask", "day", "next", limit=50, measured=asks.select("k"))
    assert {(r["ask"], r["next"]) for r in got.collect()} == {(None, None), (5.0, 5.0)} and got.count() == 400
    assert scale._split(asks, ["k"], ["ask"], None, 50, measured=asks.limit(10))[1] is None


def test_quantiles_count_their_input_once(spark, monkeypatch):
    written, write = [], scale.checkpointed
    monkeypatch.setattr(scale, "checkpointed", lambda df: written.append(df) or write(df))
    df = skewed(spark).select(F.when(F.col("g") != "k1", F.col("g")).alias("g"), "v")
    cut = exact_quantiles(df, ["g"], "v", {"mid": 0.5}, None, 20)
    assert {(r["g"], r["mid"]) for r in cut.collect()} == {(r["g"], r["mid"]) for r in exact_quantiles(df, ["g"], "v", {"mid": 0.5}, 400).collect()}
    assert "n" in written[0].columns and "ExistingRDD" not in cut._jdf.queryExecution().toString()


def test_vocabulary_reads_its_categories_once(spark):
    rows = spark.createDataFrame([("f", c) for c in "aabbbc"] + [("g", "z")], "field_path string, category string")
    out = encode.vocabulary(rows, ["field_path"], 2)
    assert "ExistingRDD" not in out._jdf.queryExecution().toString()
    assert {tuple(r) for r in out.collect()} == {
        ("f", "__MISSING__", 0), ("f", "__OTHER__", 1), ("f", "a", 2), ("f", "b", 3), ("g", "__MISSING__", 0), ("g", "__OTHER__", 1)}
