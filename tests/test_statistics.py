"""Survival and paired statistics against hand examples and brute force."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from chartloom.operators import inference, searchlog, survival


def test_breslow_hand_example(spark):
    df = spark.createDataFrame([(1, 1.0, True, 0.0), (1, 2.0, False, 0.0), (1, 3.0, True, 0.0)], "g int, time double, event boolean, risk double")
    asks = spark.createDataFrame([(1, t) for t in (0.5, 1.0, 2.0, 3.0, 4.0)], "g int, time double")
    got = {r["time"]: r["value"] for r in survival.hazard_at(survival.baseline_hazard(df, ["g"]), asks, ["g"]).collect()}
    assert [got[t] for t in (0.5, 1.0, 2.0, 3.0, 4.0)] == pytest.approx([0, 1 / 3, 5 / 6, 4 / 3, 4 / 3])


def test_logits_and_interpolation(spark):
    df = spark.createDataFrame([([0.0] * 4,)], "l array<double>")
    assert df.select(survival.survival_columns(F.col("l"))).first()[0] == pytest.approx([0.5, 0.25, 0.125, 0.0625])
    s = F.array(*[F.lit(x) for x in (0.9, 0.7, 0.5, 0.4)])
    asks = spark.createDataFrame([(t,) for t in (0.0, 5.0, 10.0, 15.0, 40.0, 41.0)], "t double")
    got = [r[0] for r in asks.select(survival.interpolated(s, [10.0, 20.0, 30.0, 40.0], F.col("t"))).collect()]
    assert got == pytest.approx([1.0, 0.95, 0.9, 0.8, 0.4, 0.0])


def test_no_comparable_pair_gives_zero(spark):
    df = spark.createDataFrame([(1, 1.0, False, 0.0), (1, 2.0, False, 1.0)], "g int, time double, event boolean, risk double")
    assert survival.concordance(df, ["g"]).first()["c_index"] == 0.0


def exact_p(d):
    d = [x for x in d if x]
    if not d:
        return 1.0
    rank = [sum(abs(y) < abs(x) for y in d) + (sum(abs(y) == abs(x) for y in d) + 1) / 2 for x in d]
    plus = sum(r for x, r in zip(d, rank) if x > 0)
    sums = [sum(r for s, r in zip(signs, rank) if s) for signs in itertools.product((0, 1), repeat=len(d))]
    return sum(w >= plus - 1e-9 for w in sums) / len(sums)


def test_signed_rank_exact_and_normal(spark):
    rng = random.Random(2)
    groups = {g: [rng.choice([-3, -2, -1, 0, 1, 2, 3, 4]) / 10 for _ in range(n)] for g, n in enumerate((5, 5, 8, 12))}
    groups[9] = [0.0, 0.0]
    rows = [(g, x) for g, xs in groups.items() for x in xs]
    df = spark.createDataFrame(rows, "g int, d double")
    got = {r["g"]: r for r in inference.signed_rank(df, ["g"], "d").collect()}
    for g, xs in groups.items():
        assert got[g]["p_greater"] == pytest.approx(exact_p(xs))
    # all positive fold differences: p = 1/32
    five = spark.createDataFrame([(1, x) for x in (0.1, 0.2, 0.3, 0.4, 0.5)], "g int, d double")
    assert inference.signed_rank(five, ["g"], "d").first()["p_greater"] == pytest.approx(1 / 32)
    many = spark.createDataFrame([(1, float(i - 30) or 0.5) for i in range(100)], "g int, d double")
    r = inference.signed_rank(many, ["g"], "d").first()
    d = [float(i - 30) or 0.5 for i in range(100)]
    rank = [sum(abs(y) < abs(x) for y in d) + (sum(abs(y) == abs(x) for y in d) + 1) / 2 for x in d]
    plus = sum(k for x, k in zip(d, rank) if x > 0)
    ties = sum(t**3 - t for t in (sum(abs(y) == v for y in d) for v in {abs(x) for x in d}))
    z = (plus - 100 * 101 / 4) / math.sqrt((100 * 101 * 201 - ties / 2) / 24)
    assert r["p_greater"] == pytest.approx(0.5 * math.erfc(z / math.sqrt(2)))


def test_stop_replay_matches_a_loop(spark):
    rng = random.Random(7)
    rows, paths = [], {}
    for run in range(6):
        base = 0.5
        for k in range(1, 15):
            base += rng.choice([0.02, 0.004, 0.0, -0.01])
            folds = [round(base + rng.uniform(-0.02, 0.02), 4) for _ in range(5)]
            c = sum(folds) / 5
            rows.append((run, k, c, folds))
            paths.setdefault(run, []).append((k, c, folds))
    df = spark.createDataFrame(rows, "run int, k long, c double, folds array<double>")
    for mode in ("sig", "gain_only"):
        got = {r["run"]: r for r in searchlog.stop_replay(df, ["run"], 0.005, 3, mode).collect()}
        for run, path in paths.items():
            k_star, best, best_folds, count, stop = 0, 0.5, [0.5] * 5, 0, None
            for k, c, folds in path:
                if stop is not None:
                    break
                gain, p = c - best, exact_p([a - b for a, b in zip(folds, best_folds)])
                improved = gain >= 0.005 and (mode == "gain_only" or p < 0.05)
                up = gain < 0.005 and (mode == "gain_only" or p >= 0.05)
                if improved:
                    k_star, best, best_folds, count = k, c, folds, 0
                else:
                    count = count + 1 if up else 0
                stop = k if count >= 3 else None
            assert (got[run]["k_star"], got[run]["stop_k"]) == (k_star, stop)


def test_anytime_area_and_catch_up(spark):
    log = spark.createDataFrame([(1, i, v, "ok", 4) for i, v in ((1, 0.5), (2, 0.6), (3, 0.55))], "run int, logical_eval_idx long, cv_c_mean double, status string, budget int")
    curve = searchlog.anytime_curve(log, ["run"], "budget")
    assert searchlog.anytime_area(curve, ["run"], "budget").first()["auc"] == pytest.approx(0.4375)
    targets = spark.createDataFrame([(1, 0.59)], "run int, target double")
    assert searchlog.catch_up(curve, targets, ["run"]).first()["catch_up"] == 2


def test_gap_table_reference(spark):
    rows = [("GBM", "l", "m", a, s) for a, s in (("A2_greedy", 0.66), ("SEAS", 0.68), ("A0_full", 0.70))]
    df = spark.createDataFrame(rows, "dataset string, landmark_tag string, modality string, algorithm string, best double")
    got = {r["algorithm"]: r for r in searchlog.gap_table(df, ["A2_greedy", "SEAS"]).collect()}
    assert got["A2_greedy"]["gap_to_best"] == pytest.approx(0.02) and got["A0_full"]["reference"]
    assert got["A0_full"]["gap_to_best"] == pytest.approx(-0.02)
