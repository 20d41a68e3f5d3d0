"""Queries on search evaluation logs, mapped from line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import searchlog
from ..scale import ordered_columns
from . import oracle_base as ob
from .clinical import Clinic
from .q_compare import rounded, scores
from .registry import query

RUN = ["run_id"]
ALGOS = ["A1_random", "A2_greedy", "A3_beam", "SEAS"]
_ORDER = "l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey"
ob.cte("x_log", f"""
SELECT l_suppkey % 20 AS run_id, row_number() OVER (PARTITION BY l_suppkey % 20 ORDER BY {_ORDER}) AS i, CASE WHEN l_partkey % 17 = 0 THEN 'error' ELSE 'ok' END AS status,
 round(0.5 + l_discount * l_quantity / 20 + (l_partkey % 50) / 1000.0, 6) AS c, 'f' || (l_partkey % 6) AS fa, 'f' || (l_suppkey % 9) AS fb, l_quantity > 30 AS hit, l_partkey AS pk FROM lineitem
""")
ob.cte("x_curve", """
SELECT run_id, i, b AS best FROM (SELECT run_id, i, max(CASE WHEN status='ok' THEN c END) OVER (PARTITION BY run_id ORDER BY i) AS b FROM x_log) WHERE b IS NOT NULL
UNION ALL SELECT run_id, max(i) + 100, max(CASE WHEN status='ok' THEN c END) FROM x_log GROUP BY 1
""")


def log(c: Clinic):
    li = c.tables.read("lineitem")
    base = li.select(
        (F.col("l_suppkey") % 20).alias("run_id"), "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.when(F.col("l_partkey") % 17 == 0, "error").otherwise("ok").alias("status"),
        F.round(0.5 + F.col("l_discount") * F.col("l_quantity") / 20 + F.col("l_partkey") % 50 / F.lit(1000.0), 6).alias("cv_c_mean"),
        F.array(F.concat(F.lit("f"), (F.col("l_partkey") % 6).cast("string")), F.concat(F.lit("f"), (F.col("l_suppkey") % 9).cast("string"))).alias("subset"),
        (F.col("l_quantity") > 30).alias("cache_hit"),
    )
    n = c.tables.rows("lineitem")
    return ordered_columns(base, RUN, _ORDER.split(", "), {"logical_eval_idx": ("row",)}, n)


def budgeted(c: Clinic):
    e = log(c)
    budget = e.groupBy("run_id").agg((F.max("logical_eval_idx") + 100).alias("budget"))
    return e.join(budget, "run_id")


def curve(c: Clinic):
    return searchlog.anytime_curve(budgeted(c), RUN, "budget", c.tables.rows("lineitem"))


@query("s11_evaluation_log", "SELECT run_id, status, count(*) AS n, max(i) AS last_idx, round(sum(c), 4) AS total FROM x_log GROUP BY ALL")
def s11_evaluation_log(c: Clinic):
    e = log(c)
    return e.groupBy("run_id", "status").agg(F.count(F.lit(1)).alias("n"), F.max("logical_eval_idx").alias("last_idx"), F.round(F.sum("cv_c_mean"), 4).alias("total"))


@query("w6_anytime_curve", "SELECT run_id, i AS logical_eval_idx, best FROM x_curve")
def w6_anytime_curve(c: Clinic):
    return curve(c).select("run_id", "logical_eval_idx", "best")


@query("w7_anytime_area", """
SELECT run_id, round(sum((best + y) * (i - x) / 2) / max(i), 6) AS auc FROM (SELECT *, lag(i) OVER w AS x, lag(best) OVER w AS y FROM x_curve WINDOW w AS (PARTITION BY run_id ORDER BY i)) GROUP BY 1
""")
def w7_anytime_area(c: Clinic):
    return rounded(searchlog.anytime_area(curve(c), RUN, "budget", 2 * c.tables.rows("lineitem")))


@query("w9_catch_up", """
SELECT k.run_id, target, (SELECT min(i) FROM x_curve v WHERE v.run_id = k.run_id AND v.best >= target) AS catch_up FROM (SELECT DISTINCT run_id, 0.70 + run_id / 400.0::DOUBLE AS target FROM x_log) k
""")
def w9_catch_up(c: Clinic):
    v = curve(c)
    targets = v.select("run_id").distinct().withColumn("target", 0.70 + F.col("run_id") / F.lit(400.0))
    return searchlog.catch_up(v, targets, RUN)


@query("w16_chosen_steps", """
WITH s AS (SELECT run_id, i % 12 AS k, c, CASE WHEN fa < fb THEN fa || ',' || fb ELSE fb || ',' || fa END AS s FROM x_log WHERE status = 'ok') SELECT run_id, k, max(c) AS c, arg_min(s, (-c, s)) AS subset FROM s GROUP BY ALL
""")
def w16_chosen_steps(c: Clinic):
    return searchlog.chosen_steps(log(c).withColumn("k", F.col("logical_eval_idx") % 12), RUN)


ob.cte("x_steps", "SELECT run_id, i % 12 AS step, round(avg(c), 6) AS c FROM x_log WHERE status = 'ok' GROUP BY ALL")


@query("w8_step_gains", """
SELECT run_id, step, round(c - p, 6) AS delta_c, unnest(['g' || (step % 4), 'h' || step]) AS field FROM (SELECT *, lag(c) OVER (PARTITION BY run_id ORDER BY step) AS p FROM x_steps) WHERE c - p > 0
""")
def w8_step_gains(c: Clinic):
    return rounded(_gains(c))


def _gains(c: Clinic):
    e = log(c).where("status = 'ok'").groupBy("run_id", (F.col("logical_eval_idx") % 12).alias("step")).agg(F.round(F.avg("cv_c_mean"), 6).alias("c"))
    path = e.withColumn("added", F.concat(F.lit("g"), (F.col("step") % 4).cast("string"), F.lit(" , h"), F.col("step").cast("string"), F.lit(",")))
    return searchlog.step_gains(path, RUN, c.tables.rows("lineitem"))


@query("a46_growth_counts", """
SELECT field, count(*) AS n FROM (SELECT unnest(['g' || (step % 4), 'h' || step]) AS field FROM (SELECT *, lag(c) OVER (PARTITION BY run_id ORDER BY step) AS p FROM x_steps) WHERE c - p > 0) GROUP BY 1
""")
def a46_growth_counts(c: Clinic):
    return searchlog.growth_counts(_gains(c))


def _paths(c: Clinic):
    f = log(c).groupBy("run_id", (F.col("logical_eval_idx") % 12).alias("k"), (F.col("l_partkey") % 5).alias("fold")).agg(F.round(F.avg("cv_c_mean"), 6).alias("v"))
    return f.groupBy("run_id", "k").agg(F.round(F.avg("v"), 6).alias("c"), F.transform(F.array_sort(F.collect_list(F.struct("fold", "v"))), lambda x: x["v"]).alias("folds"))


@query("w12_stop_replay", """
WITH RECURSIVE v AS (SELECT run_id, i % 12 AS k, pk % 5 AS fold, round(avg(c), 6) AS v FROM x_log GROUP BY ALL),
p AS (SELECT run_id, k, row_number() OVER (PARTITION BY run_id ORDER BY k) AS r, round(avg(v), 6) AS c, list(v ORDER BY fold) AS folds FROM v GROUP BY run_id, k),
s AS (SELECT run_id, 0::BIGINT AS r, 0::BIGINT AS k_star, 0.5::DOUBLE AS best, []::DOUBLE[] AS bf, 0 AS cnt, NULL::BIGINT AS stop_k FROM (SELECT DISTINCT run_id FROM p)
 UNION ALL SELECT run_id, r, CASE WHEN live AND up THEN k ELSE k_star END, CASE WHEN live AND up THEN c ELSE best END, CASE WHEN live AND up THEN folds ELSE bf END, n, CASE WHEN live AND n >= 3 THEN k ELSE stop_k END
 FROM (SELECT *, CASE WHEN NOT live THEN cnt WHEN up THEN 0 WHEN c - best < 0.002 AND pv >= 0.05 THEN cnt + 1 ELSE 0 END AS n
 FROM (SELECT *, stop_k IS NULL AS live, c - best >= 0.002 AND pv < 0.05 AS up
 FROM (SELECT *, CASE WHEN len(d) = 0 THEN 1.0 ELSE len(list_filter(range(1 << len(d)::INTEGER), lambda m: list_sum(list_transform(range(1, len(d) + 1), lambda i: CASE WHEN (m >> (i - 1)::INTEGER) & 1 = 1 THEN r2[i] ELSE 0 END)) >= plus)) / (1 << len(d)::INTEGER)::DOUBLE END AS pv
 FROM (SELECT *, coalesce(list_sum(list_transform(range(1, len(d) + 1), lambda i: CASE WHEN d[i] > 0 THEN r2[i] ELSE 0 END)), 0) AS plus
 FROM (SELECT *, list_transform(d, lambda x: 2 * len(list_filter(d, lambda y: abs(y) < abs(x))) + len(list_filter(d, lambda y: abs(y) = abs(x))) + 1) AS r2
 FROM (SELECT p.*, k_star, best, bf, cnt, stop_k, list_filter(list_transform(range(1, len(folds) + 1), lambda i: folds[i] - coalesce(bf[i], 0.5)), lambda x: x <> 0) AS d FROM s JOIN p ON p.run_id = s.run_id AND p.r = s.r + 1)))))))
SELECT run_id, k_star, cnt AS count, stop_k, CASE WHEN stop_k IS NOT NULL THEN greatest(stop_k - 3, 0) END AS recommended_k FROM s WHERE r = (SELECT max(r) FROM p WHERE p.run_id = s.run_id)
""")
def w12_stop_replay(c: Clinic):
    """Sequential rule over each path, with the exact test of the folds' differences."""
    return searchlog.stop_replay(_paths(c), RUN, 0.002, 3)


@query("w12_stop_replay_gain", """
WITH RECURSIVE f AS (SELECT run_id, i % 12 AS k, round(avg(c), 6) AS v FROM (SELECT *, i % 12 AS kk FROM x_log) GROUP BY ALL), p AS (SELECT run_id, k, row_number() OVER (PARTITION BY run_id ORDER BY k) AS r, v AS c FROM f),
s AS (SELECT run_id, 0::BIGINT AS r, 0::BIGINT AS k_star, 0.5::DOUBLE AS best, 0 AS cnt, NULL::BIGINT AS stop_k FROM (SELECT DISTINCT run_id FROM p)
 UNION ALL SELECT s.run_id, p.r, CASE WHEN stop_k IS NULL AND c - best >= 0.002 THEN p.k ELSE k_star END, CASE WHEN stop_k IS NULL AND c - best >= 0.002 THEN c ELSE best END,
  CASE WHEN stop_k IS NOT NULL THEN cnt WHEN c - best >= 0.002 THEN 0 ELSE cnt + 1 END, CASE WHEN stop_k IS NULL AND c - best < 0.002 AND cnt + 1 >= 3 THEN p.k ELSE stop_k END FROM s JOIN p ON p.run_id = s.run_id AND p.r = s.r + 1)
SELECT run_id, k_star, cnt AS count, stop_k, CASE WHEN stop_k IS NOT NULL THEN greatest(stop_k - 3, 0) END AS recommended_k FROM s WHERE r = (SELECT max(r) FROM p WHERE p.run_id = s.run_id)
""")
def w12_stop_replay_gain(c: Clinic):
    path = log(c).groupBy("run_id", (F.col("logical_eval_idx") % 12).alias("k")).agg(F.round(F.avg("cv_c_mean"), 6).alias("c")).withColumn("folds", F.array(*[F.lit(0.5)] * 5))
    return searchlog.stop_replay(path, RUN, 0.002, 3, "gain_only")


@query("w14_top_subsets", """
WITH r AS (SELECT dataset, field, row_number() OVER (PARTITION BY dataset ORDER BY c DESC, field) AS rank FROM x_fs), p AS (SELECT dataset, max(rank) AS p FROM r GROUP BY 1), k AS (SELECT DISTINCT dataset, k FROM (SELECT dataset, p, unnest([1, 3, 5, 8, 12, 20, p]) AS k FROM p) WHERE k <= p)
SELECT k.dataset, k.k, string_agg(field, ',' ORDER BY rank) AS subset FROM k JOIN r ON r.dataset = k.dataset AND rank <= k.k GROUP BY ALL
""")
def w14_top_subsets(c: Clinic):
    from pyspark.sql import Window

    w = Window.partitionBy("dataset").orderBy(F.desc("c"), "field")
    return searchlog.top_subsets(scores(c).select("dataset", "field", F.row_number().over(w).alias("rank")))


@query("t7_stratified_pick", """
WITH c AS (SELECT dataset, count(*) AS n FROM x_fs GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n, dataset) - 1 AS i, count(*) OVER () AS m FROM c), t AS (SELECT *, CASE WHEN i < m // 3 THEN 0 WHEN i < 2 * m // 3 THEN 1 ELSE 2 END AS stratum FROM r),
s AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY i) - 1 AS j, count(*) OVER (PARTITION BY stratum) AS z FROM t) SELECT dataset, n, stratum FROM s WHERE j IN (0, z // 2, z - 1)
""")
def t7_stratified_pick(c: Clinic):
    return searchlog.stratified_pick(scores(c).groupBy("dataset").agg(F.count(F.lit(1)).alias("n")))


# ---- records ------------------------------------------------------------------
ob.cte("x_recs", """
SELECT 'D' || (o_custkey % 12) AS dataset, 'landmark_0' AS landmark_tag, 'mlp' AS modality, (['A1_random','A2_greedy','A3_beam','SEAS','A0_full'])[(o_orderkey % 5) + 1] AS algorithm, o_custkey % 7 AS seed, round(avg(o_totalprice) / 500000, 4) AS best FROM orders GROUP BY ALL
""")
_ALG = ", ".join(f"'{a}'" for a in ALGOS)
ob.cte("x_means", "SELECT dataset, landmark_tag, modality, algorithm, count(*) AS n_seeds, avg(best) AS mean_best FROM x_recs GROUP BY ALL")
ob.cte("x_ranks", f"SELECT *, rank() OVER (PARTITION BY dataset ORDER BY mean_best DESC) + (count(*) OVER (PARTITION BY dataset, mean_best) - 1) / 2.0 AS r FROM x_means WHERE algorithm IN ({_ALG})")


def records(c: Clinic):
    k = F.col("o_orderkey")
    algo = F.element_at(F.array(*[F.lit(a) for a in [*ALGOS, "A0_full"]]), (k % 5 + 1).cast("int"))
    return c.tables.read("orders").groupBy(
        F.concat(F.lit("D"), (F.col("o_custkey") % 12).cast("string")).alias("dataset"), F.lit("landmark_0").alias("landmark_tag"),
        F.lit("mlp").alias("modality"), algo.alias("algorithm"), (F.col("o_custkey") % 7).alias("seed"),
    ).agg(F.round(F.avg("o_totalprice") / 500000, 4).alias("best"))


@query("a42_gap_table", f"""
SELECT m.dataset, m.landmark_tag, m.modality, algorithm, n_seeds, round(mean_best, 6) AS mean_best, round(gt_c - mean_best, 6) AS gap_to_best, gt_algo, algorithm NOT IN ({_ALG}) AS reference
FROM x_means m JOIN (SELECT dataset, max(mean_best) AS gt_c, arg_min(algorithm, (-mean_best, algorithm)) AS gt_algo FROM x_means WHERE algorithm IN ({_ALG}) GROUP BY 1) g ON g.dataset = m.dataset
""")
def a42_gap_table(c: Clinic):
    return rounded(searchlog.gap_table(records(c), ALGOS))


@query("a43_win_rates", f"""
SELECT m.algorithm, count(*) AS n_instances, count_if(m.mean_best > b.mean_best) AS n_wins, round(count_if(m.mean_best > b.mean_best) / CAST(count(*) AS DOUBLE), 6) AS win_rate, round(avg(m.mean_best - b.mean_best), 6) AS mean_difference
FROM x_means m JOIN x_means b ON b.dataset = m.dataset AND b.algorithm = 'A2_greedy' WHERE m.algorithm IN ({_ALG}) AND m.algorithm <> 'A2_greedy' GROUP BY 1
""")
def a43_win_rates(c: Clinic):
    return rounded(searchlog.win_rates(records(c), ALGOS, "A2_greedy"))


@query("w5_mean_ranks", "SELECT algorithm, count(*) AS n_instances, round(avg(r), 6) AS mean_rank, count_if(r = 1) AS n_first FROM x_ranks GROUP BY 1")
def w5_mean_ranks(c: Clinic):
    return rounded(searchlog.mean_ranks(records(c), ALGOS)).drop("mean_auc")


@query("a44_decision", f"""
WITH r AS (SELECT algorithm, avg(r) AS m FROM x_ranks GROUP BY 1), b AS (SELECT arg_min(algorithm, (m, algorithm)) AS a FROM r WHERE algorithm <> 'A2_greedy'),
d AS (SELECT a, (SELECT avg(x.mean_best - y.mean_best) FROM x_means x JOIN x_means y ON x.dataset = y.dataset WHERE x.algorithm = a AND y.algorithm = 'A2_greedy') AS adv, (SELECT m FROM r WHERE algorithm = 'SEAS') AS s FROM b)
SELECT CASE WHEN adv >= 0.005 THEN a WHEN adv > 0 THEN NULL ELSE 'A2_greedy' END AS winner, a AS best_competitor, round(adv, 6) AS advantage, adv > 0 AND adv < 0.005 AS ambiguous, round(s, 6) AS seas_rank, s <= 2.0 AS run_ablations FROM d
""")
def a44_decision(c: Clinic):
    return rounded(searchlog.decision(records(c), ALGOS, "A2_greedy"))


@query("a45_seed_hypothesis", """
WITH p AS (SELECT a.dataset, avg(a.best - b.best) AS d FROM x_recs a JOIN x_recs b ON a.dataset = b.dataset AND a.seed = b.seed AND a.algorithm = 'A2_greedy' AND b.algorithm = 'A0_full' GROUP BY 1)
SELECT count(*) AS n_instances, count_if(d >= 0.005) AS n_meets, round(count_if(d >= 0.005) / CAST(count(*) AS DOUBLE), 6) AS fraction, count_if(d >= 0.005) / CAST(count(*) AS DOUBLE) >= 2.0 / 3 AS supported FROM p
""")
def a45_seed_hypothesis(c: Clinic):
    return rounded(searchlog.seed_hypothesis(records(c).withColumnRenamed("best", "cv_c_mean"), "A2_greedy", "A0_full"))


@query("a45_baseline_hypothesis", """
WITH r AS (SELECT algorithm, avg(r) AS m FROM (SELECT *, rank() OVER (PARTITION BY dataset ORDER BY mean_best DESC) + (count(*) OVER (PARTITION BY dataset, mean_best) - 1) / 2.0 AS r FROM x_means WHERE algorithm IN ('A1_random','A2_greedy','A3_beam')) GROUP BY 1), b AS (SELECT arg_min(algorithm, (m, algorithm)) AS a FROM r)
SELECT a AS strongest, count(*) AS comparisons, count_if(x.mean_best > y.mean_best) AS wins, round(count_if(x.mean_best > y.mean_best) / CAST(count(*) AS DOUBLE), 6) AS win_rate, count_if(x.mean_best > y.mean_best) / CAST(count(*) AS DOUBLE) >= 0.6 AS supported
FROM b, x_means x JOIN x_means y ON x.dataset = y.dataset WHERE x.algorithm = 'SEAS' AND y.algorithm = a GROUP BY a
""")
def a45_baseline_hypothesis(c: Clinic):
    return rounded(searchlog.baseline_hypothesis(records(c), ["A1_random", "A2_greedy", "A3_beam"], "SEAS"))


@query("a33_seed_records", """
WITH s AS (SELECT run_id, i, status, c, hit, CASE WHEN fa = fb THEN fa WHEN fa < fb THEN fa || ',' || fb ELSE fb || ',' || fa END AS s FROM x_log), w AS (SELECT run_id, 'f' || (run_id % 6) || CASE WHEN run_id % 6 = 3 THEN '' ELSE ',f3' END AS raw FROM (SELECT DISTINCT run_id FROM x_log)),
t AS (SELECT run_id, CASE WHEN run_id % 6 = 3 THEN 'f3' WHEN run_id % 6 < 3 THEN 'f' || (run_id % 6) || ',f3' ELSE 'f3,f' || (run_id % 6) END AS s FROM w)
SELECT t.run_id, (SELECT arg_max(c, i) FROM s WHERE s.run_id = t.run_id AND s.s = t.s AND status = 'ok') AS cv_c_mean, len(string_split(t.s, ',')) AS recommended_k, n AS logical_evals, h AS cache_hits, round(h / CAST(n AS DOUBLE), 6) AS cache_rate, round(e / CAST(n AS DOUBLE), 6) AS failure_rate
FROM t JOIN (SELECT run_id, count(*) AS n, count_if(hit) AS h, count_if(status = 'error') AS e FROM x_log GROUP BY 1) USING (run_id)
""")
def a33_seed_records(c: Clinic):
    """A33 recommended evaluation by X5 set equality."""
    e = log(c)
    res = e.select("run_id").distinct().withColumn("recommended", F.array(F.lit("f3"), F.concat(F.lit("f"), (F.col("run_id") % 6).cast("string")), F.lit("f3")))
    return rounded(searchlog.seed_records(res, e, RUN))


@query("a32_seed_aggregate", """
SELECT g, count(*) AS n_seeds, round(avg(m), 6) AS cv_c_mean, round(stddev_samp(m), 6) AS cv_c_std, round(avg(n), 6) AS logical_evals_mean, round(avg(e / CAST(n AS DOUBLE)), 6) AS failure_rate FROM (SELECT run_id % 4 AS g, run_id, max(CASE WHEN status='ok' THEN c END) AS m, count(*) AS n, count_if(status='error') AS e FROM x_log GROUP BY ALL) GROUP BY 1
""")
def a32_seed_aggregate(c: Clinic):
    ok = F.col("status") == "ok"
    seeds = log(c).groupBy((F.col("run_id") % 4).alias("g"), "run_id").agg(
        F.max(F.when(ok, F.col("cv_c_mean"))).alias("cv_c_mean"), F.count(F.lit(1)).alias("logical_evals"),
        (F.count_if(~ok) / F.count(F.lit(1))).alias("failure_rate"), F.lit(2).alias("recommended_k"), F.lit(0.0).alias("cache_rate"))
    return rounded(searchlog.seed_aggregate(seeds, ["g"])).drop("recommended_k_mean", "cache_rate")


@query("s17_first_runs", """
SELECT dataset, seed, path, CAST(regexp_extract(path, 'cap_([0-9]+)', 1) AS INTEGER) AS cap FROM (SELECT *, row_number() OVER (PARTITION BY dataset, seed ORDER BY layout, path) AS r FROM (SELECT o_custkey % 50 AS dataset, o_custkey % 3 AS seed, o_orderkey % 2 AS layout, 'runs/cap_' || (o_orderkey % 500) || '/k' || o_orderkey AS path FROM orders)) WHERE r = 1
""")
def s17_first_runs(c: Clinic):
    k = F.col("o_orderkey")
    runs = c.tables.read("orders").select(
        (F.col("o_custkey") % 50).alias("dataset"), (F.col("o_custkey") % 3).alias("seed"), (k % 2).alias("layout"),
        F.concat(F.lit("runs/cap_"), (k % 500).cast("string"), F.lit("/k"), k.cast("string")).alias("path"))
    return searchlog.first_runs(runs, ["dataset", "seed"], ["layout", "path"]).drop("layout")


@query("m14_optimality_gaps", """
SELECT a.dataset, a.landmark_tag, a.modality, a.algorithm, round(b.best - a.best, 6) AS gap FROM x_recs a JOIN x_recs b ON a.dataset = b.dataset AND a.seed = b.seed AND b.algorithm = 'A0_full' AND a.algorithm <> 'A0_full'
""")
def m14_optimality_gaps(c: Clinic):
    r = records(c).withColumn("fields", F.array(F.concat(F.lit("s"), F.col("seed").cast("string")), F.lit("a"), F.lit("a")))
    return rounded(searchlog.optimality_gaps(r, "A0_full"))
