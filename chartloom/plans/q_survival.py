"""Queries on survival statistics and paired tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import inference, survival
from ..scale import checkpointed
from . import oracle_base as ob
from .clinical import Clinic
from .q_timing import labels
from .registry import query

KEYS = ["run_id", "fold"]
GRID = [float(t) for t in range(1, 61)]
LANDMARKS = {24.0: 5, 60.0: 5}

ob.cte("x_pred", """
SELECT CAST(c_nationkey % 5 AS BIGINT) AS run_id, c_custkey % 3 AS fold, l.case_id, l.survival_months AS time, l.censorship = 0 AS event,
 CASE WHEN c_custkey % 50 = 7 THEN NULL ELSE round(c_acctbal / 1000) / 10 END AS risk
FROM x_labels l JOIN customer ON c_custkey = l.patient_id
""")
ob.cte("x_use", "SELECT * FROM x_pred WHERE risk IS NOT NULL AND time >= 0")
ob.cte("x_km", """
SELECT run_id, fold, time, n, d, c, sum(n) OVER (PARTITION BY run_id, fold ORDER BY time DESC) AS at_risk FROM (SELECT run_id, fold, time, count(*) AS n, count_if(event) AS d, count_if(NOT event) AS c FROM x_use GROUP BY ALL)
""")
ob.cte("x_g", """
SELECT run_id, fold, time, product(CASE WHEN c > 0 THEN 1 - c / (at_risk - d) ELSE 1 END) OVER (PARTITION BY run_id, fold ORDER BY time) AS g FROM x_km
""")
ob.cte("x_useg", "SELECT u.*, g FROM x_use u JOIN x_g USING (run_id, fold, time)")
ob.cte("x_h", """
SELECT run_id, fold, time, sum(d / pool) OVER (PARTITION BY run_id, fold ORDER BY time) AS hazard FROM (
 SELECT run_id, fold, time, d, sum(x) OVER (PARTITION BY run_id, fold ORDER BY time DESC) AS pool FROM (SELECT run_id, fold, time, count_if(event) AS d, sum(exp(risk)) AS x FROM x_use GROUP BY ALL)) WHERE d > 0
""")
ob.cte("x_grid", """
SELECT k.run_id, k.fold, t,
 coalesce((SELECT min(g) FROM x_g g WHERE g.run_id = k.run_id AND g.fold = k.fold AND g.time <= t), 1.0) AS gt,
 (SELECT max(time) FROM x_h h WHERE h.run_id = k.run_id AND h.fold = k.fold AND h.time <= t) AS t0, (SELECT max(hazard) FROM x_h h WHERE h.run_id = k.run_id AND h.fold = k.fold AND h.time <= t) AS h0,
 (SELECT min(time) FROM x_h h WHERE h.run_id = k.run_id AND h.fold = k.fold AND h.time >= t) AS t1, (SELECT min(hazard) FROM x_h h WHERE h.run_id = k.run_id AND h.fold = k.fold AND h.time >= t) AS h1
FROM (SELECT DISTINCT run_id, fold FROM x_use) k, (SELECT CAST(unnest(range(1, 61)) AS DOUBLE) AS t)
""")
ob.cte("x_gridh", "SELECT *, CASE WHEN h0 IS NULL THEN 0 WHEN h1 IS NULL OR t0 = t THEN h0 ELSE h0 + (h1 - h0) * (t - t0) / (t1 - t0) END AS ht FROM x_grid")
ob.cte("x_brier", """
SELECT u.run_id, u.fold, t, avg(CASE WHEN time <= t AND event THEN CASE WHEN g > 0 THEN pow(exp(-ht * exp(risk)), 2) / g ELSE 0 END WHEN time > t THEN CASE WHEN gt > 0 THEN pow(1 - exp(-ht * exp(risk)), 2) / gt ELSE 0 END ELSE 0 END) AS brier
FROM x_useg u JOIN x_gridh k ON u.run_id = k.run_id AND u.fold = k.fold GROUP BY ALL
""")
ob.cte("x_auc", """
SELECT c.run_id, c.fold, landmark, sum(CASE WHEN c.risk > o.risk THEN 1.0 / c.g WHEN c.risk = o.risk THEN 0.5 / c.g ELSE 0 END) / sum(1.0 / c.g) AS auc, count(DISTINCT c.case_id) AS n
FROM (SELECT unnest([24.0, 60.0]) AS landmark) l JOIN x_useg c ON c.event AND c.time <= landmark JOIN x_useg o ON o.run_id = c.run_id AND o.fold = c.fold AND o.time > landmark GROUP BY ALL
""")
_PAIRS = """SELECT i.run_id, i.fold, count(*) AS comparable, count_if(i.risk - j.risk > 1e-8) AS concordant, count_if(abs(i.risk - j.risk) <= 1e-8) AS tied,
 sum(1.0 / (i.g * i.g)) AS wcomp, sum(CASE WHEN abs(i.risk - j.risk) <= 1e-8 THEN 0.5 WHEN i.risk > j.risk THEN 1 ELSE 0 END / (i.g * i.g)) AS wconc
 FROM x_useg i JOIN x_useg j ON i.run_id = j.run_id AND i.fold = j.fold AND i.event AND (j.time > i.time OR (j.time = i.time AND NOT j.event)) GROUP BY ALL"""
ob.cte("x_c", f"""SELECT k.run_id, k.fold, coalesce(comparable, 0) AS comparable, coalesce(concordant, 0) AS concordant, coalesce(tied, 0) AS tied,
 coalesce((concordant + 0.5 * tied) / comparable, 0.0) AS c_index, coalesce(wconc / wcomp, 0.0) AS c_ipcw FROM (SELECT DISTINCT run_id, fold FROM x_use) k LEFT JOIN ({_PAIRS}) p ON p.run_id = k.run_id AND p.fold = k.fold""")


def predictions(c: Clinic):
    """Prediction table of the mapping: risk from the account balance, some of it missing."""
    cust = c.tables.read("customer")
    key = F.col("c_custkey")
    risk = F.when(key % 50 == 7, None).otherwise(F.round(F.col("c_acctbal") / 1000) / 10)
    return labels(c).join(cust, F.col("patient_id") == key).select(
        (F.col("c_nationkey") % 5).cast("long").alias("run_id"), (key % 3).alias("fold"), "case_id",
        F.col("survival_months").alias("time"), (F.col("censorship") == 0).alias("event"), risk.alias("risk"),
    )


def usable(c: Clinic):
    return survival.metric_rows(predictions(c), KEYS)[0]


def bound(c: Clinic) -> int:
    return c.tables.rows("customer")


@query("f14_metric_rows", """
SELECT run_id, fold, count(*) AS n, count_if(risk IS NULL) AS n_missing_risk, count_if(risk IS NOT NULL AND time < 0) AS n_negative, count_if(risk IS NOT NULL AND time >= 0) AS n_used FROM x_pred GROUP BY ALL
""")
def f14_metric_rows(c: Clinic):
    """missing risks leave, then negative times, which are counted per fold."""
    p = predictions(c)
    used, folds = survival.metric_rows(p, KEYS)
    n = p.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("risk").isNull()).alias("n_missing_risk"))
    u = used.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_used"))
    return n.join(folds, KEYS).join(u, KEYS)


@query("m1_concordance", "SELECT run_id, fold, CAST(comparable AS DOUBLE) AS comparable, CAST(concordant AS DOUBLE) AS concordant, CAST(tied AS DOUBLE) AS tied, round(c_index, 9) AS c_index FROM x_c")
def m1_concordance(c: Clinic):
    """M1 Harrell c over J16 comparable pairs, counted without producing pairs."""
    return survival.concordance(usable(c), KEYS, rows=bound(c)).withColumn("c_index", F.round("c_index", 9))


@query("j16_comparable_pairs", "SELECT run_id, fold, CAST(comparable AS DOUBLE) AS comparable, CAST(concordant AS DOUBLE) AS concordant, CAST(tied AS DOUBLE) AS tied FROM x_c")
def j16_comparable_pairs(c: Clinic):
    """The same counts through the cut path that serves groups of any size, with pieces of twenty rows."""
    return survival.concordance(usable(c), KEYS, rows=None, limit=40).drop("c_index")


@query("m2_ipcw_concordance", "SELECT run_id, fold, round(c_ipcw, 6) AS c_index FROM x_c")
def m2_ipcw_concordance(c: Clinic):
    u = usable(c)
    return survival.ipcw_concordance(u, u, KEYS, bound(c)).select(*KEYS, F.round("c_index", 6).alias("c_index"))


@query("m5_kaplan_meier", """
SELECT run_id, fold, time, CAST(at_risk AS BIGINT) AS at_risk, d, c, round(product(1 - d / at_risk) OVER (PARTITION BY run_id, fold ORDER BY time), 6) AS survival, round(g, 6) AS censoring FROM x_km JOIN x_g USING (run_id, fold, time)
""")
def m5_kaplan_meier(c: Clinic):
    u = usable(c)
    s = survival.kaplan_meier(u, KEYS, "event", bound(c))
    g = survival.kaplan_meier(u, KEYS, "censoring", bound(c)).select(*KEYS, "time", F.round("survival", 6).alias("censoring"))
    return s.withColumn("survival", F.round("survival", 6)).join(g, [*KEYS, "time"])


@query("m6_baseline_hazard", "SELECT run_id, fold, t, round(ht, 6) AS hazard, round(exp(-ht * 2), 6) AS survival FROM x_gridh")
def m6_baseline_hazard(c: Clinic):
    u = usable(c)
    asks = u.select(*KEYS).distinct().select(*KEYS, F.explode(F.array(*[F.lit(t) for t in GRID])).alias("time"))
    h = survival.hazard_at(survival.baseline_hazard(u, KEYS, bound(c)), asks, KEYS, bound(c))
    return h.select(*KEYS, F.col("time").alias("t"), F.round("value", 6).alias("hazard"), F.round(F.exp(-F.col("value") * 2), 6).alias("survival"))


@query("m7_discrete_survival", """
WITH s AS (SELECT c_custkey, 1 - 1 / (1 + exp(-(c_acctbal / 5000))) AS a, 1 - 1 / (1 + exp(-(c_custkey % 7 - 3))) AS b, 0.5::DOUBLE AS c FROM customer)
SELECT c_custkey, round(a, 9) AS s1, round(a * b, 9) AS s2, round(a * b * c, 9) AS s3, round(-(a + a * b + a * b * c), 9) AS risk FROM s
""")
def m7_discrete_survival(c: Clinic):
    logits = F.array(F.col("c_acctbal") / 5000, (F.col("c_custkey") % 7 - 3).cast("double"), F.lit(0.0))
    s = survival.survival_columns(logits)
    return c.tables.read("customer").select(
        "c_custkey", *[F.round(F.element_at(s, i), 9).alias(f"s{i}") for i in (1, 2, 3)], F.round(survival.risk_of(s), 9).alias("risk")
    )


@query("m8_interpolated_survival", """
SELECT c_custkey, CAST(c_custkey % 50 AS DOUBLE) AS t, round(CASE WHEN t <= 0 THEN 1 WHEN t <= 10 THEN 1 - 0.01 * t WHEN t <= 20 THEN 0.9 - 0.02 * (t - 10) WHEN t <= 30 THEN 0.7 - 0.02 * (t - 20) WHEN t <= 40 THEN 0.5 - 0.01 * (t - 30) ELSE 0 END::DOUBLE, 9) AS survival
FROM (SELECT c_custkey, (c_custkey % 50)::DOUBLE AS t FROM customer)
""")
def m8_interpolated_survival(c: Clinic):
    t = (F.col("c_custkey") % 50).cast("double")
    s = F.array(*[F.lit(x) for x in (0.9, 0.7, 0.5, 0.4)])
    return c.tables.read("customer").select(
        "c_custkey", t.alias("t"), F.round(survival.interpolated(s, [10.0, 20.0, 30.0, 40.0], t), 9).alias("survival")
    )


@query("m3_brier", "SELECT run_id, fold, t, round(brier, 6) AS brier FROM x_brier")
def m3_brier(c: Clinic):
    u = usable(c)
    return survival.brier(u, u, KEYS, GRID, bound(c)).select(*KEYS, "t", F.round("brier", 6).alias("brier"))


_IBS = """SELECT run_id, fold, CASE WHEN lo <= 1 AND hi >= 60 THEN area / 59.0 END AS ibs FROM (
 SELECT run_id, fold, sum((brier + b0) / 2) AS area FROM (SELECT *, lag(brier) OVER (PARTITION BY run_id, fold ORDER BY t) AS b0 FROM x_brier) GROUP BY ALL)
 JOIN (SELECT run_id, fold, min(time) AS lo, max(time) AS hi FROM x_use GROUP BY ALL) USING (run_id, fold)"""
_AUC = """SELECT k.run_id, k.fold, k.landmark, k.n_events, CASE WHEN lo <= landmark AND landmark <= hi AND n_events >= 5 THEN auc END AS auc FROM (
 SELECT run_id, fold, landmark, count_if(event AND time <= landmark) AS n_events, min(time) AS lo, max(time) AS hi FROM x_use, (SELECT unnest([24.0, 60.0]) AS landmark) GROUP BY ALL) k LEFT JOIN x_auc a USING (run_id, fold, landmark)"""


@query("m3_integrated_brier", f"SELECT run_id, fold, round(ibs, 6) AS ibs FROM ({_IBS})")
def m3_integrated_brier(c: Clinic):
    u = usable(c)
    b = survival.brier(u, u, KEYS, GRID, bound(c))
    return survival.integrated_brier(b, u, KEYS, GRID).withColumn("ibs", F.round("ibs", 6))


@query("m4_landmark_auc", f"SELECT run_id, fold, CAST(landmark AS DOUBLE) AS landmark, n_events, round(auc, 6) AS auc FROM ({_AUC})")
def m4_landmark_auc(c: Clinic):
    u = usable(c)
    return survival.landmark_auc(u, u, KEYS, LANDMARKS, bound(c)).withColumn("auc", F.round("auc", 6))


@query("m9_fold_metrics", f"""
SELECT run_id, fold, n, n_events, round(c_index, 6) AS c_index, round(c_ipcw, 6) AS c_index_ipcw, round(ibs, 6) AS ibs, round(mean_auc, 6) AS mean_auc, true AS check_ok
FROM (SELECT run_id, fold, count(*) AS n, count_if(event) AS n_events FROM x_use GROUP BY ALL) JOIN x_c USING (run_id, fold) JOIN ({_IBS}) USING (run_id, fold) JOIN (SELECT run_id, fold, avg(auc) AS mean_auc FROM ({_AUC}) GROUP BY ALL) USING (run_id, fold)
""")
def m9_fold_metrics(c: Clinic):
    # the labels are joined once, every metric reads them
    u = checkpointed(usable(c))
    # the recorded value of the mapping is the same statistic from the cut path
    recorded = survival.concordance(u, KEYS, rows=None, limit=100).select(*KEYS, F.col("c_index").alias("recorded"))
    m = survival.fold_metrics(u, u, KEYS, GRID, LANDMARKS, recorded, bound(c))
    return m.select(*KEYS, "n", "n_events", *[F.round(x, 6).alias(x) for x in ("c_index", "c_index_ipcw", "ibs", "mean_auc")], "check_ok")


@query("m15_reconstruction_pick", """
SELECT o_orderkey, CASE WHEN abs(a - t) > 0.1 AND abs(b - t) < abs(a - t) THEN b ELSE a END AS value, abs(a - t) > 0.1 AND abs(b - t) < abs(a - t) AS adopted
FROM (SELECT o_orderkey, (o_orderkey % 10) / 10.0::DOUBLE AS a, (o_orderkey % 7) / 10.0::DOUBLE AS b, (o_orderkey % 5) / 10.0::DOUBLE AS t FROM orders)
""")
def m15_reconstruction_pick(c: Clinic):
    k = F.col("o_orderkey")
    pick = survival.better_reconstruction(k % 10 / F.lit(10.0), k % 7 / F.lit(10.0), k % 5 / F.lit(10.0), 0.1)
    return c.tables.read("orders").select("o_orderkey", pick.alias("p")).select("o_orderkey", "p.value", "p.adopted")


# ---- paired tests -----------------------------------------------------------
ob.cte("x_delta", """
SELECT p_brand AS dataset, p_type AS field, CAST(p_partkey AS BIGINT) AS k, round(((p_partkey * 7919) % 1000) / 1000.0::DOUBLE - 0.45, 3) AS delta FROM part
""")


def deltas(c: Clinic):
    d = F.round((F.col("p_partkey") * 7919) % 1000 / F.lit(1000.0) - 0.45, 3)
    return c.tables.read("part").select(F.col("p_brand").alias("dataset"), F.col("p_type").alias("field"), F.col("p_partkey").alias("k"), d.alias("delta"))


ob.cte("x_folds", "SELECT dataset, field, k % 5 AS fold, round(avg(delta), 6) AS delta FROM x_delta GROUP BY ALL")


def folds(c: Clinic):
    """Paired differences of the five folds of every (dataset, field)."""
    d = deltas(c).groupBy("dataset", "field", (F.col("k") % 5).alias("fold"))
    return d.agg(F.round(F.avg("delta"), 6).alias("delta"))


@query("m10_signed_rank", """
WITH r AS (SELECT field, delta, rank() OVER (PARTITION BY field ORDER BY abs(delta)) + (count(*) OVER (PARTITION BY field, abs(delta)) - 1) / 2.0 AS r FROM x_delta WHERE delta <> 0),
a AS (SELECT field, count(*) AS n, sum(CASE WHEN delta > 0 THEN r ELSE 0 END) AS plus, sum(CASE WHEN delta < 0 THEN r ELSE 0 END) AS minus FROM r GROUP BY 1)
SELECT field, n AS n_nonzero, CAST(least(plus, minus) AS DOUBLE) AS statistic FROM a
""")
def m10_signed_rank(c: Clinic):
    """Rank sums over whole groups against SQL; approximate p values are pinned by the tests."""
    return inference.signed_rank(deltas(c), ["field"], "delta", c.tables.rows("part")).select("field", "n_nonzero", "statistic")


@query("m10_signed_rank_exact", """
WITH t AS (SELECT * FROM x_folds WHERE delta <> 0),
r AS (SELECT dataset, field, delta, CAST(rank() OVER (PARTITION BY dataset, field ORDER BY abs(delta)) * 2 + count(*) OVER (PARTITION BY dataset, field, abs(delta)) - 1 AS BIGINT) AS r2, row_number() OVER (PARTITION BY dataset, field ORDER BY fold) - 1 AS b FROM t),
n AS (SELECT dataset, field, count(*) AS n, sum(CASE WHEN delta > 0 THEN r2 ELSE 0 END) AS plus, greatest(sum(CASE WHEN delta > 0 THEN r2 ELSE 0 END), sum(CASE WHEN delta < 0 THEN r2 ELSE 0 END)) AS high FROM r GROUP BY ALL),
s AS (SELECT n.dataset, n.field, m, sum(CASE WHEN (m >> CAST(b AS INTEGER)) & 1 = 1 THEN r2 ELSE 0 END) AS w FROM n JOIN (SELECT unnest(range(32)) AS m) ON m < (1 << CAST(n AS INTEGER)) JOIN r ON r.field = n.field AND r.dataset = n.dataset GROUP BY ALL)
SELECT n.dataset, n.field, any_value(n) AS n_nonzero, round(count_if(w >= plus) / CAST(count(*) AS DOUBLE), 9) AS p_greater, round(least(1.0, 2.0 * count_if(w >= high) / CAST(count(*) AS DOUBLE)), 9) AS p_two_sided FROM n JOIN s ON n.field = s.field AND n.dataset = s.dataset GROUP BY n.dataset, n.field
""")
def m10_signed_rank_exact(c: Clinic):
    t = inference.signed_rank(folds(c), ["dataset", "field"], "delta", c.tables.rows("part"))
    return t.select("dataset", "field", "n_nonzero", F.round("p_greater", 9).alias("p_greater"), F.round("p_two_sided", 9).alias("p_two_sided"))


@query("m11_paired_interval", """
SELECT dataset, field, n, round(m, 9) AS delta, round(m - q * s / sqrt(n), 9) AS ci_lo, round(m + q * s / sqrt(n), 9) AS ci_hi FROM (
 SELECT dataset, field, count(*) AS n, avg(delta) AS m, stddev_samp(delta) AS s, ([12.706204736, 4.302652730, 3.182446305, 2.776445105]::DOUBLE[])[count(*) - 1] AS q FROM x_folds GROUP BY ALL)
""")
def m11_paired_interval(c: Clinic):
    t = inference.paired_interval(folds(c), ["dataset", "field"], "delta")
    return t.select("dataset", "field", "n", *[F.round(x, 9).alias(x) for x in ("delta", "ci_lo", "ci_hi")])


@query("m12_bootstrap_interval", """
WITH v AS (SELECT field, dataset, avg(delta) AS v FROM x_delta GROUP BY ALL),
r AS (SELECT field, v, row_number() OVER (PARTITION BY field ORDER BY dataset) AS i, count(*) OVER (PARTITION BY field) AS n FROM v),
d AS (SELECT field, n, rep, ('0x' || substr(md5(concat_ws('|', '0', field, rep, i)), 1, 12))::BIGINT % n + 1 AS pick FROM r, (SELECT unnest(range(1, 2001)) AS rep)),
m AS (SELECT d.field, d.n, rep, sum(r.v) / d.n AS m FROM d JOIN r ON r.field = d.field AND r.i = d.pick GROUP BY d.field, d.n, rep)
SELECT field, n, round(quantile_cont(m, 0.025), 9) AS ci_lo, round(quantile_cont(m, 0.975), 9) AS ci_hi FROM m GROUP BY field, n
""")
def m12_bootstrap_interval(c: Clinic):
    """Resampled means over datasets; both engines draw by md5."""
    d = deltas(c).groupBy("field", "dataset").agg(F.avg("delta").alias("delta"))
    out = inference.bootstrap_mean(d, ["field"], "delta", ["dataset"], 2000, 0, c.tables.rows("part"))
    return out.select("field", "n", F.round("ci_lo", 9).alias("ci_lo"), F.round("ci_hi", 9).alias("ci_hi"))


@query("m13_spearman", """
WITH r AS (SELECT field, rank() OVER (PARTITION BY field ORDER BY a) + (count(*) OVER (PARTITION BY field, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY field ORDER BY b) + (count(*) OVER (PARTITION BY field, b) - 1) / 2.0 AS rb
 FROM (SELECT p_type AS field, p_size AS a, p_retailprice AS b FROM part)) SELECT field, count(*) AS n, round(corr(ra, rb), 6) AS rho FROM r GROUP BY 1
""")
def m13_spearman(c: Clinic):
    p = c.tables.read("part").select(F.col("p_type").alias("field"), F.col("p_size").alias("a"), F.col("p_retailprice").alias("b"))
    return inference.spearman(p, ["field"], "a", "b", c.tables.rows("part")).withColumn("rho", F.round("rho", 6))


@query("m16_ks_distance", """
WITH a AS (SELECT field, delta, k % 2 = 0 AS g FROM x_delta), n AS (SELECT field, count_if(g) AS na, count_if(NOT g) AS nb FROM a GROUP BY 1)
SELECT n.field, any_value(na) AS n_true, any_value(nb) AS n_false, round(max(abs(ca / nullif(na, 0) - cb / nullif(nb, 0))), 9) AS distance FROM n JOIN (SELECT field, delta, sum(count_if(g)) OVER w AS ca, sum(count_if(NOT g)) OVER w AS cb FROM a GROUP BY field, delta WINDOW w AS (PARTITION BY field ORDER BY delta)) s USING (field) GROUP BY n.field
""")
def m16_ks_distance(c: Clinic):
    d = deltas(c).withColumn("g", F.col("k") % 2 == 0)
    return inference.ks_distance(d, ["field"], "delta", "g", c.tables.rows("part")).withColumn("distance", F.round("distance", 9))


@query("w5_average_rank", """
SELECT p_type AS field, p_size AS value, count(*) AS n, rank_at + (count(*) - 1) / 2.0 AS avg_rank FROM (SELECT p_type, p_size, rank() OVER (PARTITION BY p_type ORDER BY p_size) AS rank_at FROM part) GROUP BY p_type, p_size, rank_at
""")
def w5_average_rank(c: Clinic):
    from ..scale import value_ranks

    p = c.tables.read("part").select(F.col("p_type").alias("field"), F.col("p_size").alias("value"))
    return value_ranks(p, ["field"], "value", c.tables.rows("part")).drop("upto")
