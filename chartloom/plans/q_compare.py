"""Queries on score tables: profiles, overlaps, arms, tiers and grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import compare
from . import oracle_base as ob
from .clinical import Clinic
from .q_timing import ends, labels
from .registry import query

ob.cte("x_fs", """
SELECT p_brand AS dataset, lower(p_type) || '.f' || (p_size % 8) AS field, round(avg(p_retailprice - 900) / 301.7, 9) AS c, round(avg(CASE WHEN p_size % 2 = 0 THEN p_retailprice - 900 ELSE 1.0217::DOUBLE * (p_retailprice - 900) END) / 301.7, 9) AS c2,
 count(*) AS n, min(p_partkey) AS k FROM part GROUP BY ALL
""")
ob.cte("x_arms", """
SELECT dataset, field, k AS field_idx, pending, CASE WHEN pending = '' THEN c END AS c_t0, CASE WHEN pending = '' THEN c2 END AS c_off, CASE WHEN pending = '' THEN c2 - c END AS delta_c, leak_rate,
 CASE WHEN k % 9 = 0 THEN 'pending' WHEN leak_rate IS NULL THEN 'undefined' ELSE 'ok' END AS leak_rate_status, k % 3 = 0 AS mask_affected, CASE WHEN k % 4 = 0 THEN 'excluded' ELSE 'kept' END AS t0_filter_status
FROM (SELECT *, CASE WHEN k % 23 = 0 THEN 't0_not_ok' WHEN k % 19 = 0 THEN 'off_missing_field' WHEN k % 17 = 0 THEN 'off_status=error' ELSE '' END AS pending, CASE WHEN k % 9 = 0 OR k % 7 = 0 THEN NULL ELSE (k % 10) / 10.0::DOUBLE END AS leak_rate FROM x_fs)
""")


def scores(c: Clinic):
    p = F.col("p_retailprice") - 900
    return c.tables.read("part").groupBy(
        F.col("p_brand").alias("dataset"), F.concat(F.lower("p_type"), F.lit(".f"), (F.col("p_size") % 8).cast("string")).alias("field")
    ).agg(
        F.round(F.avg(p) / 301.7, 9).alias("c"),
        F.round(F.avg(F.when(F.col("p_size") % 2 == 0, p).otherwise(1.0217 * p)) / 301.7, 9).alias("c2"),
        F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("k"),
    )


def arms(c: Clinic):
    s, k = scores(c), F.col("k")
    t0 = s.select("dataset", "field", k.alias("field_idx"), "c", F.when(k % 23 == 0, "error").otherwise("ok").alias("status"))
    off = s.where(k % 19 != 0).select("dataset", "field", F.col("c2").alias("c"), F.when(k % 17 == 0, "error").otherwise("ok").alias("status"))
    leak = s.where(k % 9 != 0).select("dataset", "field", F.when(k % 7 == 0, None).otherwise(k % 10 / F.lit(10.0)).alias("leak_rate"))
    changes = s.select("dataset", "field", F.when(k % 3 == 0, 4).otherwise(0).alias("changed_cells"))
    excluded = s.where(k % 4 == 0).select("dataset", "field", F.lit("R3_coverage").alias("rule"))
    return compare.field_arms(t0, off, leak, changes, excluded)


def rounded(df, digits=6, skip=()):
    cells = [F.round(F.col(f"`{n}`"), digits).alias(n) if t == "double" and n not in skip else F.col(f"`{n}`") for n, t in df.dtypes]
    return df.select(*cells)


@query("a34_dataset_profile", """
SELECT dataset, count(*) AS n_fields, round(min(c), 6) AS c_min, round(max(c), 6) AS c_max, round(quantile_cont(c, 0.5), 6) AS c_median, round(quantile_cont(c, 0.25), 6) AS c_q1, round(quantile_cont(c, 0.75), 6) AS c_q3, round(avg(c), 6) AS c_mean,
 round(coalesce(stddev_samp(c), 0), 6) AS c_std, round(max(c) - min(c), 6) AS field_spread, count_if(c >= 0.5) AS n_ge_chance, round(count_if(c >= 0.5) / CAST(count(*) AS DOUBLE), 6) AS frac_ge_chance, arg_max(field, (c, field)) AS top1_field FROM x_fs GROUP BY 1
""")
def a34_dataset_profile(c: Clinic):
    return rounded(compare.dataset_profile(scores(c)))


@query("a35_field_profile", """
SELECT field, count(*) AS n_datasets, round(quantile_cont(c, 0.5), 6) AS c_median, round(avg(c), 6) AS c_mean, round(min(c), 6) AS c_min, round(max(c), 6) AS c_max, round(max(c) - min(c), 6) AS c_range, round(coalesce(stddev_samp(c), 0), 6) AS c_std, string_agg(dataset, ',' ORDER BY dataset) AS datasets FROM x_fs GROUP BY 1
""")
def a35_field_profile(c: Clinic):
    return rounded(compare.field_profile(scores(c)))


@query("p28_short_labels", """
WITH f AS (SELECT DISTINCT field, string_split(field, '.')[2] AS leaf FROM x_fs) SELECT field, CASE WHEN count(*) OVER (PARTITION BY leaf) > 1 THEN field ELSE leaf END AS label FROM f
""")
def p28_short_labels(c: Clinic):
    return compare.short_labels(scores(c))


@query("w13_top_fields", "SELECT dataset, rank, field, c FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY c DESC, field) AS rank FROM x_fs) WHERE rank <= 5")
def w13_top_fields(c: Clinic):
    """W13 top-k per dataset and T6 restricted field space."""
    return compare.top_k(scores(c), 5).select("dataset", "rank", "field", "c")


_TOP = "SELECT dataset, field, k FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY c DESC, field) AS r FROM x_fs) s, (SELECT unnest([3, 5, 10]) AS k) g WHERE r <= g.k"
ob.cte("x_top", "SELECT s.dataset, s.field, g.kk AS k FROM (SELECT dataset, field, row_number() OVER (PARTITION BY dataset ORDER BY c DESC, field) AS r FROM x_fs) s, (SELECT unnest([3, 5, 10]) AS kk) g WHERE r <= g.kk")
ob.cte("x_pairs", """
SELECT d.k, d.a, d.b, (SELECT count(*) FROM x_top x JOIN x_top y ON x.field = y.field AND x.k = y.k WHERE x.k = d.k AND x.dataset = d.a AND y.dataset = d.b) AS shared, d.ma, d.mb
FROM (SELECT x.k, x.dataset AS a, y.dataset AS b, x.m AS ma, y.m AS mb FROM (SELECT k, dataset, count(*) AS m FROM x_top GROUP BY ALL) x JOIN (SELECT k, dataset, count(*) AS m FROM x_top GROUP BY ALL) y ON x.k = y.k AND x.dataset < y.dataset) d
""")


@query("j15_pair_overlap", "SELECT k, a, b, shared, round(shared / CAST(k AS DOUBLE), 6) AS overlap, round(shared / CAST(ma + mb - shared AS DOUBLE), 6) AS jaccard FROM x_pairs WHERE shared > 0")
def j15_pair_overlap(c: Clinic):
    return rounded(compare.pair_overlap(scores(c), [3, 5, 10]))


@query("a36_overlap_summary", """
WITH h AS (SELECT k, field, count(*) AS h FROM x_top GROUP BY ALL), n AS (SELECT k, count(DISTINCT dataset) AS nd FROM x_top GROUP BY 1),
u AS (SELECT h.k, count(*) AS n_union_fields, count_if(h = nd) AS n_in_all, count_if(h >= nd / 2.0) AS n_in_half, count_if(h = 1) AS n_unique FROM h JOIN n ON h.k = n.k GROUP BY 1)
SELECT p.k, count(*) AS n_pairs, round(avg(shared / CAST(p.k AS DOUBLE)), 6) AS mean_overlap, round(quantile_cont(shared / CAST(p.k AS DOUBLE), 0.5), 6) AS median_overlap, round(min(shared / CAST(p.k AS DOUBLE)), 6) AS min_overlap,
 round(max(shared / CAST(p.k AS DOUBLE)), 6) AS max_overlap, round(avg(shared / CAST(ma + mb - shared AS DOUBLE)), 6) AS mean_jaccard, count_if(shared = 0) AS n_empty_pairs, round(count_if(shared = 0) / CAST(count(*) AS DOUBLE), 6) AS fraction_empty_pairs,
 any_value(n_union_fields) AS n_union_fields, any_value(n_in_all) AS n_in_all, any_value(n_in_half) AS n_in_half, any_value(n_unique) AS n_unique FROM x_pairs p JOIN u ON p.k = u.k GROUP BY p.k
""")
def a36_overlap_summary(c: Clinic):
    return rounded(compare.overlap_summary(scores(c), [3, 5, 10]))


_FOLDS = """SELECT p_brand AS dataset, p_type AS scheme, p_partkey % 5 AS fold, round(avg(CASE WHEN p_type <> 'PROMO' THEN p_retailprice / 2000 END), 6) AS val, round(avg(p_retailprice / 2100), 6) AS test FROM part GROUP BY ALL"""
ob.cte("x_fold", _FOLDS)


def fold_table(c: Clinic):
    return c.tables.read("part").groupBy(F.col("p_brand").alias("dataset"), F.col("p_type").alias("scheme"), (F.col("p_partkey") % 5).alias("fold")).agg(
        F.round(F.avg(F.when(F.col("p_type") != "PROMO", F.col("p_retailprice") / 2000)), 6).alias("val"), F.round(F.avg(F.col("p_retailprice") / 2100), 6).alias("test")
    )


@query("a31_fold_scores", """
SELECT dataset, scheme, round(coalesce(avg(val), avg(test)), 9) AS c_mean, round(coalesce(CASE WHEN count(val) > 0 THEN stddev_samp(val) ELSE stddev_samp(test) END, 0), 9) AS c_std, CASE WHEN count(val) > 0 THEN 'val' ELSE 'test' END AS source FROM x_fold GROUP BY ALL
""")
def a31_fold_scores(c: Clinic):
    return rounded(compare.fold_scores(fold_table(c), ["dataset", "scheme"]), 9)


@query("a53_recompute_audit", """
SELECT dataset, scheme, abs(round(avg(val), 3) - avg(val)) > 1e-4 AS stale FROM x_fold WHERE val IS NOT NULL GROUP BY ALL
""")
def a53_recompute_audit(c: Clinic):
    f = fold_table(c).where("val is not null")
    table = f.groupBy("dataset", "scheme").agg(F.round(F.avg("val"), 3).alias("stored"))
    return compare.recompute_audit(f, table, ["dataset", "scheme"], 1e-4).select("dataset", "scheme", "stale")


@query("a50_run_summary", """
SELECT dataset, count(*) AS n_fields, count_if(k % 6 <> 0) AS n_ok, count_if(k % 6 = 0) AS n_error, coalesce(string_agg(CASE WHEN k % 6 = 0 THEN field END, ',' ORDER BY field), '') AS errors FROM x_fs GROUP BY 1
""")
def a50_run_summary(c: Clinic):
    s = scores(c).withColumn("status", F.when(F.col("k") % 6 == 0, "error").otherwise("ok"))
    return compare.run_summary(s, ["dataset"])


@query("t1_field_order", """
SELECT dataset, field, row_number() OVER (PARTITION BY dataset ORDER BY k % 6 = 0, CASE WHEN k % 6 <> 0 THEN -c END, k) AS place FROM x_fs
""")
def t1_field_order(c: Clinic):
    from pyspark.sql import Window

    s = scores(c).select("dataset", "field", "c", F.col("k").alias("field_idx"), F.when(F.col("k") % 6 == 0, "error").otherwise("ok").alias("status"))
    w = Window.partitionBy("dataset").orderBy(*compare.field_order(s))
    return s.select("dataset", "field", F.row_number().over(w).cast("long").alias("place"))


@query("j8_field_arms", "SELECT dataset, field, field_idx, pending, c_t0, c_off, round(delta_c, 6) AS delta_c, leak_rate, leak_rate_status, mask_affected, t0_filter_status FROM x_arms")
def j8_field_arms(c: Clinic):
    return arms(c).withColumn("delta_c", F.round("delta_c", 6))


@query("a37_noise_floor", """
SELECT CASE WHEN mask_affected THEN 'mask_affected' ELSE 'mask_unaffected' END AS label, count(*) AS n_fields, round(avg(delta_c), 6) AS delta_mean, round(quantile_cont(delta_c, 0.5), 6) AS delta_median, round(coalesce(stddev_samp(delta_c), 0), 6) AS delta_std,
 round(min(delta_c), 6) AS delta_min, round(max(delta_c), 6) AS delta_max, round(quantile_cont(abs(delta_c), 0.9), 6) AS abs_delta_p90, round(max(abs(delta_c)), 6) AS abs_delta_max, round(avg(CASE WHEN abs(delta_c) >= 0.01 THEN 1.0::DOUBLE ELSE 0 END), 6) AS share_ge FROM x_arms WHERE delta_c IS NOT NULL GROUP BY 1
""")
def a37_noise_floor(c: Clinic):
    return rounded(compare.noise_floor(arms(c), 0.01))


@query("f17_floor_violations", "SELECT dataset, field FROM x_arms WHERE NOT mask_affected AND abs(delta_c) > 0.01")
def f17_floor_violations(c: Clinic):
    return compare.floor_violations(arms(c), 0.01).select("dataset", "field")


@query("a38_dataset_deltas", """
SELECT dataset, count(*) AS n_fields, round(avg(delta_c), 6) AS delta_mean, round(quantile_cont(delta_c, 0.5), 6) AS delta_median, round(min(delta_c), 6) AS delta_min, round(max(delta_c), 6) AS delta_max, count_if(abs(delta_c) >= 0.0101) AS n_ge, count_if(delta_c > 0) AS n_positive,
 arg_max(field, (delta_c, field)) AS top_positive_field, arg_min(field, (delta_c, field)) AS top_negative_field FROM x_arms WHERE delta_c IS NOT NULL GROUP BY 1
""")
def a38_dataset_deltas(c: Clinic):
    return rounded(compare.dataset_deltas(arms(c), 0.0101))


@query("a39_field_impact", """
WITH a AS (SELECT field, count(*) AS n_datasets_total, count_if(mask_affected) AS n_datasets_affected, quantile_cont(CASE WHEN mask_affected THEN delta_c END, 0.5) AS med, avg(CASE WHEN mask_affected THEN CASE WHEN abs(delta_c) >= 0.0101 THEN 1.0::DOUBLE ELSE 0 END END) AS frac,
 max(abs(delta_c)) AS mx, avg(delta_c) AS m, count_if(delta_c > 0) AS n_positive, count_if(delta_c < 0) AS n_negative FROM x_arms WHERE delta_c IS NOT NULL GROUP BY 1)
SELECT field, n_datasets_total, n_datasets_affected, round(med, 6) AS median_affected, round(frac, 6) AS frac_affected, round(mx, 6) AS max_abs_delta, round(m, 6) AS delta_mean, n_positive, n_negative FROM a
""")
def a39_field_impact(c: Clinic):
    return rounded(compare.field_impact(arms(c), 0.0101)).drop("place")


@query("a51_admitted_summary", """
SELECT dataset, count_if(t0_filter_status='kept') AS n_admitted, count_if(t0_filter_status<>'kept') AS n_excluded, count_if(coalesce(t0_filter_status='kept' AND leak_rate > 0.45 AND abs(delta_c) >= 0.0101, false)) AS n_influential,
 count_if(t0_filter_status='kept' AND delta_c > 0) AS n_positive, count_if(t0_filter_status='kept' AND delta_c < 0) AS n_negative FROM x_arms WHERE delta_c IS NOT NULL GROUP BY 1
""")
def a51_admitted_summary(c: Clinic):
    return compare.admitted_summary(arms(c), 0.45, 0.0101)


@query("a51_delta_matrix", "SELECT dataset, field, k AS \"column\", round(delta_c, 6) AS delta_c FROM x_arms JOIN (SELECT field, row_number() OVER (ORDER BY round(abs(avg(delta_c)), 9) DESC, field) AS k FROM x_arms WHERE delta_c IS NOT NULL GROUP BY field) USING (field) WHERE delta_c IS NOT NULL")
def a51_delta_matrix(c: Clinic):
    return rounded(compare.delta_matrix(arms(c).where("delta_c is not null")))


@query("j9_paired_arms", "SELECT dataset, field AS work, 'mlp' AS analyzer, round(c2, 6) AS c_report, round(c, 6) AS c_deleaked, round(c2 - c, 6) AS delta FROM x_fs")
def j9_paired_arms(c: Clinic):
    s = scores(c).select("dataset", F.col("field").alias("work"), F.lit("mlp").alias("analyzer"), F.explode(F.array(
        F.struct(F.lit("raw").alias("t"), F.col("c2").alias("c")), F.struct(F.lit("lm0").alias("t"), F.col("c").alias("c")))).alias("a"))
    return rounded(compare.paired_arms(s.select("dataset", "work", "analyzer", "a.*")))


@query("a40_scheme_deltas", """
SELECT field AS work, 'mlp' AS analyzer, count(*) AS n_datasets, round(avg(c2 - c), 6) AS mean_delta, round(quantile_cont(c2 - c, 0.5), 6) AS median_delta, round(stddev_samp(c2 - c), 6) AS sd_delta, round(avg(CASE WHEN c2 - c > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS direction_consistency FROM x_fs GROUP BY 1
""")
def a40_scheme_deltas(c: Clinic):
    s = scores(c).select(F.col("field").alias("work"), F.lit("mlp").alias("analyzer"), (F.col("c2") - F.col("c")).alias("delta"))
    return rounded(compare.scheme_deltas(s))


ob.cte("x_work", "SELECT dataset, 'W' || (k % 2) AS work, field FROM x_fs")
ob.cte("x_greedy", "SELECT dataset, field FROM x_fs WHERE k % 3 <> 1")


@query("j10_two_arms", """
WITH w AS (SELECT dataset, work, count(*) AS n FROM x_work GROUP BY ALL), g AS (SELECT dataset, count(*) AS n FROM x_greedy GROUP BY 1), m AS (SELECT w.dataset, w.work, count(*) AS n FROM w JOIN x_greedy g ON g.dataset = w.dataset WHERE NOT EXISTS (SELECT 1 FROM x_work x WHERE x.dataset = w.dataset AND x.work = w.work AND x.field = g.field) GROUP BY ALL),
s AS (SELECT dataset, max(c) AS b, CASE WHEN count(*) % 2 = 0 THEN max(c2) END AS c, max(c2) + 0.01 AS best FROM x_fs GROUP BY 1)
SELECT w.dataset, w.work, 'mlp' AS modality, w.n AS n_fields_work, g.n AS n_fields_greedy, round(b, 6) AS b_c, round(coalesce(c, best), 6) AS c_c, round(coalesce(c, best) - b, 6) AS delta_c_minus_b, coalesce(m.n, 0) AS n_missed FROM w JOIN g ON g.dataset = w.dataset JOIN s ON s.dataset = w.dataset LEFT JOIN m ON m.dataset = w.dataset AND m.work = w.work
""")
def j10_two_arms(c: Clinic):
    table, _ = _two_arms(c)
    return rounded(table)


def _two_arms(c: Clinic):
    s = scores(c)
    work = s.select("dataset", F.concat(F.lit("W"), (F.col("k") % 2).cast("string")).alias("work"), "field")
    greedy = s.where(F.col("k") % 3 != 1).select("dataset", "field")
    per = s.groupBy("dataset").agg(F.max("c").alias("b_c"), F.when(F.count(F.lit(1)) % 2 == 0, F.max("c2")).alias("c_c"), (F.max("c2") + 0.01).alias("best_c"))
    pairs = work.select("dataset", "work").distinct().join(per, "dataset").withColumn("modality", F.lit("mlp"))
    sentences = s.where(F.col("k") % 5 != 0).select("dataset", "field", F.concat(F.col("field"), F.lit(" is {}.")).alias("sentence"))
    return compare.two_arms(work, greedy, pairs.select("dataset", "work", "modality", "b_c", "c_c"), per.select("dataset", F.lit("mlp").alias("modality"), "best_c"), sentences)


@query("j10_missed_fields", """
SELECT w.dataset, w.work, g.field, CASE WHEN f.k % 5 = 0 THEN '' ELSE g.field || ' is {}.' END AS bank_sentence FROM (SELECT DISTINCT dataset, work FROM x_work) w JOIN x_greedy g ON g.dataset = w.dataset JOIN x_fs f ON f.dataset = g.dataset AND f.field = g.field
WHERE NOT EXISTS (SELECT 1 FROM x_work x WHERE x.dataset = w.dataset AND x.work = w.work AND x.field = g.field)
""")
def j10_missed_fields(c: Clinic):
    """J10 missed fields and X3 set difference."""
    return _two_arms(c)[1]


ob.cte("x_tiers", """
SELECT dataset, field AS work, CASE WHEN k % 5 <> 0 THEN c END AS report_c, CASE WHEN k % 7 <> 0 THEN c2 END AS deleak_c, coalesce(CASE WHEN k % 2 = 0 THEN c + 0.1 END, s) AS reach_c, rr AS reach_raw_c
FROM x_fs LEFT JOIN (SELECT dataset, CASE WHEN min(k) % 3 <> 0 THEN max(c) END AS s, CASE WHEN min(k) % 4 <> 0 THEN max(c2) END AS rr FROM x_fs GROUP BY 1) USING (dataset)
""")


def tiers(c: Clinic):
    s, k = scores(c).withColumn("work", F.col("field")), F.col("k")
    on = ["dataset", "work"]
    best = s.groupBy("dataset").agg(F.min("k").alias("m"), F.max("c").alias("best_c"), F.max("c2").alias("c"))
    return compare.four_tiers(
        s.select(*on), s.where(k % 5 != 0).select(*on, "c"), s.where(k % 7 != 0).select(*on, F.col("c2").alias("c")),
        s.where(k % 2 == 0).select(*on, (F.col("c") + 0.1).alias("c")), best.where("m % 3 <> 0").select("dataset", "best_c"),
        best.where("m % 4 <> 0").select("dataset", "c"),
    )


@query("j11_four_tiers", """
SELECT dataset, work, round(report_c, 6) AS report_c, round(deleak_c, 6) AS deleak_c, round(reach_c, 6) AS reach_c, round(reach_raw_c, 6) AS reach_raw_c, round(report_c - deleak_c, 6) AS report_minus_deleak, round(deleak_c - reach_c, 6) AS deleak_minus_reach, round(report_c - reach_raw_c, 6) AS report_minus_reach_raw, round(reach_raw_c - reach_c, 6) AS reach_raw_minus_reach,
 CASE WHEN reach_c IS NULL THEN 'pending_C' ELSE 'ok' END AS status FROM x_tiers
""")
def j11_four_tiers(c: Clinic):
    return rounded(tiers(c))


@query("a41_tier_means", """
SELECT work, count(*) AS n, round(avg(report_c), 6) AS report_c, round(avg(deleak_c), 6) AS deleak_c, round(avg(reach_c), 6) AS reach_c, round(avg(reach_raw_c), 6) AS reach_raw_c FROM x_tiers WHERE report_c IS NOT NULL AND deleak_c IS NOT NULL AND reach_c IS NOT NULL AND reach_raw_c IS NOT NULL GROUP BY 1
""")
def a41_tier_means(c: Clinic):
    return rounded(compare.tier_means(tiers(c), "work"))


@query("j12_bindings", "SELECT unnest(['PAN1', 'PAN2']) AS scheme, dataset FROM (SELECT DISTINCT dataset FROM x_fs) UNION ALL SELECT 'HG_' || dataset, dataset FROM x_fs WHERE k % 10 = 3 GROUP BY dataset")
def j12_bindings(c: Clinic):
    s = scores(c)
    bound = s.where(F.col("k") % 10 == 3).select(F.concat(F.lit("HG_"), F.col("dataset")).alias("scheme"), "dataset").distinct()
    return compare.bindings(s.select("dataset").distinct(), ["PAN1", "PAN2"], bound)


@query("j13_bank_positions", "SELECT dataset, 'S' AS scheme, n AS ord, field, k AS field_idx FROM x_fs WHERE k % 4 <> 0")
def j13_bank_positions(c: Clinic):
    s = scores(c)
    wanted = s.select("dataset", F.lit("S").alias("scheme"), F.col("n").alias("ord"), "field")
    return compare.bank_positions(wanted, s.where(F.col("k") % 4 != 0).select("dataset", "field", F.col("k").alias("field_idx")))[0]


@query("e13_registered_schemes", """
SELECT dataset, 'S' AS scheme, coalesce(string_agg(CASE WHEN k % 4 <> 0 THEN field END, ',' ORDER BY field), '') AS fields, coalesce(string_agg(CASE WHEN k % 4 = 0 THEN field END, ',' ORDER BY field), '') AS missing, count_if(k % 4 <> 0) > 0 AS usable FROM x_fs GROUP BY 1
""")
def e13_registered_schemes(c: Clinic):
    s = scores(c)
    return compare.registered_schemes(s.select("dataset", F.lit("S").alias("scheme"), "field"), s.where(F.col("k") % 4 != 0).select("dataset", "field"))


@query("x2_ordered_distinct", "SELECT o_orderpriority, o_orderstatus, min(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL")
def x2_ordered_distinct(c: Clinic):
    return compare.ordered_distinct(c.tables.read("orders"), ["o_orderpriority", "o_orderstatus"], "o_orderkey")


@query("j18_split_differences", """
WITH l AS (SELECT DISTINCT o_orderkey % 5 AS fold, o_custkey AS m FROM orders), r AS (SELECT DISTINCT (o_orderkey + 1) % 5 AS fold, o_custkey AS m FROM orders),
d AS (SELECT fold, 'left_only' AS side, m FROM (SELECT * FROM l EXCEPT SELECT * FROM r) UNION ALL SELECT fold, 'right_only', m FROM (SELECT * FROM r EXCEPT SELECT * FROM l)), n AS (SELECT *, row_number() OVER (PARTITION BY fold, side ORDER BY m) AS i FROM d)
SELECT fold, side, count(*) AS n, string_agg(CASE WHEN i <= 5 THEN CAST(m AS VARCHAR) END, ',' ORDER BY CAST(m AS VARCHAR)) AS sample FROM n GROUP BY ALL
""")
def j18_split_differences(c: Clinic):
    """J18 and J21 split audits, X4 symmetric difference."""
    o = c.tables.read("orders")
    left = o.select((F.col("o_orderkey") % 5).alias("fold"), F.col("o_custkey").alias("m"))
    right = o.select(((F.col("o_orderkey") + 1) % 5).alias("fold"), F.col("o_custkey").alias("m"))
    return compare.set_differences(left, right, ["fold"], "m")


@query("j1_patient_intersection", "SELECT p.dataset, count(*) AS n, CAST(sum(l.censorship = 0) AS BIGINT) AS events FROM x_pat p JOIN x_labels l ON p.patient_id = l.patient_id WHERE p.patient_id IN (SELECT user_id FROM events) GROUP BY 1")
def j1_patient_intersection(c: Clinic):
    bank = c.tables.read("events").select(F.col("user_id").alias("patient_id")).distinct()
    kept = labels(c).join(bank, "patient_id", "left_semi")
    return kept.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("censorship") == 0).alias("events"))


@query("j14_slide_cases", """
SELECT 'TCGA-' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS case_id, 'TCGA-' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') || '-01Z.' || o_orderkey || '.svs' AS slide_id, survival_months, censorship
FROM orders JOIN customer ON o_custkey = c_custkey JOIN x_labels l ON l.patient_id = c_custkey
""")
def j14_slide_cases(c: Clinic):
    name = lambda k: F.concat(F.lit("TCGA-"), F.lpad(F.col(k).cast("string"), 7, "0"))
    slides = c.tables.read("orders").select(F.concat(name("o_custkey"), F.lit("-01Z."), F.col("o_orderkey").cast("string")).alias("slide"))
    cases = labels(c).select(F.lower(name("patient_id")).alias("case_id"), "survival_months", "censorship", F.col("patient_id").alias("ord"))
    return compare.slide_cases(slides, cases)


@query("j17_fold_events", "SELECT dataset, o_orderkey % 5 AS fold, CAST(sum(event) AS BIGINT) AS n_event FROM (SELECT DISTINCT e.dataset, o_orderkey % 5 AS o_orderkey, patient_id, event FROM orders JOIN x_ends e ON o_custkey = patient_id) GROUP BY ALL")
def j17_fold_events(c: Clinic):
    case = F.concat(F.lit("C-"), F.col("o_custkey").cast("string"))
    e = ends(c).select("dataset", F.concat(F.lit("C-"), F.col("patient_id").cast("string")).alias("case_id"), "event")
    home = c.patients.select("dataset", F.col("patient_id").alias("o_custkey"))
    o = c.tables.read("orders").join(home, "o_custkey").select(
        "dataset", (F.col("o_orderkey") % 5).alias("fold"), F.concat(case, F.lit("-01Z;"), case, F.lit("-02A")).alias("slides"))
    return compare.fold_events(o, e, r"^(C-\d+)-")


@query("j19_count_mismatches", """
SELECT a.dataset, a.n AS "left", b.n AS "right" FROM (SELECT dataset, count_if(event = 1) AS n FROM x_ends GROUP BY 1) a JOIN (SELECT dataset, count_if(censorship = 0) AS n FROM x_labels GROUP BY 1) b ON a.dataset = b.dataset WHERE a.n <> b.n
""")
def j19_count_mismatches(c: Clinic):
    a = ends(c).groupBy("dataset").agg(F.count_if(F.col("event") == 1).alias("n"))
    b = labels(c).groupBy("dataset").agg(F.count_if(F.col("censorship") == 0).alias("n"))
    return compare.count_mismatches(a, b, "dataset", "n")


ob.cte("x_grid20", """
SELECT g.dataset, combo, kind, model, coalesce(val, test) AS c, CASE WHEN val IS NOT NULL THEN 'val' WHEN test IS NOT NULL THEN 'test' ELSE 'missing' END AS status
FROM (SELECT dataset, combo, kind, unnest(['cox', 'mlp', 'flat']) AS model FROM (SELECT dataset, field AS combo, CASE WHEN k % 2 = 0 THEN 'greedy' ELSE 'scheme' END AS kind FROM x_fs)) g
LEFT JOIN (SELECT dataset, field, m, CASE WHEN (k + i) % 4 <> 0 THEN round(c + i * ((k * 7) % 13 - 6) / 100.0, 4) END AS val, CASE WHEN (k + i) % 3 <> 0 THEN c END AS test FROM x_fs, (SELECT unnest(['cox', 'mlp', 'flat']) AS m, unnest([0, 1, 2]) AS i) WHERE (k + i) % 11 <> 0) s ON s.dataset = g.dataset AND s.field = g.combo AND s.m = g.model
""")


def grid(c: Clinic):
    s, k = scores(c), F.col("k")
    i = F.col("i")
    each = s.select("dataset", F.col("field").alias("combo"), "c", "k", F.posexplode(F.array(F.lit("cox"), F.lit("mlp"), F.lit("flat"))).alias("i", "model")).where((k + i) % 11 != 0)
    table = each.select(
        "dataset", "combo", "model", F.when((k + i) % 4 != 0, F.round(F.col("c") + i * ((k * 7) % 13 - 6) / 100.0, 4)).alias("val"), F.when((k + i) % 3 != 0, F.col("c")).alias("test"))
    combos = s.select("dataset", F.col("field").alias("combo"), "k")
    return compare.combination_grid(combos.where(k % 2 == 0), combos.where(k % 2 != 0), ["cox", "mlp", "flat"], table)


@query("j20_combination_grid", "SELECT dataset, combo, kind, model, CAST(c AS DOUBLE) AS c, status FROM x_grid20")
def j20_combination_grid(c: Clinic):
    return grid(c)


ob.cte("x_wide20", "SELECT dataset, combo, kind, max(CASE WHEN model = 'cox' THEN c END) AS cox, max(CASE WHEN model = 'mlp' THEN c END) AS mlp FROM x_grid20 GROUP BY ALL")


def wide(c: Clinic):
    return grid(c).groupBy("dataset", "combo", "kind").pivot("model", ["cox", "mlp"]).agg(F.max("c"))


@query("a47_model_agreement", """
WITH b AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY cox DESC, combo) AS rc, row_number() OVER (PARTITION BY dataset ORDER BY mlp DESC, combo) AS rm, count(*) OVER (PARTITION BY dataset) AS n FROM x_wide20 WHERE cox IS NOT NULL AND mlp IS NOT NULL)
SELECT count(DISTINCT dataset) AS n, count_if(rc = 1 AND rm = 1) AS top1, count(DISTINCT CASE WHEN rc <= 2 AND rm <= 2 THEN dataset END) AS top2 FROM b WHERE n >= 2
""")
def a47_model_agreement(c: Clinic):
    return compare.model_agreement(wide(c), "cox", "mlp")


@query("a52_pooled_correlation", """
WITH r AS (SELECT CASE WHEN cox IS NOT NULL THEN rank() OVER (PARTITION BY dataset ORDER BY cox NULLS FIRST) + (count(*) OVER (PARTITION BY dataset, cox) - 1) / 2.0 END AS a, CASE WHEN mlp IS NOT NULL THEN rank() OVER (PARTITION BY dataset ORDER BY mlp NULLS FIRST) + (count(*) OVER (PARTITION BY dataset, mlp) - 1) / 2.0 END AS b FROM x_wide20)
SELECT count_if(a IS NOT NULL AND b IS NOT NULL) AS n, round(corr(a, b), 6) AS rho FROM r
""")
def a52_pooled_correlation(c: Clinic):
    return rounded(compare.pooled_correlation(compare.pooled_ranks(wide(c), ["cox", "mlp"]), "cox", "mlp"))


@query("a52_kind_rank", """
WITH r AS (SELECT *, rank() OVER (PARTITION BY dataset ORDER BY mlp DESC) + (count(*) OVER (PARTITION BY dataset, mlp) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY dataset) AS n FROM x_wide20 WHERE mlp IS NOT NULL),
g AS (SELECT dataset, arg_min(r, combo) AS r FROM r WHERE kind = 'greedy' AND n >= 2 GROUP BY 1) SELECT count(*) AS n, count_if(r = 1) AS n_first, round(avg(r), 6) AS mean_rank FROM g
""")
def a52_kind_rank(c: Clinic):
    return rounded(compare.kind_rank(wide(c), "mlp", "greedy"))


@query("t4_dataset_order", "SELECT dataset, row_number() OVER (ORDER BY n_event DESC, dataset) AS place FROM (SELECT dataset, count_if(censorship=0) AS n_event FROM x_labels GROUP BY 1)")
def t4_dataset_order(c: Clinic):
    """One row per dataset goes into the closing rank."""
    from pyspark.sql import Window

    n = labels(c).groupBy("dataset").agg(F.count_if(F.col("censorship") == 0).alias("e"))
    return n.select("dataset", F.row_number().over(Window.orderBy(F.desc("e"), "dataset")).cast("long").alias("place"))
