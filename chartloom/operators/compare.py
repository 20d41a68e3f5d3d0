"""Comparing score tables: profiles, overlaps, arms, tiers and differences.

These tables have one row per (dataset, field) or (dataset, scheme), so groups
are as large as the dataset and field registries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import leaf, parent_leaf


def quant(c, p: float) -> Column:
    return F.percentile(c, F.lit(p))


def spread_or_zero(c) -> Column:
    """Sample deviation, 0 for a single value."""
    return F.coalesce(F.stddev_samp(c), F.lit(0.0))


# ---- profiles ---------------------------------------------------------------
def dataset_profile(scores: DataFrame, chance: float = 0.5) -> DataFrame:
    """Score distribution of every dataset's fields; equal best scores go to the larger name."""
    c = F.col("c")
    return scores.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n_fields"), F.min(c).alias("c_min"), F.max(c).alias("c_max"),
        quant(c, 0.5).alias("c_median"), quant(c, 0.25).alias("c_q1"), quant(c, 0.75).alias("c_q3"),
        F.avg(c).alias("c_mean"), spread_or_zero(c).alias("c_std"), (F.max(c) - F.min(c)).alias("field_spread"),
        F.count_if(c >= chance).alias("n_ge_chance"), (F.count_if(c >= chance) / F.count(F.lit(1))).alias("frac_ge_chance"),
        F.max_by("field", F.struct("c", "field")).alias("top1_field"),
    )


def field_profile(scores: DataFrame) -> DataFrame:
    """Score distribution of every field over datasets."""
    c = F.col("c")
    return scores.groupBy("field").agg(
        F.count(F.lit(1)).alias("n_datasets"), quant(c, 0.5).alias("c_median"), F.avg(c).alias("c_mean"),
        F.min(c).alias("c_min"), F.max(c).alias("c_max"), (F.max(c) - F.min(c)).alias("c_range"),
        spread_or_zero(c).alias("c_std"), F.array_join(F.array_sort(F.collect_list("dataset")), ",").alias("datasets"),
    )


def short_labels(fields: DataFrame) -> DataFrame:
    """Leaf of a field, with its parent when another field has the same leaf."""
    w = Window.partitionBy("_leaf")
    named = fields.select("field").distinct().withColumn("_leaf", leaf(F.col("field")))
    label = F.when(F.count(F.lit(1)).over(w) > 1, parent_leaf(F.col("field"))).otherwise(F.col("_leaf"))
    return named.select("field", label.alias("label"))


# ---- top-k and overlap ------------------------------------------------------
#: datasets of one field that meet those of another block in a task
MEETING = 2_000


def top_k(scores: DataFrame, k: int, keys: list[str] = ("dataset",)) -> DataFrame:
    """Best ``k`` fields per group: score down, name up.  The rank filter drops all but k rows per task early."""
    w = Window.partitionBy(*keys).orderBy(F.desc("c"), "field")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _sharing(scores: DataFrame, ks: list[int]) -> DataFrame:
    top = top_k(scores, max(ks)).select("dataset", "field", "rank")
    return top.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).where("rank <= k")


def _meetings(members: DataFrame, block: int) -> DataFrame:
    """(k, a, b) once for every field that the datasets a < b share; a field of many datasets is split into pairs of blocks."""
    sizes = members.groupBy("k", "field").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("blocks"))
    cut = members.join(sizes, ["k", "field"]).withColumn("at", F.pmod(F.xxhash64("dataset"), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    a = cut.select("k", "field", F.col("dataset").alias("a"), F.col("at").alias("i"), every.alias("j"))
    b = cut.select("k", "field", F.col("dataset").alias("b"), every.alias("i"), F.col("at").alias("j"))
    return a.join(b, ["k", "field", "i", "j"]).where("a < b").select("k", "a", "b")


def pair_overlap(scores: DataFrame, ks: list[int], block: int = MEETING) -> DataFrame:
    """Shared top-k fields of every pair of datasets that shares any (a < b).

    The join meets datasets on a common field, so at most k fields per dataset
    take part, ``block`` by ``block`` datasets in a task; pairs that share
    nothing are counted, not listed.
    """
    members = _sharing(scores, ks)
    shared = _meetings(members, block).groupBy("k", "a", "b").agg(F.count(F.lit(1)).alias("shared"))
    sizes = members.groupBy("k", "dataset").agg(F.count(F.lit(1)).alias("m"))
    sa = sizes.select("k", F.col("dataset").alias("a"), F.col("m").alias("ma"))
    sb = sizes.select("k", F.col("dataset").alias("b"), F.col("m").alias("mb"))
    j = shared.join(sa, ["k", "a"]).join(sb, ["k", "b"])
    return j.select(
        "k", "a", "b", "shared", (F.col("shared") / F.col("k")).alias("overlap"),
        (F.col("shared") / (F.col("ma") + F.col("mb") - F.col("shared"))).alias("jaccard"),
    )


def overlap_summary(scores: DataFrame, ks: list[int], block: int = MEETING) -> DataFrame:
    """Per k: mean, median, least and greatest overlap over all dataset pairs, Jaccard, and how fields spread.

    Pairs are counted by the number of fields they share, at most k counts, and
    everything about overlaps comes from these counts.
    """
    members = _sharing(scores, ks)
    n = members.groupBy("k").agg(F.countDistinct("dataset").alias("n_datasets"))
    total = (F.col("n_datasets") * (F.col("n_datasets") - 1) / 2).cast("long")
    counts = pair_overlap(scores, ks, block).groupBy("k", "shared").agg(F.count(F.lit(1)).alias("c"), F.sum("jaccard").alias("jaccard"))
    upward = Window.partitionBy("k").orderBy("shared")
    run = counts.withColumn("upto", F.sum("c").over(upward)).withColumn("meeting", F.sum("c").over(Window.partitionBy("k")))
    run = run.join(n, "k").withColumn("empty", total - F.col("meeting"))

    def at(position: Column) -> Column:
        """Shared fields of the pair at a place of the order; pairs without any stand first."""
        return F.when(F.max(position - F.col("empty")) < 0, 0).otherwise(F.min(F.when(F.col("upto") > position - F.col("empty"), F.col("shared"))))

    per = run.groupBy("k").agg(
        F.max("meeting").alias("meeting"), F.sum(F.col("c") * F.col("shared")).alias("_s"), F.sum("jaccard").alias("_j"),
        F.min("shared").alias("_min"), F.max("shared").alias("_max"),
        ((at(F.floor((total - 1) / 2)) + at(F.ceil((total - 1) / 2))) / 2.0).alias("_median"),
    )
    hits = members.groupBy("k", "field").agg(F.count(F.lit(1)).alias("h")).join(n, "k").groupBy("k").agg(
        F.count(F.lit(1)).alias("n_union_fields"), F.count_if(F.col("h") == F.col("n_datasets")).alias("n_in_all"),
        F.count_if(F.col("h") >= F.col("n_datasets") / 2.0).alias("n_in_half"), F.count_if(F.col("h") == 1).alias("n_unique"),
    )
    j = n.join(per, "k", "left").join(hits, "k")
    empty = total - F.coalesce("meeting", F.lit(0))
    share = lambda c: F.coalesce(F.col(c), F.lit(0)) / F.col("k")
    return j.select(
        "k", total.alias("n_pairs"), F.try_divide(share("_s"), total).alias("mean_overlap"),
        share("_median").alias("median_overlap"), F.when(empty > 0, 0.0).otherwise(share("_min")).alias("min_overlap"),
        share("_max").alias("max_overlap"), F.try_divide(F.coalesce("_j", F.lit(0.0)), total).alias("mean_jaccard"),
        empty.alias("n_empty_pairs"), F.try_divide(empty, total).alias("fraction_empty_pairs"),
        "n_union_fields", "n_in_all", "n_in_half", "n_unique",
    )


# ---- fold scores ------------------------------------------------------------
def fold_scores(folds: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and sample deviation over folds, validation first, test where there is no validation score."""
    agg = folds.groupBy(*keys).agg(
        F.count("val").alias("_n"), F.avg("val").alias("_vm"), spread_or_zero("val").alias("_vs"),
        F.avg("test").alias("_tm"), spread_or_zero("test").alias("_ts"),
    )
    val = F.col("_n") > 0
    return agg.select(
        *keys, F.when(val, F.col("_vm")).otherwise(F.col("_tm")).alias("c_mean"),
        F.when(val, F.col("_vs")).otherwise(F.col("_ts")).alias("c_std"), F.when(val, "val").otherwise("test").alias("source"),
    )


def recompute_audit(folds: DataFrame, table: DataFrame, keys: list[str], tolerance: float = 1e-12) -> DataFrame:
    """Stored means against means of the fold values, with a stale flag."""
    fresh = folds.groupBy(*keys).agg(F.avg("val").alias("recomputed"))
    gap = F.abs(F.col("recomputed") - F.col("stored"))
    return fresh.join(table, keys).withColumns({"stale": gap > tolerance})


def run_summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Evaluated fields of a run: counts and the failed ones."""
    failed = F.array_sort(F.collect_list(F.when(F.col("status") == "error", F.col("field"))))
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_fields"), F.count_if(F.col("status") == "ok").alias("n_ok"),
        F.count_if(F.col("status") == "error").alias("n_error"), F.array_join(failed, ",").alias("errors"),
    )


def field_order(rows: DataFrame) -> list[Column]:
    """Good rows by score down and index, failed rows after them by index."""
    ok = F.col("status") == "ok"
    return [F.when(ok, 0).otherwise(1), F.when(ok, -F.col("c")), F.col("field_idx")]


# ---- arms -------------------------------------------------------------------
def field_arms(t0: DataFrame, off: DataFrame, leak: DataFrame, changes: DataFrame, excluded: DataFrame) -> DataFrame:
    """Both arms of every t0 field with leak rate, changed cells and exclusion; unusable rows carry a reason."""
    on = ["dataset", "field"]
    j = (
        t0.select(*on, "field_idx", F.col("c").alias("c_t0"), F.col("status").alias("_st"))
        .join(off.select(*on, F.col("c").alias("c_off"), F.col("status").alias("_so")), on, "left")
        .join(leak.select(*on, "leak_rate", F.lit(True).alias("_l")), on, "left")
        .join(changes.select(*on, "changed_cells"), on, "left")
        .join(excluded.select(*on, "rule"), on, "left")
    )
    reason = (
        F.when(F.col("_st") != "ok", "t0_not_ok").when(F.col("_so").isNull(), "off_missing_field")
        .when(F.col("_so") != "ok", F.concat(F.lit("off_status="), F.col("_so"))).otherwise("")
    )
    ok = reason == ""
    return j.select(
        *on, "field_idx", reason.alias("pending"), F.when(ok, F.col("c_t0")).alias("c_t0"), F.when(ok, F.col("c_off")).alias("c_off"),
        F.when(ok, F.col("c_off") - F.col("c_t0")).alias("delta_c"), "leak_rate",
        F.when(F.col("_l").isNull(), "pending").when(F.col("leak_rate").isNull(), "undefined").otherwise("ok").alias("leak_rate_status"),
        (F.coalesce("changed_cells", F.lit(0)) > 0).alias("mask_affected"),
        F.when(F.col("rule").isNotNull(), "excluded").otherwise("kept").alias("t0_filter_status"),
    )


def noise_floor(rows: DataFrame, threshold: float) -> DataFrame:
    """Difference statistics of fields whose values the mask changed, left alone, or for which that is unknown."""
    d, size = F.col("delta_c"), F.abs("delta_c")
    label = F.when(F.col("mask_affected").isNull(), "unknown").when(F.col("mask_affected"), "mask_affected").otherwise("mask_unaffected")
    return rows.where("delta_c is not null").groupBy(label.alias("label")).agg(
        F.count(F.lit(1)).alias("n_fields"), F.avg(d).alias("delta_mean"), quant(d, 0.5).alias("delta_median"),
        spread_or_zero(d).alias("delta_std"), F.min(d).alias("delta_min"), F.max(d).alias("delta_max"),
        quant(size, 0.9).alias("abs_delta_p90"), F.max(size).alias("abs_delta_max"), F.avg((size >= threshold).cast("double")).alias("share_ge"),
    )


def floor_violations(rows: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    return rows.where(~F.col("mask_affected") & (F.abs("delta_c") > tolerance))


def dataset_deltas(rows: DataFrame, threshold: float) -> DataFrame:
    d = F.col("delta_c")
    return rows.where("delta_c is not null").groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n_fields"), F.avg(d).alias("delta_mean"), quant(d, 0.5).alias("delta_median"),
        F.min(d).alias("delta_min"), F.max(d).alias("delta_max"), F.count_if(F.abs(d) >= threshold).alias("n_ge"),
        F.count_if(d > 0).alias("n_positive"),
        F.max_by("field", F.struct("delta_c", "field")).alias("top_positive_field"),
        F.min_by("field", F.struct("delta_c", "field")).alias("top_negative_field"),
    )


def field_impact(rows: DataFrame, consistency: float = 0.05) -> DataFrame:
    """Fields by median difference where the mask changed values; ``place`` orders them, unaffected fields last."""
    d, hit = F.col("delta_c"), F.col("mask_affected")
    agg = rows.where("delta_c is not null").groupBy("field").agg(
        F.count(F.lit(1)).alias("n_datasets_total"), F.count_if(hit).alias("n_datasets_affected"),
        quant(F.when(hit, d), 0.5).alias("median_affected"),
        F.avg(F.when(hit, (F.abs(d) >= consistency).cast("double"))).alias("frac_affected"), F.max(F.abs(d)).alias("max_abs_delta"),
        F.avg(d).alias("delta_mean"), F.count_if(d > 0).alias("n_positive"), F.count_if(d < 0).alias("n_negative"),
    )
    w = Window.orderBy(
        (F.col("n_datasets_affected") == 0), F.desc_nulls_last("median_affected"),
        F.when(F.col("n_datasets_affected") == 0, -F.col("n_datasets_total")), "field",
    )
    return agg.withColumn("place", F.row_number().over(w).cast("long"))


def admitted_summary(rows: DataFrame, theta: float, delta: float) -> DataFrame:
    """Per dataset: admitted and excluded fields, influential ones (leaky and moved), and signs."""
    kept = F.col("t0_filter_status") == "kept"
    strong = kept & (F.col("leak_rate") > theta) & (F.abs("delta_c") >= delta)
    return rows.where("delta_c is not null").groupBy("dataset").agg(
        F.count_if(kept).alias("n_admitted"), F.count_if(~kept).alias("n_excluded"),
        F.count_if(F.coalesce(strong, F.lit(False))).alias("n_influential"),
        F.count_if(kept & (F.col("delta_c") > 0)).alias("n_positive"), F.count_if(kept & (F.col("delta_c") < 0)).alias("n_negative"),
    )


def delta_matrix(rows: DataFrame) -> DataFrame:
    """The dataset by field matrix in long form: (dataset, field, column, delta_c).

    ``column`` numbers the fields from 1 by the size of their mean difference.
    The window that numbers them sees one row per field of the registry.
    """
    known = rows.where("delta_c is not null")
    means = known.groupBy("field").agg(F.avg("delta_c").alias("m"))
    order = Window.orderBy(F.desc(F.round(F.abs("m"), 9)), "field")
    placed = means.select("field", F.row_number().over(order).cast("long").alias("column"))
    cells = known.groupBy("dataset", "field").agg(F.first("delta_c").alias("delta_c"))
    return cells.join(placed, "field").select("dataset", "field", "column", "delta_c")


def paired_arms(rows: DataFrame) -> DataFrame:
    """Report and de-leaked rows of the same work: exactly one of each, else the job fails.

    ``rows`` has dataset, work, analyzer, t (raw or lm0), c.
    """
    keys = ["dataset", "work", "analyzer"]
    raw, lm0 = F.col("t") == "raw", F.col("t") == "lm0"
    agg = rows.groupBy(*keys).agg(
        F.count_if(raw).alias("_a"), F.count_if(lm0).alias("_b"),
        F.max(F.when(raw, F.col("c"))).alias("c_report"), F.max(F.when(lm0, F.col("c"))).alias("c_deleaked"),
    )
    fine = (F.col("_a") == 1) & (F.col("_b") == 1)
    checked = F.when(fine, F.col("c_report") - F.col("c_deleaked")).otherwise(
        F.raise_error(F.concat(F.lit("arm rows missing or repeated: "), F.concat_ws("/", *keys))).cast("double")
    )
    return agg.select(*keys, "c_report", "c_deleaked", checked.alias("delta"))


def scheme_deltas(pairs: DataFrame) -> DataFrame:
    """Mean, median, deviation and direction of the differences per (work, analyzer)."""
    d = F.col("delta")
    return pairs.groupBy("work", "analyzer").agg(
        F.count(F.lit(1)).alias("n_datasets"), F.avg(d).alias("mean_delta"), quant(d, 0.5).alias("median_delta"),
        F.stddev_samp(d).alias("sd_delta"), F.avg((d > 0).cast("double")).alias("direction_consistency"),
    )


def two_arms(work_fields: DataFrame, greedy_fields: DataFrame, scores: DataFrame, search: DataFrame, sentences: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(comparison, missed fields): greedy against a work's field set per dataset and modality.

    Greedy scores fall back to the best search score.  ``scores`` has dataset,
    work, modality, b_c, c_c; the field tables hold one row per field.
    """
    missed = greedy_fields.join(work_fields.select("dataset", "work").distinct(), "dataset").join(
        work_fields, ["dataset", "work", "field"], "left_anti"
    )
    n_missed = missed.groupBy("dataset", "work").agg(F.count(F.lit(1)).alias("n_missed"))
    n_work = work_fields.groupBy("dataset", "work").agg(F.count(F.lit(1)).alias("n_fields_work"))
    n_greedy = greedy_fields.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_fields_greedy"))
    c = F.coalesce("c_c", "best_c")
    table = (
        scores.join(search.select("dataset", "modality", "best_c"), ["dataset", "modality"], "left")
        .join(n_work, ["dataset", "work"]).join(n_greedy, "dataset").join(n_missed, ["dataset", "work"], "left")
        .select("dataset", "work", "modality", "n_fields_work", "n_fields_greedy", "b_c", c.alias("c_c"),
                F.round(c - F.col("b_c"), 6).alias("delta_c_minus_b"), F.coalesce("n_missed", F.lit(0)).alias("n_missed"))
    )
    said = missed.join(sentences, ["dataset", "field"], "left").select(
        "dataset", "work", "field", F.coalesce("sentence", F.lit("")).alias("bank_sentence")
    )
    return table, said


def four_tiers(pairs: DataFrame, report: DataFrame, deleak: DataFrame, reach: DataFrame, search: DataFrame, reach_raw: DataFrame) -> DataFrame:
    """Report, de-leaked, reachable and raw reachable score of every (dataset, work) with four differences."""
    on = ["dataset", "work"]
    j = (
        pairs.join(report.select(*on, F.col("c").alias("report_c")), on, "left")
        .join(deleak.select(*on, F.col("c").alias("deleak_c")), on, "left")
        .join(reach.select(*on, F.col("c").alias("_r")), on, "left")
        .join(search.select("dataset", F.col("best_c").alias("_s")), "dataset", "left")
        .join(reach_raw.select("dataset", F.col("c").alias("reach_raw_c")), "dataset", "left")
        .withColumn("reach_c", F.coalesce("_r", "_s"))
    )
    gap = lambda a, b: F.round(F.col(a) - F.col(b), 6)
    return j.select(
        *on, "report_c", "deleak_c", "reach_c", "reach_raw_c",
        gap("report_c", "deleak_c").alias("report_minus_deleak"), gap("deleak_c", "reach_c").alias("deleak_minus_reach"),
        gap("report_c", "reach_raw_c").alias("report_minus_reach_raw"), gap("reach_raw_c", "reach_c").alias("reach_raw_minus_reach"),
        F.when(F.col("reach_c").isNull(), "pending_C").otherwise("ok").alias("status"),
    )


def tier_means(tiers: DataFrame, group: str) -> DataFrame:
    names = ["report_c", "deleak_c", "reach_c", "reach_raw_c"]
    return tiers.where("status = 'ok'").dropna(subset=names).groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(n).alias(n) for n in names]
    )


# ---- bindings, sets and grids -------------------------------------------------
def bindings(datasets: DataFrame, free: list[str], bound: DataFrame) -> DataFrame:
    """(scheme, dataset): unbound schemes on every dataset, bound schemes on their own."""
    names = F.explode(F.array(*[F.lit(s) for s in free])).alias("scheme")
    return datasets.select(names, "dataset").unionByName(bound.join(datasets, "dataset", "left_semi").select("scheme", "dataset"))


def bank_positions(wanted: DataFrame, bank: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept in wanted order with bank index, dropped names)."""
    on = ["dataset", "field"]
    kept = wanted.join(bank.select(*on, "field_idx"), on)
    return kept.select("dataset", "scheme", "ord", "field", "field_idx"), wanted.join(bank, on, "left_anti").select("dataset", "scheme", "field")


def registered_schemes(wanted: DataFrame, bank: DataFrame) -> DataFrame:
    """Fields of a scheme the bank has, the missing ones, and whether anything is left to register."""
    hit = wanted.join(bank.select("dataset", "field", F.lit(True).alias("_in")), ["dataset", "field"], "left")
    inside = F.col("_in").isNotNull()
    names = lambda test: F.array_join(F.array_sort(F.collect_list(F.when(test, F.col("field")))), ",")
    return hit.groupBy("dataset", "scheme").agg(
        names(inside).alias("fields"), names(~inside).alias("missing"), (F.count_if(inside) > 0).alias("usable")
    )


def ordered_distinct(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.min(order).alias(order))


def set_differences(left: DataFrame, right: DataFrame, keys: list[str], member: str) -> DataFrame:
    """Members on one side only, per key: counts and the first few in order."""
    on = [*keys, member]
    a = left.select(*on).distinct().join(right.select(*on), on, "left_anti").withColumn("side", F.lit("left_only"))
    b = right.select(*on).distinct().join(left.select(*on), on, "left_anti").withColumn("side", F.lit("right_only"))
    w = Window.partitionBy(*keys, "side").orderBy(member)
    both = a.unionByName(b)
    n = both.groupBy(*keys, "side").agg(F.count(F.lit(1)).alias("n"))
    few = both.withColumn("r", F.row_number().over(w)).where("r <= 5").groupBy(*keys, "side").agg(
        F.array_join(F.array_sort(F.collect_list(F.col(member).cast("string"))), ",").alias("sample")
    )
    return n.join(few, [*keys, "side"])


def slide_cases(slides: DataFrame, cases: DataFrame, width: int = 12) -> DataFrame:
    """Slide to case by upper-case barcode prefix, first case in table order; unmatched slides leave."""
    first = cases.groupBy(F.upper("case_id").alias("_k")).agg(F.min_by(F.struct(*cases.columns), "ord").alias("_c"))
    keyed = slides.withColumn("_k", F.upper(F.substring("slide", 1, width)))
    return keyed.join(first, "_k").select(
        F.substring("slide", 1, width).alias("case_id"), F.concat("slide", F.lit(".svs")).alias("slide_id"),
        *[F.col(f"_c.{c}").alias(c) for c in cases.columns if c not in ("case_id", "ord")],
    )


def fold_events(folds: DataFrame, events: DataFrame, pattern: str) -> DataFrame:
    """Events per fold from rows that list slide barcodes joined by semicolons."""
    one = folds.select("dataset", "fold", F.explode(F.split("slides", ";")).alias("s"))
    named = one.select("dataset", "fold", F.regexp_extract("s", pattern, 1).alias("case_id")).where("case_id <> ''").distinct()
    return named.join(events, ["dataset", "case_id"]).groupBy("dataset", "fold").agg(F.sum("event").alias("n_event"))


def count_mismatches(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Keys whose counts differ between two tables that both have them."""
    return a.select(key, F.col(value).alias("left")).join(b.select(key, F.col(value).alias("right")), key).where("left <> right")


def combination_grid(paths: DataFrame, schemes: DataFrame, models: list[str], scores: DataFrame) -> DataFrame:
    """Every field combination with every model and its score: validation, then test, else missing."""
    combos = paths.select("dataset", "combo", F.lit("greedy").alias("kind")).unionByName(
        schemes.select("dataset", "combo", F.lit("scheme").alias("kind"))
    )
    grid = combos.withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))
    j = grid.join(scores, ["dataset", "combo", "model"], "left")
    c = F.coalesce("val", "test")
    source = F.when(F.col("val").isNotNull(), "val").when(F.col("test").isNotNull(), "test").otherwise("missing")
    return j.select("dataset", "combo", "kind", "model", c.alias("c"), source.alias("status"))


def model_agreement(scores: DataFrame, a: str, b: str) -> DataFrame:
    """In how many datasets two models agree on the best combination, and share one of the best two."""
    both = scores.where(F.col(a).isNotNull() & F.col(b).isNotNull())

    def best(model: str, n: int) -> DataFrame:
        w = Window.partitionBy("dataset").orderBy(F.desc(model), "combo")
        return both.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n).groupBy("dataset").agg(
            F.array_sort(F.collect_list(F.struct("r", "combo"))).alias(f"top_{model}"), F.lit(1).alias(f"_{model}")
        )

    n = both.groupBy("dataset").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    j = n.join(best(a, 2), "dataset").join(best(b, 2), "dataset")
    names = lambda m: F.transform(f"top_{m}", lambda x: x["combo"])
    same = F.element_at(names(a), 1) == F.element_at(names(b), 1)
    return j.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(same).alias("top1"), F.count_if(F.arrays_overlap(names(a), names(b))).alias("top2")
    )


def pooled_ranks(scores: DataFrame, models: list[str]) -> DataFrame:
    """Within-dataset average ranks (small score first) of every model, pooled; one row per combination."""
    out = scores
    for m in models:
        w, tie = Window.partitionBy("dataset").orderBy(m), Window.partitionBy("dataset", m)
        out = out.withColumn(f"{m}_rank", F.when(F.col(m).isNotNull(), F.rank().over(w) + (F.count(F.lit(1)).over(tie) - 1) / 2.0))
    return out


def pooled_correlation(ranked: DataFrame, a: str, b: str) -> DataFrame:
    return ranked.agg(F.count(F.when(F.col(f"{a}_rank").isNotNull() & F.col(f"{b}_rank").isNotNull(), 1)).alias("n"), F.corr(f"{a}_rank", f"{b}_rank").alias("rho"))


def kind_rank(scores: DataFrame, model: str, kind: str) -> DataFrame:
    """How often a kind of combination is the best of its dataset, and its mean rank."""
    w = Window.partitionBy("dataset").orderBy(F.desc(model))
    tie, whole = Window.partitionBy("dataset", model), Window.partitionBy("dataset")
    ranked = scores.where(F.col(model).isNotNull()).withColumns({
        "rank": F.rank().over(w) + (F.count(F.lit(1)).over(tie) - 1) / 2.0, "size": F.count(F.lit(1)).over(whole),
    })
    own = ranked.where((F.col("kind") == kind) & (F.col("size") >= 2)).groupBy("dataset").agg(F.min_by("rank", "combo").alias("rank"))
    return own.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("rank") == 1).alias("n_first"), F.avg("rank").alias("mean_rank"))
