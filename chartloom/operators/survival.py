"""Survival statistics over tables of predictions.

Groups are (run, fold) style keys given by the caller.  Pairs of patients are
never produced: concordance counts, for each event, how many later patients
have a smaller risk, by counting along sorted orders.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scale import HOT_ROWS, checkpointed, ordered_columns

TIE = 1e-8


def _match(left: list[str], prefix: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(prefix + k)) for k in left], F.lit(True))


def _renamed(df: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    return df.select(*[F.col(k).alias(prefix + k) if k in keys else F.col(k) for k in df.columns])


# ---- risk -------------------------------------------------------------------
def survival_columns(logits: Column) -> Column:
    """Running product of one minus the sigmoid of each logit."""
    start = F.struct(F.array().cast("array<double>").alias("s"), F.lit(1.0).alias("p"))

    def step(acc: Column, x: Column) -> Column:
        p = acc["p"] * (1.0 - 1.0 / (1.0 + F.exp(-x)))
        return F.struct(F.concat(acc["s"], F.array(p)).alias("s"), p.alias("p"))

    return F.aggregate(logits, start, step, lambda acc: acc["s"])


def risk_of(survival: Column) -> Column:
    return -F.aggregate(survival, F.lit(0.0), lambda a, x: a + x)


def interpolated(survival: Column, edges: list[float], t: Column) -> Column:
    """Survival at ``t`` from values at fixed edges: 1 at day 0, linear inside, 0 after the last edge."""
    out = F.lit(0.0)
    xs = [0.0, *edges]
    for i in range(len(edges) - 1, -1, -1):
        y0 = F.lit(1.0) if i == 0 else F.element_at(survival, i)
        y1 = F.element_at(survival, i + 1)
        share = (t - xs[i]) / (xs[i + 1] - xs[i])
        out = F.when(t <= xs[i + 1], y0 + (y1 - y0) * share).otherwise(out)
    return F.when(t <= 0, 1.0).otherwise(out)


def without_unusable(df: DataFrame) -> DataFrame:
    """Rows whose risk is a number; the next filter works on what is left."""
    return df.where(F.col("risk").isNotNull() & ~F.isnan("risk"))


def metric_rows(predictions: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows for the metrics, folds that had a negative time): negative times leave, and are counted per fold."""
    usable = without_unusable(predictions)
    folds = usable.groupBy(*keys).agg(F.count_if(F.col("time") < 0).alias("n_negative"))
    return usable.where(F.col("time") >= 0), folds


def cohort_rows(cohort: DataFrame, folds: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """The weighting cohort of every fold; its negative times leave only for folds that had one themselves."""
    flagged = folds.join(_renamed(cohort, by, "_c_"), _match(by, "_c_"))
    kept = flagged.where((F.col("n_negative") == 0) | (F.col("time") >= 0))
    return kept.drop(*[f"_c_{k}" for k in by], "n_negative")


# ---- concordance --------------------------------------------------------------
def _later_below(start, limit, ranks, weights, width):
    """For each query: weight of positions at or after ``start`` whose rank is below ``limit``.

    The suffix is walked in aligned blocks of doubling size; a block is one
    stretch of a sorted (block, rank) array, so each step is two searches.
    """
    n = len(ranks)
    out = np.zeros(len(start))
    at = start.astype(np.int64).copy()
    pos = np.arange(n, dtype=np.int64)
    for bit in range(max(1, int(n).bit_length())):
        step = np.int64(1) << bit
        todo = ((at & step) != 0) & (at < n)
        if todo.any():
            key = (pos >> bit) * (width + 1) + ranks
            order = np.argsort(key, kind="stable")
            key = key[order]
            total = np.concatenate([[0.0], np.cumsum(weights[order])])
            base = (at[todo] >> bit) * (width + 1)
            out[todo] += total[np.searchsorted(key, base + limit[todo])] - total[np.searchsorted(key, base)]
        at = np.where((at & step) != 0, at + step, at)
    # position 0 has no set bit: it covers the whole range
    whole = start == 0
    if whole.any():
        order = np.argsort(ranks, kind="stable")
        total = np.concatenate([[0.0], np.cumsum(weights[order])])
        out[whole] = total[np.searchsorted(ranks[order], limit[whole])]
    return out


def _pairs(pdf: pd.DataFrame) -> tuple[float, float]:
    """Weighted concordant and tied pairs inside one group of distinct (time, event, risk, weight) points."""
    time = pdf["time"].to_numpy(float)
    event = pdf["event"].to_numpy(bool)
    risk = pdf["risk"].to_numpy(float)
    n = pdf["n"].to_numpy(float)
    weight = pdf["weight"].to_numpy(float)
    order = np.lexsort((~event, time))
    time, event, risk, n, weight = time[order], event[order], risk[order], n[order], weight[order]
    values = np.unique(risk)
    ranks = np.searchsorted(values, risk)
    # events of one time come before its censored rows, which count as later
    censored_from = np.searchsorted(time, time, side="left") + np.bincount(
        np.searchsorted(np.unique(time), time), weights=event.astype(float)
    )[np.searchsorted(np.unique(time), time)].astype(np.int64)
    start = censored_from[event]
    below = _later_below(start, np.searchsorted(values, risk[event] - TIE, "left"), ranks, n, len(values))
    upto = _later_below(start, np.searchsorted(values, risk[event] + TIE, "right"), ranks, n, len(values))
    own = n[event] * weight[event]
    return float((own * below).sum()), float((own * (upto - below)).sum())


def _sum_pairs(points: DataFrame, keys: list[str], group: list[str]) -> DataFrame:
    schema = ", ".join(f"`{k}` {t}" for k, t in points.select(*keys).dtypes) + ", concordant double, tied double"

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        concordant, tied = _pairs(pdf)
        row = {k: [pdf[k].iloc[0]] for k in keys}
        return pd.DataFrame({**row, "concordant": [concordant], "tied": [tied]})

    return points.groupBy(*group).applyInPandas(count, schema)


def concordance(
    df: DataFrame, keys: list[str], weight: str | None = None, rows: int | None = None, limit: int = HOT_ROWS
) -> DataFrame:
    """Harrell's c per group; with ``weight`` each event's pairs count by its weight.

    Comparable: an event and any patient with a later time, or the same time
    and censored.  Risks within 1e-8 count one half; groups without a
    comparable pair get 0.

    Small inputs are counted group by group.  Otherwise the time order of each
    group is cut into bounded pieces: pairs inside a piece are counted there,
    pairs across pieces by running sums over pieces merged level by level.
    """
    w = F.col(weight) if weight else F.lit(1.0)
    points = (
        df.select(*keys, F.col("time").cast("double"), F.col("event").cast("boolean"), F.col("risk").cast("double"),
                  w.cast("double").alias("weight"))
        .groupBy(*keys, "time", "event", "risk", "weight").agg(F.count(F.lit(1)).alias("n"))
    )
    cutting = rows is None or rows > limit
    if cutting:
        # read by every step below
        points = checkpointed(points)
    later = points.withColumn("late", ~F.col("event"))
    marks = later.groupBy(*keys, "time", "late").agg(
        F.sum("n").alias("n"), F.sum(F.when(~F.col("late"), F.col("n") * F.col("weight"))).alias("own")
    )
    marks = ordered_columns(marks, keys, ["time", "late"], {"upto": ("sum", "n")}, rows, limit)
    if cutting:
        marks = checkpointed(marks)
    # the last event mark of a time also stands before that time's censored rows
    sizes = marks.groupBy(*keys).agg(F.sum("n").alias("size"), F.count_if(~F.col("late")).alias("_e"))
    sized = marks.where(~F.col("late")).join(_renamed(sizes.select(*keys, "size"), keys, "_z_"), _match(keys, "_z_"))
    comparable = sized.groupBy(*keys).agg(F.sum(F.col("own") * (F.col("size") - F.col("upto"))).alias("comparable"))
    counted = _cut_pairs(points, marks, keys, limit) if cutting else _sum_pairs(points, keys, keys)
    out = sizes.select(*keys).join(_renamed(comparable, keys, "_p_"), _match(keys, "_p_"), "left").join(
        _renamed(counted, keys, "_q_"), _match(keys, "_q_"), "left"
    )
    c = (F.coalesce("concordant", F.lit(0.0)) + 0.5 * F.coalesce("tied", F.lit(0.0))) / F.col("comparable")
    none = F.coalesce("comparable", F.lit(0.0)) == 0
    return out.select(
        *keys, F.coalesce("comparable", F.lit(0.0)).alias("comparable"),
        F.coalesce("concordant", F.lit(0.0)).alias("concordant"), F.coalesce("tied", F.lit(0.0)).alias("tied"),
        F.when(none, 0.0).otherwise(c).alias("c_index"),
    )


def _cut_pairs(points: DataFrame, marks: DataFrame, keys: list[str], limit: int) -> DataFrame:
    size = max(1, limit // 2)
    # a mark with more rows than a piece holds gets a piece of its own: no pair inside it is comparable
    big = F.col("n") > size
    piece = 2 * F.floor((F.col("upto") - F.col("n")) / size) + F.when(big, 1).otherwise(0)
    cut = marks.select(*keys, "time", "late", piece.cast("long").alias("piece"), big.alias("big"))
    placed = points.withColumn("late", ~F.col("event")).join(
        _renamed(cut, [*keys, "time", "late"], "_m_"), _match([*keys, "time", "late"], "_m_")
    ).select(*keys, "time", "event", "risk", "weight", "n", "piece", "big")
    placed = checkpointed(placed)
    inside = _sum_pairs(placed.where(~F.col("big")), keys, [*keys, "piece"])
    last = cut.agg(F.max("piece")).first()[0] or 0
    levels = F.sequence(F.lit(0), F.lit(max(0, int(last).bit_length() - 1)))
    data = placed.select(*keys, "piece", "risk", "n", F.explode(levels).alias("level")).select(
        *keys, "level", F.expr("shiftright(piece, level)").alias("block"),
        F.col("risk").alias("at"), F.lit(0).alias("side"), F.col("n").alias("data"), F.lit(0.0).alias("own"),
    )
    asks = placed.where("event").select(*keys, "piece", "risk", "n", "weight", F.explode(levels).alias("level")).where(
        F.expr("shiftright(piece, level) % 2 = 0")
    )
    shift = F.explode(F.array(
        F.struct((F.col("risk") - TIE).alias("at"), F.lit(-1).alias("side")),
        F.struct((F.col("risk") + TIE).alias("at"), F.lit(1).alias("side")),
    ))
    asks = asks.select(*keys, "level", (F.expr("shiftright(piece, level)") + 1).alias("block"), "n", "weight", shift.alias("_a"))
    asks = asks.select(
        *keys, "level", "block", "_a.at", "_a.side", F.lit(0).cast("long").alias("data"), (F.col("n") * F.col("weight")).alias("own")
    )
    both = data.unionByName(asks).groupBy(*keys, "level", "block", "at", "side").agg(
        F.sum("data").alias("data"), F.sum("own").alias("own")
    )
    run = ordered_columns(both, [*keys, "level", "block"], ["at", "side"], {"seen": ("sum", "data")}, None, limit)
    below = F.sum(F.when(F.col("side") == -1, F.col("own") * F.col("seen")).otherwise(0.0))
    upto = F.sum(F.when(F.col("side") == 1, F.col("own") * F.col("seen")).otherwise(0.0))
    across = run.groupBy(*keys).agg(below.alias("concordant"), (upto - below).alias("tied"))
    return inside.unionByName(across).groupBy(*keys).agg(
        F.sum("concordant").alias("concordant"), F.sum("tied").alias("tied")
    )


# ---- curves -----------------------------------------------------------------
def kaplan_meier(df: DataFrame, keys: list[str], of: str = "event", rows: int | None = None, limit: int = HOT_ROWS) -> DataFrame:
    """Survival curve per group at every distinct time; ``of='censoring'`` gives the censoring curve.

    On equal times deaths come before censorings, so the censoring curve's risk
    set leaves that time's deaths out.
    """
    e = F.col("event").cast("boolean")
    counts = df.groupBy(*keys, "time").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(e).alias("d"), F.count_if(~e).alias("c")
    ).withColumn("back", -F.col("time"))
    risk = ordered_columns(counts, keys, ["back"], {"at_risk": ("sum", "n")}, rows, limit)
    left = F.col("at_risk") - (F.col("d") if of == "censoring" else F.lit(0))
    gone = F.col("c") if of == "censoring" else F.col("d")
    ratio = F.when(gone > 0, 1.0 - gone / left).otherwise(1.0)
    staged = risk.withColumns({
        "_log": F.when(ratio > 0, F.log(ratio)).otherwise(0.0), "_dead": F.when(ratio <= 0, 1).otherwise(0),
    })
    curve = ordered_columns(staged, keys, ["time"], {"_sum": ("sum", "_log"), "_out": ("sum", "_dead")}, rows, limit)
    s = F.when(F.col("_out") > 0, 0.0).otherwise(F.exp("_sum"))
    return curve.select(*keys, "time", "at_risk", "d", "c", s.alias("survival"))


def step_values(curve: DataFrame, asks: DataFrame, keys: list[str], rows: int | None = None, limit: int = HOT_ROWS) -> DataFrame:
    """Curve value at the latest curve time at or before each asked time, 1 before the first.

    ``asks`` has the keys and ``time`` (distinct).  The curve never rises, so
    the running minimum in time order is the latest value.
    """
    line = curve.select(*keys, "time", F.lit(0).alias("ask"), F.col("survival").alias("v"))
    want = asks.select(*keys, "time", F.lit(1).alias("ask"), F.lit(None).cast("double").alias("v"))
    run = ordered_columns(line.unionByName(want), keys, ["time", "ask"], {"g": ("min", "v")}, rows, limit)
    return run.where("ask = 1").select(*keys, "time", F.coalesce("g", F.lit(1.0)).alias("value"))


def with_censoring(df: DataFrame, cohort: DataFrame, keys: list[str], rows: int | None = None) -> DataFrame:
    """Add ``g``, the censoring survival of the cohort at each row's own time."""
    asks = df.select(*keys, "time").distinct()
    g = step_values(kaplan_meier(cohort, keys, "censoring", rows), asks, keys, rows)
    on = [*keys, "time"]
    return df.join(_renamed(g, on, "_g_"), _match(on, "_g_")).withColumnRenamed("value", "g").drop(*[f"_g_{k}" for k in on])


def ipcw_concordance(df: DataFrame, cohort: DataFrame, keys: list[str], rows: int | None = None) -> DataFrame:
    """Concordance weighted by the inverse squared censoring survival at each event."""
    weighed = with_censoring(df, cohort, keys, rows)
    w = F.when(F.col("event").cast("boolean") & (F.col("g") > 0), 1.0 / F.pow("g", 2)).otherwise(0.0)
    return concordance(weighed.withColumn("w", w), keys, "w", rows)


def baseline_hazard(df: DataFrame, keys: list[str], rows: int | None = None, limit: int = HOT_ROWS) -> DataFrame:
    """Cumulative baseline hazard at event times: events over the summed exp(risk) still at risk."""
    e = F.col("event").cast("boolean")
    counts = df.groupBy(*keys, "time").agg(
        F.count_if(e).alias("d"), F.sum(F.exp("risk")).alias("_x")
    ).withColumn("back", -F.col("time"))
    pool = ordered_columns(counts, keys, ["back"], {"pool": ("sum", "_x")}, rows, limit)
    steps = pool.where("d > 0").withColumn("h", F.col("d") / F.col("pool"))
    return ordered_columns(steps, keys, ["time"], {"hazard": ("sum", "h")}, rows, limit).select(*keys, "time", "hazard")


def hazard_at(hazard: DataFrame, asks: DataFrame, keys: list[str], rows: int | None = None, limit: int = HOT_ROWS) -> DataFrame:
    """Hazard at asked times: 0 before the first event, linear between events, flat after the last."""
    line = hazard.select(*keys, "time", F.lit(0).alias("ask"), F.col("time").alias("t"), F.col("hazard").alias("h"))
    none = F.lit(None).cast("double")
    want = asks.select(*keys, "time", F.lit(1).alias("ask"), none.alias("t"), none.alias("h"))
    both = line.unionByName(want).withColumns({"_ft": -F.col("time"), "_fa": F.col("ask")})
    up = ordered_columns(both, keys, ["time", "ask"], {"t0": ("max", "t"), "h0": ("max", "h")}, rows, limit)
    down = ordered_columns(up, keys, ["_ft", "_fa"], {"t1": ("min", "t"), "h1": ("min", "h")}, rows, limit)
    share = (F.col("time") - F.col("t0")) / (F.col("t1") - F.col("t0"))
    value = (
        F.when(F.col("h0").isNull(), 0.0).when(F.col("h1").isNull() | (F.col("t0") == F.col("time")), F.col("h0"))
        .otherwise(F.col("h0") + (F.col("h1") - F.col("h0")) * share)
    )
    return down.where("ask = 1").select(*keys, "time", value.alias("value"))


# ---- Brier and AUC ----------------------------------------------------------
def grid_table(df: DataFrame, cohort: DataFrame, keys: list[str], grid: list[float], rows: int | None = None) -> DataFrame:
    """Per group one short array of (t, censoring survival, baseline hazard) over the fixed grid."""
    asks = df.select(*keys).distinct().select(*keys, F.explode(F.array(*[F.lit(float(t)) for t in grid])).alias("time"))
    g = step_values(kaplan_meier(cohort, keys, "censoring", rows), asks, keys, rows)
    h = hazard_at(baseline_hazard(cohort, keys, rows), asks, keys, rows)
    on = [*keys, "time"]
    both = g.withColumnRenamed("value", "g").join(_renamed(h.withColumnRenamed("value", "h"), on, "_h_"), _match(on, "_h_"))
    return both.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("time").alias("t"), "g", "h"))).alias("grid"))


def brier(df: DataFrame, cohort: DataFrame, keys: list[str], grid: list[float], rows: int | None = None) -> DataFrame:
    """Weighted squared error of the survival estimate at every grid time.

    A row meets its group's grid as one array and is exploded only into partial
    sums.
    """
    tables = _renamed(grid_table(df, cohort, keys, grid, rows), keys, "_t_")
    rows_g = with_censoring(df, cohort, keys, rows).join(tables, _match(keys, "_t_"))
    each = rows_g.select(*keys, "time", F.col("event").cast("boolean").alias("event"), "risk", "g", F.explode("grid").alias("p"))
    s = F.exp(-F.col("p.h") * F.exp("risk"))
    case = (F.col("time") <= F.col("p.t")) & F.col("event")
    inverse = lambda g: F.when(g > 0, 1.0 / g).otherwise(0.0)
    error = F.when(case, s * s * inverse(F.col("g"))).when(
        F.col("time") > F.col("p.t"), (1.0 - s) * (1.0 - s) * inverse(F.col("p.g"))
    ).otherwise(0.0)
    return each.groupBy(*keys, F.col("p.t").alias("t")).agg(F.avg(error).alias("brier"), F.count(F.lit(1)).alias("n"))


def integrated_brier(scores: DataFrame, df: DataFrame, keys: list[str], grid: list[float]) -> DataFrame:
    """Trapezoid mean of the Brier scores; null unless the group's times cover the grid."""
    ends = df.groupBy(*keys).agg(F.min("time").alias("lo"), F.max("time").alias("hi"))
    ordered = ordered_columns(scores, keys, ["t"], {"t0": ("lag", "t"), "b0": ("lag", "brier")}, rows=0)
    area = F.sum((F.col("brier") + F.col("b0")) * (F.col("t") - F.col("t0")) / 2.0)
    total = ordered.groupBy(*keys).agg((area / (max(grid) - min(grid))).alias("ibs"))
    joined = ends.join(_renamed(total, keys, "_i_"), _match(keys, "_i_"))
    covered = (F.col("lo") <= min(grid)) & (F.col("hi") >= max(grid))
    return joined.select(*keys, F.when(covered, F.col("ibs")).alias("ibs"))


def landmark_auc(
    df: DataFrame, cohort: DataFrame, keys: list[str], landmarks: dict[float, int], rows: int | None = None, limit: int = HOT_ROWS
) -> DataFrame:
    """Time-dependent AUC at each landmark, where follow-up covers it and enough events came before.

    ``landmarks`` maps a time to its least number of events.
    """
    g = with_censoring(df, cohort, keys, rows)
    e = F.col("event").cast("boolean")
    marks = F.explode(F.array(*[F.lit(float(t)) for t in landmarks])).alias("landmark")
    each = g.select(*keys, "time", e.alias("event"), "risk", "g", marks)
    case, control = F.col("event") & (F.col("time") <= F.col("landmark")), F.col("time") > F.col("landmark")
    w = F.when(case & (F.col("g") > 0), 1.0 / F.col("g")).otherwise(0.0)
    at = each.groupBy(*keys, "landmark", "risk").agg(
        F.count_if(control).alias("controls"), F.sum(w).alias("cases"), F.count_if(case).alias("n_cases"),
        F.min("time").alias("lo"), F.max("time").alias("hi"),
    )
    run = ordered_columns(at, [*keys, "landmark"], ["risk"], {"below": ("sum", "controls")},
                          None if rows is None else rows * len(landmarks), limit)
    won = F.sum(F.col("cases") * (F.col("below") - F.col("controls") / 2.0))
    agg = run.groupBy(*keys, "landmark").agg(
        won.alias("won"), F.sum("cases").alias("w"), F.sum("controls").alias("n"), F.sum("n_cases").alias("events"),
        F.min("lo").alias("lo"), F.max("hi").alias("hi"),
    )
    need = F.lit(5)
    for t, k in landmarks.items():
        need = F.when(F.col("landmark") == float(t), k).otherwise(need)
    usable = (F.col("lo") <= F.col("landmark")) & (F.col("landmark") <= F.col("hi")) & (F.col("events") >= need)
    auc = F.when(usable & (F.col("w") * F.col("n") > 0), F.col("won") / (F.col("w") * F.col("n")))
    return agg.select(*keys, "landmark", F.col("events").alias("n_events"), auc.alias("auc"))


def fold_metrics(
    df: DataFrame, cohort: DataFrame, keys: list[str], grid: list[float], landmarks: dict[float, int],
    recorded: DataFrame | None = None, rows: int | None = None, tolerance: float = 1e-6,
) -> DataFrame:
    """One row per fold: c, weighted c, integrated Brier, mean AUC, and the check against a recorded c."""
    c = concordance(df, keys, rows=rows).select(*keys, "c_index")
    w = ipcw_concordance(df, cohort, keys, rows).select(*keys, F.col("c_index").alias("c_index_ipcw"))
    b = integrated_brier(brier(df, cohort, keys, grid, rows), df, keys, grid)
    a = landmark_auc(df, cohort, keys, landmarks, rows).groupBy(*keys).agg(F.avg("auc").alias("mean_auc"))
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event").cast("boolean")).alias("n_events"))
    out = n
    for part in (c, w, b, a):
        out = out.join(part, keys)
    if recorded is not None:
        out = out.join(recorded.select(*keys, "recorded"), keys, "left")
        diff = F.abs(F.col("c_index") - F.col("recorded"))
        out = out.withColumns({"abs_diff": diff, "check_ok": diff <= tolerance})
    return out


def better_reconstruction(first: Column, other: Column, target: Column, tolerance: float = 1e-6) -> Column:
    """(value, adopted): the other reconstruction only when the first disagrees and the other is strictly closer."""
    off, alt = F.abs(first - target), F.abs(other - target)
    adopt = target.isNotNull() & (off > tolerance) & (alt < off)
    return F.struct(F.when(adopt, other).otherwise(first).alias("value"), F.coalesce(adopt, F.lit(False)).alias("adopted"))
