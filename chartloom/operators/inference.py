"""Paired tests, intervals and rank correlations over score tables."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scale import HOT_ROWS, ordered_columns, value_ranks
from .survival import _match, _renamed

#: groups up to these sizes get the exact distribution: without ties and zeros, and with them
EXACT_PAIRS, EXACT_TIED = 50, 13
#: rows of a group whose draws are summed in one place
DRAWN_ROWS = 1_000


@F.pandas_udf(T.DoubleType())
def _upper_tail(z: pd.Series) -> pd.Series:
    """Upper tail of the standard normal."""
    return z.map(lambda v: None if v is None or math.isnan(v) else 0.5 * math.erfc(v / math.sqrt(2.0)))


def exact_tail(ranks: Column, at_least: Column) -> Column:
    """Share of sign assignments whose positive rank sum reaches ``at_least``; ranks come doubled, as whole numbers."""
    top = F.aggregate(ranks, F.lit(0), lambda a, r: a + r)
    cells = F.sequence(F.lit(0), top)
    start = F.transform(cells, lambda i: F.when(i == 0, 1.0).otherwise(0.0))

    def add(acc: Column, r: Column) -> Column:
        return F.transform(acc, lambda x, i: x + F.when(i >= r, F.get(acc, i - r)).otherwise(0.0))

    ways = F.aggregate(ranks, start, add)
    hit = F.aggregate(F.filter(F.transform(ways, lambda x, i: F.when(i >= at_least, x)), lambda x: x.isNotNull()), F.lit(0.0), lambda a, x: a + x)
    return hit / F.pow(F.lit(2.0), F.size(ranks))


def signed_rank(
    df: DataFrame, keys: list[str], diff: str, rows: int | None = None, limit: int = HOT_ROWS,
    exact_pairs: int = EXACT_PAIRS, exact_tied: int = EXACT_TIED,
) -> DataFrame:
    """Paired signed-rank test per group: statistic, one-sided (greater) and two-sided p.

    Zero differences leave; when all are zero p is 1.  Groups of up to
    ``exact_pairs`` differences without ties and zeros, and of up to
    ``exact_tied`` with them, use the exact distribution, others the normal
    approximation with tie correction (0 for both: always the approximation).
    Only the ranks of such a group are ever listed.
    """
    d = F.col(diff)
    total = df.groupBy(*keys).agg(F.count(d).alias("n_all"))
    nonzero = df.where(d.isNotNull() & (d != 0)).select(*keys, F.abs(d).alias("size"), (d > 0).cast("int").alias("up"))
    ranks = value_ranks(nonzero, keys, "size", rows, limit)
    ups = nonzero.groupBy(*keys, "size").agg(F.sum("up").alias("ups"))
    on = [*keys, "size"]
    both = ranks.join(_renamed(ups, on, "_u_"), _match(on, "_u_"))
    n = F.col("n").cast("double")
    agg = both.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum(F.col("avg_rank") * F.col("ups")).alias("plus"),
        F.sum(F.col("avg_rank") * (F.col("n") - F.col("ups"))).alias("minus"),
        F.sum(n * n * n - n).alias("ties"),
    )
    small = agg.where(F.col("n") <= max(exact_pairs, exact_tied)).select(*[F.col(k).alias(f"_s_{k}") for k in keys])
    listed = (
        both.join(small, _match(keys, "_s_"), "left_semi").groupBy(*keys)
        .agg(F.flatten(F.collect_list(F.array_repeat((F.col("avg_rank") * 2).cast("int"), F.col("n").cast("int")))).alias("ranks"))
    )
    out = total.join(_renamed(agg, keys, "_a_"), _match(keys, "_a_"), "left").drop(*[f"_a_{k}" for k in keys])
    out = out.join(_renamed(listed, keys, "_l_"), _match(keys, "_l_"), "left").drop(*[f"_l_{k}" for k in keys])
    plain = (F.col("ties") == 0) & (F.col("n") == F.col("n_all")) & (F.col("n") <= exact_pairs)
    exact = F.col("ranks").isNotNull() & (plain | (F.col("n") <= exact_tied))
    mean = F.col("n") * (F.col("n") + 1) / 4.0
    spread = F.sqrt((F.col("n") * (F.col("n") + 1) * (2 * F.col("n") + 1) - F.col("ties") / 2.0) / 24.0)
    high = F.greatest("plus", "minus")
    exact_greater = exact_tail(F.col("ranks"), (F.col("plus") * 2).cast("int"))
    exact_two = F.least(F.lit(1.0), 2.0 * exact_tail(F.col("ranks"), (high * 2).cast("int")))
    out = out.withColumns({"_zg": (F.col("plus") - mean) / spread, "_zt": (high - mean) / spread})
    out = out.withColumns({"_ng": _upper_tail("_zg"), "_nt": _upper_tail("_zt")})
    return out.select(
        *keys, F.coalesce("n", F.lit(0)).alias("n_nonzero"),
        F.least("plus", "minus").alias("statistic"),
        F.when(F.col("n").isNull(), 1.0).when(exact, exact_greater).otherwise(F.col("_ng")).alias("p_greater"),
        F.when(F.col("n").isNull(), 1.0).when(exact, exact_two).otherwise(F.least(F.lit(1.0), 2.0 * F.col("_nt"))).alias("p_two_sided"),
    )


# 0.975 quantiles of Student's t for 1 to 30 degrees of freedom.
T_975 = (
    12.706204736, 4.302652730, 3.182446305, 2.776445105, 2.570581836, 2.446911851, 2.364624252, 2.306004135,
    2.262157163, 2.228138852, 2.200985160, 2.178812830, 2.160368656, 2.144786688, 2.131449546, 2.119905299,
    2.109815578, 2.100922040, 2.093024054, 2.085963447, 2.079613845, 2.073873068, 2.068657610, 2.063898562,
    2.059538553, 2.055529439, 2.051830516, 2.048407142, 2.045229642, 2.042272456,
)
_Z = 1.959963984540054


def t_quantile(df: Column) -> Column:
    """0.975 quantile of Student's t; beyond the table by its expansion around the normal."""
    z3, z5 = _Z**3, _Z**5
    tail = _Z + (z3 + _Z) / (4.0 * df) + (5 * z5 + 16 * z3 + 3 * _Z) / (96.0 * df * df)
    return F.when(df <= len(T_975), F.get(F.array(*[F.lit(x) for x in T_975]), df.cast("int") - 1)).otherwise(tail)


def paired_interval(df: DataFrame, keys: list[str], diff: str) -> DataFrame:
    """Mean difference with its 95 % t interval."""
    agg = df.groupBy(*keys).agg(F.avg(diff).alias("delta"), F.stddev_samp(diff).alias("sd"), F.count(diff).alias("n"))
    half = t_quantile(F.col("n") - 1) * F.col("sd") / F.sqrt("n")
    return agg.select(*keys, "n", "delta", "sd", (F.col("delta") - half).alias("ci_lo"), (F.col("delta") + half).alias("ci_hi"))


def draws_of_block(name: str, n: int, block: int, at: int, replicates: int, seed: int = 0) -> np.ndarray:
    """How many of a replicate's ``n`` draws fall on rows of block number ``at`` of a group, for every replicate.

    Rows are halved block-wise down to the block; each halving splits the draws
    binomially by a generator named after it, so all blocks of a group agree
    on every split and their draws add up to ``n``.
    """
    low, high = 0, -(-n // block)
    counts = np.full(replicates, n, dtype=np.int64)
    while high - low > 1:
        middle = (low + high) // 2
        before, rows = (middle - low) * block, min(high * block, n) - low * block
        mark = hashlib.sha256(f"{seed}|{name}|{low}|{high}".encode()).digest()
        left = np.random.default_rng(int.from_bytes(mark[:16], "little")).binomial(counts, before / rows)
        counts, low, high = (left, low, middle) if at < middle else (counts - left, middle, high)
    return counts


def bootstrap_mean(
    df: DataFrame, keys: list[str], value: str, order: list[str], replicates: int = 10_000, seed: int = 0, rows: int | None = None,
    block: int = DRAWN_ROWS,
) -> DataFrame:
    """95 % percentile interval of resampled means per group, repeatable for a seed.

    A group of n rows, numbered by ``order``, has n draws a replicate.  Rows go
    once into blocks of ``block`` with their numbers; a block knows how many
    draws of each replicate are its own and returns one sum a replicate, so
    neither draws nor rows times replicates are shuffled.  Draw i of replicate r
    picks the row of its block that md5 of (seed, keys, r, i, and the block
    beyond the first) names: the result depends on nothing but the data and the
    seed.  Null values leave, and so do groups without any other.
    """
    own = df.where(F.col(value).isNotNull()).select(*keys, *[c for c in order if c not in keys], F.col(value).cast("double").alias("_v"))
    numbered = ordered_columns(own, keys, order, {"_r": ("row",)}, rows).select(
        *keys, "_r", "_v", F.floor((F.col("_r") - 1) / F.lit(block)).cast("long").alias("_at")
    )
    sizes = numbered.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    held = numbered.groupBy(*keys, "_at").agg(F.array_sort(F.collect_list(F.struct("_r", "_v")))["_v"].alias("_vs"))
    own_name = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    blocks = held.join(_renamed(sizes, keys, "_n_"), _match(keys, "_n_")).select(*keys, "n", "_at", "_vs", own_name.alias("_name"))

    @F.pandas_udf("array<long>")
    def own_draws(name: pd.Series, n: pd.Series, at: pd.Series) -> pd.Series:
        return pd.Series([draws_of_block(k, int(m), block, int(i), replicates, seed) for k, m, i in zip(name, n, at)])

    def pick(rep: Column, i: Column) -> Column:
        name = F.concat_ws(
            "|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys], rep.cast("string"), i.cast("string"),
            F.when(F.col("_at") > 0, F.col("_at").cast("string")),
        )
        return (F.conv(F.substring(F.md5(name), 1, 12), 16, 10).cast("long") % F.size("_vs")).cast("int")

    def total(draws: Column, rep: Column) -> Column:
        drawn = F.sequence(F.lit(1).cast("long"), draws)
        return F.when(draws > 0, F.aggregate(drawn, F.lit(0.0), lambda acc, i: acc + F.get("_vs", pick(rep, i)))).otherwise(0.0)

    counted = blocks.withColumn("_draws", own_draws("_name", "n", "_at"))
    summed = counted.select(*keys, "n", F.posexplode(F.transform("_draws", lambda d, i: total(d, i + 1))).alias("rep", "s"))
    means = summed.groupBy(*keys, "n", "rep").agg((F.sum("s") / F.col("n")).alias("m"))
    # one value per replicate: at most ``replicates`` per group
    return means.groupBy(*keys, "n").agg(F.percentile("m", F.lit(0.025)).alias("ci_lo"), F.percentile("m", F.lit(0.975)).alias("ci_hi"))


def spearman(df: DataFrame, keys: list[str], a: str, b: str, rows: int | None = None, least: int = 2) -> DataFrame:
    """Rank correlation of two columns per group with ties sharing ranks.

    Equal pairs are counted before ranks are joined to them, so a value shared
    by many rows is joined once.
    """
    pairs = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*keys, a, b).agg(F.count(F.lit(1)).alias("w"))
    rows_all = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    ra = value_ranks(rows_all, keys, a, rows).select(*keys, a, F.col("avg_rank").alias("ra"))
    rb = value_ranks(rows_all, keys, b, rows).select(*keys, b, F.col("avg_rank").alias("rb"))
    j = pairs.join(_renamed(ra, [*keys, a], "_a_"), _match([*keys, a], "_a_")).join(
        _renamed(rb, [*keys, b], "_b_"), _match([*keys, b], "_b_")
    )
    w, x, y = F.col("w").cast("double"), F.col("ra"), F.col("rb")
    agg = j.groupBy(*keys).agg(
        F.sum("w").alias("n"), F.sum(w * x).alias("sx"), F.sum(w * y).alias("sy"),
        F.sum(w * x * y).alias("sxy"), F.sum(w * x * x).alias("sxx"), F.sum(w * y * y).alias("syy"),
    )
    n = F.col("n")
    # both rank columns have mean (n + 1) / 2
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / n
    vx, vy = F.col("sxx") - F.col("sx") ** 2 / n, F.col("syy") - F.col("sy") ** 2 / n
    rho = F.when((vx > 0) & (vy > 0), cov / F.sqrt(vx * vy))
    return agg.where(n >= least).select(*keys, "n", rho.alias("rho"))


def ks_distance(df: DataFrame, keys: list[str], value: str, group: str, rows: int | None = None, limit: int = HOT_ROWS) -> DataFrame:
    """Largest distance between the distribution functions of the two sides of a boolean column."""
    g = F.col(group).cast("boolean")
    at = df.where(F.col(value).isNotNull() & g.isNotNull()).groupBy(*keys, value).agg(
        F.count_if(g).alias("a"), F.count_if(~g).alias("b")
    )
    run = ordered_columns(at, keys, [value], {"ca": ("sum", "a"), "cb": ("sum", "b")}, rows, limit)
    sizes = at.groupBy(*keys).agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    j = run.join(_renamed(sizes, keys, "_n_"), _match(keys, "_n_")) if keys else run.join(F.broadcast(sizes))
    gap = F.abs(F.try_divide("ca", "na") - F.try_divide("cb", "nb"))
    return j.groupBy(*keys).agg(F.max("na").alias("n_true"), F.max("nb").alias("n_false"), F.max(gap).alias("distance"))
