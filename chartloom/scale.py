"""Ordered work inside groups of any size.

Spark runs a window partition in one task.  That is fine while a group fits a
task, and wrong when one key holds a third of the table.  The helpers here keep
the plain window for ordinary groups and cut only oversized groups into ranges
of the ordering, adding what earlier ranges carry into later ones.

Callers that know an upper bound for the rows of their input (a table's row
count) pass it as ``rows``; at or below ``HOT_ROWS`` no group can be oversized
and nothing is measured.
"""

from __future__ import annotations

import math
import re
import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HOT_ROWS = 4_000_000
# ranges that a limit below HOT_ROWS may cut a table into, and the limit from which oversized keys are few enough to broadcast
FINE_RANGES, FEW_KEYS = 64, 10_000


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints; a temporary one only where driver and tasks are one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="chartloom-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def _tables(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/tables-{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession) -> str:
    """A folder of this application's tables that nothing has used."""
    return f"{_tables(spark)}/{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows written once to the shared folder and read back; lineage ends here."""
    spark = df.sparkSession
    path = new_folder(spark)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_STORED: dict[tuple[str, str, str], str] = {}


def _state(spark: SparkSession, source: str) -> str:
    """Names, sizes and times of the files under a folder, as one text."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(source)
    found, out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(path, True), []
    while found.hasNext():
        f = found.next()
        out.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return "\n".join(sorted(out))


def stored(spark: SparkSession, source: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A derived table written once per application and state of its source, and read back as parquet.

    Later readers get column pruning and pushed filters instead of the plan
    that built the table.
    """
    key = (spark.sparkContext.applicationId, _state(spark, source), name)
    if key not in _STORED:
        path = f"{_tables(spark)}/{uuid.uuid4().hex}/{name}"
        build().write.mode("errorifexists").parquet(path)
        _STORED[key] = path
    return spark.read.parquet(_STORED[key])


def drop_tables(spark: SparkSession) -> None:
    """Delete what this application wrote to the shared folder; call it when the results are written."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_tables(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    for key in [k for k in _STORED if k[0] == spark.sparkContext.applicationId]:
        del _STORED[key]


def same_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def hot_keys(df: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """Keys with more than ``limit`` rows: at most rows/limit of them."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit)


def _ranges(total: int, limit: int) -> int:
    """How many ranges oversized groups of ``total`` rows are cut into: none is oversized, and a small limit makes no swarm of them."""
    return max(2, min(math.ceil(4 * total / limit), max(FINE_RANGES, math.ceil(4 * total / HOT_ROWS))))


def _few(df: DataFrame, limit: int) -> DataFrame:
    """One row for each oversized key: at most rows/limit, which is small unless the limit is."""
    return F.broadcast(df) if limit >= FEW_KEYS else df


def _split(
    df: DataFrame, keys: list[str], order: list[str], rows: int | None, limit: int, measured: DataFrame | None = None, ties: bool = False,
):
    """(ordinary part, oversized part cut into ranges) — the second is None when no key is oversized.

    Group sizes are counted in ``measured`` where given: rows with the same keys
    that are cheaper to read than ``df``.  ``ties`` lets ranges cut through rows
    of one place in the order.
    """
    if rows is not None and rows <= limit:
        return df, None
    if not keys:
        total = df.count()
        if total <= limit:
            return df, None
        cut = df.repartitionByRange(_ranges(total, limit), *order).withColumn("_range", F.spark_partition_id())
        return None, checkpointed(cut)
    hot = checkpointed(hot_keys(df if measured is None else measured, keys, limit))
    total = hot.agg(F.sum("_n")).first()[0]
    if not total:
        return df, None
    small = _few(hot.select(*[F.col(k).alias(f"_hot_{k}") for k in keys]), limit)
    match = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_hot_{k}")) for k in keys])
    ordinary = df.join(small, match, "left_anti")
    parts = _ranges(total, limit)
    cut = df.join(small, match, "left_semi")
    if ties:
        cut = cut.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(parts, *keys, *order, "_tie").drop("_tie")
    else:
        cut = cut.repartitionByRange(parts, *keys, *order)
    return ordinary, checkpointed(cut.withColumn("_range", F.spark_partition_id()))


_FOLD = {"sum": F.sum, "max": F.max, "min": F.min}


def ordered_columns(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    columns: dict[str, tuple],
    rows: int | None = None,
    limit: int = HOT_ROWS,
    measured: DataFrame | None = None,
    ties: bool = False,
) -> DataFrame:
    """Add ordered columns per group; ascending ``order`` should be unique inside a group.

    ``columns`` maps a new name to ``("row",)``, ``("sum"|"max"|"min", source)``
    for running values that include the current row, or ``("lag", source)``.
    ``measured`` and ``ties`` are those of ``_split``; with ``ties`` a running
    value may leave out later rows of the same place.
    """
    ordinary, cut = _split(df, keys, order, rows, limit, measured, ties)
    parts = []
    if ordinary is not None:
        w = Window.partitionBy(*keys).orderBy(*order)
        run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        out = {}
        for name, spec in columns.items():
            if spec[0] == "row":
                out[name] = F.row_number().over(w).cast("long")
            elif spec[0] == "lag":
                out[name] = F.lag(spec[1]).over(w)
            else:
                out[name] = _FOLD[spec[0]](spec[1]).over(run)
        parts.append(ordinary.withColumns(out))
    if cut is not None:
        parts.append(_ranged_columns(cut, keys, order, columns, limit))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _ranged_columns(cut: DataFrame, keys, order, columns, limit: int) -> DataFrame:
    span = keys + ["_range"]
    totals = {}
    for name, spec in columns.items():
        if spec[0] == "row":
            totals[f"_t_{name}"] = F.count(F.lit(1))
        elif spec[0] == "lag":
            totals[f"_t_{name}"] = F.max_by(F.struct(F.col(spec[1]).alias("v")), F.struct(*order))
        else:
            totals[f"_t_{name}"] = _FOLD[spec[0]](spec[1])
    summary = cut.groupBy(*span).agg(*[c.alias(n) for n, c in totals.items()])
    across = Window.partitionBy(*keys).orderBy("_range")
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    carried = {}
    for name, spec in columns.items():
        total = F.col(f"_t_{name}")
        if spec[0] == "lag":
            carried[f"_c_{name}"] = F.lag(total).over(across)
        elif spec[0] == "row":
            carried[f"_c_{name}"] = F.sum(total).over(before)
        else:
            carried[f"_c_{name}"] = _FOLD[spec[0]](total).over(before)
    # one row per range and oversized key: a few times rows/limit
    summary = summary.withColumns(carried).select(
        *[F.col(k).alias(f"_s_{k}") for k in span], *carried
    )
    match = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_s_{k}")) for k in span])
    joined = cut.join(_few(summary, limit), match, "left")
    w = Window.partitionBy(*span).orderBy(*order)
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = {}
    for name, spec in columns.items():
        carry = F.col(f"_c_{name}")
        if spec[0] == "row":
            out[name] = F.row_number().over(w).cast("long") + F.coalesce(carry, F.lit(0))
        elif spec[0] == "lag":
            out[name] = F.when(F.row_number().over(w) == 1, carry["v"]).otherwise(F.lag(spec[1]).over(w))
        elif spec[0] == "sum":
            local = F.sum(spec[1]).over(run)
            out[name] = F.when(carry.isNull(), local).otherwise(carry + F.coalesce(local, F.lit(0)))
        elif spec[0] == "max":
            out[name] = F.greatest(F.max(spec[1]).over(run), carry)
        else:
            out[name] = F.least(F.min(spec[1]).over(run), carry)
    drop = [f"_s_{k}" for k in span] + [f"_c_{n}" for n in columns] + ["_range"]
    return joined.withColumns(out).drop(*drop)


def next_at_or_after(
    asks: DataFrame, events: DataFrame, keys: list[str], ask: str, at: str, name: str, rows: int | None = None, limit: int = HOT_ROWS,
    measured: DataFrame | None = None,
) -> DataFrame:
    """The rows of ``asks`` with ``name``: the smallest ``at`` of the events of the same keys at or after ``ask``.

    Asks and events are merged and walked from the latest down with a running
    minimum, so no row holds the events of its group.  Null, NaN and minus
    infinity ask for nothing; events that are null or NaN answer nothing.
    ``measured`` has a row with the keys of every ask, if that is cheaper to read.
    """
    sizes = None if measured is None else measured.select(*keys).unionByName(events.select(*keys))
    value = F.col(at).cast("double")
    known = events.where(value.isNotNull() & ~F.isnan(value)).select(*keys, value.alias("_event")).distinct()
    day = F.col(ask).cast("double")
    open_ = day.isNull() | F.isnan(day) | (day == float("-inf"))
    merged = known.withColumns({"_down": -F.col("_event"), "_asks": F.lit(0)}).unionByName(
        asks.withColumns({"_down": F.when(~open_, -day), "_asks": F.lit(1)}), allowMissingColumns=True
    )
    # events come before the asks of their place, so asks of one place may be cut apart
    walked = ordered_columns(merged, keys, ["_down", "_asks"], {name: ("min", "_event")}, rows, limit, sizes, ties=True)
    return walked.where("_asks = 1").select(*asks.columns, name)


def value_ranks(
    df: DataFrame, keys: list[str], value: str, rows: int | None = None, limit: int = HOT_ROWS
) -> DataFrame:
    """One row per (keys, value): ``n`` copies, ``upto`` rows at or below, ``avg_rank`` with ties shared."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    out = ordered_columns(counts, keys, [value], {"upto": ("sum", "n")}, rows, limit)
    return out.withColumn("avg_rank", F.col("upto") - F.col("n") + (F.col("n") + 1) / F.lit(2.0))


def exact_quantiles(
    df: DataFrame,
    keys: list[str],
    value: str,
    probs: dict[str, float],
    rows: int | None = None,
    limit: int = HOT_ROWS,
) -> DataFrame:
    """Linear-interpolated quantiles per group, exact for groups of any size."""
    if rows is not None and rows <= limit:
        # NaN sorts above every number on both paths
        return df.groupBy(*keys).agg(
            *[F.percentile(F.col(value), F.lit(p)).alias(name) for name, p in probs.items()]
        )
    # counted once: sizes, sums and quantiles of ordinary groups then come out of one sort by the keys
    counts = checkpointed(df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n")))
    ordinary, cut = _split(counts, keys, [value], None, limit)
    parts = []
    if ordinary is not None:
        whole = Window.partitionBy(*keys)
        run = whole.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        parts.append(ordinary.withColumns({"upto": F.sum("n").over(run), "_size": F.sum("n").over(whole)}))
    if cut is not None:
        ranks = _ranged_columns(cut, keys, [value], {"upto": ("sum", "n")}, limit)
        # one row per oversized group
        sizes = cut.groupBy(*[F.col(k).alias(f"_q_{k}") for k in keys]).agg(F.sum("n").alias("_size"))
        match = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_q_{k}")) for k in keys], F.lit(True))
        parts.append(ranks.join(_few(sizes, limit), match).drop(*[f"_q_{k}" for k in keys]))
    aggs = []
    for name, p in probs.items():
        h = (F.col("_size") - 1) * F.lit(float(p))
        aggs.append(F.min(F.when(F.col("upto") > F.floor(h), F.col(value))).alias(f"_lo_{name}"))
        aggs.append(F.min(F.when(F.col("upto") > F.ceil(h), F.col(value))).alias(f"_hi_{name}"))
    final = []
    for name, p in probs.items():
        h = (F.col("_size") - 1) * F.lit(float(p))
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        final.append((lo + (hi - lo) * (h - F.floor(h))).alias(name))
    done = [part.groupBy(*keys).agg(F.first("_size").alias("_size"), *aggs).select(*keys, *final) for part in parts]
    return reduce(DataFrame.unionByName, done)
