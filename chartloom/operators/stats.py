"""Field statistics: completeness, information and type per (dataset, field)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.missing import stripped, value_state
from ..functions.numbers import double_text, number_label, to_number
from ..functions.text import stage_token
from ..scale import checkpointed
from .families import PREFIXES, Families

FIELD = ["dataset", "field_path"]


def with_state(values: DataFrame) -> DataFrame:
    """Add the three-state ``state`` to a long value table."""
    return values.withColumn("state", value_state(F.col("value"), F.col("kind")))


def value_text(value: Column, number: Column) -> Column:
    """Text of a raw value; numbers are formatted only where a text is needed."""
    return F.coalesce(value, number_label(number))


_FIXED = 10_000


def patient_values(values: DataFrame) -> DataFrame:
    """One row per (dataset, field, patient): counts of raw states and the collapsed value.

    A first grouping by distinct value keeps repeats from ever being collected;
    only the distinct values of one patient's field meet in a list, which is
    also what the collapsed text of a non-numeric field spells out.  Means are taken
    over fixed-point sums where the values allow it, so they do not depend on
    the order rows arrive in.
    """
    states = with_state(values)
    valid = F.col("state") == "valid"
    distinct = (
        states.withColumn("_t", F.when(valid & F.col("number").isNull(), stripped(F.col("value"))))
        .withColumn("_x", F.when(valid, F.coalesce("number", to_number(F.col("_t")))))
        .groupBy(*FIELD, "patient_id", "_t", "_x")
        .agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("state") == "sentinel").alias("_s"))
    )
    x, n = F.col("_x"), F.col("_n")
    seen = x.isNotNull() | F.col("_t").isNotNull()
    scaled = F.round(x * _FIXED)
    fits = (F.abs(x) < 1e9) & (F.abs(x * _FIXED - scaled) < 1e-4)
    per = distinct.groupBy("patient_id", "field_path", "dataset").agg(
        F.sum(n).alias("n_raw"),
        F.sum(F.when(seen, n).otherwise(0)).alias("n_valid"),
        F.sum("_s").alias("n_sentinel"),
        F.count_if(seen & x.isNull()).alias("_words"),
        F.count_if(x.isNotNull() & ~fits).alias("_loose"),
        F.sum(x * n).alias("_sum"),
        F.sum(F.when(fits, scaled.cast("long") * n)).alias("_fixed"),
        F.collect_list(F.when(seen, F.coalesce("_t", number_label(x)))).alias("_texts"),
    )
    total = F.when(F.col("_loose") == 0, F.col("_fixed") / F.lit(float(_FIXED))).otherwise(F.col("_sum"))
    mean = F.when((F.col("n_valid") > 0) & (F.col("_words") == 0), total / F.col("n_valid"))
    joined = F.array_join(F.array_sort(F.array_distinct("_texts")), " | ")
    return per.select(
        *FIELD, "patient_id", "n_raw", "n_valid", "n_sentinel",
        mean.alias("number"),
        F.when(F.col("n_valid") == 0, None).when(mean.isNotNull(), double_text(mean)).otherwise(joined).alias("collapsed"),
    )


def category_counts(per_patient: DataFrame, order: str = "patient_id") -> DataFrame:
    """Patients per (dataset, field, collapsed value), all a field statistic needs.

    Patients without a valid value sit in the row whose ``collapsed`` is null.
    ``first_at`` breaks mode ties by case order.
    """
    return per_patient.groupBy(*FIELD, "collapsed").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(order).alias("first_at"),
        F.max("number").alias("number"),
        F.count_if(F.col("n_raw") > 1).alias("n_many_raw"),
        F.count_if(F.col("n_valid") > 1).alias("n_many_valid"),
        F.count_if((F.col("n_valid") == 0) & (F.col("n_sentinel") > 0)).alias("n_sentinel"),
    )


def completeness(counts: DataFrame, landmark: bool = False) -> DataFrame:
    """Patient counts per (dataset, field); ``landmark`` counts repeated valid values instead of raw ones."""
    return counts.groupBy(*FIELD).agg(
        F.sum(F.when(F.col("collapsed").isNotNull(), F.col("n")).otherwise(0)).alias("valid"),
        F.sum("n_sentinel").alias("sentinel_count"),
        F.sum("n_many_valid" if landmark else "n_many_raw").alias("_multi"),
    )


def information(counts: DataFrame) -> DataFrame:
    """Entropy (base 2), normalised entropy, distinct count, mode and mode share."""
    n = F.col("n").cast("double")
    number = F.coalesce("number", to_number(F.col("collapsed")))
    agg = (
        counts.where(F.col("collapsed").isNotNull())
        .groupBy(*FIELD)
        .agg(
            F.sum("n").alias("n_values"),
            F.count(F.lit(1)).alias("unique_count"),
            F.sum(n * F.log2(n)).alias("_nlogn"),
            F.max_by("collapsed", F.struct(F.col("n"), (-F.col("first_at")).alias("f"))).alias("mode_value"),
            F.max("n").alias("_top"),
            F.count_if(number.isNull()).alias("n_text"),
            F.sum(F.when(number.isNotNull(), F.col("n")).otherwise(0)).alias("_numeric"),
            F.sum(number * n).alias("_total"),
        )
    )
    total = F.col("n_values").cast("double")
    entropy = F.greatest(F.log2(total) - F.col("_nlogn") / total, F.lit(0.0))
    return agg.select(
        *FIELD, "n_values", "unique_count", "mode_value", "n_text",
        entropy.alias("entropy"),
        F.when(F.col("unique_count") > 1, entropy / F.log2(F.col("unique_count").cast("double"))).otherwise(0.0).alias("entropy_norm"),
        (F.col("_top") / total).alias("mode_share"),
        (F.col("_numeric") / total).alias("numeric_share"),
        (F.col("_total") / F.col("_numeric")).alias("mean"),
    )


def variance(counts: DataFrame, info: DataFrame) -> DataFrame:
    """Population mean, variance and deviation of numeric collapsed values, around the known mean."""
    number = F.coalesce("number", to_number(F.col("collapsed")))
    centred = F.col("n") * F.pow(number - F.col("mean"), 2)
    return (
        # one row per (dataset, field): the size of the field registry
        counts.where(number.isNotNull())
        .join(F.broadcast(info.select(*FIELD, "mean")), FIELD)
        .groupBy(*FIELD)
        .agg(F.first("mean").alias("mean"), (F.sum(centred) / F.sum("n")).alias("variance"))
        .withColumn("deviation", F.sqrt("variance"))
    )


def stage_vocabulary(counts: DataFrame) -> DataFrame:
    """Whether the distinct tokens of a field form one ordered stage family."""
    pieces = F.when(
        F.col("collapsed").contains(" | "), F.split(F.col("collapsed"), r" \| ")
    ).otherwise(F.array("collapsed"))
    tokens = (
        counts.where(F.col("collapsed").isNotNull()).select(*FIELD, F.explode(pieces).alias("token"))
        .select(*FIELD, stripped(F.col("token")).alias("token"))
        .where(F.col("token") != "")
        .distinct()
        .withColumn("s", stage_token(F.col("token")))
    )
    seen = tokens.groupBy(*FIELD).agg(
        F.count(F.lit(1)).alias("v"),
        F.count("s").alias("p"),
        F.countDistinct("s.prefix").alias("prefixes"),
        F.countDistinct("s.num").alias("numbers"),
    )
    ordinal = (
        (F.col("v") >= 2) & (F.col("p") >= 2) & (F.col("p") >= 0.5 * F.col("v"))
        & (F.col("prefixes") == 1) & (F.col("numbers") >= 2)
    )
    return seen.select(*FIELD, ordinal.alias("ordinal_stage"))


def inferred_type(numeric_share: Column, ordinal: Column, unique_count: Column) -> Column:
    return (
        F.when(numeric_share.isNull(), "empty")
        .when(numeric_share >= 0.95, "numeric")
        .when(F.coalesce(ordinal, F.lit(False)), "ordinal_stage")
        .when(unique_count <= 20, "ordinal_class")
        .otherwise("text")
    )


def first_examples(per_patient: DataFrame, order: str = "patient_id", k: int = 5) -> DataFrame:
    """First ``k`` collapsed values in case order; the rank filter keeps k rows per task before the shuffle."""
    w = Window.partitionBy(*FIELD).orderBy(order)
    top = (
        per_patient.where(F.col("n_valid") > 0)
        .select(*FIELD, order, "collapsed", F.row_number().over(w).alias("rn"))
        .where(F.col("rn") <= k)
    )
    rows = F.array_sort(F.collect_list(F.struct("rn", F.col("collapsed").alias("v"))))
    return top.groupBy(*FIELD).agg(F.array_join(F.transform(rows, lambda r: r["v"]), " | ").alias("example_values"))


def valid_patients(f: Families, fields: dict[str, dict[str, str]]) -> DataFrame:
    """(patient_id, dataset, field_path), one row for everyone with a valid raw value.

    An object adds a flag a field to its patient, in parts; its values never
    become rows.
    """
    out = None
    for family, names in fields.items():
        flags = {
            name: F.col(name).cast("double").isNotNull() if kind == "number" else value_state(F.col(name).cast("string"), F.lit(kind)) == "valid"
            for name, kind in names.items()
        }
        per = f.table(family).groupBy("patient_id", "dataset").agg(*[F.max(flag).alias(name) for name, flag in flags.items()])
        paths = F.array_compact(F.array(*[F.when(F.col(name), F.lit(PREFIXES[family] + name)) for name in names]))
        part = per.select("patient_id", "dataset", F.explode(paths).alias("field_path"))
        out = part if out is None else out.unionByName(part)
    return out


def masked_counts(had: DataFrame, per_patient: DataFrame) -> DataFrame:
    """Patients per (dataset, field) who had a valid raw value and have none in ``per_patient``."""
    keys = ["patient_id", "field_path", "dataset"]
    raw = had.select(*keys, F.lit(False).alias("_passed"), F.lit(True).alias("_had"))
    passed = per_patient.where(F.col("n_valid") > 0).select(*keys, F.lit(True).alias("_passed"), F.lit(False).alias("_had"))
    each = raw.unionByName(passed).groupBy(*keys).agg(F.max("_passed").alias("_passed"), F.max("_had").alias("_had"))
    # a patient without a name is not known to be the same on both sides
    unknown = F.col("patient_id").isNull() | F.col("field_path").isNull() | F.col("dataset").isNull()
    return each.where(F.col("_had") & (~F.col("_passed") | unknown)).groupBy(*FIELD).agg(F.count(F.lit(1)).alias("masked_count"))


def field_stats(
    values: DataFrame,
    dictionary: DataFrame,
    sizes: DataFrame,
    *,
    had: DataFrame | None = None,
    order: str = "patient_id",
    examples: bool = False,
) -> DataFrame:
    """Full statistics table; every dictionary field appears, also with no value at all.

    With ``had`` given (``valid_patients`` of the raw values), ``values`` hold
    only what a landmark lets through: everything else is missing and
    ``masked_count`` tells how many patients had a valid raw value.
    """
    landmark = had is not None
    per = patient_values(values)
    if landmark:
        # counted by value and asked who has one
        per = checkpointed(per)
    # one pass over the values; everything below reads this much smaller table
    counts = checkpointed(category_counts(per, order))
    info = information(counts)
    parts = [
        completeness(counts, landmark), info.drop("mean"), variance(counts, info).select(*FIELD, "variance"),
        stage_vocabulary(counts),
    ]
    if examples:
        parts.append(first_examples(per, order))
    out = dictionary.join(sizes, "dataset")
    for part in parts:
        out = out.join(part, FIELD, "left")
    if landmark:
        out = out.join(masked_counts(had, per), FIELD, "left")
    total = F.col("n_patients")
    valid = F.coalesce("valid", F.lit(0))
    sentinel = F.lit(0).cast("long") if landmark else F.coalesce("sentinel_count", F.lit(0))
    null = total - valid - sentinel
    kind = F.when(F.col("n_values").isNull(), "empty").when(F.col("n_text") == 0, "numeric").otherwise("categorical")
    metric = F.when(kind == "empty", "none").when(kind == "numeric", "variance").otherwise("entropy_norm")
    amount = F.when(kind == "empty", 0.0).when(kind == "numeric", F.col("variance")).otherwise(F.col("entropy_norm"))
    columns = [
        "dataset", "field_path",
        total.alias("total"), (total - valid).alias("missing"), valid.alias("valid"),
        kind.alias("value_kind"), F.coalesce("unique_count", F.lit(0)).alias("unique_count"),
        metric.alias("info_metric_type"), F.round(amount, 6).alias("info_metric_value"),
        F.round(valid / total, 6).alias("coverage"),
        null.alias("null_count"), sentinel.alias("sentinel_count"),
        F.round(null / total, 6).alias("null_rate"), F.round(sentinel / total, 6).alias("sentinel_rate"),
        F.coalesce("mode_value", F.lit("")).alias("mode_value"),
        F.round(F.coalesce("mode_share", F.lit(0.0)), 6).alias("mode_share"),
        inferred_type(F.col("numeric_share"), F.col("ordinal_stage"), F.col("unique_count")).alias("inferred_type"),
        F.col("field_path").contains("[]").alias("multi_record"),
        F.round(F.coalesce("_multi", F.lit(0)) / total, 6).alias("multi_record_rate"),
    ]
    if examples:
        columns.append(F.coalesce("example_values", F.lit("")).alias("example_values"))
    if landmark:
        columns.append(F.coalesce("masked_count", F.lit(0)).alias("masked_count"))
    return out.select(*columns)


def shortened(stats: DataFrame, width: int = 80, columns: tuple[str, ...] = ("mode_value",)) -> DataFrame:
    """The table with long texts cut to ``width`` characters, as it is printed; the statistics themselves keep whole values."""
    return stats.withColumns({c: F.substring(c, 1, width) for c in columns if c in stats.columns})


def stats_order(stats: DataFrame, shared: bool = False) -> DataFrame:
    keys = [F.desc("missing"), "field_path"]
    return stats.orderBy("dataset", *keys) if shared else stats.orderBy(*keys)
