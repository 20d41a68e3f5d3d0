"""Follow-up records in time order with changes since the previous one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import filled_template
from ..scale import exact_quantiles, ordered_columns
from .encode import scaled, vocabulary
from .families import Families
from .landmark import passes

# Derived fields and their sentences.
DERIVED = {
    "follow_ups[].days_since_last_follow_up": ("days_since", "int", "Days since last follow-up is {}."),
    "follow_ups[].ecog_change": ("ecog_change", "", "ECOG performance status change is {}."),
    "follow_ups[].karnofsky_change": ("karnofsky_change", "", "Karnofsky performance status change is {}."),
    "follow_ups[].bmi_change": ("bmi_change", "", "Body mass index change is {}."),
    "follow_ups[].weight_change": ("weight_change", "", "Patient weight change is {} kg."),
}
_SOURCES = {
    "ecog": "ecog_performance_status", "karnofsky": "karnofsky_performance_status", "bmi": "bmi", "weight": "weight",
}


def _number(c: Column) -> Column:
    from ..functions.numbers import first_number

    return first_number(c.cast("string"))


def follow_up_records(t: Families, landmark: float | None = None, rows: int | None = None) -> DataFrame:
    """Dated follow-ups by day, undated after them in document order, one placeholder for patients with none.

    Differences are taken between neighbouring dated records only; each record
    uses the last numeric value among its own attributes.
    """
    fu = t.follow_ups.where("slotted")
    oca = t.other_attributes  # a record reads all its own attributes, also under a landmark
    if landmark is not None:
        fu = fu.where(passes(landmark))
    have = {}
    for name, column in _SOURCES.items():
        if column in fu.columns and name in ("ecog", "karnofsky"):
            have[name] = _number(F.col(column))
    own = fu.select("dataset", "patient_id", "fu_pos", "pos", F.col("days_to_follow_up").alias("days"), *[c.alias(n) for n, c in have.items()])
    last = [n for n in ("bmi", "weight") if n in oca.columns]
    if last:
        picked = oca.groupBy("dataset", "patient_id", "fu_pos").agg(
            *[F.max_by(_number(F.col(n)), F.when(_number(F.col(n)).isNotNull(), F.col("pos"))).alias(n) for n in last]
        )
        own = own.join(picked, ["dataset", "patient_id", "fu_pos"], "left")
        have.update({n: F.col(n) for n in last})
    measures = list(have)
    staged = own.withColumns({
        "undated": F.col("days").isNull(),
        "_day": F.coalesce("days", F.lit(float("inf"))),
        "_now": F.struct("days", *measures),
    })
    numbered = ordered_columns(
        staged, ["dataset", "patient_id"], ["undated", "_day", "pos"],
        {"number": ("row",), "_before": ("lag", "_now")}, rows,
    )
    before = F.col("_before")
    usable = ~F.col("undated") & before.isNotNull()
    records = numbered.select(
        "dataset", "patient_id", (F.col("number") - 1).alias("idx"), "fu_pos", "days",
        F.when(usable, F.col("days") - before["days"]).alias("days_since"),
        *[F.when(usable, F.col(m) - before[m]).alias(f"{m}_change") for m in measures],
    )
    nobody = t.patients.select("dataset", "patient_id").join(records, ["dataset", "patient_id"], "left_anti")
    return records.unionByName(nobody.withColumn("idx", F.lit(0).cast("long")), allowMissingColumns=True)


def derived_values(records: DataFrame) -> DataFrame:
    """Derived measures of every record as long field values."""
    cells = [
        F.when(F.col(c).isNotNull(), F.struct(F.lit(f).alias("field_path"), F.col(c).alias("number")))
        for f, (c, _, _) in DERIVED.items() if c in records.columns
    ]
    out = records.select("dataset", "patient_id", "idx", F.explode(F.array_compact(F.array(*cells))).alias("_c"))
    return out.select("dataset", "patient_id", "idx", "_c.*")


def with_derived_fields(fields: DataFrame) -> DataFrame:
    """Append derived fields to a (dataset, ord, field_path, convert, template) list, once per dataset."""
    extra = F.explode(F.array(*[
        F.struct(F.lit(i).alias("o"), F.lit(f).alias("field_path"), F.lit(conv).alias("convert"), F.lit(tpl).alias("template"))
        for i, (f, (_, conv, tpl)) in enumerate(DERIVED.items())
    ]))
    tail = fields.groupBy("dataset").agg(F.max("ord").alias("_last")).select("dataset", "_last", extra.alias("d"))
    new = tail.select("dataset", (F.col("_last") + 1 + F.col("d.o")).alias("ord"), "d.field_path", "d.convert", "d.template")
    return fields.unionByName(new.join(fields, ["dataset", "field_path"], "left_anti").select(fields.columns))


def padded(records: DataFrame, values: DataFrame, templates: DataFrame) -> DataFrame:
    """Field-major sentences of a dataset, every patient padded to its longest record list.

    ``position`` counts fields first and records inside a field.
    """
    longest = records.groupBy("dataset").agg((F.max("idx") + 1).alias("width"))
    people = records.select("dataset", "patient_id").distinct()
    slots = (
        people.join(longest, "dataset").join(templates, "dataset")
        .select("dataset", "patient_id", "ord", "field_path", "template", "width",
                F.explode(F.sequence(F.lit(0).cast("long"), F.col("width") - 1)).alias("idx"))
    )
    joined = slots.join(values, ["dataset", "patient_id", "field_path", "idx"], "left")
    value = F.coalesce("value", F.lit("not reported"))
    return joined.select(
        "dataset", "patient_id", (F.col("ord") * F.col("width") + F.col("idx")).alias("position"),
        filled_template(F.col("template"), value).alias("sentence"), F.col("value").isNotNull().alias("valid"),
    )


# ---- one-hot records ----------------------------------------------------------
def record_values(records: DataFrame, numbers: dict[str, str], texts: dict[str, str]) -> DataFrame:
    """(dataset, patient_id, idx, field_path, x, category) of the records' known values.

    ``numbers`` and ``texts`` map field paths to the records' columns; a column
    the records lack gives no values.
    """
    cells = [
        F.when(F.col(c).isNotNull(), F.struct(F.lit(f).alias("field_path"), (F.col(c) if number else F.lit(None)).cast("double").alias("x"),
                                              (F.lit(None) if number else F.col(c)).cast("string").alias("category")))
        for names, number in ((numbers, True), (texts, False)) for f, c in names.items() if c in records.columns
    ]
    out = records.select("dataset", "patient_id", "idx", F.explode(F.array_compact(F.array(*cells))).alias("_c"))
    return out.select("dataset", "patient_id", "idx", "_c.*")


def record_vocabulary(values: DataFrame, threshold: int = 5) -> DataFrame:
    """(dataset, field_path, category, idx) over records: missing 0, other 1, kept categories from 2."""
    return vocabulary(values.where("category is not null"), ["dataset", "field_path"], threshold)


def record_schema(values: DataFrame, vocab: DataFrame, rows: int | None = None) -> DataFrame:
    """One row per (dataset, field): kind, width and start of its columns, range, and what an unknown cell holds.

    ``fill`` is the scaled median of a continuous field; an unknown nominal cell
    has its one in the first column.  Fields are in order of their paths.
    """
    keys = ["dataset", "field_path"]
    numbers = values.where("x is not null")
    ends = numbers.groupBy(*keys).agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    con = ends.join(exact_quantiles(numbers, keys, "x", {"mid": 0.5}, rows), keys).select(
        *keys, F.lit("continuous").alias("kind"), F.lit(1).cast("long").alias("width"), "lo", "hi",
        scaled(F.col("mid"), F.col("lo"), F.col("hi")).alias("fill"),
    )
    none = F.lit(None).cast("double")
    nom = vocab.groupBy(*keys).agg((F.max("idx") + 1).alias("width")).select(
        *keys, F.lit("nominal").alias("kind"), "width", none.alias("lo"), none.alias("hi"), none.alias("fill")
    )
    # one row per dataset and field: the window sees a field list
    before = Window.partitionBy("dataset").orderBy("field_path", "kind").rowsBetween(Window.unboundedPreceding, -1)
    return con.unionByName(nom).withColumn("start", F.coalesce(F.sum("width").over(before), F.lit(0).cast("long")))


def record_cells(values: DataFrame, vocab: DataFrame, schema: DataFrame) -> DataFrame:
    """Sparse one-hot records: (dataset, patient_id, idx, field_path, column, x), a row for each known value.

    ``column`` is the place in the record's vector.  Unknown cells and records
    that a shorter patient lacks have no rows; the schema says what they hold,
    so nothing is padded to the longest patient.
    """
    keys = ["dataset", "field_path"]
    kinds = F.when(F.col("category").isNull(), "continuous").otherwise("nominal")
    # no hint for schema and vocabulary: the engine knows their size
    known = values.withColumn("kind", kinds).join(schema, [*keys, "kind"]).join(
        vocab.withColumnRenamed("idx", "_code"), [*keys, "category"], "left"
    )
    code = F.when(F.col("kind") == "nominal", F.coalesce("_code", F.lit(1))).otherwise(0)
    return known.select(
        "dataset", "patient_id", "idx", "field_path", (F.col("start") + code).alias("column"),
        F.when(F.col("kind") == "nominal", 1.0).otherwise(scaled(F.col("x"), F.col("lo"), F.col("hi"))).alias("x"),
    )
