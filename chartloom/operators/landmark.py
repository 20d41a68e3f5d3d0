"""Landmark masks: what was known by day T, and values read through the mask."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.missing import cleaned
from ..functions.numbers import DAYS_PER_MONTH, convert_by, number_label
from ..functions.text import filled_template
from .families import TIMED, Families, long_values, primary_order
from .stats import FIELD, with_state
from .timing import EXCLUDED, INFINITY


def passes(landmark: float) -> Column:
    """A located slot with a finite upper bound at or before the landmark."""
    return F.coalesce(
        ~F.col("status").isin(*EXCLUDED) & (F.col("t_hi") != INFINITY) & (F.col("t_hi") <= float(landmark)), F.lit(False)
    )


def keeps(landmark: float) -> Column:
    """Objects outside the time model stay; slotted ones must pass."""
    return ~F.col("slotted") | passes(landmark)


def masked(t: Families, landmark: float) -> Families:
    """Families with every failing object dropped; a dropped parent takes its children along."""

    def keep(family: str, table: DataFrame) -> DataFrame:
        kept = table.where(keeps(landmark))
        if family in ("diagnoses", "follow_ups"):
            return kept
        parent, key = (t.diagnoses, "dx_pos") if family.startswith("diagnoses") else (t.follow_ups, "fu_pos")
        return kept.join(parent.where(keeps(landmark)).select("dataset", "patient_id", key), ["dataset", "patient_id", key], "left_semi")

    return t.mapped(TIMED, keep)


# ---- values read field by field -------------------------------------------
def flat_diagnosis(path: Column) -> Column:
    """Leaves directly on a diagnosis, read from the primary diagnosis only."""
    return path.startswith("diagnoses[].") & ~F.substring(path, F.lit(13), F.length(path)).contains(".")


def readable(t: Families, landmark: float | None) -> Families:
    """Objects whose values a field may read, with the primary diagnosis marked.

    ``present`` on diagnoses, where a document source gives it, lists the keys
    the document really had; without it every column counts as present.
    Families marked before are taken as they are where nothing is masked.
    """
    if landmark is None and "is_main" in t.diagnoses.columns:
        return t
    seen = t
    if landmark is not None:
        seen = t.mapped(TIMED, lambda _, table: table.where(F.col("slotted") & passes(landmark)))
    dx = seen.diagnoses
    present = F.col("present") if "present" in dx.columns else F.lit(None).cast("array<string>")
    main = dx.groupBy("patient_id", "dataset").agg(
        F.min(F.struct(primary_order().alias("at"), present.alias("present"))).alias("_m")
    ).select("patient_id", "dataset", F.col("_m.at.pos").alias("main_pos"), F.col("_m.present").alias("main_keys"))
    marked = dx.join(main, ["patient_id", "dataset"]).withColumn("is_main", F.coalesce(F.col("pos") == F.col("main_pos"), F.lit(False))).drop("main_pos")
    return seen.with_tables({"diagnoses": marked})


def used_values(t: Families, fields: dict[str, dict[str, str]], landmark: float | None, timed: bool = False) -> DataFrame:
    """Valid raw values a field reads, through the landmark when one is given.

    With ``timed`` every value carries the time location of its object: that of
    the nearest timed object around it, or none outside the time model.

    Timed fields read passing objects only.  A flat diagnosis leaf reads the
    primary diagnosis among the readable ones when that diagnosis has the leaf,
    and every readable diagnosis otherwise.
    """
    keep = {"is_main": "boolean", "main_keys": "array<string>"}
    rows = with_state(long_values(readable(t, landmark), fields, timed=timed, keep=keep)).where("state = 'valid'")
    path = F.col("field_path")
    elsewhere = ~F.array_contains("main_keys", F.substring_index(path, ".", -1))
    # objects that are no diagnoses are not marked, which is known before their paths are looked at
    return rows.where(F.col("is_main").isNull() | ~flat_diagnosis(path) | F.col("is_main") | F.coalesce(elsewhere, F.lit(False))).drop(*keep)


# keys of a patient's field, those that tell rows apart first: sorts by them rarely look further
CELL = ["patient_id", "field_path", "dataset"]


def used_text() -> Column:
    """Cleaned text of a used value, null where it says nothing; the text of a number needs no cleaning."""
    value, number = F.col("value"), F.col("number")
    return F.when(value.isNotNull(), cleaned(value, None)).otherwise(number_label(number))


def bank_values(used: DataFrame) -> DataFrame:
    """(dataset, patient, field) with the joined value text: sorted distinct cleaned values."""
    texts = used.select(*CELL, used_text().alias("v")).distinct()
    joined = texts.groupBy(*CELL).agg(F.array_sort(F.collect_list("v")).alias("_l"))
    value = F.when(F.size("_l") > 0, F.array_join("_l", ", ")).otherwise("not reported")
    return joined.select(*FIELD, "patient_id", value.alias("value"))


def prompt_rows(patients: DataFrame, templates: DataFrame, bank: DataFrame) -> DataFrame:
    """Sentence and validity of every template field for every patient.

    ``templates`` has one row per (dataset, field): ``template`` and ``convert``.
    """
    every = patients.select("dataset", "patient_id").join(templates, "dataset")
    joined = every.join(bank, ["dataset", "field_path", "patient_id"], "left")
    valid = F.col("value").isNotNull()
    value = F.when(valid, convert_by(F.col("value"), F.col("convert"))).otherwise("not reported")
    return joined.select(
        "dataset", "patient_id", "field_path", filled_template(F.col("template"), value).alias("sentence"), valid.alias("valid")
    )


def cell_changes(raw: DataFrame, other: DataFrame, patients: DataFrame) -> DataFrame:
    """Per (dataset, field): cells that differ between two banks, with a first sample.

    ``untimed_change`` marks fields outside the time model, where a difference is an error.
    """
    from ..functions.paths import timed_family

    keys = [*FIELD, "patient_id"]
    left = raw.select(*keys, F.col("value").alias("a"))
    right = other.select(*keys, F.col("value").alias("b"))
    a, b = F.coalesce("a", F.lit("not reported")), F.coalesce("b", F.lit("not reported"))
    changed = a != b
    n = patients.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_patients"))
    sample = F.concat(F.col("patient_id").cast("string"), F.lit(": "), b, F.lit(" -> "), a)
    per = left.join(right, keys, "full").groupBy(*FIELD).agg(
        F.count_if(changed).alias("changed_cells"),
        F.min_by(F.when(changed, sample), F.when(changed, F.col("patient_id"))).alias("sample_change"),
    )
    family = timed_family(F.col("field_path"))
    return per.join(n, "dataset").select(
        *FIELD, F.coalesce(family, F.lit("")).alias("family"), "changed_cells", "n_patients",
        F.coalesce("sample_change", F.lit("")).alias("sample_change"),
        (family.isNull() & (F.col("changed_cells") > 0)).alias("untimed_change"),
    )


# ---- labels ----------------------------------------------------------------
def risk_set(labels: DataFrame, landmark: float) -> DataFrame:
    """Label rows still at risk after day T with the time origin moved to T; unknown times stay."""
    days = F.col("survival_months") * DAYS_PER_MONTH
    kept = labels.where(days.isNull() | F.isnan(days) | (days > float(landmark)))
    return kept.withColumn("survival_months", F.col("survival_months") - float(landmark) / DAYS_PER_MONTH)


def risk_set_stats(labels: DataFrame, landmark: float) -> DataFrame:
    """Rows, cases and events before and after the risk-set rule, per dataset.

    Cases are grouped once before they are counted, so a hot dataset is counted
    in pieces.
    """
    out = F.coalesce(F.col("survival_months") * DAYS_PER_MONTH <= float(landmark), F.lit(False))
    per_case = labels.groupBy("dataset", "case_id").agg(
        F.count(F.lit(1)).alias("r"), F.count_if(~out).alias("k"),
        F.count_if(F.col("censorship") == 0).alias("e"), F.count_if((F.col("censorship") == 0) & ~out).alias("ke"),
    )
    return per_case.groupBy("dataset").agg(
        F.sum("r").alias("rows_before"), F.sum("k").alias("rows_after"),
        F.count(F.lit(1)).alias("cases_before"), F.count_if(F.col("k") > 0).alias("cases_after"),
        F.sum("e").alias("events_before"), F.sum("ke").alias("events_after"),
        F.count_if(F.col("k") < F.col("r")).alias("cases_excluded"),
    )


def excluded_cases(labels: DataFrame, landmark: float) -> DataFrame:
    gone = F.col("survival_months") * DAYS_PER_MONTH <= float(landmark)
    return labels.where(gone).select("dataset", "case_id").distinct()
