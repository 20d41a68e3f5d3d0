"""Named scheme values of a case and the objects each value comes from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.missing import cleaned, stripped
from ..functions.numbers import number_label
from ..functions.text import first_filled
from .families import Families, primary_order
from .landmark import masked
from .leak import WHO, _therapies, therapy_sources, therapy_values, years_smoked

PHARMA = "pharmaceutical therapy, nos"
RADIATION = "radiation therapy, nos"

# The 31 scheme fields with how they are read and their placeholder.
# kinds: case (patient columns), primary (primary diagnosis columns), join (all
# objects of a family), therapy (treatments of one type), smoked.
SCHEME_FIELDS: dict[str, tuple] = {
    "demographic.age_at_index": ("case", ("age_at_index",), "unknown"),
    "demographic.sex_at_birth": ("case", ("sex_at_birth", "gender"), "not reported"),
    "demographic.race": ("case", ("race",), "not reported"),
    "demographic.ethnicity": ("case", ("ethnicity",), "not reported"),
    "diagnoses[].primary_diagnosis": ("primary", ("primary_diagnosis",), "Unknown Neoplasm"),
    "diagnoses[].morphology": ("primary", ("morphology",), "not reported"),
    "diagnoses[].tissue_or_organ_of_origin": ("primary", ("tissue_or_organ_of_origin",), "not reported"),
    "diagnoses[].laterality": ("primary", ("laterality",), "not reported"),
    "diagnoses[].year_of_diagnosis": ("primary", ("year_of_diagnosis",), "not reported"),
    "diagnoses[].age_at_diagnosis": ("primary", ("age_at_diagnosis",), "unknown"),
    "diagnoses[].tumor_grade": ("primary", ("tumor_grade",), "not reported"),
    "diagnoses[].prior_malignancy": ("primary", ("prior_malignancy",), "not reported"),
    "diagnoses[].synchronous_malignancy": ("primary", ("synchronous_malignancy",), "not reported"),
    "diagnoses[].prior_treatment": ("primary", ("prior_treatment",), "not reported"),
    "diagnoses[].ajcc_pathologic_t": ("primary", ("ajcc_pathologic_t",), "TX"),
    "diagnoses[].ajcc_pathologic_n": ("primary", ("ajcc_pathologic_n",), "NX"),
    "diagnoses[].ajcc_pathologic_m": ("primary", ("ajcc_pathologic_m",), "MX"),
    "diagnoses[].ajcc_pathologic_stage": ("primary", ("ajcc_pathologic_stage", "figo_stage"), "Stage X"),
    "diagnoses[].ajcc_staging_system_edition": (
        "primary", ("ajcc_staging_system_edition", "figo_staging_edition_year"), "not reported"),
    "diagnoses[].pathology_details[].lymph_nodes_tested": (
        "join", ("lymph_nodes_tested",), "not reported", "diagnoses_pathology_details"),
    "diagnoses[].pathology_details[].lymph_nodes_positive": (
        "join", ("lymph_nodes_positive",), "not reported", "diagnoses_pathology_details"),
    "follow_ups[].ecog_performance_status": ("join", ("ecog_performance_status",), "not reported", "follow_ups"),
    "follow_ups[].other_clinical_attributes[].bmi": (
        "join", ("bmi",), "not reported", "follow_ups_other_clinical_attributes"),
    "project.project_id": ("case", ("project_id",), "not reported"),
    "derived.pharmaceutical_therapy": ("therapy", (PHARMA,), "unknown"),
    "derived.radiation_therapy": ("therapy", (RADIATION,), "unknown"),
    "exposures[].pack_years_smoked": ("join", ("pack_years_smoked",), "unknown", "exposures"),
    "derived.years_smoked": ("smoked", (), "unknown"),
    "exposures[].cigarettes_per_day": ("join", ("cigarettes_per_day",), "unknown", "exposures"),
    "exposures[].alcohol_history": ("join", ("alcohol_history",), "not reported", "exposures"),
    "diagnoses[].site_of_resection_or_biopsy": ("primary", ("site_of_resection_or_biopsy",), "not reported"),
}


def _text(df: DataFrame, name: str) -> Column:
    kind = dict(df.dtypes)[name]
    return number_label(F.col(name)) if kind in ("double", "float") else F.col(name).cast("string")


def _filled(df: DataFrame, names: tuple[str, ...]) -> Column | None:
    have = [_text(df, n) for n in names if n in df.columns]
    return F.nullif(first_filled(have, ""), F.lit("")) if have else None


def _melt(df: DataFrame, cells: dict[str, Column]) -> DataFrame:
    """Long (field_path, value) rows of the non-null cells."""
    structs = [
        F.when(v.isNotNull(), F.struct(F.lit(f).alias("field_path"), v.alias("value"))) for f, v in cells.items()
    ]
    keep = [c for c in ("dataset", "patient_id", "family", "slotted", "status", "t_hi") if c in df.columns]
    return df.select(*keep, F.explode(F.array_compact(F.array(*structs))).alias("_c")).select(*keep, "_c.*")


def primary_rows(t: Families) -> DataFrame:
    """The primary diagnosis of every patient, whole row."""
    row = F.struct(*[F.col(c) for c in t.diagnoses.columns if c not in WHO])
    return t.diagnoses.groupBy(*WHO).agg(F.min_by(row, primary_order()).alias("_d")).select(*WHO, "_d.*")


def join_objects(t: Families) -> DataFrame:
    """Objects that contribute a text to a joined scheme value, one row per object and field."""
    out = None
    for family in ("diagnoses_pathology_details", "follow_ups", "follow_ups_other_clinical_attributes", "exposures"):
        df = t.table(family)
        if df is None:
            continue
        if "slotted" not in df.columns:
            df = df.withColumns({
                "slotted": F.lit(False), "status": F.lit(None).cast("string"), "t_hi": F.lit(None).cast("double"),
            })
        df = df.withColumn("family", F.lit(family))
        cells = {
            f: F.nullif(cleaned(_text(df, s[1][0]), ""), F.lit(""))
            for f, s in SCHEME_FIELDS.items() if s[0] == "join" and s[3] == family and s[1][0] in df.columns
        }
        if cells:
            part = _melt(df, cells)
            out = part if out is None else out.unionByName(part)
    return out


def joined_texts(objects: DataFrame) -> DataFrame:
    distinct = objects.select(*WHO, "field_path", "value").distinct()
    return distinct.groupBy(*WHO, "field_path").agg(F.array_join(F.array_sort(F.collect_list("value")), ", ").alias("value"))


def found_values(t: Families) -> DataFrame:
    """Scheme values that differ from nothing-known: (dataset, patient_id, field_path, value)."""
    case = {f: _filled(t.patients, s[1]) for f, s in SCHEME_FIELDS.items() if s[0] == "case"}
    main = primary_rows(t)
    first = {f: _filled(main, s[1]) for f, s in SCHEME_FIELDS.items() if s[0] == "primary"}
    out = _melt(t.patients.select(*t.patients.columns), {f: v for f, v in case.items() if v is not None})
    out = out.unionByName(
        _melt(main, {f: v for f, v in first.items() if v is not None}).select(*WHO, "field_path", "value")
    )
    out = out.unionByName(joined_texts(join_objects(t)))
    for field, kind in (("derived.pharmaceutical_therapy", PHARMA), ("derived.radiation_therapy", RADIATION)):
        out = out.unionByName(therapy_values(t, kind, field))
    if t.exposures is not None:
        smoked = years_smoked(t).select(*WHO, F.lit("derived.years_smoked").alias("field_path"), "value")
        out = out.unionByName(smoked)
    return out


def scheme_values(t: Families, landmark: float | None = None, fields: list[str] | None = None) -> DataFrame:
    """All scheme values of every patient in long form, placeholders where nothing is known."""
    names = fields or list(SCHEME_FIELDS)
    seen = t if landmark is None else masked(t, landmark)
    every = t.patients.select(*WHO, F.explode(F.array(*[
        F.struct(F.lit(f).alias("field_path"), F.lit(SCHEME_FIELDS[f][2]).alias("placeholder")) for f in names
    ])).alias("_f")).select(*WHO, "_f.*")
    found = found_values(seen).where(F.col("field_path").isin(*names))
    return every.join(found, [*WHO, "field_path"], "left").select(
        *WHO, "field_path", F.coalesce("value", "placeholder").alias("value"),
        F.coalesce(F.col("value") != F.col("placeholder"), F.lit(False)).alias("valid"),
    )


def scheme_wide(values: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """One row per patient, one column per scheme field."""
    names = fields or list(SCHEME_FIELDS)
    return values.groupBy(*WHO).pivot("field_path", names).agg(F.first("value"))


def scheme_sources(t: Families) -> DataFrame:
    """One row per (patient, scheme field, contributing object) with the object's time location."""
    place = ["family", "slotted", "status", "t_hi"]
    main = primary_rows(t).withColumn("family", F.lit("diagnoses"))
    every = {f: F.lit("") for f, s in SCHEME_FIELDS.items() if s[0] == "primary" and any(n in main.columns for n in s[1])}
    out = _melt(main, every).select(*WHO, "field_path", *place)
    out = out.unionByName(join_objects(t).select(*WHO, "field_path", *place))
    for field, kind in (("derived.pharmaceutical_therapy", PHARMA), ("derived.radiation_therapy", RADIATION)):
        out = out.unionByName(therapy_sources(t, kind, field).select(*WHO, "field_path", *place))
    if t.exposures is not None:
        field = F.lit("derived.years_smoked").alias("field_path")
        smoked = years_smoked(t)
        exposure = smoked.select(
            *WHO, field, F.lit("exposures").alias("family"), F.lit(False).alias("slotted"),
            F.lit(None).cast("string").alias("status"), F.lit(None).cast("double").alias("t_hi"),
        )
        via_dx = smoked.where("branch = 'diagnosis_year'").join(main.select(*WHO, *place), WHO).select(*WHO, field, *place)
        out = out.unionByName(exposure).unionByName(via_dx)
    return out


def source_values(t: Families) -> DataFrame:
    """(dataset, patient_id, field_path, value) of every object that contributes to a scheme value, case fields left out."""
    rank = F.row_number().over(Window.partitionBy(*WHO).orderBy(primary_order()))
    main = t.diagnoses.withColumn("_rank", rank).where("_rank = 1")
    first = {f: _filled(main, s[1]) for f, s in SCHEME_FIELDS.items() if s[0] == "primary"}
    columns = [*WHO, "field_path", "value"]
    out = _melt(main, {f: v for f, v in first.items() if v is not None}).select(*columns)
    out = out.unionByName(join_objects(t).select(*columns))
    for field, kind in (("derived.pharmaceutical_therapy", PHARMA), ("derived.radiation_therapy", RADIATION)):
        read, token = _therapies(t, kind)
        out = out.unionByName(read.select(*WHO, F.lit(field).alias("field_path"), token.alias("value")).where("value in ('yes', 'no')"))
    if t.exposures is not None:
        out = out.unionByName(years_smoked(t).select(*WHO, F.lit("derived.years_smoked").alias("field_path"), "value"))
    return out


def provenance_mismatches(values: DataFrame, sources: DataFrame) -> DataFrame:
    """Non-case values that differ from the value rebuilt from their sources' values: must be empty."""
    keys = [*WHO, "field_path"]
    joins = [f for f, s in SCHEME_FIELDS.items() if s[0] == "join"]
    # one object gives a primary or smoking value; a therapy's yes is above its no
    rebuilt = sources.groupBy(*keys).agg(F.sort_array(F.collect_set("value")).alias("_all")).select(
        *keys, F.when(F.col("field_path").isin(*joins), F.array_join("_all", ", ")).otherwise(F.array_max("_all")).alias("_rebuilt")
    )
    known = F.create_map(*[F.lit(x) for f, s in SCHEME_FIELDS.items() for x in (f, s[2])])
    traced = [f for f, s in SCHEME_FIELDS.items() if s[0] != "case"]
    expected = F.coalesce("_rebuilt", known[F.col("field_path")])
    return values.where(F.col("field_path").isin(*traced)).join(rebuilt, keys, "left").where(
        ~F.col("value").eqNullSafe(expected)
    ).drop("_rebuilt")


def aliased(values: DataFrame, aliases: DataFrame) -> DataFrame:
    """Replace values by their canonical spelling: (field_path, key, canonical) with keys in lower case, single spaces.

    Values without a rule only lose the space around them.
    """
    key = F.lower(F.trim(F.regexp_replace("value", r"\s+", " ")))
    joined = values.withColumn("key", key).join(aliases, ["field_path", "key"], "left")
    return joined.withColumn("value", F.coalesce(F.col("canonical"), stripped(F.col("value")))).drop("key", "canonical")
