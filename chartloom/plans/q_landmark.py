"""Queries on landmark masks, longitudinal records, scheme values and the leak audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.paths import timed_family
from ..operators import extract, landmark, leak, longitudinal, stats, timing
from ..scale import checkpointed
from . import oracle_base as ob
from .clinical import VALUE_FIELDS, Clinic
from .q_timing import ends, labels
from .registry import query

T = 365.0

ob.cte("x_objects", """
SELECT dataset, patient_id, 'diagnoses' AS family, dx_pos, 0 AS fu_pos, 0 AS n1, 0 AS n2, 0 AS n3, t_hi, status, true AS slotted FROM x_tdx
UNION ALL SELECT dataset, patient_id, 'diagnoses_treatments', dx_pos, 0, n1, n2, n3, t_hi, status, treatment_or_therapy <> 'no' FROM x_ttx
UNION ALL SELECT dataset, patient_id, 'diagnoses_pathology_details', dx_pos, 0, 0, 0, 0, t_hi, status, true FROM x_tpth
UNION ALL SELECT dataset, patient_id, 'follow_ups', 0, fu_pos, 0, 0, 0, t_hi, status, slotted FROM x_tfu
UNION ALL SELECT dataset, patient_id, 'follow_ups_molecular_tests', 0, fu_pos, 0, 0, 0, t_hi, status, true FROM x_tmol
UNION ALL SELECT dataset, patient_id, 'follow_ups_other_clinical_attributes', 0, fu_pos, 0, 0, 0, t_hi, status, true FROM x_toca
""")
ob.cte("x_keep", f"SELECT *, (NOT slotted OR (status NOT IN ('unlocated','non_informative') AND coalesce(t_hi <= {T}::DOUBLE, false))) AS keep FROM x_objects")
ob.cte("x_masked", """
SELECT o.* FROM x_keep o WHERE keep AND (family IN ('diagnoses','follow_ups')
 OR (family LIKE 'diagnoses%' AND EXISTS (SELECT 1 FROM x_keep d WHERE d.family='diagnoses' AND d.keep AND d.dx_pos=o.dx_pos))
 OR (family LIKE 'follow%' AND EXISTS (SELECT 1 FROM x_keep d WHERE d.family='follow_ups' AND d.keep AND d.fu_pos=o.fu_pos)))
""")


@query("f9_slots_passing", f"""
SELECT family, status, count(*) AS n, count_if(status NOT IN ('unlocated','non_informative') AND coalesce(t_hi <= {T}::DOUBLE, false)) AS passing FROM x_objects WHERE slotted GROUP BY ALL
""")
def f9_slots_passing(c: Clinic):
    """F9 landmark predicate and F11 object exclusions."""
    s = None
    for family in timing.TIMED:
        part = c.timed.table(family).where("slotted").select(
            F.lit(family).alias("family"), "status", landmark.passes(T).alias("p")
        )
        s = part if s is None else s.unionByName(part)
    return s.groupBy("family", "status").agg(F.count(F.lit(1)).alias("n"), F.count_if("p").alias("passing"))


@query("f10_masked_cases", "SELECT dataset, family, count(*) AS n, count(DISTINCT patient_id) AS patients FROM x_masked GROUP BY ALL")
def f10_masked_cases(c: Clinic):
    m = landmark.masked(c.timed, T)
    out = None
    for family in timing.TIMED:
        part = m.table(family).select("dataset", F.lit(family).alias("family"), "patient_id")
        out = part if out is None else out.unionByName(part)
    # counted per patient first, so no distinct set grows with a dataset
    per = out.groupBy("dataset", "family", "patient_id").agg(F.count(F.lit(1)).alias("k"))
    return per.groupBy("dataset", "family").agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("patients"))


@query("f13_risk_set", f"""
SELECT dataset, case_id, round(survival_months - {T}::DOUBLE / (365.25::DOUBLE / 12.0::DOUBLE), 6) AS survival_months, censorship FROM x_labels WHERE NOT survival_months * (365.25::DOUBLE / 12.0::DOUBLE) <= {T}::DOUBLE
""")
def f13_risk_set(c: Clinic):
    """F13 risk set and I14 time-origin shift."""
    r = landmark.risk_set(labels(c), T)
    return r.select("dataset", "case_id", F.round("survival_months", 6).alias("survival_months"), "censorship")


@query("a48_risk_set_stats", f"""
SELECT dataset, count(*) AS rows_before, count_if(k) AS rows_after, count(DISTINCT case_id) AS cases_before, count(DISTINCT CASE WHEN k THEN case_id END) AS cases_after,
 count_if(censorship=0) AS events_before, count_if(censorship=0 AND k) AS events_after, count(DISTINCT CASE WHEN NOT k THEN case_id END) AS cases_excluded
FROM (SELECT *, NOT survival_months * (365.25::DOUBLE / 12.0::DOUBLE) <= {T}::DOUBLE AS k FROM x_labels) GROUP BY 1
""")
def a48_risk_set_stats(c: Clinic):
    return landmark.risk_set_stats(labels(c), T)


@query("f8_label_restriction", """
SELECT p.dataset, count(*) AS n_cases, count(l.patient_id) AS n_kept, count(*) - count(l.patient_id) AS n_dropped FROM x_pat p LEFT JOIN x_labels l ON p.patient_id = l.patient_id GROUP BY 1
""")
def f8_label_restriction(c: Clinic):
    lab = labels(c).select("patient_id").distinct()
    kept = c.patients.select("dataset", "patient_id").join(lab, "patient_id", "left_semi")
    dropped = c.patients.select("dataset", "patient_id").join(lab, "patient_id", "left_anti")
    both = kept.withColumn("k", F.lit(1)).unionByName(dropped.withColumn("k", F.lit(0)))
    return both.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n_cases"), F.sum("k").alias("n_kept"), F.sum(1 - F.col("k")).alias("n_dropped")
    )


@query("i10_timed_family", """
SELECT field_path, max(CASE WHEN field_path LIKE 'diagnoses[].treatments[]%' THEN 'diagnoses_treatments' WHEN field_path LIKE 'diagnoses[].pathology%' THEN 'diagnoses_pathology_details' WHEN field_path LIKE 'diagnoses%' THEN 'diagnoses'
 WHEN field_path LIKE '%other_clinical%' THEN 'follow_ups_other_clinical_attributes' WHEN field_path LIKE 'follow_ups%' THEN 'follow_ups' END) AS family, count(*) AS n FROM x_values GROUP BY 1
""")
def i10_timed_family(c: Clinic):
    return c.values.groupBy("field_path", timed_family(F.col("field_path")).alias("family")).agg(F.count(F.lit(1)).alias("n"))


# ---- bank values ------------------------------------------------------------
def _tv(table: str, prefix: str, names: str, extra: str = "t_hi, status, true AS slotted") -> str:
    return " UNION ALL ".join(
        f"SELECT dataset, patient_id, '{prefix}{n}' AS field_path, {pos} AS pos, {val} AS value, {ex} FROM {table}"
        for n, val, pos, ex in [(n, f"CAST({n} AS VARCHAR)", "0" if table == "x_pat" else ("fu_pos" if table in ("x_tfu", "x_toca") else "dx_pos"), extra) for n in names.split()]
    )


def _days(n: str) -> str:
    return f"CAST(CAST({n} AS BIGINT) AS VARCHAR)"


_none = "CAST(NULL AS DOUBLE) AS t_hi, CAST(NULL AS VARCHAR) AS status, false AS slotted"
ob.cte("x_tvalues", " UNION ALL ".join([
    _tv("x_pat", "demographic.", "vital_status age_at_index race", _none),
    f"SELECT dataset, patient_id, 'demographic.days_to_death', 0, {_days('days_to_death')}, {_none} FROM x_pat",
    _tv("x_tdx", "diagnoses[].", "tumor_grade ajcc_pathologic_stage method_of_diagnosis site_of_resection_or_biopsy prior_malignancy year_of_diagnosis"),
    f"SELECT dataset, patient_id, 'diagnoses[].days_to_diagnosis', dx_pos, {_days('days_to_diagnosis')}, t_hi, status, true FROM x_tdx",
    _tv("x_ttx", "diagnoses[].treatments[].", "treatment_type treatment_or_therapy", "t_hi, status, treatment_or_therapy <> 'no' AS slotted"),
    f"SELECT dataset, patient_id, 'diagnoses[].treatments[].days_to_treatment_start', dx_pos, {_days('days_to_treatment_start')}, t_hi, status, treatment_or_therapy <> 'no' FROM x_ttx",
    _tv("x_tpth", "diagnoses[].pathology_details[].", "lymph_nodes_tested lymph_nodes_positive"),
    _tv("x_tfu", "follow_ups[].", "ecog_performance_status", "t_hi, status, slotted"),
    f"SELECT dataset, patient_id, 'follow_ups[].other_clinical_attributes[].bmi', fu_pos, CASE WHEN bmi = floor(bmi) THEN {_days('bmi')} ELSE CAST(bmi AS VARCHAR) END, t_hi, status, true FROM x_toca",
]))
_PASS = f"(status NOT IN ('unlocated','non_informative') AND coalesce(t_hi <= {T}::DOUBLE, false))"
_FLAT = "(field_path LIKE 'diagnoses[].%' AND NOT contains(substr(field_path, 13), '.'))"
_VALID = f"(value IS NOT NULL AND trim(value) <> '' AND lower(trim(value)) NOT IN ({ob.SENTINEL_LIST}))"
_ORDER = "(days_to_diagnosis IS NULL, days_to_diagnosis, diagnosis_is_primary_disease <> 'true', dx_pos)"


def _used(name: str, readable: str, dx_where: str) -> None:
    ob.cte(f"{name}_main", f"SELECT patient_id, arg_min(dx_pos, {_ORDER}) AS main_pos FROM x_tdx {dx_where} GROUP BY 1")
    ob.cte(name, f"""
    SELECT v.* FROM x_tvalues v LEFT JOIN {name}_main m ON v.patient_id = m.patient_id WHERE {_VALID} AND {readable} AND (NOT {_FLAT} OR pos = main_pos)""")
    ob.cte(f"{name}_bank", f"SELECT dataset, field_path, patient_id, string_agg(DISTINCT value, ', ' ORDER BY value) AS value FROM {name} GROUP BY ALL")


_used("x_used", "true", "")
_used("x_usedt", f"(status IS NULL OR (slotted AND {_PASS}))", f"WHERE {_PASS}")
# a slotted child of family "untimed" has a null status only for patient fields


@query("i11_masked_bank_values", "SELECT dataset, field_path, patient_id, value FROM x_usedt_bank")
def i11_masked_bank_values(c: Clinic):
    return landmark.bank_values(landmark.used_values(c.timed, VALUE_FIELDS, T))


@query("a4_landmark_stats", f"""
WITH per AS (SELECT dataset, field_path, patient_id, count(*) AS n FROM x_usedt GROUP BY ALL),
p AS (SELECT dataset, field_path, count(*) AS valid, count_if(n > 1) AS multi FROM per GROUP BY ALL),
m AS (SELECT c.dataset, c.field_path, count(*) AS masked FROM x_collapsed c LEFT JOIN per USING (dataset, field_path, patient_id) WHERE n_valid > 0 AND per.n IS NULL GROUP BY ALL)
SELECT d.dataset, d.field_path, n_patients AS total, coalesce(valid, 0) AS valid, n_patients - coalesce(valid, 0) AS null_count, coalesce(masked, 0) AS masked_count,
 round(coalesce(valid, 0) / CAST(n_patients AS DOUBLE), 6) AS coverage, round(coalesce(multi, 0) / CAST(n_patients AS DOUBLE), 6) AS multi_record_rate
FROM x_dictionary d JOIN x_sizes USING (dataset) LEFT JOIN p USING (dataset, field_path) LEFT JOIN m USING (dataset, field_path)
""")
def a4_landmark_stats(c: Clinic):
    used = landmark.used_values(c.timed, VALUE_FIELDS, T)
    s = stats.field_stats(used, c.dictionary, c.sizes, had=stats.valid_patients(c.families, VALUE_FIELDS))
    return s.select("dataset", "field_path", "total", "valid", "null_count", "masked_count", "coverage", "multi_record_rate")


_TEMPLATES = {
    "demographic.age_at_index": ("int", "Age is {} years."), "diagnoses[].tumor_grade": ("", "Tumor grade is {}."),
    "diagnoses[].ajcc_pathologic_stage": ("", "Stage is {}."), "follow_ups[].ecog_performance_status": ("", "ECOG is {}."),
}


_TEMPLATE_FIELDS = {
    "patients": {"age_at_index": "number"}, "diagnoses": {"tumor_grade": "string", "ajcc_pathologic_stage": "string"},
    "follow_ups": {"ecog_performance_status": "number"},
}


def templates(c: Clinic):
    rows = F.explode(F.array(*[
        F.struct(F.lit(i).cast("long").alias("ord"), F.lit(f).alias("field_path"), F.lit(conv).alias("convert"), F.lit(t).alias("template"))
        for i, (f, (conv, t)) in enumerate(_TEMPLATES.items())
    ]))
    return c.sizes.select("dataset", rows.alias("t")).select("dataset", "t.*")


ob.cte("x_templates", "SELECT * FROM (VALUES " + ", ".join(
    f"({i}, '{f}', '{conv}', '{t}')" for i, (f, (conv, t)) in enumerate(_TEMPLATES.items())) + ") AS t(ord, field_path, conv, template)")


@query("e1_prompt_rows", """
SELECT p.dataset, p.patient_id, t.field_path, replace(template, '{}', coalesce(value, 'not reported')) AS sentence, value IS NOT NULL AS valid
FROM x_pat p CROSS JOIN x_templates t LEFT JOIN x_usedt_bank b ON b.patient_id = p.patient_id AND b.field_path = t.field_path
""")
def e1_prompt_rows(c: Clinic):
    bank = landmark.bank_values(landmark.used_values(c.timed, _TEMPLATE_FIELDS, T))
    return landmark.prompt_rows(c.patients, templates(c), bank)


@query("j7_cell_changes", """
WITH d AS (SELECT coalesce(a.dataset, b.dataset) AS dataset, coalesce(a.field_path, b.field_path) AS field_path, coalesce(a.patient_id, b.patient_id) AS patient_id,
 coalesce(a.value, 'not reported') AS a, coalesce(b.value, 'not reported') AS b FROM x_used_bank a FULL JOIN x_usedt_bank b ON a.field_path = b.field_path AND a.patient_id = b.patient_id)
SELECT dataset, field_path, any_value(n_patients) AS n_patients, count_if(a <> b) AS changed_cells,
 coalesce(arg_min(CASE WHEN a <> b THEN patient_id || ': ' || b || ' -> ' || a END, CASE WHEN a <> b THEN patient_id END), '') AS sample_change,
 count_if(a <> b) > 0 AND field_path LIKE 'demographic%' AS untimed_change FROM d JOIN x_sizes USING (dataset) GROUP BY dataset, field_path
""")
def j7_cell_changes(c: Clinic):
    off = landmark.bank_values(landmark.used_values(c.unplaced, VALUE_FIELDS, None))
    at = landmark.bank_values(landmark.used_values(c.timed, VALUE_FIELDS, T))
    return landmark.cell_changes(off, at, c.patients).drop("family")


# ---- longitudinal -----------------------------------------------------------
ob.cte("x_rec0", f"""
SELECT f.dataset, f.patient_id, f.fu_pos, f.days_to_follow_up AS days, CAST(f.ecog_performance_status AS DOUBLE) AS ecog, o.bmi AS bmi,
 row_number() OVER (PARTITION BY f.patient_id ORDER BY f.days_to_follow_up IS NULL, f.days_to_follow_up, f.fu_pos) - 1 AS idx
FROM x_tfu f JOIN x_toca o ON f.fu_pos = o.fu_pos AND f.patient_id = o.patient_id WHERE slotted AND f.status = 'point' AND f.t_hi <= {T}::DOUBLE
""")
ob.cte("x_rec", """
SELECT dataset, patient_id, idx, fu_pos, days, days - lag(days) OVER w AS days_since, ecog - lag(ecog) OVER w AS ecog_change, bmi - lag(bmi) OVER w AS bmi_change
FROM x_rec0 WINDOW w AS (PARTITION BY patient_id ORDER BY idx)
UNION ALL SELECT dataset, patient_id, 0, NULL, NULL, NULL, NULL, NULL FROM x_pat WHERE patient_id NOT IN (SELECT patient_id FROM x_rec0)
""")


def records(c: Clinic):
    return longitudinal.follow_up_records(c.timed, T, c.tables.rows("events"))


@query("w2_follow_up_records", "SELECT patient_id, idx, fu_pos, days, days_since, ecog_change, round(bmi_change, 6) AS bmi_change FROM x_rec")
def w2_follow_up_records(c: Clinic):
    """W2 ordered records with a placeholder and W3 changes since the previous dated one."""
    r = records(c)
    return r.select("patient_id", "idx", "fu_pos", "days", "days_since", "ecog_change", F.round("bmi_change", 6).alias("bmi_change"))


@query("w15_padded_records", """
WITH w AS (SELECT dataset, max(idx) + 1 AS width FROM x_rec GROUP BY 1), p AS (SELECT DISTINCT dataset, patient_id FROM x_rec)
SELECT dataset, patient_id, o * width + i AS position, (['Days since last follow-up', 'ECOG performance status change', 'Karnofsky performance status change', 'Body mass index change', 'Patient weight change'])[o + 1] || ' is ' ||
 coalesce(CASE WHEN x = floor(x) THEN CAST(CAST(x AS BIGINT) AS VARCHAR) ELSE CAST(x AS VARCHAR) END, 'not reported') || CASE o WHEN 4 THEN ' kg.' ELSE '.' END AS sentence, x IS NOT NULL AS valid
FROM (SELECT p.*, width, o, i, CASE o WHEN 0 THEN days_since WHEN 1 THEN ecog_change WHEN 3 THEN bmi_change END AS x FROM p JOIN w USING (dataset), (SELECT unnest([0, 1, 2, 3, 4]) AS o), LATERAL (SELECT unnest(range(width)) AS i) LEFT JOIN x_rec r ON r.patient_id = p.patient_id AND r.idx = i)
""")
def w15_padded_records(c: Clinic):
    """W15 padding and E9 field-major layout of the derived fields (E10)."""
    from ..functions.numbers import number_label

    r = records(c)
    base = c.sizes.select("dataset", F.lit(-1).cast("long").alias("ord"), F.lit("x").alias("field_path"), F.lit("").alias("convert"), F.lit("").alias("template"))
    tpl = longitudinal.with_derived_fields(base).where("ord >= 0")
    vals = longitudinal.derived_values(r).select(
        "dataset", "patient_id", "field_path", "idx", number_label(F.col("number")).alias("value")
    )
    return longitudinal.padded(r, vals, tpl)


@query("e10_derived_fields", """
SELECT dataset, ord, field_path FROM (SELECT dataset, unnest([0, 1, 2, 3, 4, 5]) AS ord, unnest(['follow_ups[].bmi_change', 'follow_ups[].days_since_last_follow_up', 'follow_ups[].ecog_change', 'follow_ups[].karnofsky_change', '-', 'follow_ups[].weight_change']) AS field_path FROM x_sizes) WHERE field_path <> '-'
""")
def e10_derived_fields(c: Clinic):
    base = c.sizes.select("dataset", F.lit(0).cast("long").alias("ord"), F.lit("follow_ups[].bmi_change").alias("field_path"), F.lit("").alias("convert"), F.lit("").alias("template"))
    return longitudinal.with_derived_fields(base).select("dataset", "ord", "field_path")


_NUMBERS = {"follow_ups[].days_since_last_follow_up": "days_since", "follow_ups[].ecog_change": "ecog_change", "follow_ups[].bmi_change": "bmi_change"}
_RARE = 3
ob.cte("x_recv", " UNION ALL ".join(
    [f"SELECT dataset, patient_id, idx, '{f}' AS field_path, CAST({n} AS DOUBLE) AS x, CAST(NULL AS VARCHAR) AS category FROM x_rec WHERE {n} IS NOT NULL" for f, n in _NUMBERS.items()]
    + ["SELECT r.dataset, r.patient_id, idx, 'follow_ups[].ecog_performance_status', NULL, CAST(ecog_performance_status AS VARCHAR) FROM x_rec r JOIN x_tfu f ON f.fu_pos = r.fu_pos WHERE ecog_performance_status IS NOT NULL"]))
ob.cte("x_recfit", "SELECT dataset, field_path, min(x) AS lo, max(x) AS hi, quantile_cont(x, 0.5) AS mid FROM x_recv WHERE x IS NOT NULL GROUP BY ALL")
ob.cte("x_reccat", f"SELECT dataset, field_path, category, row_number() OVER (PARTITION BY dataset, field_path ORDER BY category) + 1 AS code FROM (SELECT dataset, field_path, category, count(*) AS n FROM x_recv WHERE category IS NOT NULL GROUP BY ALL) WHERE n >= {_RARE}")
ob.cte("x_recschema", """
SELECT *, CAST(coalesce(sum(width) OVER (PARTITION BY dataset ORDER BY field_path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM (
 SELECT dataset, field_path, 'continuous' AS kind, CAST(1 AS BIGINT) AS width, lo, hi, CASE WHEN hi <= lo THEN 0.0 ELSE (mid - lo) / (hi - lo) END AS fill FROM x_recfit
 UNION ALL SELECT v.dataset, v.field_path, 'nominal', 2 + count(DISTINCT code), NULL, NULL, NULL FROM x_recv v LEFT JOIN x_reccat c ON c.dataset = v.dataset AND c.field_path = v.field_path WHERE v.category IS NOT NULL GROUP BY ALL)
""")


def record_encoding(c: Clinic):
    ecog = c.timed.follow_ups.select("dataset", "patient_id", "fu_pos", F.col("ecog_performance_status").cast("string").alias("ecog"))
    r = records(c).join(ecog, ["dataset", "patient_id", "fu_pos"], "left")
    v = longitudinal.record_values(r, _NUMBERS, {"follow_ups[].ecog_performance_status": "ecog"})
    from ..scale import checkpointed

    v = checkpointed(v)
    vocab = longitudinal.record_vocabulary(v, _RARE)
    return v, vocab, longitudinal.record_schema(v, vocab, c.tables.rows("events"))


@query("e9_longitudinal_schema", "SELECT dataset, field_path, kind, width, start, round(lo, 6) AS lo, round(hi, 6) AS hi, round(fill, 6) AS fill FROM x_recschema")
def e9_longitudinal_schema(c: Clinic):
    """Columns of a one-hot record and what its unknown cells hold."""
    _, _, schema = record_encoding(c)
    return schema.select("dataset", "field_path", "kind", "width", "start", *[F.round(x, 6).alias(x) for x in ("lo", "hi", "fill")])


@query("e9_longitudinal_cells", """
SELECT v.dataset, patient_id, idx, v.field_path, CAST(start + CASE WHEN kind = 'nominal' THEN coalesce(code, 1) ELSE 0 END AS BIGINT) AS "column",
 round(CASE WHEN kind = 'nominal' THEN 1.0 WHEN hi <= lo THEN 0.0 ELSE (x - lo) / (hi - lo) END, 6) AS x
FROM x_recv v JOIN x_recschema s ON s.dataset = v.dataset AND s.field_path = v.field_path LEFT JOIN x_reccat k ON k.dataset = v.dataset AND k.field_path = v.field_path AND k.category = v.category
""")
def e9_longitudinal_cells(c: Clinic):
    """E9 one-hot longitudinal encoding, sparse: a row for each known value of each record."""
    v, vocab, schema = record_encoding(c)
    return longitudinal.record_cells(v, vocab, schema).withColumn("x", F.round("x", 6))


# ---- scheme values ----------------------------------------------------------
_MAIN = "arg_min(struct_pack(y := year_of_diagnosis, g := tumor_grade, s := ajcc_pathologic_stage, m := prior_malignancy, t := prior_treatment, r := site_of_resection_or_biopsy, hi := t_hi, st := status), " + _ORDER + ")"
ob.cte("x_main", f"SELECT dataset, patient_id, {_MAIN} AS d FROM x_tdx GROUP BY ALL")
ob.cte("x_smoked", """
SELECT e.dataset, e.patient_id, CASE WHEN exposure_duration_years IS NOT NULL THEN CAST(exposure_duration_years AS BIGINT)
 WHEN tobacco_smoking_quit_year IS NOT NULL THEN CAST(tobacco_smoking_quit_year AS BIGINT) - CAST(tobacco_smoking_onset_year AS BIGINT)
 WHEN tobacco_smoking_onset_year IS NOT NULL THEN d.y - CAST(tobacco_smoking_onset_year AS BIGINT) WHEN age_at_onset IS NOT NULL THEN age_at_index - CAST(age_at_onset AS BIGINT) END AS years,
 exposure_duration_years IS NULL AND tobacco_smoking_quit_year IS NULL AND tobacco_smoking_onset_year IS NOT NULL AND d.y IS NOT NULL AS by_dx
FROM x_exp e JOIN x_pat p ON e.patient_id = p.patient_id LEFT JOIN x_main m ON m.patient_id = e.patient_id
""")
_flat = {"diagnoses[].year_of_diagnosis": "CAST(d.y AS VARCHAR)", "diagnoses[].tumor_grade": "CASE WHEN d.g <> 'Unknown' THEN d.g END", "diagnoses[].ajcc_pathologic_stage": "d.s",
         "diagnoses[].prior_malignancy": "d.m", "diagnoses[].prior_treatment": "d.t", "diagnoses[].site_of_resection_or_biopsy": "nullif(d.r, '')"}
ob.cte("x_found", " UNION ALL ".join(
    ["SELECT dataset, patient_id, 'demographic.age_at_index' AS field_path, CAST(age_at_index AS VARCHAR) AS value FROM x_pat",
     "SELECT dataset, patient_id, 'demographic.race', CASE WHEN race <> 'not reported' THEN race END FROM x_pat"]
    + [f"SELECT dataset, patient_id, '{f}', {v} FROM x_main" for f, v in _flat.items()]
    + [f"SELECT dataset, patient_id, '{p}{n}', string_agg(DISTINCT {v}, ', ' ORDER BY {v}) FROM {t} GROUP BY ALL" for p, n, v, t in [
        ("diagnoses[].pathology_details[].", "lymph_nodes_tested", "CAST(lymph_nodes_tested AS VARCHAR)", "x_pth"),
        ("diagnoses[].pathology_details[].", "lymph_nodes_positive", "CAST(lymph_nodes_positive AS VARCHAR)", "x_pth"),
        ("follow_ups[].", "ecog_performance_status", "CAST(ecog_performance_status AS VARCHAR)", "x_fu"),
        ("follow_ups[].other_clinical_attributes[].", "bmi", "CASE WHEN bmi = floor(bmi) THEN CAST(CAST(bmi AS BIGINT) AS VARCHAR) ELSE CAST(bmi AS VARCHAR) END", "x_oca"),
        ("exposures[].", "pack_years_smoked", "CASE WHEN pack_years_smoked <> 'unknown' THEN pack_years_smoked END", "x_exp")]]
    + [f"SELECT dataset, patient_id, 'derived.{n}_therapy', CASE WHEN bool_or(treatment_or_therapy='yes') THEN 'yes' ELSE 'no' END FROM x_tx WHERE treatment_type = '{k}' GROUP BY ALL"
       for n, k in (("pharmaceutical", "Pharmaceutical Therapy, NOS"), ("radiation", "Radiation Therapy, NOS"))]
    + ["SELECT dataset, patient_id, 'derived.years_smoked', CAST(years AS VARCHAR) FROM x_smoked"]))
_PLACE = "CASE WHEN f = 'diagnoses[].primary_diagnosis' THEN 'Unknown Neoplasm' WHEN f LIKE '%pathologic_t' THEN 'TX' WHEN f LIKE '%pathologic_n' THEN 'NX' WHEN f LIKE '%pathologic_m' THEN 'MX' WHEN f LIKE '%pathologic_stage' THEN 'Stage X' WHEN f IN ('demographic.age_at_index','diagnoses[].age_at_diagnosis','exposures[].pack_years_smoked','exposures[].cigarettes_per_day') OR f LIKE 'derived%' THEN 'unknown' ELSE 'not reported' END"
ob.cte("x_scheme", f"""
SELECT p.dataset, p.patient_id, f AS field_path, coalesce(value, {_PLACE}) AS value, value IS NOT NULL AS valid
FROM x_pat p CROSS JOIN (SELECT unnest([{', '.join(f"'{f}'" for f in extract.SCHEME_FIELDS)}]) AS f) LEFT JOIN x_found v ON v.patient_id = p.patient_id AND v.field_path = f
""")


@query("p18_scheme_values", "SELECT dataset, patient_id, field_path, value, valid FROM x_scheme")
def p18_scheme_values(c: Clinic):
    """P9 joins, P14 primary diagnosis, P15 first value, P16 therapy, P17 years smoked, P18 the whole scheme."""
    # values at any time: nothing is masked, so no object has to be placed in time
    return extract.scheme_values(c.unplaced)


@query("p17_years_smoked", "SELECT patient_id, CAST(years AS VARCHAR) AS value FROM x_smoked WHERE years IS NOT NULL")
def p17_years_smoked(c: Clinic):
    return leak.years_smoked(c.families).select("patient_id", "value")


@query("p14_primary_diagnosis", f"SELECT patient_id, arg_min(dx_pos, {_ORDER}) AS dx_pos FROM x_tdx GROUP BY 1")
def p14_primary_diagnosis(c: Clinic):
    from ..operators.families import primary_diagnosis

    return primary_diagnosis(c.diagnoses, ["dx_pos"]).select("patient_id", "dx_pos")


@query("p19_value_aliases", """
SELECT dataset, patient_id, field_path, CASE WHEN field_path = 'demographic.race' AND value = 'BUILDING' THEN 'building trade' WHEN field_path = 'diagnoses[].tumor_grade' AND value IN ('G3', 'G4') THEN 'High Grade' ELSE value END AS value
FROM x_scheme
""")
def p19_value_aliases(c: Clinic):
    rules = [("demographic.race", "building", "building trade"), ("diagnoses[].tumor_grade", "g3", "High Grade"), ("diagnoses[].tumor_grade", "g4", "High Grade")]
    aliases = c.spark.createDataFrame(rules, "field_path string, key string, canonical string")
    values = extract.scheme_values(c.families)
    return extract.aliased(values, aliases).select("dataset", "patient_id", "field_path", "value")


# ---- leak audit -------------------------------------------------------------
ob.cte("x_src", """
SELECT m.dataset, m.patient_id, f AS field_path, 'diagnoses' AS family, true AS slotted, d.st AS status, d.hi AS t_hi FROM x_main m, (SELECT unnest(['diagnoses[].year_of_diagnosis','diagnoses[].tumor_grade','diagnoses[].ajcc_pathologic_stage','diagnoses[].prior_malignancy','diagnoses[].prior_treatment','diagnoses[].site_of_resection_or_biopsy']) AS f)
UNION ALL SELECT dataset, patient_id, 'diagnoses[].pathology_details[].lymph_nodes_tested', 'diagnoses_pathology_details', true, status, t_hi FROM x_tpth
UNION ALL SELECT dataset, patient_id, 'diagnoses[].pathology_details[].lymph_nodes_positive', 'diagnoses_pathology_details', true, status, t_hi FROM x_tpth
UNION ALL SELECT dataset, patient_id, 'follow_ups[].ecog_performance_status', 'follow_ups', slotted, status, t_hi FROM x_tfu WHERE ecog_performance_status IS NOT NULL
UNION ALL SELECT dataset, patient_id, 'follow_ups[].other_clinical_attributes[].bmi', 'follow_ups_other_clinical_attributes', true, status, t_hi FROM x_toca WHERE bmi IS NOT NULL
UNION ALL SELECT dataset, patient_id, 'exposures[].pack_years_smoked', 'exposures', false, NULL, NULL FROM x_exp WHERE pack_years_smoked <> 'unknown'
UNION ALL SELECT dataset, patient_id, CASE WHEN treatment_type LIKE 'Ph%' THEN 'derived.pharmaceutical_therapy' ELSE 'derived.radiation_therapy' END, 'diagnoses_treatments', treatment_or_therapy <> 'no',
  CASE WHEN treatment_or_therapy <> 'no' THEN status END, CASE WHEN treatment_or_therapy <> 'no' THEN t_hi END FROM x_ttx WHERE treatment_type NOT LIKE 'Surg%'
UNION ALL SELECT dataset, patient_id, 'derived.years_smoked', 'exposures', false, NULL, NULL FROM x_smoked WHERE years IS NOT NULL
UNION ALL SELECT s.dataset, s.patient_id, 'derived.years_smoked', 'diagnoses', true, d.st, d.hi FROM x_smoked s JOIN x_main m ON s.patient_id = m.patient_id WHERE by_dx
""")
ob.cte("x_verdict", """
SELECT *, slotted AND status NOT IN ('unlocated','non_informative') AND (t_hi IS NULL OR t_hi > 0) AS future, slotted AND status NOT IN ('unlocated','non_informative') AND t_hi IS NULL AS lo_only,
 slotted AND status IN ('unlocated','non_informative') AS lost FROM x_src
""")
ob.cte("x_audit", """
WITH per AS (SELECT field_path, patient_id, bool_or(coalesce(future,false)) AS future, bool_or(coalesce(lo_only,false)) AS lo_only, bool_or(coalesce(lost,false)) AS lost, bool_or(NOT slotted) AS untimed,
 count_if(future) AS n_future, max(CASE WHEN future THEN t_hi END) AS hi FROM x_verdict GROUP BY ALL),
fam AS (SELECT dataset, field_path, string_agg(DISTINCT family, ',' ORDER BY family) AS families, string_agg(DISTINCT status, ',' ORDER BY status) AS statuses FROM x_verdict WHERE future GROUP BY ALL)
SELECT s.dataset, s.field_path, count_if(valid) AS n_valid, count_if(valid AND coalesce(future,false)) AS n_leak, count_if(valid AND coalesce(lo_only,false)) AS n_lo_only_source, count_if(valid AND coalesce(lost,false)) AS n_unlocated_source, count_if(valid AND coalesce(untimed,false)) AS n_untimed_source,
 count_if(valid AND future IS NULL) AS n_no_source, count_if(valid AND (coalesce(future,false) OR coalesce(lost,false))) AS n_t0_blocked, CAST(sum(CASE WHEN valid THEN coalesce(n_future, 0) ELSE 0 END) AS BIGINT) AS n_future_sources,
 max(CASE WHEN valid THEN hi END) AS max_source_t_hi
FROM x_scheme s LEFT JOIN per USING (field_path, patient_id) GROUP BY ALL
""")


def audit(c: Clinic):
    values = extract.scheme_values(c.unplaced)
    fields = c.sizes.select("dataset", F.explode(F.array(*[F.lit(f) for f in extract.SCHEME_FIELDS])).alias("field_path"))
    return leak.audit_fields(values.where("valid"), extract.scheme_sources(c.timed), fields)


@query("a22_leak_audit", """
SELECT *, CASE WHEN n_valid > 0 THEN n_leak / CAST(n_valid AS DOUBLE) END AS leak_rate, n_valid = 0 AS leak_rate_undefined FROM x_audit
""")
def a22_leak_audit(c: Clinic):
    """A22 audit over I12 provenance and I13 verdicts; every source found by J5 in the object's own row."""
    return audit(c).drop("source_families", "source_statuses")


@query("i12_value_sources", """
SELECT field_path, family, slotted, status, count(*) AS n, count_if(coalesce(future, false)) AS n_future, count_if(coalesce(lo_only, false)) AS n_lo_only FROM x_verdict GROUP BY ALL
""")
def i12_value_sources(c: Clinic):
    v = leak.with_verdicts(extract.scheme_sources(c.timed))
    return v.groupBy("field_path", "family", "slotted", "status").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("future").alias("n_future"), F.count_if("lo_only").alias("n_lo_only")
    )


ob.cte("x_planted", """
SELECT dataset, patient_id, field_path, CASE WHEN hash_at = 3 THEN value || ' wrong' WHEN hash_at = 5 AND valid THEN 'unknown value' ELSE value END AS value, hash_at IN (3, 5) AND (hash_at = 3 OR valid) AS wrong
FROM (SELECT *, (patient_id + length(field_path)) % 37 AS hash_at FROM x_scheme)
""")


@query("i12_untraced_values", """
SELECT dataset, patient_id, field_path, value FROM x_planted WHERE wrong AND field_path NOT LIKE 'demographic.%' AND field_path <> 'project.project_id'
""")
def i12_untraced_values(c: Clinic):
    """Equality check of values and their sources over values of which some are planted wrong: just these come back."""
    at = (F.col("patient_id") + F.length("field_path")) % 37
    planted = extract.scheme_values(c.timed).withColumn(
        "value", F.when(at == 3, F.concat("value", F.lit(" wrong"))).when((at == 5) & F.col("valid"), "unknown value").otherwise(F.col("value"))
    )
    return extract.provenance_mismatches(planted, extract.source_values(c.timed)).select("dataset", "patient_id", "field_path", "value")


# bank fields: every value with the place of its object, the primary diagnosis alone for flat leaves
ob.cte("x_bank_src", f"""
SELECT *, CASE WHEN field_path LIKE 'demographic.%' THEN NULL WHEN {_FLAT} THEN 'diagnoses' WHEN field_path LIKE 'diagnoses[].treatments%' THEN 'diagnoses_treatments'
 WHEN field_path LIKE 'diagnoses[].path%' THEN 'diagnoses_pathology_details' WHEN field_path LIKE '%attributes%' THEN 'follow_ups_other_clinical_attributes' ELSE 'follow_ups' END AS family,
 coalesce(slotted AND status NOT IN ('unlocated','non_informative') AND (t_hi IS NULL OR t_hi > 0), false) AS future,
 coalesce(slotted AND status NOT IN ('unlocated','non_informative') AND t_hi IS NULL, false) AS lo_only, coalesce(slotted AND status IN ('unlocated','non_informative'), false) AS lost FROM x_used
""")


@query("a22_bank_audit", """
WITH per AS (SELECT dataset, field_path, patient_id, bool_or(future) AS future, bool_or(lo_only) AS lo_only, bool_or(lost) AS lost, bool_or(NOT slotted) AS untimed, count_if(future) AS n_future,
 max(CASE WHEN future THEN t_hi END) AS hi FROM x_bank_src GROUP BY ALL),
a AS (SELECT dataset, field_path, count(*) AS n_valid, count_if(future) AS n_leak, count_if(lo_only) AS n_lo_only_source, count_if(lost) AS n_unlocated_source, count_if(untimed) AS n_untimed_source,
 count_if(future OR lost) AS n_t0_blocked, CAST(sum(n_future) AS BIGINT) AS n_future_sources, max(hi) AS max_source_t_hi FROM per GROUP BY ALL),
s AS (SELECT dataset, field_path, string_agg(DISTINCT family, ',' ORDER BY family) AS source_families, string_agg(DISTINCT status, ',' ORDER BY status) AS source_statuses FROM x_bank_src WHERE future GROUP BY ALL),
f AS (SELECT DISTINCT field_path FROM x_tvalues)
SELECT z.dataset, field_path, n_patients, coalesce(n_valid, 0) AS n_valid, coalesce(n_leak, 0) AS n_leak, coalesce(n_lo_only_source, 0) AS n_lo_only_source, coalesce(n_unlocated_source, 0) AS n_unlocated_source,
 coalesce(n_untimed_source, 0) AS n_untimed_source, CAST(0 AS BIGINT) AS n_no_source, coalesce(n_t0_blocked, 0) AS n_t0_blocked, coalesce(n_future_sources, 0) AS n_future_sources, max_source_t_hi,
 round(CASE WHEN n_valid > 0 THEN n_leak / CAST(n_valid AS DOUBLE) END, 9) AS leak_rate, coalesce(n_valid, 0) = 0 AS leak_rate_undefined,
 coalesce(source_families, '') AS source_families, coalesce(source_statuses, '') AS source_statuses,
 CASE WHEN field_path LIKE 'demographic.%' THEN NULL WHEN field_path LIKE 'diagnoses[].treatments%' THEN 'diagnoses_treatments' WHEN field_path LIKE 'diagnoses[].path%' THEN 'diagnoses_pathology_details'
  WHEN field_path LIKE '%attributes%' THEN 'follow_ups_other_clinical_attributes' WHEN field_path LIKE 'diagnoses%' THEN 'diagnoses' ELSE 'follow_ups' END AS family,
 field_path AS audited_path, 'field_bank' AS audit_mode, 'not reported' AS placeholder
FROM x_sizes z CROSS JOIN f LEFT JOIN a USING (dataset, field_path) LEFT JOIN s USING (dataset, field_path)
""")
def a22_bank_audit(c: Clinic):
    """A22 for bank fields over I12 sources and I13 verdicts: what part of each field's values comes from after day 0."""
    return leak.bank_audit(c.timed, VALUE_FIELDS, c.sizes).withColumn("leak_rate", F.round("leak_rate", 9))


@query("i12_bank_mismatches", """
SELECT dataset, patient_id, field_path, CASE WHEN (patient_id + length(field_path)) % 41 = 7 THEN NULL ELSE value || '?' END AS value, value AS rebuilt FROM x_used_bank
WHERE (patient_id + length(field_path)) % 41 IN (7, 9)
""")
def i12_bank_mismatches(c: Clinic):
    """Bank values against the values of their sources; some are planted wrong and some left out, just these come back."""
    at = (F.col("patient_id") + F.length("field_path")) % 41
    # no verdict on time is asked of the sources: bank and sources are both values at any time
    seen = landmark.readable(c.unplaced, None)
    # written once, so bank and sources read the same tables and the shuffles that bring their texts together serve both
    seen = seen.with_tables({"diagnoses": checkpointed(seen.diagnoses)})
    bank = landmark.bank_values(landmark.used_values(seen, VALUE_FIELDS, None))
    # values are left out of the finished bank: a row number keeps the filter from being moved down to the objects of the bank alone
    kept = bank.withColumn("_row", F.monotonically_increasing_id()).where((at != 7) & (F.col("_row") >= 0)).drop("_row")
    planted = kept.withColumn("value", F.when(at == 9, F.concat("value", F.lit("?"))).otherwise(F.col("value")))
    return leak.bank_mismatches(planted, leak.bank_sources(seen, VALUE_FIELDS, placed=False))


_SCHEMES = {"wide": list(extract.SCHEME_FIELDS), "short": ["demographic.age_at_index", "diagnoses[].tumor_grade", "derived.radiation_therapy"]}


@query("a23_leak_rollup", f"""
WITH a AS (SELECT *, CASE WHEN n_valid > 0 THEN n_leak / CAST(n_valid AS DOUBLE) END AS rate FROM x_audit),
s AS (SELECT 'wide' AS scheme, field_path, dataset FROM a UNION ALL SELECT 'short', field_path, dataset FROM a WHERE field_path IN ('demographic.age_at_index', 'diagnoses[].tumor_grade', 'derived.radiation_therapy'))
SELECT s.dataset, scheme, count(*) AS n_fields, count_if(rate > 0) AS n_leaky, round(count_if(rate > 0) / CAST(count(*) AS DOUBLE), 6) AS leaky_ratio, round(avg(rate), 6) AS mean_leak_rate,
 CAST(sum(n_leak) AS BIGINT) AS n_leak_total, CAST(sum(n_valid) AS BIGINT) AS n_valid_total, CAST(sum(n_t0_blocked) AS BIGINT) AS n_t0_blocked_total, count_if(n_valid = 0) AS n_leak_rate_undefined
FROM s JOIN a USING (dataset, field_path) GROUP BY ALL
""")
def a23_leak_rollup(c: Clinic):
    pairs = F.explode(F.array(*[F.struct(F.lit(s).alias("scheme"), F.lit(f).alias("field_path")) for s, fs in _SCHEMES.items() for f in fs]))
    schemes = c.sizes.select("dataset", pairs.alias("s")).select("dataset", "s.*")
    r = leak.rollup(audit(c), schemes)
    return r.drop("n_not_in_bank").withColumns({"leaky_ratio": F.round("leaky_ratio", 6), "mean_leak_rate": F.round("mean_leak_rate", 6)})


@query("a24_field_payload", """
WITH k AS (SELECT dataset, field_path, row_number() OVER (PARTITION BY dataset ORDER BY field_path) - 1 AS field_idx FROM x_audit)
SELECT dataset, field_idx, field_path, 'G1_' || left(md5(CAST(field_idx AS VARCHAR)), 10) AS scheme, n_valid, round(CASE WHEN n_valid > 0 THEN n_leak / CAST(n_valid AS DOUBLE) END, 6) AS leak_rate FROM k JOIN x_audit USING (dataset, field_path)
""")
def a24_field_payload(c: Clinic):
    names = sorted(extract.SCHEME_FIELDS)
    rows = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("field_idx"), F.lit(f).alias("field_path")) for i, f in enumerate(names)]))
    kept = c.sizes.select("dataset", rows.alias("k")).select("dataset", "k.*")
    return leak.field_payload(audit(c), kept).withColumn("leak_rate", F.round("leak_rate", 6))


@query("a25_leak_tables", """
SELECT field_path, count(rate) AS n_datasets, round(avg(rate), 6) AS mean_leak_rate, round(max(rate), 6) AS max_leak_rate FROM (SELECT *, CASE WHEN n_valid > 0 THEN n_leak / CAST(n_valid AS DOUBLE) END AS rate FROM x_audit)
GROUP BY 1 ORDER BY avg(rate) DESC NULLS LAST, field_path LIMIT 12
""")
def a25_leak_tables(c: Clinic):
    """A25 field leak table and T8 top rows."""
    t = leak.field_table(audit(c), top=12)
    return t.withColumns({"mean_leak_rate": F.round("mean_leak_rate", 6), "max_leak_rate": F.round("max_leak_rate", 6)})
