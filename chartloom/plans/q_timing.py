"""Queries on time location: intervals, slots, endpoints and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import timing
from ..scale import checkpointed
from .clinical import Clinic
from .registry import query


def family_times(c: Clinic, family: str, *columns):
    df = c.timed.table(family).where("slotted")
    return df.select("patient_id", *columns, "t_lo", "t_hi", "status")


@query("i3_diagnosis_intervals", "SELECT patient_id, dx_pos, t_lo, t_hi, status FROM x_tdx")
def i3_diagnosis_intervals(c: Clinic):
    """I1-I3: status, upper bound chain with the next follow-up (J6), diagnosis rule."""
    return family_times(c, "diagnoses", "dx_pos")


@query("i4_treatment_intervals", """
SELECT patient_id, dx_pos, n1 AS line, n2 AS part, n3 AS supp, t_lo, t_hi, status FROM x_ttx WHERE treatment_or_therapy <> 'no'
""")
def i4_treatment_intervals(c: Clinic):
    at = lambda i: F.element_at("pos", i)
    return family_times(c, "diagnoses_treatments", "dx_pos", at(2).alias("line"), at(3).alias("part"), at(4).alias("supp"))


@query("i5_pathology_intervals", "SELECT patient_id, dx_pos, t_lo, t_hi, status FROM x_tpth")
def i5_pathology_intervals(c: Clinic):
    return family_times(c, "diagnoses_pathology_details", "dx_pos")


@query("i6_follow_up_intervals", "SELECT patient_id, fu_pos, t_lo, t_hi, status FROM x_tfu WHERE slotted")
def i6_follow_up_intervals(c: Clinic):
    return family_times(c, "follow_ups", "fu_pos")


@query("i7_molecular_intervals", "SELECT patient_id, fu_pos, t_lo, t_hi, status FROM x_tmol")
def i7_molecular_intervals(c: Clinic):
    return family_times(c, "follow_ups_molecular_tests", "fu_pos")


@query("i8_other_attribute_intervals", "SELECT patient_id, fu_pos, t_lo, t_hi, status FROM x_toca")
def i8_other_attribute_intervals(c: Clinic):
    return family_times(c, "follow_ups_other_clinical_attributes", "fu_pos")


@query("w1_slot_numbers", """
SELECT patient_id, family, slot, t_lo, t_hi, status, record_days, strftime(updated_at, '%Y-%m-%d %H:%M:%S.%f') AS write_at FROM x_slots
""")
def w1_slot_numbers(c: Clinic):
    """W1 numbering and I9 slot rows."""
    s = timing.slots(c.timed, c.bound)
    return s.select("patient_id", "family", "slot", "t_lo", "t_hi", "status", "record_days", F.date_format("write_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("write_at"))


@query("a15_slot_coverage", """
SELECT family, slot, count(record_days) AS covered, count(*) AS present, count(*) - count(record_days) AS excluded, count(record_days) || '/' || count(*) AS ratio,
 count_if(status='point') AS point, count_if(status='bounded') AS bounded, count_if(status='lo_only') AS lo_only, count_if(status='unlocated') AS unlocated,
 count_if(status='non_informative') AS non_informative FROM x_slots GROUP BY ALL
""")
def a15_slot_coverage(c: Clinic):
    return timing.slot_coverage(timing.slots(c.timed, c.bound))


@query("a16_wide_slots", """
SELECT dataset, patient_id, 'diagnoses_record' || slot AS "column", record_days AS value FROM x_slots WHERE family = 'diagnoses'
""")
def a16_wide_slots(c: Clinic):
    return timing.slot_cells(timing.slots(c.timed, c.bound, ["diagnoses"]), "diagnoses")


@query("a11_case_context", """
SELECT dataset, patient_id, last_fu AS last_follow_up, th2, adj_start AS adjuvant_start, tx_first, surg AS surgery_first, res_ev AS resection_evidence,
 prior_case AS prior_malignancy_case, main_class, len(follow_days) AS n_follow_days FROM x_ctx
""")
def a11_case_context(c: Clinic):
    """A11 case context and A14 pathology class of the case."""
    ctx = c.context
    return ctx.select(
        "dataset", "patient_id", "last_follow_up", "th2", "adjuvant_start", "tx_first", "surgery_first",
        "resection_evidence", "prior_malignancy_case", "main_class", "n_follow_days",
    )


@query("a14_pathology_class", "SELECT patient_id, dx_pos, path_class, is_prior, evidence FROM x_dxf")
def a14_pathology_class(c: Clinic):
    return c.facts.select("patient_id", "dx_pos", "path_class", "is_prior", "evidence")


def ends(c: Clinic):
    return timing.endpoints(c.patients, c.context)


def labels(c: Clinic):
    """Label table of the mapping: patients with an endpoint, in months."""
    e = ends(c).where("ground_truth_time is not null and event is not null")
    return e.select(
        "dataset", F.concat(F.lit("C"), F.col("patient_id").cast("string")).alias("case_id"), "patient_id",
        (F.col("ground_truth_time") / F.lit(365.25 / 12.0)).alias("survival_months"), (1 - F.col("event")).alias("censorship"),
    )


@query("a12_endpoints", """
SELECT dataset, patient_id, vital_status, event, gt AS ground_truth_time, src AS ground_truth_source, last_fu AS days_to_last_follow_up, days_to_death FROM x_ends
""")
def a12_endpoints(c: Clinic):
    return ends(c)


@query("a13_year_of_diagnosis", """
SELECT dataset, patient_id, coalesce(min(CASE WHEN diagnosis_is_primary_disease = 'true' OR classification_of_tumor = 'primary' THEN year_of_diagnosis END), min(year_of_diagnosis)) AS year_of_diagnosis
FROM x_dx GROUP BY ALL
""")
def a13_year_of_diagnosis(c: Clinic):
    return timing.year_of_diagnosis(c.diagnoses)


@query("a17_index_date_audit", """
WITH d AS (SELECT patient_id, count_if(diagnosis_is_primary_disease='true' AND days_to_diagnosis IS NULL) AS m, count_if(diagnosis_is_primary_disease='true' AND days_to_diagnosis = 0) AS z,
 count_if(diagnosis_is_primary_disease='true' AND days_to_diagnosis <> 0) AS nz FROM x_dx GROUP BY 1),
g AS (SELECT dataset, count(*) AS n_cases, count_if(index_date='Diagnosis') AS "Diagnosis", count_if(index_date='First Treatment') AS "First Treatment",
 count_if(index_date IS NULL) AS missing_key_clinical_content, CAST(sum(CASE WHEN index_date='Diagnosis' THEN coalesce(z,0) ELSE 0 END) AS BIGINT) AS primary_dtd_zero,
 CAST(sum(CASE WHEN index_date='Diagnosis' THEN coalesce(nz,0) ELSE 0 END) AS BIGINT) AS primary_dtd_nonzero, CAST(sum(CASE WHEN index_date='Diagnosis' THEN coalesce(m,0) ELSE 0 END) AS BIGINT) AS primary_dtd_missing
 FROM x_pat LEFT JOIN d USING (patient_id) GROUP BY 1)
SELECT *, concat_ws(', ', CASE WHEN "Diagnosis" > 0 AND "First Treatment" > 0 THEN 'mixed_index_date' END, CASE WHEN "First Treatment" > 0 THEN 'non_diagnosis_index_date' END,
 CASE WHEN missing_key_clinical_content > 0 THEN 'index_date_missing_clinical' END, CASE WHEN primary_dtd_nonzero / (primary_dtd_zero + primary_dtd_nonzero) >= 0.2 THEN 'day0_not_primary' END) AS flags FROM g
""")
def a17_index_date_audit(c: Clinic):
    a = timing.index_date_audit(c.families)
    return a.select(
        "dataset", "n_cases", "Diagnosis", "First Treatment", "missing_key_clinical_content",
        "primary_dtd_zero", "primary_dtd_nonzero", "primary_dtd_missing", "flags",
    )


@query("a17_index_date_flagged", """
SELECT p.dataset, p.patient_id, coalesce(index_date, '') AS index_date, coalesce(n, 0) AS n_diagnoses, CASE WHEN index_date IS NULL THEN 'index_date_missing_clinical' ELSE 'non_diagnosis_index_date' END AS flag
FROM x_pat p LEFT JOIN (SELECT patient_id, count(*) AS n FROM x_dx GROUP BY 1) d ON p.patient_id = d.patient_id WHERE index_date IS NULL OR index_date <> 'Diagnosis'
""")
def a17_index_date_flagged(c: Clinic):
    return timing.index_date_flagged(c.families)


@query("a18_event_summary", """
SELECT e.dataset, count(*) AS n_patients, count_if(event=1) AS n_event, count_if(event=0) AS n_censored, count_if(event IS NULL) AS n_unknown,
 round(count_if(event=1) / CAST(count(event) AS DOUBLE), 4) AS event_rate, count_if(event=1 AND gt IS NULL) AS n_event_no_time, count_if(event=0 AND gt IS NULL) AS n_censored_no_time,
 count_if(gt <= 0) AS n_gt_le_0, count_if(gt < 0) AS n_gt_lt_0, count_if(event=1 AND gt=0) AS n_event_gt_0, count_if(event=0 AND gt=0) AS n_censored_gt_0, count_if(event IS NULL AND gt=0) AS n_unknown_gt_0,
 any_value(nl) AS n_label_patients, any_value(ne) AS n_event_label, any_value(nc) AS n_censored_label
FROM x_ends e LEFT JOIN (SELECT dataset, count(*) AS nl, count_if(censorship=0) AS ne, count_if(censorship=1) AS nc FROM x_labels GROUP BY 1) l ON e.dataset = l.dataset GROUP BY e.dataset
""")
def a18_event_summary(c: Clinic):
    return timing.event_summary(ends(c), labels(c))


@query("a19_event_table", """
SELECT patient_id, event, gt AS ground_truth_time, CASE WHEN gt < 0 THEN 'negative' WHEN gt = 0 AND event IS NULL THEN 'unknown_0' WHEN gt = 0 AND event = 1 THEN 'event_0' WHEN gt = 0 THEN 'censored_0' END AS category FROM x_ends
""")
def a19_event_table(c: Clinic):
    """A19 patient events and F15 categories at or before day 0."""
    return timing.event_table(ends(c)).select("patient_id", "event", "ground_truth_time", "category")


@query("a20_label_gate", """
SELECT dataset, count(*) AS n_patients, count_if(survival_months <= 0) AS n_gt_le_0, count_if(survival_months < 0) AS n_gt_lt_0, count_if(censorship=0 AND survival_months=0) AS n_event_0,
 count_if(censorship=1 AND survival_months=0) AS n_censored_0, count_if(survival_months IS NULL) AS n_no_time FROM x_labels GROUP BY 1
""")
def a20_label_gate(c: Clinic):
    return timing.label_gate(labels(c))


@query("a21_main_set", """
SELECT dataset, count(*) AS n_label_patients, count_if(censorship=0) AS n_event_label, count_if(censorship=1) AS n_censored_label FROM x_labels GROUP BY 1 HAVING count_if(censorship=0) >= 20
""")
def a21_main_set(c: Clinic):
    """A21 label events and F16 main-set threshold."""
    return timing.main_set(labels(c), 20)


@query("w10_normalized_write_times", """
WITH f AS (SELECT patient_id, min(updated_at) AS m FROM x_slots WHERE updated_at IS NOT NULL GROUP BY 1)
SELECT s.patient_id, family, slot, last AS last_time_days, CASE WHEN last <> 0 THEN round((epoch_us(updated_at) - epoch_us(m)) / 86400000000.0::DOUBLE / last, 6) + 0.0::DOUBLE END AS share
FROM x_slots s JOIN f USING (patient_id) JOIN (SELECT patient_id, CASE WHEN vital_status='Dead' THEN days_to_death ELSE last_fu END AS last FROM x_ends) USING (patient_id) WHERE updated_at IS NOT NULL
""")
def w10_normalized_write_times(c: Clinic):
    s = timing.slots(c.timed, c.bound)
    return timing.normalized_times(s, ends(c), "write").drop("dataset")


@query("w11_normalized_record_times", """
SELECT patient_id, family, slot, last AS last_time_days, CASE WHEN last <> 0 THEN round(record_days / last, 6) + 0.0::DOUBLE END AS share
FROM x_slots JOIN (SELECT patient_id, CASE WHEN vital_status='Dead' THEN days_to_death ELSE last_fu END AS last FROM x_ends) USING (patient_id) WHERE record_days IS NOT NULL
""")
def w11_normalized_record_times(c: Clinic):
    return timing.normalized_times(timing.slots(c.timed, c.bound), ends(c), "record").drop("dataset")
