"""Time location, masks, longitudinal records and the leak audit on cases made for these tests."""

import pytest
from pyspark.sql import functions as F

from chartloom.operators import extract, landmark, leak, longitudinal, timing

GRADE = "diagnoses[].tumor_grade"


def case(pid, diagnoses=(), follow_ups=(), **demographic):
    return {"submitter_id": pid, "demographic": demographic, "diagnoses": list(diagnoses), "follow_ups": list(follow_ups)}


def treated(*starts, **more):
    return {"days_to_diagnosis": 0, "treatments": [{"days_to_treatment_start": s} for s in starts], **more}


def days_of(t):
    rows = timing.slots(t).collect()
    return {(r["patient_id"], r["family"], r["slot"]): r["record_days"] for r in rows}


def test_treatments_are_known_at_the_next_visit(make_families):
    visits = [{"days_to_follow_up": d} for d in (15, 60, 200)]
    got = days_of(timing.timed(make_families([case("K", [treated(3, 15, 61, 400)], visits)])))
    # each start is bounded by the first visit on or after it; day 400 is itself the last that is known of the case
    assert [got[("K", "diagnoses_treatments", i)] for i in (1, 2, 3)] == [15, 15, 200]
    assert got[("K", "diagnoses_treatments", 4)] == 400


def test_refused_treatments_have_no_slot(make_families):
    dx = {"days_to_diagnosis": 0, "treatments": [{"treatment_or_therapy": "no"}, {"days_to_treatment_start": 7}]}
    got = days_of(timing.timed(make_families([case("K", [dx], [{"days_to_follow_up": 9}])])))
    assert [k for k in got if k[1] == "diagnoses_treatments"] == [("K", "diagnoses_treatments", 1)]
    assert got[("K", "diagnoses_treatments", 1)] == 9


def test_coverage_counts_cases_with_a_slot(make_families):
    docs = [case("K", [treated(1, None)], [{"days_to_follow_up": 4}]), case("L", [treated(2)], [{"days_to_follow_up": 8}]), case("M", [treated(None)])]
    cover = timing.slot_coverage(timing.slots(timing.timed(make_families(docs)))).where("family = 'diagnoses_treatments'")
    got = {r["slot"]: (r["ratio"], r["bounded"], r["unlocated"]) for r in cover.collect()}
    assert got == {1: ("2/3", 2, 1), 2: ("0/1", 0, 1)}


def test_endpoints(make_families):
    f = make_families([
        case("K", [{"days_to_diagnosis": 0, "days_to_last_follow_up": 511}], vital_status="Alive"),
        case("L", [{"days_to_diagnosis": 0, "days_to_last_follow_up": 90}], vital_status="Dead", days_to_death=97),
        case("M", follow_ups=[{"days_to_follow_up": 33}, {"days_to_follow_up": 21}], vital_status="Alive"),
    ])
    ctx = timing.case_context(timing.diagnosis_facts(f), f.follow_ups)
    got = {r["patient_id"]: (r["ground_truth_time"], r["event"]) for r in timing.endpoints(f.patients, ctx).collect()}
    assert got == {"K": (511, 0), "L": (97, 1), "M": (33, 0)}


def test_index_date_counts(make_families):
    docs = [{**case("K"), "index_date": "Diagnosis"}, {**case("L"), "index_date": "Diagnosis"}, case("M", [treated(1)])]
    row = timing.index_date_audit(make_families(docs)).first()
    assert (row["n_cases"], row["Diagnosis"], row["missing_key_clinical_content"]) == (3, 2, 1)


def test_one_patient_id_in_two_datasets(make_cases):
    from chartloom.sources.cases import shred

    def cases(dataset):
        return make_cases([case("K", [treated(3, 40)], [{"days_to_follow_up": 5, "other_clinical_attributes": [{"bmi": 20.0}]}])], dataset)

    alone = timing.timed(shred(cases("A")))
    both = timing.timed(shred(cases("A").unionByName(cases("B"))))
    for family in ("diagnoses_treatments", "follow_ups", "diagnoses"):
        one, two = alone.table(family).count(), both.table(family).count()
        assert two == 2 * one
    assert timing.slots(both).count() == 2 * timing.slots(alone).count()
    masked = landmark.masked(both, 10.0)
    assert masked.table("diagnoses_treatments").where("dataset = 'A'").count() == landmark.masked(alone, 10.0).table("diagnoses_treatments").count()
    assert longitudinal.follow_up_records(both, 100).count() == 2 * longitudinal.follow_up_records(alone, 100).count()


def test_changes_between_dated_visits(make_families):
    visits = [
        {"days_to_follow_up": 70, "ecog_performance_status": "2", "other_clinical_attributes": [{"bmi": 31.0, "weight": 88.0}]},
        {"days_to_follow_up": 20, "ecog_performance_status": "0", "other_clinical_attributes": [{"bmi": 30.5, "weight": 90.0}]},
        {"days_to_follow_up": 300, "ecog_performance_status": "4", "other_clinical_attributes": [{"bmi": 1.0, "weight": 1.0}]},
    ]
    t = timing.timed(make_families([case("K", follow_ups=visits), case("L", follow_ups=[{"days_to_follow_up": 101}])]))
    rows = longitudinal.follow_up_records(t, 100).orderBy("patient_id", "idx").collect()
    k = [r for r in rows if r["patient_id"] == "K"]
    assert [(r["days"], r["days_since"], r["ecog_change"], r["bmi_change"], r["weight_change"]) for r in k] == [
        (20, None, None, None, None), (70, 50, 2, 0.5, -2)]
    late = [r for r in rows if r["patient_id"] == "L"]
    assert len(late) == 1 and late[0]["fu_pos"] is None  # its only visit is after the landmark


def graded(pid, grade, day=0, last=None):
    dx = {"tumor_grade": grade, "days_to_diagnosis": day}
    if last is not None:
        dx["days_to_last_follow_up"] = last
    return case(pid, [dx], age_at_index=47)


@pytest.mark.parametrize("docs,valid,leaking,open_ended,latest", [
    ([graded("K", "G1")], 1, 0, 0, None),
    ([graded("K", "G1"), graded("L", "G3", 14)], 2, 1, 1, None),
    ([graded("K", "G2", 5, 77), graded("L", "G3", 6, 91), graded("M", "G4")], 3, 2, 0, 91),
    ([graded("K", "Not Reported", 5, 77), graded("L", "G3", 6, 91)], 1, 1, 0, 91),
])
def test_leak_audit(spark, make_families, docs, valid, leaking, open_ended, latest):
    t = timing.timed(make_families(docs))
    values = extract.scheme_values(t).where("valid")
    fields = spark.createDataFrame([("D", GRADE), ("D", "demographic.age_at_index")], "dataset string, field_path string")
    got = {r["field_path"]: r for r in leak.audit_fields(values, extract.scheme_sources(t), fields).collect()}
    row = got[GRADE]
    assert (row["n_valid"], row["n_leak"], row["n_lo_only_source"], row["max_source_t_hi"]) == (valid, leaking, open_ended, latest)
    age = got["demographic.age_at_index"]
    assert (age["n_valid"], age["n_leak"], age["n_no_source"]) == (len(docs), 0, len(docs))


def test_values_unlike_their_sources_are_reported(make_families):
    first = {"tumor_grade": "G1", "days_to_diagnosis": 0, "diagnosis_is_primary_disease": "true",
             "treatments": [{"treatment_type": "Radiation Therapy, NOS", "treatment_or_therapy": x} for x in ("no", "yes")]}
    other = {"tumor_grade": "G4", "days_to_diagnosis": 90, "diagnosis_is_primary_disease": "false"}
    visits = [{"ecog_performance_status": x} for x in ("1", "0", "1")]
    t = timing.timed(make_families([case("K", [other, first], follow_ups=visits), case("L", [{"tumor_grade": "G2"}])]))
    values, sources = extract.scheme_values(t), extract.source_values(t)
    assert extract.provenance_mismatches(values, sources).count() == 0
    wrong = {GRADE: "G4", "follow_ups[].ecog_performance_status": "1", "derived.radiation_therapy": "no"}
    planted = values.withColumn("value", F.coalesce(*[
        F.when((F.col("patient_id") == "K") & (F.col("field_path") == f), v) for f, v in wrong.items()
    ], "value"))
    got = {(r["patient_id"], r["field_path"]): r["value"] for r in extract.provenance_mismatches(planted, sources).collect()}
    assert got == {("K", f): v for f, v in wrong.items()}


def test_masks_keep_what_has_no_slot(make_families):
    refused = {"treatment_type": "Radiation Therapy, NOS", "treatment_or_therapy": "no", "days_to_treatment_start": 33}
    dx = {"days_to_diagnosis": 0, "diagnosis_is_primary_disease": "true", "treatments": [refused]}
    undated = case("L", [{"tumor_grade": "G2"}])
    t = timing.timed(make_families([case("K", [dx]), undated]))

    def pick(at):
        return {(r["patient_id"], r["field_path"]): r["value"] for r in extract.scheme_values(t, at).collect()}

    raw, masked = pick(None), pick(0.0)
    assert raw[("K", "derived.radiation_therapy")] == masked[("K", "derived.radiation_therapy")] == "no"
    assert raw[("L", GRADE)] == "G2" and masked[("L", GRADE)] != "G2"


def test_a_leaf_missing_on_the_main_diagnosis_is_read_elsewhere(make_families):
    second = {"days_to_diagnosis": 8, "site_of_resection_or_biopsy": "Lung"}
    absent = case("K", [{"days_to_diagnosis": 1}, second])
    empty = case("L", [{"days_to_diagnosis": 1, "site_of_resection_or_biopsy": None}, second])
    t = timing.timed(make_families([absent, empty]))
    used = landmark.used_values(t, {"diagnoses": {"site_of_resection_or_biopsy": "string"}}, None)
    assert {r["patient_id"]: r["value"] for r in landmark.bank_values(used).collect()} == {"K": "Lung"}


def test_time_origin_moves_to_the_landmark(spark):
    month = 365.25 / 12
    given = {"a": 1.0, "b": 90 / month, "c": 91 / month, "d": 24.0, "e": None}
    df = spark.createDataFrame([("D", k, m, 1) for k, m in given.items()], "dataset string, case_id string, survival_months double, censorship int")
    got = {r["case_id"]: r["survival_months"] for r in landmark.risk_set(df, 90).collect()}
    assert "a" not in got and got["e"] is None
    assert got["c"] == pytest.approx(1 / month, abs=1e-9) and got["d"] == pytest.approx(24 - 90 / month, abs=1e-9)


def test_years_smoked_before_the_diagnosis(make_families):
    doc = {**case("K", [{"year_of_diagnosis": 2011}], age_at_index=71),
           "exposures": [{}, {"tobacco_smoking_onset_year": 1978, "tobacco_smoking_quit_year": 1999}]}
    f = make_families([doc])
    assert leak.years_smoked(f).first()["value"] == "21"
    wide = extract.scheme_wide(extract.scheme_values(f)).first()
    assert (wide["derived.years_smoked"], wide["demographic.age_at_index"]) == ("21", "71")


def test_parse_time(spark):
    given = ["2019-12-31T22:30:00-05:00", "2021-06-01T12:00:00Z", "2021-06-01T12:00:00", "soon"]
    df = spark.createDataFrame([(x,) for x in given], "t string")
    got = [str(r[0]) for r in df.select(timing.parse_time(F.col("t"))).collect()]
    assert got == ["2020-01-01 03:30:00", "2021-06-01 12:00:00", "2021-06-01 12:00:00", "None"]
