"""Leak audit of bank fields and one-hot longitudinal records on cases made for these tests."""

import pytest
from pyspark.sql import functions as F

from chartloom.operators import landmark, leak, longitudinal, timing

FIELDS = {"patients": {"race": "string"}, "diagnoses": {"tumor_grade": "string"}, "diagnoses_treatments": {"treatment_type": "string"}}
GRADE, KIND = "diagnoses[].tumor_grade", "diagnoses[].treatments[].treatment_type"


def case(pid, diagnoses=(), follow_ups=(), **demographic):
    return {"submitter_id": pid, "demographic": demographic, "diagnoses": list(diagnoses), "follow_ups": list(follow_ups)}


@pytest.fixture(scope="module")
def timed(make_families):
    late = {"days_to_diagnosis": 70, "tumor_grade": "G4"}
    drug = [{"treatment_type": "Drug A", "days_to_treatment_start": 40}, {"treatment_type": "Drug A", "days_to_treatment_start": -3}, {"treatment_type": " "}]
    return timing.timed(make_families([
        case("K", [late, {"days_to_diagnosis": 0, "tumor_grade": "G2", "treatments": drug}], [{"days_to_follow_up": 60}], race="white"),
        case("L", [{"days_to_diagnosis": 0, "treatments": [{"treatment_type": "Drug B"}]}, late], race="unknown"),
        case("M", [{"days_to_diagnosis": 0, "tumor_grade": "Unknown"}]),
    ]))


def sizes(t):
    return t.patients.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_patients"))


def test_bank_sources_carry_the_place_of_their_object(timed):
    got = sorted((r["patient_id"], r["field_path"], r["family"], r["t_hi"], r["value"]) for r in leak.bank_sources(timed, FIELDS).collect() if r["field_path"] != KIND)
    # K reads its primary diagnosis only; L's lacks the leaf, so all of its diagnoses are read (the last one with no
    # upper bound, as nothing is known of L after day 70); M's value says nothing
    assert got == [("K", "demographic.race", None, None, "white"), ("K", GRADE, "diagnoses", 0.0, "G2"), ("L", GRADE, "diagnoses", None, "G4")]
    drugs = [(r["patient_id"], r["t_hi"]) for r in leak.bank_sources(timed, FIELDS).where(F.col("field_path") == KIND).collect()]
    assert sorted(d for d in drugs if d[0] == "K") == [("K", 60.0), ("K", 60.0)]


def test_bank_audit(timed):
    rows = {r["field_path"]: r for r in leak.bank_audit(timed, FIELDS, sizes(timed)).collect()}
    race, grade, kind = rows["demographic.race"], rows[GRADE], rows[KIND]
    assert (race["n_patients"], race["n_valid"], race["n_leak"], race["n_untimed_source"], race["family"]) == (3, 1, 0, 1, None)
    assert (grade["n_valid"], grade["n_leak"], grade["leak_rate"], grade["n_lo_only_source"], grade["family"]) == (2, 1, 0.5, 1, "diagnoses")
    assert (grade["max_source_t_hi"], kind["max_source_t_hi"]) == (None, 60.0)
    assert (kind["n_valid"], kind["n_leak"], kind["n_future_sources"], kind["source_families"]) == (2, 1, 2, "diagnoses_treatments")
    assert {(r["audited_path"], r["audit_mode"], r["placeholder"]) for r in rows.values()} == {(p, "field_bank", "not reported") for p in rows}


def test_bank_mismatches_find_planted_values(timed):
    bank = landmark.bank_values(landmark.used_values(timed, FIELDS, None))
    sources = leak.bank_sources(timed, FIELDS)
    assert leak.bank_mismatches(bank, sources).count() == 0
    wrong = bank.where(F.col("field_path") != "demographic.race").withColumn("value", F.when(F.col("field_path") == GRADE, "G9").otherwise(F.col("value")))
    got = {(r["patient_id"], r["field_path"], r["value"], r["rebuilt"]) for r in leak.bank_mismatches(wrong, sources).collect()}
    assert got == {("K", GRADE, "G9", "G2"), ("L", GRADE, "G9", "G4"), ("K", "demographic.race", None, "white")}


def test_fields_without_values_have_a_row(timed):
    none = leak.bank_audit(timed, {"diagnoses": {"tumor_grade": "string"}}, sizes(timed).withColumn("dataset", F.lit("other")))
    row = none.first()
    assert (row["n_valid"], row["leak_rate"], row["leak_rate_undefined"]) == (0, None, True)


def test_one_hot_records(spark):
    rows = [("D", "a", 0, None, "x"), ("D", "a", 1, 4.0, "x"), ("D", "a", 2, 8.0, "y"), ("D", "b", 0, 6.0, None), ("E", "c", 0, 5.0, "x"), ("E", "d", 0, None, None)]
    records = spark.createDataFrame(rows, "dataset string, patient_id string, idx long, days double, grade string")
    v = longitudinal.record_values(records, {"f.days": "days", "f.absent": "nothing"}, {"f.grade": "grade"})
    vocab = longitudinal.record_vocabulary(v, threshold=2)
    schema = longitudinal.record_schema(v, vocab)
    got = {(r["dataset"], r["field_path"]): (r["kind"], r["width"], r["start"], r["lo"], r["hi"], r["fill"]) for r in schema.collect()}
    assert got == {
        ("D", "f.days"): ("continuous", 1, 0, 4.0, 8.0, 0.5), ("D", "f.grade"): ("nominal", 3, 1, None, None, None),
        ("E", "f.days"): ("continuous", 1, 0, 5.0, 5.0, 0.0), ("E", "f.grade"): ("nominal", 2, 1, None, None, None),
    }
    cells = sorted(tuple(r) for r in longitudinal.record_cells(v, vocab, schema).collect())
    assert cells == [
        ("D", "a", 0, "f.grade", 3, 1.0), ("D", "a", 1, "f.days", 0, 0.0), ("D", "a", 1, "f.grade", 3, 1.0), ("D", "a", 2, "f.days", 0, 1.0),
        ("D", "a", 2, "f.grade", 2, 1.0), ("D", "b", 0, "f.days", 0, 0.5), ("E", "c", 0, "f.days", 0, 0.0), ("E", "c", 0, "f.grade", 2, 1.0),
    ]
    assert longitudinal.record_cells(v.limit(0), vocab, schema).count() == 0
