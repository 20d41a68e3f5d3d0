"""Work that would grow faster than the input: tables built for nothing, swarms of ranges, inputs read again and again."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from chartloom.operators import encode, landmark, stats, survival, timing
from chartloom.operators.families import Families
from chartloom.plans import q_encode, q_landmark
from chartloom.plans.clinical import VALUE_FIELDS, Clinic
from chartloom.scale import HOT_ROWS, _ranges, _split, ordered_columns


class _Untouched:
    """Time locations nobody may ask for."""

    def __getattr__(self, name):
        raise AssertionError(f"{name} was placed in time")


@pytest.fixture
def clinic(spark):
    who, pos = "dataset string, patient_id long, ", ", pos array<long>"
    people = [(None if i == 3 else "DS0", i) for i in range(4)]
    tables = {
        "patients": ([(*p, "Dead", 3.0, 40 + p[1], "WHITE") for p in people], who + "vital_status string, days_to_death double, age_at_index int, race string"),
        "diagnoses": (
            [(*p, 10 + p[1], [10 + p[1]], 0.0, "true", "G1", "Stage I", "Biopsy", "Lung", "no", "no", 2000, "primary") for p in people],
            who + "dx_pos long" + pos + ", days_to_diagnosis double, diagnosis_is_primary_disease string, tumor_grade string, ajcc_pathologic_stage string, "
            "method_of_diagnosis string, site_of_resection_or_biopsy string, prior_malignancy string, prior_treatment string, year_of_diagnosis int, classification_of_tumor string",
        ),
        "treatments": (
            [(*p, 10 + p[1], [10 + p[1], k], t, "yes", 5.0) for p in people for k, t in enumerate(("Radiation  Therapy", "radiation therapy", "Not \t Reported", "un known"))],
            who + "dx_pos long" + pos + ", treatment_type string, treatment_or_therapy string, days_to_treatment_start double",
        ),
        "pathology_details": ([(*p, 10 + p[1], [10 + p[1]], 5, 1) for p in people], who + "dx_pos long" + pos + ", lymph_nodes_tested long, lymph_nodes_positive long"),
        "follow_ups": ([(*p, 20, [20], 1) for p in people], who + "fu_pos long" + pos + ", ecog_performance_status int"),
        "other_attributes": ([(*p, 20, [20], 22.5) for p in people], who + "fu_pos long" + pos + ", bmi double"),
    }
    c = Clinic(spark, "")
    c.__dict__["families"] = Families(**{n: spark.createDataFrame(rows, schema) for n, (rows, schema) in tables.items()}, exposures=None, molecular_tests=None)
    c.__dict__["timed"] = _Untouched()
    return c


def test_values_at_any_time_need_no_time_location(clinic):
    t = q_encode.tokens(clinic)
    got = {(r["dataset"], r["patient_id"], r["field_path"]): r["category"] for r in encode.patient_categories(t).collect()}
    path = "diagnoses[].treatments[].treatment_type"
    assert got["DS0", 0, path] == "radiation therapy | un known"
    # nobody's objects have no place in time, so their values never counted
    assert (None, 3, path) not in got and (None, 3, "follow_ups[].ecog_performance_status") in got
    vocabulary = q_encode.a27_dataset_vocabulary(clinic)
    assert vocabulary.where(F.col("field_path") == path).count() == 2
    scheme = q_landmark.p18_scheme_values(clinic).where("field_path = 'diagnoses[].tumor_grade'").collect()
    assert sorted((r["patient_id"], r["value"], r["valid"]) for r in scheme) == [(0, "G1", True), (1, "G1", True), (2, "G1", True), (3, "not reported", False)]


def test_slots_of_one_family_build_no_other(spark):
    dx = spark.createDataFrame(
        [("DS0", 1, [2], 0.0, 0.0, "point", True), ("DS0", 1, [1], None, None, "unlocated", True), ("DS0", 1, [3], None, None, "unlocated", False)],
        "dataset string, patient_id long, pos array<long>, t_lo double, t_hi double, status string, slotted boolean",
    )

    def build():
        raise AssertionError("a family nobody asked for was built")

    t = Families(diagnoses=dx, **{n: build for n in ("patients", "treatments", "pathology_details", "follow_ups", "molecular_tests", "other_attributes")})
    cells = timing.slot_cells(timing.slots(t, families=["diagnoses"]), "diagnoses").collect()
    assert sorted((r["column"], r["value"]) for r in cells) == [("diagnoses_record1", None), ("diagnoses_record2", 0.0)]


def test_small_limits_make_no_swarm_of_ranges(spark):
    df = spark.range(3000).select((F.col("id") % 2).alias("g"), F.col("id").alias("x"), F.lit(1).alias("n"))
    ordinary, cut = _split(df, ["g"], ["x"], None, 10)
    assert cut.select("_range").distinct().count() <= 64
    # ranges of the usual limit stay well under it at any size
    assert _ranges(100 * HOT_ROWS, HOT_ROWS) == 400 and 4000 * HOT_ROWS / _ranges(4000 * HOT_ROWS, 40) <= HOT_ROWS
    out = ordered_columns(df, ["g"], ["x"], {"s": ("sum", "n"), "p": ("lag", "x")}, None, 10)
    assert out.where("s <> (x - g) / 2 + 1 or p <> x - 2 or (p is null) <> (x < 2)").count() == 0 and out.count() == 3000


def test_concordance_reads_its_rows_once_when_cut(spark):
    read = spark.sparkContext.accumulator(0)

    def told(batches):
        for b in batches:
            read.add(len(b))
            yield b

    rows = spark.createDataFrame([(i % 2, float(i % 17), i % 3 == 0, float(i % 5)) for i in range(200)], "g int, time double, event boolean, risk double")
    seen = rows.mapInPandas(told, rows.schema)
    cut = survival.concordance(seen, ["g"], rows=None, limit=10).collect()
    assert read.value == 200
    assert sorted(map(tuple, cut)) == sorted(map(tuple, survival.concordance(rows, ["g"], rows=200).collect()))


def test_bank_and_its_sources_come_together_once(spark, clinic, tmp_path):
    # as read from the shared folder: one table gives one plan
    for name in ("patients", "diagnoses", "treatments", "pathology_details", "follow_ups", "other_attributes"):
        getattr(clinic.families, name).write.parquet(str(tmp_path / name))
    tables = {n: (lambda n=n: spark.read.parquet(str(tmp_path / n))) for n in ("patients", "diagnoses", "treatments", "pathology_details", "follow_ups", "other_attributes")}
    clinic.__dict__["families"] = Families(**tables, molecular_tests=None)
    # the clinic of this test fails if time locations are asked for
    found = q_landmark.i12_bank_mismatches(clinic)
    rows = found.collect()
    bank = landmark.bank_values(landmark.used_values(clinic.unplaced, VALUE_FIELDS, None)).collect()
    at = {(r["dataset"], r["patient_id"], r["field_path"]): ((r["patient_id"] + len(r["field_path"])) % 41, r["value"]) for r in bank}
    want = {(*k, None if a == 7 else v + "?", v) for k, (a, v) in at.items() if a in (7, 9)}
    # keys without a dataset don't meet in the join, so such values miss each other
    named = {tuple(r) for r in rows if r["dataset"] is not None}
    assert named == {w for w in want if w[0] is not None} and len(named) == len([r for r in rows if r["dataset"] is not None]) > 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan


def test_landmark_stats_read_their_values_once(spark):
    read = spark.sparkContext.accumulator(0)

    def told(batches):
        for b in batches:
            read.add(len(b))
            yield b

    schema = "dataset string, patient_id long, field_path string, value string, number double, kind string"
    path = "demographic.race"
    values = spark.createDataFrame([("D", 1, path, "white", None, "string"), ("D", 1, path, "white", None, "string"), ("D", None, path, "x", None, "string")], schema)
    people = spark.createDataFrame(
        [("D", 1, "white"), ("D", 2, " asian "), ("D", 3, " Unknown"), ("D", 4, None), ("D", None, "x"), (None, 5, "x")], "dataset string, patient_id long, race string"
    )
    had = stats.valid_patients(Families(patients=people), {"patients": {"race": "string"}})
    assert sorted((r["dataset"] or "", r["patient_id"] or 0) for r in had.collect()) == [("", 5), ("D", 0), ("D", 1), ("D", 2)]
    dictionary = spark.createDataFrame([("D", path), ("D", "demographic.gender")], "dataset string, field_path string")
    sizes = spark.createDataFrame([("D", 5)], "dataset string, n_patients long")
    out = stats.field_stats(values.mapInPandas(told, values.schema), dictionary, sizes, had=had)
    got = {r["field_path"]: (r["valid"], r["null_count"], r["masked_count"], r["multi_record_rate"]) for r in out.collect()}
    # 2 is masked, and so is the patient without a name, who is not known to be the same
    assert got == {path: (2, 3, 2, 0.2), "demographic.gender": (0, 5, 0, 0.0)}
    assert read.value == 3


def test_case_context_needs_no_sort(spark):
    who = "dataset string, patient_id long, "
    facts = spark.createDataFrame(
        [("D", 1, 5, True, "P1"), ("D", 1, 6, False, "P3"), ("D", 1, 7, False, "P2"), ("D", 2, 8, True, "P3"), ("D", 3, 9, True, "P1"), ("D", 3, 4, True, "P2")],
        who + "dx_pos long, is_prior boolean, path_class string",
    ).selectExpr(
        "*", "'no' AS prior_malignancy", "true AS evidence", *[f"CAST(NULL AS DOUBLE) AS {n}" for n in (
            "days_to_last_follow_up", "days_to_last_known_disease_status", "days_to_recurrence", "tx_last", "tx_first", "adjuvant_first", "surgery_first")],
        "CAST(NULL AS BOOLEAN) AS adjuvant_seen",
    )
    visits = spark.createDataFrame([("D", 4, 3.0, False)], who + "days_to_follow_up double, is_shell boolean")
    context = timing.case_context(facts, visits)
    assert {r["patient_id"]: r["main_class"] for r in context.collect()} == {1: "P2", 2: "P3", 3: "P1", 4: None}
    assert "SortAggregate" not in context._jdf.queryExecution().executedPlan().toString()
