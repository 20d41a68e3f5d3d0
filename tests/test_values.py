"""Value classification, paths, statistics and rules on small documents."""

import json

import pytest
from pyspark.sql import functions as F

from chartloom.functions import missing, numbers, text
from chartloom.functions.paths import path_values, timed_family
from chartloom.operators import rules, scan, stats
from chartloom.operators.families import primary_diagnosis
from chartloom.sources import cases as case_source


def column(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("t"))).collect()]


def test_value_states(spark):
    got = column(spark, [" ", "Unknown", " n/a ", "not  reported", "x", None], missing.text_state)
    assert got == ["null", "sentinel", "sentinel", "valid", "valid", "null"]
    assert column(spark, ["not  reported", "Stage  X"], lambda t: missing.is_missing_token(t, ("stage x",))) == [True, True]


def test_numbers_like_float(spark):
    got = column(spark, ["1e3", "5d", "1_000", " 61 ", "_1", "1__0", ".5", "5.", "-inf", "x"], numbers.to_number)
    assert got == [1000.0, None, 1000.0, 61.0, None, None, 0.5, 5.0, float("-inf"), None]
    assert column(spark, ["61.0", "12345678.5", "0.5"], lambda t: numbers.double_text(t.cast("double"))) == ["61.0", "12345678.5", "0.5"]


def test_converters(spark):
    assert column(spark, ["23000", "60.9", "x"], lambda t: numbers.convert(t, "days_to_years")) == ["62", "60", "x"]
    assert column(spark, ["167.0", "-27179"], lambda t: numbers.convert(t, "days_abs")) == ["167", "27179"]
    with pytest.raises(ValueError):
        numbers.convert(F.lit("1"), "nope")


def test_path_walk_and_primary_diagnosis(spark, make_cases):
    doc = {"submitter_id": "P1", "demographic": {"age_at_index": 61, "gone": None},
           "diagnoses": [{"days_to_diagnosis": 426, "diagnosis_is_primary_disease": "true", "g": "a"},
                         {"days_to_diagnosis": 0, "g": "b"}, {"days_to_diagnosis": 457, "g": "c"}]}
    c = make_cases([doc])
    rows = path_values(c, ["demographic.age_at_index", "demographic.gone", "demographic.no", "diagnoses[].g"], keep=["submitter_id"]).collect()
    assert sorted((r["field_path"], r["value"], r["kind"]) for r in rows) == [
        ("demographic.age_at_index", "61", "number"), ("demographic.gone", None, "null"),
        ("diagnoses[].g", "a", "string"), ("diagnoses[].g", "b", "string"), ("diagnoses[].g", "c", "string")]
    main = primary_diagnosis(case_source.shred(c).diagnoses, ["days_to_diagnosis"]).first()
    assert main["days_to_diagnosis"] == 0


def test_first_document_wins(spark, make_cases):
    kept = make_cases([{"submitter_id": "A", "x": 1}, {"submitter_id": " "}, {"submitter_id": "A", "x": 2}, {"submitter_id": "B"}])
    assert sorted((r["submitter_id"], r["pos"]) for r in kept.collect()) == [("A", 0), ("B", 3)]


def test_read_case_files(spark, tmp_path):
    import json

    (tmp_path / "a.json").write_text(json.dumps([{"submitter_id": "A"}, {"submitter_id": "B"}]))
    (tmp_path / "b.json").write_text(json.dumps([{"submitter_id": "A", "x": 1}]))
    reg = case_source.Registry({"D": {"clinic_files": [str(tmp_path / "a.json"), str(tmp_path / "b.json")]}}, {"dd": "D"})
    rows = case_source.load_cases(case_source.read_cases(spark, reg, "dd")).collect()
    assert sorted((r["submitter_id"], r["file_ord"], r["pos"]) for r in rows) == [("A", 0, 0), ("B", 0, 1)]
    with pytest.raises(ValueError):
        reg.resolve("nope")


def test_key_scan_nests_to_any_depth(spark, make_cases):
    c = make_cases([{"submitter_id": "A", "d": {"x": 1}, "l": [{"y": [{"z": 1}]}, 3], "s": [1, 2]}])
    got = {(r["prefix"], r["key"]) for r in scan.scan_keys(c, 4).collect()}
    assert got == {("", "submitter_id"), ("", "d"), ("", "l"), ("", "s"), ("d", "x"), ("l[]", "y"), ("l[].y[]", "z")}
    # a first chain that is too short is made longer
    assert {(r["prefix"], r["key"]) for r in scan.scan_keys(c, 1).collect()} == got


def test_dictionary_types_and_enums_of_any_depth(spark):
    from chartloom.sources import tables

    deep = {"anyOf": [{"oneOf": [{"type": "array", "items": {"anyOf": [{"enum": ["x", "y"]}, {"type": ["string", "null"]}]}}]}]}
    schema = {"category": "clinical", "required": ["a"], "properties": {
        "a": deep, "b": {"type": "integer"}, "c": {"enum": ["y", 3, "y"]}, "d": {"$ref": "z"}, "e": {"type": "array", "items": {"type": "number"}}}}
    df = spark.createDataFrame([("treatment", json.dumps(schema))], "entity string, j string").select("entity", F.parse_json("j").alias("schema"))
    got = {r["field"]: (r["type"], r["required"], r["enum"], r["n_enum"]) for r in tables.flatten_dictionary(df).collect()}
    assert got == {
        "a": ("array[enum|string|null]", "yes", "x | y", 2), "b": ("integer", "no", "", 0), "c": ("enum", "no", "y | 3", 2),
        "d": ("z", "no", "", 0), "e": ("array[number]", "no", "", 0)}


def test_field_stats_on_small_values(spark):
    rows = [("D", "a", "f", "x"), ("D", "b", "f", "Unknown"), ("D", "c", "f", "x"), ("D", "c", "f", "y"), ("D", "d", "f", "")]
    values = spark.createDataFrame(
        [(d, p, f, None, v, None, "string") for d, p, f, v in rows],
        "dataset string, patient_id string, field_path string, pos array<long>, value string, number double, kind string")
    fields = spark.createDataFrame([("D", "f"), ("D", "none")], "dataset string, field_path string")
    sizes = spark.createDataFrame([("D", 4)], "dataset string, n_patients long")
    per = stats.patient_values(values)
    counts = stats.category_counts(per.withColumn("o", F.ascii("patient_id")), "o")
    done = {r["field_path"]: r for r in fields.join(sizes, "dataset").join(stats.completeness(counts), stats.FIELD, "left").collect()}
    assert done["f"]["valid"] == 2 and done["f"]["sentinel_count"] == 1 and done["none"]["valid"] is None
    info = stats.information(counts).first()
    assert info["unique_count"] == 2 and info["entropy"] == pytest.approx(1.0)
    # equal counts: the value met first wins
    assert info["mode_value"] == "x"


def test_rule_order_and_exemption(spark):
    rows = [("demographic.vital_status", 1.0, 3, 0.5), ("demographic.days_to_birth", 0.9, 9, 0.1), ("case_id", 1.0, 9, 0.1),
            ("diagnoses[].treatments", 1.0, 9, 0.1), ("a.b", 0.1, 9, 0.1), ("demographic.race", 0.9, 1, 1.0), ("diagnoses[].prior_malignancy", 0.9, 1, 1.0),
            ("diagnoses[].age_at_diagnosis", 0.9, 9, 0.1), ("family_histories[].relationship_age_at_diagnosis", 0.9, 9, 0.1), ("demographic.gender", 0.9, 2, 0.5)]
    df = spark.createDataFrame(rows, "field_path string, coverage double, unique_count int, mode_share double")
    got = {r["field_path"]: (r["rule"], r["trigger"]) for r in rules.apply_rules(df).collect()}
    assert got["demographic.vital_status"] == ("R0_label_leak", "vital_status")
    assert got["demographic.days_to_birth"] == (None, "")
    assert got["case_id"] == ("R1_admin", "case_id")
    assert got["diagnoses[].treatments"] == ("R1_admin", "container:treatments")
    assert got["a.b"] == ("R3_coverage", "0.100000<0.3")
    assert got["demographic.race"] == (None, "")
    assert got["diagnoses[].prior_malignancy"] == ("R4_degenerate", "n_unique=1")
    assert got["diagnoses[].age_at_diagnosis"] == ("R5_alias", "alias_of demographic.age_at_index")
    assert got["family_histories[].relationship_age_at_diagnosis"] == (None, "")
    assert got["demographic.gender"] == ("R5_alias", "alias_of sex_at_birth")
    strict = {r["field_path"]: r["rule"] for r in rules.apply_rules(df, strict_exempt=True).collect()}
    assert strict["diagnoses[].prior_malignancy"] is None


def test_names(spark):
    assert column(spark, ["diagnoses[].treatments[].x", "demographic.race", "follow_ups[]"], timed_family) == ["diagnoses_treatments", None, "follow_ups"]
    assert column(spark, ["a {} b {}", "none"], lambda t: text.filled_template(t, F.lit("v"))) == ["a v b {}", "none"]


def test_quick_ways_around_trimming_and_patterns(spark):
    texts = ["", " ", "a", "~", "\x7f", "a ", "\ta", "\u2003a\u3000", "é", "a é ", "\x1cNone", "N/A\x85", "x\u200b", None]
    assert column(spark, texts, missing.trimmed) == [t.strip() if t is not None else None for t in texts]
    assert column(spark, ["--", " -- ", "ok ", "\u00a0unknown", "", None], lambda t: missing.cleaned(t, None)) == [None, None, "ok", None, None, None]
    words = ["1_0", " -2.5e3 ", ".5", "5.", "5d", "e5", "_1", "+", ".", "Inf", "-infinity", "+NaN", "nano", "in", "", "x1", None]
    got = column(spark, words, numbers.to_number)
    assert str(got) == str([10.0, -2500.0, 0.5, 5.0, None, None, None, None, None, float("inf"), float("-inf"), float("nan"), None, None, None, None, None])
