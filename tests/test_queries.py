"""Registered queries next to their SQL twins on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = os.environ.get("CHARTLOOM_TEST_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = [
    "a3_field_stats", "a8_field_registry", "i4_treatment_intervals", "w1_slot_numbers", "a4_landmark_stats", "w2_follow_up_records",
    "p18_scheme_values", "a22_leak_audit", "e4_encoded_cells", "e14_neighbour_pairs", "m1_concordance", "m9_fold_metrics",
    "j15_pair_overlap", "a44_decision", "s1_load_cases", "a1_key_scan", "s14_merged_rows", "s6_flatten_dictionary",
    "a16_wide_slots", "a51_delta_matrix", "w12_stop_replay", "m12_bootstrap_interval", "m11_paired_interval",
    "a22_bank_audit", "i12_untraced_values", "i12_bank_mismatches", "e9_longitudinal_cells", "e9_longitudinal_schema",
    "s1_array_files", "s4_tab_rows", "s18_written_banks", "u3_scheme_datasets", "u3_scheme_fields", "u4_alias_rules", "u5_template_spec",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables absent")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, db, name):
    df = entry.queries()[name](spark, FOLDER)
    cols = sorted(df.columns)
    got = sorted(str(tuple(r[c] for c in cols)) for r in df.collect())
    rel = db.execute(entry.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    want = sorted(str(tuple(row[names.index(c)] for c in cols)) for row in rel.fetchall())
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
