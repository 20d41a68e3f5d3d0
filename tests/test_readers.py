"""Readers of rule files, splits, evaluation logs and line files over files made here."""

import json

import pytest
from pyspark.sql import functions as F

from chartloom.operators import rules
from chartloom.sources import tables


def test_rule_file(tmp_path):
    path = tmp_path / "rules.json"
    path.write_text(json.dumps({
        "R0_label_leak": {"leaves": ["state"], "substrings": ["death"], "path_suffixes": [".x"], "leaf_startswith": ["days_to_"], "except_leaves": ["days_to_birth"]},
        "R1_admin": {"leaves": ["case_id"], "leaf_endswith": ["_id"], "container_leaves": ["project"]},
        "R4_exempt": {"fields": ["demographic.race"]},
        "R5_alias": {"groups": [{"canonical": " a.b ", "aliases": [" c.d", "", " "]}, {"canonical": "e", "aliases": None}]},
    }))
    got = rules.load_rules(str(path))
    assert got.leak_leaves == ["state"] and got.leak_substrings == ["death"] and got.leak_suffixes == [".x"]
    assert got.leak_prefixes == ["days_to_"] and got.leak_exceptions == ["days_to_birth"]
    assert got.admin_leaves == ["case_id"] and got.admin_suffixes == ["_id"] and got.containers == ["project"]
    assert got.exempt == ["demographic.race"] and got.aliases == {"c.d": "a.b"}
    path.write_text("{}")
    assert rules.load_rules(str(path)) == rules.RuleSet()
    path.write_text("[]")
    with pytest.raises(ValueError, match="JSON object"):
        rules.load_rules(str(path))


def test_split_files(spark, tmp_path):
    (tmp_path / "splits_0.csv").write_text(",train,val,test\n0,A,B,C\n1,D,,\n")
    (tmp_path / "splits_12.csv").write_text(",train,val,test\n0,B,A,\n")
    rows = tables.read_splits(spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in rows) == [
        (0, "test", "C"), (0, "train", "A"), (0, "train", "D"), (0, "val", "B"), (12, "train", "B"), (12, "val", "A"),
    ]


def test_evaluation_log(spark, tmp_path):
    line = {"logical_eval_idx": 3, "k": 2, "subset": ["a", "b"], "cv_c_mean": 0.5, "cv_folds": [0.4, 0.6], "status": "ok", "extra": 1}
    (tmp_path / "log.jsonl").write_text(json.dumps(line) + "\n" + json.dumps({"logical_eval_idx": 4, "status": "error"}) + "\n")
    rows = tables.read_evaluations(spark, str(tmp_path)).orderBy("logical_eval_idx").collect()
    assert [(r["logical_eval_idx"], r["subset"], r["cv_folds"], r["status"], r["wall_ms"]) for r in rows] == [
        (3, ["a", "b"], [0.4, 0.6], "ok", None), (4, None, None, "error", None),
    ]


def test_inventory_of_files(spark, tmp_path):
    (tmp_path / "nationwidechildrens.org_drug.txt").write_text("id\tday\nID\tDay\nCDE_ID:\tCDE_ID:1\nx\t1\ny\t2\n")
    (tmp_path / "plain.txt").write_text("a\tb\tc\n1\t2\t3\n")
    rows = tables.tab_inventory(tables.file_lines(spark, str(tmp_path))).orderBy(F.desc("file")).collect()
    assert [tuple(r) for r in rows] == [
        ("plain.txt", "plain", 3, 1, "a;b;c"), ("nationwidechildrens.org_drug.txt", "drug", 2, 2, "id;day"),
    ]
