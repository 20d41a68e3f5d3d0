"""Alias, scheme and spec files made here, good and bad."""

import json

import pytest

from chartloom.operators import extract
from chartloom.sources import settings


def write(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value, indent=1))


def test_alias_files(spark, tmp_path):
    write(tmp_path / "a.json", {"_doc": "x", "aliases": {"demographic.race": {"map": {"afro american": "black", "n/a": "", "Odd": "never"}}, "g": {}}})
    write(tmp_path / "b.json", {"other": 1})
    rules = settings.read_aliases(spark, str(tmp_path))
    assert sorted(tuple(r) for r in rules.collect()) == [
        ("demographic.race", "Odd", "never"), ("demographic.race", "afro american", "black"), ("demographic.race", "n/a", ""),
    ]
    values = spark.createDataFrame([("demographic.race", v) for v in (" Afro  AMERICAN", "N/A", "odd", None)] + [("g", "n/a")], "field_path string, value string")
    got = [r["value"] for r in extract.aliased(values, rules).collect()]
    assert sorted(got, key=str) == ["", None, "black", "n/a", "odd"]
    write(tmp_path / "c.json", "[1")
    with pytest.raises(Exception):
        settings.read_aliases(spark, str(tmp_path)).collect()


GOOD = {"source": "gdc", "fields": ["b", "a"]}


def bound(spark, schemes):
    names = spark.createDataFrame([("TCGA-A",), ("TCGA_B",), ("OWN",)], "dataset string")
    aliases = spark.createDataFrame([("mine", "OWN"), ("gone", "ELSEWHERE")], "alias string, dataset string")
    return sorted(tuple(r) for r in settings.scheme_datasets(schemes, names, aliases).collect())


def test_scheme_folder(spark, tmp_path):
    write(tmp_path / "schemes.json", {"_schemes": ["FREE", "FIELD_BANK", "ALL", "SOME one"]})
    write(tmp_path / "FREE" / "fields.json", GOOD)
    write(tmp_path / "ALL" / "fields.json", {**GOOD, "datasets": ["tcga", "All_TCGA"]})
    write(tmp_path / "SOME one" / "fields.json", {**GOOD, "source": " GDC ", "datasets": ["mine", " mine ", "", "ALL_TCGA", "gone"]})
    write(tmp_path / "unlisted" / "fields.json", {"fields": []})
    found = settings.read_schemes(spark, str(tmp_path))
    assert sorted(tuple(r) for r in settings.scheme_fields(found).where("scheme = 'ALL'").collect()) == [("ALL", 0, "b"), ("ALL", 1, "a")]
    assert bound(spark, found) == [
        ("ALL", "TCGA-A"), ("ALL", "TCGA_B"), ("FREE", "OWN"), ("FREE", "TCGA-A"), ("FREE", "TCGA_B"), ("SOME one", "OWN"),
    ]


def test_schemes_in_one_file(spark, tmp_path):
    assert settings.read_schemes(spark, str(tmp_path)).count() == 0
    whole = {**GOOD, "template_file": "t", "prompt_file": "p", "dirname": "d"}
    write(tmp_path / "custom_schemes.json", {"_doc": [1], "FIELD_BANK": {}, "ONE": {**whole, "datasets": "OWN"}, "NONE": {**whole, "datasets": []}})
    assert bound(spark, settings.read_schemes(spark, str(tmp_path))) == [("ONE", "OWN")]
    # the other name comes first
    write(tmp_path / "schemes.json", {"BAD": GOOD})
    with pytest.raises(Exception, match="scheme lacks parts: BAD"):
        settings.read_schemes(spark, str(tmp_path)).collect()


@pytest.mark.parametrize("scheme,said", [
    ({**GOOD, "fields": []}, "without fields"), ({"source": "gdc"}, "without fields"), ({**GOOD, "fields": ["a", "a"]}, "repeated fields"),
    ({**GOOD, "source": "other"}, "unknown source"), ({"fields": ["a"]}, "unknown source"), (None, "without fields"),
])
def test_bad_schemes(spark, tmp_path, scheme, said):
    write(tmp_path / "schemes.json", {"_schemes": ["X"]})
    if scheme is not None:
        write(tmp_path / "X" / "fields.json", scheme)
    with pytest.raises(Exception, match=said):
        settings.read_schemes(spark, str(tmp_path)).collect()


HEAD = "field,convert,unit,template,note\n"


def test_spec_file(spark, tmp_path):
    path = tmp_path / "spec.csv"
    write(path, HEAD.replace("note", "note,more") + ' a.b ,Days_Abs,days,"Said ""x"", {}.",nan,1\n\nc,,,{}.,,\n')
    rows = sorted(tuple(r) for r in settings.read_spec(spark, str(path)).collect())
    assert rows == [("a.b", "Days_Abs", "days", 'Said "x", {}.', ""), ("c", "", "", "{}.", "")]


@pytest.mark.parametrize("lines,said", [
    ("a,,,{}.,\na ,,,{}.,\n", "repeated: a"), (",int,,{}.,\n", "without a field"), ("a,weeks,,{}.,\n", "unknown converter of a"),
    ("a,,,{} {}.,\n", "template of a"), ("a,,,{},\n", "end with a period"),
])
def test_bad_specs(spark, tmp_path, lines, said):
    write(tmp_path / "spec.csv", HEAD + lines)
    with pytest.raises(Exception, match=said):
        settings.read_spec(spark, str(tmp_path / "spec.csv")).collect()


def test_spec_without_a_column(spark, tmp_path):
    write(tmp_path / "spec.csv", "field,unit,template,note\n")
    with pytest.raises(ValueError, match="convert"):
        settings.read_spec(spark, str(tmp_path / "spec.csv"))
