"""Keyed tables: whole rewrites behind a manifest."""

import pytest

from chartloom.sources import sinks


def rows(spark, path):
    return sorted(map(str, (dict(sorted(r.asDict().items())) for r in sinks.read_keyed(spark, path).collect())))


def table(spark, *given):
    return spark.createDataFrame(list(given), "k int, p string, v string")


def test_a_key_that_changes_its_partition_is_there_once(spark, tmp_path):
    path = str(tmp_path / "t")
    assert sinks.read_keyed(spark, path) is None
    sinks.replace_keys(spark, path, table(spark, (1, "x", "a"), (2, "x", "b"), (3, "y/ =", "c"), (None, None, "d")), ["k"], "p")
    sinks.replace_keys(spark, path, table(spark, (1, "z", "e"), (None, "x", "f"), (4, "y/ =", "g")), ["k"], "p")
    want = [(1, "z", "e"), (2, "x", "b"), (3, "y/ =", "c"), (None, "x", "f"), (4, "y/ =", "g")]
    assert rows(spark, path) == sorted(str(dict(zip("kpv", w))) for w in want)
    # a partition all of whose keys left is no longer part of the table
    assert "null" not in sinks._manifest(spark, path)
    sinks.replace_keys(spark, path, spark.createDataFrame([], "k int, p string, v string"), ["k"], "p")
    assert len(rows(spark, path)) == 5


def test_a_rewrite_that_did_not_end_does_not_count(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.replace_keys(spark, path, table(spark, (1, "x", "a")), ["k"], "p")
    # a manifest without its success mark, as a lost driver leaves it
    (tmp_path / "t" / "manifests" / "2").mkdir()
    assert len(rows(spark, path)) == 1
    sinks.replace_keys(spark, path, table(spark, (2, "x", "b")), ["k"], "p")
    assert len(rows(spark, path)) == 2


def test_two_writers_from_one_manifest(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    sinks.replace_keys(spark, path, table(spark, (1, "x", "a")), ["k"], "p")
    plain = sinks.checkpointed
    other = []

    def slow(df):
        if not other:
            other.append(True)
            sinks.replace_keys(spark, path, table(spark, (2, "y", "b")), ["k"], "p")
        return plain(df)

    monkeypatch.setattr(sinks, "checkpointed", slow)
    with pytest.raises(Exception, match="(?i)already exists|other writer"):
        sinks.replace_keys(spark, path, table(spark, (1, "z", "c")), ["k"], "p")
    assert len(rows(spark, path)) == 2


def test_columns_are_united(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.replace_keys(spark, path, table(spark, (1, "x", "a")), ["k"], "p")
    sinks.replace_keys(spark, path, spark.createDataFrame([(2, "y", 5)], "k int, p string, w int"), ["k"], "p")
    assert rows(spark, path) == sorted(str({"k": k, "p": p, "v": v, "w": w}) for k, p, v, w in [(1, "x", "a", None), (2, "y", None, 5)])
