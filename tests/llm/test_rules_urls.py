"""Quality rules and URL filters against their SQL twins."""

import pytest
from pyspark.sql import functions as F

from chartloom.llm import quality, urls


def rows(df, columns):
    return sorted(str(tuple(r[c] for c in columns)) for r in df.collect())


def sql(db, text, columns):
    found = db.execute(text)
    names = [d[0] for d in found.description]
    return sorted(str(tuple(r[names.index(c)] for c in columns)) for r in found.fetchall())


def test_quality_equals_sql(spark, db, folder):
    assert rows(quality.op1_quality_rules(spark, folder), quality.RESULT) == sql(db, quality.ORACLE, quality.RESULT)


def test_quality_of_odd_rows(spark, odd, as_folder):
    import duckdb

    where = as_folder(documents=odd)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{where}/documents.parquet/*.parquet'")
    assert rows(quality.op1_quality_rules(spark, where), quality.RESULT) == sql(con, quality.ORACLE, quality.RESULT)


def test_repeated_windows(spark):
    words = [f"w{i}" for i in range(30)]
    text = " ".join(words + words[5:14])  # nine words again: two windows, first included
    found = quality.quality_rules(spark.createDataFrame([(text,)], "text string")).first()
    assert found.n_repeat_words == 18
    assert found.base_failed  # 18 of 39 words


def test_clean_labels_are_kept(docs, labels):
    found = quality.quality_rules(docs).join(labels, "doc_id").where("quality = 1 and n_words >= 20 and not base_failed")
    assert found.where("not kept").count() <= 0.01 * found.count()


def test_quality_stage_keeps_columns(spark, clashing, odd):
    out = quality.stage(spark, clashing, "")
    assert out.columns == clashing.columns
    assert quality.stage(spark, odd.limit(0), "").count() == 0
    kept = {r.text for r in quality.quality_rules(odd).where("kept").collect()}
    assert {r.text for r in out.collect()} == kept


PAGES = [
    (1, "http://a.example.net/en/1"), (2, "http://A.EXAMPLE.net/en/1"), (3, "https://net"), (4, "https://net/"),
    (5, "https://x.net?q=/en/"), (6, None), (7, ""), (8, "no scheme example.net/en/"), (9, "http://example.com/de/x#y"),
    (9, "http://example.com/de/x#y"), (10, "ftp://notexample.com/de/"), (11, "http://www.spam-farm.example.org/fr/1"),
    (12, "http://casino-win.example.org/"), (13, "http://ok.org/viagra"), (14, "http://ok.org/viagranot"),
    (15, "http://b.org/fr/?x://y/z"), (None, "http://b.org/fr"), (16, "http://h.example.net:80/en/"), (17, "x://spam-farm.net"),
]


def test_urls_equal_sql(spark, db, folder):
    assert rows(urls.op10_url_filter(spark, folder), urls.RESULT) == sql(db, urls.ORACLE, urls.RESULT)


def test_odd_urls(spark, as_folder):
    import duckdb

    where = as_folder(pages=spark.createDataFrame(PAGES, "page_id long, url string"))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{where}/pages.parquet/*.parquet'")
    got = urls.op10_url_filter(spark, where)
    assert rows(got, urls.RESULT) == sql(con, urls.ORACLE, urls.RESULT)
    by = {(r.page_id, r.verdict) for r in got.collect()}
    assert {(1, "allow"), (4, "block"), (3, "allow"), (9, "block"), (12, "block"), (13, "block"), (14, "allow"), (6, "allow")} <= by


def test_pattern_tokens():
    assert urls.literal_tokens("||spam-farm.") == ["spam", "farm"]
    assert urls.literal_tokens("casino*win/") == []  # both ends of the first are open, the second opens at the wildcard
    assert urls.literal_tokens("/porn/") == ["porn"]


def test_open_patterns_reach_every_url(spark):
    df = spark.createDataFrame([(1, "http://xcasinoy.org/")], "page_id long, url string")
    assert urls.url_filter(df, pattern_rules=("casino",)).first().verdict == "block"


def test_url_clash_and_empty(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string").withColumns({"host": F.lit(1), "_url_key": F.lit(2), "verdict": F.lit(3)})
    out = urls.url_filter(df)
    assert out.count() == len(PAGES) and out.where("_url_key = 2").count() == len(PAGES)
    assert urls.url_filter(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["quality", "urls"])
def test_no_python_in_plans(spark, folder, name):
    df = quality.op1_quality_rules(spark, folder) if name == "quality" else urls.op10_url_filter(spark, folder)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
