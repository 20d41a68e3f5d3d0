import os

import duckdb
import pytest

FOLDER = os.environ.get("CHARTLOOM_TEST_DIR", "/root/testdata/sf0.001")

#: nulls, empty and blank texts, repeated rows and ids, marks of several kinds, one long text
ODD = [
    (1, None, "en", "s", None),
    (2, "", "en", "s", 0),
    (3, " \t\n\x0b\x0c\r ", None, "s", 7),
    (4, "one two three four five six seven eight nine ten " * 4, "en", None, 200),
    (4, "one two three four five six seven eight nine ten " * 4, "en", None, 200),
    (4, "another text under the same id, with the word of and to", "en", "s", 5),
    (None, "a text without an id: mail a.b@c.org or +1 (203) 555-8282", "en", "s", 3),
    (None, None, None, None, None),
    (7, "é🙂 ÀB ﬁ 日本語 \x85 \u2028 <|endoftext|> '" + "x" * 300, "fr", "s", 1),
    (8, "The the of and\nThe the of and\n- item\nmore ... of the\n" * 3, "en", "s", 9),
    (9, "word " * 30_000, "en", "s", 150_000),
    (-5, "4539578763621486 pays 10.0.0.256 and 10.0.0.255", "en", "s", 1),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


@pytest.fixture(scope="session")
def clashing(odd):
    """The odd rows with extra columns named like results and like intermediate columns."""
    from pyspark.sql import functions as F

    extra = ["n_words", "kept", "ids", "score", "fingerprint", "pii", "rate", "copies", "posterior", "n_tokens", "_text",
             "_candidates", "row", "shard", "slot", "host", "verdict", "_sort_id", "_words"]
    return odd.select("*", *[F.lit(i).alias(c) for i, c in enumerate(extra)])


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{FOLDER}/labels.parquet")


@pytest.fixture(scope="session")
def db():
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


@pytest.fixture(scope="session")
def folder():
    return FOLDER


@pytest.fixture(scope="session")
def as_folder(tmp_path_factory):
    """Write a table as the only one of a folder, as registered queries read it."""

    def write(**tables):
        out = str(tmp_path_factory.mktemp("tables"))
        for name, df in tables.items():
            df.write.parquet(f"{out}/{name}.parquet")
        return out

    return write
