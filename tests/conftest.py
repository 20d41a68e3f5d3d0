import json
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F

from chartloom.session import local_session
from chartloom.sources.cases import identified, load_cases, shred


@pytest.fixture(scope="session")
def spark():
    return local_session(8, "chartloom-tests")


@pytest.fixture(scope="session")
def make_cases(spark):
    def make(docs, dataset="D"):
        rows = [(dataset, 0, i, json.dumps(d)) for i, d in enumerate(docs)]
        df = spark.createDataFrame(rows, "dataset string, file_ord long, pos long, j string")
        return load_cases(df.select("dataset", "file_ord", "pos", F.parse_json("j").alias("doc")))

    return make


@pytest.fixture(scope="session")
def make_families(make_cases):
    return lambda docs: shred(make_cases(docs))
