"""Every registered query against its SQL on the smallest test tables."""

import pytest
from check_oracle import compare, connect

from __spark_entry__ import entry
from suite.all_queries import ORACLES as SQL
from suite.all_queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
# Queries whose result may be empty at this scale (too few rows to match).
MAY_BE_EMPTY = {"search_title", "search_facets", "search_page", "page_after", "liked_missing"}


@pytest.fixture(scope="module")
def db():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF_DIR)
    if name in SQL:
        difference = compare(df, db, SQL[name])
        assert difference is None or (difference == "no rows" and name in MAY_BE_EMPTY), difference
    else:
        assert df.count() > 0


def test_entry(spark):
    sessions = entry(spark)
    assert sessions.columns == [
        "id", "participant_id", "created_at", "model_version", "experiment_group", "intent", "recommendations",
    ]
    assert sessions.count() == sessions.select("id").distinct().count() > 0
