"""Every query that has SQL against DuckDB, and the pure functions."""

import os
import re

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from __spark_entry__ import QUERIES
from nestquery.functions.glob import BadPattern, glob_to_regex

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def values(df):
    def plain(x):
        return None if x is None or x is pd.NA or x != x else x.item() if hasattr(x, "item") else x

    return sorted((tuple(plain(x) for x in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False)), key=repr)


def duck(sql):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c.sql(sql).df()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    query, sql = QUERIES[name]
    got, want = query(spark, SF).toPandas(), duck(sql)
    assert sorted(got.columns) == sorted(want.columns)
    assert values(got) == values(want)


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1


@pytest.mark.parametrize("glob, yes, no", [
    ("**/*.sit", ["a.sit", "x/y/a.sit"], ["a.sitx", "a.SIT"]),
    ("*", ["a", ""], ["a/b"]),
    ("a/**", ["a", "a/b", "a/b/c"], ["ab", "b/a"]),
    ("a/**/z", ["a/z", "a/b/z", "a/b/c/z"], ["az", "a/bz"]),
    ("{a,b*}/c?", ["a/cx", "bbb/cd"], ["c/cx", "a/c"]),
    ("[!a-c]x[]]", ["dx]"], ["ax]", "/x]"]),
    ("a\\*b", ["a*b"], ["axb"]),
    ("a.b+(c)", ["a.b+(c)"], ["aXb+(c)"]),
])
def test_glob(glob, yes, no):
    r = re.compile(glob_to_regex(glob))
    assert all(r.fullmatch(x) for x in yes) and not any(r.fullmatch(x) for x in no)


@pytest.mark.parametrize("bad", ["[a", "{a,b", "a\\"])
def test_bad_glob(bad):
    with pytest.raises(BadPattern):
        glob_to_regex(bad)
