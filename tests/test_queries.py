"""Registered queries against their SQL on the smallest tables, where these are at hand."""

from __future__ import annotations

import math
import os

import pytest

import __spark_entry__ as entry
from attestra.plans import panels, records, tables, verdicts

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLE = {**verdicts.ORACLE, **tables.ORACLE, **records.ORACLE, **panels.ORACLE}


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DIR):
        pytest.skip("no tables")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def rows(df):
    import pandas as pd

    def plain(v):
        if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
            return ""
        if isinstance(v, float):
            return str(int(v)) if v == int(v) else repr(round(v, 6))
        if hasattr(v, "isoformat"):
            return str(pd.Timestamp(v))
        return str(v.tolist()) if hasattr(v, "tolist") else str(v)

    return sorted(tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, name):
    got, want = entry.queries()[name](spark, DIR).toPandas(), duck.sql(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want) and len(got)


def test_every_verdict_occurs(spark):
    if not os.path.isdir(DIR):
        pytest.skip("no tables")
    assert {r.overall_verdict for r in entry.entry(spark).collect()} == {"pass", "needs_review", "fail"}
    seen = {(r.rule_id, r.verdict) for r in entry.queries()["rule_verdicts"](spark, DIR).collect()}
    for rule in ("FORM_ALCOHOL_CONTENT_MATCHES_LABEL", "FORM_NET_CONTENTS_MATCHES_LABEL", "COUNTRY_OF_ORIGIN_MATCH", "GOV_WARNING_EXACT_TEXT"):
        assert {v for r, v in seen if r == rule} == {"pass", "needs_review", "fail"}, rule
