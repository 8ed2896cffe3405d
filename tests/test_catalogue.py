"""Every query of the catalogue against its SQL, on the tables at sf0.001."""

from datetime import date, datetime

import duckdb
import pytest

import __spark_entry__
from stellarframe.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def engine():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, float):
        return round(x, 9)
    if isinstance(x, datetime):
        return x.replace(tzinfo=None)
    return x if isinstance(x, (str, int, date, type(None))) else float(x)


@pytest.mark.parametrize("name", catalogue.SQL)
def test_query_equals_sql(spark, engine, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    done = engine.execute(catalogue.SQL[name])
    names = [c[0] for c in done.description]
    want = [tuple(plain(dict(zip(names, r, strict=True))[c]) for c in columns) for r in done.fetchall()]
    assert sorted(names) == columns
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL) - {"grouped_cv_regression"}))
def test_other_queries_run(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_every_panel_has_a_value(spark):
    from stellarframe.plans import serve

    rows = catalogue.QUERIES["dashboard_panels"](spark, SF).collect()
    assert {r["panel"] for r in rows} == {p for p, _, _ in serve.PANELS} and not [r["panel"] for r in rows if r["value"] is None]
    assert len({r["name"] for r in catalogue.QUERIES["all_metrics"](spark, SF).collect()}) == 42


def test_regression_is_registered_with_its_settings(spark, monkeypatch):
    from stellarframe.plans import model

    given = []
    monkeypatch.setattr(model, "cross_validated", lambda pairs, **settings: given.append(settings))
    monkeypatch.setattr(model, "scores", lambda predicted: predicted)
    catalogue.QUERIES["grouped_cv_regression"](spark, SF)
    assert [model.SETTINGS | g for g in given] == [model.SETTINGS]


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
