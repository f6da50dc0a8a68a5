"""The driver's contract, and every query against its SQL on the smallest tables."""

import importlib
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from postmill.plans import core_queries, oracles, reference_queries

DATA = "/root/testdata/sf0.001"


def test_contract():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and set(core_queries.QUERIES) <= set(q)


def test_library_works_without_the_llm_subpackage(monkeypatch):
    for name in [n for n in sys.modules if n.startswith("postmill.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "postmill.llm", None)
    fresh = importlib.reload(entry)
    assert set(fresh.queries()) == set(core_queries.QUERIES) | set(reference_queries.QUERIES)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in ("raw_jobs_itviec", "raw_jobs_topcv", "skills_flat", "annotations_unified", "skill_reference", "events", "embeddings"):
        c.execute(f"create view {name} as select * from read_parquet('{DATA}/{name}.parquet')")
    return c


def normal(rows):
    def value(x):
        if isinstance(x, float):
            return round(x, 5)
        return x.isoformat() if hasattr(x, "isoformat") else float(x) if type(x).__name__ == "Decimal" else x

    return sorted((tuple(value(x) for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", ["text_skill_key", "location_canonical", "dedup_last", "surrogate_keys", "missing_profile", "cluster_summary", "embedding_components", "iaa_kappa_label", "json_parse", "title_standard"])
def test_query_equals_sql(spark, duck, name):
    df = reference_queries.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    cursor = duck.execute(oracles.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = normal(tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall())
    assert normal(tuple(r) for r in df.select(*columns).collect()) == want


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
