"""Every registered query against its SQL."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from hookloom.plans.oracles import ORACLES
from tests.compare import compare, oracle_connection

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle_connection(SF)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "external_id" in df.columns


def test_every_core_query_has_sql():
    core = set(entry.core_queries())
    assert set(ORACLES) == core
    # Corpus queries without SQL have brute-force tests beside them.
    assert core <= set(entry.oracle_sql()) <= set(entry.queries())


def test_core_queries_stand_without_the_corpus_part(monkeypatch):
    def missing(name):
        raise ImportError(name)

    monkeypatch.setattr(entry.importlib, "import_module", missing)
    assert set(entry.queries()) == set(entry.oracle_sql()) == set(entry.core_queries())


@pytest.mark.parametrize("name", entry.queries())
def test_query(spark, con, name):
    assert compare(spark, con, entry.queries()[name], entry.oracle_sql().get(name), SF) == ""
