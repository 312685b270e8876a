import importlib
import sys
from pathlib import Path

import duckdb
import pytest

from attesta.plans import catalog

FOLDER = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    if not FOLDER.exists():
        pytest.skip("no driver tables here")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{FOLDER}/{t}.parquet')")
    return con


def plain(value):
    return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else value


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    frame = catalog.QUERIES[name](spark, str(FOLDER))
    names = sorted(frame.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in frame.collect()), key=repr)
    if name not in catalog.ORACLES:
        return
    found = duck.execute(catalog.ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == names
    expected = sorted((tuple(plain(r[columns.index(c)]) for c in names) for r in found.fetchall()), key=repr)
    assert got == expected


def test_the_entry_lives_without_the_corpus_part(monkeypatch):
    root = Path(__file__).parents[2]
    monkeypatch.syspath_prepend(str(root))
    entry = importlib.import_module("__spark_entry__")
    assert set(catalog.QUERIES) <= set(entry.queries())
    real = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda n, *a: None if n.startswith(("attesta.llm", "corpus_pipeline")) else real(n, *a))
    sys.modules.pop("__spark_entry__")
    bare = importlib.import_module("__spark_entry__")
    sys.modules.pop("__spark_entry__")
    assert set(bare.queries()) == set(catalog.QUERIES) and set(bare.oracle_sql()) == set(catalog.ORACLES)
