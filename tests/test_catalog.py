"""Every query with SQL against DuckDB on the smallest tables; the others must return rows."""

import glob
import os

import duckdb
import pytest

from locusforge.plans import catalog

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(rows):
    return sorted((tuple(round(float(v), 4) + 0.0 if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_sql_agrees(spark, db, name):
    found = catalog.queries()[name](spark, DIR)
    cols = sorted(found.columns)
    ref = db.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({catalog.oracle_sql()[name]})").fetchall()
    got = [tuple(r) for r in found.select(*cols).collect()]
    assert len(got) == len(ref)
    for a, b in zip(plain(got), plain(ref)):
        assert len(a) == len(b) and all(x == y or (isinstance(x, float) and abs(x - y) <= 2e-4) for x, y in zip(a, b)), (a, b)


@pytest.mark.parametrize("name", ["principal_components", "mlm_global", "farmcpu", "blink", "effective_tests", "qq_histogram", "manhattan_points"])
def test_others_return_rows(spark, name):
    assert catalog.queries()[name](spark, DIR).count() > 0


def test_long_models_run_with_the_operators_own_defaults(monkeypatch):
    told = {}
    monkeypatch.setattr(catalog, "supplier_panel", lambda *_: (None, None))
    monkeypatch.setattr(catalog.multilocus, "resample", lambda geno, y, **options: told.update(options))
    catalog.queries()["farmcpu_resampling"](None, DIR)
    assert set(told) <= {"seed"}
