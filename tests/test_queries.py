"""Every query of the engine against its SQL in DuckDB, and the entry file without the training-data folder."""

import builtins
import glob
import os

import pytest

import __spark_entry__ as entry
from palimpsest.plans.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for file in glob.glob(f"{FOLDER}/*.parquet"):
        connection.sql(f"create view {os.path.basename(file)[:-8]} as select * from '{file}'")
    return connection


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    df, want = QUERIES[name](spark, FOLDER), duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert sorted(map(repr, map(tuple, df.select(*want.columns).collect()))) == sorted(map(repr, want.fetchall()))


def documents(spark, folder, rows):
    """A folder whose documents are the rows, in one file."""
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def both(spark, folder, name):
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    connection.sql(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    df, want = QUERIES[name](spark, folder), connection.sql(SQL[name])
    return sorted(map(repr, map(tuple, df.select(*want.columns).collect()))), sorted(map(repr, want.fetchall()))


def test_closure_of_one_text_in_two_sources(spark, tmp_path):
    """Also of a source that only a document beside the branch has, absent parents, and no text, language or source."""
    rows = [(1, "same", "de", "a"), (2, "same", "de", "b"), (4, "same", "de", "c"), (3, "same", "en", "d"), (14, "x", "main", "a"), (6, None, "fr", "e"), (12, "y", "fr", None), (13, "z", None, "a")]
    got, want = both(spark, documents(spark, tmp_path / "odd", rows), "closure_objects")
    assert got == want and len(got) == 5


def test_verify_of_one_text_in_two_languages(spark, tmp_path):
    rows = [(0, "a", "en", "x"), (1, "a", "de", "x"), (2, "b", "de", "x"), (3, "b", "fr", "x"), (4, "c", None, "x"), (5, "c", "de", "x"), (6, "d", None, None), (7, "e", "fr", "src3"), (8, None, "fr", "x")]
    got, want = both(spark, documents(spark, tmp_path / "odd", rows), "verify_report")
    assert got == want == ["(False, 2, 2, 2, 2)"]
    got, want = both(spark, documents(spark, tmp_path / "null", [*rows, (9, None, "fr", "src3")]), "verify_report")
    assert got == want == ["(False, 0, 6, 0, 0)"]


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def importing(monkeypatch, error):
    real = builtins.__import__

    def without(name, *args, **kwargs):
        if name == "corpus_pipeline" or name.startswith("palimpsest.llm"):
            raise error(name)
        return real(name, *args, **kwargs)

    monkeypatch.setattr(builtins, "__import__", without)


def test_entry_without_the_folder(monkeypatch):
    importing(monkeypatch, lambda name: ModuleNotFoundError(name, name=name))
    assert set(entry.queries()) == set(QUERIES) and set(entry.oracle_sql()) == set(SQL)


def test_entry_with_a_broken_folder(monkeypatch):
    importing(monkeypatch, lambda name: ModuleNotFoundError(name, name="numpy"))
    with pytest.raises(ModuleNotFoundError):
        entry.queries()
