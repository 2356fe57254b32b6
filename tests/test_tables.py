"""Keyed replacement of table rows."""

from __future__ import annotations

import pytest

from spendlight.sources.tables import KeyedTable

SCHEMA = "k long, j string, v string"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_upserts_replace_by_key(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ("k", "j"), parts=4)
    assert rows(table.read()) == []
    first = [(i, "a", f"old{i}") for i in range(20)] + [(None, None, "old")]
    assert table.upsert(spark.createDataFrame(first, SCHEMA)) == 1
    assert rows(table.read()) == sorted(first, key=repr)
    more = [(3, "a", "new"), (3, "b", "other"), (None, None, "new"), (50, "a", "x"), (50, "a", "y"), (50, "a", "y")]
    table.upsert(spark.createDataFrame(more, SCHEMA).withColumnRenamed("v", "V"), order="v")
    want = {(k, j): v for k, j, v in first} | {(3, "a"): "new", (3, "b"): "other", (None, None): "new", (50, "a"): "y"}
    assert rows(table.read()) == sorted(((k, j, v) for (k, j), v in want.items()), key=repr)
    assert rows(table.read(1)) == sorted(first, key=repr)
    table.upsert(spark.createDataFrame([], SCHEMA))
    table.forget()
    assert rows(table.read()) == sorted(((k, j, v) for (k, j), v in want.items()), key=repr)


def test_a_broken_upsert_changes_nothing(spark, tmp_path, monkeypatch):
    table = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ("k",), parts=4)
    table.upsert(spark.createDataFrame([(i, "a", "old") for i in range(10)], SCHEMA))
    before = rows(table.read())

    def broken(self, version, held):
        raise OSError("lost before the switch")

    new = spark.createDataFrame([(i, "a", "new") for i in range(5, 15)], SCHEMA)
    with monkeypatch.context() as m:
        m.setattr(KeyedTable, "_publish", broken)
        with pytest.raises(OSError, match="before the switch"):
            table.upsert(new)
    assert rows(table.read()) == before
    # a manifest without its mark of success doesn't count either
    half = tmp_path / "t" / "manifest" / "version=2"
    half.mkdir()
    (half / "part-0.parquet").write_bytes(b"half a file")
    assert rows(table.read()) == before
    table.upsert(new)
    assert rows(table.read()) == sorted([(i, "a", "old") for i in range(5)] + [(i, "a", "new") for i in range(5, 15)], key=repr)


def test_only_touched_partitions_are_written(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ("k",), parts=8)
    table.upsert(spark.createDataFrame([(i, "a", "old") for i in range(200)], SCHEMA))
    table.upsert(spark.createDataFrame([(7, "a", "new")], SCHEMA))
    assert len([p for p in (tmp_path / "t" / "data" / "version=2").iterdir() if p.is_dir()]) == 1
    assert table.read().count() == 200
