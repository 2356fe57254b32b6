"""Chains, retries and exact windows over several runs, also after a broken one."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from spendlight.operators import ingest as I
from spendlight.sources.tables import KeyedTable
from spendlight.streaming import chain as C
from spendlight.streaming import events as S
from spendlight.streaming.state import first_in_ttl, timed_state


def sent(spark, folder, numbers):
    rows = [(f"e{n}", "artifact.ingested", str(n), f"k{n}", 0) for n in numbers]
    spark.createDataFrame(rows, C.EVENT).coalesce(1).write.mode("append").parquet(folder)


def found(spark, home, name, sink):
    return sorted((r["event_id"], r["attempt"], r["idempotency_key"]) for r in C.read_sink(spark, home, name, sink).collect())


def failing(batch):
    bad = F.col("artifact_id") == "3"
    return batch.where(~bad), C.follow(batch.where(~bad), "artifact.parse_requested", "parse:"), batch.where(bad)


def test_the_fourth_failure_is_dead_once(spark, tmp_path, monkeypatch):
    home, source = str(tmp_path / "home"), str(tmp_path / "source")
    sent(spark, source, range(6))
    written, once = [], C._once

    def lost(batch, folder, number):
        once(batch, folder, number)
        if folder.endswith("dead") and not batch.isEmpty():
            written.append(number)
            if len(written) == 1:
                raise OSError("lost after the dead letter was written")

    monkeypatch.setattr(C, "_once", lost)
    with pytest.raises(Exception, match="lost after"):
        C.run_stage(spark, home, "work", source, failing)
    # the broken batch runs again and finds its dead letter there
    C.run_stage(spark, home, "work", source, failing)
    assert len(written) == 2 and written[0] == written[1]
    assert found(spark, home, "work", "dead") == [("e3", 3, "k3:retry:3")]
    assert found(spark, home, "work", "kept") == [(f"e{n}", 0, f"k{n}") for n in (0, 1, 2, 4, 5)]
    # nothing new: nothing happens; a later event goes the same way
    C.run_stage(spark, home, "work", source, failing)
    sent(spark, source, [7])
    C.run_stage(spark, home, "work", source, failing)
    assert [e for e, _, _ in found(spark, home, "work", "kept")] == ["e0", "e1", "e2", "e4", "e5", "e7"]
    assert found(spark, home, "work", "dead") == [("e3", 3, "k3:retry:3")]


def test_an_event_travels_the_chain_in_one_run(spark, tmp_path):
    home, source = str(tmp_path / "home"), str(tmp_path / "source")
    sent(spark, source, range(4))
    nothing = lambda b: b.where("false")
    stages = {"ingest": failing, "parse": lambda b: (b, C.follow(b, "artifact.normalize_requested", "normalize:"), nothing(b)), "normalize": lambda b: (b, nothing(b), nothing(b))}
    C.run_chain(spark, home, source, stages)
    assert found(spark, home, "normalize", "kept") == [(f"normalize:parse:e{n}", 0, f"normalize:{n}") for n in (0, 1, 2)]
    sent(spark, source, [9])
    C.run_chain(spark, home, source, stages)
    assert [k for _, _, k in found(spark, home, "normalize", "kept")] == [f"normalize:{n}" for n in (0, 1, 2, 9)]


def test_exact_windows_over_micro_batches(spark, tmp_path):
    rng, at, slices = random.Random(2), 0, []
    for part in range(3):
        rows = []
        for i in range(60):
            at += rng.randrange(90)
            rows.append((part * 100 + i, f"k{rng.randrange(4)}", at))
        slices.append(spark.createDataFrame(rows, "event_id long, idempotency_key string, s long").select("event_id", "idempotency_key", F.timestamp_seconds("s").alias("ts")))
    source = str(tmp_path / "events")
    with timed_state(spark):
        out = S.replay(spark, source, lambda s: first_in_ttl(s, 600), "ttl", schema="event_id long, idempotency_key string, ts timestamp", slices=slices)
    assert {tuple(r) for r in out.collect()} == {tuple(r) for r in I.first_in_ttl(spark.read.parquet(source), 600).collect()}


def test_older_rows_give_way(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), "k long, v string, at long", ("k",), parts=2)
    table.upsert(spark.createDataFrame([(1, "new", 9), (2, "old", 1)], "k long, v string, at long"), "at", keep_newer=True)
    table.upsert(spark.createDataFrame([(1, "late", 3), (2, "new", 5), (3, "only", 2)], "k long, v string, at long"), "at", keep_newer=True)
    assert sorted(tuple(r) for r in table.read().collect()) == [(1, "new", 9), (2, "new", 5), (3, "only", 2)]
