"""Landing payloads: decode, verify, deduplicate, store paths, parse."""

from __future__ import annotations

import json
from bisect import bisect_left
from collections import deque

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlight.storage import store


def content_hash(content) -> Column:
    return F.sha2(content, 256)


def decode_payload(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events with their decoded bytes and hash, and the rejected ones with a reason."""
    data = F.try_to_binary(F.nullif(F.col("raw_data_hex"), F.lit("")), F.lit("hex"))
    out = events.withColumn("content", data)
    good = out.where(F.col("content").isNotNull()).withColumn("computed_hash", F.sha2("content", 256))
    return good, out.where(F.col("content").isNull()).withColumn("reason", F.lit("no data")).drop("content")


def verify_hash(decoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    wrong = (F.coalesce("content_hash", F.lit("")) != "") & (F.lower("content_hash") != F.col("computed_hash"))
    return decoded.where(~wrong), decoded.where(wrong).withColumn("reason", F.lit("hash mismatch"))


def new_artifacts(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """The first of each (source, content_hash) that isn't stored yet; copies are reduced before they are shuffled."""
    first = batch.groupBy("source", "content_hash").agg(F.min_by(F.struct(*batch.columns), F.struct("retrieved_at", "artifact_id")).alias("first"))
    kept = first.join(stored.select("source", "content_hash"), ["source", "content_hash"], "left_anti")
    return kept.select("first.*")


def storage_path(source: Column, digest: Column) -> Column:
    return F.concat(F.lit("artifacts/"), F.substring(digest, 1, 2), F.lit("/"), digest, F.lit("/"), source, F.lit(".raw"))


def json_path(source: Column, digest: Column) -> Column:
    return F.concat(F.lit("artifacts/"), source, F.lit("/"), F.substring(digest, 1, 16), F.lit(".json"))


def first_in_ttl(events: DataFrame, ttl_seconds: int = 3600) -> DataFrame:
    """``(idempotency_key, event_id)`` of the events whose key wasn't accepted within the ttl before; each one accepted arms the ttl anew.

    Events without a time are all accepted; a null key is a key. Events lie in range cells of key and time, so
    a key with very many of them lies in several. For each cell of such a key it is worked out when it is left after
    being entered with any last accepted time; these steps are chained over the key's cells, and then every cell is walked by itself.
    """
    at = F.unix_micros(F.col("ts").cast("timestamp")).alias("at")
    key = F.concat(F.when(F.col("idempotency_key").isNull(), "-").otherwise("+"), F.coalesce(F.col("idempotency_key").cast("string"), F.lit(""))).alias("key")
    slim = events.select(key, at, "idempotency_key", "event_id")
    dealt = store(slim.repartitionByRange("key", "at", "event_id").withColumn("cell", F.spark_partition_id()))
    timed, ttl = dealt.where("at is not null"), ttl_seconds * 1_000_000
    # a border between two cells is crossed by one key at most: this table has fewer rows than there are cells
    split = timed.groupBy("key").agg(F.min("cell").alias("low"), F.max("cell").alias("high")).where("low < high").select("key")
    entered = _entries(_steps(timed.join(F.broadcast(split), "key", "left_semi"), ttl))
    rows = timed.join(F.broadcast(entered), ["key", "cell"], "left").repartition("key", "cell").sortWithinPartitions("key", "cell", "at", "event_id")

    def run(batches):
        cell, last = None, None
        for batch in batches:
            kept = []
            for i, (k, c, t, entry) in enumerate(zip(*(batch.column(j).to_pylist() for j in range(4)), strict=True)):
                if (k, c) != cell:
                    cell, last = (k, c), entry
                if last is None or t >= last + ttl:
                    kept.append(i)
                    last = t
            yield batch.take(pa.array(kept, pa.int64())).select(["idempotency_key", "event_id"])

    kinds = dict(slim.dtypes)
    taken = rows.select("key", "cell", "at", "entry", "idempotency_key", "event_id").mapInArrow(run, f"idempotency_key {kinds['idempotency_key']}, event_id {kinds['event_id']}")
    return taken.unionByName(dealt.where("at is null").select("idempotency_key", "event_id"))


class TtlSteps:
    """The last accepted time that a cell is left with, as a step function of that it is entered with."""

    def __init__(self, first: int, ttl: int):
        self.first, self.ttl, self.bound = first, ttl, None
        # open ways through the cell: their last accepted time, ascending, and the entries that lead to it
        self.ways: deque[tuple[int, list[int]]] = deque()

    def add(self, t: int) -> None:
        joined: list[int] = []
        while self.ways and self.ways[0][0] <= t - self.ttl:
            more = self.ways.popleft()[1]
            joined, more = (joined, more) if len(joined) >= len(more) else (more, joined)
            joined += more
        # entries up to here haven't met an event that they let in yet; none is later than the cell's first event
        if self.bound is None or self.bound < min(t - self.ttl, self.first):
            self.bound = t - self.ttl
            joined.append(self.bound)
        if joined:
            self.ways.append((t, joined))

    def steps(self) -> list[tuple[int, int]]:
        """``(entry, exit)``: entries up to the first and above the one before leave with the second; entries above the last leave as they came."""
        out: list[tuple[int, int]] = []
        for entry, left in sorted((entry, last) for last, entries in self.ways for entry in entries):
            if out and out[-1][1] == left:
                out.pop()
            out.append((entry, left))
        return out


def _steps(timed: DataFrame, ttl: int) -> DataFrame:
    """``(key, cell, steps)`` for each cell of ``timed``."""
    kind = pa.list_(pa.struct([("entry", pa.int64()), ("left", pa.int64())]))

    def run(batches):
        cell, steps = None, None

        def row():
            found = [{"entry": entry, "left": left} for entry, left in steps.steps()]
            return pa.RecordBatch.from_arrays([pa.array([cell[0]]), pa.array([cell[1]], pa.int32()), pa.array([found], kind)], ["key", "cell", "steps"])

        for batch in batches:
            for k, c, t in zip(*(batch.column(j).to_pylist() for j in range(3)), strict=True):
                if (k, c) != cell:
                    if cell is not None:
                        yield row()
                    cell, steps = (k, c), TtlSteps(t, ttl)
                steps.add(t)
        if cell is not None:
            yield row()

    sorted_ = timed.select("key", "cell", "at").distinct().repartition("key", "cell").sortWithinPartitions("key", "cell", "at")
    return sorted_.mapInArrow(run, "key string, cell int, steps array<struct<entry: long, left: long>>")


def _entries(steps: DataFrame) -> DataFrame:
    """``(key, cell, entry)``: the last accepted time that each cell is entered with, null in a key's first cell."""

    def run(batches):
        key, last = None, None
        for batch in batches:
            entries = []
            for k, found in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if k != key:
                    key, last = k, None
                entries.append(last)
                at = 0 if last is None else bisect_left(found, last, key=lambda s: s["entry"])
                last = found[at]["left"] if at < len(found) else last
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(entries, pa.int64())], ["key", "cell", "entry"])

    return store(steps.repartition("key").sortWithinPartitions("key", "cell").mapInArrow(run, "key string, cell int, entry long"))


def _walk(value, depth: int = 0) -> list[str]:
    """Scalars depth first, blanks and nulls left out, as the source's language prints them."""
    if depth > 8 or value is None:
        return []
    if isinstance(value, dict):
        return [x for v in value.values() for x in _walk(v, depth + 1)]
    if isinstance(value, list):
        return [x for v in value for x in _walk(v, depth + 1)]
    text = str(value).strip()
    return [text] if text else []


def _flatten(contents: pd.Series) -> pd.Series:
    def one(x):
        if x is None:
            return None
        try:
            return " ".join(_walk(json.loads(x)))
        except ValueError:
            return x

    return contents.map(one)


def extract_text(docs: DataFrame, json_types: tuple[str, ...], cap: int = 1_000_000) -> DataFrame:
    """``docs`` with text: JSON contents flattened, others as they are, cut at ``cap`` characters."""
    is_json = F.coalesce(F.col("doc_type").isin(*json_types), F.lit(False)) | F.coalesce(F.startswith(F.ltrim("content"), F.lit("{")), F.lit(False))
    # by filter and union: beside a Python function, when() would send every row to Python
    as_is = docs.where(~is_json).withColumn("text", F.substring("content", 1, cap))
    flat = docs.where(is_json).withColumn("text", F.substring(F.pandas_udf(_flatten, "string")(F.col("content")), 1, cap))
    return as_is.unionByName(flat)


def new_docs(parsed: DataFrame, stored: DataFrame) -> DataFrame:
    return parsed.dropDuplicates(["artifact_id"]).join(stored.select("artifact_id"), "artifact_id", "left_anti").select(*parsed.columns)


def run_summary(fetched: DataFrame) -> DataFrame:
    """Per run: fetched, stored, deduplicated, errors and status."""
    by = fetched.groupBy("run_id").agg(F.count(F.lit(1)).alias("fetched"), F.count_if(F.col("outcome") == "stored").alias("stored"), F.count_if(F.col("outcome") == "duplicate").alias("deduplicated"), F.count_if(F.col("outcome") == "error").alias("errors"))
    return by.withColumn("status", F.when(F.col("errors") > 0, "partial").otherwise("completed"))


def upsert_sources(current: DataFrame, new: DataFrame) -> DataFrame:
    """The registry keyed by name: new values win, what is missing stays."""
    n = new.select("name", F.col("base_url").alias("new_url"), F.col("is_active").alias("new_active"))
    return current.join(n, "name", "full").select("name", F.coalesce("new_url", "base_url").alias("base_url"), F.coalesce("new_active", "is_active").alias("is_active"))


def active_sources(registry: DataFrame, name: str | None = None) -> DataFrame:
    """The sources that may be fetched, or the one of a name if it may."""
    active = registry.where(F.coalesce("is_active", F.lit(False)))
    return active if name is None else active.where(F.col("name") == name)


def canonical_json(df: DataFrame) -> Column:
    """Record text with sorted keys, nulls and private keys left out."""
    keys = sorted(c for c in df.columns if not c.startswith("_"))
    return F.to_json(F.struct(*keys))
