"""Tables of files whose rows are replaced by key.

Rows lie in ``parts`` partitions by the hash of their key. An upsert reads and writes only the
partitions that its rows fall into, as files of a new version beside the old ones; then it writes
a manifest that says which version holds each partition. A manifest counts once Spark has marked it as
finished, so readers see the rows before an upsert or those after it and nothing between, and an upsert
that is broken off leaves the table as it was; its files are overwritten by the next.
One writer at a time; old versions stay until ``forget`` removes them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlight.storage import discard, exists, folders

PART = "part__"


@dataclass(frozen=True)
class KeyedTable:
    """Rows of ``schema`` under unique ``keys`` in the folder ``path``; null keys are keys like others."""

    spark: SparkSession
    path: str
    schema: str
    keys: tuple[str, ...]
    parts: int = 64

    def _versions(self) -> list[int]:
        """Finished versions, ascending."""
        found = (int(name.removeprefix("version=")) for name in folders(self.spark, f"{self.path}/manifest") if name.startswith("version="))
        return sorted(v for v in found if exists(self.spark, f"{self.path}/manifest/version={v}/_SUCCESS"))

    def _manifest(self, version: int | None = None) -> tuple[int, dict[int, int]]:
        """The newest version (or that given) and the version that holds each filled partition, one row a partition."""
        versions = self._versions()
        if not versions:
            return 0, {}
        version = versions[-1] if version is None else version
        rows = self.spark.read.schema("part int, held long").parquet(f"{self.path}/manifest/version={version}").collect()
        return version, {r["part"]: r["held"] for r in rows}

    def _rows(self, held: dict[int, int]) -> DataFrame:
        folders_ = [f"{self.path}/data/version={v}/{PART}={p}" for p, v in sorted(held.items())]
        return self.spark.read.schema(self.schema).parquet(*folders_) if folders_ else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None) -> DataFrame:
        return self._rows(self._manifest(version)[1])

    def _part(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.parts)).cast("int")

    def upsert(self, rows: DataFrame, order: str | None = None, keep_newer: bool = False) -> int:
        """``rows`` take the place of those with their keys, new keys are added; returns the new version.

        Of rows that repeat a key that with the greatest ``order`` counts, then that with the greatest hash. With
        ``keep_newer`` the rows of the table compete in the same way, so that a row gives way to later ones only.
        """
        version, held = self._manifest()
        version += 1
        fields = [F.col(c) for c in self._rows({}).columns]
        rank = F.struct(*([order] if order else []), F.xxhash64(*fields))
        new = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*fields), rank).alias("row")).select("row.*").withColumn(PART, self._part())
        target = f"{self.path}/data/version={version}"
        stage = f"{self.path}/stage/version={version}"
        # the new rows are written once by themselves: their partitions say which old ones have to be read
        new.write.mode("overwrite").partitionBy(PART).parquet(stage)
        touched = sorted(int(name.removeprefix(f"{PART}=")) for name in folders(self.spark, stage) if name.startswith(f"{PART}="))
        staged = self.spark.read.schema(f"{self.schema}, {PART} int").parquet(stage)
        old = self._rows({p: held[p] for p in touched if p in held}).withColumn(PART, self._part())
        if keep_newer:
            merged = old.unionByName(staged).groupBy(*self.keys).agg(F.max_by(F.struct(*fields, PART), rank).alias("row")).select("row.*")
        else:
            same = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in self.keys]
            merged = old.alias("o").join(staged.select(*self.keys).alias("n").hint("merge"), same, "left_anti").unionByName(staged)
        merged.write.mode("overwrite").partitionBy(PART).parquet(target)
        self._publish(version, held | dict.fromkeys(touched, version))
        discard(self.spark, stage)
        return version

    def _publish(self, version: int, held: dict[int, int]) -> None:
        self.spark.createDataFrame(sorted(held.items()), "part int, held long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/version={version}")

    def forget(self) -> None:
        """Removes the manifests before the newest and the files that it doesn't name."""
        version, held = self._manifest()
        for v in self._versions()[:-1]:
            discard(self.spark, f"{self.path}/manifest/version={v}")
        for name in folders(self.spark, f"{self.path}/data"):
            v = int(name.removeprefix("version="))
            if v not in held.values():
                discard(self.spark, f"{self.path}/data/{name}")
                continue
            for part in folders(self.spark, f"{self.path}/data/{name}"):
                if part.startswith(f"{PART}=") and held.get(int(part.removeprefix(f"{PART}="))) != v:
                    discard(self.spark, f"{self.path}/data/{name}/{part}")
