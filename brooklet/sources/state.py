"""A table's rows at a version: a base and the changes on top, merged when read.

Every applied batch adds one delta (the new image of each changed key, or a tombstone). Reading
takes the latest delta row of each key and the base rows whose key no delta names. The delta's
keys are broadcast when they were counted within BROADCAST_KEYS, so reading doesn't shuffle the
base; beyond that both sides shuffle by key. Compaction writes a new base and keeps old files
for readers of older versions until they are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brooklet.functions.zset import latest_per_key
from brooklet.schema import TableSchema

BROADCAST_KEYS = 20_000
COMPACT_AFTER = 20


class TableState:
    def __init__(self, spark: SparkSession, root: str, schema: TableSchema, bases: list[int] | None = None, deltas: dict[int, int] | None = None):
        self.spark, self.root, self.schema = spark, f"{root}/{schema.name}", schema
        self.bases: list[int] = bases or []
        self.deltas: dict[int, int] = deltas or {}  # version -> changed keys

    def _path(self, kind: str, v: int) -> str:
        return f"{self.root}/{kind}={v:09d}"

    def load(self, rows: DataFrame, version: int) -> None:
        """Start from rows that exist already."""
        names = self.schema.struct().names
        rows.select(*names).write.mode("overwrite").parquet(self._path("base", version))
        self.bases = [version]

    def apply(self, images: DataFrame, version: int, count: int) -> None:
        """Advance by the (old, new) images of changed keys."""
        keys = [F.coalesce(F.col(f"new.{c}"), F.col(f"old.{c}")).alias(c) for c in self.schema.primary_key]
        rest = [F.col(f"new.{c}").alias(c) for c in self.schema.struct().names if c not in self.schema.primary_key]
        images.select(*keys, *rest, F.col("new").isNull().alias("_gone")).write.mode("overwrite").parquet(self._path("delta", version))
        self.deltas[version] = count

    def at(self, version: int) -> DataFrame:
        """The rows as of a version."""
        names, pk = self.schema.struct().names, list(self.schema.primary_key)
        base_v = max((v for v in self.bases if v <= version), default=None)
        after = [v for v in sorted(self.deltas) if v <= version and (base_v is None or v > base_v)]
        struct = self.schema.struct()
        base = self.spark.createDataFrame([], struct) if base_v is None else self.spark.read.schema(struct).parquet(self._path("base", base_v)).select(*names)
        if not after:
            return base
        typed = {f.name: f.dataType for f in struct.fields}
        ddl = ", ".join(f"`{c}` {typed[c].simpleString()}" for c in [*pk, *(c for c in names if c not in pk)]) + ", _gone boolean"
        parts = None
        for v in after:
            d = self.spark.read.schema(ddl).parquet(self._path("delta", v)).withColumn("_v", F.lit(v))
            parts = d if parts is None else parts.unionByName(d)
        last = latest_per_key(parts, pk, F.col("_v")) if len(after) > 1 else parts
        fresh = last.filter(~F.col("_gone")).select(*names)
        if base_v is None:
            return fresh
        touched = parts.select(*pk).distinct() if len(after) > 1 else parts.select(*pk)
        if sum(self.deltas[v] for v in after) <= BROADCAST_KEYS:
            touched = F.broadcast(touched)
        return base.join(touched, pk, "left_anti").select(*names).unionByName(fresh)

    def compact(self, version: int) -> None:
        if sum(v <= version for v in self.deltas) > COMPACT_AFTER and version not in self.bases:
            self.at(version).write.mode("overwrite").parquet(self._path("base", version))
            self.bases.append(version)
