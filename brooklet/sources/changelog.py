"""The change log: an ordered log of row changes, one folder per commit, JSON lines inside.

A commit is written aside and renamed into the log, so a reader sees whole commits. Envelopes
carry a table, a key, the new values (all columns, or some for a partial update), the old ones
where the source knows them, and headers with operation, transaction and position (lsn, seq).
Cells travel as text and are typed on reading; what doesn't parse becomes NULL.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brooklet.schema import KEY_JOINER, TableSchema, ValidationError
from brooklet.sources.fs import Store

ENVELOPE = "type string, key string, value map<string,string>, old map<string,string>, headers struct<operation: string, txid: bigint, lsn: bigint, seq: bigint>"
OPERATIONS = ("insert", "update", "upsert", "delete", "truncate")
#: Keys of one delete request.
MOST_KEYS = 1000


class ChangeLog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, Store(spark, root)
        names = self.store.list("commits")
        self.next_lsn = int(names[-1]) + 1 if names else 1

    @property
    def glob(self) -> str:
        return self.store.path("commits") + "/*"

    def _take(self) -> int:
        lsn, self.next_lsn = self.next_lsn, self.next_lsn + 1
        return lsn

    def append(self, envelopes: list[dict], txid: int | None = None) -> int:
        """Write one commit of envelopes and return its position. Those without a stamp get one."""
        lsn = self._take()
        lines = []
        for seq, e in enumerate(envelopes):
            h = {"txid": txid if txid is not None else lsn, "lsn": lsn, "seq": seq} | {k: v for k, v in e["headers"].items() if v is not None}
            text = lambda m: None if m is None else {c: None if v is None else (str(v).lower() if isinstance(v, bool) else str(v)) for c, v in m.items()}
            lines.append(json.dumps(e | {"headers": h, "value": text(e.get("value")), "old": text(e.get("old"))}))
        self.store.write_text(f"commits/{lsn:016d}/part.json", "\n".join(lines) + "\n")
        return lsn

    def append_rows(self, schema: TableSchema, op: str, rows: DataFrame, seq: Column | None = None, columns: list[str] | None = None) -> int:
        """One commit with a change for each row of a DataFrame; written by Spark, whatever its size. An
        update may carry some columns only, the key among them."""
        lsn, named = self._take(), schema.projected(columns) if op == "update" else list(schema.columns)
        cells = F.map_from_arrays(F.array(*[F.lit(c) for c in named]), F.array(*[F.col(c).cast("string") for c in named]))
        e = rows.select(
            F.lit(schema.name).alias("type"), schema.key().alias("key"), (F.lit(None).cast("map<string,string>") if op == "delete" else cells).alias("value"),
            F.struct(F.lit(op).alias("operation"), F.lit(lsn).alias("txid"), F.lit(lsn).alias("lsn"), (F.monotonically_increasing_id() if seq is None else seq).alias("seq")).alias("headers"),
        )
        e.write.option("ignoreNullFields", "false").json(self.store.path(f"_staged/{lsn:016d}"))
        self.store.rename(f"_staged/{lsn:016d}", f"commits/{lsn:016d}")
        return lsn

    def change(self, schema: TableSchema, op: str, key: dict | None = None, row: dict | None = None) -> dict:
        """A checked envelope. An insert or upsert takes a whole row, an update some columns."""
        if op not in OPERATIONS:
            raise ValidationError(f"unknown operation {op}")
        if op == "truncate":
            return {"type": schema.name, "key": None, "value": None, "headers": {"operation": op}}
        if row is None and op != "delete":
            raise ValidationError(f"{op} needs a row")
        given = dict(row or {})
        pk = {c: (key or given).get(c) for c in schema.primary_key}
        if any(v is None for v in pk.values()):
            raise ValidationError(f"{op} needs the primary key {', '.join(schema.primary_key)}")
        for c in key or {}:
            if c not in schema.primary_key:
                raise ValidationError(f"{c} is not part of the primary key")
        typed = schema.row(pk | given)
        value = None if op == "delete" else typed if op != "update" else {c: typed[c] for c in (*schema.primary_key, *given)}
        text = KEY_JOINER.join(str(typed[c]).lower() if isinstance(typed[c], bool) else str(typed[c]) for c in schema.primary_key)
        return {"type": schema.name, "key": text, "value": value, "headers": {"operation": op}}

    def insert_row(self, schema: TableSchema, values: dict) -> int:
        return self.append([self.change(schema, "insert", row=values)])

    def delete_rows(self, schema: TableSchema, keys: list[dict]) -> int:
        if len(keys) > MOST_KEYS:
            raise ValidationError(f"at most {MOST_KEYS} keys at once")
        return self.append([self.change(schema, "delete", key=k) for k in keys])


def typed(schema: TableSchema, cells: Column) -> list[Column]:
    """The columns of a table from a map of text cells."""
    return [cells[f.name].try_cast(f.dataType).alias(f.name) for f in schema.struct().fields]
