"""The client surface: one object with the engine's public calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brooklet.schema import TableSchema
from brooklet.streaming.engine import LiveEngine
from brooklet.streaming.live_subset import LiveSubset
from brooklet.streaming.protocol import Materialized, ShapeProtocol


class Client:
    """define_schema, write, shape, query, subset, live_subset, aggregate, over one engine root."""

    def __init__(self, spark: SparkSession, root: str):
        self.engine = LiveEngine(spark, root)
        self.protocol = ShapeProtocol(self.engine)

    def define_schema(self, name: str, doc: dict, counts: list[str] | None = None) -> None:
        self.engine.define_table(TableSchema.from_json(name, doc), counts=counts)

    def register(self, name: str, rows: DataFrame, primary_key: str | list[str], counts: list[str] | None = None) -> None:
        self.engine.define_table(TableSchema.from_df(name, rows, primary_key), rows, counts)

    def write(self, table: str, op: str, key: dict | None = None, row: dict | None = None, txid: int | None = None) -> int:
        return self.engine.write(table, op, key, row, txid)

    def insert_row(self, table: str, values: dict) -> int:
        return self.engine.log.insert_row(self.engine.schemas[table], values)

    def delete_rows(self, table: str, keys: list[dict]) -> int:
        return self.engine.log.delete_rows(self.engine.schemas[table], keys)

    def shape(self, table: str, where=None, columns: list[str] | None = None, changes_only: bool = False) -> Materialized:
        return Materialized(self.engine, self.engine.create_shape(table, where, columns, changes_only))

    def query(self, table: str, where=None, columns: list[str] | None = None) -> DataFrame:
        return self.engine.query(table, where, columns)

    def subset(self, table: str, **page) -> tuple[DataFrame, int]:
        return self.engine.query_subset(table, **page)

    def live_subset(self, table: str, where=None, order_by=None, limit: int = 100) -> tuple[LiveSubset, Materialized]:
        """A live page and the changes-only feed that keeps it current."""
        feed = self.shape(table, where, changes_only=True)
        page = LiveSubset(self.engine.schemas[table], order_by, limit)
        rows, version = self.engine.query_subset(table, where, None, order_by, limit)
        page.load([r.asDict() for r in rows.collect()], version)
        return page, feed

    def aggregate(self, table: str, fn: str, col: str | None = None, where=None) -> Materialized:
        return Materialized(self.engine, self.engine.create_aggregate(table, fn, col, where))

    def drain(self) -> None:
        self.engine.run()
