"""The live queries' workload: a change log made of ``orders``, applied by the live engine.

Three commits, each drained by itself: all orders are inserted; those with ``o_orderkey % 11 = 0`` and
those of the highest prices are deleted, so that values leave the sets and a maximum is retracted; of the
rest, those with ``o_orderkey % 7 = 0`` get the status F by a partial update. Every live query of the
registry is registered on one engine before the log is read, so all are kept by one stream; ``LATE`` is
registered after the first commit and one query sleeps through the second.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brooklet.operators.predicate import subqueries
from brooklet.schema import TableSchema
from brooklet.sources.fs import scratch_root
from brooklet.streaming.engine import LiveEngine
from brooklet.streaming.protocol import ShapeProtocol
from brooklet.streaming.retention import Limits

_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
_F = "o_orderstatus = 'F'"
#: Orders of this part of the highest price or more are deleted.
HIGH = 0.9
PRIORITIES = ("1-URGENT", "2-HIGH")
_INNER = f"(SELECT o_custkey FROM orders WHERE {_F})"


class Replay:
    def __init__(self, spark: SparkSession, sf_dir: str):
        orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(*_COLUMNS)
        customer = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")
        e = self.engine = LiveEngine(spark, scratch_root(spark, "replay"))
        e.define_table(TableSchema.from_df("orders", orders, "o_orderkey"), orders.limit(0), counts=["o_orderstatus", "o_orderpriority"])
        e.define_table(TableSchema.from_df("customer", customer, "c_custkey"), customer)
        self.filter = e.create_shape("orders", _F, ["o_orderkey", "o_orderstatus", "o_totalprice"])
        self.routed = {s: e.create_shape("orders", f"o_orderstatus = '{s}'", ["o_orderkey"]) for s in ("F", "O", "P")}
        self.member = e.create_shape("customer", f"c_custkey IN {_INNER}")
        self.outsider = e.create_shape("customer", f"c_custkey NOT IN {_INNER}")
        self.either = e.create_shape("customer", f"c_custkey < 100 OR c_custkey IN {_INNER}")
        self.family = dict(zip(PRIORITIES, e.create_shapes("customer", [f"c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '{p}' AND {_F})" for p in PRIORITIES]), strict=True))
        self.changes = e.create_shape("orders", _F, ["o_orderkey"], changes_only=True)
        self.sleeper = e.create_shape("orders", "o_orderstatus = 'F' AND o_totalprice > 100000", ["o_orderkey"])
        self.aggregates = {fn: e.create_aggregate("orders", fn, None if fn == "count" else "o_totalprice", _F) for fn in ("count", "sum", "max")}
        schema = e.schemas["orders"]
        e.log.append_rows(schema, "upsert", orders)
        e.run()
        asked = {"table": "public.orders", "where": "o_orderstatus = $1 AND o_totalprice > 100000", "params[1]": "F", "columns": "o_orderkey"}
        self.protocol = ShapeProtocol(e)
        self.snapshot = self.protocol.get(asked | {"offset": "-1"})
        self.late = e.create_shape("orders", "o_totalprice < 50000", ["o_orderkey"])
        e.release(self.sleeper)
        e.sweep(Limits(idle=1), now=time.monotonic() + 5)
        top = orders.agg(F.max("o_totalprice")).first()[0]
        e.log.append_rows(schema, "delete", orders.filter((F.col("o_orderkey") % 11 == 0) | (F.col("o_totalprice") >= HIGH * top)))
        e.run()
        e.reactivate(self.sleeper)
        e.log.append_rows(schema, "update", orders.filter((F.col("o_orderkey") % 11 != 0) & (F.col("o_totalprice") < HIGH * top) & (F.col("o_orderkey") % 7 == 0)).withColumn("o_orderstatus", F.lit("F")), columns=["o_orderkey", "o_orderstatus"])
        e.run()
        self.live = self.protocol.get({"table": "orders"} | {k: self.snapshot["headers"][k] for k in ("handle", "offset")})

    def contributors(self) -> DataFrame:
        """The state behind the subquery: its values, and how many rows hold each up."""
        sets = self.engine.sets
        leaf = subqueries(self.engine.shapes[self.member].predicate)[0]
        return sets._bound(leaf, sets.state(sets.node(leaf), self.engine.version)).select("value", "w")

    def router(self) -> DataFrame:
        out = None
        for s, shape in self.routed.items():
            part = self.engine.rows(shape).select(F.lit(s).alias("shape_key"), "o_orderkey")
            out = part if out is None else out.unionByName(part)
        return out


_done: dict[tuple[str, str], Replay] = {}


def replay(spark: SparkSession, sf_dir: str) -> Replay:
    """One replay for each session and folder; its queries share it."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _done:
        _done[key] = Replay(spark, sf_dir)
    return _done[key]
