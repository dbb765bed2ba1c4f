"""Registered queries of the engine's smaller parts: decoders, predicate tools, weighted rows, gates, pages
and the shape protocol, each with the SQL of the same result."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brooklet.functions import zset
from brooklet.operators import subset
from brooklet.operators.aggregate import Aggregate
from brooklet.operators.predicate import canonical, from_json, matches, subqueries, to_json, to_sql, validate
from brooklet.operators.where_parser import parse
from brooklet.plans.replay import HIGH, replay
from brooklet.schema import TableSchema, ValidationError
from brooklet.sources import pgoutput
from brooklet.sources.changelog import ENVELOPE, typed
from brooklet.sources.gate import SnapshotGate
from brooklet.streaming import membership, retention
from brooklet.streaming.live_subset import LiveSubset

_NESTED = "p_size > 10 AND (p_brand LIKE 'Brand#1%' OR NOT (p_type = 'PROMO')) AND p_name <> 'it''s'"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written as replication messages, with those of a table nobody asked for, and decoded."""
    rows = _read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    schema = TableSchema.from_df("customer", rows, "c_custkey")
    keys = [(c, c == "c_custkey") for c in rows.columns]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for lsn, b in enumerate(batches):
            messages = [pgoutput.relation(1, "public", "customer", keys), pgoutput.relation(2, "public", "other", keys), pgoutput.begin(lsn, lsn)]
            for r in b.itertuples(index=False):
                cells = [None if x is None else str(x) for x in r]
                messages += [pgoutput.insert(2, cells), pgoutput.insert(1, cells)]
            found = list(pgoutput.envelopes(iter([*messages, pgoutput.commit(lsn)]), {"customer": schema}))
            yield pd.DataFrame({c: [e[c] for e in found] for c in ("type", "key", "value", "old", "headers")})

    return rows.mapInPandas(run, ENVELOPE).select(*typed(schema, F.col("value")))


def _by_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A predicate turned to SQL text and parameters, run as SQL."""
    part, params = _read(spark, sf_dir, "part"), []
    p = validate(parse(_NESTED), "part", {"part": TableSchema.from_df("part", part, "p_partkey")})
    text = to_sql(p, params).replace('"', "`")
    for i in range(len(params), 0, -1):
        text = text.replace(f"${i}", f":v{i}")
    return spark.sql(f"SELECT p_partkey FROM {{part}} WHERE {text}", args={f"v{i}": v for i, v in enumerate(params, 1)}, part=part)


def _by_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row evaluator, over batches of rows."""
    part = _read(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand", "p_type", "p_name")
    p = validate(parse(_NESTED), "part", {"part": TableSchema.from_df("part", part, "p_partkey")})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.loc[[matches(p, r) for r in b.to_dict("records")], ["p_partkey"]]

    return part.mapInPandas(run, "p_partkey long")


def _same_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that differ in order only, or went through JSON, have one canonical form."""
    texts = ["p_size > 1 AND (p_type = 'A' OR p_brand = 'B')", "(p_brand = 'B' OR p_type = 'A') AND p_size > 1", "p_size > 2 AND (p_type = 'A' OR p_brand = 'B')"]
    forms = [canonical(from_json(to_json(parse(t)))) for t in texts]
    return spark.createDataFrame([(i, forms.index(f)) for i, f in enumerate(forms)], "i int, same_as int")


def _refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which requests are errors of the caller."""
    orders = TableSchema.from_df("orders", _read(spark, sf_dir, "orders"), "o_orderkey")
    asked = [("count", None, None), ("sum", None, None), ("sum", "o_orderpriority", None), ("median", "o_totalprice", None), ("max", "nope", None), ("avg", "o_totalprice", "o_custkey IN (SELECT c_custkey FROM customer)"), ("min", "o_orderpriority", "o_custkey > 5")]
    out = []
    for i, (fn, col, text) in enumerate(asked):
        try:
            Aggregate(fn, col).check(orders, parse(text) if text else None)
            out.append((i, False))
        except ValidationError:
            out.append((i, True))
    return spark.createDataFrame(out, "i int, refused boolean")


def _dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stamped twice over, and seen up to a mark."""
    e = _read(spark, sf_dir, "events").select("event_id", F.floor(F.col("event_id") / 10).alias("l"), (F.col("event_id") % 10).cast("long").alias("s"))
    return zset.dedup(e.unionByName(e), (20, 4), F.col("l"), F.col("s")).select("event_id")


def _weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images to weighted rows and back to feed rows: prices of every third order change, every fifth order goes."""
    o = _read(spark, sf_dir, "orders")
    row = lambda price: F.struct(F.col("o_custkey").alias("c"), price.alias("p"))
    price = F.when(F.col("o_orderkey") % 3 == 0, F.lit(1.0)).otherwise(F.col("o_totalprice").cast("double"))
    images = o.select(F.col("o_orderkey").alias("key"), row(F.col("o_totalprice").cast("double")).alias("old"), F.when(F.col("o_orderkey") % 5 != 0, row(price)).alias("new"))
    return zset.feed(zset.delta(images), ["key"]).select("key", "op", "row.p")


_GATE = SnapshotGate(lsn=150, xmin=100, xmax=400, xip=(120, 130, 333))


def _gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 4 != 0, F.col("event_id")).cast("long").alias("xid"))
    return e.filter(~_GATE.skipped(F.col("xid"), F.col("event_id").cast("long"))).select("event_id")


def _sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The window's comparator, on the 25 nations."""
    nation = _read(spark, sf_dir, "nation")
    schema = TableSchema.from_df("nation", nation, "n_nationkey")
    rows = sorted((r.asDict() for r in nation.collect()), key=subset.comparator(schema, ("n_regionkey", "desc")))
    return spark.createDataFrame([(i, r["n_nationkey"]) for i, r in enumerate(rows, 1)], "rank int, n_nationkey long")


def _evicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dormant queries beyond the limit go, the longest idle first; one for each nation."""
    uses = [retention.ShapeUse(str(r["n_nationkey"]), r["n_regionkey"] % 2, 1000 - r["n_nationkey"], 10.0, bytes=10) for r in _read(spark, sf_dir, "nation").collect()]
    return spark.createDataFrame([(int(i),) for i in retention.plan(uses, retention.Limits(most_shapes=18)).evict], "n_nationkey long")


_TOP, _TOP_ORDER, _TOP_ROWS = "o_orderstatus = 'F'", ("o_totalprice", "asc"), 200


def _live_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page read after the first commit, kept by the feed of the others."""
    e = (r := replay(spark, sf_dir)).engine
    schema, cols = e.schemas["orders"], ["o_orderkey", "o_totalprice"]
    page = LiveSubset(schema, _TOP_ORDER, _TOP_ROWS)
    page.load([x.asDict() for x in subset.query_subset(e.table("orders", 1), schema, parse(_TOP), cols, _TOP_ORDER, _TOP_ROWS).collect()], 1)
    edge = page.boundary["o_totalprice"]
    fed = e.feed(r.filter, after=1).withColumn("price", F.coalesce(F.col("value"), F.col("old"))["o_totalprice"].cast("double")).filter(F.col("price") <= edge)  # what lies outside never enters
    for x in sorted(fed.collect(), key=lambda x: x["version"]):
        row = None if x["value"] is None else {"o_orderkey": int(x["value"]["o_orderkey"]), "o_totalprice": type(edge)(x["value"]["o_totalprice"])}
        page.merge(x["op"], x["key"], row, x["version"])
    return spark.createDataFrame([(x["o_orderkey"], float(x["o_totalprice"])) for x in page.ordered()], "o_orderkey long, o_totalprice double")


def _messages(which: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return getattr(replay(spark, sf_dir), which)["messages"].frame().select("operation", "key")

    return run


def _views(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = replay(spark, sf_dir)
    return spark.createDataFrame([(i, x["key"], x["value"]["o_orderstatus"]) for i, x in enumerate(r.protocol.rows(r.filter, 40))], "i int, key string, o_orderstatus string")


def _probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose key the subquery's set holds as of the second commit, asked of the state."""
    e = (r := replay(spark, sf_dir)).engine
    p = e.shapes[r.member].predicate
    assert len(subqueries(p)) == 1
    rows = e.table("customer").filter("c_custkey % 2 = 0")
    return e.sets.decided("customer", rows, p, 2, rows.count() <= membership.BROADCAST_VALUES).select("c_custkey")


_GONE = f"(o_orderkey % 11 = 0 OR o_totalprice >= {HIGH} * (SELECT MAX(o_totalprice) FROM orders))"
_LAST = f"(SELECT o_orderkey, o_totalprice, CASE WHEN o_orderkey % 7 = 0 THEN 'F' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE NOT {_GONE}) f"
_BIG = "o_totalprice > 100000"

#: name -> (query, SQL).
PARTS = {
    "src_replication_decode": (_decoded, "SELECT c_custkey, c_name, c_nationkey FROM customer"),
    "pred_to_sql": (_by_sql, f"SELECT p_partkey FROM part WHERE {_NESTED}"),
    "pred_row_evaluator": (_by_row, f"SELECT p_partkey FROM part WHERE {_NESTED}"),
    "pred_canonical": (_same_text, "SELECT * FROM (VALUES (0, 0), (1, 0), (2, 2)) v(i, same_as)"),
    "agg_validation": (_refused, "SELECT * FROM (VALUES (0, FALSE), (1, TRUE), (2, TRUE), (3, TRUE), (4, TRUE), (5, TRUE), (6, FALSE)) v(i, refused)"),
    "zset_dedup": (_dedup, "SELECT event_id FROM events WHERE event_id > 204"),
    "zset_feed": (_weighted, "SELECT o_orderkey AS key, CASE WHEN o_orderkey % 5 = 0 THEN 'delete' ELSE 'upsert' END AS op, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(1 AS DOUBLE) END AS p FROM orders WHERE o_orderkey % 5 = 0 OR (o_orderkey % 3 = 0 AND o_totalprice <> 1)"),
    "snapshot_gate": (_gated, "SELECT event_id FROM events WHERE NOT CASE WHEN event_id % 4 <> 0 THEN event_id < 100 OR (event_id < 400 AND event_id NOT IN (120, 130, 333)) ELSE event_id < 150 END"),
    "sort_window_comparator": (_sorted, "SELECT CAST(row_number() OVER (ORDER BY n_regionkey DESC, n_nationkey DESC) AS INTEGER) AS rank, CAST(n_nationkey AS BIGINT) AS n_nationkey FROM nation"),
    "retention_lru": (_evicted, "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey FROM nation WHERE n_regionkey % 2 = 0 ORDER BY n_nationkey LIMIT 7"),
    "live_page_merge": (_live_page, f"SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) AS o_totalprice FROM {_LAST} WHERE o_orderstatus = 'F' AND (o_totalprice, o_orderkey) <= (SELECT (o_totalprice, o_orderkey) FROM (SELECT o_totalprice, o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice, o_orderkey LIMIT {_TOP_ROWS}) t ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 1)"),
    "proto_snapshot": (_messages("snapshot"), f"SELECT 'insert' AS operation, CAST(o_orderkey AS VARCHAR) AS key FROM orders WHERE o_orderstatus = 'F' AND {_BIG}"),
    "proto_live": (_messages("live"), f"SELECT 'delete' AS operation, CAST(o_orderkey AS VARCHAR) AS key FROM orders WHERE o_orderstatus = 'F' AND {_BIG} AND {_GONE} UNION ALL SELECT 'insert', CAST(o_orderkey AS VARCHAR) FROM orders WHERE NOT {_GONE} AND o_orderkey % 7 = 0 AND o_orderstatus <> 'F' AND {_BIG}"),
    "proto_rows_view": (_views, f"SELECT CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS INTEGER) AS i, CAST(o_orderkey AS VARCHAR) AS key, o_orderstatus FROM {_LAST} WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 40"),
    "live_membership_probe": (_probe, f"SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0 AND c_custkey IN (SELECT o_custkey FROM orders WHERE NOT {_GONE} AND o_orderstatus = 'F')"),
}
