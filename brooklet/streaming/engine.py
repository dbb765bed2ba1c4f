"""The live-query engine: registered queries, one change stream, exact feeds.

One Structured Streaming query reads the change log; each micro-batch is whole commits. A batch
becomes, per table, (old, new) images of the keys it changed, resolved against the table's
state. From these every kind of query is advanced with a few plans, however many queries:

* filters: both images are routed to the queries they match (families by an equi join with
  their parameters, the rest by wide projections); a key in the new image's result is an upsert,
  one only in the old image's a delete;
* filters with subqueries: the sets behind them are state (membership.py), advanced by the batch's
  deltas. The rows that can have changed are the batch's images and those whose connecting column
  holds a value that flipped; their verdicts before and after come from the state, and the
  difference is the feed. Images are routed first, by the conjuncts that need no subquery, so that
  queries which they cannot concern cost nothing; queries that differ in a subquery's values share one
  plan. Where a set gains or loses NULL or becomes (non-)empty under a negation, all rows are decided;
* aggregates: weighted sums are added to their state; MIN and MAX keep a multiset of values;
* counts by group columns: weighted sums.

A batch is one version, or with ``flush="commit"`` one for each commit of the log, so that what stood
between two commits is in the feeds, too. Batches are written under their id and overwritten if repeated,
and one catalog event commits them, so a batch takes effect once. Since a query starts from a table version and sees the
batches after it, no change is lost or doubled between its snapshot and its feed.
"""

from __future__ import annotations

import gc
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field
from functools import partial
from threading import Lock

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brooklet.functions import zset
from brooklet.operators import aggregate as agg_ops
from brooklet.operators import compile as comp
from brooklet.operators import route, subset
from brooklet.operators.aggregate import Aggregate
from brooklet.operators.predicate import And, In, Predicate, canonical, conjuncts, from_json, subqueries, subquery_template, tables, to_json, validate
from brooklet.operators.where_parser import parse
from brooklet.schema import TableSchema, ValidationError
from brooklet.sources.changelog import ENVELOPE, ChangeLog, typed
from brooklet.sources.fs import Store
from brooklet.sources.state import TableState
from brooklet.streaming import retention
from brooklet.streaming.catalog import Catalog, ShapeRecord
from brooklet.streaming.membership import BROADCAST_VALUES, Sets
from brooklet.streaming.metrics import Metrics

FEED = "shape_id string, key string, op string, value map<string,string>, old map<string,string>, version bigint"
AGG_KEY = "agg"
#: Keys of one batch up to which they are broadcast to find their old images. The driver builds what is
#: broadcast, for all the plans that run at a time.
BROADCAST_KEYS = 20_000
#: Files of aggregate state, and of feeds, beyond which they are folded.
MOST_PARTS, MOST_FEEDS = 60, 200
#: Independent writes of one batch that run at a time; Spark shares its executors among them, and the driver
#: holds the plans and broadcasts of all.
AT_ONCE = 4
#: Part of the driver's heap that plans may take before what they left is collected.
HEAP_SHARE = 0.125


def trim(spark: SparkSession) -> bool:
    """Give what the driver's JVM has freed beside its heap back to the system; False where it cannot. Threads and
    compiled plans come and go with every batch, and the allocator keeps what they freed in an arena for each few threads."""
    gateway = spark.sparkContext._gateway
    jvm = gateway.jvm
    try:
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        call = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServerConnection").getMethods() if m.getName() == "invoke")
        args = gateway.new_array(jvm.java.lang.Object, 4)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        call.invoke(server, args)
    except Py4JJavaError:  # another JVM, or another allocator
        return False
    return True


@dataclass
class _Shape:
    record: ShapeRecord
    predicate: Predicate | None
    agg: Aggregate | None = None
    last_used: float = field(default_factory=time.monotonic)
    dormant_since: float | None = None


def _template(s: _Shape) -> tuple | None:
    """What queries of one family have in common: one positive subquery among plain conjuncts, whose
    own filter holds no subquery; the columns that it pins to values don't count."""
    parts = list(conjuncts(s.predicate))
    leaves = [x for x in parts if isinstance(x, In)]
    if len(leaves) != 1 or leaves[0].negated or subqueries(leaves[0].where) or any(subqueries(x) for x in parts if x is not leaves[0]):
        return None
    leaf = leaves[0]
    cols, _, residual = subquery_template(leaf.where)
    plain = canonical(And(tuple(x for x in parts if x is not leaf)))
    return (s.record.table, tuple(s.record.columns), plain, leaf.col, leaf.table, leaf.project, cols, canonical(residual))


class LiveEngine:
    def __init__(self, spark: SparkSession, root: str, flush: str = "batch"):
        if flush not in ("batch", "commit"):
            raise ValidationError(f"flush is batch or commit, not {flush}")
        self.spark, self.store, self.flush = spark, Store(spark, root), flush
        self.log, self.catalog = ChangeLog(spark, self.store.path("log")), Catalog(self.store)
        self.schemas: dict[str, TableSchema] = {}
        self.states: dict[str, TableState] = {}
        self.counts: dict[str, list[str]] = {}
        self.shapes: dict[str, _Shape] = {}
        self.metrics = Metrics()
        self.faults: set[str] = set()
        self._agg_values: dict[tuple[str, int], tuple] = {}
        self._heap_was, self._collecting = 0, Lock()
        self.work = self.store.path("work")
        found = self.catalog.fold()
        self.folded, self.gone, self.feeds, self.feeds_gone = found.folded, found.gone, found.feeds, found.feeds_gone
        self.batch, self.version, self.highwater = found.batch, found.version, found.highwater
        for t, d in found.tables.items():
            schema = TableSchema.from_json(t, d["schema"]) if not d.get("struct") else self._from_struct(t, d)
            self.schemas[t] = schema
            self.states[t] = TableState(spark, self.store.path("state"), schema, d["bases"], {int(v): n for v, n in d["deltas"].items()})
            if d.get("counts"):
                self.counts[t] = d["counts"]
        for r in found.shapes.values():
            self.shapes[r.id] = _Shape(r, from_json(r.where), Aggregate(r.fn, r.col) if r.kind == "aggregate" else None, dormant_since=None if r.dormant_at is None else time.monotonic())
        self.sets, self._committed = Sets(self, found.nodes), self.version

    @staticmethod
    def _from_struct(name: str, d: dict) -> TableSchema:
        from pyspark.sql.types import StructType

        from brooklet.schema import ColumnDef, kind_of

        struct = StructType.fromJson(d["struct"])
        return TableSchema(name, {f.name: ColumnDef(kind_of(f.dataType), f.dataType.simpleString()) for f in struct.fields}, tuple(d["pk"]), struct)

    # ---- tables

    def define_table(self, schema: TableSchema, rows: DataFrame | None = None, counts: list[str] | None = None) -> None:
        """Declare a table, with the rows it has already and the group columns to keep counts by."""
        for c in counts or ():
            schema.kind(c)
        self.schemas[schema.name] = schema
        state = self.states[schema.name] = TableState(self.spark, self.store.path("state"), schema)
        if rows is not None:
            state.load(rows, self.version)
        if counts:
            self.counts[schema.name] = counts
            self._write(agg_ops.group_counts(state.at(self.version), counts), self._counts_path(schema.name, self.version))
        self.catalog.log("table", name=schema.name, schema=schema.to_json(), struct=schema.struct().jsonValue(), pk=list(schema.primary_key), bases=state.bases, deltas={}, counts=counts)

    def table(self, name: str, version: int | None = None) -> DataFrame:
        if name not in self.states:
            raise ValidationError(f"unknown table {name}")
        return self.states[name].at(self.version if version is None else version)

    def _tables(self, names: set[str], version: int) -> dict[str, DataFrame]:
        return {t: self.table(t, version) for t in names}

    def write(self, table: str, op: str, key: dict | None = None, row: dict | None = None, txid: int | None = None) -> int:
        """Append one change to the log (insert, update of some columns, upsert, delete, truncate)."""
        return self.log.append([self.log.change(self.schemas[table], op, key, row)], txid)

    # ---- registration

    def predicate(self, table: str, where: str | dict | Predicate | None) -> Predicate | None:
        p = parse(where) if isinstance(where, str) else from_json(where) if isinstance(where, dict) else where
        return validate(p, table, self.schemas)

    def create_shape(self, table: str, where=None, columns: list[str] | None = None, changes_only: bool = False) -> str:
        """Register a query and return its id; an equal query is shared."""
        p = self.predicate(table, where)
        cols = self.schemas[table].projected(columns)
        sig = f"rows|{changes_only}|{table}|{canonical(p)}|{','.join(cols)}"
        return self._join(sig) or self._create(ShapeRecord(uuid.uuid4().hex[:16], "rows", table, to_json(p), cols, changes_only, since=self.version, signature=sig), p)

    def create_aggregate(self, table: str, fn: str, col: str | None = None, where=None) -> str:
        p, agg = self.predicate(table, where), Aggregate(fn, col)
        agg.check(self.schemas[table], p)
        sig = agg_ops.signature(table, agg, p)
        return self._join(sig) or self._create(ShapeRecord(uuid.uuid4().hex[:16], "aggregate", table, to_json(p), fn=fn, col=col, since=self.version, signature=sig), p, agg)

    def _join(self, sig: str) -> str | None:
        for s in self.shapes.values():
            if s.record.signature == sig:
                s.record.refs += 1
                s.last_used = time.monotonic()
                self.metrics.count("shapes_shared")
                self.catalog.log("joined", id=s.record.id)
                if s.record.dormant_at is not None:
                    self.reactivate(s.record.id)
                return s.record.id
        return None

    def _create(self, r: ShapeRecord, p: Predicate | None, agg: Aggregate | None = None) -> str:
        s, began = _Shape(r, p, agg), time.monotonic()
        self.sets.ensure(p)
        if agg is not None:
            self._seed_aggregate(s)
        elif not r.changes_only:
            self._write(self._snapshot(s, self.version).withColumns({"op": F.lit("upsert"), "old": F.lit(None).cast("map<string,string>")}), self._feed_path(self.version, r.id))
        self.shapes[r.id] = s
        self.catalog.log("created", **asdict(r))
        self.metrics.count("shapes_created")
        self.metrics.create.add(time.monotonic() - began)
        return r.id

    def create_shapes(self, table: str, wheres: list, columns: list[str] | None = None) -> list[str]:
        """Register many queries at once and return their ids in order. Their snapshots are few plans:
        one for all without subqueries, one for each family that differs in a subquery's values."""
        began, cols, ids, new = time.monotonic(), self.schemas[table].projected(columns), [], {}
        known = {s.record.signature: i for i, s in self.shapes.items()}
        for where in wheres:
            p = self.predicate(table, where)
            sig = f"rows|False|{table}|{canonical(p)}|{','.join(cols)}"
            if sig in known and known[sig] not in new:
                ids.append(self._join(sig))
                continue
            if sig in known:
                new[known[sig]].record.refs += 1
            else:
                r = ShapeRecord(uuid.uuid4().hex[:16], "rows", table, to_json(p), cols, since=self.version, signature=sig)
                known[sig], new[r.id] = r.id, _Shape(r, p)
            ids.append(known[sig])
        plain = {i: s for i, s in new.items() if not subqueries(s.predicate)}
        families: dict[tuple, list[_Shape]] = {}
        for i, s in new.items():
            if i not in plain:
                families.setdefault(_template(s) or (i,), []).append(s)
        out = {"op": F.lit("upsert"), "old": F.lit(None).cast("map<string,string>"), "version": F.lit(self.version).cast("long")}
        parts = []
        if plain:
            schema = self.schemas[table]
            hit = route.route_all(self.table(table), schema, {i: s.predicate for i, s in plain.items()})
            parts.append(hit.select(F.col("_query").alias("shape_id"), schema.key().alias("key"), comp.row_text(schema, cols).alias("value")))
        for found in families.values():
            parts.append(self._family_rows(found, self.version) if len(found) > 1 else self._snapshot(found[0], self.version).drop("version"))
        for s in new.values():
            self.sets.ensure(s.predicate)
        for n, rows in enumerate(parts):
            self._write(rows.withColumns(out), self._feed_path(self.version, f"many-{uuid.uuid4().hex[:8]}-{n}"))
        self.shapes |= new
        self.catalog.log("created_many", shapes=[asdict(s.record) for s in new.values()])
        self.metrics.count("shapes_created", len(new))
        self.metrics.create.add(time.monotonic() - began)
        return ids

    def release(self, shape_id: str) -> None:
        s = self.shapes[shape_id]
        s.record.refs, s.last_used = max(0, s.record.refs - 1), time.monotonic()
        self.catalog.log("left", id=shape_id)

    def purge(self, shape_id: str) -> None:
        """Drop a query, whoever holds it, and the sets that only it used. Its rows in folders that it shares
        with others go when those are folded."""
        del self.shapes[shape_id]
        self.catalog.log("dropped", id=shape_id)
        for name in self.store.list("feed"):
            if name.endswith(shape_id):
                self.store.delete(f"feed/{name}")
        self.sets.drop_unused()

    def feed_bytes(self) -> dict[str, int]:
        """The size of each query's feed: the bytes of its keys and rows."""
        rows = self._feed_rows()
        text = F.octet_length("key") + F.coalesce(F.octet_length(F.to_json("value")), F.lit(0)) + F.coalesce(F.octet_length(F.to_json("old")), F.lit(0))
        return {} if rows is None else {r["shape_id"]: r["n"] for r in rows.groupBy("shape_id").agg(F.sum(text).alias("n")).collect() if r["shape_id"] in self.shapes}

    def sweep(self, limits: retention.Limits, now: float | None = None) -> retention.Plan:
        """Plan and carry out retention."""
        now = time.monotonic() if now is None else now
        size = self.feed_bytes() if limits.most_bytes else {}
        uses = [retention.ShapeUse(i, s.record.refs, now - s.last_used, None if s.dormant_since is None else now - s.dormant_since, can_sleep=s.agg is None, bytes=size.get(i, 0)) for i, s in self.shapes.items()]
        plan = retention.plan(uses, limits)
        for i in plan.deactivate:
            self.shapes[i].record.dormant_at, self.shapes[i].dormant_since = self.version, now
            self.catalog.log("dormant", id=i, version=self.version)
        for i in plan.evict:
            self.purge(i)
        return plan

    def reactivate(self, shape_id: str) -> None:
        """Wake a dormant query: what changed since it slept is the difference of two versions."""
        s = self.shapes[shape_id]
        if s.record.dormant_at is not None and s.record.dormant_at < self.version:
            a, b = self._snapshot(s, s.record.dormant_at).alias("a"), self._snapshot(s, self.version).alias("b")
            both = a.join(b, "key", "full_outer").filter("not (map_entries(a.value) <=> map_entries(b.value))")
            rows = both.select(F.lit(shape_id).alias("shape_id"), "key", F.when(F.col("b.value").isNull(), "delete").otherwise("upsert").alias("op"), F.col("b.value").alias("value"), F.col("a.value").alias("old"), F.lit(self.version).cast("long").alias("version"))
            self._write(rows, self._feed_path(self.version, f"wake-{shape_id}"))
        s.record.dormant_at, s.dormant_since, s.last_used = None, None, time.monotonic()
        self.catalog.log("reactivated", id=shape_id)

    # ---- reading

    def _snapshot(self, s: _Shape, version: int) -> DataFrame:
        """(shape_id, key, value, version) of a row query's result at a version."""
        r, schema = s.record, self.schemas[s.record.table]
        rows = comp.where(self.table(r.table, version), s.predicate, self._tables(tables(s.predicate), version))
        return rows.select(F.lit(r.id).alias("shape_id"), schema.key().alias("key"), comp.row_text(schema, r.columns).alias("value"), F.lit(version).cast("long").alias("version"))

    def query(self, table: str, where=None, columns: list[str] | None = None) -> DataFrame:
        """A query's rows now, from the tables."""
        p = self.predicate(table, where)
        return comp.shape(self.table(table), self.schemas[table], p, columns, self._tables(tables(p), self.version))

    def query_subset(self, table: str, where=None, columns=None, order_by=None, limit=None, offset=None, after=None) -> tuple[DataFrame, int]:
        """One ordered page, and the version that it is of."""
        p = self.predicate(table, where)
        page = subset.query_subset(self.table(table), self.schemas[table], p, columns, order_by, limit, offset, after, self._tables(tables(p), self.version))
        return page, self.version

    def feed(self, shape_id: str, after: int | None = None) -> DataFrame:
        """A query's feed rows, those of versions after ``after``; its snapshot has the version it began at."""
        s = self.shapes[shape_id]
        s.last_used = time.monotonic()
        rows = self._feed_rows()
        if rows is None:
            return self.spark.createDataFrame([], FEED)
        rows = rows.filter((F.col("shape_id") == shape_id) & (F.col("version") >= s.record.since))
        return rows if after is None else rows.filter(F.col("version") > after)

    def _feed_names(self) -> list[str]:
        return [n for n in self.store.list("feed") if n not in self.feeds_gone and (not n.endswith("-folded") or n in self.feeds)]

    def _feed_rows(self) -> DataFrame | None:
        names = self._feed_names()
        return self.spark.read.schema(FEED).parquet(*[self.store.path(f"feed/{n}") for n in names]) if names else None

    def _compact_feeds(self, version: int) -> None:
        """Fold many feed folders into one, sorted by query, so that reading a feed skips what is others';
        rows of queries that are gone stay behind."""
        names = self._feed_names()
        if len(names) <= MOST_FEEDS:
            return
        alive = self.spark.createDataFrame([(i, s.record.since) for i, s in self.shapes.items()], "shape_id string, since bigint")
        few = F.broadcast(alive) if len(self.shapes) <= route.BROADCAST_ROWS else alive
        rows = self._feed_rows().join(few, "shape_id").filter("version >= since").drop("since")
        self._write(rows.repartitionByRange("shape_id", "key").sortWithinPartitions("shape_id", "version"), self.store.path(f"feed/{version:09d}-folded"))
        self.catalog.log("feeds_folded", gone=names, new=f"{version:09d}-folded")
        self.feeds, self.feeds_gone = {f"{version:09d}-folded"}, self.feeds_gone | set(names)
        for n in names:
            self.store.delete(f"feed/{n}")

    def rows(self, shape_id: str, until: int | None = None) -> DataFrame:
        """A row query's current result, folded from its feed alone, in the table's types."""
        r = self.shapes[shape_id].record
        fed = self.feed(shape_id)
        if until is not None:
            fed = fed.filter(F.col("version") <= until)
        last = fed.groupBy("key").agg(F.max_by(F.struct("op", "value"), "version").alias("l")).filter("l.op = 'upsert'")
        struct = self.schemas[r.table].struct()
        return last.select(*[F.col("l.value")[c].try_cast(struct[c].dataType).alias(c) for c in r.columns])

    def value(self, shape_id: str) -> DataFrame:
        """(value, n) of an aggregate, from its state."""
        s = self.shapes[shape_id]
        s.last_used = time.monotonic()
        r, schema = s.record, self.schemas[s.record.table]
        state = self._latest_agg(s)
        n = F.coalesce(F.col("n"), F.lit(0)).alias("n")
        if r.fn == "count":
            return state.select((n if r.col is None else F.coalesce(F.col("nn"), F.lit(0))).alias("value"), n)
        if r.fn in ("sum", "avg"):
            return state.select(F.when(F.col("nn") > 0, F.col("total") / F.col("nn") if r.fn == "avg" else F.col("total")).alias("value"), n)
        bags = self._multiset(s)
        best = bags.agg((F.min if r.fn == "min" else F.max)("v").alias("value"))
        kind = schema.struct()[r.col].dataType
        return state.select(best.scalar().cast(kind).alias("value"), n)

    def group_counts(self, table: str) -> DataFrame:
        return self.spark.read.parquet(self._counts_path(table, max(v for v in self._counts_versions(table) if v <= self.version)))

    # ---- one batch

    @staticmethod
    def together(todo: list[Callable[[], None]]) -> None:
        """Run independent steps side by side; the first failure is raised once all have ended."""
        if len(todo) < 2:
            for f in todo:
                f()
            return
        with ThreadPoolExecutor(min(AT_ONCE, len(todo))) as pool:
            for done in [pool.submit(f) for f in todo]:
                done.result()

    def _write(self, df: DataFrame, path: str) -> None:
        df.write.mode("overwrite").parquet(path)
        self._let_go()

    def _let_go(self) -> None:
        """Collect the driver's garbage once a part of its heap was taken. Spark drops the broadcasts and shuffles of
        ended plans only when the driver's JVM has collected them, which it does when its heap is full; what was
        freed beside the heap stays with the JVM until it is trimmed."""
        heap = self.spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
        used = lambda: heap.totalMemory() - heap.freeMemory()
        taken = lambda: used() - self._heap_was >= HEAP_SHARE * heap.maxMemory()
        if not taken():
            return
        with self._collecting:  # a collection that began before this write ended has missed what it left
            if taken():
                gc.collect()  # what Python holds of plans, Spark holds
                self.spark.sparkContext._jvm.System.gc()
                trim(self.spark)
                self._heap_was = used()

    def _feed_path(self, version: int, what: str) -> str:
        return self.store.path(f"feed/{version:09d}-{what}")

    def _counts_path(self, table: str, version: int) -> str:
        return self.store.path(f"counts/{table}/{version:09d}")

    def _counts_versions(self, table: str) -> list[int]:
        return [int(x) for x in self.store.list(f"counts/{table}")]

    def run(self) -> None:
        """Drain: apply every commit that the log holds now, then return."""
        if not self.store.exists("log/commits"):
            return
        lines = self.spark.readStream.schema(ENVELOPE).json(self.log.glob)
        q = lines.writeStream.foreachBatch(self._batch).option("checkpointLocation", self.store.path("checkpoint")).trigger(availableNow=True).start()
        q.awaitTermination()

    def _batch(self, envelopes: DataFrame, batch_id: int) -> None:
        if batch_id <= self.batch:
            return
        began, h = time.monotonic(), F.col("headers")
        self._rewind()
        new = zset.dedup(envelopes, self.highwater, h["lsn"], h["seq"]).filter(F.col("type").isin(list(self.schemas)))
        self.work = self.store.path(f"work/{batch_id:09d}")
        self._write(new, f"{self.work}/envelopes")
        new = self.spark.read.schema(ENVELOPE).parquet(f"{self.work}/envelopes")
        parts = [new]
        if self.flush == "commit":  # unstamped envelopes last, as the order of images has them
            stamps = sorted((r[0] for r in new.select(h["lsn"]).distinct().collect()), key=lambda x: (x is None, x))
            parts = [new.filter(h["lsn"].eqNullSafe(F.lit(x).cast("long"))) for x in stamps]
        marks, touched = [], set()
        for part in parts:
            got = self._apply(part, self.version + 1)
            marks += got[0]
            touched |= got[1]
        self.highwater = max([*marks, *([self.highwater] if self.highwater else [])], default=None)
        self.batch = batch_id
        self.catalog.log("batch", batch=batch_id, version=self.version, highwater=self.highwater, tables={t: {"bases": self.states[t].bases, "deltas": self.states[t].deltas} for t in touched}, nodes=self.sets.marks())
        self._committed = self.version
        self._compact_feeds(self.version)
        self.store.delete(f"work/{batch_id:09d}")
        self.metrics.count("batches")
        self.metrics.batch.add(time.monotonic() - began)

    def _rewind(self) -> None:
        """Back to the committed version, if a batch failed on the way."""
        self.version = self._committed
        for st in self.states.values():
            st.bases, st.deltas = [v for v in st.bases if v <= self.version], {v: n for v, n in st.deltas.items() if v <= self.version}
        self.sets.rewind(self.version)
        self._agg_values = {k: v for k, v in self._agg_values.items() if k[1] <= self.version}

    def _apply(self, new: DataFrame, version: int) -> tuple[list[tuple], set[str]]:
        """Advance everything by some commits; their last positions and the tables that they changed."""
        h = F.col("headers")
        per_table = new.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct(h["lsn"], h["seq"])).alias("hw"), F.max(h["operation"] == "truncate").alias("cut")).collect()
        images, counts = {}, {}
        for r in per_table:
            schema = self.schemas[r["type"]]
            got = self._images(new.filter(F.col("type") == r["type"]), schema, r["n"], r["cut"])
            self._write(got, path := f"{self.work}/{version:09d}-images-{schema.name}")
            images[schema.name] = got = self.spark.read.schema(got.schema).parquet(path)
            counts[schema.name] = got.count()
            self.states[schema.name].apply(got, version, counts[schema.name])
            self.metrics.count("changed_keys", counts[schema.name])
        self._advance(images, counts, version)
        for t in images:
            self.states[t].compact(version)
        self._compact_aggregates(version)
        self.sets.compact(version)
        self._agg_values = {k: v for k, v in self._agg_values.items() if k[1] == version} | {(i, version): v for (i, w), v in self._agg_values.items() if w == self.version and (i, version) not in self._agg_values}
        self.version = version
        self.metrics.count("envelopes", sum(r["n"] for r in per_table))
        return [(r["hw"][0], r["hw"][1] or 0) for r in per_table if r["hw"] and r["hw"][0] is not None], set(images)

    def _images(self, new: DataFrame, schema: TableSchema, count: int, cut: bool) -> DataFrame:
        """(key, old, new) of every key that the batch changes."""
        h, names = F.col("headers"), schema.struct().names
        order = F.struct(F.coalesce(h["lsn"], F.lit(2**62)).alias("l"), F.coalesce(h["seq"], F.lit(0)).alias("s"))
        op = h["operation"]
        full, gone = op.isin("insert", "upsert"), op == "delete"
        cells = [F.max_by(F.struct(F.col("value")[c].alias("x")), F.when(F.map_contains_key("value", F.lit(c)), order)).alias(f"c{i}") for i, c in enumerate(names)]
        per_key = new.filter(op != "truncate").groupBy("key").agg(
            F.max_by(op, order).alias("op"), F.max(F.when(full, order)).alias("full"), F.max(F.when(gone, order)).alias("gone"), F.max(order).alias("last"), *cells)
        state = self.table(schema.name).select(schema.key().alias("key"), F.struct(*names).alias("old"))
        if cut:
            at = new.filter(op == "truncate").agg(F.max(order)).scalar()
            per_key = per_key.withColumn("cut", at)
            joined = state.join(per_key, "key", "full_outer").withColumn("kept", F.lit(None).cast(state.schema["old"].dataType))
            gone_at = F.greatest("gone", F.coalesce("cut", at))
        else:
            keys = F.broadcast(per_key.select("key")) if count <= BROADCAST_KEYS else per_key.select("key")
            joined = per_key.join(state.join(keys, "key", "left_semi"), "key", "left").withColumn("kept", F.col("old"))
            gone_at = F.col("gone")
        alive = (F.col("last") > F.coalesce(gone_at, F.struct(F.lit(-1).cast("long").alias("l"), F.lit(-1).cast("long").alias("s")))) & F.when(gone_at.isNull(), F.col("full").isNotNull() | F.col("kept").isNotNull()).otherwise(F.coalesce(F.col("full") > gone_at, F.lit(False)))
        cell = [F.when(F.col(f"c{i}").isNull(), F.col("kept")[c]).otherwise(F.col(f"c{i}.x").try_cast(schema.struct()[c].dataType)).alias(c) for i, c in enumerate(names)]
        image = F.when(F.coalesce(alive, F.lit(False)), F.struct(*cell))
        if "drop_deletes" in self.faults:  # for the tests' negative control
            image = F.coalesce(image, F.col("old"))
        return joined.select("key", "old", image.alias("new")).filter("not (old <=> new)")

    def _advance(self, images: dict[str, DataFrame], counts: dict[str, int], version: int) -> None:
        images = {t: im for t, im in images.items() if counts[t]}
        live, todo = [s for s in self.shapes.values() if s.record.dormant_at is None], []
        for t, im in images.items():
            plain = {s.record.id: s for s in live if s.record.table == t and s.agg is None and not subqueries(s.predicate)}
            if plain:
                todo.append(partial(lambda im, t, plain: self._write(self._filtered(im, t, plain, version), self._feed_path(version, f"rows-{t}")), im, t, plain))
            aggs = {s.record.id: s for s in live if s.record.table == t and s.agg is not None}
            if aggs:
                todo.append(partial(self._advance_aggregates, im, t, aggs, version))
            if t in self.counts:
                todo.append(partial(self._advance_counts, im, t, version))
        families: dict[tuple, list[_Shape]] = {}
        for s in live:
            if s.agg is None and subqueries(s.predicate):
                families.setdefault(_template(s) or (s.record.id,), []).append(s)
        met: set[str] = set()
        todo.append(lambda: met.update(self._met([found[0] for found in families.values()], images)))
        flips: dict[str, DataFrame] = {}
        todo.append(lambda: flips.update(self.sets.advance(images, counts, version)))
        self.together(todo)

        def advance(found: list[_Shape]) -> None:
            s = found[0]
            rows = self._family(found, images if s.record.id in met else {}, counts, flips, version) if _template(s) else self._membership(s, images, counts, flips, version)
            if rows is not None:
                self._write(rows, self._feed_path(version, f"{'family' if _template(s) else 'member'}-{s.record.id}"))

        todo = []
        for found in families.values():
            if found[0].record.id in met or any(self.sets.split(x)[0] in flips for x in subqueries(found[0].predicate)):
                todo.append(partial(advance, found))
                self.metrics.count("queries_advanced", len(found))
            else:
                self.metrics.count("queries_passed_over", len(found))
        self.together(todo)

    def _advance_counts(self, im: DataFrame, t: str, version: int) -> None:
        gone = im.filter("old is not null").select("old.*").withColumn(zset.WEIGHT, F.lit(-1))
        come = im.filter("new is not null").select("new.*").withColumn(zset.WEIGHT, F.lit(1))
        was = self.group_counts(t).withColumnRenamed("cnt", zset.WEIGHT)
        cols = self.counts[t]
        moved = gone.unionByName(come).select(*cols, zset.WEIGHT).unionByName(was)
        self._write(agg_ops.group_counts(moved, cols, zset.WEIGHT), self._counts_path(t, version))

    def _met(self, shapes: list[_Shape], images: dict[str, DataFrame]) -> set[str]:
        """The queries of which an old or new image meets all conjuncts that hold no subquery."""
        out: set[str] = set()
        for t, im in images.items():
            plain = {s.record.id: And(tuple(x for x in conjuncts(s.predicate) if not subqueries(x))) for s in shapes if s.record.table == t}
            if plain:
                rows = im.filter("old is not null").select("old.*").unionByName(im.filter("new is not null").select("new.*"))
                out |= {r[0] for r in route.route_all(rows, self.schemas[t], plain).select("_query").distinct().collect()}
        return out

    def _values(self, found: dict[str, _Shape], schema: TableSchema, prefix: str) -> Column:
        """The wire form of a row for the query in _query: its own projection."""
        by_cols: dict[tuple, list[str]] = {}
        for i, s in found.items():
            by_cols.setdefault(tuple(s.record.columns), []).append(i)
        if len(by_cols) == 1:
            return comp.row_text(schema, list(next(iter(by_cols))), prefix)
        out = None
        for cols, ids in by_cols.items():
            v = comp.row_text(schema, list(cols), prefix)
            out = F.when(F.col("_query").isin(ids), v) if out is None else out.when(F.col("_query").isin(ids), v)
        return out

    def _filtered(self, im: DataFrame, t: str, found: dict[str, _Shape], version: int) -> DataFrame:
        """Feed rows of queries without subqueries."""
        schema, queries = self.schemas[t], {i: s.predicate for i, s in found.items()}
        sides = []
        for side, w in (("old", -1), ("new", 1)):
            rows = im.filter(F.col(side).isNotNull()).select("key", f"{side}.*")
            hit = route.route_all(rows, schema, queries)
            sides.append(hit.select(F.col("_query").alias("shape_id"), "key", self._values(found, schema, "").alias("row"), F.lit(w).cast("long").alias(zset.WEIGHT)))
        both = sides[0].unionByName(sides[1])
        old = F.max_by(F.when(F.col(zset.WEIGHT) < 0, F.col("row")), F.when(F.col(zset.WEIGHT) < 0, F.lit(1)).otherwise(F.lit(0)))
        new = F.max_by(F.when(F.col(zset.WEIGHT) > 0, F.col("row")), F.when(F.col(zset.WEIGHT) > 0, F.lit(1)).otherwise(F.lit(0)))
        out = both.groupBy("shape_id", "key").agg((F.max(zset.WEIGHT) > 0).alias("in"), new.alias("value"), old.alias("old"))
        out = out.filter("not (in and map_entries(value) <=> map_entries(old))")  # what a query doesn't show hasn't changed
        return out.select("shape_id", "key", F.when(F.col("in"), "upsert").otherwise("delete").alias("op"), F.when(F.col("in"), F.col("value")).alias("value"), "old", F.lit(version).cast("long").alias("version"))

    # ---- subqueries

    def _difference(self, a: DataFrame, b: DataFrame, version: int) -> DataFrame:
        """Feed rows from (shape_id, key, value) before and after."""
        a, b = a.alias("a"), b.alias("b")
        both = a.join(b, ["shape_id", "key"], "full_outer").filter("not (map_entries(a.value) <=> map_entries(b.value))")
        return both.select("shape_id", "key", F.when(F.col("b.value").isNull(), "delete").otherwise("upsert").alias("op"), F.col("b.value").alias("value"), F.col("a.value").alias("old"), F.lit(version).cast("long").alias("version"))

    def _membership(self, s: _Shape, images: dict[str, DataFrame], counts: dict[str, int], flips: dict[str, DataFrame], version: int) -> DataFrame | None:
        """Feed rows of a query with subqueries: its verdicts before and after, on what can have changed."""
        r, schema = s.record, self.schemas[s.record.table]
        olds, news, few = self.sets.near(r.table, s.predicate, images, counts, flips, version, r.id)
        if olds is None:
            return None
        sides = [self.sets.decided(r.table, rows, s.predicate, v, few).select(F.lit(r.id).alias("shape_id"), schema.key().alias("key"), comp.row_text(schema, r.columns).alias("value")) for rows, v in ((olds, self.version), (news, version))]
        return self._difference(*sides, version)

    def _binds(self, found: list[_Shape]) -> tuple[In, DataFrame | list[str]]:
        """The subquery of a family, and (shape_id, b0…) of its queries, or their ids if they bind nothing."""
        leaves = [next(y for y in conjuncts(x.predicate) if isinstance(y, In)) for x in found]
        cols, struct = subquery_template(leaves[0].where)[0], self.schemas[leaves[0].table].struct()
        if not cols:
            return leaves[0], [x.record.id for x in found]
        ddl = ", ".join(["shape_id string", *(f"b{i} {struct[c].dataType.simpleString()}" for i, c in enumerate(cols))])
        params = self.spark.createDataFrame([(x.record.id, *subquery_template(leaf.where)[1]) for x, leaf in zip(found, leaves, strict=True)], ddl)
        return leaves[0], F.broadcast(params) if len(found) <= route.BROADCAST_ROWS else params

    def _bound(self, values: DataFrame, params: DataFrame | list[str]) -> DataFrame:
        """(shape_id, …) of a node's rows (b0…, value, …), once for each query of a family that binds them."""
        if isinstance(params, list):
            return values.withColumn("shape_id", F.explode(F.array(*map(F.lit, params))))
        on = [c for c in params.columns if c != "shape_id"]
        return values.join(params, on).drop(*on)

    def _family(self, found: list[_Shape], images: dict[str, DataFrame], counts: dict[str, int], flips: dict[str, DataFrame], version: int) -> DataFrame | None:
        """Feed rows of queries that differ only in the values that their subquery's columns must
        equal: those values are rows of a table, and one plan serves all of the queries."""
        r, schema = found[0].record, self.schemas[found[0].record.table]
        leaf, params = self._binds(found)
        node, plain = self.sets.node(leaf), And(tuple(x for x in conjuncts(found[0].predicate) if not isinstance(x, In)))
        text, out = comp.row_text(schema, r.columns), None
        own = images.get(r.table)
        if own is not None:
            few, sides = counts[r.table] <= BROADCAST_VALUES, []
            for side, v in (("old", self.version), ("new", version)):
                rows = comp.where(own.filter(f"{side} is not null").select("key", f"{side}.*"), plain)
                values = rows.select(F.col(leaf.col).alias("value")).filter("value is not null").distinct()
                held = self._bound(self.sets.state(node, v, values, few).drop("w"), params).distinct().withColumnRenamed("value", "_v")
                sides.append(rows.join(held, rows[leaf.col] == held["_v"]).select("shape_id", "key", text.alias("value")))
            out = self._difference(*sides, version)
        if node.id in flips:
            moved = self._bound(flips[node.id].filter("value is not null"), params).withColumnRenamed("value", "_v")
            rows = comp.where(self.table(r.table, version), plain).withColumn("_k", schema.key())
            if r.table in counts and counts[r.table]:  # the images' rows are decided above, or meet no query
                mine = self.spark.read.schema("key string").parquet(f"{self.work}/{version:09d}-images-{r.table}").select(F.col("key").alias("_k"))
                rows = rows.join(F.broadcast(mine) if counts[r.table] <= BROADCAST_VALUES else mine, "_k", "left_anti")
            hit = rows.join(moved, rows[leaf.col] == moved["_v"])
            more = hit.select("shape_id", F.col("_k").alias("key"), F.when(F.col("now"), "upsert").otherwise("delete").alias("op"), F.when(F.col("now"), text).alias("value"), F.when(~F.col("now"), text).alias("old"), F.lit(version).cast("long").alias("version"))
            out = more if out is None else out.unionByName(more)
        return out

    def _family_rows(self, found: list[_Shape], version: int) -> DataFrame:
        """(shape_id, key, value) of a family's results at a version."""
        r, schema = found[0].record, self.schemas[found[0].record.table]
        leaf, params = self._binds(found)
        self.sets.ensure(found[0].predicate)
        plain = And(tuple(x for x in conjuncts(found[0].predicate) if not isinstance(x, In)))
        outer = comp.where(self.table(r.table, version), plain).withColumn("_k", schema.key())
        held = self._bound(self.sets.state(self.sets.node(leaf), version).filter("value is not null").drop("w"), params).distinct().withColumnRenamed("value", "_v")
        return outer.join(held, outer[leaf.col] == held["_v"]).select("shape_id", F.col("_k").alias("key"), comp.row_text(schema, r.columns).alias("value"))

    # ---- aggregates

    def _agg_path(self, version: int, what: str) -> str:
        return self.store.path(f"agg/{version:09d}-{what}")

    _AGG = "shape_id string, n bigint, nn bigint, total double, version bigint"
    _BAG = "shape_id string, v string, w bigint, version bigint"

    def _contributions(self, rows: DataFrame, found: dict[str, _Shape]) -> DataFrame:
        """(shape_id, v, w): the cell of each row that each aggregate matches, with its weight."""
        cell = F.lit(None).cast("string")
        hit = route.route_all(rows, self.schemas[next(iter(found.values())).record.table], {i: s.predicate for i, s in found.items()})
        by_col: dict[str, list[str]] = {}
        for i, s in found.items():
            if s.record.col:
                by_col.setdefault(s.record.col, []).append(i)
        for c, ids in by_col.items():
            cell = F.when(F.col("_query").isin(ids), F.col(c).cast("string")).otherwise(cell)
        return hit.select(F.col("_query").alias("shape_id"), cell.alias("v"), zset.WEIGHT)

    def _sums(self, parts: DataFrame, found: dict[str, _Shape], version: int) -> DataFrame:
        numeric = [i for i, s in found.items() if s.record.fn in ("sum", "avg")]
        x = F.when(F.col("shape_id").isin(numeric), F.col("v").try_cast("double"))
        return parts.groupBy("shape_id").agg(F.sum(zset.WEIGHT).alias("n"), F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col(zset.WEIGHT))), F.lit(0)).alias("nn"), F.sum(x * F.col(zset.WEIGHT)).alias("total")).withColumn("version", F.lit(version).cast("long"))

    def _bags(self, parts: DataFrame, found: dict[str, _Shape], version: int) -> DataFrame | None:
        ids = [i for i, s in found.items() if s.record.fn in ("min", "max")]
        if not ids:
            return None
        return parts.filter(F.col("shape_id").isin(ids) & F.col("v").isNotNull()).groupBy("shape_id", "v").agg(F.sum(zset.WEIGHT).alias("w")).filter("w != 0").withColumn("version", F.lit(version).cast("long"))

    def _record_aggregates(self, rows: DataFrame, found: dict[str, _Shape], version: int, what: str) -> None:
        parts = self._contributions(rows, found)
        self._write(self._sums(parts, found, version), self._agg_path(version, f"sums-{what}"))
        bags = self._bags(parts, found, version)
        if bags is not None:
            self._write(bags, self._agg_path(version, f"bags-{what}"))

    def _seed_aggregate(self, s: _Shape) -> None:
        rows = self.table(s.record.table).withColumn(zset.WEIGHT, F.lit(1).cast("long"))
        found = {s.record.id: s}
        plan = agg_ops.plan_from_counts(s.predicate, self.counts.get(s.record.table, []))
        if s.record.fn == "count" and s.record.col is None and plan is not None and s.record.table in self.counts:
            n = agg_ops.count_from_groups(self.group_counts(s.record.table), plan)
            seeded = n.select(F.lit(s.record.id).alias("shape_id"), "n", F.lit(0).cast("long").alias("nn"), F.lit(None).cast("double").alias("total"), F.lit(self.version).cast("long").alias("version"))
            self._write(seeded, self._agg_path(self.version, f"sums-{s.record.id}"))
        else:
            self._record_aggregates(rows, found, self.version, s.record.id)
        self.shapes[s.record.id] = s
        self._feed_aggregates(found, self.version, s.record.id, None)

    def _advance_aggregates(self, im: DataFrame, t: str, found: dict[str, _Shape], version: int) -> None:
        gone = im.filter("old is not null").select("old.*").withColumn(zset.WEIGHT, F.lit(-1).cast("long"))
        come = im.filter("new is not null").select("new.*").withColumn(zset.WEIGHT, F.lit(1).cast("long"))
        unknown = {i: s for i, s in found.items() if (i, self.version) not in self._agg_values}
        before = {i: self._agg_values.get((i, self.version)) for i in found} | (self._values_of(unknown, self.version) if unknown else {})
        self._record_aggregates(gone.unionByName(come), found, version, f"t-{t}")
        self._feed_aggregates(found, version, f"agg-{t}", before)

    def _feed_aggregates(self, found: dict[str, _Shape], version: int, what: str, before: dict | None) -> None:
        """One row {value, n} per aggregate: first always, later when its value changes."""
        rows = []
        for i, (value, n) in self._values_of(found, version).items():
            self._agg_values[i, version] = (value, n)
            if before is None or before[i][0] != value:
                rows.append((i, AGG_KEY, "upsert", {"value": None if value is None else str(value), "n": str(n)}, None, version))
        if rows:
            self._write(self.spark.createDataFrame(rows, FEED), self._feed_path(version, f"{what}-values"))

    def _agg_names(self) -> list[str]:
        return [n for n in self.store.list("agg") if n not in self.gone and (not n.endswith("-folded") or n in self.folded)]

    def _agg_parts(self, kind: str, schema: str, version: int | None = None) -> DataFrame:
        version = self.version if version is None else version
        names = [n for n in self._agg_names() if f"-{kind}-" in n and int(n.split("-")[0]) <= version]
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[self.store.path(f"agg/{n}") for n in names])

    def _values_of(self, found: dict[str, _Shape], version: int) -> dict[str, tuple]:
        """(value, n) of many aggregates at once; one row each reaches the driver."""
        ids = self.spark.createDataFrame([(i, s.record.since) for i, s in found.items()], "shape_id string, since bigint")
        mine = lambda kind, schema: self._agg_parts(kind, schema, version).join(F.broadcast(ids) if len(found) <= route.BROADCAST_ROWS else ids, "shape_id").filter("version >= since")
        sums = {r["shape_id"]: r for r in mine("sums", self._AGG).groupBy("shape_id").agg(F.sum("n").alias("n"), F.sum("nn").alias("nn"), F.sum("total").alias("total")).collect()}
        best: dict[str, tuple] = {}
        by_type: dict[str, list[str]] = {}
        for i, s in found.items():
            if s.record.fn in ("min", "max"):
                by_type.setdefault(self.schemas[s.record.table].struct()[s.record.col].dataType.simpleString(), []).append(i)
        if by_type:
            held = mine("bags", self._BAG).groupBy("shape_id", "v").agg(F.sum("w").alias("w")).filter("w > 0")
            for kind, names in by_type.items():
                v = F.col("v").cast(kind)
                best |= {r["shape_id"]: (r["low"], r["high"]) for r in held.filter(F.col("shape_id").isin(names)).groupBy("shape_id").agg(F.min(v).alias("low"), F.max(v).alias("high")).collect()}
        out = {}
        for i, s in found.items():
            r, fn = sums.get(i), s.record.fn
            n, nn, total = (r["n"] or 0, r["nn"] or 0, r["total"]) if r else (0, 0, None)
            if fn == "count":
                value = n if s.record.col is None else nn
            elif fn in ("sum", "avg"):
                value = None if not nn else total / nn if fn == "avg" else total
            else:
                value = best.get(i, (None, None))[fn == "max"]
            out[i] = (value, n)
        return out

    def _compact_aggregates(self, version: int) -> None:
        """Fold the aggregates' parts of many batches into one; readers see either, never both."""
        names = [n for n in self._agg_names() if int(n.split("-")[0]) <= version]
        if len(names) <= MOST_PARTS:
            return
        since = {i: s.record.since for i, s in self.shapes.items() if s.agg is not None}
        live = F.lit(False)
        for i, v in since.items():
            live = live | ((F.col("shape_id") == i) & (F.col("version") >= v))
        sums = self._agg_parts("sums", self._AGG, version).filter(live).groupBy("shape_id").agg(F.sum("n").alias("n"), F.sum("nn").alias("nn"), F.sum("total").alias("total"), F.max("version").alias("version"))
        bags = self._agg_parts("bags", self._BAG, version).filter(live).groupBy("shape_id", "v").agg(F.sum("w").alias("w"), F.max("version").alias("version")).filter("w != 0")
        new = [f"{version:09d}-sums-folded", f"{version:09d}-bags-folded"]
        self._write(sums, self.store.path(f"agg/{new[0]}"))
        self._write(bags, self.store.path(f"agg/{new[1]}"))
        # this event is the switch: until it is in the catalog the new files don't count, then the old ones don't
        self.catalog.log("folded", gone=names, new=new)
        self.folded, self.gone = set(new), self.gone | set(names)
        for n in names:
            self.store.delete(f"agg/{n}")

    def _latest_agg(self, s: _Shape) -> DataFrame:
        parts = self._agg_parts("sums", self._AGG).filter((F.col("shape_id") == s.record.id) & (F.col("version") >= s.record.since))
        return parts.agg(F.sum("n").alias("n"), F.sum("nn").alias("nn"), F.sum("total").alias("total"))

    def _multiset(self, s: _Shape) -> DataFrame:
        """The values of a MIN or MAX that still have a row behind them."""
        kind = self.schemas[s.record.table].struct()[s.record.col].dataType
        parts = self._agg_parts("bags", self._BAG).filter((F.col("shape_id") == s.record.id) & (F.col("version") >= s.record.since))
        return parts.groupBy("v").agg(F.sum("w").alias("w")).filter("w > 0").select(F.col("v").cast(kind).alias("v"))

    # ---- introspection

    def describe(self, shape_id: str) -> dict:
        """The operators that a query's changes pass, from source to feed."""
        s = self.shapes[shape_id]
        nodes = [{"op": "source", "table": t} for t in sorted({s.record.table} | tables(s.predicate))] + [{"op": "delta"}]
        if s.agg is not None:
            nodes += [{"op": "filter", "where": canonical(s.predicate)}, {"op": "fold", "fn": s.record.fn, "col": s.record.col}]
        elif subqueries(s.predicate):
            nodes += [{"op": "distinct", "of": f"{x.table}.{x.project}"} for x in subqueries(s.predicate)] + [{"op": "join", "where": canonical(s.predicate)}]
        else:
            nodes += [{"op": "key" if route.families({"q": s.predicate})[0] else "filter", "where": canonical(s.predicate)}]
        return {"id": shape_id, "nodes": [*nodes, {"op": "project", "columns": s.record.columns}, {"op": "sink"}]}

    def health(self) -> dict:
        return {"status": "active" if self.version else "starting" if self.schemas else "waiting", "tables": {t: {"version": self.version, "deltas": len(st.deltas)} for t, st in self.states.items()}, "shapes": len(self.shapes), "families": {t: len(route.families({i: s.predicate for i, s in self.shapes.items() if s.record.table == t and s.agg is None and not subqueries(s.predicate)})[0]) for t in self.schemas}, "metrics": self.metrics.summary()}

    def trace(self, shape_id: str) -> DataFrame:
        """(version, op, rows): what each batch sent to a query's feed."""
        return self.feed(shape_id).groupBy("version", "op").agg(F.count(F.lit(1)).alias("rows"))

    def subqueries(self) -> dict[str, int]:
        """Every distinct subquery that queries hold, at any depth, and by how many it is held."""
        out: dict[str, int] = {}

        def add(p: Predicate | None) -> None:
            for x in subqueries(p):
                name = f"{x.table}|{x.project}|{canonical(x.where)}"
                out[name] = out.get(name, 0) + 1
                add(x.where)

        for s in self.shapes.values():
            add(s.predicate)
        return out
