"""The shape protocol: a query's rows as messages, first a snapshot, then what changed.

A handle belongs to one snapshot of a (shared) query. Offsets are table versions. Unknown
handles must start anew; handles idle for HANDLE_TTL seconds let go of their query. A response's
messages stay in the cluster: they are read from the feed, as of the response's version, when they are
iterated, and pass the driver one partition at a time.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import islice

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from brooklet.operators.params import collect, substitute
from brooklet.schema import ValidationError
from brooklet.streaming.engine import LiveEngine

HANDLE_TTL = 600
#: Rows and log entries that the views show, by default and at most.
ROWS_DEFAULT, ROWS_MOST, LOG_DEFAULT, LOG_MOST = 200, 2000, 50, 500
UP_TO_DATE = {"headers": {"control": "up-to-date"}}


class MustRefetch(Exception):
    """409: the handle is not known here; start again from the snapshot."""


class Transient(Exception):
    """500: the same request may succeed later."""


@dataclass
class _Handle:
    shape_id: str
    table: str
    last_used: float


class Messages(Sequence):
    """A response's messages, the up-to-date one last. ``frame`` has (operation, key, value) of the others
    in any order, ``ordered`` sorts them; both are built anew for each reading, as the feed's files may
    have been folded meanwhile."""

    def __init__(self, frame: Callable[[], DataFrame], ordered: Callable[[], DataFrame]):
        self.frame, self._ordered, self._count = frame, ordered, None

    def __iter__(self) -> Iterator[dict]:
        for r in self._ordered().toLocalIterator():
            yield {"headers": {"operation": r["operation"]}, "key": r["key"], "value": dict(r["value"])}
        yield UP_TO_DATE

    def __len__(self) -> int:
        if self._count is None:
            self._count = self.frame().count() + 1
        return self._count

    def __getitem__(self, i):
        if isinstance(i, slice) or i < 0:
            return list(self)[i] if isinstance(i, slice) else self[len(self) + i]
        for m in islice(self, i, None):
            return m
        raise IndexError(i)


class ShapeProtocol:
    def __init__(self, engine: LiveEngine, handle_ttl: float = HANDLE_TTL):
        self.engine, self.ttl = engine, handle_ttl
        self.handles: dict[str, _Handle] = {}

    def _expire(self, now: float) -> None:
        for h in [h for h, x in self.handles.items() if now - x.last_used >= self.ttl]:
            shape = self.handles.pop(h).shape_id
            if shape in self.engine.shapes:
                self.engine.release(shape)

    def get(self, query: dict, now: float | None = None) -> dict:
        """One request: {table, where?, params…?, columns?, offset, handle?} to {status, headers, messages}."""
        now = time.monotonic() if now is None else now
        self._expire(now)
        offset, handle = str(query.get("offset", "")), query.get("handle")
        table = str(query.get("table", "")).rpartition(".")[2]
        if not table:
            raise ValidationError("table is required")
        if offset == "-1":
            return self._snapshot(table, query, now)
        if not offset.isdigit():
            raise ValidationError("offset is -1 or one that was returned")
        if handle is None:
            raise ValidationError("an offset needs its handle")
        if handle not in self.handles:
            raise MustRefetch(handle)
        h = self.handles[handle]
        if h.table != table:
            raise ValidationError(f"the handle is of another table than {table}")
        h.last_used = now
        return self._live(handle, h, int(offset))

    def _headers(self, handle: str, table: str) -> dict:
        return {"handle": handle, "offset": str(self.engine.version), "schema": self.engine.schemas[table].wire()}

    def _snapshot(self, table: str, query: dict, now: float) -> dict:
        where = query.get("where")
        if where:
            where = substitute(where, collect(query))
        columns = query["columns"].split(",") if isinstance(query.get("columns"), str) else query.get("columns")
        shape = self.engine.create_shape(table, where, columns)
        handle = f"{shape}-{uuid.uuid4().hex[:8]}"
        self.handles[handle] = _Handle(shape, table, now)
        head = self._headers(handle, table)
        build = lambda: self._inserts(shape, int(head["offset"]))
        return {"status": 200, "headers": head, "messages": Messages(lambda: build().drop("_order"), lambda: build().orderBy("_order").drop("_order"))}

    def _feed(self, shape: str, until: int) -> DataFrame:
        if shape not in self.engine.shapes:
            raise MustRefetch(shape)
        return self.engine.feed(shape).filter(F.col("version") <= until)

    def _inserts(self, shape: str, until: int) -> DataFrame:
        """(operation, key, value) of a query's rows as of a version, and what orders them."""
        last = self._feed(shape, until).groupBy("key").agg(F.max_by(F.struct("op", "value"), "version").alias("l"), F.min("version").alias("first")).filter("l.op = 'upsert'")
        return last.select(F.lit("insert").alias("operation"), "key", F.col("l.value").alias("value"), F.struct(F.col("first"), *_by_key()).alias("_order"))

    def _changes(self, shape: str, pk: str, after: int, until: int) -> DataFrame:
        """(operation, key, value) of what changed between two versions, and what orders it. A row is known
        if its feed's entry before was an upsert; deletes of unknown rows are no messages."""
        w = W.partitionBy("key").orderBy("version")
        fed = self._feed(shape, until).select("*", F.lag("op").over(w).alias("_was"), F.lag("value").over(w).alias("_had"))
        known = F.coalesce(F.col("_was") == "upsert", F.lit(False))
        gone = F.when(F.size("old") > 0, F.col("old")).when(F.size("_had") > 0, F.col("_had")).otherwise(F.create_map(F.lit(pk), F.col("key")))
        out = fed.filter(F.col("version") > after).filter((F.col("op") == "upsert") | known)
        operation = F.when(F.col("op") == "delete", "delete").when(known, "update").otherwise("insert")
        return out.select(operation.alias("operation"), "key", F.when(F.col("op") == "upsert", F.col("value")).otherwise(gone).alias("value"), F.struct(F.col("version"), (F.col("op") == "delete").alias("d"), *_by_key()).alias("_order"))

    def _live(self, handle: str, h: _Handle, offset: int) -> dict:
        head = self._headers(handle, h.table)
        if h.shape_id not in self.engine.shapes:
            raise MustRefetch(handle)
        if offset >= self.engine.version:
            return {"status": 204, "headers": head, "messages": []}
        pk, until = self.engine.schemas[h.table].primary_key[0], self.engine.version
        build = lambda: self._changes(h.shape_id, pk, offset, until)
        if build().isEmpty():
            return {"status": 204, "headers": head, "messages": []}
        return {"status": 200, "headers": head, "messages": Messages(lambda: build().drop("_order"), lambda: build().orderBy("_order").drop("_order"))}

    # ---- views

    def rows(self, shape: str, limit: int = ROWS_DEFAULT) -> list[dict]:
        """Rows by key, numerically where keys are numbers; only those shown reach the driver."""
        last = self.engine.feed(shape).groupBy("key").agg(F.max_by(F.struct("op", "value"), "version").alias("l")).filter("l.op = 'upsert'")
        number = F.col("key").try_cast("decimal(38,0)")
        shown = last.orderBy(number.isNull(), number, "key").limit(min(limit, ROWS_MOST))
        return [{"key": r["key"], "value": dict(r["l"]["value"])} for r in shown.collect()]

    def log(self, shape: str, limit: int = LOG_DEFAULT) -> list[dict]:
        """The last feed entries as insert, update or delete."""
        number = F.col("key").try_cast("decimal(38,0)")
        before = F.lag("op").over(W.partitionBy("key").orderBy("version"))
        fed = self.engine.feed(shape).withColumn("was", before)
        order = [F.col("version"), F.col("op") == "delete", number.isNull(), number, F.col("key")]
        last = fed.orderBy(*[c.desc() for c in order]).limit(min(limit, LOG_MOST)).collect()
        kind = lambda r: "delete" if r["op"] == "delete" else "update" if r["was"] == "upsert" else "insert"
        return [{"op": kind(r), "key": r["key"], "value": None if r["value"] is None else dict(r["value"]), "version": r["version"]} for r in reversed(last)]


def _by_key() -> list[Column]:
    """Sorts numbers before texts, and as numbers."""
    number = F.when(F.col("key").rlike("^[+-]?[0-9]+$"), F.col("key").try_cast("decimal(38,0)"))
    return [number.isNull().alias("t"), number.alias("n"), F.col("key").alias("k")]


class Materialized:
    """A client's view of one query: its current rows, callbacks on change, and a wait for a write."""

    def __init__(self, engine: LiveEngine, shape: str):
        self.engine, self.shape, self.at, self._listeners, self.closed = engine, shape, -1, [], False
        self.current: dict[str, dict] = {}
        self.refresh()

    def subscribe(self, listener) -> None:
        self._listeners.append(listener)

    def refresh(self) -> list[dict]:
        if self.closed:
            return []
        fed = sorted(self.engine.feed(self.shape, after=self.at).collect(), key=lambda r: (r["version"], r["op"] == "delete"))
        for r in fed:
            if r["op"] == "upsert":
                self.current[r["key"]] = dict(r["value"])
            else:
                self.current.pop(r["key"], None)
        self.at = self.engine.version
        events = [{"op": r["op"], "key": r["key"], "value": r["value"]} for r in fed]
        for f in self._listeners if events else ():
            f(events)
        return events

    def await_commit(self, lsn: int) -> None:
        """Apply the log until a commit is in."""
        if (self.engine.highwater or (0, 0))[0] < lsn:
            self.engine.run()
        if (self.engine.highwater or (0, 0))[0] < lsn:
            raise Transient(f"commit {lsn} is not in the log")
        self.refresh()

    def close(self) -> None:
        if not self.closed:
            self.closed = True
            self.engine.release(self.shape)
