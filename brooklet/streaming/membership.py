"""The sets behind subqueries, kept as weighted values and advanced by deltas.

A node is a subquery without the equalities that its queries differ in: its table, the projected
column, the columns of those equalities (binds) and the rest of its filter. Its state has a row for each
(binds, value) with the number of rows that hold the value up, so queries that differ in the binds
share it. A batch adds a delta: the values that changed rows brought or took. A value whose count becomes
positive, or stops being so, has *flipped*; only flips reach the rows, and the nodes, that connect to it.

Rows that a batch can have changed for a predicate are its images, and the rows whose connecting
column holds a flipped value; all rows only where a set gained or lost NULL, or became (non-)empty,
under a negation. State is read for the values in question alone, by a join with them.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brooklet.operators import compile as comp
from brooklet.operators.predicate import In, Predicate, canonical, from_json, null_sensitive, subqueries, subquery_template, to_json

#: Deltas of a node's state beyond which they are folded into a base.
MOST_DELTAS = 20
#: Counted rows up to which values are broadcast to a state or table; beyond, the join shuffles.
BROADCAST_VALUES = 20_000


@dataclass
class Node:
    id: str
    table: str
    project: str
    binds: tuple[str, ...]
    residual: Predicate | None
    bases: list[int] = field(default_factory=list)
    deltas: list[int] = field(default_factory=list)

    @property
    def keys(self) -> list[str]:
        return [*(f"b{i}" for i in range(len(self.binds))), "value"]


def _same(a: DataFrame, b: DataFrame, names: list[str]) -> list[Column]:
    return [a[n].eqNullSafe(b[n]) for n in names]


class Sets:
    """The nodes of an engine's subqueries."""

    def __init__(self, engine, found: dict[str, dict]):
        self.engine, self.nodes, self._facts = engine, {}, {}
        for d in found.values():
            self.nodes[d["id"]] = Node(d["id"], d["table"], d["project"], tuple(d["binds"]), from_json(d["residual"]), list(d["bases"]), list(d["deltas"]))

    # ---- nodes

    @staticmethod
    def split(leaf: In) -> tuple[str, tuple]:
        """The node of a subquery, and the values of its binds."""
        cols, values, residual = subquery_template(leaf.where)
        sig = f"{leaf.table}|{leaf.project}|{','.join(cols)}|{canonical(residual)}"
        return hashlib.sha256(sig.encode()).hexdigest()[:16], values

    def node(self, leaf: In) -> Node:
        return self.nodes[self.split(leaf)[0]]

    def ensure(self, p: Predicate | None) -> None:
        """Nodes for every subquery of a predicate, the inner ones first, seeded from the tables as they are."""
        for leaf in subqueries(p):
            i, _ = self.split(leaf)
            if i in self.nodes:
                continue
            cols, _, residual = subquery_template(leaf.where)
            self.ensure(residual)
            n, e = Node(i, leaf.table, leaf.project, cols, residual), self.engine
            rows = self.decided(n.table, e.table(n.table), residual, e.version, None)
            self._add(n, rows, F.lit(1), "base", e.version)
            n.bases = [e.version]
            self.nodes[i] = n
            e.catalog.log("node", id=i, table=n.table, project=n.project, binds=list(cols), residual=to_json(residual), bases=n.bases, deltas=[])

    def drop_unused(self) -> None:
        """Nodes that no query reaches go, with their state."""
        used: set[str] = set()

        def mark(p: Predicate | None) -> None:
            for leaf in subqueries(p):
                used.add(self.split(leaf)[0])
                mark(leaf.where)

        for s in self.engine.shapes.values():
            mark(s.predicate)
        for i in [i for i in self.nodes if i not in used]:
            del self.nodes[i]
            self.engine.catalog.log("node_dropped", id=i)
            self.engine.store.delete(f"sets/{i}")

    # ---- state

    def _path(self, n: Node, kind: str, version: int) -> str:
        return self.engine.store.path(f"sets/{n.id}/{kind}-{version:09d}")

    def _weighed(self, n: Node, rows: DataFrame, w: Column) -> DataFrame:
        return rows.select(*[F.col(c).alias(f"b{i}") for i, c in enumerate(n.binds)], F.col(n.project).alias("value"), w.cast("long").alias("w"))

    def _add(self, n: Node, rows: DataFrame, w: Column, kind: str, version: int) -> None:
        sums = self._weighed(n, rows, w).groupBy(*n.keys).agg(F.sum("w").alias("w"))
        self.engine._write(sums, self._path(n, kind, version))

    def state(self, n: Node, version: int, only: DataFrame | None = None, few: bool = True, on: list[str] | None = None) -> DataFrame:
        """(binds, value, w) with w > 0 as of a version; of the values in ``only`` alone, if given."""
        base = max(v for v in n.bases if v <= version)
        paths = [self._path(n, "base", base), *(self._path(n, "delta", v) for v in n.deltas if base < v <= version)]
        struct = self.engine.schemas[n.table].struct()
        ddl = ", ".join(f"{k} {struct[c].dataType.simpleString()}" for k, c in zip(n.keys, (*n.binds, n.project), strict=True)) + ", w bigint"
        parts = self.engine.spark.read.schema(ddl).parquet(*paths)
        if only is not None:
            only = F.broadcast(only) if few else only
            parts = parts.join(only, _same(parts, only, on or ["value"]), "left_semi")
        return parts.groupBy(*n.keys).agg(F.sum("w").alias("w")).filter("w > 0")

    def _bound(self, leaf: In, rows: DataFrame) -> DataFrame:
        """The rows of a node's table that belong to a subquery's own binds."""
        for i, v in enumerate(self.split(leaf)[1]):
            rows = rows.filter(F.col(f"b{i}") == F.lit(v))
        return rows

    def facts(self, leaf: In, version: int) -> tuple[bool, bool]:
        """Whether a subquery's set is empty, and whether it holds NULL."""
        i, values = self.split(leaf)
        name = (i, values, version)
        if name not in self._facts:
            got = self._bound(leaf, self.state(self.nodes[i], version)).agg((F.count(F.lit(1)) == 0).alias("e"), (F.count_if(F.col("value").isNull()) > 0).alias("n")).first()
            self._facts[name] = (got["e"], got["n"])
        return self._facts[name]

    def members(self, p: Predicate | None, version: int, rows: DataFrame | None, few: bool) -> comp.SetOf:
        """How a predicate's subqueries are answered as of a version, for the connecting values of ``rows``."""

        def of(leaf: In) -> comp.Members:
            n = self.node(leaf)
            only = None if rows is None else rows.select(F.col(leaf.col).alias("value")).filter("value is not null").distinct()
            found = self._bound(leaf, self.state(n, version, only, few)).filter("value is not null").select("value").distinct()
            # without a negation an unknown verdict is as good as a false one
            empty, null = self.facts(leaf, version) if null_sensitive(p, leaf) else (False, False)
            return found, F.lit(empty), F.lit(null)

        return of

    def decided(self, table: str, rows: DataFrame, p: Predicate | None, version: int, few: bool | None) -> DataFrame:
        """The rows for which a predicate is TRUE as of a version; ``few``: whether they may be broadcast,
        None for a whole table."""
        return comp.chosen(rows, p, self.members(p, version, None if few is None else rows, bool(few)))

    # ---- one batch

    def advance(self, images: dict[str, DataFrame], counts: dict[str, int], version: int) -> dict[str, DataFrame]:
        """Bring every node to a version; (binds, value, now) of the values that flipped, by node."""
        flips: dict[str, DataFrame] = {}
        levels: dict[int, list[Node]] = {}
        for n in self.nodes.values():
            levels.setdefault(self._depth(n.residual), []).append(n)
        for _, nodes in sorted(levels.items()):  # inner sets first; those of one depth side by side
            due = [n for n in nodes if n.table in images or any(self.split(x)[0] in flips for x in subqueries(n.residual))]
            got: dict[str, DataFrame] = {}
            self.engine.together([partial(self._advance, n, images, counts, flips, version, got) for n in due])
            flips |= got
            self.engine.metrics.count("flipped_sets", len(got))
        return flips

    def _depth(self, p: Predicate | None) -> int:
        return max((1 + self._depth(x.where) for x in subqueries(p)), default=0)

    def _advance(self, n: Node, images: dict[str, DataFrame], counts: dict[str, int], flips: dict[str, DataFrame], version: int, got: dict[str, DataFrame]) -> None:
        e = self.engine
        olds, news, few = self.near(n.table, n.residual, images, counts, flips, version, n.id)
        if olds is None:
            return
        was = self._weighed(n, self.decided(n.table, olds, n.residual, e.version, few), F.lit(-1))
        now = self._weighed(n, self.decided(n.table, news, n.residual, version, few), F.lit(1))
        moved = was.union(now).groupBy(*n.keys).agg(F.sum("w").alias("w")).filter("w != 0")
        e._write(moved, path := self._path(n, "delta", version))
        moved = e.spark.read.schema(moved.schema).parquet(path)
        size = moved.count()
        if not size:
            e.store.delete(path.removeprefix(f"{e.store.root}/"))
            return
        held = self.state(n, e.version, moved.select(*n.keys), size <= BROADCAST_VALUES, n.keys).withColumnRenamed("w", "had")
        both = moved.join(held, _same(moved, held, n.keys), "left").select(*[moved[k] for k in n.keys], "w", F.coalesce("had", F.lit(0)).alias("had"))
        found = both.filter("(had > 0) != (had + w > 0)").select(*n.keys, (F.col("had") == 0).alias("now"))
        e._write(found, where := f"{e.work}/{version:09d}-flips-{n.id}")
        n.deltas.append(version)
        flipped = e.spark.read.schema(found.schema).parquet(where)
        if not flipped.isEmpty():
            got[n.id] = flipped

    def flipped(self, leaf: In, flips: dict[str, DataFrame]) -> DataFrame | None:
        i, _ = self.split(leaf)
        return self._bound(leaf, flips[i]) if i in flips else None

    def near(self, t: str, p: Predicate | None, images: dict[str, DataFrame], counts: dict[str, int], flips: dict[str, DataFrame], version: int, name: str) -> tuple[DataFrame | None, DataFrame | None, bool | None]:
        """The rows of a table, before and after, for which a predicate can have changed, and whether
        they may be broadcast (None: they are all rows); None where there are none."""
        e = self.engine
        moved = [(leaf, f) for leaf in subqueries(p) if (f := self.flipped(leaf, flips)) is not None]
        for leaf, _ in moved:
            if null_sensitive(p, leaf) and self.facts(leaf, e.version) != self.facts(leaf, version):
                return e.table(t, e.version), e.table(t, version), None
        own, names = images.get(t), e.schemas[t].struct().names
        olds = news = None
        if own is not None:
            olds, news = own.filter("old is not null").select("old.*"), own.filter("new is not null").select("new.*")
        size = counts.get(t, 0)
        if moved:
            key, rows = e.schemas[t].key(), e.table(t, version)
            hit = None
            for leaf, f in moved:
                values = f.select(F.col("value").alias("_flip")).filter("_flip is not null").distinct()
                got = rows.join(values, rows[leaf.col] == values["_flip"], "left_semi")
                hit = got if hit is None else hit.union(got)
            if len(moved) > 1:
                hit = hit.dropDuplicates(list(e.schemas[t].primary_key))
            if own is not None:
                mine = own.select(F.col("key").alias("_k"))
                hit = hit.withColumn("_k", key).join(F.broadcast(mine) if size <= BROADCAST_VALUES else mine, "_k", "left_anti").drop("_k")
            e._write(hit.select(*names), path := f"{e.work}/{version:09d}-near-{name}")
            hit = e.spark.read.schema(e.schemas[t].struct()).parquet(path)
            if more := hit.count():
                size += more
                olds, news = (hit, hit) if olds is None else (olds.unionByName(hit), news.unionByName(hit))
        return olds, news, size <= BROADCAST_VALUES

    def compact(self, version: int) -> None:
        """Fold the deltas of nodes that have many; files of older versions stay for those who read them."""
        for n in self.nodes.values():
            if sum(v > max(n.bases) for v in n.deltas) > MOST_DELTAS:
                self.engine._write(self.state(n, version), self._path(n, "base", version))
                n.bases.append(version)
        self._facts = {k: v for k, v in self._facts.items() if k[2] >= version - 1}

    def rewind(self, version: int) -> None:
        """Forget what a batch that was not committed had begun."""
        for n in self.nodes.values():
            n.bases, n.deltas = [v for v in n.bases if v <= version], [v for v in n.deltas if v <= version]
        self._facts = {k: v for k, v in self._facts.items() if k[2] <= version}

    def marks(self) -> dict[str, dict]:
        return {i: {"bases": n.bases, "deltas": n.deltas} for i, n in self.nodes.items()}
