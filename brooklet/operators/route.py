"""Routing changed rows to many queries at once.

Queries that are equalities on the same columns form a family: their values are rows of a
parameter table, and routing is an equi join of the delta with it, for one query or a million.
The rest are found by a conjunct that each must satisfy (an equality is a join, too), and what
has none is evaluated in wide projections, CHUNK predicates each.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brooklet.operators.compile import to_column
from brooklet.operators.predicate import And, Predicate, canonical, conjuncts, equality_template, necessary_conjunct
from brooklet.schema import TableSchema

#: Predicates of one projection; generated code has a size limit.
CHUNK = 100
#: Parameter rows up to which the table is broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 500_000

Queries = dict[str, Predicate | None]


def families(queries: Queries) -> tuple[dict[tuple[str, ...], dict[str, tuple]], Queries]:
    """({key columns: {query: values}}, the rest)."""
    routed: dict[tuple[str, ...], dict[str, tuple]] = defaultdict(dict)
    rest: Queries = {}
    for q, p in queries.items():
        t = equality_template(p)
        if t is None:
            rest[q] = p
        else:
            routed[t[0]][q] = t[1]
    return dict(routed), rest


def _table(spark: SparkSession, schema: TableSchema, cols: tuple[str, ...], rows: list[tuple], extra: tuple = ()) -> DataFrame:
    struct = schema.struct()
    fields = [T.StructField("_query", T.StringType()), *(T.StructField(f"_p{i}", struct[c].dataType) for i, c in enumerate(cols)), *extra]
    params = spark.createDataFrame(rows, T.StructType(fields))
    return F.broadcast(params) if len(rows) <= BROADCAST_ROWS else params


def route(delta: DataFrame, schema: TableSchema, members: dict[str, tuple], cols: tuple[str, ...]) -> DataFrame:
    """Rows of ``delta`` with _query, once for each query of the family that they match."""
    params = _table(delta.sparkSession, schema, cols, [(q, *v) for q, v in members.items()])
    on = [delta[c] == params[f"_p{i}"] for i, c in enumerate(cols)]
    return delta.join(params, on).drop(*[f"_p{i}" for i in range(len(cols))])


def evaluate_all(delta: DataFrame, queries: Queries) -> DataFrame:
    """Rows of ``delta`` with _query, by evaluating every predicate on every row."""
    items = list(queries.items())
    hits = []
    for at in range(0, len(items), CHUNK):
        each = F.array(*[F.when(to_column(p), F.lit(q)) for q, p in items[at : at + CHUNK]])
        hits.append(F.filter(each, lambda x: x.isNotNull()))
    if not hits:
        return delta.withColumn("_query", F.lit(None).cast("string")).limit(0)
    return delta.withColumn("_query", F.explode(F.concat(*hits) if len(hits) > 1 else hits[0]))


def candidates(delta: DataFrame, schema: TableSchema, queries: Queries) -> DataFrame:
    """Rows with _query by each query's necessary equality, then the rest of its predicate; queries
    without one are evaluated on all rows."""
    by_col: dict[str, Queries] = defaultdict(dict)
    scan: Queries = {}
    for q, p in queries.items():
        leaf = necessary_conjunct(p)
        if leaf is not None and leaf.op == "eq":
            by_col[leaf.col][q] = p
        else:
            scan[q] = p
    parts = [evaluate_all(delta, scan)] if scan or not by_col else []
    for col, found in sorted(by_col.items()):
        # queries that differ in the value only share the rest of their predicate, and its evaluation
        rests: dict[str, tuple[int, Predicate]] = {}
        rows = []
        for q, p in found.items():
            leaf = necessary_conjunct(p)
            rest = And(tuple(x for x in conjuncts(p) if x is not leaf))
            rows.append((q, leaf.value, rests.setdefault(canonical(rest), (len(rests), rest))[0]))
        params = _table(delta.sparkSession, schema, (col,), rows, (T.StructField("_rest", T.IntegerType()),))
        near = delta.join(params, delta[col] == params["_p0"]).drop("_p0")
        verdicts = [F.when((F.col("_rest") == i) & to_column(rest), F.lit(True)) for i, rest in rests.values()]
        keep = [F.coalesce(*verdicts[at : at + CHUNK], F.lit(False)) for at in range(0, len(verdicts), CHUNK)]
        for k in keep[1:]:
            keep[0] = keep[0] | k
        parts.append(near.filter(keep[0]).drop("_rest"))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def route_all(delta: DataFrame, schema: TableSchema, queries: Queries) -> DataFrame:
    """Rows of ``delta`` with _query, once for each query that they match, by the cheapest way for each."""
    routed, rest = families(queries)
    parts = [route(delta, schema, members, cols) for cols, members in sorted(routed.items())]
    if rest or not parts:
        parts.append(candidates(delta, schema, rest))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out
