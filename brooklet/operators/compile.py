"""Predicates to DataFrame plans.

What has no subquery becomes one Column, pushed to the scan. Positive subqueries among the
top conjuncts become left semi joins. A subquery anywhere else (negated, under OR or NOT) is
decided by a left join to its distinct values and two scalar facts about its set, whether it
is empty and whether it holds NULL: that gives SQL's three-valued answer with an equi join,
where a null-aware anti join under OR would be a nested loop.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brooklet.operators.predicate import And, In, IsNull, Leaf, Not, Or, Predicate, conjuncts, subqueries
from brooklet.schema import TableSchema, ValidationError

Tables = dict[str, DataFrame]
_names = count()


def _leaf(c: Column, op: str, value) -> Column:
    if value is None:
        return F.lit(None).cast("boolean")
    if op == "like":
        return c.like(value.replace("\\", "\\\\"))  # the pattern has no escape character; Spark's has
    return {"eq": c.__eq__, "neq": c.__ne__, "lt": c.__lt__, "lte": c.__le__, "gt": c.__gt__, "gte": c.__ge__}[op](F.lit(value))


def to_column(p: Predicate | None, col=F.col, member=None) -> Column:
    """The predicate as a Column; ``col`` finds a column by name, ``member`` decides an IN leaf."""
    match p:
        case None:
            return F.lit(True)
        case Leaf(c, op, value):
            return _leaf(col(c), op, value)
        case IsNull(c, flag):
            return col(c).isNull() if flag else col(c).isNotNull()
        case And(items):
            return reduce(lambda a, b: a & b, [to_column(x, col, member) for x in items]) if items else F.lit(True)
        case Or(items):
            eqs = {x.col for x in items if isinstance(x, Leaf) and x.op == "eq" and x.value is not None}
            if len(items) > 1 and len(eqs) == 1 and all(isinstance(x, Leaf) and x.op == "eq" and x.value is not None for x in items):
                return col(items[0].col).isin([x.value for x in items])
            return reduce(lambda a, b: a | b, [to_column(x, col, member) for x in items]) if items else F.lit(False)
        case Not(item):
            return ~to_column(item, col, member)
        case In():
            if member is None:
                raise ValidationError("a subquery cannot stand here")
            return member(p)
    raise ValidationError(f"not a predicate: {p!r}")


def value_set(leaf: In, tables: Tables) -> DataFrame:
    """The values of a subquery, one column, repeats and NULL included."""
    if leaf.table not in tables:
        raise ValidationError(f"unknown table {leaf.table}")
    return where(tables[leaf.table], leaf.where, tables).select(F.col(leaf.project).alias(f"_v{next(_names)}"))


#: A subquery's distinct values that are not NULL (one column), whether its set is empty, and whether it holds NULL.
Members = tuple[DataFrame, Column, Column]
SetOf = Callable[[In], Members]


def from_tables(tables: Tables) -> SetOf:
    """Subqueries answered by running them."""

    def of(leaf: In) -> Members:
        values = value_set(leaf, tables)
        v = values.columns[0]
        facts = values.agg(F.struct((F.count(F.lit(1)) == 0).alias("empty"), (F.count_if(F.col(v).isNull()) > 0).alias("null"))).scalar()
        return values.filter(F.col(v).isNotNull()).distinct(), facts["empty"], facts["null"]

    return of


def with_verdicts(df: DataFrame, p: Predicate | None, sets: SetOf, name: str) -> DataFrame:
    """``df`` with a boolean column: the predicate's three-valued verdict on each row."""
    flags: dict[int, Column] = {}
    kept = df.columns
    for leaf in subqueries(p):
        found, empty, null = sets(leaf)
        v, hit = f"_v{next(_names)}", f"_hit{next(_names)}"
        found = found.select(F.col(found.columns[0]).alias(v), F.lit(True).alias(hit))
        df = df.join(found, df[leaf.col] == found[v], "left").drop(v)
        yes = F.when(empty, F.lit(False)).when(F.col(leaf.col).isNull(), F.lit(None)).when(F.col(hit), F.lit(True)).when(null, F.lit(None)).otherwise(F.lit(False))
        flags[id(leaf)] = ~yes if leaf.negated else yes
    return df.select(*kept, to_column(p, F.col, lambda leaf: flags[id(leaf)]).alias(name))


def chosen(df: DataFrame, p: Predicate | None, sets: SetOf) -> DataFrame:
    """The rows for which the predicate is TRUE, its subqueries answered by ``sets``."""
    name = f"_ok{next(_names)}"
    return with_verdicts(df, p, sets, name).filter(F.col(name)).drop(name) if subqueries(p) else df.filter(to_column(p))


def where(df: DataFrame, p: Predicate | None, tables: Tables | None = None) -> DataFrame:
    """The rows of ``df`` for which the predicate is TRUE."""
    tables = tables or {}
    rest = []
    parts = list(conjuncts(p))
    plain = [x for x in parts if not subqueries(x)]
    if plain:
        df = df.filter(to_column(And(tuple(plain))))
    for x in parts:
        if isinstance(x, In) and not x.negated:
            values = value_set(x, tables)
            df = df.join(values, df[x.col] == values[values.columns[0]], "left_semi")
        elif subqueries(x):
            rest.append(x)
    if rest:
        df = chosen(df, And(tuple(rest)), from_tables(tables))
    return df


def shape(df: DataFrame, schema: TableSchema, p: Predicate | None, columns: list[str] | None = None, tables: Tables | None = None) -> DataFrame:
    """A query's rows: filtered, then projected to the columns asked for and the key."""
    return where(df, p, tables).select(*schema.projected(columns))


def row_text(schema: TableSchema, columns: list[str] | None = None, prefix: str = "") -> Column:
    """map<column, text> of a row, as the wire carries it; booleans as true and false, NULL as null."""
    cols = schema.projected(columns)
    return F.map_from_arrays(F.array(*[F.lit(c) for c in cols]), F.array(*[F.col(prefix + c).cast("string") for c in cols]))
