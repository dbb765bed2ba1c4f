"""Scalar aggregates over one filter, and counts kept by group columns that can answer some of them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brooklet.operators.compile import to_column, where
from brooklet.operators.predicate import And, Leaf, Or, Predicate, canonical, conjuncts, subqueries
from brooklet.schema import TableSchema, ValidationError

FUNCTIONS = ("count", "sum", "avg", "min", "max")


@dataclass(frozen=True)
class Aggregate:
    fn: str
    col: str | None = None

    def check(self, schema: TableSchema, p: Predicate | None) -> Aggregate:
        if self.fn not in FUNCTIONS:
            raise ValidationError(f"unknown aggregate {self.fn}")
        if subqueries(p):
            raise ValidationError("an aggregate's filter cannot hold a subquery")
        if self.fn != "count" and self.col is None:
            raise ValidationError(f"{self.fn} needs a column")
        if self.col is not None and schema.kind(self.col) not in ("int", "float") and self.fn in ("sum", "avg"):
            raise ValidationError(f"{self.fn} needs a numeric column, {self.col} is {schema.kind(self.col)}")
        return self

    def value(self) -> Column:
        """Over rows as they are. Sums are doubles whatever the column's type."""
        match self.fn:
            case "count":
                return F.count(F.lit(1)) if self.col is None else F.count(self.col)
            case "sum":
                return F.sum(F.col(self.col).cast("double"))
            case "avg":
                return F.avg(F.col(self.col).cast("double"))
            case "min":
                return F.min(self.col)
        return F.max(self.col)


def aggregate(df: DataFrame, schema: TableSchema, agg: Aggregate, p: Predicate | None = None) -> DataFrame:
    """One row (value, n); n counts the matching rows, cells that are NULL included."""
    agg.check(schema, p)
    return where(df, p).agg(agg.value().alias("value"), F.count(F.lit(1)).alias("n"))


def group_counts(df: DataFrame, columns: list[str], weight: str | None = None) -> DataFrame:
    """Rows per combination of the group columns; weighted where a delta is summed."""
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    out = df.groupBy(*columns).agg(n.alias("cnt"))
    return out if weight is None else out.filter("cnt != 0")


def plan_from_counts(p: Predicate | None, columns: list[str]) -> dict[str, list] | None:
    """{column: accepted values} if the filter is a conjunction of equalities, or of ORs of equalities
    on one column, over group columns, each at most once; else None, and the rows must be read."""
    plan: dict[str, list] = {}
    for x in conjuncts(p):
        leaves = x.items if isinstance(x, Or) else (x,)
        if not leaves or not all(isinstance(i, Leaf) and i.op == "eq" for i in leaves) or len({i.col for i in leaves}) > 1:
            return None
        col = leaves[0].col
        if col not in columns or col in plan:
            return None
        plan[col] = [i.value for i in leaves if i.value is not None]  # = NULL is never true
    return plan


def count_from_groups(counts: DataFrame, plan: dict[str, list]) -> DataFrame:
    """(value, n) of COUNT(*), summed over the groups that a plan accepts."""
    p = And(tuple(Or(tuple(Leaf(c, "eq", v) for v in values)) for c, values in sorted(plan.items())))
    total = F.coalesce(F.sum("cnt"), F.lit(0)).cast("long")
    return counts.filter(to_column(p)).agg(total.alias("value")).withColumn("n", F.col("value"))


def signature(table: str, agg: Aggregate, p: Predicate | None) -> str:
    return f"aggregate|{table}|{canonical(p)}|{agg.fn}|{agg.col or '*'}"
