"""Subset queries: one ordered page of a query, and cursors to the next.

Order is the source database's: ascending with NULLs last, descending with NULLs first; every
primary-key column breaks ties in the same direction.
"""

from __future__ import annotations

from functools import cmp_to_key, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brooklet.operators.compile import Tables, where
from brooklet.operators.predicate import Predicate
from brooklet.schema import TableSchema, ValidationError

OrderBy = tuple[str, str]


def order_columns(schema: TableSchema, order_by: OrderBy | None) -> list[Column]:
    if order_by is None:
        return [F.col(c).asc_nulls_last() for c in schema.primary_key]
    col, direction = order_by
    schema.kind(col)
    if direction not in ("asc", "desc"):
        raise ValidationError(f"order is asc or desc, not {direction}")
    cols = [col, *(c for c in schema.primary_key if c != col)]
    return [F.col(c).asc_nulls_last() if direction == "asc" else F.col(c).desc_nulls_first() for c in cols]


def _after_one(col: str, value, desc: bool) -> Column:
    c = F.col(col)
    if value is None:
        return c.isNotNull() if desc else F.lit(False)
    return (c < F.lit(value)) if desc else (c > F.lit(value)) | c.isNull()


def keyset(schema: TableSchema, order_by: OrderBy | None, last: dict) -> Column:
    """The rows that come after ``last`` in the page order; NULL boundaries have their own region."""
    cols = [order_by[0], *(c for c in schema.primary_key if c != order_by[0])] if order_by else list(schema.primary_key)
    desc = bool(order_by) and order_by[1] == "desc"
    out = F.lit(False)
    for i, c in enumerate(cols):
        same = [F.col(x).eqNullSafe(F.lit(last[x])) for x in cols[:i]]
        out = out | reduce(lambda a, b: a & b, [*same, _after_one(c, last[c], desc)])
    return out


def query_subset(df: DataFrame, schema: TableSchema, p: Predicate | None = None, columns: list[str] | None = None, order_by: OrderBy | None = None, limit: int | None = None, offset: int | None = None, after: dict | None = None, tables: Tables | None = None) -> DataFrame:
    """One page. Limits and offsets under 0 count as 0; an order column is read though not returned."""
    rows = where(df, p, tables)
    if after is not None:
        rows = rows.filter(keyset(schema, order_by, after))
    if order_by is not None or limit is not None or offset:
        rows = rows.orderBy(*order_columns(schema, order_by))
    if offset:
        rows = rows.offset(max(0, offset))
    if limit is not None:
        rows = rows.limit(max(0, limit))
    return rows.select(*schema.projected(columns))


def comparator(schema: TableSchema, order_by: OrderBy | None):
    """A sort key for rows in plain Python, in the same order as a page."""
    cols = [order_by[0], *(c for c in schema.primary_key if c != order_by[0])] if order_by else list(schema.primary_key)
    sign = -1 if order_by and order_by[1] == "desc" else 1

    def compare(a: dict, b: dict) -> int:
        for c in cols:
            x, y = a[c], b[c]
            if x == y:
                continue
            if x is None or y is None:
                return sign * (1 if x is None else -1)
            if isinstance(x, str):
                x, y = x.encode(), y.encode()
            return sign * (-1 if x < y else 1)
        return 0

    return cmp_to_key(compare)
