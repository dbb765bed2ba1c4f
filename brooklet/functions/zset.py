"""Weighted rows: changes as +1 and -1, and how feeds are read off them.

A changed row is ``old`` and ``new`` images of one key: an insert has no old, a delete no new.
Deltas carry the weight in ``__w``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WEIGHT = "__w"


def delta(images: DataFrame) -> DataFrame:
    """(row, __w) of (old, new): the old image leaves, the new one enters, equal ones cancel."""
    pair = F.array(F.struct(F.col("old").alias("row"), F.lit(-1).cast("long").alias(WEIGHT)), F.struct(F.col("new").alias("row"), F.lit(1).cast("long").alias(WEIGHT)))
    changed = images.filter(~F.col("old").eqNullSafe(F.col("new")))
    rest = [c for c in images.columns if c not in ("old", "new")]
    return changed.select(*rest, F.explode(pair).alias("d")).select(*rest, "d.row", f"d.{WEIGHT}").filter("row is not null")


def dedup(envelopes: DataFrame, highwater: tuple[int, int] | None, lsn: Column, seq: Column) -> DataFrame:
    """Without what was seen: stamped envelopes at or under the highwater, and repeats of a stamp.
    Unstamped envelopes pass."""
    if highwater is not None:
        h = F.struct(F.lit(highwater[0]).cast("long").alias("l"), F.lit(highwater[1]).cast("long").alias("s"))
        envelopes = envelopes.filter(lsn.isNull() | (F.struct(lsn.cast("long").alias("l"), F.coalesce(seq, F.lit(0)).cast("long").alias("s")) > h))
    marked = envelopes.withColumns({"_l": lsn, "_s": F.coalesce(seq, F.lit(0))})
    return marked.filter("_l is not null").dropDuplicates(["_l", "_s"]).unionByName(marked.filter("_l is null")).drop("_l", "_s")


def latest_per_key(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The last row of each key by ``order``; aggregated, so combined before its shuffle."""
    cols = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*cols), order).alias("_r")).select(*keys, "_r.*")


def feed(weighted: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, op, row): per key, an upsert of the row that entered, else a delete."""
    entered = F.max_by(F.when(F.col(WEIGHT) > 0, F.col("row")), F.when(F.col(WEIGHT) > 0, F.lit(1)).otherwise(F.lit(0)))
    out = weighted.groupBy(*keys).agg(entered.alias("row"), (F.max(WEIGHT) > 0).alias("in"))
    return out.select(*keys, F.when(F.col("in"), "upsert").otherwise("delete").alias("op"), F.when(F.col("in"), F.col("row")).alias("row"))


def contributors(rows: DataFrame, value: str, weight: Column | None = None) -> DataFrame:
    """(value, contributors): how many rows hold up each value of a subquery's set."""
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return rows.groupBy(F.col(value).alias("value")).agg(n.alias("contributors")).filter("contributors > 0")


def flips(before: DataFrame, after: DataFrame) -> DataFrame:
    """(value, now): values that a set gained (true) or lost, NULL among them."""
    a = before.select(F.col("value").alias("v"), F.lit(True).alias("was"))
    b = after.select(F.col("value").alias("w"), F.lit(True).alias("is"))
    both = a.join(b, F.col("v").eqNullSafe(F.col("w")), "full_outer")
    return both.filter("was is null or is is null").select(F.when(F.col("is"), F.col("w")).otherwise(F.col("v")).alias("value"), F.col("is").isNotNull().alias("now"))
