"""The fence between a snapshot and the changes after it: which changes the snapshot already holds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_lsn(text: str) -> int:
    """A log position 'HI/LO' in hexadecimal as one number."""
    hi, _, lo = text.partition("/")
    return (int(hi, 16) << 32) | int(lo, 16)


def lsn_column(text: Column) -> Column:
    half = lambda i: F.conv(F.split_part(text, F.lit("/"), F.lit(i)), 16, 10).cast("long")
    return half(1) * F.lit(1 << 32) + half(2)


@dataclass(frozen=True)
class SnapshotGate:
    """A change is skipped iff its transaction was visible to the snapshot: under xmin, or under xmax
    and not in progress. Without a transaction id, iff its position is before the snapshot's."""

    lsn: int = 0
    xmin: int = 0
    xmax: int = 0
    xip: tuple[int, ...] = ()
    passthrough: bool = False

    def skips(self, xid: int | None, lsn: int | None) -> bool:
        if self.passthrough:
            return False
        if xid is not None and self.xmax:
            return xid < self.xmin or (xid < self.xmax and xid not in self.xip)
        return lsn is not None and lsn < self.lsn

    def skipped(self, xid: Column, lsn: Column) -> Column:
        """The same, over columns."""
        if self.passthrough:
            return F.lit(False)
        by_lsn = F.coalesce(lsn < F.lit(self.lsn), F.lit(False))
        if not self.xmax:
            return by_lsn
        held = F.array(*[F.lit(x) for x in self.xip]).cast("array<bigint>")
        visible = (xid < self.xmin) | ((xid < self.xmax) & ~F.array_contains(held, xid.cast("long")))
        return F.when(xid.isNotNull(), visible).otherwise(by_lsn)
