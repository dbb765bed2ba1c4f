"""Table schemas: coarse column types, primary keys, row keys and literal typing."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Joins the parts of a composite key.
KEY_JOINER = "\u001f"


class ValidationError(ValueError):
    """A request that can never succeed as it stands: the caller's error."""


_KINDS = {
    "int": T.LongType(), "float": T.DoubleType(), "text": T.StringType(), "bool": T.BooleanType(),
}
_WIRE = {"int": "int8", "float": "float8", "text": "text", "bool": "bool"}
_DDL = {"int": "INTEGER", "float": "DOUBLE PRECISION", "text": "TEXT", "bool": "BOOLEAN"}
_TRUE, _FALSE = {"t", "true", "TRUE", "True"}, {"f", "false", "FALSE", "False"}


def kind_of(t: T.DataType) -> str:
    """The coarse type of a Spark type; what has none of its own is compared natively, as 'native'."""
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int"
    if isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "float"
    if isinstance(t, T.BooleanType):
        return "bool"
    if isinstance(t, (T.StringType, T.CharType, T.VarcharType)):
        return "text"
    return "native"


@dataclass(frozen=True)
class ColumnDef:
    kind: str
    source_type: str = ""
    has_default: bool = False


@dataclass(frozen=True)
class TableSchema:
    name: str
    columns: dict[str, ColumnDef]
    primary_key: tuple[str, ...]
    spark: T.StructType | None = field(default=None, compare=False)

    def __post_init__(self) -> None:
        if not self.primary_key:
            raise ValidationError(f"table {self.name} needs a primary key")
        for c in self.primary_key:
            self.kind(c)

    @classmethod
    def from_df(cls, name: str, df: DataFrame, primary_key: str | list[str]) -> TableSchema:
        pk = (primary_key,) if isinstance(primary_key, str) else tuple(primary_key)
        cols = {f.name: ColumnDef(kind_of(f.dataType), f.dataType.simpleString(), bool(f.metadata.get("has_default"))) for f in df.schema.fields}
        return cls(name, cols, pk, df.schema)

    @classmethod
    def from_json(cls, name: str, doc: dict) -> TableSchema:
        """{"columns": {name: kind or {"type": kind, "hasDefault": bool}}, "primaryKey": name or list}"""
        cols = {}
        for c, d in doc["columns"].items():
            d = {"type": d} if isinstance(d, str) else d
            if d["type"] not in _KINDS:
                raise ValidationError(f"unknown type {d['type']} of column {c}")
            cols[c] = ColumnDef(d["type"], d.get("sourceType", _DDL[d["type"]].lower()), bool(d.get("hasDefault")))
        pk = doc.get("primaryKey")
        return cls(name, cols, (pk,) if isinstance(pk, str) else tuple(pk or ()))

    def to_json(self) -> dict:
        pk = list(self.primary_key)
        return {"columns": {c: d.kind for c, d in self.columns.items()}, "primaryKey": pk[0] if len(pk) == 1 else pk}

    def kind(self, column: str) -> str:
        if column not in self.columns:
            raise ValidationError(f"unknown column {column} of table {self.name}")
        return self.columns[column].kind

    def struct(self) -> T.StructType:
        """The Spark schema of the table's rows."""
        if self.spark is not None:
            return self.spark
        return T.StructType([T.StructField(c, _KINDS[d.kind], c not in self.primary_key, {"source_type": d.source_type, "has_default": d.has_default}) for c, d in self.columns.items()])

    def projected(self, columns: list[str] | None) -> list[str]:
        """The columns that a projection returns: those asked for and the key, in table order."""
        if columns is None:
            return list(self.columns)
        for c in columns:
            self.kind(c)
        return [c for c in self.columns if c in columns or c in self.primary_key]

    def key(self, prefix: str = "") -> Column:
        """The text form of a row's primary key."""
        parts = [F.coalesce(F.col(prefix + c).cast("string"), F.lit("null")) for c in self.primary_key]
        return F.concat_ws(KEY_JOINER, *parts)

    def wire(self) -> dict:
        """The schema header of the shape protocol."""
        pk = {c: i for i, c in enumerate(self.primary_key)}
        return {c: {"type": _WIRE.get(d.kind, "text")} | ({"pk_index": pk[c]} if c in pk else {}) for c, d in self.columns.items()}

    def ddl(self) -> str:
        cols = ", ".join(f'"{c}" {_DDL.get(d.kind, "TEXT")}' for c, d in self.columns.items())
        return f'CREATE TABLE "{self.name}" ({cols}, PRIMARY KEY ({", ".join(f"{chr(34)}{c}{chr(34)}" for c in self.primary_key)}))'

    def row(self, values: dict) -> dict:
        """A full row from some values: checked, typed, the rest null."""
        for c in values:
            self.kind(c)
        return {c: None if values.get(c) is None else coerce(d.kind, values[c]) for c, d in self.columns.items()}


def coerce(kind: str, value):
    """A literal in the column's type. Text is read as the type; other literals must have it."""
    bad = ValidationError(f"literal {value!r} is not of type {kind}")
    if value is None:
        return None
    if kind == "native":
        return value
    if isinstance(value, str) and kind != "text":
        try:
            if kind == "int":
                return int(value)
            if kind == "float":
                x = float(value)
                if not math.isfinite(x):
                    raise bad
                return x
        except ValueError as e:
            raise bad from e
        if value in _TRUE or value in _FALSE:
            return value in _TRUE
        raise bad
    ok = {"int": (int,), "float": (int, float), "text": (str,), "bool": (bool,)}[kind]
    if not isinstance(value, ok) or (isinstance(value, bool) and kind != "bool"):
        raise bad
    return float(value) if kind == "float" else value
