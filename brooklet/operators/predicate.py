"""Predicates: syntax tree, JSON form, validation, canonical form, and what planning reads off them.

The truth model is SQL's: a comparison with NULL is unknown, AND is decided by FALSE and OR by
TRUE, NOT keeps unknown, IS NULL is never unknown, and a row is kept where the whole is TRUE.
``x IN S`` is FALSE for an empty S, TRUE if x is in S, and otherwise unknown if x or any value
of S is NULL.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from brooklet.schema import TableSchema, ValidationError, coerce

OPS = ("eq", "neq", "lt", "lte", "gt", "gte", "like")
_SYMBOL = {"eq": "=", "neq": "<>", "lt": "<", "lte": "<=", "gt": ">", "gte": ">=", "like": "LIKE"}


@dataclass(frozen=True)
class Leaf:
    col: str
    op: str
    value: object


@dataclass(frozen=True)
class IsNull:
    col: str
    is_null: bool = True


@dataclass(frozen=True)
class And:
    items: tuple = ()


@dataclass(frozen=True)
class Or:
    items: tuple = ()


@dataclass(frozen=True)
class Not:
    item: object


@dataclass(frozen=True)
class In:
    col: str
    table: str
    project: str
    where: object = None
    negated: bool = False


Predicate = Leaf | IsNull | And | Or | Not | In
Schemas = dict[str, TableSchema]


def from_json(doc) -> Predicate | None:
    """The tree of a JSON predicate; None matches everything."""
    if doc is None:
        return None
    if not isinstance(doc, dict):
        raise ValidationError(f"not a predicate: {doc!r}")
    if "and" in doc:
        return And(tuple(from_json(x) for x in doc["and"]))
    if "or" in doc:
        return Or(tuple(from_json(x) for x in doc["or"]))
    if "not" in doc:
        return Not(from_json(doc["not"]))
    if "isNull" in doc:
        return IsNull(doc["col"], bool(doc["isNull"]))
    if "in" in doc:
        inner = doc["in"]
        return In(doc["col"], inner["table"], inner["project"], from_json(inner.get("where")), bool(doc.get("negated")))
    if doc.get("op") not in OPS or "col" not in doc or "value" not in doc:
        raise ValidationError(f"not a predicate: {doc!r}")
    return Leaf(doc["col"], doc["op"], doc["value"])


def to_json(p: Predicate | None):
    match p:
        case None:
            return None
        case Leaf(col, op, value):
            return {"col": col, "op": op, "value": value}
        case IsNull(col, flag):
            return {"col": col, "isNull": flag}
        case And(items):
            return {"and": [to_json(x) for x in items]}
        case Or(items):
            return {"or": [to_json(x) for x in items]}
        case Not(item):
            return {"not": to_json(item)}
        case In(col, table, project, where, negated):
            inner = {"table": table, "project": project} | ({"where": to_json(where)} if where is not None else {})
            return {"col": col, "in": inner} | ({"negated": True} if negated else {})
    raise ValidationError(f"not a predicate: {p!r}")


def validate(p: Predicate | None, table: str, schemas: Schemas) -> Predicate | None:
    """The predicate with its literals typed; errors name what is unknown or mistyped."""
    if table not in schemas:
        raise ValidationError(f"unknown table {table}")
    s = schemas[table]
    match p:
        case None:
            return None
        case Leaf(col, op, value):
            kind = s.kind(col)
            if op == "like" and kind != "text":
                raise ValidationError(f"LIKE needs a text column, {col} is {kind}")
            if op not in OPS:
                raise ValidationError(f"unknown operator {op}")
            return Leaf(col, op, coerce(kind, value))
        case IsNull(col, _):
            s.kind(col)
            return p
        case And(items):
            return And(tuple(validate(x, table, schemas) for x in items))
        case Or(items):
            return Or(tuple(validate(x, table, schemas) for x in items))
        case Not(item):
            return Not(validate(item, table, schemas))
        case In(col, inner, project, where, negated):
            s.kind(col)
            if inner not in schemas:
                raise ValidationError(f"unknown table {inner}")
            schemas[inner].kind(project)
            return In(col, inner, project, validate(where, inner, schemas), negated)
    raise ValidationError(f"not a predicate: {p!r}")


def canonical(p: Predicate | None) -> str:
    """A text that is equal for predicates that differ only in the order under AND and OR."""
    match p:
        case None:
            return "*"
        case Leaf(col, op, value):
            return f"L({col},{op.capitalize()},{json.dumps(value, default=str)})"
        case IsNull(col, flag):
            return f"U({col},{str(flag).lower()})"
        case And(items):
            return f"A({','.join(sorted(map(canonical, items)))})"
        case Or(items):
            return f"O({','.join(sorted(map(canonical, items)))})"
        case Not(item):
            return f"N({canonical(item)})"
        case In(col, table, project, where, negated):
            return f"I({col},{str(negated).lower()},{table}|{project}|{canonical(where)})"
    raise ValidationError(f"not a predicate: {p!r}")


def conjuncts(p: Predicate | None) -> Iterator[Predicate]:
    """The members of a (nested) AND; the predicate itself if it is none."""
    if isinstance(p, And):
        for x in p.items:
            yield from conjuncts(x)
    elif p is not None:
        yield p


def walk(p: Predicate | None) -> Iterator[Predicate]:
    if p is None:
        return
    yield p
    match p:
        case And(items) | Or(items):
            for x in items:
                yield from walk(x)
        case Not(item):
            yield from walk(item)


def subqueries(p: Predicate | None) -> list[In]:
    """The IN leaves of a predicate itself, not those inside them."""
    return [x for x in walk(p) if isinstance(x, In)]


def tables(p: Predicate | None) -> set[str]:
    """Every table that a predicate's subqueries read, at any depth."""
    return {t for x in subqueries(p) for t in {x.table} | tables(x.where)}


def columns(p: Predicate | None) -> set[str]:
    return {x.col for x in walk(p) if isinstance(x, (Leaf, IsNull, In))}


def null_sensitive(p: Predicate | None, leaf: In, negated: bool = False) -> bool:
    """Whether a NULL or the first value in the leaf's set can change rows that it doesn't name:
    where the leaf counts negated, by itself or under NOT."""
    match p:
        case In():
            return p is leaf and (p.negated or negated)
        case And(items) | Or(items):
            return any(null_sensitive(x, leaf, negated) for x in items)
        case Not(item):
            return null_sensitive(item, leaf, True)
    return False


def equality_template(p: Predicate | None) -> tuple[tuple[str, ...], tuple] | None:
    """(columns, values) if the predicate is nothing but ANDed non-null equalities on distinct columns."""
    parts = list(conjuncts(p))
    if not parts or not all(isinstance(x, Leaf) and x.op == "eq" and x.value is not None for x in parts):
        return None
    if len({x.col for x in parts}) < len(parts):
        return None
    parts = sorted(parts, key=lambda x: x.col)
    return tuple(x.col for x in parts), tuple(x.value for x in parts)


def subquery_template(p: Predicate | None) -> tuple[tuple[str, ...], tuple, Predicate | None]:
    """(columns, binds, residual): the first non-null equality of each column, in canonical order,
    lifted out of a subquery's conjuncts, so that subqueries differing in them share one plan."""
    binds: dict[str, object] = {}
    rest = []
    for x in sorted(conjuncts(p), key=canonical):
        if isinstance(x, Leaf) and x.op == "eq" and x.value is not None and x.col not in binds:
            binds[x.col] = x.value
        else:
            rest.append(x)
    residual = None if not rest else rest[0] if len(rest) == 1 else And(tuple(rest))
    return tuple(binds), tuple(binds.values()), residual


def necessary_conjunct(p: Predicate | None) -> Leaf | None:
    """An equality, else a range leaf, that every matching row must satisfy; None if there is none."""
    found = [x for x in conjuncts(p) if isinstance(x, Leaf) and x.value is not None]
    for ops in (("eq",), ("lt", "lte", "gt", "gte")):
        for x in found:
            if x.op in ops:
                return x
    return None


def like(text: str, pattern: str) -> bool:
    """SQL LIKE without an escape character."""
    return re.fullmatch("".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in pattern), text, re.S) is not None


_COMPARE = {"eq": lambda a, b: a == b, "neq": lambda a, b: a != b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b, "gt": lambda a, b: a > b, "gte": lambda a, b: a >= b, "like": like}


def evaluate(p: Predicate | None, row: dict, values: Callable[[In], set] | None = None) -> bool | None:
    """TRUE, FALSE or None (unknown) of one row, in plain Python: the tests' second opinion.
    ``values`` gives a subquery's set, with None in it for NULL."""
    match p:
        case None:
            return True
        case Leaf(col, op, value):
            cell = row.get(col)
            if cell is None or value is None:
                return None
            a, b = (cell.encode(), value.encode()) if isinstance(cell, str) and op != "like" else (cell, value)
            return _COMPARE[op](a, b)
        case IsNull(col, flag):
            return (row.get(col) is None) == flag
        case And(items):
            got = [evaluate(x, row, values) for x in items]
            return False if False in got else None if None in got else True
        case Or(items):
            got = [evaluate(x, row, values) for x in items]
            return True if True in got else None if None in got else False
        case Not(item):
            got = evaluate(item, row, values)
            return None if got is None else not got
        case In(col, _, _, _, negated):
            s, cell = values(p), row.get(col)
            got = False if not s else None if cell is None else True if cell in s else None if None in s else False
            return got if got is None or not negated else not got
    raise ValidationError(f"not a predicate: {p!r}")


def matches(p: Predicate | None, row: dict, values: Callable[[In], set] | None = None) -> bool:
    return evaluate(p, row, values) is True


def to_sql(p: Predicate | None, params: list) -> str:
    """Parameterised SQL; numbers and booleans inline, other literals appended to ``params`` as $n."""
    quoted = lambda c: '"' + c.replace('"', '""') + '"'
    match p:
        case None:
            return "TRUE"
        case Leaf(col, op, value):
            if value is None:
                return f"{quoted(col)} {_SYMBOL[op]} NULL"
            if isinstance(value, bool):
                lit = str(value).upper()
            elif isinstance(value, (int, float)):
                lit = repr(value)
            else:
                params.append(value)
                lit = f"${len(params)}"
            return f"{quoted(col)} {_SYMBOL[op]} {lit}"
        case IsNull(col, flag):
            return f"{quoted(col)} IS {'' if flag else 'NOT '}NULL"
        case And(items):
            return "(" + " AND ".join(to_sql(x, params) for x in items) + ")" if items else "TRUE"
        case Or(items):
            return "(" + " OR ".join(to_sql(x, params) for x in items) + ")" if items else "FALSE"
        case Not(item):
            return f"NOT ({to_sql(item, params)})"
        case In(col, table, project, where, negated):
            inner = f"SELECT {quoted(project)} FROM {quoted(table)}" + ("" if where is None else f" WHERE {to_sql(where, params)}")
            return f"{quoted(col)} {'NOT ' if negated else ''}IN ({inner})"
    raise ValidationError(f"not a predicate: {p!r}")
