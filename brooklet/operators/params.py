"""Numbered parameters: $1, $2, … in a WHERE text, filled from request parameters."""

from __future__ import annotations

import json
import re

from brooklet.schema import ValidationError

_BRACKET = re.compile(r"params\[(.+)\]")
_PLACE = re.compile(r"""('(?:[^']|'')*'|"(?:[^"]|"")*")|\$(\d+)""")


def collect(query: dict[str, object]) -> dict[int, str]:
    """{n: text} from ``params[n]=…`` pairs, which win, or one ``params`` JSON object. Keys are 1 to n without gaps."""
    found = {m[1]: v for k, v in query.items() if (m := _BRACKET.fullmatch(k))}
    if not found and query.get("params"):
        doc = query["params"]
        found = json.loads(doc) if isinstance(doc, str) else doc
        if not isinstance(found, dict):
            raise ValidationError("params must be an object of numbered values")
    out = {}
    for k, v in found.items():
        if not re.fullmatch(r"[1-9]\d*", str(k)):
            raise ValidationError(f"parameter key {k} is not a number from 1")
        out[int(k)] = "" if v is None else str(v).lower() if isinstance(v, bool) else str(v)
    if sorted(out) != list(range(1, len(out) + 1)):
        raise ValidationError("parameter keys must run from 1 without gaps")
    return out


def substitute(where: str, params: dict[int, str]) -> str:
    """The text with each $n outside quotes replaced by its value as a string literal."""

    def fill(m: re.Match) -> str:
        if m[1]:
            return m[1]
        n = int(m[2])
        if n not in params:
            raise ValidationError(f"parameter ${n} was not provided")
        return "'" + params[n].replace("'", "''") + "'"

    return _PLACE.sub(fill, where)
