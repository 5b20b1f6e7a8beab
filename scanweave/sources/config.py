"""Object configurations: a text of `"Class" { "#id": n, "name": value, ... }` objects with // comments and pointers.

A value is a string, number, bool, list, object, or `{"#pointer": n}`, which stands for the object with that id.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

_TOKEN = re.compile(r'\s+|//[^\n]*|("[^"\n]*")|([{}\[\],:])|([^\s{}\[\],:"]+)')


_WORDS = {"true": True, "false": False, "null": None}


@dataclass
class Node:
    """A configured object: its class name, id and properties. A class that nobody knows is kept as it is."""

    kind: str
    id: int | None = None
    properties: dict = field(default_factory=dict)


def tokens(text: str) -> list[str]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"unreadable at {text[at : at + 20]!r}")
        out += [x for x in m.groups() if x is not None]
        at = m.end()
    return out


def _value(t: list[str], at: int):
    x = t[at]
    if x == "{":
        out, at = {}, at + 1
        while t[at] != "}":
            if t[at + 1] != ":":
                raise ValueError(f"a colon is missing after {t[at]}")
            out[t[at].strip('"')], at = _value(t, at + 2)
            at += t[at] == ","
        return out, at + 1
    if x == "[":
        out, at = [], at + 1
        while t[at] != "]":
            v, at = _value(t, at)
            out.append(v)
            at += t[at] == ","
        return out, at + 1
    if x[0] == '"':
        return x[1:-1], at + 1
    return (_WORDS[x] if x in _WORDS else _number(x)), at + 1


def _number(x: str):
    try:
        return int(x)
    except ValueError:
        return float(x)


def read(text: str) -> list[Node]:
    """The objects of a configuration, with pointers replaced by the objects they name."""
    t, at, nodes = tokens(text), 0, []
    while at < len(t):
        kind = t[at].strip('"')
        body, at = _value(t, at + 1)
        nodes.append(Node(kind, body.pop("#id", None), body))
    by_id = {n.id: n for n in nodes if n.id is not None}

    def resolved(v):
        if isinstance(v, dict):
            if set(v) == {"#pointer"}:
                return by_id.get(v["#pointer"])
            return {k: resolved(x) for k, x in v.items()}
        return [resolved(x) for x in v] if isinstance(v, list) else v

    for n in nodes:
        n.properties = {k: resolved(v) for k, v in n.properties.items()}
    return nodes


def write(nodes: list[Node]) -> str:
    """The text of objects, with pointers by id."""

    def plain(v):
        if isinstance(v, Node):
            return {"#pointer": v.id}
        if isinstance(v, dict):
            return {k: plain(x) for k, x in v.items()}
        return [plain(x) for x in v] if isinstance(v, list) else v

    return "\n".join(f'"{n.kind}" {json.dumps({"#id": n.id, **{k: plain(v) for k, v in n.properties.items()}}, indent=1)}' for n in nodes)
