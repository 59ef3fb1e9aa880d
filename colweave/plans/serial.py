"""Programs as JSON and back: nodes once each, in an order where arguments come first."""

from __future__ import annotations

import json
from typing import Any

from ..types import BY_NAME, DType, timestamp
from .expr import Expr
from .program import Program, Table


def _plain(value: Any, number) -> Any:
    if isinstance(value, DType):
        return {"time": [value.unit, value.utc]} if value.kind == "time" else {"type": value.name}
    if isinstance(value, Expr):
        return {"node": number(value)}
    return list(value) if isinstance(value, tuple | set) else value


def _back(value: Any, nodes: list[Expr]) -> Any:
    if isinstance(value, dict):
        if "time" in value:
            return timestamp(*value["time"])
        return BY_NAME[value["type"]] if "type" in value else nodes[value["node"]]
    return value


def to_json(program: Program) -> str:
    """Text that from_json reads back; shared nodes stay shared."""
    numbers: dict[int, int] = {}
    nodes: list[dict] = []

    def number(e: Expr) -> int:
        if id(e) not in numbers:
            args = [number(a) for a in e.args]
            params = {k: _plain(v, number) for k, v in e.params.items()}
            numbers[id(e)] = len(nodes)
            nodes.append({"op": e.op, "args": args, "params": params})
        return numbers[id(e)]

    outputs = {n: number(e) for n, e in program.outputs.items()}
    columns = {n: [_plain(t, number), nullable] for n, (t, nullable) in program.schema.columns.items()} if program.schema else None
    return json.dumps({"nodes": nodes, "outputs": outputs, "columns": columns})


def from_json(text: str) -> Program:
    data = json.loads(text)
    nodes: list[Expr] = []
    for n in data["nodes"]:
        nodes.append(Expr(n["op"], tuple(nodes[a] for a in n["args"]), {k: _back(v, nodes) for k, v in n["params"].items()}))
    schema = None
    if data["columns"] is not None:
        schema = Table({})
        schema.columns = {n: (_back(t, nodes), nullable) for n, (t, nullable) in data["columns"].items()}
    return Program({n: nodes[k] for n, k in data["outputs"].items()}, schema)


def inspect_json(text: str, df, mode: str = "formatted", **inputs: Any) -> str:
    """inspect of a program that is there as JSON."""
    return from_json(text).inspect(df, mode, **inputs)
