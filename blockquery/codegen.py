"""Python source for a collection: its records as a typed dictionary, its sets of values, and a function that connects to it."""

from __future__ import annotations

from .schema import CollectionSchema, Field


def _class_name(name: str) -> str:
    return "".join(p.capitalize() for p in "".join(ch if ch.isalnum() else " " for ch in name).split()) or "Record"


def _type(f: Field) -> str:
    one = {"number": "float", "boolean": "bool", "json": f.py_type or "Any"}.get(f.kind, "str")
    if f.values:
        one = f.values_type or "Literal[" + ", ".join(map(repr, f.values)) + "]"
    if f.multi:
        one = f"list[{one}]"
    return f"{one} | None" if f.nullable else one


def record_module(schema: CollectionSchema, name: str = "records", path: str = "") -> str:
    record, unions = _class_name(name) + "Record", {f.values_type: f.values for f in schema.fields.values() if f.values and f.values_type}
    lines = ['"""Generated from the schema; do not edit."""', "", "from typing import Any, Literal, NotRequired, TypedDict", "", "from pyspark.sql import SparkSession", "", "from blockquery.client import Collection", "from blockquery.client import connect as _connect", ""]
    lines += [f"{n} = Literal[{', '.join(map(repr, values))}]" for n, values in sorted(unions.items())] + [""] * bool(unions)
    fields = ", ".join(f"{n!r}: {f'NotRequired[{_type(f)}]' if f.absent else _type(f)}" for n, f in schema.fields.items())
    lines += [f"{record} = TypedDict({record!r}, {{{fields}}})", "", f"SCHEMA: dict[str, Any] = {schema.describe()!r}", "", ""]
    lines += [f"def connect(spark: SparkSession, path: str = {path!r}, max_results: int = 10_000) -> Collection:", "    return _connect(spark, path, max_results)", ""]
    return "\n".join(lines)
