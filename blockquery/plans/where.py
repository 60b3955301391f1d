"""The `where` dictionary: what may stand in it, what of it narrows the blocks to read, and its exact predicate."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import EngineError
from ..schema import LIST_OPERATORS, CollectionSchema, Field, element_operators

KEYS, REST = "_keys", "_rest"


class _Unset:
    def __repr__(self) -> str:
        return "UNSET"


#: A filter that is not there; None means the same (a null value is asked for with isNull).
UNSET = _Unset()


def _gone(v: Any) -> bool:
    return v is None or v is UNSET


def compact(where: dict[str, Any] | None) -> dict[str, dict[str, Any]]:
    """Without unset filters, operators and element operators, and without what is then empty."""
    out: dict[str, dict[str, Any]] = {}
    for name, filters in (where or {}).items():
        if _gone(filters):
            continue
        if not isinstance(filters, dict):
            raise ValueError(f"{name}: a filter is a dictionary of operators")
        own: dict[str, Any] = {}
        for op, v in filters.items():
            if op in ("some", "every") and isinstance(v, dict):
                v = {k: x for k, x in v.items() if not _gone(x)}
                if not v:
                    continue
            if not _gone(v):
                own[op] = v
        if own:
            out[name] = own
    return out


def _check_value(name: str, f: Field, op: str, v: Any) -> None:
    single = {"string": str, "date": (str, dt.date), "number": (int, float), "boolean": bool}.get("string" if f.multi else f.kind, object)
    right = lambda x: isinstance(x, single) and (single is bool or not isinstance(x, bool))
    if op in ("in", "hasEvery"):
        if isinstance(v, (str, dict)) or not all(right(x) for x in v):
            raise ValueError(f"{name}.{op} takes a list of the field's kind")
    elif op in ("isNull", "isAbsent", "exists", "isEmpty"):
        if not isinstance(v, bool):
            raise ValueError(f"{name}.{op} takes true or false")
    elif op in ("startsWith", "endsWith", "contains"):
        if not isinstance(v, str):
            raise ValueError(f"{name}.{op} takes a string")
    elif not right(v):
        raise ValueError(f"{name}.{op} takes a value of the field's kind")


def check(where: dict[str, dict[str, Any]], schema: CollectionSchema) -> None:
    """Every field known, every operator one of the field's, every value of its kind."""
    for name, filters in where.items():
        f = schema.fields.get(name)
        if f is None:
            raise ValueError(f"unknown field {name!r}")
        allowed = schema.operators(name)
        for op, v in filters.items():
            if op not in allowed:
                raise ValueError(f"{name}: operator {op!r} is not one of {list(allowed)}")
            if op in ("some", "every"):
                for inner, x in elements(v).items():
                    if inner not in element_operators(f):
                        raise ValueError(f"{name}.{op}: operator {inner!r} is not one of {list(element_operators(f))}")
                    _check_value(f"{name}.{op}", f, inner, x)
            else:
                _check_value(name, f, op, v)


def elements(v: Any) -> dict[str, Any]:
    """An element filter; a plain value stands for equals."""
    return v if isinstance(v, dict) else {"equals": v}


# --- what narrows --------------------------------------------------------------------------------


def operator_prunes(op: str, v: Any, pruning: tuple[str, ...]) -> bool:
    if op in ("some", "every"):
        return any(operator_prunes(inner, x, pruning) for inner, x in elements(v).items())
    if op == "hasEvery":
        return bool(pruning) and len(v) > 0
    if op == "isEmpty":
        return bool(pruning) and v is True
    if op not in pruning:
        return False
    if op == "contains":
        return len(v) >= 3
    return v != "" if op in ("startsWith", "endsWith") else True


def where_prunes(where: dict[str, Any] | None, schema: CollectionSchema) -> bool:
    own = compact(where)
    return not own or any(operator_prunes(op, v, schema.pruning(name)) for name, filters in own.items() if name in schema.fields for op, v in filters.items())


def assert_prunes(where: dict[str, Any], schema: CollectionSchema) -> None:
    if where_prunes(where, schema):
        return
    notes = []
    for name, filters in where.items():
        for op, v in filters.items():
            if op == "contains" and "contains" in schema.pruning(name):
                notes.append(f"{name}.contains needs three characters or more")
            elif op in ("startsWith", "endsWith", "hasEvery") and len(v) == 0:
                notes.append(f"{name}.{op} is empty")
    able = [n for n in schema.fields if schema.pruning(n)]
    raise EngineError("NEEDS_PRUNING", f"the filters on {', '.join(where)} narrow nothing, so every block would be read; add a filter on one of {', '.join(able)}" + (f" ({'; '.join(notes)})" if notes else ""))


# --- the predicate -------------------------------------------------------------------------------


def _value(c: Column, op: str, v: Any) -> Column:
    match op:
        case "equals":
            return c == v
        case "not":
            return c != v
        case "in":
            return c.isin(*v) if len(v) else F.lit(False)
        case "gt":
            return c > v
        case "gte":
            return c >= v
        case "lt":
            return c < v
        case "lte":
            return c <= v
        case "startsWith":
            return c.startswith(v)
        case "endsWith":
            return c.endswith(v)
        case "contains":
            return c.contains(v)
    raise ValueError(f"unknown operator {op!r}")


def _all(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


def _element(v: Any) -> Callable[[Column], Column]:
    """All operators of an element filter, on one element."""
    return lambda x: _all([_value(x, op, y) for op, y in elements(v).items()])


def field_predicate(name: str, filters: dict[str, Any], has_keys: bool = False) -> Column:
    """has_keys: whether records say which keys they have; without, a null counts as null and no key is absent."""
    c, parts = F.col(f"`{name}`"), []
    present = F.array_contains(F.col(KEYS), name) if has_keys else F.lit(True)
    for op, v in filters.items():
        if op == "isNull":
            parts.append((present & c.isNull()) == F.lit(v))
        elif op == "isAbsent":
            parts.append(~present == F.lit(v))
        elif op == "exists":
            parts.append(c.isNotNull() if v else c.isNull())
        elif op == "some":
            parts.append(F.exists(c, _element(v)))
        elif op == "every":
            parts.append(c.isNotNull() & F.forall(c, _element(v)))
        elif op == "hasEvery":
            parts.append(c.isNotNull() & _all([F.array_contains(c, x) for x in v]))
        elif op == "isEmpty":
            parts.append((F.size(c) == 0) == F.lit(v))
        else:
            parts.append(_value(c, op, v))
    return _all(parts)


def predicate(where: dict[str, dict[str, Any]], has_keys: bool = False) -> Column:
    return _all([field_predicate(name, filters, has_keys) for name, filters in where.items()])


__all__ = ["KEYS", "REST", "LIST_OPERATORS", "UNSET", "assert_prunes", "check", "compact", "elements", "field_predicate", "operator_prunes", "predicate", "where_prunes"]
