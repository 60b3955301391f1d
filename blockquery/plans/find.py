"""`where`, order and page over any DataFrame whose columns a schema describes: the exact part of a query, without blocks."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.blocks import stored_order
from ..schema import CollectionSchema
from .where import KEYS, check, compact, predicate

OrderBy = dict[str, str] | list[dict[str, str]] | None


def order_keys(order_by: OrderBy) -> list[tuple[str, str]]:
    given = [] if order_by is None else order_by if isinstance(order_by, list) else [order_by]
    keys = [(n, d) for one in given for n, d in one.items()]
    for n, d in keys:
        if d not in ("asc", "desc"):
            raise ValueError(f"{n}: the order is asc or desc")
    return keys


def order_columns(df: DataFrame, schema: CollectionSchema, keys: list[tuple[str, str]]) -> list[Column]:
    """Missing values are lowest; lists compare as their joined text; the primary key breaks ties. Without keys, the stored order."""
    if not keys:
        return stored_order(df, schema)
    out = []
    for name, direction in keys:
        f = schema.fields.get(name)
        if f is None or f.kind == "json":
            raise ValueError(f"{name!r} cannot be ordered by")
        c = F.array_join(F.col(f"`{name}`"), ",") if f.multi else F.col(f"`{name}`")
        out.append(c.asc_nulls_first() if direction == "asc" else c.desc_nulls_last())
    named = {n for n, _ in keys}
    if schema.pk is not None and schema.pk not in named:
        out.append(F.col(f"`{schema.pk}`").asc_nulls_last())
    return out


def matching(df: DataFrame, schema: CollectionSchema, where: dict[str, Any] | None) -> DataFrame:
    own = compact(where)
    check(own, schema)
    return df.where(predicate(own, KEYS in df.columns))


def page(df: DataFrame, schema: CollectionSchema, order_by: OrderBy = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """A page in the given order; with a limit Spark keeps the page's rows of each task only."""
    for name, v in (("limit", limit), ("offset", offset)):
        if v is not None and (not isinstance(v, int) or isinstance(v, bool) or v < 0):
            raise ValueError(f"{name} must not be negative")
    out = df.orderBy(*order_columns(df, schema, order_keys(order_by)))
    out = out.offset(offset) if offset else out
    return out.limit(limit) if limit is not None else out


def find(df: DataFrame, schema: CollectionSchema, where: dict[str, Any] | None = None, order_by: OrderBy = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Matching records; ordered only where an order or a page is asked for."""
    found = matching(df, schema, where)
    return found if order_by is None and limit is None and not offset else page(found, schema, order_by, limit, offset)
