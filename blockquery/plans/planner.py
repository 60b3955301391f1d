"""From a `where` to the blocks that can hold a match. The exact predicate is applied again to what is read, so this may keep too many blocks and never too few."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.blocks import BLOCK
from ..schema import CollectionSchema, Field
from .where import elements, operator_prunes

#: Up to so many blocks are read by their own paths; more are a broadcast semi-join that Spark prunes partitions with.
LITERAL_BLOCKS = 1000


@dataclass
class Metadata:
    """The tables beside the blocks. A None has no rows."""

    blocks: DataFrame
    zonemap: DataFrame | None = None
    postings: DataFrame | None = None
    reversed: DataFrame | None = None
    trigrams: DataFrame | None = None
    empty: DataFrame | None = None
    #: Spark types of the records' columns: bounds of native dates and times are kept as the strings that a cast gives.
    kinds: dict[str, str] = field(default_factory=dict)


def successor(prefix: str) -> str | None:
    """The least string above all with the prefix in code point order; None if there is none."""
    chars = list(prefix)
    while chars:
        code = ord(chars.pop())
        if code < 0x10FFFF:
            code = 0xE000 if code + 1 == 0xD800 else code + 1
            return "".join(chars) + chr(code)
    return None


def _overlap(lo: Column, hi: Column, op: str, v: Any) -> Column:
    """Whether bounds can hold a match. Edges are kept: doubles may have rounded them."""
    if op == "equals":
        return (lo <= F.lit(v)) & (hi >= F.lit(v))
    if op == "in":
        return reduce(lambda a, b: a | b, (_overlap(lo, hi, "equals", x) for x in v), F.lit(False))
    if op in ("gt", "gte"):
        return hi >= F.lit(v)
    if op in ("lt", "lte"):
        return lo <= F.lit(v)
    end = successor(v)
    return (hi >= F.lit(v)) & (lo < F.lit(end) if end is not None else F.lit(True))


def _blocks(df: DataFrame) -> DataFrame:
    return df.select(F.explode("blocks").alias(BLOCK)).distinct()


def _in_all(table: DataFrame, values: list[str]) -> DataFrame:
    """Blocks in the lists of all values; each value has one list."""
    found = table.where(F.col("value").isin(*values)).select(F.explode("blocks").alias(BLOCK))
    return found.groupBy(BLOCK).agg(F.count("*").alias("n")).where(F.col("n") == len(values)).select(BLOCK)


def _of(table: DataFrame | None, name: str) -> DataFrame | None:
    return None if table is None else table.where(F.col("field") == name)


def _sorted(meta: Metadata, filters: dict[str, Any], pruning: tuple[str, ...]) -> DataFrame | None:
    parts = [_overlap(F.col("lo"), F.col("hi"), op, v) for op, v in filters.items() if operator_prunes(op, v, pruning)]
    return meta.blocks.where(reduce(lambda a, b: a & b, parts)).select(BLOCK) if parts else None


def _indexed(meta: Metadata, f: Field, filters: dict[str, Any], pruning: tuple[str, ...]) -> list[DataFrame]:
    """A candidate set for each operator that an index answers; all of them hold the match."""
    out, name = [], f.name
    for op, v in filters.items():
        if not operator_prunes(op, v, pruning):
            continue
        if f.kind in ("number", "date"):
            z = _of(meta.zonemap, name)
            lo, hi = ("min_n", "max_n") if f.kind == "number" else ("min_s", "max_s")
            if f.kind == "date":
                as_text = _as_text(meta.kinds.get(name, "string"))
                v = [as_text(x) for x in v] if op == "in" else as_text(v)
            out.append(z.where(_overlap(F.col(lo), F.col(hi), op, v)).select(BLOCK))
            continue
        table, value = _of(meta.postings, name), F.col("value")
        if op in ("equals", "in"):
            wanted = [str(x).lower() if isinstance(x, bool) else x for x in (v if op == "in" else [v])]
            out.append(_blocks(table.where(value.isin(*wanted) if wanted else F.lit(False))))
        elif op == "startsWith":
            out.append(_blocks(table.where(value.startswith(v))))
        elif op == "endsWith":
            out.append(_blocks(_of(meta.reversed, name).where(value.startswith(v[::-1]))))
        elif op == "contains":
            grams = sorted({v[i : i + 3] for i in range(len(v) - 2)})
            out.append(_in_all(_of(meta.trigrams, name), grams))
    return out


def _as_text(kind: str) -> Callable[[Any], Column]:
    """A value as the string that its column has in the zonemap: ISO strings stay, native dates and times are cast like their column."""
    if kind == "string":
        return lambda v: F.lit(v.isoformat() if isinstance(v, dt.date) else v)
    return lambda v: F.lit(v).cast(kind).cast("string")


def _list(meta: Metadata, f: Field, filters: dict[str, Any], pruning: tuple[str, ...]) -> list[DataFrame]:
    out = []
    for op, v in filters.items():
        if not operator_prunes(op, v, pruning):
            continue
        if op == "hasEvery":
            wanted = list(dict.fromkeys(v))
            if f.kind == "string" and wanted:  # one lookup: a block must be in the lists of all values
                out.append(_in_all(_of(meta.postings, f.name), wanted))
            else:
                out += [p for x in wanted for p in _indexed(meta, f, {"equals": x}, pruning)]
            continue
        none = _of(meta.empty, f.name).select(BLOCK) if meta.empty is not None else None
        if op == "isEmpty":
            if none is not None:
                out.append(none)
            continue
        found = _indexed(meta, f, elements(v), pruning)
        if op == "some":
            out += found
        elif none is not None:  # every: an empty list passes
            out += [p.union(none).distinct() for p in found]
    return out


def candidate_sets(where: dict[str, dict[str, Any]], schema: CollectionSchema, meta: Metadata) -> list[DataFrame]:
    out = []
    for name, filters in where.items():
        f, pruning = schema.fields[name], schema.pruning(name)
        if schema.is_sort(name):
            found = _sorted(meta, filters, pruning)
            out += [found] if found is not None else []
        else:
            out += _list(meta, f, filters, pruning) if f.multi else _indexed(meta, f, filters, pruning)
    return out


def candidates(where: dict[str, dict[str, Any]], schema: CollectionSchema, meta: Metadata) -> DataFrame | None:
    """The blocks in all candidate sets; None if nothing narrows."""
    sets = candidate_sets(where, schema, meta)
    return reduce(lambda a, b: a.join(b, BLOCK, "left_semi"), sets) if sets else None


def named(found: DataFrame) -> list[int] | None:
    """The candidate blocks, in order; None where they are more than LITERAL_BLOCKS."""
    # candidate sets are distinct in themselves, and so is what is left of one by the others
    rows = found.limit(LITERAL_BLOCKS + 1).collect()
    return sorted({r[0] for r in rows}) if len(rows) <= LITERAL_BLOCKS else None
