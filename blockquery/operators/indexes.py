"""Zonemaps and postings: which blocks hold which values, as ordinary tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import trigrams
from ..schema import CollectionSchema, Field
from .blocks import BLOCK


def indexed(schema: CollectionSchema) -> list[Field]:
    return [f for f in schema.fields.values() if f.indexed and not schema.is_sort(f.name)]


def zonemap_aggregates(fields: list[Field]) -> list[Column]:
    aggs: list[Column] = []
    for i, f in enumerate(fields):
        c = F.col(f"`{f.name}`")
        low, high = (F.array_min(c), F.array_max(c)) if f.multi else (c, c)
        aggs += [F.min(low).alias(f"_lo{i}"), F.max(high).alias(f"_hi{i}")]
    return aggs


def zonemap_of(wide: DataFrame, fields: list[Field]) -> DataFrame:
    """field, block and bounds: as strings for strings and dates, as doubles for numbers and booleans. wide: zonemap_aggregates by block."""

    def row(i: int, f: Field) -> Column:
        text = f.kind in ("string", "date")
        as_text = lambda c: c.cast("string") if text else F.lit(None).cast("string")
        as_number = lambda c: F.lit(None).cast("double") if text else c.cast("double")
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        return F.struct(F.lit(f.name).alias("field"), as_text(lo).alias("min_s"), as_text(hi).alias("max_s"), as_number(lo).alias("min_n"), as_number(hi).alias("max_n"))

    long = wide.select(BLOCK, F.explode(F.array(*(row(i, f) for i, f in enumerate(fields)))).alias("z"))
    return long.select("z.field", BLOCK, "z.min_s", "z.max_s", "z.min_n", "z.max_n").where("min_s IS NOT NULL OR min_n IS NOT NULL")


def zonemap(stored: DataFrame, schema: CollectionSchema) -> DataFrame | None:
    fields = indexed(schema)
    return zonemap_of(stored.groupBy(BLOCK).agg(*zonemap_aggregates(fields)), fields) if fields else None


def _entries(f: Field, tables: tuple[str, ...]) -> list[Column]:
    """Arrays of (table, field, value): what a record adds to the value, suffix and trigram indexes by one field."""
    c = F.col(f"`{f.name}`")
    values = F.filter(c, lambda x: x.isNotNull()) if f.multi else F.when(c.isNotNull(), F.array(c))
    row = lambda table, v: F.struct(F.lit(table).alias("table"), F.lit(f.name).alias("field"), v.cast("string").alias("value"))
    out = []
    if "postings" in tables and f.kind in ("string", "boolean"):
        out.append(F.transform(values, lambda v: row("postings", v)))
    if "reversed" in tables and f.ends_with:
        out.append(F.transform(values, lambda v: row("reversed", F.reverse(v))))
    if "trigrams" in tables and f.contains:
        out.append(F.transform(F.array_distinct(F.flatten(F.transform(values, trigrams))), lambda v: row("trigrams", v)))
    return [F.coalesce(x, F.array().cast("array<struct<table:string,field:string,value:string>>")) for x in out]


TEXT_TABLES = ("postings", "reversed", "trigrams")


def tables_of(schema: CollectionSchema) -> list[str]:
    return [t for t in TEXT_TABLES if any(_entries(f, (t,)) for f in indexed(schema))]


def text_indexes(stored: DataFrame, schema: CollectionSchema, tables: tuple[str, ...] = TEXT_TABLES) -> DataFrame | None:
    """table, field, value, blocks: all of these indexes from one scan. Entries are made distinct first, so a common value is one row of each block and no more."""
    arrays = [x for f in indexed(schema) for x in _entries(f, tables)]
    if not arrays:
        return None
    entries = stored.select(BLOCK, F.explode(F.concat(*arrays)).alias("e")).select(BLOCK, "e.*").distinct()
    return entries.groupBy("table", "field", "value").agg(F.sort_array(F.collect_set(BLOCK)).alias("blocks"))


def _one(stored: DataFrame, schema: CollectionSchema, table: str) -> DataFrame | None:
    found = text_indexes(stored, schema, (table,))
    return None if found is None else found.select("field", "value", "blocks")


def postings(stored: DataFrame, schema: CollectionSchema) -> DataFrame | None:
    return _one(stored, schema, "postings")


def reversed_postings(stored: DataFrame, schema: CollectionSchema) -> DataFrame | None:
    return _one(stored, schema, "reversed")


def trigram_postings(stored: DataFrame, schema: CollectionSchema) -> DataFrame | None:
    return _one(stored, schema, "trigrams")


def empty_blocks(stored: DataFrame, schema: CollectionSchema) -> DataFrame | None:
    """field, block: blocks with a list that is there and empty."""
    names = [f.name for f in schema.fields.values() if f.multi]
    if not names:
        return None
    empty = F.filter(F.array(*(F.when(F.size(F.col(f"`{n}`")) == 0, F.lit(n)) for n in names)), lambda x: x.isNotNull())
    return stored.select(F.explode(empty).alias("field"), BLOCK).distinct()


def selectivity(table: DataFrame, blocks: int) -> DataFrame:
    """field, mean_postings, share: how much of the collection a value's blocks are on average."""
    return table.groupBy("field").agg(F.avg(F.size("blocks")).alias("mean_postings")).withColumn("share", F.col("mean_postings") / max(1, blocks))
