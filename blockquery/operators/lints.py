"""What deserves a warning about data or indexes, from statistics that the build has anyway."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import CollectionSchema
from .indexes import selectivity
from .infer import SHAPE_SHARE, URL, UUID, WEAK_SHARE, Stats

LONG_RUN, SKEW, FEW_BLOCKS = 20, 2.0, 8


def low_cardinality_sort(records: int, distinct: int, name: str) -> str | None:
    if distinct and records / distinct > LONG_RUN:
        return f"{name}: {records / distinct:.1f} records share a sort value on average; filters on it read whole runs"
    return None


def weak_indexes(shares: dict[str, float], blocks: int, what: str = "index") -> list[str]:
    """Indexes whose values are in too many blocks; too few blocks say nothing."""
    if blocks < FEW_BLOCKS:
        return []
    return [f"{name}: a value of its {what} is in {share:.0%} of the blocks on average, so it hardly narrows" for name, share in sorted(shares.items()) if share > WEAK_SHARE]


def unsuitable_text_indexes(schema: CollectionSchema, stats: dict[str, Stats]) -> list[str]:
    return [f"{n}: its values are {stats[n].shape}s; a text index of these is large and rarely asked" for n, f in schema.fields.items() if (f.ends_with or f.contains) and n in stats and stats[n].shape]


def oversized_record(largest: int, block_bytes: int) -> str | None:
    return f"a record of {largest} bytes is larger than a block" if largest > block_bytes else None


def skewed_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks of more than twice the mean of bytes."""
    mean = blocks.agg(F.avg("bytes").alias("mean"))  # one row
    return blocks.join(F.broadcast(mean)).where(F.col("bytes") > SKEW * F.col("mean")).drop("mean")


def contains_larger_than_column(index_bytes: dict[str, int], column_bytes: dict[str, int]) -> list[str]:
    return [f"{n}: its contains index ({b} bytes) is larger than the column" for n, b in sorted(index_bytes.items()) if b > column_bytes.get(n, b)]


def over_budget(manifest_bytes: int, budget: int = 1_000_000) -> str | None:
    return f"the manifest has {manifest_bytes} bytes, over {budget}" if manifest_bytes > budget else None


def shared_values(schema: CollectionSchema) -> list[tuple[str, ...]]:
    """Fields with equal sets of values that could share a named type."""
    by: dict[frozenset, list[str]] = {}
    for n, f in schema.fields.items():
        if f.values and f.values_type is None:
            by.setdefault(frozenset(f.values), []).append(n)
    return [tuple(sorted(names)) for names in by.values() if len(names) > 1]


def text_shapes(stored: DataFrame, names: list[str]) -> dict[str, Stats]:
    """What text-indexed fields look like, for unsuitable_text_indexes; and their bytes."""
    if not names:
        return {}
    aggs = [x for i, c in enumerate(names) for x in (F.count(F.col(f"`{c}`")).alias(f"n{i}"), F.coalesce(F.sum(F.octet_length(F.col(f"`{c}`"))), F.lit(0)).alias(f"b{i}"), *(F.sum(F.col(f"`{c}`").rlike(p).cast("long")).alias(f"{s}{i}") for s, p in (("url", URL), ("uuid", UUID))))]
    row = stored.agg(*aggs).first()
    shape = lambda i: next((s for s in ("url", "uuid") if row[f"n{i}"] and row[f"{s}{i}"] >= SHAPE_SHARE * row[f"n{i}"]), None)
    return {c: Stats(c, "string", row[f"n{i}"], row[f"n{i}"], 0, 0, shape=shape(i), bytes=row[f"b{i}"]) for i, c in enumerate(names)}


def collection_warnings(collection, stats: dict[str, Stats] | None = None, block_bytes: int | None = None, manifest_bytes: int | None = None) -> list[str]:
    """All warnings about a built collection, from its metadata; one aggregate over text-indexed columns for what that does not hold."""
    schema, meta, n = collection.schema, collection.metadata, collection.manifest["blocks"]
    block_bytes = block_bytes or collection.manifest["block_bytes"]
    shapes = text_shapes(collection.stored(), [name for name, f in schema.fields.items() if (f.contains or f.ends_with) and not f.multi])
    out = [low_cardinality_sort(collection.manifest["records"], collection.manifest["values"], schema.sort_field)]
    for table, what in ((meta.postings, "index"), (meta.reversed, "endsWith index"), (meta.trigrams, "contains index")):
        if table is not None:
            out += weak_indexes({r["field"]: r["share"] for r in selectivity(table, n).collect()}, n, what)  # a row for each field
    if meta.trigrams is not None:
        # a gram's text, and two bytes for each block it is in
        sized = meta.trigrams.groupBy("field").agg(F.sum(F.octet_length("value") + 2 * F.size("blocks")).alias("n")).collect()
        out += contains_larger_than_column({r["field"]: r["n"] for r in sized}, {c: s.bytes for c, s in shapes.items()})
    skewed = skewed_blocks(meta.blocks).count()
    out.append(f"{skewed} blocks have more than {SKEW:g} times the mean of bytes" if skewed else None)
    out.append(oversized_record(collection.manifest["largest"], block_bytes))
    out.append(over_budget(manifest_bytes) if manifest_bytes is not None else None)
    out += unsuitable_text_indexes(schema, shapes | (stats or {}))
    out += [f"{', '.join(names)} have the same values and could share a named type" for names in shared_values(schema)]
    return [w for w in out if w]
