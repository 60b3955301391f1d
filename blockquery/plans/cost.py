"""Estimates of sizes and of what a filter reads, before anything is built."""

from __future__ import annotations

import math
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import trigrams
from ..operators.blocks import record_bytes
from ..schema import CollectionSchema

MIB = 1 << 20


def block_count(total_bytes: int, block_bytes: int) -> int:
    return max(1, math.ceil(total_bytes / block_bytes))


def recommended_block_bytes(p95_record_bytes: int, least: int = MIB // 2, usual: int = 2 * MIB, most: int = 8 * MIB) -> int:
    return min(max(max(usual, p95_record_bytes), least), most)


def nearest_rank(values: list[int], share: float) -> int:
    ordered = sorted(values)
    return ordered[max(0, math.ceil(share * len(ordered)) - 1)] if ordered else 0


def postings_count(occurrences: list[int], blocks: int) -> int:
    """Entries of an index: a value is in no more blocks than it has records."""
    return sum(min(n, blocks) for n in occurrences)


def index_bytes(cardinality: int, mean_value_bytes: float, postings: int) -> float:
    return cardinality * mean_value_bytes + 2 * postings


def trigram_bytes(lengths: list[int], distinct_grams: int, blocks: int) -> int:
    return 2 * min(sum(max(n - 2, 0) for n in lengths), distinct_grams * blocks)


def equality_cost(records: int, cardinality: int, blocks: int, block_bytes: int, chunk_bytes: int = 45_000) -> tuple[int, int]:
    """Bytes and requests of an equality filter through an index."""
    found = min(max(math.ceil((records / max(cardinality, 1)) / max(records / blocks, 1e-9)), 1), blocks)
    return chunk_bytes + found * block_bytes, 1 + found


def range_blocks(blocks: int, share: float = 0.1) -> int:
    return math.ceil(share * blocks)


def scatter(bins_by_value: dict[object, tuple[int, int]]) -> float:
    """Mean number of bins of a value, weighted by its records: value to (records, bins)."""
    total = sum(n for n, _ in bins_by_value.values())
    return sum(n * b for n, b in bins_by_value.values()) / total if total else 0.0


def metadata_bytes(blocks: int, bounded: int, postings: int) -> int:
    """Of the tables beside the blocks: counts and bounds of the sort field, bounds of other fields, and entries of indexes."""
    return 48 * blocks + 40 * bounded * blocks + 2 * postings


def estimate(records: DataFrame, schema: CollectionSchema, block_bytes: int) -> dict[str, Any]:
    """What a build of these records would make, and what an equality filter on each indexed field would read. Nothing is written."""
    sized = records.select(record_bytes(records).alias("n"))
    n, total, p95, largest = sized.selectExpr("count(*)", "coalesce(sum(n), 0)", "coalesce(percentile_disc(0.95) WITHIN GROUP (ORDER BY n), 0)", "coalesce(max(n), 0)").first()
    blocks, fields, entries, bounded = block_count(int(total), block_bytes), {}, 0, 0
    own = [f for f in schema.fields.values() if f.indexed and not schema.is_sort(f.name) and f.name in records.columns]
    if own:
        # a scan for all fields: (field, value) pairs, and for contains indexes (field, gram)
        array = lambda f: F.col(f"`{f.name}`") if f.multi else F.array(F.col(f"`{f.name}`").cast("string"))
        pair = lambda f, kind, v: F.struct(F.lit(f.name).alias("field"), F.lit(kind).alias("kind"), v.alias("v"))
        values = [F.transform(array(f), lambda v: pair(f, "value", v)) for f in own]  # noqa: B023
        grams = [F.transform(F.flatten(F.transform(array(f), trigrams)), lambda v: pair(f, "gram", v)) for f in own if f.contains]  # noqa: B023
        none = F.array().cast("array<struct<field:string,kind:string,v:string>>")
        pairs = records.select(F.explode(F.concat(*(F.coalesce(x, none) for x in values + grams))).alias("p")).select("p.*").where("v IS NOT NULL")
        per = pairs.groupBy("field", "kind", "v").agg(F.count("*").alias("k"))
        sums = per.groupBy("field", "kind").agg(F.count("*").alias("n"), F.sum("k").alias("k"), F.sum(F.least("k", F.lit(blocks))).alias("postings"), F.avg(F.octet_length("v")).alias("mean"))
        found = {(r["field"], r["kind"]): r for r in sums.collect()}  # two rows for each field
    for f in own:
        bounded += 1
        r = found.get((f.name, "value"))
        card, postings, mean = (r["n"], r["postings"], r["mean"]) if r else (0, 0, 0.0)
        one = {"cardinality": card, "postings": postings, "index_bytes": round(index_bytes(card, mean, postings))}
        if f.ends_with:
            one["reversed_bytes"] = one["index_bytes"]
        if f.contains:
            g = found.get((f.name, "gram"))
            one["trigram_bytes"] = 2 * min(g["k"], g["n"] * blocks) if g else 0
        one["equality_bytes"], one["equality_requests"] = equality_cost(n, card, blocks, block_bytes)
        fields[f.name], entries = one, entries + postings
    return {"records": n, "bytes": int(total), "blocks": blocks, "p95_record_bytes": p95, "largest_record_bytes": largest, "recommended_block_bytes": recommended_block_bytes(p95), "range_blocks": range_blocks(blocks), "metadata_bytes": metadata_bytes(blocks, bounded, entries), "fields": fields}
