"""Sorting records and cutting them into blocks that do not overlap in the sort field."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import EngineError
from ..plans.where import KEYS, REST
from ..schema import CollectionSchema

BLOCK = "_block"
#: Names that the engine adds to records; REST is part of a record all the same.
INTERNAL = (BLOCK, KEYS, "_bad", "_line")
HIDDEN = (*INTERNAL, REST)
#: Tasks that list folders of blocks.
LISTERS = 64


def work_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share; where unset, under the working directory, in local mode only."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise EngineError("CONFIG", "set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + os.path.abspath("spark-warehouse/checkpoints")
    return f"{base.rstrip('/')}/bq-{uuid.uuid4().hex[:12]}"


@contextmanager
def listing(spark: SparkSession):
    """Folders of blocks are listed by a few tasks; Spark's own default is one for each folder."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    spark.conf.set(name, min(int(before), LISTERS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def record_bytes(df: DataFrame) -> Column:
    """Bytes of a record as a line of JSON."""
    return F.octet_length(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns if c not in INTERNAL)))) + 1


def stored_order(df: DataFrame, schema: CollectionSchema) -> list[Column]:
    """Sort field ascending, then nulls, then absent keys; then the primary key; then the record itself, so that the order is total."""
    order = [F.col(f"`{schema.sort_field}`").asc_nulls_last()]
    if KEYS in df.columns:
        order.append((~F.array_contains(F.col(KEYS), schema.sort_field)).asc())
    if schema.pk is not None and schema.pk != schema.sort_field:
        order.append(F.col(f"`{schema.pk}`").asc_nulls_last())
    return order


#: Up to so many blocks each is a range partition, and a task, of its own; of more, a partition of RANGE_BYTES holds several.
RANGES, RANGE_BYTES = 200, 64 << 20


def cut_blocks(df: DataFrame, schema: CollectionSchema, block_bytes: int) -> DataFrame:
    """Records with their block, sorted inside it.

    One range exchange does it all: as many range partitions as the bytes fill blocks, and each partition is a block.
    Equal sort values share a partition, so no run is split and blocks do not overlap. Sizes are near the target as far as
    the exchange's sample goes; a value with more records than a block holds makes a large one. Small blocks of a large
    collection would make the exchange's pieces, its sample and the tasks too many: then partitions are larger, and cut
    into blocks by places inside them, at the first record of a run. Block numbers have gaps between partitions.
    """
    total, records = df.agg(F.coalesce(F.sum(record_bytes(df)), F.lit(0)), F.count("*")).first()
    blocks = max(1, -(-int(total) // block_bytes))
    ranges = min(blocks, max(RANGES, -(-int(total) // RANGE_BYTES)))
    order = stored_order(df, schema)
    # the exchange sees the sort value and the missing marks only: ties must not be split
    by = order[: 2 if KEYS in df.columns else 1]
    line = F.xxhash64(*(F.col(f"`{c}`") for c in df.columns if c not in INTERNAL))
    if ranges == blocks:
        ranged = df.repartitionByRange(blocks, *by).withColumn(BLOCK, F.spark_partition_id())
        return ranged.sortWithinPartitions(BLOCK, *order, line)
    # as columns, so that exchange, sort and window agree on what a run is and no row moves twice
    s = F.col(f"`{schema.sort_field}`")
    run = {"_none": s.isNull()} | ({"_absent": ~F.array_contains(F.col(KEYS), schema.sort_field)} if KEYS in df.columns else {})
    keys = [*map(F.col, run), s]
    placed = df.withColumns(run).repartitionByRange(ranges, *keys).sortWithinPartitions(*keys)
    # a row's number in its partition, below the 33 bits that hold it
    placed = placed.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    first = F.min("_row").over(Window.partitionBy(*keys))
    most = min(blocks + 1, ((1 << 31) - 1) // ranges)
    inside = F.least(F.floor(first * blocks / max(1, records)), F.lit(most - 1))
    return placed.withColumn(BLOCK, (F.col("_part") * most + inside).cast("int")).drop(*run, "_part", "_row").sortWithinPartitions(BLOCK, *order, line)


def exact_cut(df: DataFrame, by: str, weight: Column, target: int, path: str) -> DataFrame:
    """df with `_block` = (weight of all smaller values of `by`) div target: equal values share a block, whatever the partitioning.

    Range partitions are written to `path` with their number, so that the sums before each (a row for each partition) and
    the running sums inside them speak of the same rows, also when a task runs again. No window spans the whole data.
    """
    spark, key = df.sparkSession, F.col(f"`{by}`")
    ranged = df.withColumn("_weight", weight.cast("long")).repartitionByRange(key).withColumn("_part", F.spark_partition_id())
    ranged.write.mode("overwrite").parquet(path)
    parts = spark.read.schema(ranged.schema).parquet(path)
    rows, base, offsets = parts.groupBy("_part").agg(F.sum("_weight").alias("w"), F.min(key).alias("_key")).orderBy("_part").collect(), 0, []
    for r in rows:
        offsets.append((r["_part"], base))
        base += r["w"]
    upto, run = Window.partitionBy("_part").orderBy(key), Window.partitionBy("_part", key)
    before = F.sum("_weight").over(upto) - F.sum("_weight").over(run)
    # a row for each range partition
    joined = parts.withColumn("_before", before).join(F.broadcast(spark.createDataFrame(offsets, "_part int, _base bigint")), "_part")
    return joined.withColumn(BLOCK, ((F.col("_base") + F.col("_before")) / target).cast("int")).drop("_weight", "_part", "_base", "_before")


def places(df: DataFrame, order: list[Column], path: str) -> tuple[DataFrame, int]:
    """df with `_place`, from 0, in this order, and how many records there are. Range partitions are written and counted as in exact_cut."""
    spark = df.sparkSession
    ranged = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    ranged.write.mode("overwrite").parquet(path)
    parts = spark.read.schema(ranged.schema).parquet(path)
    offsets, n = [], 0
    for r in parts.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect():
        offsets.append((r["_part"], n))
        n += r["n"]
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    # a row for each range partition
    joined = parts.withColumn("_place", inside).join(F.broadcast(spark.createDataFrame(offsets, "_part int, _base bigint")), "_part")
    return joined.withColumn("_place", F.col("_base") + F.col("_place")).drop("_part", "_base"), n


def greedy_cut(records: Iterable[tuple[object, int]], target: int) -> list[int]:
    """Block numbers of sorted (key, bytes) by closing a block once it would pass the target at a new key: exact, for small data and tests."""
    out, block, size, last = [], 0, 0, object()
    for key, n in records:
        if size and size + n > target and key != last:
            block, size = block + 1, 0
        size += n
        last = key
        out.append(block)
    return out


def content_hash_of(lines: Column) -> Column:
    """A hash of a set of records that does not depend on their order: the sum of 60 bits of each line's MD5."""
    return F.sum(F.conv(F.substring(F.md5(lines.cast("binary")), 1, 15), 16, 10).cast("decimal(38,0)"))


def block_aggregates(stored: DataFrame, schema: CollectionSchema) -> list[Column]:
    """count, bytes, largest record, bounds of the sort field over real values, its distinct values, nulls and absent keys, and a hash of the content."""
    s = F.col(f"`{schema.sort_field}`")
    absent = ~F.array_contains(F.col(KEYS), schema.sort_field) if KEYS in stored.columns else F.lit(False)
    line = F.to_json(F.struct(*(F.col(f"`{c}`") for c in stored.columns if c not in INTERNAL)))
    size = F.octet_length(line) + 1
    return [
        F.count("*").alias("count"),
        F.sum(size).alias("bytes"),
        F.max(size).alias("largest"),
        F.min(s).alias("lo"),
        F.max(s).alias("hi"),
        # equal values share a block, so these add up to the collection's; no set is larger than a block
        F.size(F.collect_set(s)).alias("values"),
        F.sum((s.isNull() & ~absent).cast("long")).alias("n_null"),
        F.sum(absent.cast("long")).alias("n_absent"),
        content_hash_of(line).cast("string").alias("hash"),
    ]


def block_table(stored: DataFrame, schema: CollectionSchema) -> DataFrame:
    """A row for each block, as block_aggregates says."""
    return stored.groupBy(BLOCK).agg(*block_aggregates(stored, schema))
