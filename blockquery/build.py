"""Building a collection: read, derive, check, sort, cut, index, write beside the old one and swap."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import EngineError
from .operators import indexes
from .operators.blocks import BLOCK, block_aggregates, cut_blocks, listing
from .operators.derive import derive
from .operators.drift import check_drift
from .plans.where import KEYS
from .schema import BLOCK_BYTES, COMPRESSIONS, FORMAT_VERSION, CollectionSchema, Config, validate
from .sources.readers import read_records

def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        raise EngineError("CONFIG", "there is no collection at this path")
    stream = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def _rename(fs, source, to) -> None:
    if not fs.rename(source, to):
        raise EngineError("DEPLOY_INTEGRITY", f"{source} could not be renamed")


def swap(spark: SparkSession, staged: str, path: str) -> None:
    """Puts a finished tree in the place of the old one; until then the old one serves, and is back if that fails."""
    fs, new = _fs(spark, staged)
    _, now = _fs(spark, path)
    _, old = _fs(spark, path.rstrip("/") + "__old")
    if fs.exists(now):
        fs.delete(old, True)
        _rename(fs, now, old)
    fs.mkdirs(now.getParent())
    try:
        _rename(fs, new, now)
    except Exception:
        if fs.exists(old) and not fs.exists(now):
            fs.rename(old, now)
        raise
    fs.delete(old, True)


def recover(spark: SparkSession, path: str) -> bool:
    """Puts the old collection back where a swap was cut short between its two renames."""
    fs, now = _fs(spark, path)
    _, old = _fs(spark, path.rstrip("/") + "__old")
    return bool(not fs.exists(now) and fs.exists(old) and fs.rename(old, now))


def build(records: DataFrame, schema: CollectionSchema, path: str, block_bytes: int = BLOCK_BYTES, compression: str = "zstd", name: str = "records", checked: bool = True) -> dict:
    """Writes the collection of records (columns by field name; other columns are carried) and returns its manifest.

    Text is parsed once: parsed and derived records are written beside the collection, and checks, sizes, cuts and the sorted
    blocks come from there. Two scans of the blocks give all tables beside them.
    """
    spark = records.sparkSession
    schema = validate(schema)
    staged = path.rstrip("/") + "__staged"
    fs, p = _fs(spark, staged)
    fs.delete(p, True)
    codec = COMPRESSIONS[compression]
    parsed = derive(records, schema)
    if KEYS in records.columns or any(f.derive_from is not None for f in schema.fields.values()):
        # parsing text and deriving fields is done once; typed columns are as cheap to read again
        parsed.write.option("compression", "lz4").parquet(f"{staged}/parsed")
        parsed = spark.read.schema(parsed.schema).parquet(f"{staged}/parsed")
    if checked:
        check_drift(parsed, schema)
    derived = parsed.drop("_bad")
    cut_blocks(derived, schema, block_bytes).write.option("compression", codec).partitionBy(BLOCK).parquet(f"{staged}/blocks")
    fs.delete(_fs(spark, f"{staged}/parsed")[1], True)
    with listing(spark):
        stored = spark.read.schema(T.StructType([*derived.schema, T.StructField(BLOCK, T.IntegerType())])).parquet(f"{staged}/blocks")
    fields, written = indexes.indexed(schema), {}

    def write(df: DataFrame | None, table: str) -> None:
        if df is not None:
            df.write.option("compression", codec).parquet(f"{staged}/meta/{table}")
            written[table] = json.loads(df.schema.json())

    own = block_aggregates(stored, schema)
    wide = stored.groupBy(BLOCK).agg(*own, *indexes.zonemap_aggregates(fields))
    wide.write.parquet(f"{staged}/wide")
    wide = spark.read.schema(wide.schema).parquet(f"{staged}/wide")
    write(wide.select(*(c for c in wide.columns if not c.startswith(("_lo", "_hi")))).coalesce(1), "blocks")
    if fields:
        zones = indexes.zonemap_of(wide, fields)
        write(zones.repartition("field").sortWithinPartitions("field", BLOCK), "zonemap")
    found = indexes.text_indexes(stored, schema)
    if found is not None:
        # sorted, so that footers narrow a lookup to a few row groups
        order = ["table", "field", "value"]
        found.repartitionByRange(*order).sortWithinPartitions(*order).write.option("compression", codec).partitionBy("table").parquet(f"{staged}/meta/index")
        written |= {t: json.loads(found.select("field", "value", "blocks").schema.json()) for t in indexes.tables_of(schema)}
    empty = indexes.empty_blocks(stored, schema)
    write(None if empty is None else empty.coalesce(1), "empty_blocks")
    blocks = spark.read.schema(wide.schema).parquet(f"{staged}/wide")
    totals = blocks.selectExpr("coalesce(sum(count), 0) AS records", "count(*) AS blocks", "coalesce(sum(bytes), 0) AS bytes", "coalesce(max(largest), 0) AS largest", "coalesce(sum(values), 0) AS values").first()
    # named by content: who has an old manifest finds files gone, unless the blocks are the same
    content = blocks.select(F.sha2(F.concat_ws(" ", F.lit(json.dumps(schema.to_json(), sort_keys=True)), F.sum(F.conv(F.substring(F.md5(F.concat_ws(" ", BLOCK, "hash").cast("binary")), 1, 15), 16, 10).cast("decimal(38,0)")).cast("string"), F.count("*")), 256)).first()[0]
    data = f"blocks-{content[:16]}"
    _rename(fs, _fs(spark, f"{staged}/blocks")[1], _fs(spark, f"{staged}/{data}")[1])
    fs.delete(_fs(spark, f"{staged}/wide")[1], True)
    manifest = {"format_version": FORMAT_VERSION, "dataset": name, "records": totals["records"], "blocks": totals["blocks"], "bytes": totals["bytes"], "largest": totals["largest"], "values": totals["values"], "block_bytes": block_bytes, "tables": sorted(written), "table_columns": written, "without_rows": [t for t in indexes.TEXT_TABLES if t in written and not fs.exists(_fs(spark, f"{staged}/meta/index/table={t}")[1])], "data": data, "schema": schema.to_json(), "columns": json.loads(stored.schema.json())}
    write_text(spark, f"{staged}/manifest.json", json.dumps(manifest))
    swap(spark, staged, path)
    return manifest


def build_from_config(spark: SparkSession, config: Config) -> dict:
    records = read_records(spark, config.input, config.format, config.schema, config.records, config.delimiter)
    return build(records, config.schema, config.output, config.block_bytes, config.compression, config.name)
