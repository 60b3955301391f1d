"""Readers of records. Null and a missing key are different facts: where a format tells them apart, `_keys` lists the keys a record has."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import EngineError
from ..functions.normalize import numeric
from ..plans.where import KEYS, REST
from ..schema import CollectionSchema, Field


def expand(spark: SparkSession, pattern: str) -> list[str]:
    """Paths of a pattern, in order. Hadoop's own patterns have no `**`: folders of any depth are listed through the path's file system, local or not, and matched here."""
    if "**" not in pattern:
        return [pattern]
    root = pattern[: pattern.index("**")].rsplit("/", 1)[0] or "/"
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    found, wanted = [], _matcher(base.toUri().getPath().rstrip("/") + pattern[len(root.rstrip("/")) :])
    if fs.exists(base):
        files = fs.listFiles(base, True)
        while files.hasNext():
            path = files.next().getPath()
            if wanted.fullmatch(path.toUri().getPath()):
                found.append(path.toString())
    if not found:
        raise EngineError("CONFIG", "no file matches the input pattern")
    return sorted(found)


def _matcher(pattern: str) -> re.Pattern:
    """`**/` is any depth of folders, `*` and `?` stay inside one, `{a,b}` is either."""
    out, i, depth = "", 0, 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            ch = pattern[i]
            depth += (ch == "{") - (ch == "}" and depth > 0)
            out += {"*": "[^/]*", "?": "[^/]", "{": "(?:", "}": ")"}.get(ch, "|" if ch == "," and depth else re.escape(ch))
            i += 1
    return re.compile(out)


def _read(spark: SparkSession, load, pattern: str) -> DataFrame:
    from pyspark.errors import AnalysisException

    try:
        return load(expand(spark, pattern))
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise EngineError("CONFIG", "no file matches the input pattern") from None
        raise


def ndjson_lines(spark: SparkSession, pattern: str) -> DataFrame:
    """The column `value`: a record's JSON; blank lines are none."""
    return _read(spark, spark.read.text, pattern).select(F.trim("value").alias("value")).where("value != ''")


def json_lines(spark: SparkSession, pattern: str, records: str | None = None) -> DataFrame:
    """Records of whole JSON documents: an array's elements or an object's values, at the dotted path `records`. A document is the unit that one task parses."""
    whole = _read(spark, lambda paths: spark.read.text(paths, wholetext=True), pattern)
    path = "$" + "".join(f"['{p}']" for p in records.split(".")) if records else "$"
    at = F.try_variant_get(F.parse_json("value"), path, "variant")
    kind = F.schema_of_variant(at)
    fault = F.raise_error(F.lit("CORRUPT_DATA: the record selector does not lead to an array or object"))
    checked = whole.select(F.when(at.isNull() | ~kind.rlike("^(ARRAY|OBJECT)"), fault).otherwise(at).alias("v"))
    checked.createOrReplaceTempView("_bq_documents")
    return spark.sql("SELECT to_json(e.value) AS value FROM _bq_documents, LATERAL variant_explode(v) AS e")


def _extract(f: Field, v: Column) -> Column:
    path = "$['" + f.name.replace("'", "\\'") + "']"
    if f.kind == "json":
        return F.to_json(F.variant_get(v, path, "variant"))
    kind = "array<string>" if f.multi else {"number": "double", "boolean": "boolean"}.get(f.kind, "string")
    return F.try_variant_get(v, path, kind)


def from_lines(lines: DataFrame, schema: CollectionSchema, keep_line: bool = False) -> DataFrame:
    """Typed columns of JSON records, the keys they have, and a `_bad` array of fields whose value is not of the kind."""
    parsed = lines.withColumn("_v", F.parse_json("value"))
    own = [f for f in schema.fields.values() if f.derive_from is None]
    columns = [_extract(f, F.col("_v")).alias(f.name) for f in own]
    keys = F.json_object_keys("value").alias(KEYS)
    bad = F.filter(F.array(*(F.when(_is_bad(f, F.col("_v")), F.lit(f.name)) for f in own)), lambda x: x.isNotNull()).alias("_bad")
    return parsed.select(*columns, _rest_of_json(schema), keys, bad, *([F.col("value").alias("_line")] if keep_line else []))


def _rest_of_json(schema: CollectionSchema) -> Column:
    """Keys that the schema does not declare, carried as one JSON object; null where there are none."""
    rest = F.map_filter(F.from_json("value", "map<string,variant>"), lambda k, v: ~k.isin(*schema.fields))
    return F.when(F.size(rest) > 0, F.to_json(rest)).alias(REST)


def _is_bad(f: Field, v: Column) -> Column:
    """Whether a value that is there and not null is of another kind."""
    if f.kind == "json":
        return F.lit(False)
    path = "$['" + f.name.replace("'", "\\'") + "']"
    kind = F.schema_of_variant(F.variant_get(v, path, "variant"))
    if f.multi:
        right = kind.isin("ARRAY<STRING>", "ARRAY<VOID>") | (kind == "ARRAY<>")
    else:
        right = {"boolean": kind == "BOOLEAN", "number": kind.rlike("^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)")}.get(f.kind, kind == "STRING")
    return kind.isNotNull() & (kind != "VOID") & ~right


def read_csv(spark: SparkSession, pattern: str, schema: CollectionSchema, delimiter: str = ",") -> DataFrame:
    """Records of delimited text with a header. An empty cell is a missing key; a number must be finite, a boolean true or false; a list has no form in a cell."""
    options = {"header": True, "sep": delimiter, "quote": '"', "escape": '"', "multiLine": True, "mode": "FAILFAST"}
    raw = _read(spark, lambda paths: spark.read.options(**options).csv(paths), pattern)
    own = [f for f in schema.fields.values() if f.derive_from is None]
    columns, bad = [], []
    for f in own:
        cell = F.nullif(F.col(f"`{f.name}`"), F.lit("")) if f.name in raw.columns else F.lit(None).cast("string")
        # a number is what the numeric normalizer takes: decimal, hexadecimal, octal or binary, and finite
        value = {"number": numeric(cell), "boolean": F.when(cell == "true", True).when(cell == "false", False)}.get(f.kind, cell)
        if f.kind in ("number", "boolean"):
            value = F.when(cell.isNotNull() & value.isNull(), F.raise_error(F.lit(f"CORRUPT_DATA: a cell of {f.name} is no {f.kind}")).cast(f.spark_type())).otherwise(value)
        if f.multi:  # a cell holds one text: delimited files have no lists
            value = F.when(cell.isNotNull(), F.raise_error(F.lit(f"CORRUPT_DATA: a cell of {f.name} is no list")).cast("array<string>"))
        columns.append(value.alias(f.name))
        bad.append(F.when(cell.isNotNull(), F.lit(f.name)))
    keys = F.filter(F.array(*bad), lambda x: x.isNotNull()).alias(KEYS)
    more = [c for c in raw.columns if c not in schema.fields]
    rest = F.nullif(F.to_json(F.struct(*(F.col(f"`{c}`") for c in more))), F.lit("{}")) if more else F.lit(None).cast("string")
    return raw.select(*columns, rest.alias(REST), keys, F.array().cast("array<string>").alias("_bad"))


def read_records(spark: SparkSession, pattern: str, form: str, schema: CollectionSchema, records: str | None = None, delimiter: str | None = None) -> DataFrame:
    if form == "ndjson":
        return from_lines(ndjson_lines(spark, pattern), schema)
    if form == "json":
        return from_lines(json_lines(spark, pattern, records), schema)
    if form in ("csv", "tsv"):
        return read_csv(spark, pattern, schema, delimiter or ("\t" if form == "tsv" else ","))
    return _read(spark, lambda paths: spark.read.parquet(*paths), pattern)


def head(lines: DataFrame, n: int) -> DataFrame:
    """The first records only: Spark stops reading once it has them."""
    return lines.limit(n)


def count_records(lines: DataFrame) -> DataFrame:
    """How many records, and their bytes: no parsing."""
    return lines.agg(F.count("*").alias("records"), F.coalesce(F.sum(F.octet_length("value")), F.lit(0)).alias("bytes"))


def empty(spark: SparkSession, schema: CollectionSchema) -> DataFrame:
    return spark.createDataFrame([], T.StructType([T.StructField(n, f.spark_type()) for n, f in schema.fields.items()]))
