"""Queries of what lies around a search: sources and sinks, builds, checks, advice and the client's rules, each with its SQL."""

from __future__ import annotations

import contextlib
import io
import json
import os
import tempfile
import threading
import time
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import __main__ as cli
from .build import build
from .client import connect
from .codegen import record_module
from .errors import DriftError, EngineError
from .functions.normalize import normalize
from .operators import infer, lints
from .operators.blocks import BLOCK, content_hash_of
from .operators.drift import check_drift
from .operators.indexes import postings, selectivity, trigram_postings
from .operators.sampling import SEED, sample, seeded_hash
from .plans import cost
from .plans.where import where_prunes
from .queries import CUSTOMERS, LINES, LISTS, ORDERS, PARTS, ROWS, SQL_LINES, SQL_NO_VIEW, SQL_PARTS, SQL_RANKED, collection, labelled, lines, query, ranked, register_built, table, work_dir
from .schema import CollectionSchema, Field, resolve
from .sources.readers import count_records, from_lines, head, ndjson_lines, read_records


def _values(columns: str, rows: list[tuple]) -> str:
    """SQL of a constant table: what a rule says, whatever the data."""
    quoted = lambda v: "NULL" if v is None else ("TRUE" if v else "FALSE") if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(quoted, r)) + ')' for r in rows)}) t({columns})"


def _code(run) -> str:
    """The code of an engine error, or the name of another one; 'ok' where there is none."""
    try:
        run()
    except EngineError as e:
        return e.code
    except ValueError as e:
        return type(e).__name__
    return "ok"


# --- sources -------------------------------------------------------------------------------------


def _of_line(columns: DataFrame) -> DataFrame:
    return columns.select(F.col("id").cast("bigint").alias("id"), "a", "n", F.array_join("l", ",").alias("l"))


_SQL_OF_LINE = f"SELECT event_id AS id, json_extract_string(line, '$.a') AS a, CAST(json_extract_string(line, '$.n') AS DOUBLE) AS n, CASE WHEN list_contains(json_keys(line), 'l') THEN array_to_string(CAST(json_extract(line, '$.l') AS VARCHAR[]), ',') END AS l FROM {SQL_LINES}"


@query("scan_ndjson", _SQL_OF_LINE)
def scan_ndjson(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{work_dir(spark)}/ndjson"
    lines(spark, sf_dir).write.text(path)
    return _of_line(read_records(spark, path, "ndjson", LINES))


def _documents(spark: SparkSession, sf_dir: str, head_: str, tail: str) -> str:
    """Eight JSON documents, a file each, that hold all lines as an array."""
    path = f"{work_dir(spark)}/json"
    part = (F.get_json_object("value", "$.id").cast("bigint") % 8).alias("doc")
    whole = F.concat(F.lit(head_ + "["), F.array_join(F.sort_array(F.collect_list("value")), ",\n"), F.lit("]" + tail)).alias("value")
    lines(spark, sf_dir).select(part, "value").groupBy("doc").agg(whole).write.partitionBy("doc").text(path)
    return f"{path}/doc=*/*"


@query("scan_json", _SQL_OF_LINE)
def scan_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of_line(read_records(spark, _documents(spark, sf_dir, "", ""), "json", LINES))


@query("scan_json_selector", _SQL_OF_LINE)
def scan_json_selector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of_line(read_records(spark, _documents(spark, sf_dir, '{"about": {"of": 1}, "data": {"rows": ', "}}"), "json", LINES, "data.rows"))


def _delimited(spark: SparkSession, df: DataFrame, form: str) -> DataFrame:
    path = f"{work_dir(spark)}/{form}"
    df.write.options(header=True, sep="\t" if form == "tsv" else ",", quote='"', escape='"').csv(path)
    return read_records(spark, path, form, PARTS)


_PART_COLUMNS = ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")
_SQL_CELLS = "SELECT CAST(p_partkey AS DOUBLE) AS p_partkey, concat(p_name, ', \"', p_brand, '\"') AS p_name, p_brand, p_type, CAST(p_size AS DOUBLE) AS p_size, p_retailprice FROM part"


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose names hold delimiters and quotes."""
    return table(spark, sf_dir, "part").select(*_PART_COLUMNS).withColumn("p_name", F.concat("p_name", F.lit(', "'), "p_brand", F.lit('"')))


@query("scan_csv", _SQL_CELLS)
def scan_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _delimited(spark, _cells(spark, sf_dir), "csv").select(*_PART_COLUMNS)


@query("scan_tsv", _SQL_CELLS.replace("', \"'", "'\t\"'"))
def scan_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _cells(spark, sf_dir).withColumn("p_name", F.replace("p_name", F.lit(', "'), F.lit('\t"')))
    return _delimited(spark, cells, "tsv").select(*_PART_COLUMNS)


_CELLS = CollectionSchema("id", {"id": Field("id", "number"), "n": Field("n", "number", absent=True), "b": Field("b", "boolean", absent=True), "t": Field("t", "string", absent=True)}, "id")
_CELL_N = "CASE CAST(p_partkey % 6 AS INT) WHEN 0 THEN '0x1F' WHEN 1 THEN concat(' ', p_size, '.5 ') WHEN 2 THEN '' WHEN 3 THEN '-1e3' WHEN 4 THEN '0b101' ELSE '0o17' END"


@query("csv_cells", "SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 31.0 WHEN 1 THEN p_size + 0.5 WHEN 3 THEN -1000.0 WHEN 4 THEN 5.0 WHEN 5 THEN 15.0 END AS n, CASE p_partkey % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS b, CASE WHEN p_partkey % 5 > 0 THEN p_brand END AS t, (p_partkey % 6 = 2) AS n_absent FROM part")
def csv_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells become numbers in any notation, booleans and texts; an empty one is a missing key."""
    path = f"{work_dir(spark)}/cells"
    cells = table(spark, sf_dir, "part").selectExpr("p_partkey AS id", f"{_CELL_N} AS n", "CASE CAST(p_partkey % 3 AS INT) WHEN 0 THEN 'true' WHEN 1 THEN 'false' ELSE '' END AS b", "CASE WHEN p_partkey % 5 > 0 THEN p_brand ELSE '' END AS t")
    cells.write.options(header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    df = read_records(spark, path, "csv", _CELLS)
    return df.select(F.col("id").cast("bigint").alias("id"), "n", "b", "t", (~F.array_contains("_keys", "n")).alias("n_absent"))


def _tree(spark: SparkSession, sf_dir: str) -> str:
    path = f"{work_dir(spark)}/tree"
    key = F.get_json_object("value", "$.id").cast("bigint")
    lines(spark, sf_dir).select("value", (key % 2).alias("x"), (key % 3).alias("y")).write.partitionBy("x", "y").text(path)
    return path


@query("glob_any_depth", "SELECT event_id AS id FROM events")
def glob_any_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ndjson_lines(spark, f"{_tree(spark, sf_dir)}/**/part-*").select(F.get_json_object("value", "$.id").cast("bigint").alias("id"))


@query("glob_union", "SELECT event_id AS id FROM events WHERE event_id % 2 = 1 AND event_id % 3 IN (0, 2)")
def glob_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ndjson_lines(spark, f"{_tree(spark, sf_dir)}/x=1/y={{0,2}}/*").select(F.get_json_object("value", "$.id").cast("bigint").alias("id"))


@query("head_scan", "SELECT least(count(*), 250) AS n, TRUE AS among_all FROM events")
def head_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{work_dir(spark)}/head"
    lines(spark, sf_dir).write.text(path)
    first = head(ndjson_lines(spark, path), 250)
    return first.agg(F.count("*").alias("n"), F.bool_and(F.get_json_object("value", "$.id").isNotNull()).alias("among_all"))


@query("count_scan", f"SELECT count(*) AS records, CAST(sum(strlen(line)) AS BIGINT) AS bytes FROM {SQL_LINES}")
def count_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{work_dir(spark)}/count"
    lines(spark, sf_dir).write.text(path)
    return count_records(ndjson_lines(spark, path))


# --- builds --------------------------------------------------------------------------------------


@query("block_hash", f"SELECT b AS block, CAST(sum(CAST(('0x' || substr(md5(concat(o_orderkey, '|', o_custkey, '|', o_orderstatus)), 1, 15)) AS BIGINT)) AS VARCHAR) AS hash FROM {SQL_RANKED} GROUP BY b")
def block_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat_ws("|", "o_orderkey", "o_custkey", "o_orderstatus")
    return ranked(spark, sf_dir).groupBy(F.col(BLOCK).alias("block")).agg(content_hash_of(line).cast("string").alias("hash"))


@query("content_names", "SELECT TRUE AS same_content_same_name, TRUE AS other_content_other_name, count(*) AS records FROM customer")
def content_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A collection's folder of blocks is named by what is in it and how it is cut (here not at all)."""
    base, df = work_dir(spark), table(spark, sf_dir, "customer")
    one, two, three = (build(d, CUSTOMERS, f"{base}/{i}", block_bytes=1 << 30) for i, d in enumerate((df, df.repartition(3), df.withColumn("c_acctbal", F.col("c_acctbal") + 1))))
    return spark.createDataFrame([(one["data"] == two["data"], one["data"] != three["data"], one["records"])], "same_content_same_name boolean, other_content_other_name boolean, records bigint")


@query("compression_codecs", " UNION ALL ".join(f"SELECT '{c}' AS compression, '{r}' AS result, {'0' if r != 'ok' else '(SELECT count(*) FROM customer)'} AS records" for c, r in (("none", "ok"), ("gzip", "ok"), ("zstd", "ok"), ("snappy", "ok"), ("brotli", "CONFIG"), ("lzma", "CONFIG"))))
def compression_codecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, out = work_dir(spark), []
    for name in ("none", "gzip", "zstd", "snappy", "brotli", "lzma"):
        data = {"compression": name, "schema": {"sortField": "c_name", "fields": {"c_name": {"kind": "string"}}}}
        code = _code(lambda: resolve(data))  # noqa: B023
        n = build(table(spark, sf_dir, "customer").select("c_name"), resolve(data).schema, f"{base}/{name}", 1 << 18, name)["records"] if code == "ok" else 0
        out.append((name, code, n))
    return spark.createDataFrame(out, "compression string, result string, records bigint")


@query("rebuild_is_seen", "SELECT count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS before, count(*) AS after_, 0 AS left_over FROM customer")
def rebuild_is_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A client opened before a rebuild finds its files gone, loads the new manifest and asks again; nothing of the old tree is left."""
    path, df = f"{work_dir(spark)}/swap", table(spark, sf_dir, "customer")
    build(df.where("c_mktsegment = 'BUILDING'"), CUSTOMERS, path, block_bytes=1 << 14)
    old = connect(spark, path)
    # both counts read the records, where they lie
    before = old.count({"c_name": {"gte": ""}}, exact=True).count
    build(df, CUSTOMERS, path, block_bytes=1 << 14)
    after = old.count({"c_name": {"gte": ""}}, exact=True).count
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    left = sum(fs.exists(spark._jvm.org.apache.hadoop.fs.Path(path + tail)) for tail in ("__old", "__staged"))
    return spark.createDataFrame([(before, after, left)], "before bigint, after_ bigint, left_over int")


@query("missing_tail", "SELECT count(*) FILTER (WHERE quality IS NULL) AS n_null, 0 AS n_absent, count(DISTINCT quality) AS vals, count(*) AS records FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def missing_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing sort values are counted by block; values of the sort field add up, as blocks share none."""
    path = f"{work_dir(spark)}/tail"
    by = CollectionSchema("quality", {"doc_id": Field("doc_id", "number"), "quality": Field("quality", "number", nullable=True)})
    build(labelled(spark, sf_dir).select("doc_id", "quality"), by, path, block_bytes=1 << 14)
    c = connect(spark, path)
    return c.metadata.blocks.agg(F.sum("n_null").alias("n_null"), F.sum("n_absent").cast("int").alias("n_absent"), F.sum("values").alias("vals"), F.sum("count").alias("records"))


@query("sort_values", "SELECT count(DISTINCT o_orderdate) AS vals, count(*) AS records FROM orders")
def sort_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = collection(spark, sf_dir, "orders").manifest
    return spark.createDataFrame([(m["values"], m["records"])], "vals bigint, records bigint")


_TYPES = [("o_orderkey", "float"), ("o_custkey", "float"), ("o_orderstatus", "str"), ("o_totalprice", "float"), ("o_orderdate", "str"), ("o_orderpriority", "str")]


@query("generated_types", _values("field, type", _TYPES))
def generated_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The generated module's record type, as Python sees it."""
    space: dict[str, Any] = {}
    exec(compile(record_module(ORDERS, "orders", "/data/orders"), "generated", "exec"), space)  # noqa: S102
    rows = [(n, getattr(t, "__name__", str(t))) for n, t in space["OrdersRecord"].__annotations__.items()]
    return spark.createDataFrame(rows, "field string, type string")


@query("generated_client", "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'P'")
def generated_client(spark: SparkSession, sf_dir: str) -> DataFrame:
    space: dict[str, Any] = {}
    exec(compile(record_module(ORDERS, "orders", collection(spark, sf_dir, "orders").path), "generated", "exec"), space)  # noqa: S102
    return space["connect"](spark).query({"o_orderstatus": {"equals": "P"}}).agg(F.count("*").alias("n"))


def _cli(*argv: str) -> tuple[int, str, str]:
    out, err = io.StringIO(), io.StringIO()
    with contextlib.redirect_stdout(out), contextlib.redirect_stderr(err):
        code = cli.main(list(argv))
    return code, out.getvalue(), err.getvalue()


@query("init_config", _values("field, kind, absent, nullable, multi, indexed", [("id", "number", False, False, False, False), ("a", "string", True, True, False, True), ("n", "number", True, False, False, True), ("l", "string", True, False, True, True)]))
def init_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What `init` writes for a file of lines: kinds, what may be missing, lists and advised indexes."""
    path = f"{work_dir(spark)}/init"
    lines(spark, sf_dir).write.text(path)
    with tempfile.TemporaryDirectory() as own:  # the command's own configuration file
        _cli("init", path, "--config", f"{own}/c.json", "--pk", "id", "--sort-field", "id")
        with open(f"{own}/c.json") as f:
            fields = json.load(f)["schema"]["fields"]
    rows = [(n, f["kind"], *(bool(f.get(k)) for k in ("absent", "nullable", "multi", "indexed"))) for n, f in fields.items()]
    return spark.createDataFrame(rows, "field string, kind string, absent boolean, nullable boolean, multi boolean, indexed boolean")


@query("cli_build_inspect", f"SELECT count(*) AS built, count(*) AS inspected, 0 AS code, count(*) FILTER (WHERE NOT list_contains(json_keys(line), 'a')) AS absent FROM {SQL_LINES}")
def cli_build_inspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = work_dir(spark)
    lines(spark, sf_dir).write.text(f"{base}/in")
    with tempfile.TemporaryDirectory() as own:
        config = {"input": f"{base}/in", "output": f"{base}/out", "blockBytes": 1 << 18, "schema": {"sortField": "a", "pk": "id", "fields": {"id": {"kind": "number", "indexed": True}, "a": {"kind": "string", "absent": True, "nullable": True}, "n": {"kind": "number", "absent": True}, "l": {"kind": "string", "multi": True, "indexed": True, "absent": True}}}}
        with open(os.path.join(own, "c.json"), "w") as f:
            json.dump(config, f)
        code, built, _ = _cli("build", f"{own}/c.json")
    _, seen, _ = _cli("inspect", f"{base}/out")
    report = json.loads(seen)
    return spark.createDataFrame([(json.loads(built)["records"], report["records"], code, report["missing"]["absent"])], "built bigint, inspected bigint, code int, absent bigint")


# --- checks and advice ---------------------------------------------------------------------------


@query("drift_error", f"SELECT 'CORRUPT_DATA' AS code, 'a' AS field, 'missing' AS fault, count(*) AS records, min(line) AS record, CAST(NULL AS VARCHAR) AS value FROM {SQL_LINES} WHERE NOT list_contains(json_keys(line), 'a') UNION ALL SELECT 'CORRUPT_DATA', 'l', 'kind', count(*), min(line), arg_min(CAST(json_extract(line, '$.l') AS VARCHAR), line) FROM {SQL_LINES} WHERE list_contains(json_keys(line), 'l')")
def drift_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All faults in one error, each with its least record and the value at fault."""
    strict = CollectionSchema("id", {"id": Field("id", "number"), "a": Field("a", "string", nullable=True), "l": Field("l", "boolean", absent=True)}, "id")
    try:
        check_drift(from_lines(lines(spark, sf_dir), strict, keep_line=True), strict)
        rows: list[tuple] = []
    except DriftError as e:
        rows = [(e.code, r["field"], r["fault"], r["records"], r["record"], r["value"]) for r in e.report]
    return spark.createDataFrame(rows, "code string, field string, fault string, records bigint, record string, value string")


_SQL_SHARES = " UNION ALL ".join(f"SELECT '{f}' AS field, avg(n) AS n FROM (SELECT count(DISTINCT b) AS n FROM {SQL_PARTS} GROUP BY {f})" for f in ("p_name", "p_brand", "p_type"))


@query("weak_plain_indexes", f"SELECT field, round(n / (SELECT count(DISTINCT b) FROM {SQL_PARTS}), 9) AS share, n / (SELECT count(DISTINCT b) FROM {SQL_PARTS}) > {infer.WEAK_SHARE} AND (SELECT count(DISTINCT b) FROM {SQL_PARTS}) >= {lints.FEW_BLOCKS} AS warned FROM ({_SQL_SHARES})")
def weak_plain_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = ranked(spark, sf_dir, "part", "p_retailprice")
    n = blocks.select(BLOCK).distinct().count()
    shares = {r["field"]: r["share"] for r in selectivity(postings(blocks, PARTS), n).collect()}
    warned = {w.split(":")[0] for w in lints.weak_indexes(shares, n)}
    return spark.createDataFrame([(f, round(s, 9), f in warned) for f, s in shares.items()], "field string, share double, warned boolean")


_SQL_GRAMS = f"(SELECT DISTINCT b, g FROM (SELECT b, unnest(list_transform(range(1, length(p_name) - 1), lambda i: substr(p_name, i, 3))) AS g FROM {SQL_PARTS}))"


@query("weak_text_index", f"SELECT round(avg(n) / (SELECT count(DISTINCT b) FROM {SQL_PARTS}), 9) AS share, avg(n) / (SELECT count(DISTINCT b) FROM {SQL_PARTS}) > {infer.WEAK_SHARE} AND (SELECT count(DISTINCT b) FROM {SQL_PARTS}) >= {lints.FEW_BLOCKS} AS warned FROM (SELECT count(*) AS n FROM {_SQL_GRAMS} GROUP BY g)")
def weak_text_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = ranked(spark, sf_dir, "part", "p_retailprice")
    n = blocks.select(BLOCK).distinct().count()
    row = selectivity(trigram_postings(blocks, PARTS), n).first()
    return spark.createDataFrame([(round(row["share"], 9), bool(lints.weak_indexes({"p_name": row["share"]}, n, "contains index")))], "share double, warned boolean")


@query("contains_index_bytes", f"SELECT (SELECT sum(strlen(g) + 2 * n) FROM (SELECT g, count(*) AS n FROM {_SQL_GRAMS} GROUP BY g))::BIGINT AS index_bytes, (SELECT sum(strlen(p_name)) FROM part)::BIGINT AS column_bytes, (SELECT sum(strlen(g) + 2 * n) FROM (SELECT g, count(*) AS n FROM {_SQL_GRAMS} GROUP BY g)) > (SELECT sum(strlen(p_name)) FROM part) AS warned")
def contains_index_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = ranked(spark, sf_dir, "part", "p_retailprice")
    own = trigram_postings(blocks, PARTS).agg(F.sum(F.octet_length("value") + 2 * F.size("blocks"))).first()[0]
    column = lints.text_shapes(blocks, ["p_name"])["p_name"].bytes
    return spark.createDataFrame([(own, column, bool(lints.contains_larger_than_column({"p_name": own}, {"p_name": column})))], "index_bytes bigint, column_bytes bigint, warned boolean")


@query("column_bytes", "SELECT 'p_name' AS field, CAST(sum(strlen(p_name)) AS BIGINT) AS bytes FROM part UNION ALL SELECT 'p_brand', CAST(sum(strlen(p_brand)) AS BIGINT) FROM part UNION ALL SELECT 'p_type', CAST(sum(strlen(p_type)) AS BIGINT) FROM part")
def column_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lints.text_shapes(table(spark, sf_dir, "part"), ["p_name", "p_brand", "p_type"])
    return spark.createDataFrame([(n, s.bytes) for n, s in found.items()], "field string, bytes bigint")


@query("unsuitable_text_index", f"SELECT 'url' AS field, count(*) FILTER (WHERE regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://\\S+$')) >= {infer.SHAPE_SHARE} * count(url) AS warned FROM pages UNION ALL SELECT 'html', FALSE")
def unsuitable_text_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = CollectionSchema("page_id", {"page_id": Field("page_id", "number"), **{n: Field(n, "string", indexed=True, contains=True) for n in ("url", "html")}})
    warned = {w.split(":")[0] for w in lints.unsuitable_text_indexes(schema, lints.text_shapes(table(spark, sf_dir, "pages"), ["url", "html"]))}
    return spark.createDataFrame([(n, n in warned) for n in ("url", "html")], "field string, warned boolean")


@query("oversized_record", "SELECT CAST(max(strlen(text)) > 65536 AS BOOLEAN) AS warned FROM documents")
def oversized_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest record of a collection, held against a block; texts here are far from the edge on either side."""
    path = f"{work_dir(spark)}/large"
    build(table(spark, sf_dir, "documents").select("doc_id", "text"), CollectionSchema("doc_id", {"doc_id": Field("doc_id", "number"), "text": Field("text", "string")}), path, block_bytes=1 << 16)
    return spark.createDataFrame([(any("larger than a block" in w for w in lints.collection_warnings(connect(spark, path))),)], "warned boolean")


@query("skipped_indexes", "SELECT 'o_custkey' AS field, FALSE AS skipped UNION ALL SELECT 'o_orderstatus', TRUE UNION ALL SELECT 'o_orderpriority', TRUE")
def skipped_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of few values lie in every block of another order: advice leaves their indexes out. Customers of one date are few, and kept."""
    orders = table(spark, sf_dir, "orders").withColumn("o_custkey", F.date_format("o_orderdate", "yyyy-MM"))
    stats = infer.column_stats(orders)
    shares = infer.block_share(orders, "o_orderdate", ["o_custkey", "o_orderstatus", "o_orderpriority"], 40, distinct={n: s.distinct for n, s in stats.items()})
    left_out = {w.split(":")[0] for w in infer.skipped_indexes(stats, "o_orderdate", shares)}
    return spark.createDataFrame([(n, n in left_out) for n in ("o_custkey", "o_orderstatus", "o_orderpriority")], "field string, skipped boolean")


@query("manifest_budget", _values("bytes, warned", [(999_999, False), (1_000_000, False), (1_000_001, True)]))
def manifest_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(n, lints.over_budget(n) is not None) for n in (999_999, 1_000_000, 1_000_001)], "bytes bigint, warned boolean")


@query("shared_value_sets", "SELECT string_agg(f, ',' ORDER BY f) AS fields FROM (SELECT 'lang' AS f, (SELECT array_to_string(list_sort(list(DISTINCT lang)), ',') FROM documents) AS v UNION ALL SELECT 'other', (SELECT array_to_string(list_sort(list(DISTINCT lang)), ',') FROM documents) UNION ALL SELECT 'third', 'x,y') GROUP BY v HAVING count(*) > 1")
def shared_value_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = infer.small_sets(table(spark, sf_dir, "documents").withColumn("other", F.col("lang")), ["lang", "other"]).collect()
    fields = {r["field"]: Field(r["field"], "string", values=tuple(r["values"].split(","))) for r in sets} | {"third": Field("third", "string", values=("x", "y"))}
    return spark.createDataFrame([(",".join(names),) for names in lints.shared_values(CollectionSchema("third", fields))], "fields string")


_UNIQUE = ("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")


@query("unique_fields", " UNION ALL ".join(f"SELECT '{c}' AS field, count(DISTINCT {c}) = count({c}) AS is_unique FROM orders" for c in _UNIQUE))
def unique_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = infer.column_stats(table(spark, sf_dir, "orders"))
    return spark.createDataFrame([(c, stats[c].unique) for c in _UNIQUE], "field string, is_unique boolean")


_SHARED = ("o_custkey", "o_orderstatus", "o_orderpriority")
_SQL_BINS = "(SELECT *, CAST((row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1) * 20 // count(*) OVER () AS INT) AS bin FROM orders)"


@query("block_share", " UNION ALL ".join(f"SELECT '{c}' AS field, round(avg(n) / 20, 9) AS share FROM (SELECT count(DISTINCT bin) AS n FROM {_SQL_BINS} GROUP BY {c})" for c in _SHARED))
def block_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From all records the estimate is a count. Places among equal prices go by key in both."""
    orders = table(spark, sf_dir, "orders").withColumn("rank", F.struct("o_totalprice", "o_orderkey"))
    found = infer.block_share(orders, "rank", list(_SHARED), 20, rows=1 << 40)
    return spark.createDataFrame([(n, round(s, 9)) for n, s in found.items()], "field string, share double")


@query("sort_scatter", f"SELECT round((a + b) / 2, 9) AS blocks FROM (SELECT (SELECT avg(n) FROM (SELECT count(DISTINCT bin) AS n FROM {_SQL_BINS} GROUP BY o_custkey)) AS a, (SELECT avg(n) FROM (SELECT count(DISTINCT bin) AS n FROM {_SQL_BINS} GROUP BY o_orderstatus)) AS b)")
def sort_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("rank", F.struct("o_totalprice", "o_orderkey"))
    return spark.createDataFrame([(round(infer.scatter(orders, "rank", ["o_custkey", "o_orderstatus"], 20, rows=1 << 40), 9),)], "blocks double")


@query("sampled_share", _values("field, near", [(c, True) for c in _SHARED]))
def sampled_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From 2,000 records the estimate is within five points of the count over all."""
    orders = table(spark, sf_dir, "orders").select(F.struct("o_totalprice", "o_orderkey").alias("rank"), *_SHARED)
    distinct = {n: orders.select(n).distinct().count() for n in _SHARED}
    part, whole = (infer.block_share(orders, "rank", list(_SHARED), 20, rows=n, distinct=distinct) for n in (2000, 1 << 40))
    return spark.createDataFrame([(n, abs(part[n] - whole[n]) < 0.05) for n in _SHARED], "field string, near boolean")


@query("sample_bins", "SELECT c_custkey, CAST((row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1) * 16 // count(*) OVER () AS BIGINT) AS bin FROM customer")
def sample_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infer.sample_bins(table(spark, sf_dir, "customer").select("c_acctbal", "c_custkey"), "c_acctbal", 16).select("c_custkey", "bin")


_SQL_SEEDED = f"(CAST(('0x' || substr(md5(concat('{SEED}|', o_orderkey)), 1, 14)) AS BIGINT) >> 3)"


@query("seeded_hash", f"SELECT o_orderkey, {_SQL_SEEDED} AS hash FROM orders")
def seeded_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", seeded_hash(SEED, [F.col("o_orderkey")]).alias("hash"))


@query("seeded_sample", f"SELECT o_orderkey, o_totalprice FROM orders ORDER BY {_SQL_SEEDED}, o_orderkey LIMIT 200")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of 200 (the operator's own limit) that is the same on any partitioning."""
    return sample(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").repartition(5), 200, by=["o_orderkey"])


@query("advice", _values("what, field", [("pk", "part_id"), ("sort", "p_retailprice"), ("index", "p_size"), ("index", "p_name"), ("index", "p_brand")]))
def advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The primary key, sort field and indexes that statistics advise: of parts whose fields have 12, 7, 5 and one value, and prices all different."""
    key = F.col("p_partkey")
    few = lambda n: F.concat(F.lit("v"), F.pmod(key, F.lit(n)).cast("string"))
    parts = table(spark, sf_dir, "part").select(key.cast("string").alias("part_id"), few(7).alias("p_name"), few(5).alias("p_brand"), F.lit("t").alias("p_type"), F.pmod(key, F.lit(12)).alias("p_size"), (key + 0.5).alias("p_retailprice"))
    stats = infer.column_stats(parts)
    sort = infer.recommend_sort(stats)
    rows = [("pk", infer.recommend_pk(stats)), ("sort", sort), *(("index", n) for n in infer.recommend_indexes(stats, sort)[0])]
    return spark.createDataFrame(rows, "what string, field string")


@query("estimates", "SELECT count(*) AS records, CAST(sum(n) AS BIGINT) AS bytes, CAST(ceil(sum(n) / 65536.0) AS BIGINT) AS blocks, CAST(quantile_disc(n, 0.95) AS BIGINT) AS p95, (SELECT count(DISTINCT o_orderstatus) FROM orders) AS cardinality FROM (SELECT strlen(concat('{\"o_orderkey\":', o_orderkey, ',\"o_orderstatus\":\"', o_orderstatus, '\"}')) + 1 AS n FROM orders)")
def estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = CollectionSchema("o_orderkey", {"o_orderkey": Field("o_orderkey", "number"), "o_orderstatus": Field("o_orderstatus", "string", indexed=True)})
    e = cost.estimate(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), own, 65_536)
    return spark.createDataFrame([(e["records"], e["bytes"], e["blocks"], int(e["p95_record_bytes"]), e["fields"]["o_orderstatus"]["cardinality"])], "records bigint, bytes bigint, blocks bigint, p95 bigint, cardinality bigint")


# --- the client's rules --------------------------------------------------------------------------

register_built("built_offset_far", "orders", {"o_orderstatus": {"equals": "F"}}, "o_orderstatus = 'F'", "ORDER BY o_orderdate, o_orderkey LIMIT 30 OFFSET 700", limit=30, offset=700)


@query("built_sort_prefix", "SELECT c_custkey, c_name FROM customer WHERE starts_with(c_name, 'Customer#00000012')")
def built_sort_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prefix of the sort field is a range of blocks."""
    path = f"{work_dir(spark)}/names"
    build(table(spark, sf_dir, "customer"), CUSTOMERS, path, block_bytes=1 << 13)
    return connect(spark, path).query({"c_name": {"startsWith": "Customer#00000012"}}).select("c_custkey", "c_name")


@query("page_after_skip", "SELECT o_orderkey, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS total, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') > 530 AS has_more FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate, o_orderkey LIMIT 30 OFFSET 500")
def page_after_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page behind an offset: whole blocks are skipped by their counts."""
    found = collection(spark, sf_dir, "orders").find_many({"o_orderstatus": {"equals": "F"}}, limit=30, offset=500)
    return spark.createDataFrame([(r["o_orderkey"], found.total, found.has_more) for r in found.records], "o_orderkey bigint, total bigint, has_more boolean")


@query("block_order_scan", "SELECT p_partkey FROM part WHERE p_type <> 'SMALL' ORDER BY p_retailprice, p_partkey LIMIT 25")
def block_order_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter that narrows nothing may be asked in block order with a limit."""
    found = collection(spark, sf_dir, "part").find_many({"p_type": {"not": "SMALL"}}, limit=25, scan="block-order")
    return spark.createDataFrame([(r["p_partkey"],) for r in found.records], "p_partkey bigint")


@query("walk_needs_no_tail", "SELECT doc_id, quality FROM documents d LEFT JOIN labels l USING (doc_id) ORDER BY quality ASC NULLS FIRST, doc_id LIMIT 20")
def walk_needs_no_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing sort values are stored last and asked for first: then a page is no walk of blocks."""
    path = f"{work_dir(spark)}/walk"
    by = CollectionSchema("quality", {"doc_id": Field("doc_id", "number", indexed=True), "quality": Field("quality", "number", nullable=True)}, "doc_id")
    build(labelled(spark, sf_dir).select("doc_id", "quality"), by, path, block_bytes=1 << 12)
    found = connect(spark, path).find_many(order_by={"quality": "asc"}, limit=20)
    return spark.createDataFrame([(r["doc_id"], r.get("quality")) for r in found.records], "doc_id bigint, quality int")


_RULES = [
    ("unknown operator", "ValueError"), ("operator of another kind", "ValueError"), ("unknown field", "ValueError"), ("value of another kind", "ValueError"), ("negative limit", "ValueError"),
    ("nothing narrows", "NEEDS_PRUNING"), ("short contains", "NEEDS_PRUNING"), ("scan without limit", "NEEDS_PRUNING"), ("scan in another order", "NEEDS_PRUNING"), ("limit above the ceiling", "LIMIT_EXCEEDED"), ("more than the ceiling", "LIMIT_EXCEEDED"),
    ("no primary key", "CONFIG"), ("no collection", "CONFIG"), ("another format", "FORMAT_VERSION"), ("broken manifest", "CORRUPT_DATA"), ("a file is gone", "DEPLOY_INTEGRITY"), ("all is well", "ok"),
]


@query("error_codes", _values("rule, code", _RULES))
def error_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .build import write_text

    part, orders, no_pk = (collection(spark, sf_dir, n) for n in ("part", "orders", "no_view"))
    base = work_dir(spark)
    write_text(spark, f"{base}/format/manifest.json", json.dumps({"format_version": 99}))
    write_text(spark, f"{base}/broken/manifest.json", "{")
    build(table(spark, sf_dir, "customer"), CUSTOMERS, f"{base}/gone", block_bytes=1 << 13)
    gone = connect(spark, f"{base}/gone")
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/gone/{gone.manifest['data']}")
    root.getFileSystem(spark._jsc.hadoopConfiguration()).delete(root, True)
    runs = (
        lambda: part.find_many({"p_name": {"like": "x"}}), lambda: part.find_many({"p_size": {"startsWith": "x"}}), lambda: part.find_many({"nothing": {"equals": 1}}), lambda: part.find_many({"p_size": {"equals": "x"}}), lambda: part.find_many(limit=-1),
        lambda: part.find_many({"p_type": {"not": "SMALL"}}), lambda: part.find_many({"p_name": {"contains": "re"}}), lambda: part.find_many({"p_type": {"not": "SMALL"}}, scan="block-order"), lambda: part.find_many({"p_type": {"not": "SMALL"}}, {"p_name": "asc"}, 5, scan="block-order"), lambda: part.find_many(limit=10_001), lambda: connect(spark, orders.path, max_results=10).find_many({"o_orderstatus": {"equals": "F"}}),
        lambda: no_pk.get(1), lambda: connect(spark, f"{base}/nowhere"), lambda: connect(spark, f"{base}/format"), lambda: connect(spark, f"{base}/broken"), lambda: gone.find_many({"c_name": {"startsWith": "Customer#00000012"}}), lambda: part.find_many({"p_size": {"equals": 3}}, limit=1),
    )
    return spark.createDataFrame([(rule, _code(run)) for (rule, _), run in zip(_RULES, runs)], "rule string, code string")


_PRUNES = [("{}", True), ('{"p_name": {"contains": "abc"}}', True), ('{"p_name": {"contains": "ab"}}', False), ('{"p_name": {"not": "abc"}}', False), ('{"p_size": {"gte": 3}}', True), ('{"p_retailprice": {"lt": 10}}', True), ('{"p_name": {"startsWith": ""}}', False), ('{"p_name": {"exists": true}, "p_brand": {"equals": "x"}}', True), ('{"types": {"isEmpty": false}}', False), ('{"types": {"isEmpty": true}}', True), ('{"types": {"hasEvery": []}}', False), ('{"types": {"some": {"not": "x"}}}', False)]


@query("prunes", _values("filter, narrows", _PRUNES))
def prunes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(w, where_prunes(json.loads(w), LISTS if "types" in w else PARTS)) for w, _ in _PRUNES], "filter string, narrows boolean")


@query("schema_of", _values("field, kind, indexed, sort", [("p_partkey", "number", True, False), ("p_name", "string", True, False), ("p_brand", "string", True, False), ("p_type", "string", True, False), ("p_size", "number", True, False), ("p_retailprice", "number", False, True)]))
def schema_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = collection(spark, sf_dir, "part")
    assert set(c.get_schema()["fields"]) == set(c.schema.fields)
    return spark.createDataFrame([(n, f.kind, f.indexed, c.schema.is_sort(n)) for n, f in c.schema.fields.items()], "field string, kind string, indexed boolean, sort boolean")


_NORMAL = [("fold", "Ünïcödé STRASSE", "unicode strasse"), ("lowercase", "ABC", "abc"), ("trim", "  x y ", "x y"), ("trim", "   ", None), ("numeric", " 0x1F ", "31.0"), ("numeric", "1e3", "1000.0"), ("numeric", "12 apples", None), ("fold", "ÉÀ", "ea")]


@query("normalize_values", _values("used, value, result", _NORMAL))
def normalize_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a client asks for is normalized as the column was."""
    rows = [(u, v, None if (got := normalize(u, v)) is None else str(got)) for u, v, _ in _NORMAL]
    return spark.createDataFrame(rows, "used string, value string, result string")


@query("fold_lists", f"SELECT user_id, day, array_to_string(list_transform(types, lambda x: lower(x)), '/') AS folded FROM {SQL_NO_VIEW} WHERE len(types) > 0")
def fold_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A derived list: every element folded, and one that holds any character stays one."""
    from .operators.derive import derive
    from .queries import lists

    fields = {"user_id": Field("user_id", "number"), "day": Field("day", "string"), "types": Field("types", "string", indexed=True, multi=True), "folded": Field("folded", "string", indexed=True, multi=True, absent=True, derive_from="types", derive_using="fold")}
    accents = lists(spark, sf_dir, "view").withColumn("types", F.transform("types", lambda x: F.replace(F.upper(x), F.lit("E"), F.lit("É"))))
    return derive(accents, CollectionSchema("user_id", fields)).where(F.size("types") > 0).select("user_id", "day", F.array_join("folded", "/").alias("folded"))


@query("cancelled", "SELECT 'ABORTED' AS code")
def cancelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query under a tag that another thread cancels."""
    c = collection(spark, sf_dir, "orders")
    slow = c.stored()
    # keeps its tasks busy until they are interrupted
    c._match = lambda where: (slow.where(F.length(F.sha2(F.repeat(F.col("o_orderkey").cast("string"), F.lit(500_000)).cast("binary"), 512)) > 0), None)
    code: list[str] = []
    done = threading.Event()

    def stop() -> None:
        while not done.is_set():
            time.sleep(0.2)
            c.cancel("surface-cancel")

    from pyspark import InheritableThread

    other = InheritableThread(target=stop)
    other.start()
    try:
        code.append(_code(lambda: c.find_many({"o_orderstatus": {"equals": "F"}}, {"o_totalprice": "asc"}, 5, tag="surface-cancel")))
    finally:
        done.set()
        other.join()
    return spark.createDataFrame([(code[0],)], "code string")


@query("inspect_report", "SELECT count(*) AS records, count(DISTINCT o_orderdate) AS sort_values, (SELECT count(DISTINCT o_orderstatus) FROM orders) AS status_values, (SELECT count(DISTINCT o_orderpriority) FROM orders) AS priority_values FROM orders")
def inspect_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = cli.inspect(spark, collection(spark, sf_dir, "orders").path)
    return spark.createDataFrame([(r["records"], r["sort_values"], r["fields"]["o_orderstatus"]["index"]["values"], r["fields"]["o_orderpriority"]["index"]["values"])], "records bigint, sort_values bigint, status_values bigint, priority_values bigint")
