"""Every operator as a query over the driver's tables, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .build import build
from .client import Collection, connect, merge_by_pk
from .functions.normalize import fold, lowercase, numeric, trim
from .operators import indexes, infer
from .operators.blocks import BLOCK, block_table, exact_cut, work_dir
from .operators.drift import drift_report
from .operators.lints import LONG_RUN, skewed_blocks
from .plans.find import find
from .schema import CollectionSchema, Field
from .sources.readers import from_lines

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return put


# --- collections over the driver's tables --------------------------------------------------------


def _schema(sort: str, pk: str | None, **fields: str) -> CollectionSchema:
    """Fields by kind and marks: i indexed, e endsWith, c contains, n nullable, a absent, m list."""
    out = {}
    for name, spec in fields.items():
        kind, _, marks = spec.partition(":")
        out[name] = Field(name, kind, indexed="i" in marks, ends_with="e" in marks, contains="c" in marks, nullable="n" in marks, absent="a" in marks, multi="m" in marks)
    return CollectionSchema(sort, out, pk)


ORDERS = _schema("o_orderdate", "o_orderkey", o_orderkey="number:i", o_custkey="number:i", o_orderstatus="string:i", o_totalprice="number:i", o_orderdate="date", o_orderpriority="string:i")
PARTS = _schema("p_retailprice", "p_partkey", p_partkey="number:i", p_name="string:iec", p_brand="string:i", p_type="string:i", p_size="number:i", p_retailprice="number")
PARTS_BY_NAME = _schema("p_name", "p_partkey", p_partkey="number:i", p_name="string", p_brand="string:i", p_type="string:i", p_size="number:i", p_retailprice="number")
CUSTOMERS = _schema("c_name", "c_custkey", c_custkey="number:i", c_name="string", c_nationkey="number", c_acctbal="number:i", c_mktsegment="string:i")
EVENTS = _schema("ts", "event_id", event_id="number:i", ts="date", user_id="number:i", event_type="string:i", value="number", props="string")
DOCUMENTS = _schema("n_chars", "doc_id", doc_id="number:i", text="string", lang="string:i", source="string:i", n_chars="number", quality="number:n", toxic="number:n")
LISTS = _schema("user_id", None, user_id="number", day="string:i", types="string:im")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their labels, null where they have none."""
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")


def lists(spark: SparkSession, sf_dir: str, without: str | None = None) -> DataFrame:
    """The event types of each user and day, as a list."""
    types = F.sort_array(F.collect_set("event_type"))
    out = table(spark, sf_dir, "events").groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(types.alias("types"))
    return out if without is None else out.withColumn("types", F.filter("types", lambda x: x != without))


SQL_LABELLED = "(SELECT d.*, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"
SQL_LISTS = "(SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, list_sort(list(DISTINCT event_type)) AS types FROM events GROUP BY 1, 2)"
SQL_NO_VIEW = f"(SELECT user_id, day, list_filter(types, lambda x: x <> 'view') AS types FROM {SQL_LISTS})"

FRAMES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], CollectionSchema, str, list[str]]] = {
    "orders": (lambda s, d: table(s, d, "orders"), ORDERS, "orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]),
    "part": (lambda s, d: table(s, d, "part"), PARTS, "part", ["p_partkey", "p_name", "p_brand", "p_size", "p_retailprice"]),
    "part_by_name": (lambda s, d: table(s, d, "part"), PARTS_BY_NAME, "part", ["p_partkey", "p_name", "p_brand", "p_size", "p_retailprice"]),
    "customer": (lambda s, d: table(s, d, "customer"), CUSTOMERS, "customer", ["c_custkey", "c_name", "c_acctbal"]),
    "events": (lambda s, d: table(s, d, "events"), EVENTS, "events", ["event_id", "user_id", "event_type"]),
    "labelled": (labelled, DOCUMENTS, SQL_LABELLED, ["doc_id", "lang", "n_chars", "quality"]),
    "lists": (lists, LISTS, SQL_LISTS, ["user_id", "day", "types"]),
    "no_view": (lambda s, d: lists(s, d, "view"), LISTS, SQL_NO_VIEW, ["user_id", "day", "types"]),
}


def _flat(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*(F.array_join(c, ",").alias(c) if c == "types" else F.col(c) for c in columns))


def _sql_columns(columns: list[str]) -> str:
    return ", ".join(f"array_to_string({c}, ',') AS {c}" if c == "types" else c for c in columns)


def register(name: str, frame: str, where: dict[str, Any] | None, sql_where: str = "TRUE", sql_tail: str = "", **rest: Any) -> None:
    load, schema, source, columns = FRAMES[frame]
    QUERIES[name] = lambda s, d: _flat(find(load(s, d), schema, where, **rest), columns)
    ORACLES[name] = f"SELECT {_sql_columns(columns)} FROM {source} t WHERE {sql_where} {sql_tail}"


# scalar predicates
register("eq_string", "orders", {"o_orderstatus": {"equals": "F"}}, "o_orderstatus = 'F'")
register("eq_number", "part", {"p_size": {"equals": 7}}, "p_size = 7")
register("not_string", "orders", {"o_orderpriority": {"not": "5-LOW"}}, "o_orderpriority <> '5-LOW'")
register("not_skips_missing", "labelled", {"quality": {"not": 1}}, "quality <> 1")
register("in_list", "events", {"event_type": {"in": ["purchase", "signup"]}}, "event_type IN ('purchase', 'signup')")
register("in_number", "part", {"p_size": {"in": [1, 5, 49]}}, "p_size IN (1, 5, 49)")
register("in_empty", "orders", {"o_orderstatus": {"in": []}}, "FALSE")
register("range_number", "orders", {"o_totalprice": {"gte": 100000, "lt": 200000}}, "o_totalprice >= 100000 AND o_totalprice < 200000")
register("range_open", "orders", {"o_totalprice": {"gt": 250000, "lte": 260000}}, "o_totalprice > 250000 AND o_totalprice <= 260000")
register("range_date", "orders", {"o_orderdate": {"gte": "1997-01-01", "lt": "1998-01-01"}}, "o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01'")
register("range_string_sort", "customer", {"c_name": {"gte": "Customer#000000100", "lt": "Customer#000000200"}}, "c_name >= 'Customer#000000100' AND c_name < 'Customer#000000200'")
register("starts_with", "part", {"p_name": {"startsWith": "red"}}, "starts_with(p_name, 'red')")
register("ends_with", "part", {"p_name": {"endsWith": "ring"}}, "suffix(p_name, 'ring')")
register("contains", "part", {"p_name": {"contains": "widg"}}, "contains(p_name, 'widg')")
register("contains_short", "part", {"p_name": {"contains": "ri"}, "p_retailprice": {"gte": 950}}, "contains(p_name, 'ri') AND p_retailprice >= 950")
register("is_null", "labelled", {"quality": {"isNull": True}}, "quality IS NULL")
register("exists_true", "labelled", {"quality": {"exists": True}}, "quality IS NOT NULL")
register("exists_false", "labelled", {"quality": {"exists": False}}, "quality IS NULL")
register("and_multi_field", "orders", {"o_orderstatus": {"equals": "O"}, "o_orderpriority": {"startsWith": "1"}, "o_totalprice": {"gt": 50000, "lt": 300000}}, "o_orderstatus = 'O' AND starts_with(o_orderpriority, '1') AND o_totalprice > 50000 AND o_totalprice < 300000")
register("unset_filters", "orders", {"o_orderstatus": {"equals": None}, "o_custkey": None, "o_orderpriority": {"equals": "2-HIGH"}}, "o_orderpriority = '2-HIGH'")
register("where_empty", "customer", None)

# lists
register("list_some", "lists", {"types": {"some": "purchase"}}, "list_contains(types, 'purchase')")
register("list_some_prefix", "lists", {"types": {"some": {"startsWith": "p", "endsWith": "e"}}}, "len(list_filter(types, lambda x: starts_with(x, 'p') AND suffix(x, 'e'))) > 0")
register("list_every", "lists", {"types": {"every": {"in": ["view", "click"]}}}, "len(list_filter(types, lambda x: x NOT IN ('view', 'click'))) = 0")
register("list_every_empty", "no_view", {"types": {"every": "click"}}, "len(list_filter(types, lambda x: x <> 'click')) = 0")
register("list_has_every", "lists", {"types": {"hasEvery": ["view", "error"]}}, "list_has_all(types, ['view', 'error'])")
register("list_is_empty", "no_view", {"types": {"isEmpty": True}}, "len(types) = 0")
register("list_exact_set", "lists", {"types": {"hasEvery": ["view", "click"], "every": {"in": ["view", "click"]}}}, "list_has_all(types, ['view', 'click']) AND len(list_filter(types, lambda x: x NOT IN ('view', 'click'))) = 0")

# order and pages
register("order_single_desc", "orders", {"o_orderstatus": {"equals": "F"}}, "o_orderstatus = 'F'", "ORDER BY o_totalprice DESC, o_orderkey LIMIT 25", order_by={"o_totalprice": "desc"}, limit=25)
register("order_multi", "part", {"p_size": {"lte": 10}}, "p_size <= 10", "ORDER BY p_brand, p_size DESC, p_partkey LIMIT 40", order_by=[{"p_brand": "asc"}, {"p_size": "desc"}], limit=40)
register("order_nulls_first", "labelled", None, "TRUE", "ORDER BY quality ASC NULLS FIRST, doc_id LIMIT 700", order_by={"quality": "asc"}, limit=700)
register("order_nulls_last", "labelled", None, "TRUE", "ORDER BY quality DESC NULLS LAST, doc_id LIMIT 500", order_by={"quality": "desc"}, limit=500)
register("order_list", "lists", {"types": {"some": "error"}}, "list_contains(types, 'error')", "ORDER BY array_to_string(types, ',') DESC, user_id, day LIMIT 30", order_by=[{"types": "desc"}, {"user_id": "asc"}, {"day": "asc"}], limit=30)
register("page_offset", "orders", {"o_totalprice": {"gte": 100000}}, "o_totalprice >= 100000", "ORDER BY o_totalprice, o_orderkey LIMIT 10 OFFSET 20", order_by={"o_totalprice": "asc"}, limit=10, offset=20)
register("offset_alone", "customer", {"c_mktsegment": {"equals": "BUILDING"}}, "c_mktsegment = 'BUILDING'", "ORDER BY c_acctbal DESC, c_custkey OFFSET 5", order_by={"c_acctbal": "desc"}, offset=5)
register("default_order", "part", {"p_type": {"equals": "SMALL"}}, "p_type = 'SMALL'", "ORDER BY p_retailprice, p_partkey LIMIT 15", limit=15)
register("get_hit", "orders", {"o_orderkey": {"equals": 42}}, "o_orderkey = 42", "LIMIT 1", limit=1)
register("get_miss", "orders", {"o_orderkey": {"equals": -1}}, "o_orderkey = -1")


@query("default_order_missing_last", f"SELECT doc_id, quality FROM {SQL_LABELLED} ORDER BY quality ASC NULLS LAST, doc_id LIMIT 450")
def default_order_missing_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_quality = CollectionSchema("quality", DOCUMENTS.fields, "doc_id")
    return find(labelled(spark, sf_dir), by_quality, limit=450).select("doc_id", "quality")


@query("has_more", "SELECT count(*) > 90 AS has_more, least(count(*) - 20, 70) AS n FROM (SELECT 1 FROM orders WHERE o_orderstatus = 'F' LIMIT 91)")
def has_more(spark: SparkSession, sf_dir: str) -> DataFrame:
    """offset 20, limit 70: one row beyond the page says whether there is more."""
    found = find(table(spark, sf_dir, "orders"), ORDERS, {"o_orderstatus": {"equals": "F"}}, {"o_totalprice": "asc"}, 71, 20)
    return found.agg((F.count("*") > 70).alias("has_more"), F.least(F.count("*"), F.lit(70)).alias("n"))


@query("exact_total", "SELECT count(*) AS total FROM orders WHERE o_orderstatus = 'O' AND o_totalprice >= 150000")
def exact_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "orders"), ORDERS, {"o_orderstatus": {"equals": "O"}, "o_totalprice": {"gte": 150000}}).agg(F.count("*").alias("total"))


@query("or_merge_by_pk", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' UNION SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 400000")
def or_merge_by_pk(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    parts = [find(orders, ORDERS, w).select("o_orderkey", "o_custkey") for w in ({"o_orderpriority": {"equals": "1-URGENT"}}, {"o_totalprice": {"gt": 400000}})]
    return merge_by_pk(parts, "o_orderkey")


# --- missing keys --------------------------------------------------------------------------------

LINES = CollectionSchema("id", {"id": Field("id", "number"), "a": Field("a", "string", absent=True, nullable=True), "n": Field("n", "number", absent=True), "l": Field("l", "string", indexed=True, multi=True, absent=True)}, "id")
_KEY_A = "CASE WHEN event_id % 3 = 0 THEN '' WHEN event_id % 3 = 1 THEN ',\"a\":null' ELSE concat(',\"a\":\"', event_type, '\"') END"
_LINE = f"concat('{{\"id\":', event_id, {_KEY_A}, CASE WHEN event_id % 5 = 0 THEN '' ELSE concat(',\"n\":', user_id) END, CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN ',\"l\":[]' ELSE concat(',\"l\":[\"', event_type, '\",\"x\"]') END, '}}')"
SQL_LINES = f"(SELECT event_id, {_LINE} AS line FROM events)"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as lines of JSON, in which keys are missing, null or there."""
    return table(spark, sf_dir, "events").selectExpr(f"{_LINE} AS value")


def register_lines(name: str, where: dict[str, Any], sql_where: str) -> None:
    QUERIES[name] = lambda s, d: find(from_lines(lines(s, d), LINES), LINES, where).select(F.col("id").cast("bigint").alias("id"), "a")
    ORACLES[name] = f"SELECT event_id AS id, json_extract_string(line, '$.a') AS a FROM {SQL_LINES} WHERE {sql_where}"


register_lines("is_absent", {"a": {"isAbsent": True}}, "NOT list_contains(json_keys(line), 'a')")
register_lines("is_null_not_absent", {"a": {"isNull": True}}, "json_type(line, '$.a') = 'NULL'")
register_lines("exists_json", {"a": {"exists": True}}, "json_extract_string(line, '$.a') IS NOT NULL")
register_lines("not_skips_absent", {"a": {"not": "click"}}, "json_extract_string(line, '$.a') <> 'click'")
register_lines("json_number_range", {"n": {"gte": 10, "lt": 40}}, "CAST(json_extract_string(line, '$.n') AS BIGINT) BETWEEN 10 AND 39")
register_lines("json_list_empty", {"l": {"isEmpty": True}}, "json_array_length(line, '$.l') = 0 AND list_contains(json_keys(line), 'l')")
register_lines("json_list_some", {"l": {"some": {"startsWith": "p"}}}, "json_extract_string(line, '$.l[0]') LIKE 'p%'")


@query("drift_report", f"SELECT 'a' AS field, 'missing' AS fault, count(*) AS records FROM {SQL_LINES} WHERE NOT list_contains(json_keys(line), 'a') UNION ALL SELECT 'a', 'null', count(*) FROM {SQL_LINES} WHERE json_type(line, '$.a') = 'NULL' UNION ALL SELECT 'n', 'missing', count(*) FROM {SQL_LINES} WHERE NOT list_contains(json_keys(line), 'n') UNION ALL SELECT 'l', 'kind', count(*) FROM {SQL_LINES} WHERE list_contains(json_keys(line), 'l')")
def drift_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of the lines against a schema that knows no missing keys and takes the list for a boolean."""
    strict = CollectionSchema("id", {"id": Field("id", "number"), "a": Field("a", "string"), "n": Field("n", "number"), "l": Field("l", "boolean", absent=True, nullable=True)}, "id")
    return spark.createDataFrame(drift_report(from_lines(lines(spark, sf_dir), strict), strict), "field string, fault string, records bigint")


@query("infer_kinds", "SELECT * FROM (VALUES ('id', 'number', FALSE, FALSE, FALSE), ('a', 'string', TRUE, TRUE, FALSE), ('n', 'number', TRUE, FALSE, FALSE), ('l', 'string', TRUE, FALSE, TRUE)) t(field, kind, absent, nullable, multi)")
def infer_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = infer.field_stats(lines(spark, sf_dir))
    return spark.createDataFrame([(s.name, s.kind, s.absent, s.nulls > 0, s.multi) for s in stats.values()], "field string, kind string, absent boolean, nullable boolean, multi boolean")


# --- blocks and indexes --------------------------------------------------------------------------

ROWS = 100
SQL_RANKED = f"(SELECT *, CAST((rank() OVER (ORDER BY o_totalprice) - 1) // {ROWS} AS INT) AS b FROM orders)"
SQL_PARTS = f"(SELECT *, CAST((rank() OVER (ORDER BY p_retailprice) - 1) // {ROWS} AS INT) AS b FROM part)"
BY_PRICE = CollectionSchema("o_totalprice", ORDERS.fields, "o_orderkey")


def ranked(spark: SparkSession, sf_dir: str, name: str = "orders", by: str = "o_totalprice") -> DataFrame:
    return exact_cut(table(spark, sf_dir, name), by, F.lit(1), ROWS, work_dir(spark))


@query("sort_cut_blocks", f"SELECT b AS block, count(*) AS count, min(o_totalprice) AS lo, max(o_totalprice) AS hi, 0 AS n_null, 0 AS n_absent FROM {SQL_RANKED} GROUP BY b")
def sort_cut_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_table(ranked(spark, sf_dir), BY_PRICE).select(F.col(BLOCK).alias("block"), "count", "lo", "hi", "n_null", "n_absent")


@query("zonemap_build", f"SELECT 'o_orderstatus' AS field, b AS block, min(o_orderstatus) AS min_s, max(o_orderstatus) AS max_s, NULL AS min_n, NULL AS max_n FROM {SQL_RANKED} GROUP BY b UNION ALL SELECT 'o_orderpriority', b, min(o_orderpriority), max(o_orderpriority), NULL, NULL FROM {SQL_RANKED} GROUP BY b UNION ALL SELECT 'o_custkey', b, NULL, NULL, CAST(min(o_custkey) AS DOUBLE), CAST(max(o_custkey) AS DOUBLE) FROM {SQL_RANKED} GROUP BY b UNION ALL SELECT 'o_orderkey', b, NULL, NULL, CAST(min(o_orderkey) AS DOUBLE), CAST(max(o_orderkey) AS DOUBLE) FROM {SQL_RANKED} GROUP BY b")
def zonemap_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexes.zonemap(ranked(spark, sf_dir), BY_PRICE).withColumnRenamed(BLOCK, "block")


def _postings_sql(source: str, parts: list[tuple[str, str, str]]) -> str:
    """parts: field, value and what to select it from, unnested where there are several."""
    return " UNION ALL ".join(f"SELECT '{field}' AS field, v AS value, array_to_string(list_sort(list(DISTINCT b)), ',') AS blocks FROM (SELECT b, {value} AS v FROM {source}{more}) GROUP BY v" for field, value, more in parts)


def _joined(df: DataFrame) -> DataFrame:
    return df.select("field", "value", F.array_join(F.col("blocks").cast("array<string>"), ",").alias("blocks"))


@query("postings_build", _postings_sql(SQL_PARTS, [("p_name", "p_name", ""), ("p_brand", "p_brand", ""), ("p_type", "p_type", "")]))
def postings_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(indexes.postings(ranked(spark, sf_dir, "part", "p_retailprice"), PARTS))


@query("reversed_build", _postings_sql(SQL_PARTS, [("p_name", "reverse(p_name)", "")]))
def reversed_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(indexes.reversed_postings(ranked(spark, sf_dir, "part", "p_retailprice"), PARTS))


@query("trigram_build", _postings_sql(SQL_PARTS, [("p_name", "unnest(list_transform(range(1, length(p_name) - 1), lambda i: substr(p_name, i, 3)))", "")]))
def trigram_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(indexes.trigram_postings(ranked(spark, sf_dir, "part", "p_retailprice"), PARTS))


SQL_LIST_BLOCKS = f"(SELECT *, CAST((rank() OVER (ORDER BY user_id) - 1) // {ROWS} AS INT) AS b FROM {SQL_NO_VIEW})"


@query("empty_list_blocks", f"SELECT DISTINCT 'types' AS field, b AS block FROM {SQL_LIST_BLOCKS} WHERE len(types) = 0")
def empty_list_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = exact_cut(lists(spark, sf_dir, "view"), "user_id", F.lit(1), ROWS, work_dir(spark))
    return indexes.empty_blocks(stored, LISTS).withColumnRenamed(BLOCK, "block")


@query("index_selectivity", f"SELECT field, sum(n) AS postings, count(*) AS vals FROM (SELECT 'p_brand' AS field, count(DISTINCT b) AS n FROM {SQL_PARTS} GROUP BY p_brand UNION ALL SELECT 'p_type', count(DISTINCT b) FROM {SQL_PARTS} GROUP BY p_type UNION ALL SELECT 'p_name', count(DISTINCT b) FROM {SQL_PARTS} GROUP BY p_name) GROUP BY field")
def index_selectivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = indexes.postings(ranked(spark, sf_dir, "part", "p_retailprice"), PARTS)
    return found.groupBy("field").agg(F.sum(F.size("blocks")).cast("bigint").alias("postings"), F.count("*").alias("vals"))


@query("skew_lint", "SELECT g AS block, n AS bytes FROM (SELECT g, n, avg(n) OVER () AS mean FROM (SELECT CAST(doc_id % 10 AS INT) * CAST(doc_id % 3 AS INT) AS g, CAST(sum(strlen(text)) AS BIGINT) AS n FROM documents GROUP BY 1)) WHERE n > 2 * mean")
def skew_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    group = ((F.col("doc_id") % 10) * (F.col("doc_id") % 3)).cast("int").alias("block")
    return skewed_blocks(table(spark, sf_dir, "documents").groupBy(group).agg(F.sum(F.octet_length("text")).alias("bytes")))


@query("low_card_lint", f"SELECT 'o_orderdate' AS field, count(*) > {LONG_RUN} * count(DISTINCT o_orderdate) AS warned FROM orders UNION ALL SELECT 'o_orderstatus', count(*) > {LONG_RUN} * count(DISTINCT o_orderstatus) FROM orders")
def low_card_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    found = infer.exact_cardinality(orders, ["o_orderdate", "o_orderstatus"])
    # one row
    return found.join(F.broadcast(orders.agg(F.count("*").alias("n")))).select("field", (F.col("n") > LONG_RUN * F.col("distinct")).alias("warned"))


# --- through a built collection ------------------------------------------------------------------

_BUILT: dict[tuple[str, str, str], str] = {}


def collection(spark: SparkSession, sf_dir: str, name: str) -> Collection:
    """A collection over a table, built once in a session, of blocks small enough that pruning shows."""
    load, schema, *_ = FRAMES[name]
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _BUILT:
        path = f"{work_dir(spark)}/{name}"
        build(load(spark, sf_dir), schema, path, block_bytes=1 << 16 if name.startswith("part") else 1 << 18)
        _BUILT[key] = path
    return connect(spark, _BUILT[key])


def register_built(name: str, frame: str, where: dict[str, Any], sql_where: str, sql_tail: str = "", **rest: Any) -> None:
    columns = FRAMES[frame][3]
    QUERIES[name] = lambda s, d: _flat(collection(s, d, frame).query(where, **rest), columns)
    ORACLES[name] = f"SELECT {_sql_columns(columns)} FROM {FRAMES[frame][2]} t WHERE {sql_where} {sql_tail}"


register_built("built_sort_range", "orders", {"o_orderdate": {"gte": "1997-01-01", "lt": "1997-04-01"}}, "o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1997-04-01'")
register_built("built_index_and_sort", "orders", {"o_orderdate": {"gt": "1998-06-01"}, "o_orderstatus": {"equals": "P"}, "o_custkey": {"gte": 100, "lte": 300}}, "o_orderdate > TIMESTAMP '1998-06-01' AND o_orderstatus = 'P' AND o_custkey BETWEEN 100 AND 300")
register_built("built_top_k", "orders", {"o_orderpriority": {"in": ["1-URGENT", "2-HIGH"]}}, "o_orderpriority IN ('1-URGENT', '2-HIGH')", "ORDER BY o_totalprice DESC, o_orderkey LIMIT 20", order_by={"o_totalprice": "desc"}, limit=20)
register_built("built_starts_with", "part", {"p_name": {"startsWith": "red w"}}, "starts_with(p_name, 'red w')")
register_built("built_sorted_prefix", "part_by_name", {"p_name": {"startsWith": "red w"}}, "starts_with(p_name, 'red w')")
register_built("built_ends_with", "part", {"p_name": {"endsWith": " bolt"}}, "suffix(p_name, ' bolt')")
register_built("built_contains", "part", {"p_name": {"contains": "ll wid"}}, "contains(p_name, 'll wid')")
register_built("built_number_index", "part", {"p_size": {"equals": 3}, "p_retailprice": {"lt": 1000}}, "p_size = 3 AND p_retailprice < 1000")
register_built("built_list", "no_view", {"types": {"hasEvery": ["click"], "every": {"in": ["click", "error"]}}}, "list_has_all(types, ['click']) AND len(list_filter(types, lambda x: x NOT IN ('click', 'error'))) = 0")
register_built("built_list_empty", "no_view", {"types": {"isEmpty": True}}, "len(types) = 0")


@query("built_get", "SELECT p_partkey, p_name FROM part WHERE p_partkey = 17")
def built_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collection(spark, sf_dir, "part").get(17)
    return spark.createDataFrame([(found["p_partkey"], found["p_name"])] if found else [], "p_partkey bigint, p_name string")


@query("built_page", "SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') > 60 AS has_more FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate, o_orderkey LIMIT 40 OFFSET 20")
def built_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page in stored order, read block by block until it is full."""
    found = collection(spark, sf_dir, "orders").find_many({"o_orderstatus": {"equals": "F"}}, limit=40, offset=20)
    return spark.createDataFrame([(r["o_orderkey"], r["o_totalprice"], found.has_more) for r in found.records], "o_orderkey bigint, o_totalprice double, has_more boolean")


@query("built_count", "SELECT (SELECT count(*) FROM orders) AS total, TRUE AS total_exact, count(*) AS found, TRUE AS bounded, 0 AS none FROM orders WHERE o_orderdate >= TIMESTAMP '1999-01-01'")
def built_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, where = collection(spark, sf_dir, "orders"), {"o_orderdate": {"gte": "1999-01-01"}}
    total, bound, exact, none = c.count(), c.count(where), c.count(where, exact=True), c.count({"o_orderdate": {"gt": "2100-01-01"}})
    return spark.createDataFrame([(total.count, total.exact, exact.count, exact.count <= bound.count <= total.count and none.exact, none.count)], "total bigint, total_exact boolean, found bigint, bounded boolean, none bigint")


@query("count_upper_bound", f"SELECT count(*) AS bound FROM {SQL_RANKED} WHERE b IN (SELECT b FROM {SQL_RANKED} GROUP BY b HAVING max(o_totalprice) >= 200000 AND min(o_totalprice) <= 250000)")
def count_upper_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the blocks whose bounds meet a range of the sort field: no record is read for it."""
    from .plans.planner import Metadata, candidates

    blocks = block_table(ranked(spark, sf_dir), BY_PRICE)
    found = candidates({"o_totalprice": {"gte": 200000, "lte": 250000}}, BY_PRICE, Metadata(blocks))
    return blocks.join(found, BLOCK, "left_semi").agg(F.sum("count").alias("bound"))


# --- derived columns and statistics --------------------------------------------------------------

_RAW = "CASE CAST(p_partkey % 8 AS INT) WHEN 0 THEN concat('  ', p_size, ' ') WHEN 1 THEN concat('-', p_size, '.5') WHEN 2 THEN '1e3' WHEN 3 THEN '' WHEN 4 THEN concat(p_size, '+*') WHEN 5 THEN 'Infinity' WHEN 6 THEN '0x1F' ELSE p_brand END"


@query("derive_numeric", "SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN CAST(p_size AS DOUBLE) WHEN 1 THEN -p_size - 0.5 WHEN 2 THEN 1000.0 WHEN 6 THEN 31.0 END AS n FROM part")
def derive_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", numeric(F.expr(_RAW)).alias("n"))


@query("derive_lower", "SELECT p_partkey, lower(p_brand) AS brand, lower(p_type) AS kind FROM part")
def derive_lower(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", lowercase(F.col("p_brand")).alias("brand"), lowercase(F.col("p_type")).alias("kind"))


@query("derive_trim", "SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN concat('-', p_size, '.5') WHEN 2 THEN '1e3' WHEN 4 THEN concat(p_size, '+*') WHEN 5 THEN 'Infinity' WHEN 6 THEN '0x1F' WHEN 7 THEN p_brand END AS t FROM part")
def derive_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", trim(F.expr(_RAW)).alias("t"))


@query("derive_fold", "SELECT doc_id, md5(lower(strip_accents(text))) AS folded FROM documents")
def derive_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(fold(F.col("text")).cast("binary")).alias("folded"))


@query("reverse_hash", "SELECT p_partkey, reverse(p_name) AS reversed, substr(sha256(p_name), 1, 16) AS hash FROM part")
def reverse_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .functions.normalize import content_hash

    return table(spark, sf_dir, "part").select("p_partkey", F.reverse("p_name").alias("reversed"), content_hash(F.col("p_name")).alias("hash"))


_COUNTED = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


@query("infer_cardinality", " UNION ALL ".join(f"SELECT '{c}' AS field, count(DISTINCT {c}) AS \"distinct\" FROM orders" for c in _COUNTED))
def infer_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infer.exact_cardinality(table(spark, sf_dir, "orders"), list(_COUNTED))


@query("infer_enum", " UNION ALL ".join(f"SELECT '{c}' AS field, array_to_string(list_sort(list(DISTINCT {c})), ',') AS \"values\" FROM orders" for c in ("o_orderstatus", "o_orderpriority")))
def infer_enum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third field has too many values to be listed."""
    return infer.small_sets(table(spark, sf_dir, "orders").withColumn("many", F.col("o_orderkey").cast("string")), ["o_orderstatus", "o_orderpriority", "many"])


@query("shape_url", "SELECT count(url) AS n, count(CASE WHEN regexp_matches(url, '^https?://\\S+$') THEN 1 END) AS urls, 0 AS uuids FROM pages")
def shape_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infer.shape_shares(table(spark, sf_dir, "pages"), "url")


@query("percentile_bytes", "SELECT CAST(quantile_disc(strlen(text), 0.95) AS BIGINT) AS p95, CAST(max(strlen(text)) AS BIGINT) AS largest, CAST(sum(strlen(text)) AS BIGINT) AS total, count(*) AS records FROM documents")
def percentile_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = table(spark, sf_dir, "documents").select(F.octet_length("text").cast("bigint").alias("n"))
    return sized.agg(F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY n)").cast("bigint").alias("p95"), F.max("n").alias("largest"), F.sum("n").alias("total"), F.count("*").alias("records"))


@query("occurrences", "SELECT o_custkey AS value, count(*) AS n FROM orders GROUP BY 1")
def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("value")).agg(F.count("*").alias("n"))


def queries() -> dict[str, Query]:
    from . import surface_queries  # noqa: F401  it registers its own

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delivered orders of a price range, dearest first."""
    return find(table(spark, sf_dir, "orders"), ORDERS, {"o_orderstatus": {"equals": "F"}, "o_totalprice": {"gte": 100000, "lte": 200000}}, {"o_totalprice": "desc"}, 20)
