"""Queries of a built collection."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .build import read_text
from .errors import EngineError
from .operators.blocks import BLOCK, HIDDEN, INTERNAL, listing
from .plans import planner
from .plans.find import OrderBy, order_columns, order_keys, page
from .operators.indexes import TEXT_TABLES
from .plans.planner import Metadata, candidate_sets, candidates, named
from .plans.where import KEYS, REST, assert_prunes, check, compact, predicate
from .schema import FORMAT_VERSION, CollectionSchema

MAX_RESULTS = 10_000
#: Blocks of the first step of a walk; each further step reads twice as many.
WALK = 4
#: Rows that a top-k may gather.
MAX_TOP_K = 100_000


#: Up to so many blocks, block table and zonemap are kept in the driver; and for so many collections.
LOCAL_BLOCKS, MOST_OPENED = 10_000, 32


@dataclass
class _Opened:
    metadata: Metadata
    records: DataFrame | None = None


_OPENED: dict[tuple[str, str, str], _Opened] = {}


@dataclass
class Found:
    """records, whether more follow the page, and how many match in all where that is known without another read."""

    records: list[dict[str, Any]]
    has_more: bool
    total: int | None = None


@dataclass
class Count:
    count: int
    exact: bool


def merge_by_pk(frames: list[DataFrame], pk: str) -> DataFrame:
    """The union of several queries' records, each once: what there is in place of OR. Of records that share a key and differ, the least as JSON stays."""
    both = reduce(DataFrame.unionByName, frames)
    whole = F.struct(*(F.col(f"`{c}`") for c in both.columns))
    return both.groupBy(F.col(f"`{pk}`").alias("_pk")).agg(F.min_by(whole, F.to_json(whole)).alias("_row")).select("_row.*")


class Collection:
    def __init__(self, spark: SparkSession, path: str, max_results: int = MAX_RESULTS):
        self.spark, self.path, self.max_results = spark, path.rstrip("/"), max_results
        self._load()

    def _load(self) -> None:
        text = read_text(self.spark, f"{self.path}/manifest.json")
        try:
            manifest = json.loads(text)
        except json.JSONDecodeError:
            raise EngineError("CORRUPT_DATA", "the manifest is no JSON") from None
        if manifest.get("format_version") != FORMAT_VERSION:
            raise EngineError("FORMAT_VERSION", f"the collection has format {manifest.get('format_version')}, this engine reads {FORMAT_VERSION}; build it again")
        self.manifest, self.schema = manifest, CollectionSchema.from_json(manifest["schema"])
        self._columns = T.StructType.fromJson(manifest["columns"])
        columns, folder = manifest["table_columns"], {t: f"index/table={t}" for t in TEXT_TABLES}

        def table(name: str) -> DataFrame | None:
            # with its columns at hand, opening a table starts no job
            if name in manifest["without_rows"]:
                return self.spark.createDataFrame([], T.StructType.fromJson(columns[name]))
            return self.spark.read.schema(T.StructType.fromJson(columns[name])).parquet(f"{self.path}/meta/{folder.get(name, name)}") if name in columns else None

        # tables and the list of files that an earlier client of the same manifest has opened
        self._key = (self.spark.sparkContext.applicationId, self.path, text)
        self._opened = _OPENED.get(self._key)
        if self._opened is not None:
            self.metadata = self._opened.metadata
            return
        with self._errors():
            self.metadata = Metadata(table("blocks"), table("zonemap"), table("postings"), table("reversed"), table("trigrams"), table("empty_blocks"), {f.name: f.dataType.simpleString() for f in self._columns})
            if manifest["blocks"] <= LOCAL_BLOCKS:
                # a row for each block, and for each field of it: what the driver holds it looks up without a job
                self.metadata.blocks = self._local(self.metadata.blocks)
                self.metadata.zonemap = self._local(self.metadata.zonemap)
        while len(_OPENED) >= MOST_OPENED:
            del _OPENED[next(iter(_OPENED))]
        self._opened = _OPENED[self._key] = _Opened(self.metadata)

    def _local(self, table: DataFrame | None) -> DataFrame | None:
        return table if table is None else self.spark.createDataFrame(table.collect(), table.schema)

    @contextmanager
    def _errors(self) -> Iterator[None]:
        try:
            yield
        except (PySparkException, Py4JJavaError) as e:
            text = str(e)
            if "cancelled" in text.lower() or "canceled" in text.lower():
                raise EngineError("ABORTED", "the query was cancelled") from None
            if any(m in text for m in ("PATH_NOT_FOUND", "FILE_NOT_EXIST", "FileNotFoundException", "UNABLE_TO_INFER_SCHEMA")):
                raise EngineError("DEPLOY_INTEGRITY", "a file of the collection is missing") from None
            if "FAILED_READ_FILE" in text or "is not a Parquet file" in text or "CANNOT_READ_FILE" in text:
                raise EngineError("CORRUPT_DATA", "a file of the collection cannot be read") from None
            raise

    def _fresh(self, run: Callable[[], Any]) -> Any:
        """Runs a query; where files have gone because the collection was built again, once more with its new manifest."""
        try:
            with self._errors():
                return run()
        except EngineError as e:
            if e.code != "DEPLOY_INTEGRITY":
                raise
            self.spark.catalog.refreshByPath(self.path)
            _OPENED.pop(self._key, None)
            self._load()
            with self._errors():
                return run()

    # --- plans -----------------------------------------------------------------------------------

    def stored(self, blocks: list[int] | None = None) -> DataFrame:
        """The records of all or of some blocks. Of up to half of them, only their own folders are listed, and each must have a file."""
        root = f"{self.path}/{self.manifest['data']}"
        reader = self.spark.read.schema(self._columns).option("basePath", root)
        if blocks is not None and not blocks:
            return self.spark.createDataFrame([], self._columns)
        if blocks is None or 2 * len(blocks) > self.manifest["blocks"]:
            if self._opened.records is None:  # its list of files is kept
                with listing(self.spark):
                    self._opened.records = reader.parquet(root)
            return self._opened.records if blocks is None else self._opened.records.where(F.col(BLOCK).isin(*blocks))
        with listing(self.spark):
            df = reader.parquet(*(f"{root}/{BLOCK}={b}" for b in blocks))
        there = {int(m[1]) for m in (re.search(rf"/{BLOCK}=(\d+)/", f) for f in df.inputFiles()) if m}
        if there != set(blocks):
            raise EngineError("DEPLOY_INTEGRITY", f"{len(set(blocks) - there)} blocks have no file")
        return df

    def _checked(self, where: dict[str, Any] | None) -> dict[str, dict[str, Any]]:
        own = compact(where)
        check(own, self.schema)
        return own

    def _match(self, where: dict[str, dict[str, Any]]) -> tuple[DataFrame, list[int] | None]:
        found, blocks = None, None
        if self.manifest["blocks"] <= planner.LITERAL_BLOCKS:
            blocks = self._candidates(where)
        else:
            found = candidates(where, self.schema, self.metadata)
            blocks = None if found is None else named(found)
        records = self.stored(blocks)
        if found is not None and blocks is None:
            # block numbers: a few bytes for each block of the collection
            records = records.join(F.broadcast(found.distinct()), BLOCK, "left_semi")
        return records.where(predicate(where, KEYS in records.columns)), blocks

    def _candidates(self, where: dict[str, dict[str, Any]]) -> list[int] | None:
        """The candidate blocks of a collection of few blocks: sets from tables in the driver need no job, and meet here."""
        sets = [{r[0] for r in found.select(BLOCK).collect()} for found in candidate_sets(where, self.schema, self.metadata)]
        return sorted(set.intersection(*sets)) if sets else None

    def query(self, where: dict[str, Any] | None = None, order_by: OrderBy = None, limit: int | None = None, offset: int = 0, columns: list[str] | None = None) -> DataFrame:
        """The records as a DataFrame, which nothing has read yet: no ceiling, for what comes next may narrow further."""
        own = self._checked(where)
        assert_prunes(own, self.schema)
        df = page(self._match(own)[0], self.schema, order_by, limit, offset)
        return df.select(*columns) if columns else df.drop(*INTERNAL)

    # --- the four methods ------------------------------------------------------------------------

    def find_many(self, where: dict[str, Any] | None = None, order_by: OrderBy = None, limit: int | None = None, offset: int = 0, scan: str | None = None, tag: str | None = None) -> Found:
        for name, v in (("limit", limit), ("offset", offset)):
            if v is not None and (not isinstance(v, int) or isinstance(v, bool) or v < 0):
                raise ValueError(f"{name} must not be negative")
        if limit is not None and limit > self.max_results:
            raise EngineError("LIMIT_EXCEEDED", f"the limit is above {self.max_results}")
        own, keys = self._checked(where), order_keys(order_by)
        if scan is not None:
            self._assert_scan(scan, limit, keys)
        else:
            assert_prunes(own, self.schema)
        if tag is None:
            return self._fresh(lambda: self._find(own, keys, limit, offset))
        # the context's tags: a session's own can be interrupted by the thread that set them only
        self.spark.sparkContext.addJobTag(tag)
        try:
            return self._fresh(lambda: self._find(own, keys, limit, offset))
        finally:
            self.spark.sparkContext.removeJobTag(tag)

    def cancel(self, tag: str) -> None:
        """Stops the queries that run under a tag, from any thread; they end with ABORTED."""
        self.spark.sparkContext.cancelJobsWithTag(tag)

    def _assert_scan(self, scan: str, limit: int | None, keys: list[tuple[str, str]]) -> None:
        if scan != "block-order":
            raise EngineError("CONFIG", f"unknown scan {scan!r}")
        if limit is None or self._walk(limit, keys) is None:
            raise EngineError("NEEDS_PRUNING", "a block-order scan needs a limit, and the stored order or its reverse")

    def _walk(self, limit: int | None, keys: list[tuple[str, str]]) -> str | None:
        """The direction in which blocks can be read one after the other until a page is full."""
        if limit is None:
            return None
        if not keys:
            return "asc"
        missing = self.metadata.blocks.where("n_null + n_absent > 0")
        if len(keys) > 1 or keys[0][0] != self.schema.sort_field or not missing.isEmpty():
            return None  # an explicit order puts missing values first, the stored one last
        return keys[0][1]

    def _find(self, where: dict, keys: list[tuple[str, str]], limit: int | None, offset: int) -> Found:
        if offset <= MAX_TOP_K:
            return self._page(where, keys, limit, offset)
        # a top-k of so many rows would be kept in one place: sort and skip instead
        name = "spark.sql.execution.topKSortFallbackThreshold"
        before = self.spark.conf.get(name)
        self.spark.conf.set(name, MAX_TOP_K)
        try:
            return self._page(where, keys, limit, offset)
        finally:
            self.spark.conf.set(name, before)

    def _page(self, where: dict, keys: list[tuple[str, str]], limit: int | None, offset: int) -> Found:
        df, blocks = self._match(where)
        direction = self._walk(limit, keys)
        columns = order_columns(df, self.schema, keys)
        if direction is not None and self.manifest["blocks"] > WALK:
            if blocks is None and self.manifest["blocks"] <= LOCAL_BLOCKS:
                blocks = sorted(r[0] for r in self.metadata.blocks.select(BLOCK).collect())
            elif blocks is None:
                narrow = candidates(where, self.schema, self.metadata)
                blocks = sorted(r[0] for r in (self.metadata.blocks if narrow is None else narrow).select(BLOCK).collect())  # a number for each block
            if offset:
                return self._skipped(df, where, columns, direction, limit, offset)
            return self._walked(df, blocks, columns, direction, limit)
        ordered = df.orderBy(*columns)
        ordered = ordered.offset(offset) if offset else ordered
        if limit is not None:
            rows = ordered.limit(limit + 1).collect()
            more = len(rows) > limit
            return Found(self._plain(rows[:limit]), more, None if more or (not rows and offset) else offset + len(rows))
        rows = ordered.limit(self.max_results + 1).collect()
        if len(rows) > self.max_results:
            raise EngineError("LIMIT_EXCEEDED", f"more than {self.max_results} records match; set a limit")
        return Found(self._plain(rows), False, None if not rows and offset else offset + len(rows))

    def _walked(self, df: DataFrame, blocks: list[int], columns: list[Column], direction: str, limit: int) -> Found:
        left, step, rows = list(blocks if direction == "asc" else blocks[::-1]), WALK, []
        while left and len(rows) <= limit:
            batch, left = left[:step], left[step:]
            step *= 2
            rows += df.where(F.col(BLOCK).isin(*batch)).orderBy(*columns).limit(limit + 1 - len(rows)).collect()
        more = len(rows) > limit
        return Found(self._plain(rows[:limit]), more, None if more or left else len(rows))

    def _skipped(self, df: DataFrame, where: dict, columns: list[Column], direction: str, limit: int, offset: int) -> Found:
        """A page beyond an offset: matches are counted by block (from metadata without a filter), and only the blocks of the page are read for records."""
        counts = (df.groupBy(BLOCK).agg(F.count("*").alias("count")) if where else self.metadata.blocks).select(BLOCK, "count")
        held = sorted((r[0], r[1]) for r in counts.collect())  # two numbers for each block
        total, before, chosen, reached = sum(n for _, n in held), 0, [], 0
        for block, n in held if direction == "asc" else held[::-1]:
            if reached + n <= offset:
                before += n
            elif reached < offset + limit:
                chosen.append(block)
            reached += n
        if not chosen:
            return Found([], total > offset + limit, total)
        rows = df.where(F.col(BLOCK).isin(*chosen)).orderBy(*columns).offset(offset - before).limit(limit).collect()
        return Found(self._plain(rows), total > offset + limit, total)

    def _plain(self, rows: list[Row]) -> list[dict[str, Any]]:
        """Records as dictionaries; a key that was absent stays so, and one that the schema does not declare is there again."""
        out = []
        for r in rows:
            d = r.asDict(recursive=True)
            keys = set(d[KEYS]) if KEYS in d else None
            own = {k: v for k, v in d.items() if k not in HIDDEN and (keys is None or v is not None or k in keys)}
            out.append(own | json.loads(d[REST]) if d.get(REST) else own)
        return out

    def count(self, where: dict[str, Any] | None = None, exact: bool = False) -> Count:
        """At most so many records match, from metadata alone. Exact for no filter and no candidate, or if asked for, which reads."""
        own = self._checked(where)
        if not own:
            return Count(self.manifest["records"], True)
        if exact:
            return Count(self._fresh(lambda: self._match(own)[0].count()), True)

        def bound() -> int:
            if self.manifest["blocks"] <= LOCAL_BLOCKS:
                held = self._candidates(own)
                held = None if held is None else set(held)
                rows = self.metadata.blocks.select(BLOCK, "count").collect()
                return sum(r["count"] for r in rows) if held is None else sum(r["count"] for r in rows if r[BLOCK] in held)
            found = candidates(own, self.schema, self.metadata)
            blocks = self.metadata.blocks
            return (blocks if found is None else blocks.join(found.distinct(), BLOCK, "left_semi")).agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]

        n = self._fresh(bound)
        return Count(n, n == 0)

    def get(self, key: Any) -> dict[str, Any] | None:
        if self.schema.pk is None:
            raise EngineError("CONFIG", "the collection has no primary key")
        found = self._checked({self.schema.pk: {"equals": key}})

        def first() -> list[dict[str, Any]]:
            df, _ = self._match(found)
            return self._plain(df.orderBy(BLOCK, *order_columns(df, self.schema, [])).limit(1).collect())

        return next(iter(self._fresh(first)), None)

    def get_schema(self) -> dict[str, Any]:
        return self.schema.describe()


def connect(spark: SparkSession, path: str, max_results: int = MAX_RESULTS) -> Collection:
    return Collection(spark, path, max_results)
