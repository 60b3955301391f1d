"""Behaviour around a search that SQL says little of: what is collected, how many jobs look up, swaps that fail, estimates from samples."""

import random

import pytest

from blockquery import build as building
from blockquery.build import build, recover
from blockquery.client import Collection, connect
from blockquery.errors import EngineError
from blockquery.operators import blocks, infer
from blockquery.operators.derive import derive
from blockquery.plans import planner
from blockquery.schema import CollectionSchema, Field, resolve
from blockquery.sources.readers import _matcher, read_records

SCHEMA = CollectionSchema("k", {"k": Field("k", "number"), "id": Field("id", "number", indexed=True), "t": Field("t", "string", indexed=True, multi=True)}, "id")


def frame(spark, n):
    return spark.range(n).selectExpr("id div 2 AS k", "id", "array(concat('a', id % 3), concat('b', id % 5)) AS t")


def test_an_offset_collects_the_page_only(spark, tmp_path, monkeypatch):
    build(frame(spark, 60_000), SCHEMA, str(tmp_path / "c"), block_bytes=1 << 16)
    c = connect(spark, str(tmp_path / "c"))
    held = []
    plain = Collection._plain
    monkeypatch.setattr(Collection, "_plain", lambda self, rows: held.append(len(rows)) or plain(self, rows))
    for where in (None, {"t": {"some": "a1"}}):
        matching = [i for i in range(60_000) if where is None or i % 3 == 1]
        for order in (None, {"k": "desc"}):
            for offset in (0, 7, 5_000, 19_990, 59_990, 10**6):
                found = c.find_many(where, order, 15, offset)
                own = sorted(matching, key=lambda i: (i // 2 if order is None else -(i // 2), i))[offset : offset + 15]
                assert [r["id"] for r in found.records] == own and found.has_more == (len(matching) > offset + 15)
                assert held[-1] <= 15
    by_id = c.find_many({"t": {"some": "a1"}}, {"id": "desc"}, 5, 19_000)
    assert [r["id"] for r in by_id.records] == sorted((i for i in range(60_000) if i % 3 == 1), reverse=True)[19_000:19_005]


def test_many_small_blocks_take_few_tasks(spark, tmp_path):
    """F4 to F9: beyond RANGES, a range partition holds several blocks; these are as many and as large as asked for, no run is split and none overlap."""
    schema = CollectionSchema("k", {"k": Field("k", "number", nullable=True), "id": Field("id", "number", indexed=True)}, "id")
    # runs of two, one run larger than a block, nulls at the end
    df = spark.range(20_000).selectExpr("CASE WHEN id % 100 = 7 THEN NULL WHEN id BETWEEN 3000 AND 3300 THEN 1500 ELSE id div 2 END AS k", "id").repartition(5)
    cut = blocks.cut_blocks(df, schema, 1 << 10)
    assert cut.rdd.getNumPartitions() == blocks.RANGES
    places: dict = {}
    for part in cut.rdd.glom().collect():
        assert [r[blocks.BLOCK] for r in part] == sorted(r[blocks.BLOCK] for r in part)
        for r in part:
            places.setdefault(r[blocks.BLOCK], []).append((r["k"] is None, r["k"] or 0, r["id"]))
    own = [places[b] for b in sorted(places)]
    assert sum(own, []) == sorted((r["k"] is None, r["k"] or 0, r["id"]) for r in df.collect())
    assert all(a[-1][:2] < b[0][:2] for a, b in zip(own, own[1:]))
    sizes = sorted(map(len, own))
    assert sizes[-1] >= 301 and 350 < len(own) < 700 and sizes[len(own) // 2] <= 55  # 26 bytes a record: 510 blocks of 39
    path = str(tmp_path / "c")
    manifest = build(df, schema, path, block_bytes=1 << 10)
    c = connect(spark, path)
    assert manifest["blocks"] == len(own) and manifest["values"] == df.select("k").distinct().count() - 1
    assert c.get(4321)["k"] == 2160 and c.count({"k": {"equals": 1500}}, exact=True).count == df.where("k = 1500").count()
    found = c.find_many(None, None, 20, 9_990).records
    assert [r["id"] for r in found] == [x[2] for x in sum(own, [])[9_990:10_010]]


def test_small_blocks_keep_nulls_before_absent_keys(spark):
    schema = CollectionSchema("k", {"k": Field("k", "number", nullable=True, absent=True), "id": Field("id", "number")}, "id")
    df = spark.range(8000).selectExpr("IF(id % 40 < 2, NULL, id) AS k", "id", "IF(id % 40 = 0, array('id'), array('k', 'id')) AS _keys").repartition(3)
    rank = lambda r: (r["k"] is None, "k" not in r["_keys"], r["k"] or 0)
    cut = blocks.cut_blocks(df, schema, 1 << 9)
    got = sorted((r[blocks.BLOCK], i, rank(r)) for i, r in enumerate(cut.collect()))
    assert cut.rdd.getNumPartitions() <= blocks.RANGES < len({x[0] for x in got}) and [x[2] for x in got] == sorted(map(rank, df.collect()))
    ends = [{x[0] for x in got if x[2][:2] == kind} for kind in ((False, False), (True, False), (True, True))]
    assert not (ends[0] & ends[1] or ends[1] & ends[2])


def test_folders_are_listed_by_few_tasks(spark, tmp_path):
    """F4 to F9: not one for each block; the session's setting is as it was."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before, tracker = spark.conf.get(name), spark.sparkContext.statusTracker()
    build(frame(spark, 20_000), SCHEMA, str(tmp_path / "c"), block_bytes=1 << 12)
    c, seen = connect(spark, str(tmp_path / "c")), set(tracker.getJobIdsForGroup(None))
    assert c.manifest["blocks"] > 2 * blocks.LISTERS and c.stored().inputFiles()
    stages = [tracker.getStageInfo(i) for j in set(tracker.getJobIdsForGroup(None)) - seen for i in tracker.getJobInfo(j).stageIds]
    assert stages and max(x.numTasks for x in stages if x) <= blocks.LISTERS and spark.conf.get(name) == before


def test_a_rebuild_is_seen_without_collecting(spark, monkeypatch):
    """records on both sides of a rebuild are counted where they lie."""
    from blockquery import surface_queries

    held, plain = [], Collection._plain
    monkeypatch.setattr(Collection, "_plain", lambda self, rows: held.append(len(rows)) or plain(self, rows))
    customers = spark.range(3000).selectExpr("id AS c_custkey", "format_string('Customer#%09d', id) AS c_name", "CAST(id % 25 AS int) AS c_nationkey", "CAST(id AS double) AS c_acctbal", "IF(id % 5 = 0, 'BUILDING', 'OTHER') AS c_mktsegment")
    monkeypatch.setattr(surface_queries, "table", lambda *_: customers)
    row = surface_queries.rebuild_is_seen(spark, "").first()
    assert (row["before"], row["after_"], row["left_over"]) == (600, 3000, 0) and sum(held) == 0


def test_every_value_of_a_list_in_one_look_up(spark, tmp_path, monkeypatch):
    build(frame(spark, 3000), SCHEMA, str(tmp_path / "c"), block_bytes=1 << 14)
    c, asked = connect(spark, str(tmp_path / "c")), []
    own = planner._in_all
    monkeypatch.setattr(planner, "_in_all", lambda table, values: asked.append(values) or own(table, values))
    got = c.query({"t": {"hasEvery": ["a1", "b2", "a1"]}}).count()
    assert got == sum(i % 3 == 1 and i % 5 == 2 for i in range(3000)) and asked == [["a1", "b2"]]


def test_a_swap_that_fails_leaves_the_old_collection(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "c")
    build(frame(spark, 100), SCHEMA, path, block_bytes=1 << 20)
    rename, calls = building._rename, []

    def failing(fs, source, to):
        calls.append(str(to))
        if str(to).endswith("/c"):
            raise EngineError("DEPLOY_INTEGRITY", "no")
        rename(fs, source, to)

    monkeypatch.setattr(building, "_rename", failing)
    with pytest.raises(EngineError):
        build(frame(spark, 200), SCHEMA, path, block_bytes=1 << 20)
    assert connect(spark, path).count().count == 100 and any(x.endswith("__old") for x in calls)
    (tmp_path / "c").rename(tmp_path / "c__old")  # cut short between the two renames
    assert recover(spark, path) and not recover(spark, path) and connect(spark, path).count().count == 100


def test_shares_from_a_sample():
    """Within five points of the mean over values, however they lie."""
    r, n, blocks = random.Random(1), 100_000, 100
    cases = {
        "scattered": [r.randrange(1000) for _ in range(n)],
        "clustered": [i // 100 for i in range(n)],
        "rare": [r.randrange(50_000) for _ in range(n)],
        "few": [r.randrange(20) for _ in range(n)],
        "windows": [(i + r.randint(-3000, 3000)) // 500 for i in range(n)],
        "both": [i // 100 if i % 2 else r.randrange(1000) + 5000 for i in range(n)],
        "unique": [n - i for i in range(n)],
    }
    for name, values in cases.items():
        where = {}
        for i, v in enumerate(values):
            where.setdefault(v, set()).add(i * blocks // n)
        truth = sum(map(len, where.values())) / len(where) / blocks
        drawn = [{"s": i, "v": values[i]} for i in r.sample(range(n), 2000)]
        assert abs(infer.estimated_share(drawn, n, "s", "v", blocks, len(where)) - truth) < 0.05, name
        assert infer.estimated_share([{"s": i, "v": v} for i, v in enumerate(values)], n, "s", "v", blocks) == pytest.approx(truth)
    assert infer.estimated_share([{"s": 1, "v": None}], 10, "s", "v", 5) is None and infer.estimated_share([], 0, "s", "v", 5) is None


def test_near_unique_fields_are_not_unique(spark):
    rows = [(i, i if i != 77 else 76, f"x{i}") for i in range(5000)]
    stats = infer.column_stats(spark.createDataFrame(rows, "id int, almost_id int, t string"))
    assert stats["id"].unique and stats["t"].unique and not stats["almost_id"].unique
    lines = spark.createDataFrame([(f'{{"id": {a}, "almost_id": {b}}}',) for a, b, _ in rows], "value string")
    found = infer.field_stats(lines)
    assert found["id"].unique and not found["almost_id"].unique and infer.recommend_pk(found) == "id"


def test_dates_and_addresses(spark):
    rows = [("2005-01-18", "2005-01-18 10:00", "2005-01-18T10:00:00+0000", "2005-01-18T10:00:00.5+02:00", "s3://b/x", "mailto:x")]
    stats = infer.column_stats(spark.createDataFrame(rows, "a string, b string, c string, d string, e string, f string"))
    assert [s.kind for s in stats.values()] == ["date", "string", "string", "date", "string", "string"]
    assert stats["e"].shape == "url" and stats["f"].shape is None


def test_folded_lists_keep_their_elements(spark):
    fields = {"id": Field("id", "number"), "l": Field("l", "string", indexed=True, multi=True), "f": Field("f", "string", indexed=True, multi=True, absent=True, derive_from="l", derive_using="fold")}
    df = spark.createDataFrame([(1, ["É\x00A", None, "b"]), (2, []), (3, None)], "id int, l array<string>")
    assert [r["f"] for r in derive(df, CollectionSchema("id", fields)).orderBy("id").collect()] == [["e\x00a", "b"], None, None]


def test_lists_have_no_form_in_cells(spark, tmp_path):
    (tmp_path / "x.csv").write_text("id,t\n1,a;b\n")
    with pytest.raises(Exception, match="is no list"):
        read_records(spark, str(tmp_path / "x.csv"), "csv", CollectionSchema("id", {"id": Field("id", "number"), "t": Field("t", "string", indexed=True, multi=True)})).collect()
    with pytest.raises(EngineError, match="brotli"):
        resolve({"compression": "brotli", "schema": {"sortField": "a", "fields": {"a": {"kind": "string"}}}})


def test_patterns():
    for pattern, yes, no in (("/a/**/*.x", ("/a/b.x", "/a/b/c/d.x"), ("/a/b.y", "/b/a/b.x")), ("/a/**", ("/a/b", "/a/b/c"), ("/b",)), ("/a/{b,c}/**/?.z", ("/a/b/q.z", "/a/c/d/q.z"), ("/a/d/q.z", "/a/b/qq.z")), ("/a+/**/x", ("/a+/x",), ("/aa/x",))):
        assert all(_matcher(pattern).fullmatch(x) for x in yes) and not any(_matcher(pattern).fullmatch(x) for x in no)
