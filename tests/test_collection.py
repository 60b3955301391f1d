import json
import random

import pytest

from blockquery.build import build
from blockquery.client import connect, merge_by_pk
from blockquery.errors import DriftError, EngineError
from blockquery.operators.blocks import BLOCK, exact_cut, greedy_cut
from blockquery.plans.find import find
from blockquery.plans.planner import candidates
from blockquery.plans.where import compact
from blockquery.schema import CollectionSchema, Field, validate
from blockquery.sources.readers import read_records
from pyspark.sql import functions as F

from .fixtures import COLOR_SCHEMA, COLORS, MOVIE_ROWS, MOVIE_SCHEMA, STATS, TAGLINE_SCHEMA, TAGLINES, ndjson, titles


def built(spark, tmp_path, rows, schema, block_bytes=60, name="c"):
    records = read_records(spark, ndjson(tmp_path / f"{name}.ndjson", rows), "ndjson", schema)
    build(records, schema, str(tmp_path / name), block_bytes=block_bytes)
    return connect(spark, str(tmp_path / name))


@pytest.fixture(scope="module")
def movies(spark, tmp_path_factory):
    return built(spark, tmp_path_factory.mktemp("movies"), MOVIE_ROWS, MOVIE_SCHEMA)


def blocks_of(c, where):
    found = candidates(compact(where), c.schema, c.metadata)
    return None if found is None else {r[0] for r in found.collect()}


def test_blocks_do_not_overlap(movies):
    rows = movies.metadata.blocks.orderBy(BLOCK).collect()
    assert len(rows) > 3 and sum(r["count"] for r in rows) == 10 == movies.manifest["records"]
    assert all(a["hi"] < b["lo"] for a, b in zip(rows, rows[1:]))


def test_find_many(movies):
    assert sorted(titles(movies.find_many({"year": {"equals": 2000}}).records)) == ["Gladiator", "Memento", "Snatch"]
    assert titles(movies.find_many({"title": {"contains": "Matr"}}).records) == ["The Matrix", "The Matrix Reloaded"]
    assert titles(movies.find_many({"title": {"endsWith": "ption"}, "rating": {"gte": 8.8}}).records) == ["Inception"]
    assert movies.find_many({"year": {"in": []}}).records == []
    page = movies.find_many({"year": {"gte": 2000}}, limit=3, offset=1)
    assert titles(page.records) == ["Memento", "Snatch", "The Matrix Reloaded"] and page.has_more
    last = movies.find_many({"year": {"gte": 2000}}, limit=20)
    assert not last.has_more and last.total == 9 and len(last.records) == 9
    assert titles(movies.find_many(order_by={"year": "desc"}, limit=2).records) == ["Parasite", "Interstellar"]
    assert titles(movies.find_many({"year": {"gte": 2000}}, {"rating": "desc"}, limit=2).records) == ["The Dark Knight", "Inception"]
    assert set(movies.find_many({"year": {"equals": 2019}}).records[0]) == {"year", "title", "rating"}


def test_pruning(movies):
    n = movies.manifest["blocks"]
    assert len(blocks_of(movies, {"year": {"equals": 2019}})) == 1
    assert blocks_of(movies, {"year": {"lt": 1900}}) == set()
    assert 0 < len(blocks_of(movies, {"title": {"endsWith": "Knight"}})) < n
    assert 0 < len(blocks_of(movies, {"title": {"contains": "epti"}})) < n
    assert blocks_of(movies, {"title": {"contains": "ep"}}) is None and blocks_of(movies, {"title": {"not": "x"}}) is None
    assert len(movies.query({"year": {"equals": 2019}}).inputFiles()) == 1 < len(movies.stored().inputFiles())


def test_many_candidates_are_joined(movies, monkeypatch):
    monkeypatch.setattr("blockquery.plans.planner.LITERAL_BLOCKS", 2)
    df = movies.query({"year": {"gte": 2000, "lte": 2014}})
    assert df.count() == 8 and "dynamicpruning" in df._jdf.queryExecution().optimizedPlan().toString().lower()
    assert titles(movies.find_many({"year": {"gte": 2003}}, limit=2, offset=1).records) == ["The Dark Knight", "Inception"]


def test_count_and_get(movies):
    assert (movies.count().count, movies.count().exact) == (10, True)
    bound = movies.count({"rating": {"gte": 8.8}})
    assert bound.count >= 2 and not bound.exact
    assert (movies.count({"rating": {"gte": 8.8}}, exact=True).count, movies.count({"year": {"gt": 3000}})) == (2, type(bound)(0, True))
    assert movies.get("Snatch")["rating"] == 8.3 and movies.get("Nothing") is None
    assert movies.get_schema()["fields"]["title"]["pruning"] == ["equals", "in", "startsWith", "endsWith", "contains"]


def test_refusals(spark, movies, tmp_path):
    def code(f):
        with pytest.raises(EngineError) as e:
            f()
        return e.value.code

    small = connect(spark, movies.path, max_results=4)
    assert code(lambda: small.find_many(limit=5)) == "LIMIT_EXCEEDED"
    assert code(lambda: small.find_many()) == "LIMIT_EXCEEDED"
    assert len(small.find_many(limit=4).records) == 4
    assert code(lambda: movies.find_many({"title": {"not": "x"}})) == "NEEDS_PRUNING"
    assert code(lambda: movies.find_many({"title": {"not": "x"}}, scan="block-order")) == "NEEDS_PRUNING"
    assert code(lambda: movies.find_many({"title": {"not": "x"}}, {"title": "asc"}, 3, scan="block-order")) == "NEEDS_PRUNING"
    assert code(lambda: movies.find_many(limit=3, scan="sideways")) == "CONFIG"
    assert titles(movies.find_many({"title": {"not": "The Matrix"}}, limit=2, scan="block-order").records) == ["Gladiator", "Memento"]
    assert code(lambda: connect(spark, str(tmp_path / "none"))) == "CONFIG"
    with pytest.raises(ValueError):
        movies.find_many(limit=-1)


def test_versions_and_lost_files(spark, tmp_path):
    c = built(spark, tmp_path, MOVIE_ROWS, MOVIE_SCHEMA)
    manifest = tmp_path / "c/manifest.json"
    good = manifest.read_text()
    for text, code in ((json.dumps(json.loads(good) | {"format_version": 9}), "FORMAT_VERSION"), ("{", "CORRUPT_DATA")):
        (tmp_path / "c/.manifest.json.crc").unlink(missing_ok=True)
        manifest.write_text(text)
        with pytest.raises(EngineError) as e:
            connect(spark, str(tmp_path / "c"))
        assert e.value.code == code
    manifest.write_text(good)
    for p in (tmp_path / "c").glob("blocks-*/_block=*/*.parquet"):
        p.unlink()
    with pytest.raises(EngineError) as e:
        c.find_many({"year": {"equals": 2000}})
    assert e.value.code in ("DEPLOY_INTEGRITY", "CORRUPT_DATA")


def test_rebuilt_underneath(spark, tmp_path):
    c = built(spark, tmp_path, MOVIE_ROWS, MOVIE_SCHEMA)
    assert len(c.find_many({"year": {"equals": 2000}}).records) == 3
    built(spark, tmp_path, [*MOVIE_ROWS, {"year": 2000, "title": "Cast Away", "rating": 7.8}], MOVIE_SCHEMA)
    assert len(c.find_many({"year": {"equals": 2000}}).records) == 4
    assert not (tmp_path / "c__old").exists() and not (tmp_path / "c__staged").exists()


def test_failed_build_leaves_the_old(spark, tmp_path):
    built(spark, tmp_path, MOVIE_ROWS, MOVIE_SCHEMA)
    with pytest.raises(DriftError) as e:
        built(spark, tmp_path, [{"year": 1, "title": None, "rating": 1.0}, {"year": "x", "title": "t", "rating": 2}, {"year": 3, "title": "u"}], MOVIE_SCHEMA)
    assert {(r["field"], r["fault"], r["records"]) for r in e.value.report} == {("title", "null", 1), ("year", "kind", 1), ("rating", "missing", 1)}
    assert connect(spark, str(tmp_path / "c")).count().count == 10


def test_null_and_absent(spark, tmp_path):
    c = built(spark, tmp_path, TAGLINES, TAGLINE_SCHEMA)
    by = lambda **f: titles(c.find_many({"year": {"gte": 1900}, "tagline": f}).records)
    assert (by(isNull=True), by(isAbsent=True), sorted(by(exists=False))) == (["Snatch"], ["Gladiator"], ["Gladiator", "Snatch"])
    records = {r["title"]: r for r in c.find_many({"year": {"equals": 2000}}).records}
    assert "tagline" not in records["Gladiator"] and records["Snatch"]["tagline"] is None
    assert titles(c.find_many({"genres": {"some": "Crime"}}).records) == ["Snatch", "The Dark Knight"]


def test_missing_tail(spark, tmp_path):
    rows = [{"title": "Untitled Absent"}, {"year": None, "title": "Untitled Null"}, {"year": 2010, "title": "Inception"}, {"year": 2000, "title": "Gladiator"}]
    schema = validate(CollectionSchema("year", {"year": Field("year", "number", absent=True, nullable=True), "title": Field("title", "string")}))
    for size in (30, 1 << 20):
        c = built(spark, tmp_path, rows, schema, size, f"tail{size}")
        assert titles(c.find_many(limit=10).records) == ["Gladiator", "Inception", "Untitled Null", "Untitled Absent"]
        assert titles(c.find_many(order_by={"year": "asc"}, limit=10).records)[2:] == ["Gladiator", "Inception"]
        assert titles(c.find_many({"year": {"equals": 2000}}).records) == ["Gladiator"]
        assert titles(c.find_many({"year": {"gte": 2005}}).records) == ["Inception"]
        row = c.metadata.blocks.selectExpr("sum(n_null)", "sum(n_absent)").first()
        assert tuple(row) == (1, 1)


def test_lists(spark, tmp_path):
    c = built(spark, tmp_path, COLORS, COLOR_SCHEMA, 1)
    by = lambda **f: sorted(titles(c.find_many({"colors": f}).records))
    assert by(isEmpty=True) == ["also colorless", "colorless"] and by(hasEvery=["W", "U"]) == ["UW", "WU", "WUB"]
    assert by(every={"in": ["W", "U"]}) == ["U", "UW", "W", "WU", "also colorless", "colorless"]
    assert by(hasEvery=["W", "U"], every={"in": ["W", "U"]}) == ["UW", "WU"]
    none = c.count({"colors": {"hasEvery": ["W", "R"]}})
    assert (none.count, none.exact) == (0, True)
    assert len(blocks_of(c, {"colors": {"isEmpty": True}})) == 2


def test_derived(spark, tmp_path):
    rows = [{"name": n, "power": p, "year": y} for n, p, y in STATS]
    fields = {"year": Field("year", "number"), "name": Field("name", "string"), "power": Field("power", "string", indexed=True), "power_num": Field("power_num", "number", indexed=True, absent=True, derive_from="power", derive_using="numeric")}
    schema = validate(CollectionSchema("year", fields))
    c = built(spark, tmp_path, rows, schema)
    got = {r["name"]: r.get("power_num") for r in c.find_many(limit=20).records}
    assert got["Grizzly Bears"] == 2 and got["Impervious Greatwurm"] == 16 and got["Tarmogoyf"] is got["Infinity Elemental"] is got["Angry Mob"] is None
    assert {r["name"] for r in c.find_many({"power_num": {"gte": 8}}).records} == {"Force of Nature", "Impervious Greatwurm", "Ghalta"}
    assert c.find_many({"power_num": {"isAbsent": True}, "year": {"equals": 2007}}).records[0]["name"] == "Tarmogoyf"
    with pytest.raises(EngineError):
        records = read_records(spark, ndjson(tmp_path / "d.ndjson", rows), "ndjson", schema).withColumn("power_num", F.lit(1.0))
        build(records, schema, str(tmp_path / "d"), checked=False)


def test_pruned_equals_brute_force(spark, tmp_path):
    r = random.Random(5)
    words = ["red ring", "red bolt", "blue ring", "blue widget", "green bolt", "Ångström", "zed\U0001f600", "", "ab"]
    rows = []
    for i in range(300):
        row = {"k": r.choice([i // 7, i / 3, -i]), "id": f"id{i:03}", "t": r.choice(words), "n": r.choice([None, r.randint(0, 20), r.random()]), "b": r.random() < 0.3, "d": f"20{r.randint(10, 20)}-0{r.randint(1, 9)}-11", "l": r.sample(["x", "y", "zz", "w w"], r.randint(0, 3))}
        for key in ("k", "l", "n"):
            if r.random() < 0.1:
                del row[key]
        rows.append(row)
    mark = {"absent": True, "nullable": True}
    fields = {"k": Field("k", "number", **mark), "id": Field("id", "string", indexed=True), "t": Field("t", "string", indexed=True, ends_with=True, contains=True), "n": Field("n", "number", indexed=True, **mark), "b": Field("b", "boolean", indexed=True), "d": Field("d", "date", indexed=True), "l": Field("l", "string", indexed=True, multi=True, absent=True)}
    schema = validate(CollectionSchema("k", fields, "id"))
    c = built(spark, tmp_path, rows, schema, 1500)
    assert c.manifest["blocks"] >= 10
    plain = read_records(spark, ndjson(tmp_path / "plain.ndjson", rows), "ndjson", schema).cache()

    def filters():
        number = lambda: r.choice([r.randint(-50, 60), r.random() * 20])
        text = lambda: r.choice([*words, "red", "ring", "e b", "bol", "Å", "\U0001f600"])
        some = {
            "k": lambda: {r.choice(["equals", "gt", "gte", "lt", "lte", "not"]): number(), r.choice(["gte", "lte", "lt"]): number()},
            "n": lambda: r.choice([{"in": [number(), r.randint(0, 20)]}, {r.choice(["gt", "lt", "equals"]): r.randint(0, 20)}, {"isNull": True}, {"isAbsent": True}, {"exists": r.random() < 0.5}]),
            "t": lambda: r.choice([{r.choice(["equals", "startsWith", "endsWith", "contains", "not"]): text()}, {"in": [text(), text()]}]),
            "b": lambda: {"equals": r.random() < 0.5},
            "d": lambda: {r.choice(["gte", "lt", "equals"]): f"20{r.randint(10, 20)}-05"},
            "l": lambda: r.choice([{"some": r.choice(["x", "zz"])}, {"some": {r.choice(["startsWith", "endsWith", "not"]): "w"}}, {"every": {"in": ["x", "y"]}}, {"hasEvery": r.sample(["x", "y", "zz"], r.randint(0, 2))}, {"isEmpty": r.random() < 0.5}]),
        }
        return {name: some[name]() for name in r.sample(list(some), r.randint(1, 3))}

    for _ in range(12):
        where = filters()
        own = compact(where)
        got = sorted(x["id"] for x in c._match(own)[0].collect())
        assert got == sorted(x["id"] for x in find(plain, schema, where).collect()), where
        assert c.count(where).count >= len(got)
    for where in ({"k": {"gte": 0}}, {"t": {"startsWith": "red"}}):
        for order in (None, {"k": "asc"}, {"k": "desc"}, {"t": "asc"}):
            ids = lambda rows: [x["id"] for x in rows]
            assert ids(c.find_many(where, order, limit=7, offset=3).records) == ids(find(plain, schema, where, order, 7, 3).collect())


def test_exact_and_greedy_cuts(spark, tmp_path):
    r = random.Random(3)
    rows = [(r.randint(0, 40), r.randint(1, 9)) for _ in range(500)]
    df = spark.createDataFrame(rows, "k int, w int").repartition(5)
    got = exact_cut(df, "k", F.col("w"), 100, "file://" + str(tmp_path / "cut")).collect()
    assert len(got) == 500 and all(x[BLOCK] == sum(w for k, w in rows if k < x["k"]) // 100 for x in got)
    keys = sorted(k for k, _ in rows)
    cut = greedy_cut([(k, 10) for k in keys], 95)
    assert all(a == b for (j, a), (k, b) in zip(zip(keys, cut), list(zip(keys, cut))[1:]) if j == k) and cut == sorted(cut)
    assert greedy_cut([], 10) == [] and greedy_cut([("a", 99), ("a", 99), ("b", 1)], 10) == [0, 0, 1]


def test_empty_collection_and_columns(spark, tmp_path):
    df = spark.createDataFrame([], "year double, title string, rating double")
    build(df, MOVIE_SCHEMA, str(tmp_path / "e"))
    c = connect(spark, str(tmp_path / "e"))
    assert c.find_many({"year": {"equals": 1}}).records == [] and c.count().count == 0 and c.get("x") is None


def test_merge_by_pk(movies):
    both = merge_by_pk([movies.query({"year": {"equals": 2000}}), movies.query({"rating": {"gte": 8.4}})], "title")
    assert both.count() == 8 and movies.query({"year": {"equals": 2000}}, columns=["title"]).columns == ["title"]
