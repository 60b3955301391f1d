import json

import pytest

from blockquery.__main__ import main
from blockquery.operators import infer, lints
from blockquery.operators.infer import Stats
from blockquery.plans import cost
from blockquery.schema import CollectionSchema, Field

from .fixtures import MOVIE_ROWS, ndjson


def stats_of(spark, tmp_path, rows):
    return infer.field_stats(spark.read.text(ndjson(tmp_path / "s.ndjson", rows)))


def test_kinds(spark, tmp_path):
    rows = [{"n": i if i % 2 else i / 2, "b": i > 2, "s": f"v{i % 3}", "d": f"2020-01-{i + 10}", "mixed": i if i else "x", "l": ["a"] if i else [], "nums": [i], "maybe": None if i == 1 else "q", "day": "2020-01-01T10:00:00Z" if i else "soon", "o": {"k": i}} for i in range(20)]
    del rows[3]["s"]
    got = stats_of(spark, tmp_path, rows)
    assert {n: s.kind for n, s in got.items()} == {"n": "number", "b": "boolean", "s": "string", "d": "date", "mixed": "json", "l": "string", "nums": "json", "maybe": "string", "day": "string", "o": "json"}
    assert got["l"].multi and not got["s"].multi and got["s"].absent and got["maybe"].nulls == 1 and not got["maybe"].absent
    assert got["s"].values == ["v0", "v1", "v2"] and got["d"].values is None
    assert got["n"].distinct >= 14 and got["d"].unique


def test_shapes_and_values(spark, tmp_path):
    rows = [{"id": f"0000000{i % 10}-0000-4000-8000-0000000000{i:02}", "uri": f"https://x.org/{i}", "name": f"name {i}"} for i in range(40)]
    got = stats_of(spark, tmp_path, rows)
    assert (got["id"].shape, got["uri"].shape, got["name"].shape) == ("uuid", "url", None) and got["name"].values is None
    assert infer.recommend_pk(got) == "id"
    schema = CollectionSchema("name", {"name": Field("name", "string"), "uri": Field("uri", "string", indexed=True, contains=True)})
    assert len(lints.unsuitable_text_indexes(schema, got)) == 1


def test_all_null_is_a_string(spark, tmp_path):
    got = stats_of(spark, tmp_path, [{"a": None}, {"a": None}])
    assert got["a"].kind == "string" and got["a"].nulls == 2 and got["a"].values is None


def make(name, kind="number", distinct=50, records=1000, **rest):
    return Stats(name, kind, records, rest.pop("present", records), rest.pop("nulls", 0), distinct, **rest)


def test_recommendations():
    stats = {s.name: s for s in (make("card_id", distinct=1000, unique=True), make("year"), make("title", "string", 900), make("tags", "string", 9, multi=True), make("when", "date", 700), make("gone", "number", 990, present=900))}
    assert infer.recommend_sort(stats) == "card_id" and infer.recommend_pk(stats) == "card_id"
    del stats["card_id"]
    assert infer.recommend_sort(stats) == "when" and infer.recommend_pk(stats) is None
    chosen, skipped = infer.recommend_indexes(stats, "when", {"year": 0.6})
    assert chosen == ["tags"] and skipped == ["year"]
    assert infer.recommend_indexes(stats, "when")[0] == ["tags", "year"]
    assert infer.pk_named("_id") and infer.pk_named("userId") and not infer.pk_named("title")


def test_refreshed_keeps_choices():
    old = CollectionSchema("year", {"year": Field("year", "number"), "t": Field("t", "string", indexed=True, contains=True), "gone": Field("gone", "string")})
    new = infer.refreshed(old, {"year": make("year"), "t": make("t", "string", nulls=3)})
    assert new.fields["t"].contains and new.fields["t"].nullable and "gone" not in new.fields and new.sort_field == "year"


def test_block_share(spark):
    df = spark.createDataFrame([(i, i // 2000, i % 7) for i in range(20_000)], "id int, clustered int, scattered int")
    share = infer.block_share(df, "id", ["clustered", "scattered"], 20)
    assert share["clustered"] < 0.2 < lints.WEAK_SHARE < share["scattered"]


def test_whole_shares_stay_where_they_lie(spark, monkeypatch):
    """of all records the driver sees sums and a row for each range partition, and the count is the one over a list."""
    from pyspark.sql.classic.dataframe import DataFrame

    rows = [(i * 7919 % 6000, i // 600, i % 7 if i % 3 else None, [f"a{i % 2}", None, f"b{i // 1000}"]) for i in range(6000)]
    df = spark.createDataFrame(rows, "id int, clustered int, scattered int, l array<string>")
    held, plain = [], DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda self: held.append(out := plain(self)) or out)
    fields = ["clustered", "scattered", "l"]
    got = infer.block_share(df, "id", fields, 20, rows=1 << 40)
    assert max(map(len, held)) < 100
    drawn = [dict(zip(("id", *fields), r)) for r in rows]
    assert got == {n: infer.estimated_share(drawn, len(rows), "id", n, 20) for n in fields}
    bins = infer.sample_bins(df.select("id", "clustered"), "id", 16).collect()
    assert all(r["bin"] == r["id"] * 16 // 6000 for r in bins) and len(bins) == 6000


def test_lints(spark):
    assert lints.low_cardinality_sort(100, 4, "a") and not lints.low_cardinality_sort(100, 50, "a")
    assert lints.weak_indexes({"a": 0.9, "b": 0.1}, 20) and not lints.weak_indexes({"a": 0.9}, 5)
    assert lints.oversized_record(100, 50) and not lints.oversized_record(10, 50)
    blocks = spark.createDataFrame([(i, 10) for i in range(9)] + [(9, 100)], "block int, bytes int")
    assert [r["block"] for r in lints.skewed_blocks(blocks).collect()] == [9]
    assert lints.contains_larger_than_column({"a": 10, "b": 1}, {"a": 5, "b": 5}) and lints.over_budget(2_000_000) and not lints.over_budget(5)
    values = ("x", "y")
    assert lints.shared_values(CollectionSchema("a", {"a": Field("a", "string", values=values), "b": Field("b", "string", values=values[::-1]), "c": Field("c", "string", values=("z",))})) == [("a", "b")]


def test_collection_warnings(spark, tmp_path):
    from blockquery.build import build
    from blockquery.client import connect
    from blockquery.schema import validate

    fields = {"k": Field("k", "number"), "flag": Field("flag", "string", indexed=True), "t": Field("t", "string", indexed=True, contains=True)}
    rows = [(float(i // 30), "ab"[i % 2], f"text {i}") for i in range(900)]
    build(spark.createDataFrame(rows, "k double, flag string, t string"), validate(CollectionSchema("k", fields)), str(tmp_path / "w"), block_bytes=2000)
    found = lints.collection_warnings(connect(spark, str(tmp_path / "w")))
    assert any("records share a sort value" in w for w in found) and any(w.startswith("flag: a value of its index") for w in found)


def test_generated_types():
    from blockquery.codegen import record_module

    fields = {"a": Field("a", "string", values=("x", "y"), values_type="Letter", nullable=True), "l": Field("l", "string", indexed=True, multi=True, absent=True), "j": Field("j", "json")}
    text = record_module(CollectionSchema("a", fields), "my set")
    compile(text, "generated", "exec")
    assert "Letter = Literal['x', 'y']" in text and "'a': Letter | None" in text and "'l': NotRequired[list[str]]" in text and "class" not in text and "MySetRecord" in text


def test_samples_and_sort_choice(spark):
    from blockquery.operators.sampling import sample

    df = spark.createDataFrame([(i, i // 100, i % 13) for i in range(2000)], "id int, near int, far int")
    a, b = ([tuple(r) for r in sample(x, 50).collect()] for x in (df, df.repartition(7)))
    assert a == b and len(set(a)) == 50 and sample(df, 50, 1).collect() != a
    stats = {s.name: s for s in (make("id", distinct=2000, records=2000), make("near", distinct=20, records=2000), make("far", distinct=13, records=2000))}
    assert infer.recommend_sort_for(df, stats, ["near"]) == "id" and infer.recommend_sort_for(df, stats, []) == "id"


def test_costs():
    assert cost.block_count(0, 10) == 1 and cost.block_count(101, 10) == 11
    assert cost.recommended_block_bytes(10) == 2 << 20 and cost.recommended_block_bytes(99 << 20) == 8 << 20
    assert cost.nearest_rank(list(range(1, 101)), 0.95) == 95 and cost.nearest_rank([], 0.5) == 0
    assert cost.postings_count([1, 5, 100], 10) == 16 and cost.index_bytes(3, 2.0, 16) == 38
    assert cost.trigram_bytes([5, 2], 100, 10) == 6 and cost.range_blocks(15) == 2
    assert cost.equality_cost(1000, 100, 10, 1000) == (46_000, 2)
    assert cost.scatter({"a": (1, 1), "b": (3, 2)}) == pytest.approx(1.75)


def test_command_line(spark, tmp_path, capsys):
    source, config, out = ndjson(tmp_path / "m.ndjson", MOVIE_ROWS), tmp_path / "c.json", tmp_path / "out"
    assert main(["init", source, "--config", str(config), "--sort-field", "year", "--output", str(out), "--index", "title"]) == 0
    assert json.loads(config.read_text())["schema"]["fields"]["title"]["indexed"]
    assert main(["build", str(config)]) == 0 and json.loads(capsys.readouterr().out.strip().splitlines()[-1])["records"] == 10
    assert main(["inspect", str(out)]) == 0 and '"records": 10' in capsys.readouterr().out
    assert main(["inspect", "--config", str(config)]) == 0
    found = json.loads(capsys.readouterr().out)
    assert found["records"] == 10 and found["blocks"] == 1 and found["fields"]["title"]["cardinality"] == 10
    assert main(["codegen", str(config), "--output", str(tmp_path / "movies.py")]) == 0
    scope: dict = {}
    exec((tmp_path / "movies.py").read_text(), scope)
    assert set(scope["RecordsRecord"].__annotations__) == {"year", "title", "rating"} and scope["connect"](spark).count().count == 10
    assert main(["init", source, "--config", str(config), "--reinfer"]) == 0 and json.loads(config.read_text())["schema"]["fields"]["title"]["indexed"]
    assert main(["inspect", str(tmp_path / "nowhere")]) == 1
