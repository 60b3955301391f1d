import itertools
import random
import re

import pytest

from blockquery.llm.common import Scratch
from blockquery.llm.source_mixing import MinCostFlow, mix_sources, mix_table, op4_source_mixing, order_key, quotas, route, take_copies, targets
from pyspark.sql import functions as F


def test_flow_by_brute_force():
    r = random.Random(1)
    for _ in range(40):
        arcs = [(0, 2, r.randint(0, 2), r.randint(0, 3)), (0, 3, r.randint(0, 2), r.randint(0, 3)), (2, 3, 1, 1), (2, 1, r.randint(0, 2), r.randint(0, 3)), (3, 1, r.randint(0, 2), r.randint(0, 3))]
        net = MinCostFlow(4)
        ids = [net.arc(*x) for x in arcs]
        total = net.run(0, 1)
        cost = sum(net.flow(e) * x[3] for e, x in zip(ids, arcs))
        best = (0, 0)
        for f in itertools.product(*(range(x[2] + 1) for x in arcs)):
            if f[0] == f[2] + f[3] and f[1] + f[2] == f[4]:
                best = max(best, (f[0] + f[1], -sum(k * x[3] for k, x in zip(f, arcs))))
        assert (total, -cost) == best


def test_quotas():
    got = quotas({"b": 100, "a": 100, None: 100, "c": 100})
    # a 5, b 2, c 1, null 5: 600 words; a and null stop at 200, 200 are left for b and c, where b stops at 133.3
    assert got["a"] == got[None] == 200 and got["b"] == pytest.approx(400 / 3) and got["c"] == pytest.approx(200 / 3)
    assert sum(quotas({"x": 10, "y": 0}).values()) == pytest.approx(15) and quotas({}) == {}
    assert sorted(["é", "z", None, "Z", "\U0001f600", ""], key=order_key) == ["", "Z", "z", "é", "\U0001f600", None]


def test_overlapping_sources_repeat_only_where_needed():
    taken = route({("a",): 10, ("a", "b"): 10, ("b",): 10}, {"a": 15, "b": 10})
    assert sum(taken.values()) == 25 and all(n <= 10 for n in taken.values())
    taken = route({("a",): 10, ("b",): 10}, {"a": 18, "b": 3})
    assert taken == {("a",): 18, ("b",): 3}


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_edge_cases(spark, edge, nothing):
    mixed, own, target = mix_sources(edge)
    rows = mixed.collect()
    assert len(rows) == edge.count() and all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    assert own == {s: sum(words(x["text"]) for x in edge.collect() if x["source"] == s) for s in ("a", "b", "c", None)}
    for s in own:
        got = sum(r["taken"] for r in rows if r["pattern"] == ("[null]" if s is None else f'["{s}"]'))
        assert abs(got - target[s]) <= 1
    assert mix_sources(nothing)[0].count() == 0
    copies = take_copies(edge)
    assert copies.columns == edge.columns
    counted = {r["doc_id"]: r["count"] for r in copies.groupBy("doc_id").count().collect()}
    assert max(counted.values()) <= 4 and 1 not in counted  # two rows of one id, twice each
    assert take_copies(nothing).count() == 0


def test_membership_patterns(spark):
    docs = spark.createDataFrame([(i, "w " * (i % 7), ["a"] if i % 3 == 0 else ["b", "a"] if i % 3 == 1 else []) for i in range(300)], "doc_id int, text string, of array<string>")
    mixed, own, target = mix_sources(docs, F.col("of"))
    rows = mixed.collect()
    assert set(own) == {"a", "b"} and {r["pattern"] for r in rows} == {'["a"]', '["a","b"]', "[]"}
    assert all(r["taken"] == 0 for r in rows if r["pattern"] == "[]")
    assert abs(sum(r["taken"] for r in rows) - sum(target.values())) <= 2 or sum(r["taken"] for r in rows) == 2 * sum(r["size"] for r in rows if r["pattern"] != "[]")


def test_query(spark, small):
    rows, again = op4_source_mixing(spark, small).collect(), op4_source_mixing(spark, small).collect()
    assert sorted(rows) == sorted(again)
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    by = {}
    for r in rows:
        assert r["size"] == words(docs[r["doc_id"]]["text"]) and 0 <= r["taken"] <= 2 * r["size"]
        by.setdefault(docs[r["doc_id"]]["source"], []).append(r)
    want = quotas({s: sum(r["size"] for r in own) for s, own in by.items()})
    for s, own in by.items():
        assert {(r["source_size"], r["target"]) for r in own} == {(sum(r["size"] for r in own), want[s])}
        assert abs(sum(r["taken"] for r in own) - want[s]) <= 1


def plain_targets(sizes, weights=(5, 2, 1)):
    """By bisection on the level to which every source is filled."""
    order = sorted(sizes, key=order_key)
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    want, low, high = 1.5 * sum(sizes.values()), 0.0, 4.0 * sum(sizes.values()) + 1
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(2 * sizes[s], mid * w[s]) for s in order) < want else (low, mid)
    return {s: min(2 * sizes[s], low * w[s]) for s in order}


@pytest.mark.parametrize("small", [0, 100_000])
def test_targets_of_any_number_of_sources(spark, small):
    r = random.Random(5)
    sizes = {f"{'é' if i % 5 else 'z'}{i}": int(r.paretovariate(0.7)) for i in range(3000)} | {None: 40, "": 7, "\x1f\x0b": 900}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint").repartition(3)
    got = {r["source"]: (r["source_size"], r["target"]) for r in targets(df, len(sizes), Scratch(spark, "t"), small=small).collect()}
    want = plain_targets(sizes)
    assert {s: n for s, (n, _) in got.items()} == sizes
    assert all(got[s][1] == pytest.approx(want[s], rel=1e-6) for s in sizes)


def test_many_sources(spark):
    """More sources than the driver plans, and names that writers of JSON escape differently."""
    docs = spark.range(60_000).selectExpr("id AS doc_id", "repeat('w ', cast(id % 5 as int)) AS text", "concat('\x1f\x0b', cast(id div 3 as string), '.example') AS source")
    mixed, sources, _ = mix_table(docs, small=1000)
    assert sources.count() == 20_000
    got = mixed.groupBy("pattern").agg(F.sum("taken").alias("taken"), F.sum("size").alias("size")).join(sources.select(F.to_json(F.array("source")).alias("pattern"), "source_size", "target"), "pattern")
    assert got.count() == 20_000 and mixed.count() == 60_000
    assert got.where("size != source_size OR abs(taken - target) > 1").count() == 0


def test_rows_that_repeat_an_id(spark):
    """One id for most of a source's rows: its border is found among rows alike, in bounded tasks, and copies are each row's own."""
    rows = [(7 if i % 4 else i, "w " * (3 if i % 4 else 5), "a" if i % 3 else "b") for i in range(6000)] + [(None, "w w", "a")] * 500
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(5)
    for window_rows in (10, 100_000):
        mixed, sources, _ = mix_table(docs, window_rows=window_rows)
        found = mixed.collect()
        target = {f'["{r["source"]}"]': r["target"] for r in sources.collect()}
        assert len(found) == len(rows) and all(0 <= r["taken"] <= 2 * r["size"] for r in found)
        for p, want in target.items():
            assert abs(sum(r["taken"] for r in found if r["pattern"] == p) - want) <= 1
        parts = [r for r in found if r["taken"] % r["size"]]
        assert len(parts) <= 2
    copies = take_copies(docs.withColumn("extra", F.lit(1)))
    taken = {r["source"]: r["n"] for r in copies.groupBy("source").agg(F.sum(F.size(F.split(F.trim("text"), " "))).alias("n")).collect()}
    assert all(abs(taken[p[2:-2]] - want) <= 5 for p, want in target.items())


def test_too_many_overlapping_patterns_are_an_error(spark):
    docs = spark.createDataFrame([(i, "w", [f"s{i}", f"s{i + 1}"]) for i in range(30)], "doc_id int, text string, of array<string>")
    with pytest.raises(ValueError, match="most_patterns"):
        mix_table(docs, F.col("of"), most_patterns=29)
    assert mix_table(docs, F.col("of"), most_patterns=30)[0].count() == 30
