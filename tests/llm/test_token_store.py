import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from blockquery.llm.common import Scratch, default_vocabulary
from blockquery.llm.token_store import LEAST, MOST, _shift_tables, crc_shift, cuts, merkle, op10_token_store, read_digests, read_documents, verified_chunks, verify_manifest, write_store


def ids_of(text):
    return Tokenizer.from_file(default_vocabulary()).encode(text or "", add_special_tokens=False).ids + [2]


def crc(ids):
    return zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))


def expected(docs):
    """doc_id, start, n_tokens, ids_crc32 in ascending doc_id order."""
    start = 0
    for i in sorted(docs):
        ids = ids_of(docs[i])
        yield i, start, len(ids), crc(ids)
        start += len(ids)


def test_query(spark, small, small_docs):
    got = sorted(tuple(r[c] for c in ("doc_id", "start", "n_tokens", "ids_crc32")) for r in op10_token_store(spark, small).collect())
    assert got == list(expected(small_docs))


def test_round_trip_and_shards(spark, small_docs):
    docs = {i: small_docs[i] for i in sorted(small_docs)[:60]}
    df = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string").repartition(4)
    root = Scratch(spark, "t").root
    write_store(df, root, shard_docs=13)
    verify_manifest(spark, root)
    assert spark.read.parquet(f"{root}/shards").count() == 5
    want = list(expected(docs))
    assert sorted(tuple(r) for r in read_digests(spark, root).select("doc_id", "start", "n_tokens", "ids_crc32").collect()) == want
    whole = {r["doc_id"]: r for r in read_documents(spark, root).collect()}
    assert all(np.frombuffer(whole[i]["ids"], "<u4").tolist() == ids_of(docs[i]) and whole[i]["start"] == start for i, start, *_ in want)


def test_shared_passages_are_stored_once(spark):
    r = random.Random(3)
    passage = " ".join(f"word{r.randrange(5000)}" for _ in range(4000))
    docs = spark.createDataFrame([(i, " ".join(f"x{r.randrange(999)}" for _ in range(300)) + " " + passage) for i in range(20)], "doc_id int, text string")
    root = Scratch(spark, "t").root
    write_store(docs, root)
    total = spark.read.parquet(f"{root}/recipes").selectExpr("sum(n_tokens)").first()[0]
    stored = spark.read.parquet(f"{root}/chunks").selectExpr("sum(n_ids)").first()[0]
    assert stored < 0.25 * total


@pytest.mark.parametrize("what", ["payload", "order", "missing", "manifest"])
def test_damage_is_found(spark, small_docs, what):
    docs = {i: small_docs[i] for i in sorted(small_docs)[:20]}
    root = Scratch(spark, "t").root
    write_store(spark.createDataFrame(list(docs.items()), "doc_id bigint, text string"), root)
    table = "recipes" if what in ("order", "manifest") else "chunks"
    df = spark.read.parquet(f"{root}/{table}")
    bad = {"payload": lambda: df.selectExpr("digest", "n_ids", "unhex(concat('00', substring(hex(payload), 3))) AS payload"), "missing": lambda: df.limit(df.count() - 1), "order": lambda: df.selectExpr("shard", "doc_id", "rel_start", "n_tokens", "root", "reverse(digests) AS digests", "lengths"), "manifest": lambda: df.selectExpr("shard", "place", "doc_id", "rel_start", "n_tokens + 1 AS n_tokens", "root", "digests", "lengths")}[what]()
    rows, schema = bad.collect(), bad.schema
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{root}/{table}")
    with pytest.raises(Exception, match="match|not in the store|add up"):
        if what == "manifest":
            verify_manifest(spark, root)
        else:
            read_digests(spark, root).collect()


@pytest.mark.parametrize("what", ["ids", "starts", "lengths", "rows", "width", "end", "shards"])
def test_the_tree_covers(spark, small_docs, what):
    docs = {i: small_docs[i] for i in sorted(small_docs)[:40]}
    root = Scratch(spark, "t").root
    write_store(spark.createDataFrame(list(docs.items()), "doc_id bigint, text string"), root, shard_docs=11)
    verify_manifest(spark, root)
    table = {"width": "store", "end": "store", "shards": "shards"}.get(what, "recipes")
    df = spark.read.parquet(f"{root}/{table}")
    rows = [r.asDict() for r in df.collect()]
    if what == "ids":
        rows[3]["doc_id"], rows[4]["doc_id"] = rows[4]["doc_id"], rows[3]["doc_id"]
    elif what == "starts":
        for r in rows:
            r["rel_start"] += 7
    elif what == "lengths":
        rows[5]["lengths"] = [rows[5]["lengths"][0] + 1, *rows[5]["lengths"][1:]]
    elif what == "rows":
        rows.pop()
    elif what == "width":
        rows[0]["width"] = 4
    elif what == "end":
        rows[0]["end_id"] = 5
    else:
        rows[0]["base"] += 1
    spark.createDataFrame(rows, df.schema).write.mode("overwrite").parquet(f"{root}/{table}")
    with pytest.raises(Exception, match="match"):
        verify_manifest(spark, root)
        read_digests(spark, root).collect()


def test_wide_vocabulary(spark, tmp_path):
    import json

    said = json.load(open(default_vocabulary(), encoding="utf-8"))
    said["model"]["vocab"] |= {f"unused{i}": len(said["model"]["vocab"]) + 10 + i for i in range(20_000)}
    said["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = "[\\p{L}\\p{N}]+|[^\\s\\p{L}\\p{N}]+"  # other cuts than those known
    path = f"{tmp_path}/other.json"
    json.dump(said, open(path, "w", encoding="utf-8"))
    texts = ["a1b2 don't 12345", "", "Ünïcode 漢字 x", "the the the " * 400]
    root = Scratch(spark, "t").root
    write_store(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), root, path)
    verify_manifest(spark, root)
    t = Tokenizer.from_file(path)
    got = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in read_documents(spark, root).collect()}
    assert got == {i: t.encode(x, add_special_tokens=False).ids + [2] for i, x in enumerate(texts)}
    assert spark.read.parquet(f"{root}/store").first()["width"] == 4
    assert {r["doc_id"]: r["ids_crc32"] for r in read_digests(spark, root).collect()} == {i: crc(x) for i, x in got.items()}


def test_cuts_and_roots():
    r = random.Random(1)
    for _ in range(300):
        n = r.randint(1, 9000)
        ends = cuts(n, sorted(r.sample(range(1, n + 1), min(n, r.randint(0, 40)))))
        sizes = np.diff([0, *ends])
        assert ends[-1] == n and (sizes > 0).all() and (sizes <= MOST).all() and (sizes[:-1] >= min(LEAST, MOST)).all()
    assert len({merkle([b"a", b"b"], [1, 1]), merkle([b"a", b"b"], [1, 2]), merkle([b"b", b"a"], [1, 1]), merkle([b"ab"], [2]), merkle([], []), merkle([b"a", b"b", b"b"], [1, 1, 1])}) == 6
    tables = _shift_tables()
    a, b = b"some bytes", b"more of them, and a few others"
    assert int(crc_shift(np.array([zlib.crc32(a)]), np.array([len(b)]), tables)[0]) ^ zlib.crc32(b) == zlib.crc32(a + b)


def test_edge_cases(spark, edge, nothing):
    root = Scratch(spark, "t").root
    write_store(edge, root, shard_docs=4)
    verify_manifest(spark, root)
    rows = sorted((tuple(r[c] for c in ("start", "doc_id", "n_tokens", "ids_crc32")) for r in read_digests(spark, root).collect()), key=lambda r: r[0])
    assert len(rows) == edge.count() and rows[0][1] is None and [r[1] for r in rows[1:]] == sorted(r[1] for r in rows[1:])
    assert all(a[0] + a[2] == b[0] for a, b in zip(rows, rows[1:]))
    texts = {r["doc_id"]: r["text"] for r in edge.collect()}
    assert all((r[2], r[3]) == (len(ids_of(texts[r[1]])), crc(ids_of(texts[r[1]]))) for r in rows)
    empty = Scratch(spark, "t").root
    write_store(nothing, empty)
    assert read_digests(spark, empty).count() == 0 == verified_chunks(spark, empty).count()
