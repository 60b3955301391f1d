import random
import re

import numpy as np
import pytest

from blockquery.llm.minhash_dedup import components, keep_one, link_documents, most_different, op6_minhash_dedup, shingles, sketch, two_bits
from blockquery.llm.common import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")


SHINGLE = 4


def plain_set(text):
    own = [w.translate({c: c + 32 for c in range(65, 91)}) for w in WORD.findall(text or "")]
    return {tuple(own[i : i + SHINGLE]) for i in range(len(own) - SHINGLE + 1)} if len(own) >= SHINGLE else {tuple(own)} if own else set()


def brute_force(texts):
    """doc_id to (n_shingles, component) by all pairs that share a shingle."""
    sets, up, holders = {i: plain_set(t) for i, t in texts.items()}, {i: i for i in texts}, {}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    shared = {}
    for own in holders.values():
        for k, a in enumerate(own):
            for b in own[k + 1 :]:
                shared[a, b] = shared.get((a, b), 0) + 1
    for (a, b), both in shared.items():
        if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return {i: (len(sets[i]), root(i)) for i in texts}


def test_every_coordinate_fills_and_agreement_is_the_similarity():
    r = np.random.default_rng(3)
    for n in (1, 2, 7, 150, 5000):
        assert (sketch(r.integers(0, 2**63, n, dtype=np.uint64)) != np.uint64(0xFFFFFFFFFFFFFFFF)).all()
    for share in (0.5, 0.8, 0.95):
        got, differ = [], []
        for _ in range(60):
            both, more = int(400 * share), 400 - int(400 * share)
            base = r.integers(0, 2**63, both + more, dtype=np.uint64)
            a, b = base[: both + more // 2], np.concatenate([base[:both], base[both + more // 2 :]])
            got.append((sketch(a) == sketch(b)).mean())
            x = (two_bits(a) ^ two_bits(b)).view(np.uint64)
            differ.append(sum(bin(int((v | v >> np.uint64(1)) & np.uint64(0x5555555555555555))).count("1") for v in x))
        assert abs(np.mean(got) - share) < 0.02 and abs(np.mean(differ) - 1024 * 0.75 * (1 - share)) < 8
        if share == 0.8:
            assert np.std(got) < 1.3 * (0.8 * 0.2 / 150) ** 0.5 and max(differ) <= most_different(80, 100)


def test_shingles():
    assert len(shingles(b"")) == 0 == len(shingles(b" \n")) and len(shingles(b"a")) == 1 and len(shingles(b"A b C")) == 1
    assert (shingles(b"A b c d", 4) == shingles("a B\tc\n d".encode(), 4)).all() and len(shingles(b"a b a b a b a b", 4)) == 2
    assert (shingles("É b c d".encode()) != shingles("é b c d".encode())).all()


def near(r, words, edits):
    out = list(words)
    for _ in range(edits):
        out[r.randrange(len(out))] = f"e{r.randrange(10**6)}"
    return out


def test_against_brute_force(spark):
    """Exact copies, chains, clusters at both sides of the threshold, and a passage that all share."""
    r, texts = random.Random(7), {}
    passage = [f"p{i}" for i in range(40)]
    for g in range(25):
        base = [f"g{g}w{r.randrange(400)}" for _ in range(r.choice((5, 30, 120)))]
        now = base
        for k in range(r.choice((1, 2, 12))):
            texts[len(texts)] = " ".join(now)
            now = near(r, r.choice((base, now)), r.choice((0, 1, 2, 3, 5)))
    for k in range(30):
        texts[len(texts)] = " ".join(passage + [f"x{k}y{i}" for i in range(12)])
    texts |= {len(texts): "", len(texts) + 1: None, len(texts) + 2: "One two", len(texts) + 3: "one TWO"}
    rows = [(i, t) for i, t in texts.items()]
    r.shuffle(rows)
    got = {x["doc_id"]: x for x in link_documents(spark.createDataFrame(rows, "doc_id bigint, text string"), SHINGLE).collect()}
    want = brute_force(texts)
    assert {i: (x["n_shingles"], x["component_id"]) for i, x in got.items()} == want
    assert all(x["kept"] == (x["component_id"] == i) for i, x in got.items())


def test_components(spark, tmp_path):
    r = random.Random(2)
    edges = [(a, b) for a, b in ((r.randrange(200), r.randrange(200)) for _ in range(150)) if a != b] + [(i, i + 1) for i in range(300, 400)]
    df = spark.createDataFrame([(min(e), max(e)) for e in edges], "a bigint, b bigint")
    got = {x["node"]: x["component"] for x in components(df, Scratch(spark, "t"), "c").collect()}
    up = {n: n for e in edges for n in e}
    for _ in up:
        changed = False
        for a, b in edges:
            low = min(up[a], up[b])
            changed |= (up[a], up[b]) != (low, low)
            up[a] = up[b] = low
        if not changed:
            break
    assert got == up
    assert components(df.where("false"), Scratch(spark, "t"), "d") is None


def test_edge_cases(spark, edge, nothing):
    rows = link_documents(edge, SHINGLE).collect()
    assert len(rows) == edge.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["n_shingles"] == by[2]["n_shingles"] == by[3]["n_shingles"] == 0 and by[1]["component_id"] == 1 and by[2]["kept"]
    assert by[11]["component_id"] == 10 and by[10]["n_shingles"] == 1 and by[7]["component_id"] == 6 and by[None]["component_id"] is None and by[None]["kept"]
    assert sum(r["doc_id"] == 9 for r in rows) == 2
    kept = keep_one(edge, SHINGLE)
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == edge.columns and len(ids) == len(set(ids)) and set(ids) == {r["doc_id"] for r in rows if r["kept"]}
    assert link_documents(nothing).count() == 0 == keep_one(nothing).count()


def test_query(spark, small, small_docs):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in op6_minhash_dedup(spark, small).collect()}
    assert got == brute_force(small_docs)


@pytest.mark.parametrize("words", [3, 5])
def test_other_parameters(spark, words):
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "a b c d e f g h"), (3, "z y x")], "doc_id bigint, text string")
    got = {r["doc_id"]: r["component_id"] for r in link_documents(docs, words=words, numerator=70).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_rows_that_repeat_an_id_leave_the_least_text(spark):
    rows = [(1, "b " * 30, 2), (1, "a " * 30, 1), (1, "a " * 30, 0), (2, "some other words " * 9, 5), (None, "x y z", 1), (None, "x y z", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, node int")
    for n in (1, 4):
        got = keep_one(docs.repartition(n))
        assert got.columns == docs.columns
        assert sorted((r["doc_id"] or 0, r["text"], r["node"]) for r in got.collect()) == [(0, "x y z", 1), (0, "x y z", 1), (1, "a " * 30, 0), (2, "some other words " * 9, 5)]
