import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from blockquery.llm import kneser_ney
from blockquery.llm.kneser_ney import Vocabulary, _unmix, bigram_keys, mapped, op9_kneser_ney, put, score_corpus, shards_of
from blockquery.llm.kneser_ney import discounts as own_discounts
from blockquery.llm.common import mix

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = {c: c + 32 for c in range(65, 91)}


def tokens(text):
    return [*WORD.findall((text or "").translate(LOW)), "</s>"]


def discounts(n1, n2, n3, n4):
    """Chen and Goodman's three discounts, kept apart from the operator's; half a count where its counts of counts are none."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    d1 = 1 - 2 * y * n2 / n1 if n1 and n2 else 0.5
    d2 = 2 - 3 * y * n3 / n2 if n2 and n3 else 0.5
    d3 = 3 - 4 * y * n4 / n3 if n3 and n4 else 0.5
    return [0.0, min(max(d1, 0.05), 0.95), min(max(d2, 0.05), 1.95), min(max(d3, 0.05), 2.95)]


def model(texts):
    """The model of the operator's docstring, from dictionaries."""
    train = [tokens(t) for i, t in texts if i is not None and zlib.crc32(str(i).encode()) % 10 != 0]
    c1, c2, follow, before = Counter(), Counter(), defaultdict(Counter), Counter()
    for own in train:
        c1.update(own)
        c2.update(zip(["<s>", *own], own))
    starts = len(train)
    for (a, w), n in c2.items():
        follow[a][min(n, 3)] += 1
        before[w] += 1
    total, types = sum(c1.values()), len(c1)
    d = discounts(*(sum(n == k for n in c2.values()) for k in (1, 2, 3, 4)))
    du = discounts(*(sum(n == k for n in before.values()) for k in (1, 2, 3, 4)))
    distinct = len(c2)
    mass = sum(du[min(n, 3)] for n in before.values())

    def single(w):
        if not distinct:
            return 1 / (types + 1)
        return max(before[w] - du[min(before[w], 3)], 0) / distinct + mass / distinct / (types + 1)

    def p(a, w):
        n = starts if a == "<s>" else c1[a]
        if not n:
            return single(w)
        return max(c2[a, w] - d[min(c2[a, w], 3)], 0) / n + sum(d[k] * follow[a][k] for k in (1, 2, 3)) / n * single(w)

    return p, c1, total, types


def brute_force(texts):
    p, c1, total, types = model(texts)
    for i, t in texts:
        own = tokens(t)
        base = sum(math.log10((c1[w] + 0.1) / (total + 0.1 * (types + 1))) for w in own)
        yield i, len(own), sum(c1[w] > 0 for w in own), total, base, sum(math.log10(p(a, w)) for a, w in zip(["<s>", *own], own))


def compare(rows, want):
    rows, want = (sorted(x, key=lambda r: (r[0] is None, r[0] or 0, r[-1])) for x in (rows, want))
    assert len(rows) == len(want)
    for a, b in zip(rows, want):
        assert tuple(a[:4]) == tuple(b[:4]) and a[4:] == pytest.approx(b[4:], rel=1e-9)


NAMES = ("doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def test_query(spark, small, small_docs):
    rows = op9_kneser_ney(spark, small).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0) for r in rows)
    compare([tuple(r[n] for n in NAMES) for r in rows], list(brute_force(list(small_docs.items()))))
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)  # context helps on unseen documents


def test_edge_cases(spark, edge, nothing):
    rows = [tuple(r[n] for n in NAMES) for r in score_corpus(edge).collect()]
    compare(rows, list(brute_force([(r["doc_id"], r["text"]) for r in edge.collect()])))
    assert all(r["held_out"] for r in score_corpus(edge).collect() if r["doc_id"] is None)
    assert score_corpus(nothing).count() == 0
    unlearned = score_corpus(edge.where("doc_id IS NULL")).collect()
    assert [(r["train_tokens"], r["n_known"], r["score"]) for r in unlearned] == [(0, 0, 0.0)]


def test_probabilities_sum_to_one():
    """Over the vocabulary and one unseen word, after any context; the query is held against the same model."""
    texts = list(enumerate(["a b c a b", "b c", "a a a", "c b a b c a", "", "d"] * 6))
    p, c1, *_ = model(texts)
    for context in ("<s>", "a", "b", "d", "never-seen"):
        assert sum(p(context, w) for w in [*c1, "never-seen"]) == pytest.approx(1)


def test_hashes_invert():
    x = np.random.default_rng(1).integers(0, 2**63, 1000, dtype=np.uint64)
    assert (_unmix(mix(x)) == x).all()
    assert _unmix(bigram_keys(np.array([3]), np.array([7])))[0] == (3 << 32) + 7


def test_discounts():
    r = np.random.default_rng(2)
    for n in ((0, 0, 0, 0), (1, 0, 0, 0), (100, 40, 20, 10), (5, 500, 1, 900), *r.integers(0, 50, (200, 4)).tolist()):
        assert own_discounts(*n).tolist() == pytest.approx(discounts(*n))


def test_shards_follow_the_data_alone(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "some words here " * 64) for i in range(64)], "doc_id bigint, text string")
    monkeypatch.setattr(kneser_ney, "SHARD_BYTES", 1000)
    found = set()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for n in ("2", "64"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.add(shards_of(docs))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found == {128} and shards_of(docs.where("false")) == 16
    v = Vocabulary("", {s: (50_000, 0) for s in range(16)}, 16)
    assert v.groups == 13 and v.group_n.sum() == 800_000 and v.group_n.max() == kneser_ney.GROUP_WORDS


def test_stores_that_cannot_be_mapped(tmp_path, monkeypatch):
    """Files of another store are written under another name first, and mapped from a copy that has no name."""
    import os
    import tempfile

    arrays = [np.arange(1000, dtype="<u8"), np.arange(7, dtype="u1"), np.zeros(0, "<u4")]
    monkeypatch.setattr(kneser_ney, "_local", lambda uri: None)
    monkeypatch.setattr(tempfile, "tempdir", str(tmp_path / "own"))
    os.mkdir(tmp_path / "own")
    uri = f"file://{tmp_path}/far/words-3"
    put(uri, arrays)
    put(uri, arrays)
    assert os.listdir(tmp_path / "far") == ["words-3"]
    got = mapped(uri)
    assert all((a == b).all() for a, b in zip(got, arrays)) and os.listdir(tmp_path / "own") == []
