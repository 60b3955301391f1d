"""Texts of some megabytes go through every operator whole."""

import random
import zlib

import pytest
from tokenizers import Tokenizer

from blockquery.llm import best_fit_packing, kneser_ney, line_crf, minhash_dedup, quality_rules, source_mixing, token_store
from blockquery.llm.common import Scratch, default_vocabulary

WORDS = 400_000


@pytest.fixture(scope="module")
def texts():
    r = random.Random(2)
    known = ["".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 8))) for _ in range(3000)]
    words = [r.choice(known) for _ in range(WORDS)]
    one_line = " ".join(words)
    return {1: one_line, 2: "\n".join(" ".join(words[i : i + 11]) for i in range(0, WORDS, 11)), 3: one_line + " and one word more", 4: "short text of a few words", 5: "x" * 3_000_000}


@pytest.fixture(scope="module")
def long_docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "a") for i, t in texts.items()], "doc_id bigint, text string, lang string, source string").repartition(2).cache()


def test_quality_rules(spark, long_docs):
    rows = {r["doc_id"]: r for r in quality_rules.quality_rules(long_docs, spark.createDataFrame([(1, 1)], "doc_id bigint, quality int")).collect()}
    assert [rows[i]["n_words"] for i in range(1, 6)] == [WORDS, WORDS, WORDS + 4, 6, 1] and rows[5]["word_chars"] == 3_000_000
    assert rows[2]["n_lines"] == -(-WORDS // 11) and rows[1]["n_distinct_words"] == rows[2]["n_distinct_words"]


def test_line_field(spark, long_docs):
    labels = spark.createDataFrame([(4, 1), (5, 0), (11, 1)], "doc_id bigint, quality int")
    scored = {r["doc_id"]: r["score"] for r in line_crf.classify(long_docs, labels).collect()}
    assert len(scored) == 5 and all(0 <= s <= 1 for s in scored.values())


def test_mixing_and_packing(spark, long_docs, texts):
    mixed, sources, _ = source_mixing.mix_table(long_docs)
    assert {r["doc_id"]: r["size"] for r in mixed.collect()} == {i: len(t.split()) for i, t in texts.items()}
    t = Tokenizer.from_file(default_vocabulary())
    want = {i: len(t.encode(x, add_special_tokens=False).ids) + 1 for i, x in texts.items()}
    pieces = best_fit_packing.pack_documents(long_docs).collect()
    got = {i: sum(p["length"] for p in pieces if p["doc_id"] == i) for i in texts}
    assert got == want and all(p["length"] == 4096 for p in pieces if p["start"] + 4096 < want[p["doc_id"]])


def test_near_duplicates(long_docs):
    rows = {r["doc_id"]: r["component_id"] for r in minhash_dedup.link_documents(long_docs).collect()}
    assert rows == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}


def test_scores(long_docs, texts):
    rows = {r["doc_id"]: r for r in kneser_ney.score_corpus(long_docs).collect()}
    assert all(rows[i]["n_tokens"] == len(t.split()) + 1 for i, t in texts.items())
    assert rows[1]["score"] == pytest.approx(rows[2]["score"], rel=1e-9)


def test_token_store(spark, long_docs, texts):
    root = Scratch(spark, "t").root
    token_store.write_store(long_docs, root)
    token_store.verify_manifest(spark, root)
    t = Tokenizer.from_file(default_vocabulary())
    crc = {i: zlib.crc32(b"".join(x.to_bytes(4, "little") for x in t.encode(s, add_special_tokens=False).ids + [2])) for i, s in texts.items()}
    assert {r["doc_id"]: r["ids_crc32"] for r in token_store.read_digests(spark, root).collect()} == crc
