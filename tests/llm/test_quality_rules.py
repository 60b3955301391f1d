import random
import re
from fractions import Fraction
from math import comb

import pytest

from blockquery.llm.quality_rules import FEATURES, RULES, STEPS, binomial_cdf, certify, features_of, op1_quality_rules, quality_rules, repeat_words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    words, seen, dup = WORD.findall(text or ""), set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_features_by_brute_force():
    r = random.Random(2)
    for _ in range(300):
        text = "".join(r.choice(["a", "b", "é", "\U0001f600", " ", " ", "\n", "\t", "\x0b", "#", "$", " ", "\x85"]) for _ in range(r.randint(0, 80)))
        assert features_of(text.encode())[:5] == plain(text), repr(text)
    assert repeat_words([b"a"] * 5) == 5 and repeat_words([b"a", b"b"]) == 0


def test_exact_binomial():
    for n, k, p in ((10, 3, Fraction(1, 5)), (50, 0, Fraction(1, 20)), (200, 12, Fraction(1, 20)), (5, 5, Fraction(1, 2))):
        exact = float(sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))
        assert binomial_cdf(k, n, float(p)) == pytest.approx(exact, rel=1e-9)
    assert binomial_cdf(7, 7, 0.3) == 1.0


def test_certified_in_sequence():
    assert certify(1000, [0, 1, 2, 500], 0.01, 0.01) == 2
    assert certify(1000, [0, 400, 0, 0], 0.01, 0.01) == 0  # nothing beyond the first failure
    assert certify(100, [0, 0, 0, 0], 0.01, 0.01) is None and certify(0, [0] * 4, 0.5, 0.5) is None
    # so many good documents, none of them rejected, certify a step at 5 and 5 percent
    assert certify(59, [0], 0.05, 0.05) == 0 and certify(58, [0], 0.05, 0.05) is None
    assert certify(86, [0], 0.05, 0.05 / 4) == 0 and certify(85, [0], 0.05, 0.05 / 4) is None
    assert all(len(cuts) == STEPS and list(cuts) == sorted(cuts, reverse=True) for *_, cuts in RULES.values())


def test_false_rejection_is_limited():
    """A cut-off that truly rejects more than alpha is certified in at most a share `level` of trials."""
    r, wrong = random.Random(4), 0
    for _ in range(2000):
        k = sum(r.random() < 0.06 for _ in range(300))
        wrong += certify(300, [k], 0.05, 0.1) is not None
    assert wrong / 2000 <= 0.1


def test_edge_cases(spark, edge, nothing):
    labels = spark.createDataFrame([(5, 1), (6, 1), (None, 1), (6, 1), (7, None)], "doc_id bigint, quality int")
    rows = quality_rules(edge, labels).collect()
    assert len(rows) == edge.count() and not any(r["kept"] is None or r["base_failed"] is None for r in rows)
    by = {r["doc_id"]: r for r in rows}
    assert all(by[i]["base_failed"] and not by[i]["kept"] and by[i]["failed_rule"] == "base" for i in (1, 2, 3, 4, 10))
    assert by[1]["n_words"] == 0 and by[5]["n_words"] == 48_000
    assert quality_rules(nothing, labels).count() == 0
    unlabelled = quality_rules(edge, labels.where("false")).collect()
    assert all(r["kept"] == (not r["base_failed"]) for r in unlabelled)


def test_rules_reject_junk_and_keep_good(spark):
    r = random.Random(6)
    prose = lambda: " ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 8))) for _ in range(120))
    junk = lambda: " ".join("".join(r.choice("ab#$%&|<>") for _ in range(4)) for _ in range(120))
    rows = [(i, prose() if i % 10 else junk(), "en" if i % 2 else "de") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 10 > 0)) for i in range(4000) if i % 3], "doc_id bigint, quality int")
    got = quality_rules(docs, labels).collect()
    good, bad = [x for x in got if x["doc_id"] % 10], [x for x in got if x["doc_id"] % 10 == 0]
    assert sum(x["kept"] for x in good) >= 0.95 * len(good) and sum(x["kept"] for x in bad) == 0
    assert {x["failed_rule"] for x in bad} <= set(RULES) | {"base"}


def plain_step(text):
    """Steps of the path that a document passes, by rule."""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = {"n_words": len(words), "n_lines": len(lines), "n_distinct_words": len(set(words)), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": repeat_words([w.encode() for w in words])}
    out = {}
    for rule, (sign, a, b, cuts) in RULES.items():
        ratio = sign * n[a] / n[b] if n[b] else 0.0
        out[rule] = next((i for i, c in enumerate(cuts) if ratio > c), STEPS)
    return out, n["n_words"] < 50 or 100 * n["n_repeat_words"] > 50 * n["n_words"]


def test_steps_by_brute_force(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    texts = {r["doc_id"]: (r["lang"], *plain_step(r["text"] or "")) for r in docs.collect()}
    trials = {}
    for r in labels.where("quality = 1").collect():
        lang, steps, base = texts.get(r["doc_id"], (None, None, True))
        if not base:
            trials.setdefault(lang, {})[r["doc_id"]] = min(steps.values())
    certified = {lang: certify(len(t), [sum(v <= i for v in t.values()) for i in range(STEPS)], 0.05, 0.05 / len(trials)) for lang, t in trials.items()}
    # rows that repeat an id are no further trials
    got = quality_rules(docs.unionByName(docs.where("lang = 'es'")), labels).collect()
    assert certified["en"] is not None and {r["lang"]: r["certified_step"] for r in got} == {k: certified.get(k) for k in {t[0] for t in texts.values()}}
    assert {"base", None} < {r["failed_rule"] for r in got}
    for r in got:
        lang, steps, base = texts[r["doc_id"]]
        step = certified.get(lang)
        failed = "base" if base else next((rule for rule in RULES if step is not None and steps[rule] <= step), None)
        assert r["failed_rule"] == failed and r["kept"] == (failed is None)


def test_query(spark, small, small_docs):
    rows = op1_quality_rules(spark, small).collect()
    assert len(rows) == len(small_docs)
    for x in rows:
        assert (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"]) == plain_fast(small_docs[x["doc_id"]])
        assert x["base_failed"] == (x["n_words"] < 50 or 100 * x["n_repeat_words"] > 50 * x["n_words"]) and (not x["base_failed"] or not x["kept"])
    assert set(FEATURES) >= {"n_words", "n_repeat_words"}


def plain_fast(text):
    words, seen, dup = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup
