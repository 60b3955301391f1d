import math
import random
import re
import zlib

from blockquery.llm.secret_scan import BUCKETS, CANDIDATE, FEATURES, dictionary, features, find_occurrences, find_secrets, findings_table, forest_score, labelled_findings, op2_secret_scan, redact, train_forest
from pyspark.sql import functions as F

from .conftest import python_free


def score_in_python(forest, row):
    def vote(node):
        while not isinstance(node, float):
            node = node[2] if row[FEATURES[node[0]]] <= node[1] else node[3]
        return node

    return sum(map(vote, forest)) / len(forest)


def test_forest_as_sql_and_held_out_accuracy(spark):
    forest = train_forest(findings_table(spark))
    held = findings_table(spark, labelled_findings(1500, seed=99, words=dictionary()[1::2]))  # words that training has not seen
    described = held.select("label", *(c.cast("double").alias(n) for n, c in features(*(F.col(c) for c in ("value", "before", "after", "path"))).items()))
    rows = described.withColumn("score", forest_score(forest, F.col)).collect()
    assert all(abs(r["score"] - score_in_python(forest, r)) < 1e-9 for r in rows)
    right = sum((r["score"] >= 0.5) == bool(r["label"]) for r in rows)
    assert right / len(rows) >= 0.95
    assert all(0 <= r["coverage"] <= 1 for r in rows)


def test_candidates_and_redaction(spark, edge, nothing):
    r = random.Random(8)
    key = "".join(r.choice("0123456789abcdef") for _ in range(40))
    text = f'some words token = "{key}" and again {key} here, card 4012888888881881 and id 4f2d commit 0123456789abcdef0123456789abcdef01234567 end'
    docs = spark.createDataFrame([(1, text, "src/main.py", len(text), "kept"), (2, text, None, 1, None), (3, None, None, None, None), (4, "", "x", 0, "y")], "doc_id int, text string, source string, n_chars int, more string")
    found = find_secrets(docs)
    assert python_free(found)
    rows = found.collect()
    assert {x["value"] for x in rows} == set(re.findall(CANDIDATE, text)) and {x["doc_id"] for x in rows} == {1, 2}
    assert [x["start"] for x in rows if x["doc_id"] == 1 and x["value"] == key] == [text.index(key) + 1]
    assert all(x["secret"] == (x["value"] == key) for x in rows)
    out = {x["doc_id"]: x for x in redact(docs).collect()}
    assert out[1]["text"] == text.replace(key, "[secret]") and out[1]["n_chars"] == len(out[1]["text"]) and out[1]["more"] == "kept"
    assert out[3]["text"] is None and out[4]["text"] == "" and out[4]["n_chars"] == 0
    masked = redact(edge)
    assert masked.columns == edge.columns and masked.count() == edge.count() and python_free(masked)
    assert redact(nothing).count() == 0 == find_secrets(nothing).count()


def test_long_digitless_and_assigned_values_are_found_whole(spark):
    r = random.Random(6)
    pick = lambda alphabet, k: "".join(r.choice(alphabet) for _ in range(k))
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    values = {1: pick(letters + "0123456789+/", 1600), 2: pick(letters, 32), 3: "Tr0ub&dor!9x", 4: pick(letters + "0123456789", 200_000)}
    texts = {i: f'the value password = "{v}" and more' for i, v in values.items()}
    texts[3] += " Tr0ub&dor!9x and xTr0ub&dor!9x"
    docs = spark.createDataFrame([(i, t, "src/main.py", 0) for i, t in texts.items()], "doc_id int, text string, source string, n_chars int")
    rows = {(x["doc_id"], x["start"], x["value"]): x["secret"] for x in find_secrets(docs).collect()}
    for i, v in values.items():
        assert (i, texts[i].index(v) + 1, v) in rows
    out = {x["doc_id"]: x["text"] for x in redact(docs).collect()}
    for i in (1, 2):
        assert rows[i, texts[i].index(values[i]) + 1, values[i]] and out[i] == 'the value password = "[secret]" and more'
    assert rows[3, texts[3].index(values[3]) + 1, values[3]] and out[3] == 'the value password = "[secret]" and more [secret] and xTr0ub&dor!9x'


def test_every_occurrence_is_judged_where_it_stands(spark):
    r = random.Random(5)
    a, b, c = ("".join(r.choice("0123456789abcdef") for _ in range(40)) for _ in range(3))
    texts = {
        1: f'see commit {a} of the build and later on token = "{a}" end',
        2: f'path/{b}/more of it \U0001f600 and then token = "{b}" end',
        3: f'commit {c} and commit {c} end',
        4: " ".join(f"{i:016d}-{i % 7}" for i in range(1500)) + f' {a}\n{b},{c}',
    }
    docs = spark.createDataFrame([(i, t, "src/main.py", 0) for i, t in texts.items()], "doc_id int, text string, source string, n_chars int")
    places = find_occurrences(docs)
    assert python_free(places)
    rows = places.collect()
    for i, t in texts.items():
        assert sorted((x["start"], x["value"]) for x in rows if x["doc_id"] == i) == [(m.start() + 1, m[0]) for m in re.finditer(CANDIDATE, t)]
    found = {(x["doc_id"], x["value"]): x for x in find_secrets(docs).collect()}
    for (i, v), x in found.items():
        own = [y for y in rows if (y["doc_id"], y["value"]) == (i, v)]
        assert x["score"] == max(y["score"] for y in own) and x["start"] == min(y["start"] for y in own)
    assert found[1, a]["secret"] and found[2, b]["secret"] and not found[3, c]["secret"]
    assert found[2, b]["start"] == texts[2].rindex(b) + 1
    out = {x["doc_id"]: x["text"] for x in redact(docs).collect()}
    assert a not in out[1] and b not in out[2] and out[3] == texts[3]


def test_query(spark, small, small_docs):
    """Every candidate of a plain scan of the texts, once in each document, and planted tokens are secrets."""
    rows = op2_secret_scan(spark, small).collect()
    want = {(i, t.index(v) + 1, len(v)) for i, t in small_docs.items() for v in set(re.findall(CANDIDATE, t))}
    assert {(x["doc_id"], x["start"], x["length"]) for x in rows} == want
    for x in rows:
        before = small_docs[x["doc_id"]][: x["start"] - 1]
        assert x["secret"] == before.endswith('token = "')


def features_in_python(value, before, after, path):
    """Every feature by its definition."""
    n, low = len(value), value.lower()
    kinds = ["A" if "A" <= c <= "Z" else "a" if "a" <= c <= "z" else "0" if c in "0123456789" else "-" if c in "+/_-=" else c for c in value]
    counts = {c: value.count(c) for c in set(value)}
    known = {zlib.crc32(w.encode()) % (1 << 19) for w in dictionary()}
    bigrams = "th he in er an re nd at on nt ha es st en ed to it ou ea is or ti as te et ng of al de se le ar ve ra ur ro io co me ic".split()
    out = {
        "length": n,
        "digits": sum(c in "0123456789" for c in value) / n,
        "uppers": sum("A" <= c <= "Z" for c in value) / n,
        "transitions": sum(a != b for a, b in zip(kinds, kinds[1:])) / n,
        "distinct": len(counts) / n,
        "entropy": -sum(k / n * math.log2(k / n) for k in counts.values()),
        "bigrams": sum(low[i : i + 2] in bigrams for i in range(n)) / n,
        "coverage": sum(len(w) for w in re.findall("[A-Z]?[a-z]{3,}|[A-Z]{4,}", value) if zlib.crc32(w.lower().encode()) % (1 << 19) in known) / n,
        "hex": all(c in "0123456789abcdef" for c in low),
        "dashes": sum(c in "_/-" for c in value) / n,
        "prefix": value.startswith(("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghr_", "ghs_", "xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-", "sk_live", "rk_live", "eyJ", "AIza", "glpat-", "npm_", "SG")),
        "test_path": any(w in path.lower() for w in ("test", "example", "sample", "fixture", "mock", "doc/", "docs/", "vendor", "readme", "demo")),
        "assigned": bool(re.search("[=:>]\\s*[\"'`]?$", before)) and not re.search("[^=]>\\s*[\"'`]?$", before),
        "quoted": before[-1:] in ("'", '"', "`") and before != "" and after[:1] in ("'", '"', "`") and after != "",
        "has_digit": any(c in "0123456789" for c in value),
        "marks": sum(not (c.isascii() and (c.isalnum() or c in "+/_-=")) and not c.isspace() for c in value) / n,
        "spaces": sum(c.isspace() for c in value) / n,
    }
    for name, words in (("before", re.findall("[a-z]{2,}", before.lower())[::-1][:4]), ("after", re.findall("[a-z]{2,}", after.lower())[:2])):
        buckets = {zlib.crc32(w.encode()) % BUCKETS for w in words}
        out |= {f"{name}_{i}": i in buckets for i in range(BUCKETS)}
    return out


def test_features_by_definition(spark):
    rows = labelled_findings(600, seed=5)
    table = findings_table(spark, rows)
    got = table.select("value", "before", "after", "path", *(c.cast("double").alias(n) for n, c in features(*(F.col(c) for c in ("value", "before", "after", "path"))).items())).collect()
    assert len(dictionary()) > 10_000 and {"password", "secret", "message"} <= set(dictionary())
    for r in got:
        for name, want in features_in_python(r["value"], r["before"], r["after"], r["path"]).items():
            assert abs(r[name] - float(want)) < 1e-9, (name, r["value"], r["before"], r["after"], r[name], want)


def test_findings_of_one_kind_and_of_none(spark, edge):
    r = random.Random(3)
    key = "".join(r.choice("0123456789abcdef") for _ in range(40))
    docs = spark.createDataFrame([(1, f'token = "{key}" or commit {key[::-1]}', "a.py")], "doc_id int, text string, source string")
    good = [("x1" * 10, "token = ", "", "a", 1)]
    for rows, want in (([], True), (good, True), ([(*good[0][:4], 0)], False), ([(None, None, None, None, None)], True)):
        found = find_secrets(docs, findings_table(spark, rows)).collect()
        assert len(found) == 2 and {r["secret"] for r in found} == {want}
    both = findings_table(spark, [*labelled_findings(300), (None, None, None, None, 0)])
    assert find_secrets(docs, both).count() == 2 and python_free(redact(edge, both))


def test_words_around_are_learnt(spark):
    """Labels that follow from one neighbouring word, of which no pattern speaks."""
    r = random.Random(9)
    value = lambda: "".join(r.choice("0123456789abcdefghij") for _ in range(24))
    rows = [(value(), f"some {w} ", f" and {r.choice(('more', 'less'))}", "", int(w == "zebra")) for w in ("zebra", "lemon") * 150]
    docs = spark.createDataFrame([(i, f"some {w} {value()} and more", "") for i, w in enumerate(("zebra", "lemon") * 20)], "doc_id int, text string, source string")
    found = find_secrets(docs, findings_table(spark, rows)).collect()
    assert len(found) == 40 and all(x["secret"] == (x["doc_id"] % 2 == 0) for x in found)
