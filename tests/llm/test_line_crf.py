import itertools
import random
import zlib

import numpy as np

from blockquery.llm import line_crf
from blockquery.llm.line_crf import WIDTH, _Sequences, classify, fit, forward_backward, keep_good, line_features, line_marginals, mixed_sequences, op3_line_crf, own_features, scores

from .conftest import PROSE


def test_forward_backward_by_enumeration():
    r = np.random.default_rng(1)
    n, a = np.array([5, 3, 1]), r.normal(size=(2, 2))
    u = np.where(np.arange(5)[None, :] < n[:, None], r.normal(size=(3, 5)), 0.0)
    *_, log_z, good = forward_backward(u, n, a)
    for d in range(3):
        weight = {}
        for y in itertools.product((0, 1), repeat=int(n[d])):
            weight[y] = np.exp(sum(u[d, t] for t in range(n[d]) if y[t]) + sum(a[p, q] for p, q in zip(y, y[1:])))
        z = sum(weight.values())
        assert np.isclose(np.log(z), log_z[d])
        for t in range(n[d]):
            assert np.isclose(sum(w for y, w in weight.items() if y[t]) / z, good[d, t])


def test_features_use_neighbours():
    x, length = line_features(b"good words here\n### $$$\n\nlast line of text.")
    assert x.shape == (4, WIDTH) and length.tolist() == [16, 8, 1, 19]
    y, _ = line_features(b"good words here\nplain words\n\nlast line of text.")
    assert (x[0] != y[0]).any() and (x[3] == y[3]).all()
    assert line_features(b"")[0].shape == (1, WIDTH)


def test_stopword_share_is_of_the_whole_line():
    head, prose, junk = PROSE.split() * 20, "The house of the river.".split() * 100, "zxqv brrk the7 qqx, mmh".split() * 100
    x, y = (line_features(" ".join(head[:400] + tail).encode())[0] for tail in (prose, junk))
    plain = sum(w in ("the", "over", "and", "then", "it", "from") and w.encode() in line_crf._STOPWORDS for w in head[:400])
    assert np.isclose(x[0, 12], (plain + 300) / 900) and np.isclose(y[0, 12], plain / 900)
    short = line_features(b"The house, of the river (the) long (river)")[0]
    assert np.isclose(short[0, 12], 4 / 8)


def corpus(n, seed):
    r = random.Random(seed)
    line = lambda: " ".join(r.choice(PROSE.split()) for _ in range(r.randint(4, 12))) + "."
    junk = lambda: "".join(r.choice("#$%|<>=_ ") for _ in range(40))
    return [(i, "\n".join((line if i % 3 else junk)() for _ in range(r.randint(1, 12))), int(i % 3 > 0)) for i in range(n)]


def test_learns_and_weighs_by_length():
    rows = corpus(120, 3)
    model = fit([(line_features(t.encode())[0], y) for _, t, y in rows])
    held = corpus(90, 4)
    got = scores(model, [t.encode() for _, t, _ in held])
    assert sum((s >= 0.7) == bool(y) for s, (_, _, y) in zip(got, held)) >= 85
    one = [scores(model, [t.encode()])[0] for _, t, _ in held]  # batches do not change a score
    assert np.allclose(one, got)
    mixed = (PROSE * 5 + ".\n" + "#$%| " * 3).encode()
    assert scores(model, [mixed])[0] > 0.5


def enumerated(model, text):
    """The score of a text, by all labellings of its lines."""
    x, length = line_features(text)
    u, a = ((x.astype(float) - model.mean) / model.scale) @ model.weights, model.transitions
    z = good = 0.0
    for y in itertools.product((0, 1), repeat=len(u)):
        w = np.exp(sum(v for v, q in zip(u, y) if q) + sum(a[p, q] for p, q in zip(y, y[1:])))
        z, good = z + w, good + w * sum(n for n, q in zip(length, y) if q) / length.sum()
    return good / z


def test_scores_by_enumeration():
    model = fit([(line_features(t.encode())[0], y) for _, t, y in corpus(60, 8)], steps=12)
    texts = [t.encode() for _, t, _ in corpus(40, 9) if t.count("\n") < 9] + [b"", b"\n\n", PROSE.encode() + b"\n#$%"]
    assert np.allclose(scores(model, texts), [enumerated(model, t) for t in texts])


def test_gradients_by_differences():
    r = np.random.default_rng(3)
    texts = [(r.normal(size=(n, 4)), y, r.uniform(1, 9, n)) for n, y in ((5, 1), (1, 0), (3, np.array([0, 1, 1])), (5, np.array([1, 0, 0, 1, 0])))]
    own = _Sequences(texts)
    w, a = r.normal(size=4), r.normal(size=(2, 2))
    _, by_line, by_pair = own.gradient(own.x @ w, a)
    loss = lambda w, a: own.gradient(own.x @ w, a)[0]
    for k in range(4):
        e = np.eye(4)[k] * 1e-6
        assert np.isclose((own.x.T @ by_line)[k], (loss(w + e, a) - loss(w - e, a)) / 2e-6, atol=1e-5)
    for p, q in itertools.product((0, 1), repeat=2):
        e = np.zeros((2, 2))
        e[p, q] = 1e-6
        assert np.isclose(by_pair[p, q], (loss(w, a + e) - loss(w, a - e)) / 2e-6, atol=1e-5)


def test_lines_of_mixed_documents(spark):
    """Junk planted in good documents is found line by line, and prose in bad ones."""
    sf_dir = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    sample = [(*own_features(texts[i]), quality[i]) for i in quality if not held(i)]
    model = fit([(line_crf._with_neighbours(x), y, n) for x, n, y in sample] + mixed_sequences(sample))
    good = [texts[i].split(b"\n") for i in quality if held(i) and quality[i] and texts[i].count(b"\n") > 3]
    # lines of bad documents that are bad themselves: every other word in marks or capitals
    junk = [[x for x in texts[i].split(b"\n") if sum(w != w.lower() or not w.isalpha() for w in x.split()) * 2 > len(x.split()) > 3] for i in quality if held(i) and not quality[i]]
    junk = [x for x in junk if len(x) > 1]
    r, right, total, both = random.Random(1), 0, 0, 0
    for _ in range(200):
        own, block = r.choice(good), r.choice(junk)[: r.randint(2, 5)]
        at = r.randint(1, len(own) - 1)
        (found, _), = line_marginals(model, [b"\n".join(own[:at] + block + own[at:])])
        want = [1] * at + [0] * len(block) + [1] * (len(own) - at)
        right, total = right + sum((p >= 0.5) == q for p, q in zip(found, want)), total + len(want)
        both += found.min() < 0.5 <= found.max()
    assert len(good) > 20 and len(junk) > 5 and right >= 0.9 * total and both >= 190


def test_edge_cases(spark, edge, nothing):
    labels = spark.createDataFrame([(5, 1), (8, 0), (6, 1), (6, 0), (4, None), (None, 1), (12, 0), (10, 0), (7, 1)], "doc_id bigint, quality int")
    rows = classify(edge, labels).collect()
    assert len(rows) == edge.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) and r["held_out"] is not None for r in rows)
    by = {r["doc_id"]: r["score"] for r in rows}
    assert by[6] == by[7] and by[1] == by[2] and by[10] == by[11]
    kept = keep_good(edge, labels)
    assert kept.columns == edge.columns and kept.count() == sum(r["predicted"] for r in rows)
    assert classify(nothing, labels).count() == 0
    assert {r["score"] for r in classify(edge, labels.where("false")).collect()} == {1.0}
    assert {r["score"] for r in classify(edge, labels.where("quality = 0")).collect()} == {0.0}


def test_labels_of_the_held_out_fold_are_not_used(spark, small):
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    from pyspark.sql import functions as F

    flipped = labels.withColumn("quality", F.when(line_crf.bucket_of("doc_id", 4) == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r["doc_id"]: r["score"] for r in classify(docs, x).collect()} for x in (labels, flipped))
    assert a == b


def test_query_held_out_accuracy(spark, small):
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    rows = [r for r in op3_line_crf(spark, small).collect() if r["held_out"] and r["doc_id"] in truth]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in rows) >= 0.9 * len(rows)
