import re

import corpus_pipeline
from blockquery.llm.best_fit_packing import pack_documents
from blockquery.llm.line_crf import classify
from blockquery.llm.minhash_dedup import link_documents
from blockquery.llm.secret_scan import find_secrets
from blockquery.llm.source_mixing import quotas
from blockquery.llm.common import default_vocabulary
from pyspark.sql import functions as F
from tokenizers import Tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def stages(spark, docs, sf_dir, tmp_path):
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{name}")
        docs = out[name] = spark.read.parquet(f"{tmp_path}/{name}")
    return out


def test_stages(spark, small, tmp_path):
    planted = F.concat("text", F.lit(' token = "'), F.sha1(F.col("doc_id").cast("string")), F.lit('" and so on'))
    docs = spark.read.parquet(f"{small}/documents.parquet").withColumn("text", F.when(F.col("doc_id") % 7 == 0, planted).otherwise(F.col("text")))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "secrets", "mixing", "packing"]
    out = stages(spark, docs, small, tmp_path)
    rows = {n: df.collect() for n, df in out.items()}
    for name in list(out)[:-1]:
        assert out[name].columns == docs.columns
    ids = lambda x: sorted(r["doc_id"] for r in x)
    labels = spark.read.parquet(f"{small}/labels.parquet")
    assert ids(rows["quality"]) == ids(classify(docs, labels).where("predicted = 1").collect()) and len(rows["quality"]) < docs.count()
    assert ids(rows["near_duplicates"]) == ids(link_documents(out["quality"]).where("kept").collect())
    secrets = [r for r in find_secrets(out["near_duplicates"]).collect() if r["secret"]]
    after = {r["doc_id"]: r for r in rows["secrets"]}
    assert len(secrets) >= 5 and ids(rows["secrets"]) == ids(rows["near_duplicates"])
    for r in secrets:
        assert r["value"] not in after[r["doc_id"]]["text"] and "[secret]" in after[r["doc_id"]]["text"]
    clean = {r["doc_id"]: r for r in rows["near_duplicates"] if r["doc_id"] not in {s["doc_id"] for s in secrets}}
    assert all(after[i]["text"] == r["text"] for i, r in clean.items())
    sizes, taken = {}, {}
    for r in rows["secrets"]:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(WORD.findall(r["text"]))
    copies = {}
    for r in rows["mixing"]:
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + 1
        taken[r["source"]] = taken.get(r["source"], 0) + len(WORD.findall(r["text"]))
    assert max(copies.values()) <= 2
    for s, want in quotas(sizes).items():
        largest = max(len(WORD.findall(r["text"])) for r in rows["secrets"] if r["source"] == s)
        assert abs(taken.get(s, 0) - want) <= largest
    t = Tokenizer.from_file(default_vocabulary())
    total = sum(len(t.encode(r["text"], add_special_tokens=False).ids) + 1 for r in rows["mixing"])
    assert sum(r["length"] for r in rows["packing"]) == total
    again = pack_documents(out["mixing"]).selectExpr("sum(ids_crc32)").first()[0]
    assert again == sum(r["ids_crc32"] for r in rows["packing"])


def test_edge_cases(spark, edge, nothing, tmp_path):
    labels = spark.createDataFrame([(5, 1), (8, 0), (6, 1), (12, 0)], "doc_id bigint, quality int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for name, docs in (("edge", edge), ("nothing", nothing)):
        out = stages(spark, docs, str(tmp_path), tmp_path / name)
        for stage in list(out)[:-1]:
            assert out[stage].columns == docs.columns
        if name == "nothing":
            assert out["packing"].count() == 0
            continue
        ids = {stage: sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in df.collect()) for stage, df in out.items()}
        assert set(ids["quality"]) <= {(d["doc_id"] is None, d["doc_id"] or 0) for d in docs.collect()}
        # one row for each id, and of equal texts the smallest
        known = [i for none, i in ids["near_duplicates"] if not none]
        assert len(known) == len(set(known)) and 7 not in known and 11 not in known and set(known) <= {i for _, i in ids["quality"]}
        assert ids["secrets"] == ids["near_duplicates"] and set(ids["mixing"]) <= set(ids["secrets"])
        assert not {1, 2, 3} & {i for _, i in ids["mixing"]} and max(map(ids["mixing"].count, ids["mixing"])) <= 2
        before = {r["doc_id"]: r for r in docs.collect()}
        for r in out["mixing"].collect():  # every other column as it was
            assert all(r[c] == before[r["doc_id"]][c] for c in docs.columns if c not in ("text", "n_chars"))
        assert sorted(set(ids["packing"])) == sorted(set(ids["mixing"]))


def test_without_labels_of_both_kinds(spark, edge, tmp_path):
    for quality, n in ((1, edge.count()), (0, 0)):
        base = f"{tmp_path}/{quality}"
        spark.createDataFrame([(5, quality), (6, quality)], "doc_id bigint, quality int").write.parquet(f"{base}/labels.parquet")
        assert corpus_pipeline.quality(spark, edge, base).count() == n


def test_run(spark, small):
    df = corpus_pipeline.run(spark, small)
    assert df.count() > 0 and {"doc_id", "piece", "sequence_id", "offset", "length"} <= set(df.columns)
