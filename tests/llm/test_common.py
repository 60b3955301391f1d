import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from blockquery.llm.common import Scratch, bucket_of, chain_hash, default_vocabulary, fresh, shared_dir, text_slices, word_ids
from pyspark.sql import functions as F


def test_token_ids_are_those_of_whole_texts(small_docs):
    t = Tokenizer.from_file(default_vocabulary())
    ours = word_ids(default_vocabulary())
    r = random.Random(1)
    alphabet = list("abcXYZ019 '\t\n.,-!?<|>éÉñßİıŒœÿ#") + ["'s", "'RE", "don't", " 'll", "\r\n", " ", "­", "ǅ", "漢字", "\U0001f600", "á", "ﬁ", "\x00", "\x1c", "\x85", "<|endoftext|>", "<|startoftext|>"]
    texts = [*small_docs.values(), *("".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(3000))]
    for text in texts:
        own = ours.one(text.encode())
        assert [int.from_bytes(own[i : i + 4], "little") for i in range(0, len(own), 4)] == t.encode(text, add_special_tokens=False).ids, repr(text)


def test_slices(spark):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4]), pa.array([b"aaaa", None, b"b" * 50, b"c"], pa.binary())], ["id", "text"])
    got = [(b.column(0).to_pylist(), t) for b, t in text_slices(iter([batch]), 10)]
    assert got == [([1, 2], [b"aaaa", b""]), ([3], [b"b" * 50]), ([4], [b"c"])]


def test_buckets(spark):
    rows = spark.range(50).select("id", bucket_of("id", 10).alias("b")).collect()
    assert all(r["b"] == zlib.crc32(str(r["id"]).encode()) % 10 for r in rows)
    assert spark.createDataFrame([(None,)], "doc_id bigint").select(bucket_of()).first()[0] is None


def test_names_and_scratch(spark):
    df = spark.createDataFrame([(1, 2)], "`__id` int, `__ID_` int")
    assert fresh(df, "__id") == "__id__" and fresh(df, "x") == "x"
    s = Scratch(spark, "t")
    assert s.write(df.select(F.lit(1).alias("a")), "x").first()["a"] == 1 and s.root.startswith("file:")
    s.drop()


def test_windows():
    a = np.array([3, 1, 4, 1, 5], np.uint64)
    assert len(chain_hash(a, 6)) == 0 and len(chain_hash(a, 5)) == 1 and chain_hash(a, 2)[0] != chain_hash(a[::-1].copy(), 2)[-1]


def test_no_local_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    session = type("Session", (), {"sparkContext": Context()})()
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(session)


@pytest.mark.parametrize("name", ["op1", "op2", "op3", "op4", "op5", "op6", "op7", "op8", "op9", "op10"])
def test_registered(name):
    import __spark_entry__ as entry

    assert [q for q in entry.queries() if q.startswith(f"{name}_")]
