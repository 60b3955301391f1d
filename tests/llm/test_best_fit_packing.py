import math
import random
import zlib

import pytest
from tokenizers import Tokenizer

from blockquery.llm.best_fit_packing import OpenBins, op5_best_fit_packing, pack_documents
from blockquery.llm.common import default_vocabulary


def test_bins_by_brute_force():
    r = random.Random(1)
    for most in (1, 3, 8):
        bins, open_, made = OpenBins(20, most), {}, 0
        for _ in range(500):
            n = r.randint(1, 20)
            seq, offset = bins.place(n)
            fits = [f for f in open_.values() if f >= n]
            if fits:
                assert open_[seq] == min(fits) and offset == 20 - open_[seq]
            else:
                if len(open_) >= most:
                    fullest = min(open_.values())
                    closed = next(k for k, f in open_.items() if f == fullest and k not in {x for own in bins.by_free.values() for x in own})
                    del open_[closed]
                assert seq == made and offset == 0
                open_[seq], made = 20, made + 1
            open_[seq] -= n
            if not open_[seq]:
                del open_[seq]
            assert len(open_) <= most and sorted(open_) == sorted(x for own in bins.by_free.values() for x in own)


def check(rows, texts, sequence=4096):
    t = Tokenizer.from_file(default_vocabulary())
    ids = {i: t.encode(x or "", add_special_tokens=False).ids + [1] for i, x in texts.items()}
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(ids)
    for i, own in by_doc.items():
        own.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own))) and len(own) == math.ceil(len(ids[i]) / sequence)
        for k, r in enumerate(own):
            part = ids[i][k * sequence : (k + 1) * sequence]
            assert (r["start"], r["length"]) == (k * sequence, len(part))
            assert r["ids_crc32"] == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))
    for own in by_seq.values():
        own.sort(key=lambda r: r["offset"])
        assert own[0]["offset"] == 0 and all(a["offset"] + a["length"] == b["offset"] for a, b in zip(own, own[1:]))
        assert own[-1]["offset"] + own[-1]["length"] <= sequence
    return sum(len(x) for x in ids.values()), len(by_seq)


def test_query(spark, small, small_docs):
    total, sequences = check(op5_best_fit_packing(spark, small).collect(), small_docs)
    assert sequences <= math.ceil(total / 4096) * 1.02 + 1


def test_edge_cases(spark, edge, nothing):
    rows = pack_documents(edge.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]), sequence=64).collect()
    check(rows, {r["doc_id"]: r["text"] for r in edge.collect() if r["doc_id"] is not None}, 64)
    whole = pack_documents(edge).collect()
    assert sum(r["doc_id"] == 9 for r in whole) == 2 and sum(r["doc_id"] is None for r in whole) == 1
    assert pack_documents(nothing).count() == 0
    with_ids = pack_documents(edge, with_ids=True).collect()
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] for r in with_ids)


@pytest.mark.parametrize("streams", [1, 50])
def test_streams(spark, streams):
    docs = spark.createDataFrame([(i, "w " * (i % 90)) for i in range(200)], "doc_id int, text string")
    from blockquery.llm.best_fit_packing import pack, token_pieces

    pieces = token_pieces(docs, default_vocabulary(), 100)
    rows = pack(pieces, 200, 100, stream_pieces=200 // streams).collect()
    check(rows, {i: "w " * (i % 90) for i in range(200)}, 100)


def test_full_pieces_close_nothing():
    bins = OpenBins(100, 4)
    for n in (60, 61, 62, 63):
        bins.place(n)
    for _ in range(50):
        assert bins.alone()[1] == 0
    assert bins.count == 4 and bins.place(37) == (3, 63)
