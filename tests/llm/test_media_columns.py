import hashlib
import os
import random
import subprocess
import sys
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from blockquery.llm import flac
from blockquery.llm.common import Scratch
from blockquery.llm.media_columns import decode, describe, encode, media_columns, op8_media_columns, padded, store

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_padding():
    assert padded(b"") == bytes(64) and len(padded(b"x" * 64)) == 64 and len(padded(b"x" * 65)) == 128


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=9000), min_size=1, max_size=4))
def test_round_trip(payloads):
    payloads = [padded(p) for p in payloads]
    media = flac.encode_many(payloads)
    assert media == [flac.encode_many([p])[0] for p in payloads]
    for p, m, blocks in zip(payloads, media, flac.decode_many(media)):
        assert m[:4] == b"fLaC" and b"".join(x for _, x in blocks) == p
        assert [at for at, _ in blocks] == np.cumsum([0, *(len(x) for _, x in blocks[:-1])]).tolist()
        info, plain = flac.decode_plain(m)
        assert b"".join((x[0] + 128).astype(np.uint8).tobytes() for _, x in plain) == p


def test_shapes_of_sound():
    r = np.random.default_rng(1)
    t = np.arange(20_000)
    for x in (np.full(5000, 128), 128 + 100 * np.sin(t / 9), r.integers(0, 256, 20_000), t % 256, np.where(t % 2048 < 3, 255, 0)):
        p = padded(x.astype(np.uint8).tobytes())
        media = flac.encode_many([p])[0]
        assert b"".join(b for _, b in flac.decode_many([media])[0]) == p
        for at in (0, 1, len(p) // 2, len(p) - 1):
            first, samples = flac.seek(media, at)
            assert first <= at < first + samples.shape[1] and samples[0][at - first] + 128 == p[at]
    assert len(flac.encode_many([bytes([128]) * 20_000])[0]) < 2000  # constant sound is small
    with pytest.raises(ValueError):
        flac.seek(media, 10**9)


def test_damage_is_found():
    r = random.Random(5)
    p = padded("some text that is coded as sound, ".encode() * 200)
    media = flac.encode_many([p])[0]
    for _ in range(200):
        at = r.randrange(len(media))
        bad = bytearray(media)
        bad[at] ^= 1 << r.randrange(8)
        try:
            got = b"".join(x for _, x in flac.decode_many([bytes(bad)])[0])
        except ValueError:
            continue
        assert got == p  # a bit that says nothing about the samples
    for cut in range(0, len(media), 7):
        with pytest.raises(ValueError):
            flac.decode_many([media[:cut]])


def test_checksums():
    assert flac.crc8(b"123456789") == 0xF4 and flac.crc16(b"123456789") == 0xFEE8


# --- streams that the encoder does not make, put together bit by bit -----------------------------


def bits(v, n):
    return format(v & (1 << n) - 1, f"0{n}b") if n else ""


def rice(e, k):
    u = 2 * e if e >= 0 else -2 * e - 1
    return "0" * (u >> k) + "1" + bits(u, k)


def residual(x, order, coefficients, shift):
    return [x[i] - (sum(c * x[i - 1 - j] for j, c in enumerate(coefficients)) >> shift) for i in range(order, len(x))]


def coded(e, order, n, partitions=0, method=0, escapes=(), k=3):
    out, per, at = bits(method, 2) + bits(partitions, 4), n >> partitions, 0
    for p in range(1 << partitions):
        own = e[at : at + per - (order if p == 0 else 0)]
        at += len(own)
        if p in escapes:
            width = max(v.bit_length() + 1 for v in own)
            out += "1" * (4 + method) + bits(width, 5) + "".join(bits(v, width) for v in own)
        else:
            out += bits(k + p % 2, 4 + method) + "".join(rice(v, k + p % 2) for v in own)
    return out


def linear(x, coefficients, precision, shift, width=8, **how):
    order = len(coefficients)
    head = "0" + bits(31 + order, 6) + "0" + "".join(bits(v, width) for v in x[:order]) + bits(precision - 1, 4) + bits(shift, 5) + "".join(bits(c, precision) for c in coefficients)
    return head + coded(residual(x, order, coefficients, shift), order, len(x), **how)


def fixed(x, order, width=8, wasted=0, **how):
    own = [v >> wasted for v in x]
    head = "0" + bits(8 + order, 6) + ("1" + "0" * (wasted - 1) + "1" if wasted else "0") + "".join(bits(v, width - wasted) for v in own[:order])
    return head + coded(residual(own, order, ([], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1])[order], 0), order, len(x), **how)


def stream(n, subframes, layout=0, channels=1, seek=True, pcm=b""):
    head = bytes([0xFF, 0xF8, 7 << 4, layout << 4 | 1 << 1, 0]) + (n - 1).to_bytes(2, "big")
    body = "".join(subframes)
    frame = head + bytes([flac.crc8(head)]) + int(body + "0" * (-len(body) % 8), 2).to_bytes((len(body) + 7) // 8, "big")
    frame += flac.crc16(frame).to_bytes(2, "big")
    info = n.to_bytes(2, "big") * 2 + bytes(6) + (8000 << 44 | (channels - 1) << 41 | 7 << 36 | n).to_bytes(8, "big") + hashlib.md5(pcm).digest()
    table = bytes(16) + n.to_bytes(2, "big")
    return b"fLaC" + bytes([0 if seek else 0x80, 0, 0, len(info)]) + info + (bytes([0x83, 0, 0, 18]) + table if seek else b"") + frame


def wave(n, seed):
    r = random.Random(seed)
    return [max(-128, min(127, int(90 * np.sin(i / 7 + seed) + r.randint(-9, 9)))) for i in range(n)]


def signed(x):
    return bytes(v & 255 for v in x)


def test_streams_of_other_encoders():
    r, n = random.Random(3), 1024
    made = []
    for seed in range(12):
        x, order = wave(n, seed), (1, 2, 3, 4, 5, 6, 7, 8, 12, 16, 24, 32)[seed]
        c = [r.randint(-200, 200) for _ in range(order)]
        made.append((x, stream(n, [linear(x, c, 9, 7)], pcm=signed(x))))
        made.append((x, stream(n, [linear(x, c, 12, 8, partitions=2)], pcm=signed(x))))
        made.append((x, stream(n, [linear(x, c, 9, 7, partitions=3, escapes=(1, 4), method=1)], seek=False, pcm=signed(x))))
    for order in range(5):
        x = wave(n, 50 + order)
        made += [(x, stream(n, [fixed(x, order)], pcm=signed(x))), (x, stream(n, [fixed(x, order, partitions=4, escapes=(0, 15))], pcm=signed(x)))]
        x = [v // 4 * 4 for v in x]
        made.append((x, stream(n, [fixed(x, order, wasted=2)], pcm=signed(x))))
    expected = [bytes((v + 128) & 255 for v in x) for x, _ in made]
    assert [b"".join(p for _, p in blocks) for blocks in flac.decode_many([m for _, m in made])] == expected
    for want, (x, m) in zip(expected, made):
        assert [b.tolist() for _, b in flac.decode_plain(m)[1]] == [[x]]


def test_stereo():
    n = 512
    left, right = wave(n, 1), wave(n, 2)
    side, mid = [a - b for a, b in zip(left, right)], [(a + b) >> 1 for a, b in zip(left, right)]
    pcm = bytes(v & 255 for pair in zip(left, right) for v in pair)
    for layout, parts in ((1, (fixed(left, 2), linear(right, [300, -100], 10, 8))), (8, (fixed(left, 1), fixed(side, 1, 9))), (9, (fixed(side, 2, 9), fixed(right, 0, k=5))), (10, (fixed(mid, 1), fixed(side, 3, 9)))):
        m = stream(n, parts, layout, 2, pcm=pcm)
        assert flac.decode_plain(m)[1][0][1].tolist() == [left, right]
        assert flac.decode_many([m]) == [[(0, pcm)]]


def test_reserved_codes_are_errors():
    x = wave(64, 1)
    good = stream(64, [fixed(x, 1)], pcm=signed(x))
    flac.decode_many([good])
    at = 4 + 4 + 34 + 4 + 18
    for offset, value in ((2, 0x00), (2, 0x7F), (3, 0xB2), (3, 0x06), (4, 0xFF), (8, 0x04), (8, 0x1C << 1)):
        bad = bytearray(good)
        bad[at + offset] = value
        bad[at + 7] = flac.crc8(bytes(bad[at : at + 7]))
        for decoder in (lambda m: flac.decode_many([m]), flac.decode_plain):
            with pytest.raises(ValueError):
                decoder(bytes(bad))


def feature_of(p, starts):
    x = [b - 128 for b in p]
    crossings = sum((a < 0) != (b < 0) for a, b in zip(x, x[1:]))
    seek = zlib.crc32(b"".join(s.to_bytes(8, "little") for s in starts))
    return f"rate=8000;blocks={len(starts)};seek={seek};samples={len(x)};sum={sum(x)};energy={sum(v * v for v in x)};crossings={crossings};low={min(x)};high={max(x)}"


def test_long_text_in_bounded_memory():
    code = """
import resource, sys, hashlib
from blockquery.llm import flac
from blockquery.llm.media_columns import summary
p = bytes(i * i * 31 % 97 + 32 for i in range(1 << 16)) * 1024
start = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
m = flac.encode_many([p])
out = summary(flac.decode_many(m)[0])
assert out[0] == len(p) and out[1] == hashlib.sha256(p).hexdigest()
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - start) >> 10)
"""
    used = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=ROOT)
    assert int(used.stdout) < 700


def test_edge_cases(spark, edge, nothing):
    streams = encode(edge)
    rows = media_columns(edge).collect()
    assert len(rows) == edge.count() and describe(streams).count() == edge.count()
    texts = {}
    for r in edge.collect():
        texts.setdefault(r["doc_id"], (r["text"] or "").encode())
    for r in rows:
        p = padded(texts[r["doc_id"]])
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(texts[r["doc_id"]]), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert r["feature"] == feature_of(p, range(0, len(p), 4096) if len(p) % 4096 >= 16 or not len(p) % 4096 else [*range(0, len(p) - 4096, 4096)])
    blocks = decode(streams)
    one = sorted((b["sample_offset"], b["pcm"]) for b in blocks.where("doc_id = 5").collect())
    assert b"".join(p for _, p in one) == padded(texts[5]) and all(b["n_samples"] == len(b["pcm"]) for b in blocks.collect())
    assert describe(encode(nothing)).count() == 0 == decode(encode(nothing)).count() == media_columns(nothing).count()


def test_copies_are_stored_once(spark):
    rows = [(i, "the same text " * 20) for i in range(40)] + [(i, f"text {i} " * 30) for i in range(40, 60)] + [(None, "without an id " * 9)] * 3 + [(70, "twice"), (70, "twice"), (71, None), (72, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    scratch = Scratch(spark, "test-media")
    _, streams, many = store(docs, scratch)
    assert many == 4 and streams.where("shared").count() == 1 + 3 + 2 + 1 and streams.where("NOT shared").count() == 20
    found = media_columns(docs).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"], r["n_bytes"]) for r in found if r["doc_id"] is not None) == sorted((False, i, len(t or "")) for i, t in rows if i is not None)
    assert len(found) == len(rows) and len({r["media_sha256"] for r in found if (r["doc_id"] or 0) < 40 and r["doc_id"] is not None}) == 1


def test_query(spark, small, small_docs):
    for r in op8_media_columns(spark, small).collect():
        p = padded(small_docs[r["doc_id"]].encode())
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(small_docs[r["doc_id"]].encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        m = flac.encode_many([p])[0]
        assert (r["media_bytes"], r["media_sha256"]) == (len(m), hashlib.sha256(m).hexdigest()) and r["feature"] == feature_of(p, [s for s, _ in flac.decode_many([m])[0]])
