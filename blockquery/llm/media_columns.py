"""Media columns: bytes kept losslessly as FLAC, decoded with every checksum verified into seekable PCM blocks.

`encode` makes a payload 8-bit mono samples; `decode` gives PCM blocks with the offset of their first sample, and fails on
a stream whose frame checksums or MD5 do not match; `describe` computes digests and features of a stream's PCM blocks.
`store` writes the streams, each distinct text's once, and `media_columns` reads them back from there.

A null payload is empty; a payload is padded with zero bytes to a positive multiple of 64. Repeated rows, and rows with
equal texts or ids, are answered each on their own and equal texts alike; a null id stays null. An empty table gives an
empty result. Other columns are not read. A very long text is coded by groups of frames: its task holds the text, its
stream and about 100 MB (tests hold 64 MiB to 1 GB).
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import flac
from .common import Scratch, documents, text_bytes, text_slices

UNIT = 64
#: Bytes of payload that are coded together; the bits of these, and places in them, are what a task holds.
TOGETHER = 1 << 20
#: Digests of texts that several rows share are broadcast up to so many (some 300 bytes each), and joined by a shuffle beyond.
BROADCAST_SHARED = 100_000


def padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % UNIT or (0 if data else UNIT))


def encode(docs: DataFrame, *keys: str) -> DataFrame:
    """keys (doc_id, if none are named), n_bytes (unpadded), media: the text of each row as a FLAC stream."""
    keys = keys or ("doc_id",)
    schema = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys) + ", n_bytes bigint, media binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches, TOGETHER):
            media = flac.encode_many([padded(t) for t in texts])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], [*keys, "n_bytes", "media"])

    return text_bytes(docs, *keys).mapInArrow(run, schema)


def _media_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for batch in batches:
        media = batch.column(batch.schema.get_field_index("media")).to_pylist()
        start, total = 0, 0
        for i, m in enumerate(media):
            if i > start and total + len(m) > TOGETHER:
                yield batch.slice(start, i - start), media[start:i]
                start, total = i, 0
            total += len(m)
        if start < len(media):
            yield batch.slice(start), media[start:]


def decode(streams: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, block, sample_offset, n_samples, pcm: a row for each block of each stream."""
    kind = streams.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, media in _media_slices(batches):
            decoded = flac.decode_many(media)
            at = [i for i, blocks in enumerate(decoded) for _ in blocks]
            flat = [(j, s, p) for blocks in decoded for j, (s, p) in enumerate(blocks)]
            frame = [(info.bits + 7) // 8 * info.channels for info in map(flac.parse_metadata, media)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array([j for j, _, _ in flat], pa.int32()), pa.array([s for _, s, _ in flat], pa.int64()), pa.array([len(p) // frame[i] for i, (_, _, p) in zip(at, flat)], pa.int32()), pa.array([p for _, _, p in flat], pa.binary())],
                [key, "block", "sample_offset", "n_samples", "pcm"],
            )

    return streams.select(key, "media").mapInArrow(run, f"`{key}` {kind}, block int, sample_offset bigint, n_samples int, pcm binary")


def _crossings(x: np.ndarray, before: int | None) -> int:
    own = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return own + (before is not None and len(x) > 0 and (before < 0) != (x[0] < 0))


def summary(blocks: list[tuple[int, bytes]]) -> tuple:
    """Bytes, SHA-256, checksum of the last UNIT bytes and features of 8-bit PCM blocks, a block at a time; `seek` is the crc32 of their sample offsets as little-endian 64-bit integers."""
    sha, tail, n, total, energy, crossings, low, high, last = hashlib.sha256(), b"", 0, 0, 0, 0, 127, -128, None
    for _, pcm in blocks:
        sha.update(pcm)
        x = np.frombuffer(pcm, np.uint8).astype(np.int64) - 128
        tail, n, total, energy = (tail + pcm)[-UNIT:], n + len(x), total + int(x.sum()), energy + int((x * x).sum())
        crossings += _crossings(x, last)
        low, high, last = min(low, int(x.min())), max(high, int(x.max())), int(x[-1])
    seek = zlib.crc32(np.array([s for s, _ in blocks], "<i8").tobytes())
    feature = f"rate={flac.RATE};blocks={len(blocks)};seek={seek};samples={n};sum={total};energy={energy};crossings={crossings};low={low};high={high}"
    return n, sha.hexdigest(), zlib.crc32(tail), feature


DESCRIBED = "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def describe(streams: DataFrame) -> DataFrame:
    """streams without their media, with digests and features computed from the bytes read back."""
    kept = [f for f in streams.schema if f.name != "media"]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        for batch, media in _media_slices(batches):
            rows = []
            for m, blocks in zip(media, flac.decode_many(media)):
                size, sha, tail, feature = summary(blocks)
                rows.append((size, sha, tail, len(m), hashlib.sha256(m).hexdigest(), feature))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))], [*names, *(c.split()[0] for c in DESCRIBED.split(", "))])

    return streams.select(*names, "media").mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", " + DESCRIBED)


def store(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, int]:
    """Writes each distinct text's stream once. Gives rows (doc_id, n_bytes, digest), streams (doc_id, digest, shared, n_bytes, media) and how many texts are shared.

    Of rows with the same text that of the smallest id has the stream; where such rows repeat an id or have none, each has.
    """
    digest = F.substring(F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)), 1, 16).alias("digest")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes")
    rows = scratch.write(docs.select("doc_id", size, digest), "rows")
    owners = rows.groupBy("digest").agg(F.min("doc_id").alias("owner"), F.count("*").alias("copies")).where("copies > 1")
    owners = scratch.write(owners.select("digest", "owner", F.lit(True).alias("shared")), "owners")
    many = owners.count()
    found = docs.select("doc_id", "text", digest).join(F.broadcast(owners) if many <= BROADCAST_SHARED else owners, "digest", "left")
    first = F.col("owner").isNull() | F.coalesce(F.col("doc_id") == F.col("owner"), F.lit(False))
    streams = encode(found.where(first).select("doc_id", "digest", F.coalesce("shared", F.lit(False)).alias("shared"), "text"), "doc_id", "digest", "shared")
    return rows, scratch.write(streams, "streams", ("shared",)), many


def media_columns(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and what the stored stream of each row's text says when it is read back."""
    scratch = Scratch(docs.sparkSession, "media")
    rows, streams, many = store(docs.select("doc_id", "text"), scratch)
    alone = describe(streams.where("NOT shared").select("doc_id", "n_bytes", "media"))
    if not many:
        return alone
    names = [c.split()[0] for c in DESCRIBED.split(", ")]
    of_shared = describe(streams.where("shared").select("digest", "media")).groupBy("digest").agg(*(F.first(c).alias(c) for c in names))
    of_shared = scratch.write(of_shared, "described")
    return alone.unionByName(rows.join(F.broadcast(of_shared) if many <= BROADCAST_SHARED else of_shared, "digest").select("doc_id", "n_bytes", *names))


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(documents(spark, sf_dir))


QUERIES = {"op8_media_columns": op8_media_columns}
ORACLES: dict[str, str] = {}
