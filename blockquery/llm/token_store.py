"""Content-addressed store of token ids.

Layout under one root, all parquet, so that Spark's commit protocol covers lost executors:

    chunks/     digest binary, n_ids int, payload binary    each distinct chunk once; ids as little-endian uint16 or uint32
    recipes/    shard int, place bigint, doc_id, rel_start, n_tokens, root binary, digests array, lengths array    in ascending doc_id order
    shards/     shard int, base bigint, n_docs, n_tokens, root string    a row for each shard
    store/      width int, end_id bigint, vocabulary string, n_shards, n_docs, n_tokens, root string    one row

A rolling (gear) hash over the last 16 ids cuts each document's ids into chunks of `least` to `most` ids, so equal
passages give equal chunks wherever they stand.

The hash tree: a document's root is a binary tree over its chunks' digests and lengths; a leaf of its shard is the SHA-256
of its doc_id, start, length and root; blocks of `BLOCK_DOCS` leaves in order give block hashes, these in order the
shard's root, and the shards' roots in order, with the width and end id, the store's. `verify_manifest` computes all of it
anew from the recipes, `read_digests` and `read_documents` verify every chunk against its digest and every document
against its root. No group that is hashed together grows with the corpus but the list of shards.

Null text is empty: the end id alone. Null ids sort first. Repeated rows and equal ids stay separate documents (their
order among each other is any). A very long text is many chunks, and its recipe one row with 36 bytes for each. An empty
table gives an empty store. Columns beside doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, default_vocabulary, documents, file_digest, mix, text_bytes, text_slices, word_ids

END_ID = 2
WINDOW, LEAST, MOST, MASK_BITS = 16, 128, 2048, 9
#: Pieces of texts whose ids a worker remembers, in either alphabet (some 190 bytes each).
KNOWN_PIECES = 700_000
#: A range partition of recipes holds about so many documents.
SHARD_DOCS = 50_000
#: Documents whose leaves are hashed together.
BLOCK_DOCS = 1024
#: Numbers of surplus rows are broadcast up to so many (8 bytes each), and joined by a shuffle beyond.
BROADCAST_ROWS = 1_000_000
#: Digests that a task remembers to leave out chunks it has already written.
SEEN = 200_000


def marks(ids: np.ndarray, gear: np.ndarray, bits: int = MASK_BITS) -> np.ndarray:
    """Places after which a chunk may end. Only the last WINDOW ids decide, so documents may be given one after the other."""
    g = gear[ids]
    h, k = g, 1
    while k < WINDOW:  # sums over 2, 4, ... ids, each from two of half as many
        more = h.copy()
        more[k:] += h[:-k] << np.uint32(k)
        h, k = more, 2 * k
    return np.flatnonzero((h >> np.uint32(32 - bits)) == 0) + 1


def cuts(n: int, own: list[int], least: int = LEAST, most: int = MOST) -> list[int]:
    """Ends of a document's chunks of n ids; the last is n. own: its marks. None below `least` counts, and `least` > WINDOW, so what stands before the document has no say."""
    out, start = [], 0
    for m in own:
        if m - start < least:
            continue
        while m - start > most:
            start += most
            out.append(start)
        if m - start >= least and m < n:
            out.append(m)
            start = m
    while n - start > most:
        start += most
        out.append(start)
    out.append(n)
    return out


def merkle(digests: list[bytes], lengths: list[int]) -> bytes:
    """Root of a binary hash tree over chunks; leaves and inner nodes are told apart by a prefix."""
    sha = hashlib.sha256
    level = [sha(b"\0" + d + n.to_bytes(8, "little")).digest() for d, n in zip(digests, lengths)] or [sha(b"\2").digest()]
    while len(level) > 1:
        level = [sha(b"\1" + b"".join(level[i : i + 2])).digest() for i in range(0, len(level), 2)]
    return level[0]


# crc32(a + b) is crc32(a) moved on by len(b) zero bytes, xor crc32(b): chunks' checksums give their document's.
def _shift_tables() -> np.ndarray:
    """tables[b][k][v]: what byte k of a crc with value v becomes after 2**b zero bytes."""
    single = np.zeros(32, np.uint64)
    for bit in range(32):  # one zero byte
        x = 1 << bit
        for _ in range(8):
            x = (x >> 1) ^ (0xEDB88320 if x & 1 else 0)
        single[bit] = x
    out, now = [], single
    values = np.arange(256, dtype=np.uint64)
    for _ in range(40):
        tables = np.zeros((4, 256), np.uint64)
        for k in range(4):
            for bit in range(8):
                tables[k] ^= np.where(values >> np.uint64(bit) & np.uint64(1), now[8 * k + bit], np.uint64(0))
        out.append(tables)
        now = _apply(tables, now)
    return np.array(out)


def _apply(t: np.ndarray, x: np.ndarray) -> np.ndarray:
    byte = np.uint64(255)
    return t[0][x & byte] ^ t[1][x >> np.uint64(8) & byte] ^ t[2][x >> np.uint64(16) & byte] ^ t[3][x >> np.uint64(24) & byte]


def crc_shift(crc: np.ndarray, zeros: np.ndarray, tables: np.ndarray) -> np.ndarray:
    crc, zeros = crc.astype(np.uint64), zeros.astype(np.uint64)
    for b in range(int(zeros.max(initial=0)).bit_length()):
        crc = np.where(zeros >> np.uint64(b) & np.uint64(1), _apply(tables[b], crc), crc)
    return crc


def wide(vocabulary: str) -> bool:
    """Whether ids need four bytes."""
    return word_ids(vocabulary).tokenizer.get_vocab_size() > 1 << 16


def _staged(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """Recipes (kind 0) and the chunks they name (kind 1), from one pass of the tokenizer."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"kind int, doc_id {kind}, n_tokens bigint, root binary, digests array<binary>, lengths array<int>, digest binary, n_ids int, payload binary"
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen = word_ids(vocabulary, KNOWN_PIECES), set()
        large = wide(vocabulary)
        gear = (mix(np.arange(1, max(encode.tokenizer.get_vocab_size(), end_id + 1) + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
        for batch, texts in text_slices(batches):
            rows, chunks, encoded = [], [], encode(texts)
            ids = np.frombuffer(end.join(encoded) + end, "<u4")
            stored, found = (ids if large else ids.astype("<u2")).tobytes(), marks(ids, gear)
            ends = np.cumsum([len(own) // 4 + 1 for own in encoded])
            split, first = np.searchsorted(found, ends, "right").tolist(), 0
            found, width, begin = found.tolist(), 4 if large else 2, 0
            for stop, last in zip(ends.tolist(), split):
                digests, lengths, a = [], [], 0
                for b in cuts(stop - begin, [m - begin for m in found[first:last]]):
                    payload = stored[width * (begin + a) : width * (begin + b)]
                    digest = hashlib.sha256(payload).digest()
                    digests.append(digest)
                    lengths.append(b - a)
                    if digest not in seen:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(digest)
                        chunks.append((digest, b - a, payload))
                    a = b
                rows.append((stop - begin, merkle(digests, lengths), digests, lengths))
                begin, first = stop, last
            n, m = len(rows), len(chunks)
            none = lambda k, t: pa.nulls(k, t)
            both = lambda have, t, first: pa.concat_arrays([pa.array(have, t), none(m, t)] if first else [none(n, t), pa.array(have, t)])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([0] * n + [1] * m, pa.int32()),
                    pa.concat_arrays([batch.column(0), none(m, batch.column(0).type)]),
                    both([r[0] for r in rows], pa.int64(), True),
                    both([r[1] for r in rows], pa.binary(), True),
                    both([r[2] for r in rows], pa.list_(pa.binary()), True),
                    both([r[3] for r in rows], pa.list_(pa.int32()), True),
                    both([c[0] for c in chunks], pa.binary(), False),
                    both([c[1] for c in chunks], pa.int32(), False),
                    both([c[2] for c in chunks], pa.binary(), False),
                ],
                ["kind", "doc_id", "n_tokens", "root", "digests", "lengths", "digest", "n_ids", "payload"],
            )

    return text_bytes(docs, "doc_id").mapInArrow(run, schema)


def write_store(docs: DataFrame, root: str, vocabulary: str | None = None, end_id: int = END_ID, shard_docs: int = SHARD_DOCS) -> None:
    spark = docs.sparkSession
    scratch = Scratch(spark, "token-store")
    staged = _staged(docs, vocabulary or default_vocabulary(), end_id).withColumn("row", F.monotonically_increasing_id())
    staged = scratch.write(staged, "staged", ("kind",))
    chunks = staged.where("kind = 1").select("row", "digest", "n_ids", "payload")
    # a task leaves out what it has written itself; of what several have, all but one row are left out here. Only digests move
    twice = chunks.groupBy("digest").agg(F.min("row").alias("first"), F.count("*").alias("rows")).where("rows > 1")
    surplus = scratch.write(chunks.select("digest", "row").join(twice, "digest").where("row != first").select("row"), "surplus")
    chunks = chunks.join(F.broadcast(surplus) if surplus.count() <= BROADCAST_ROWS else surplus, "row", "left_anti").drop("row")
    chunks.write.mode("overwrite").option("compression", "zstd").parquet(f"{root}/chunks")
    recipes = staged.where("kind = 0").select("doc_id", "n_tokens", "root", "digests", "lengths")
    shards = max(1, -(-recipes.count() // shard_docs))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, at, place = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            n = np.array(batch.column(1).to_pylist(), np.int64)
            starts, places = at + np.cumsum(n) - n, place + np.arange(len(n))
            at, place = at + int(n.sum()), place + len(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), shard), pa.int32()), pa.array(places, pa.int64()), batch.column(0), pa.array(starts, pa.int64()), *batch.columns[1:]], ["shard", "place", "doc_id", "rel_start", *batch.schema.names[1:]])

    ordered = recipes.repartitionByRange(shards, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    written = ordered.mapInArrow(run, f"shard int, place bigint, doc_id {kind}, rel_start bigint, n_tokens bigint, root binary, digests array<binary>, lengths array<int>")
    written.write.mode("overwrite").option("compression", "zstd").parquet(f"{root}/recipes")
    vocabulary = vocabulary or default_vocabulary()
    about = (4 if wide(vocabulary) else 2, end_id, file_digest(vocabulary))
    rows, store = manifest(spark.read.parquet(f"{root}/recipes"), about)
    spark.createDataFrame(rows, SHARD_ROW).coalesce(1).write.mode("overwrite").parquet(f"{root}/shards")
    spark.createDataFrame([store], STORE_ROW).coalesce(1).write.mode("overwrite").parquet(f"{root}/store")
    scratch.drop()


SHARD_ROW = "shard int, base bigint, n_docs bigint, n_tokens bigint, root string"
STORE_ROW = "width int, end_id bigint, vocabulary string, n_shards bigint, n_docs bigint, n_tokens bigint, root string"


def manifest(recipes: DataFrame, about: tuple[int, int, str]) -> tuple[list[tuple], tuple]:
    """A row for each shard and the store's own row, hashed from the recipes. about: width, end id and digest of the vocabulary."""
    # the id comes last, as it may hold anything
    leaf = F.sha2(F.concat(F.concat_ws(" ", "place", "rel_start", "n_tokens", F.hex("root")), F.coalesce(F.concat(F.lit(" "), F.col("doc_id").cast("string")), F.lit(""))), 256)
    hashed = lambda column, order: F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, column))), lambda x: x[column]), ","), 256)
    leaves = recipes.select("shard", F.floor(F.col("place") / BLOCK_DOCS).alias("block"), "place", "n_tokens", leaf.alias("leaf"))
    blocks = leaves.groupBy("shard", "block").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), hashed("leaf", "place").alias("own"))
    shards = blocks.groupBy("shard").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), hashed("own", "block").alias("root"))
    rows, base, docs = [], 0, 0
    for shard, n_docs, n_tokens, root in sorted(shards.collect()):  # a row for each SHARD_DOCS documents
        rows.append((shard, base, n_docs, n_tokens, root))
        base, docs = base + n_tokens, docs + n_docs
    width, end_id, vocabulary = about
    whole = hashlib.sha256("\n".join([f"{width} {end_id} {vocabulary}", *(f"{shard} {first} {root}" for shard, first, _, _, root in rows)]).encode()).hexdigest()
    return rows, (width, end_id, vocabulary, len(rows), docs, base, whole)


def stored_width(spark: SparkSession, root: str) -> int:
    return spark.read.parquet(f"{root}/store").first()["width"]


def verified_chunks(spark: SparkSession, root: str) -> DataFrame:
    """digest, crc (of the ids as uint32) and n_ids of each chunk as stored; a chunk that does not match its digest fails the job."""
    width = stored_width(spark, root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, payloads = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            crc, n = [], []
            for d, p in zip(digests, payloads):
                if hashlib.sha256(p).digest() != d:
                    raise ValueError(f"chunk {d.hex()} does not match its digest")
                ids = np.frombuffer(p, f"<u{width}")
                crc.append(zlib.crc32(ids.astype("<u4")))
                n.append(len(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(crc, pa.int64()), pa.array(n, pa.int32())], ["digest", "crc", "n_ids"])

    return spark.read.parquet(f"{root}/chunks").select("digest", "payload").mapInArrow(run, "digest binary, crc bigint, n_ids int")


def read_digests(spark: SparkSession, root: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files; ids need not move, for checksums combine."""
    recipes = spark.read.parquet(f"{root}/recipes").drop("place")
    kind = recipes.schema["doc_id"].dataType.simpleString()
    tables = _shift_tables()

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, digest, tail, length = [], [], [], []
            for i, (n, own, digests, lengths) in enumerate(zip(*(batch.column(k).to_pylist() for k in (3, 4, 5, 6)))):
                if merkle(digests, lengths) != own:
                    raise ValueError("a document's chunk list does not match its root")
                left = n
                for d, m in zip(digests, lengths):
                    left -= m
                    at.append(i), digest.append(d), tail.append(4 * left), length.append(m)
                if left:
                    raise ValueError("a document's chunks do not add up to its length")
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(take) for k in (0, 1, 2, 3)), pa.array(digest, pa.binary()), pa.array(tail, pa.int64()), pa.array(length, pa.int32())], ["shard", "doc_id", "rel_start", "n_tokens", "digest", "tail", "length"])

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc, tail = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("crc", "tail"))
            if (batch.column(batch.schema.get_field_index("n_ids")).to_numpy(zero_copy_only=False) != batch.column(batch.schema.get_field_index("length")).to_numpy(zero_copy_only=False)).any():
                raise ValueError("a chunk's length does not match the recipe")
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), pa.array(crc_shift(crc, tail, tables).astype(np.int64), pa.int64())], ["shard", "doc_id", "rel_start", "n_tokens", "crc"])

    exploded = recipes.select("shard", "doc_id", "rel_start", "n_tokens", "root", "digests", "lengths").mapInArrow(parts, f"shard int, doc_id {kind}, rel_start bigint, n_tokens bigint, digest binary, tail bigint, length int")
    joined = exploded.join(verified_chunks(spark, root), "digest", "left").select("shard", "doc_id", "rel_start", "n_tokens", "crc", "n_ids", "length", "tail")
    missing = F.when(F.col("crc").isNull(), F.raise_error(F.lit("a chunk named by a recipe is not in the store"))).otherwise(F.col("crc"))
    crcs = joined.withColumn("crc", missing.cast("bigint")).mapInArrow(moved, f"shard int, doc_id {kind}, rel_start bigint, n_tokens bigint, crc bigint")
    per_doc = crcs.groupBy("shard", "rel_start", "doc_id", "n_tokens").agg(F.bit_xor("crc").alias("ids_crc32"))
    shards = spark.read.parquet(f"{root}/shards")
    # a row for each SHARD_DOCS documents; Spark broadcasts it only under its own size limit
    return per_doc.join(shards.select("shard", "base"), "shard").select("doc_id", (F.col("base") + F.col("rel_start")).alias("start"), "n_tokens", "ids_crc32")


def verify_manifest(spark: SparkSession, root: str) -> None:
    """Fails if the hash tree over the recipes is not that of the manifest."""
    said = tuple(spark.read.parquet(f"{root}/store").first())
    rows, store = manifest(spark.read.parquet(f"{root}/recipes"), said[:3])
    if store != said or sorted(rows) != sorted(tuple(r) for r in spark.read.parquet(f"{root}/shards").collect()):
        raise ValueError("the recipes do not match the manifest")


def read_documents(spark: SparkSession, root: str) -> DataFrame:
    """doc_id, start, ids binary (little-endian uint32): whole documents put together again. A document is the largest group gathered."""
    width = stored_width(spark, root)
    recipes = spark.read.parquet(f"{root}/recipes").select("shard", "rel_start", "doc_id", "n_tokens", F.posexplode("digests").alias("pos", "digest"))
    joined = recipes.join(spark.read.parquet(f"{root}/chunks").select("digest", "payload"), "digest", "left")
    gathered = joined.groupBy("shard", "rel_start", "doc_id", "n_tokens").agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "payload"))).alias("parts"))
    kind = dict(recipes.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = []
            for n, parts in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                for p in parts:
                    if p["payload"] is None:
                        raise ValueError("a chunk named by a recipe is not in the store")
                    if hashlib.sha256(p["payload"]).digest() != p["digest"]:
                        raise ValueError(f"chunk {p['digest'].hex()} does not match its digest")
                own = np.frombuffer(b"".join(p["payload"] for p in parts), f"<u{width}").astype("<u4").tobytes()
                if len(own) != 4 * n:
                    raise ValueError("a document's chunks do not add up to its length")
                ids.append(own)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(ids, pa.binary())], ["shard", "rel_start", "doc_id", "ids"])

    whole = gathered.mapInArrow(run, f"shard int, rel_start bigint, doc_id {kind}, ids binary")
    return whole.join(spark.read.parquet(f"{root}/shards").select("shard", "base"), "shard").select("doc_id", (F.col("base") + F.col("rel_start")).alias("start"), "ids")


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op10-store")
    root = scratch.root
    write_store(documents(spark, sf_dir), root)
    scratch.until_exit()
    verify_manifest(spark, root)
    return read_digests(spark, root)


QUERIES = {"op10_token_store": op10_token_store}
ORACLES: dict[str, str] = {}
