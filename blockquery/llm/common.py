"""Helpers shared by the corpus operators: shared scratch tables, words, word hashes and token ids."""

from __future__ import annotations

import ctypes
import hashlib
import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where unset, one under the working directory, in local mode only."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + os.path.abspath(os.path.join("spark-warehouse", "checkpoints"))
        spark.sparkContext.setCheckpointDir(found)
    return found


class Scratch:
    """Tables of one operator run in the shared folder. A written table cuts the lineage and outlives any executor; results read it, so it goes when the driver ends, or by `drop`."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.marked = spark, f"{shared_dir(spark).rstrip('/')}/bq-{name}-{uuid.uuid4().hex[:12]}", False

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def write(self, df: DataFrame, table: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
        writer = df.write.mode("overwrite").option("compression", "zstd")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(self.path(table))
        self.until_exit()
        return self.spark.read.schema(df.schema).parquet(self.path(table))

    def until_exit(self) -> None:
        """Has the driver delete what is there now and later when it ends. For a folder that exists."""
        if not self.marked:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
            self.marked = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).deleteOnExit(path)

    def drop(self, table: str = "") -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}".rstrip("/"))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_bytes(df: DataFrame, *keep: str) -> DataFrame:
    """The kept columns and text as UTF-8 bytes: Python then splits words without decoding."""
    return df.select(*keep, F.col("text").cast("binary").alias("text"))


def release_memory() -> None:
    """Gives freed memory back to the system: Spark keeps its Python workers, and with them all that they ever held."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def text_slices(batches: Iterator[pa.RecordBatch], most: int = 8 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of about `most` bytes of text (a longer text stands alone), with the texts; null is empty."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index("text"))
        sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
        start, total = 0, 0
        for i, n in enumerate([*sizes, most + 1]):
            if i > start and (total + n > most or i == len(sizes)):
                # only a slice's texts are Python's at a time
                yield batch.slice(start, i - start), [t or b"" for t in column.slice(start, i - start).to_pylist()]
                start, total = i, 0
            total += n
    batch = column = None
    release_memory()


def bucket_of(column: str = "doc_id", parts: int = 10):
    """crc32 of the id as text, modulo parts; null where the id is null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(parts)


# --- 64-bit hashes -------------------------------------------------------------------------------

M1, M2, GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits (wraps on purpose)."""
    x = x ^ (x >> np.uint64(30))
    x = x * M1
    x ^= x >> np.uint64(27)
    x *= M2
    x ^= x >> np.uint64(31)
    return x


def chain_hash(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-word windows; order matters."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = h[: len(h) - n + 1].copy()
    for i in range(1, n):
        out = mix(out * GOLD + h[i : len(h) - n + 1 + i])
    return out


# --- token ids -----------------------------------------------------------------------------------

# What the tokenizer's pre-tokenizer cuts, for texts of plain ASCII or Latin letters after lowering.
_ASCII_PIECES = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[!-/:-@\[-`{-~]+")
_LATIN_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ž]+|[0-9]|[!-/:-@\\[-`{-~]+")
_NOT_ASCII_PLAIN = re.compile(rb"[^\t-\r -~]|<\|")
# U+0130 lowers to a letter and a combining mark
_NOT_LATIN_PLAIN = re.compile("[^\t-\r -~À-ÖØ-öø-įı-ž]|<\\|")
#: Byte-level alphabets show the bytes that are no visible Latin-1 characters as U+0100 and up, in order.
_VISIBLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_SHOWN = {b: chr(b) for b in _VISIBLE} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in set(_VISIBLE))}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Known(dict):
    """The ids that `find` gives for a key, packed, kept for `limit` keys at most: when half of that is full it becomes the older half, from which keys in use come back."""

    def __init__(self, find, limit: int):
        super().__init__()
        self.find, self.half, self.older = find, limit // 2, {}

    def __missing__(self, key):
        found = self.older.get(key)
        if found is None:
            ids = self.find(key)
            found = struct.pack(f"<{len(ids)}I", *ids)
            if len(key) > 64:
                return found
        if len(self) >= self.half:
            self.older = dict(self)
            self.clear()
        self[key] = found
        return found


def file_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


#: The normalizer and pre-tokenizer that WordIds knows: lowered, and cut into what _ASCII_PIECES and _LATIN_PIECES find.
_KNOWN_CUTS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


def cuts_are_known(path: str) -> bool:
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    return all(said.get(k) == v for k, v in _KNOWN_CUTS.items()) and all(t["content"].startswith("<|") for t in said.get("added_tokens", []))


class WordIds:
    """Token ids of whole texts, as little-endian uint32 bytes.

    A tokenizer with the cuts of _KNOWN_CUTS never joins across ASCII white space, as it drops white space: a text's ids
    are its words' ids in order, and the library encodes a word once. In texts of plain ASCII or Latin letters the
    pre-tokenizer's own pieces (lowered runs of letters, digits, runs of marks, English contractions) are found here and
    given to the library's model, which makes far fewer of them distinct. Tests hold this against encoding whole texts.
    Any other tokenizer file is given whole texts.
    """

    def __init__(self, path: str, limit: int = 450_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), cuts_are_known(path)
        model = self.tokenizer.model
        self.words = _Known(lambda w: self.tokenizer.encode(w.decode("utf-8", "replace"), add_special_tokens=False).ids, limit // 4)
        self.ascii = _Known(lambda p: [x.id for x in model.tokenize(p.decode("ascii"))], limit)
        self.latin = _Known(lambda p: [x.id for x in model.tokenize(p.encode().decode("latin-1").translate(_SHOWN))], limit)

    def one(self, text: bytes) -> bytes:
        if not self.known:
            return np.array(self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()
        if text.isascii():
            if not _NOT_ASCII_PLAIN.search(text):
                return b"".join(map(self.ascii.__getitem__, _ASCII_PIECES.findall(text.lower())))
        elif not _NOT_LATIN_PLAIN.search(own := text.decode("utf-8", "replace")):
            return b"".join(map(self.latin.__getitem__, _LATIN_PIECES.findall(own.lower())))
        return b"".join(map(self.words.__getitem__, text.split()))

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        return list(map(self.one, texts))


_WORD_IDS: dict[tuple[str, int], WordIds] = {}


def word_ids(path: str, limit: int = 450_000) -> WordIds:
    """One for each Python worker, so that its tasks share what it has learned: some 400 bytes for each piece of the limit."""
    if (path, limit) not in _WORD_IDS:
        _WORD_IDS[path, limit] = WordIds(path, limit)
    return _WORD_IDS[path, limit]


def crc_ids(ids: bytes) -> int:
    return zlib.crc32(ids)
