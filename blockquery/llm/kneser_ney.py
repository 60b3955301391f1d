"""Language-model scores: an interpolated modified Kneser-Ney bigram model in sorted hash arrays that workers map.

Counting is done by Spark in three rounds of map and merge over all training documents: words, bigrams, and what follows
and precedes each word. A task counts its own texts first and sends each shard one packed block of sorted keys and counts;
a shard's blocks are merged into a file of sorted 64-bit keys with counts, written under a temporary name and renamed, so a
task that runs twice writes the same. Shards are cut by the top bits of uniform hashes: a common word is one key of one
shard and never a group of rows. Scoring tasks map the files and look up their distinct words and bigrams by binary search;
what they hold is their own texts, the operating system keeps the pages.

    P(w | c) = max(n(c w) - D(n(c w)), 0) / n(c) + g(c) P(w),   g(c) = (D1 N1(c .) + D2 N2(c .) + D3 N3+(c .)) / n(c)
    P(w) = max(N(. w) - d(N(. w)), 0) / N(. .) + g / (V + 1)

with a start mark as first context and an end token after every document. The order is two: a corpus of varied words has
about 0.8 distinct trigrams for each word, which would take more disk than it may use; README has the figures.

How many shards there are follows from the bytes of the texts, and runs of words have a fixed length, so that no task holds
more on a larger corpus; the session's shuffle partitions have no say. The driver holds two numbers for each shard. A
vocabulary of 2**32 words or more is an error: bigrams are pairs of 32-bit numbers.

Null text is empty: its end token alone. A very long text is counted and scored by its task as a whole, some 40 bytes for
each word. A null id is held out, as it cannot be placed in a fold. Repeated rows are counted
and scored each on their own. With nothing to learn from, every probability is 1 / (V + 1) with V = 0. An empty table gives
an empty result. Columns beside doc_id and text are not read.
"""

from __future__ import annotations

import math
import os
import tempfile
import uuid
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bucket_of, documents, mix, text_bytes, text_slices

FOLDS, HELD_OUT = 10, 0
START, END = np.uint64(0x5354415254000001), np.uint64(0x454E440000000002)
#: Text that a task counts at once.
TOGETHER = 32 << 20
#: Keys and counts of one shard, before they are merged, and shards that one task merges in turn.
SHARD_BYTES, TASK_SHARDS = 8 << 20, 4
#: Words whose surroundings one task adds up; what reaches it from all shards is some 20 MB on a corpus of any size.
GROUP_WORDS = 1 << 16
_FULL = 255  # counts from here on are in the overflow


# --- files in the shared folder ------------------------------------------------------------------


def _local(uri: str) -> str | None:
    parsed = urlparse(uri)
    return unquote(parsed.path) if parsed.scheme in ("", "file") else None


def put(uri: str, arrays: list[np.ndarray]) -> None:
    """Arrays of one file: a header of their lengths and kinds, then each from a multiple of 8 bytes."""
    kinds = {"u1": 1, "u4": 4, "u8": 8}
    head = np.array([len(arrays), *(x for a in arrays for x in (len(a), kinds[a.dtype.str[1:]]))], "<u8")
    parts = [head.tobytes(), *(a.tobytes() + bytes(-a.nbytes % 8) for a in arrays)]
    path = _local(uri)
    if path is None:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(uri)
        system.create_dir(os.path.dirname(path))
        temporary = f"{os.path.dirname(path)}/.{os.path.basename(path)}-{uuid.uuid4().hex}"
        with system.open_output_stream(temporary) as out:
            for p in parts:
                out.write(p)
        system.move(temporary, path)
        return
    os.makedirs(os.path.dirname(path), exist_ok=True)
    handle, temporary = tempfile.mkstemp(dir=os.path.dirname(path), prefix=".")
    with os.fdopen(handle, "wb") as out:
        for p in parts:
            out.write(p)
    os.replace(temporary, path)


def mapped(uri: str) -> list[np.ndarray]:
    path = _local(uri)
    if path is None:  # a store that cannot be mapped: a nameless copy of this file is, which ends with the worker
        from pyarrow import fs

        system, there = fs.FileSystem.from_uri(uri)
        path = tempfile.TemporaryFile()
        with system.open_input_stream(there) as source:
            while block := source.read(1 << 20):
                path.write(block)
        path.flush()
    raw = np.memmap(path, np.uint8, "r")
    n = int(raw[:8].view("<u8")[0])
    head = raw[8 : 8 + 16 * n].view("<u8").reshape(n, 2)
    at, out = 8 + 16 * n, []
    for length, width in head.tolist():
        out.append(raw[at : at + length * width].view(f"<u{width}"))
        at += (length * width + 7) // 8 * 8
    return out


# --- counting ------------------------------------------------------------------------------------


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, each with START before and END behind; and how many each has, these included."""
    import xxhash

    h, parts, lengths = xxhash.xxh3_64_intdigest, [], []
    for t in texts:
        words = t.lower().split()
        own = np.empty(len(words) + 2, np.uint64)
        own[0], own[-1] = START, END
        own[1:-1] = np.fromiter(map(h, words), np.uint64, len(words))
        parts.append(own)
        lengths.append(len(own))
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.array(lengths, np.int64)


def shards_of(train: DataFrame) -> int:
    """A power of two, so many that about SHARD_BYTES reach a shard of bigrams whatever the session's settings: prose makes a byte of keys and counts of each byte of text, or less; words of one letter four times that."""
    size = train.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return 1 << max(4, math.ceil(math.log2(max(1, size / SHARD_BYTES))))


def by_shard(blocks: DataFrame, shards: int, column: str = "shard") -> DataFrame:
    """Blocks dealt to tasks of just TASK_SHARDS shards, which are merged one after the other; a hash would deal some tasks twice as many."""
    task = F.floor(F.col(column) / TASK_SHARDS).cast("int")
    return blocks.withColumn("task", task).repartitionById(-(-shards // TASK_SHARDS), F.col("task")).groupBy("task", column)


def _cut(keys: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard begins among sorted keys, and the end."""
    bits = np.uint64(64 - int(math.log2(shards)))
    return np.append(np.searchsorted(keys, np.arange(shards, dtype=np.uint64) << bits), len(keys))


def _blocks(keys: np.ndarray, counts: np.ndarray, shards: int) -> pa.RecordBatch:
    """Sorted keys and their counts as a row for each shard that has any."""
    at = _cut(keys, shards)
    own = [s for s in range(shards) if at[s] < at[s + 1]]
    counts = counts.astype("<u4")
    return pa.RecordBatch.from_arrays(
        [pa.array(own, pa.int32()), pa.array([keys[at[s] : at[s + 1]].tobytes() for s in own], pa.binary()), pa.array([_small(counts[at[s] : at[s + 1]]) for s in own], pa.binary())],
        ["shard", "keys", "counts"],
    )


_BLOCK = "shard int, keys binary, counts binary"


def _small(counts: np.ndarray) -> bytes:
    """Counts in a byte each, then those that do not fit."""
    return np.minimum(counts, _FULL).astype(np.uint8).tobytes() + counts[counts >= _FULL].tobytes()


def _large(data: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(data, np.uint8, n).astype(np.int64)
    out[out == _FULL] = np.frombuffer(data, "<u4", offset=n)
    return out


def _merged(table: pa.Table) -> tuple[int, np.ndarray, np.ndarray]:
    keys = [np.frombuffer(k, "<u8") for k in table.column("keys").to_pylist()]
    counts = np.concatenate([_large(c, len(k)) for k, c in zip(keys, table.column("counts").to_pylist())])
    keys = np.concatenate(keys)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return table.column("shard")[0].as_py(), keys[first], np.add.reduceat(counts, first)


def count_words(train: DataFrame, root: str, shards: int) -> dict[int, tuple[int, int]]:
    """Files of words and counts. For each shard: how many words, and their tokens."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in text_slices(batches, TOGETHER):
            yield _blocks(*np.unique(_tokens(texts)[0], return_counts=True), shards)

    def merge(table: pa.Table) -> pa.Table:
        shard, keys, counts = _merged(table)
        put(f"{root}/words-{shard}", [keys, counts.astype("<u8")])
        return pa.table({"shard": pa.array([shard], pa.int32()), "n": pa.array([len(keys)], pa.int64()), "tokens": pa.array([int(counts.sum())], pa.int64())})

    found = by_shard(text_bytes(train).mapInArrow(count, _BLOCK), shards).applyInArrow(merge, "shard int, n bigint, tokens bigint")
    return {r["shard"]: (r["n"], r["tokens"]) for r in found.collect()}  # a row for each shard


class Vocabulary:
    """Words of all shards: numbers are places in the order of hashes."""

    def __init__(self, root: str, sizes: dict[int, tuple[int, int]], shards: int):
        self.root, self.shards = root, shards
        n = np.array([sizes.get(s, (0, 0))[0] for s in range(shards)], np.int64)
        self.first = np.cumsum(n) - n
        self.n = n
        # what stands around words is kept by runs of GROUP_WORDS words: a bigram shard sends each run one block
        words = int(n.sum())
        self.groups = max(1, -(-words // GROUP_WORDS))
        self.group_first = np.arange(self.groups, dtype=np.int64) * GROUP_WORDS
        self.group_n = np.minimum(words - self.group_first, GROUP_WORDS)
        self.files: dict[tuple[str, int], list[np.ndarray]] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"files": {}}

    def file(self, kind: str, shard: int) -> list[np.ndarray]:
        if (kind, shard) not in self.files:
            self.files[kind, shard] = mapped(f"{self.root}/{kind}-{shard}")
        return self.files[kind, shard]

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers (-1: unknown) and counts of sorted distinct word hashes."""
        number, count = np.full(len(words), -1, np.int64), np.zeros(len(words), np.int64)
        at = _cut(words, self.shards)
        for s in np.flatnonzero(np.diff(at)):
            if not self.n[s]:
                continue
            keys, counts = self.file("words", int(s))
            own = words[at[s] : at[s + 1]]
            i = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            hit = keys[i] == own
            number[at[s] : at[s + 1]] = np.where(hit, self.first[s] + i, -1)
            count[at[s] : at[s + 1]] = np.where(hit, counts[i].astype(np.int64), 0)
        return number, count

    def around(self, numbers: np.ndarray) -> np.ndarray:
        """N1, N2, N3+ of what follows and N of what precedes, for sorted numbers (-1: zeros)."""
        out = np.zeros((len(numbers), 4), np.int64)
        group = np.searchsorted(self.group_first, numbers, side="right") - 1
        for g in np.unique(group[numbers >= 0]):
            own = (group == g) & (numbers >= 0)
            dense = self.file("around", int(g))[0].reshape(-1, 4)
            out[own] = dense[numbers[own] - self.group_first[g]]
        return out


def _pairs(tokens: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places of the second tokens of all bigrams."""
    inner = np.ones(len(tokens), bool)
    inner[np.cumsum(lengths) - lengths] = False
    return np.flatnonzero(inner)


def bigram_keys(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """A bijection of two numbers under 2**32, spread evenly."""
    return mix((context.astype(np.uint64) << np.uint64(32)) | word.astype(np.uint64))


def _unmix(x: np.ndarray) -> np.ndarray:
    """The inverse of mix."""
    m1, m2 = np.uint64(pow(0xBF58476D1CE4E5B9, -1, 1 << 64)), np.uint64(pow(0x94D049BB133111EB, -1, 1 << 64))
    x = x ^ (x >> np.uint64(31)) ^ (x >> np.uint64(62))
    x = x * m2
    x = x ^ (x >> np.uint64(27)) ^ (x >> np.uint64(54))
    x = x * m1
    return x ^ (x >> np.uint64(30)) ^ (x >> np.uint64(60))


def count_bigrams(train: DataFrame, vocabulary: Vocabulary, root: str, shards: int) -> tuple[DataFrame, str]:
    """Files of bigrams and counts; a row for each shard and group of words with what the bigrams say about the words around them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in text_slices(batches, TOGETHER):
            tokens, lengths = _tokens(texts)
            words, inverse = np.unique(tokens, return_inverse=True)
            number = vocabulary.find(words)[0][inverse]
            at = _pairs(tokens, lengths)
            yield _blocks(*np.unique(bigram_keys(number[at - 1], number[at]), return_counts=True), shards)

    def merge(table: pa.Table) -> pa.Table:
        shard, keys, counts = _merged(table)
        over = np.flatnonzero(counts >= _FULL)
        put(f"{root}/bigrams-{shard}", [keys, np.minimum(counts, _FULL).astype(np.uint8), over.astype("<u4"), counts[over].astype("<u8")])
        pair = _unmix(keys)
        context, word = (pair >> np.uint64(32)).astype(np.int64), (pair & np.uint64(0xFFFFFFFF)).astype(np.int64)
        kind = np.minimum(counts, 3) - 1
        rows, index = np.unique(np.concatenate([context, word]), return_inverse=True)
        found = np.zeros((len(rows), 4), np.int64)
        np.add.at(found, (index[: len(keys)], kind), 1)
        np.add.at(found, (index[len(keys) :], 3), 1)
        of = np.searchsorted(vocabulary.group_first, rows, side="right") - 1
        at = np.append(np.searchsorted(of, np.arange(vocabulary.groups)), len(rows))
        own = [g for g in range(vocabulary.groups) if at[g] < at[g + 1]]
        n = len(own)
        of_counts = [int((counts == k).sum()) for k in (1, 2, 3, 4)]
        return pa.table(
            {
                "part": pa.array(own, pa.int32()),
                "numbers": pa.array([(rows[at[g] : at[g + 1]] - vocabulary.group_first[g]).astype("<u4").tobytes() for g in own], pa.binary()),
                "found": pa.array([found[at[g] : at[g + 1]].astype("<u4").tobytes() for g in own], pa.binary()),
                # the shard's own sums, once
                **{f"n{k + 1}": pa.array([of_counts[k]] + [0] * (n - 1), pa.int64()) for k in range(4)},
                "distinct": pa.array([len(keys)] + [0] * (n - 1), pa.int64()),
            }
        )

    schema = "part int, numbers binary, found binary, n1 bigint, n2 bigint, n3 bigint, n4 bigint, distinct bigint"
    return by_shard(text_bytes(train).mapInArrow(count, _BLOCK), shards).applyInArrow(merge, schema), schema


def count_around(parts: DataFrame, vocabulary: Vocabulary, root: str) -> list[int]:
    """Files of N1, N2, N3+ and the number of preceding words for each word; and how many words have 1, 2, 3, 4 of these."""
    start = vocabulary.find(np.array([START]))[0][0]

    def merge(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        dense = np.zeros((int(vocabulary.group_n[part]), 4), np.int64)
        for numbers, found in zip(table.column("numbers").to_pylist(), table.column("found").to_pylist()):
            dense[np.frombuffer(numbers, "<u4")] += np.frombuffer(found, "<u4").reshape(-1, 4)  # numbers of a block are distinct
        put(f"{root}/around-{part}", [dense.reshape(-1).astype("<u8" if dense.max(initial=0) >> 32 else "<u4")])
        before = dense[:, 3]
        if vocabulary.group_first[part] <= start < vocabulary.group_first[part] + vocabulary.group_n[part]:
            before = np.delete(before, start - vocabulary.group_first[part])
        return pa.table({f"n{k}": pa.array([int((before == k).sum())], pa.int64()) for k in (1, 2, 3, 4)} | {"more": pa.array([int((before >= 3).sum())], pa.int64())})

    found = by_shard(parts, vocabulary.groups, "part").applyInArrow(merge, "n1 bigint, n2 bigint, n3 bigint, n4 bigint, more bigint")
    row = found.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("n1", "n2", "n3", "n4", "more"))).first()
    return list(row)


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """D(0..3+) by the counts of counts; where these are too few for the formula, half of the count at most one."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    guess = [0.0, *(k - (k + 1) * y * b / a if a and b else 0.5 for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))]
    return np.array([min(max(d, 0.0), k) if k == 0 else min(max(d, 0.05), k - 0.05) for k, d in enumerate(guess)])


class Model:
    """What workers need beside the files: a few numbers."""

    def __init__(self, root: str, shards: int, vocabulary: Vocabulary, tokens: int, types: int, pairs: list[int], singles: list[int], distinct: int):
        self.root, self.shards, self.vocabulary, self.tokens, self.types, self.distinct = root, shards, vocabulary, tokens, types, distinct
        self.d = discounts(*pairs)
        self.du = discounts(*singles[:4])
        mass = self.du[1] * singles[0] + self.du[2] * singles[1] + self.du[3] * singles[4]
        self.rest = mass / distinct if distinct else 1.0

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """Counts of sorted distinct bigram keys."""
        out = np.zeros(len(keys), np.int64)
        at = _cut(keys, self.shards)
        for s in np.flatnonzero(np.diff(at)):
            try:
                known, small, over, large = self.vocabulary.file("bigrams", int(s))
            except FileNotFoundError:  # no bigram fell there
                continue
            own = keys[at[s] : at[s + 1]]
            i = np.minimum(np.searchsorted(known, own), len(known) - 1)
            hit = known[i] == own
            c = small[i].astype(np.int64)
            full = np.flatnonzero(hit & (c == _FULL))
            if len(full):
                c[full] = large[np.searchsorted(over, i[full])]
            out[at[s] : at[s + 1]] = np.where(hit, c, 0)
        return out

    def score(self, texts: list[bytes]) -> list[np.ndarray]:
        """n_tokens, n_known, base_score and score of each text."""
        tokens, lengths = _tokens(texts)
        words, inverse = np.unique(tokens, return_inverse=True)
        number, count = self.vocabulary.find(words) if self.types else (np.full(len(words), -1), np.zeros(len(words), np.int64))
        around = self.vocabulary.around(number) if self.types else np.zeros((len(words), 4), np.int64)
        before = around[:, 3]
        single = np.maximum(before - self.du[np.minimum(before, 3)], 0) / max(self.distinct, 1) + self.rest / (self.types + 1)
        given = np.where(count > 0, (around[:, :3] * self.d[1:]).sum(axis=1) / np.maximum(count, 1), 1.0)
        at = _pairs(tokens, lengths)
        c, w = inverse[at - 1], inverse[at]
        # a bigram with an unknown word is not in the files, and no key may be made of it
        known = (number[c] >= 0) & (number[w] >= 0)
        keys = bigram_keys(np.where(known, number[c], 0), np.where(known, number[w], 0))
        distinct, place = np.unique(keys, return_inverse=True)
        pair = np.where(known, self.counts(distinct)[place] if self.types else 0, 0)
        p = np.maximum(pair - self.d[np.minimum(pair, 3)], 0) / np.maximum(count[c], 1) + given[c] * single[w]
        base = np.log10((count[w] + 0.1) / (self.tokens + 0.1 * (self.types + 1)))
        n = lengths - 1
        first = np.cumsum(n) - n
        add = lambda x: np.add.reduceat(x, first)  # noqa: E731  every text has its end token
        return [n, add((count[w] > 0).astype(np.int64)), add(base), add(np.log10(p))]


def train_model(train: DataFrame, root: str) -> Model:
    spark = train.sparkSession
    shards = shards_of(train)
    sizes = count_words(train, root, shards)
    vocabulary = Vocabulary(root, sizes, shards)
    types, tokens = int(vocabulary.n.sum()), sum(t for _, t in sizes.values())
    if types >= 1 << 32:
        raise ValueError("the vocabulary has more than 2**32 words")
    if not types:
        return Model(root, shards, vocabulary, 0, 0, [0] * 4, [0] * 5, 0)
    documents_seen = int(vocabulary.find(np.array([START]))[1][0])
    parts, schema = count_bigrams(train, vocabulary, root, shards)
    path = f"{root}/parts"
    parts.write.mode("overwrite").option("compression", "zstd").parquet(path)
    parts = spark.read.schema(schema).parquet(path)
    *pairs, distinct = parts.agg(*(F.sum(c) for c in ("n1", "n2", "n3", "n4", "distinct"))).first()
    singles = count_around(parts, vocabulary, root)
    vocabulary.files.clear()
    return Model(root, shards, vocabulary, tokens - documents_seen, types - 1, pairs, singles, distinct)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches, TOGETHER // 2):
            n, known, base, score = model.score(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64())], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return text_bytes(docs, "doc_id").mapInArrow(run, f"doc_id {kind}, n_tokens bigint, n_known bigint, base_score double, score double")


def score_corpus(docs: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    docs = docs.select("doc_id", "text")
    scratch = Scratch(docs.sparkSession, "kneser-ney")
    model = train_model(docs.where(bucket_of("doc_id", folds) != held_out), scratch.root)
    scratch.until_exit()
    held = F.coalesce(bucket_of("doc_id", folds) == held_out, F.lit(True))
    return score_documents(docs, model).select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("bigint").alias("train_tokens"), "base_score", "score")


def op9_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_corpus(documents(spark, sf_dir))


QUERIES = {"op9_kneser_ney": op9_kneser_ney}
ORACLES: dict[str, str] = {}
