"""Best-fit packing of token sequences: bounded-space online best-fit over a bitset of free space.

Documents become token ids with an end id. Only documents longer than a sequence are cut. Full pieces are sequences of
their own; the rest is packed in parallel streams. Each stream holds at most `open_bins` open sequences, keyed by free
space in one bitset: a piece goes to the fullest open sequence that still takes it, and where a new one must be opened
beyond the bound, the fullest closes first.

Null text is empty (a piece of the end id alone). Repeated rows and equal or null ids are separate documents, each packed
whole. A very long text is encoded in its task, which holds it and its ids, and cut. An empty table gives no pieces.
Columns beside doc_id and text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, crc_ids, default_vocabulary, documents, text_bytes, text_slices, word_ids

END_ID = 1
SEQUENCE = 4096
OPEN_BINS = 512
#: Pieces of texts whose ids a worker remembers. Packing stands behind other stages in workers that keep what those held.
KNOWN_PIECES = 300_000
#: Pieces in a stream: many, so that its last open sequences weigh little, and few enough for one short task.
STREAM_PIECES = 50_000


class OpenBins:
    """Open sequences by free space. The bitset has bit f set while some open sequence has f free."""

    def __init__(self, size: int, most: int):
        self.size, self.most, self.count, self.bits = size, most, 0, 0
        self.by_free: dict[int, list[int]] = {}
        self.made = 0

    def place(self, length: int) -> tuple[int, int]:
        """The sequence and the offset for a piece."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            one = self._take(free)
        else:
            if self.count >= self.most:  # the fullest closes first
                self._take((self.bits & -self.bits).bit_length() - 1)
            one, free = self.made, self.size
            self.made += 1
        left = free - length
        if left:
            self.by_free.setdefault(left, []).append(one)
            self.bits |= 1 << left
            self.count += 1
        return one, self.size - free

    def alone(self) -> tuple[int, int]:
        """A sequence for a full piece, which needs no open one and closes none."""
        self.made += 1
        return self.made - 1, 0

    def _take(self, free: int) -> int:
        held = self.by_free[free]
        one = held.pop()
        if not held:
            del self.by_free[free]
            self.bits &= ~(1 << free)
        self.count -= 1
        return one


def token_pieces(docs: DataFrame, vocabulary: str, sequence: int = SEQUENCE, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids: a row for each piece of at most `sequence` ids."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids binary" if with_ids else "")
    end, step = end_id.to_bytes(4, "little"), 4 * sequence

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_ids(vocabulary, KNOWN_PIECES)
        for batch, texts in text_slices(batches):
            at, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, own in enumerate(encode(texts)):
                own += end
                for k, a in enumerate(range(0, len(own), step)):
                    part = own[a : a + step]
                    at.append(i), piece.append(k), start.append(a // 4), length.append(len(part) // 4), crc.append(crc_ids(part))
                    if with_ids:
                        ids.append(part)
            columns = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(ids, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return text_bytes(docs, "doc_id").mapInArrow(run, schema)


def pack(pieces: DataFrame, rows: int, sequence: int = SEQUENCE, open_bins: int = OPEN_BINS, stream_pieces: int = STREAM_PIECES) -> DataFrame:
    """Adds sequence_id and offset to pieces (of which there are `rows`), one best-fit run in each stream."""
    from pyspark import TaskContext

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, base = OpenBins(sequence, open_bins), TaskContext.get().partitionId() << 40
        for batch in batches:
            placed = [bins.alone() if n == sequence else bins.place(n) for n in batch.column(batch.schema.get_field_index("length")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([base + s for s, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64())], [*batch.schema.names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id bigint, offset bigint"
    return pieces.repartition(max(1, math.ceil(rows / stream_pieces))).mapInArrow(run, schema)


def pack_documents(docs: DataFrame, vocabulary: str | None = None, sequence: int = SEQUENCE, end_id: int = END_ID, open_bins: int = OPEN_BINS, with_ids: bool = False) -> DataFrame:
    """Pieces with their place. With ids, they are joined to the places after packing, which moves lengths only."""
    scratch = Scratch(docs.sparkSession, "packing")
    pieces = scratch.write(token_pieces(docs, vocabulary or default_vocabulary(), sequence, end_id, with_ids).withColumn("row", F.monotonically_increasing_id()), "pieces")
    rows = pieces.count()
    # written, so that a piece's place does not change if a task runs again
    placed = scratch.write(pack(pieces.drop("ids"), rows, sequence, open_bins), "placed")
    if with_ids:
        return placed.join(pieces.select("row", "ids"), "row").drop("row")
    scratch.drop("pieces")
    return placed.drop("row")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir)).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


QUERIES = {"op5_best_fit_packing": op5_best_fit_packing}
ORACLES: dict[str, str] = {}
