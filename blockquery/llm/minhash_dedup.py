"""MinHash near-duplicates by fast similarity sketching, banding and exact verification.

Sketch. In round i every shingle is thrown into one of t bins by a hash of its own and carries a value whose integer part
is i; a bin keeps its smallest value. After t rounds every shingle goes to bin i - t instead, so at the latest after 2t
rounds every coordinate is filled, whatever the size of the set, while a large set fills all bins in its first round or two.
Two sets agree in a coordinate with probability equal to their similarity, with the concentration of t independent ones.

Candidates. `BANDS` bands of `ROWS` coordinates: a pair of similarity 0.8 shares no band with probability under 1e-5.

Links. Documents with the same set are one node, named by their smallest id. Candidate pairs are verified on full sets of
64-bit shingle hashes. No group is expanded into its pairs: first each node is held against the smallest node it shares a
band with; verified links are contracted to components; then, as long as a band's bucket holds nodes of several components,
some nodes outside its largest component (pivots) are held against all of the bucket that are not yet connected to them,
and leave it. A pair is held together in the first band that it shares and nowhere else, and its full sets are compared
only if a second, longer sketch (1024 coordinates of two bits) does not rule the similarity out: a pair of similarity 0.8
is ruled out with probability under 1e-6. When no bucket holds two components, every pair that shares a band is either
connected or has been refuted, and a group of m copies costs about m verifications. Components come from contraction with
pointer jumping. Everything stays distributed; nothing about documents reaches the driver but counts.

A document without words, or null, has no shingles and is linked with nothing. A null id is linked with nothing, its
component is null and it is kept. Rows that repeat an id are one document for linking, by the least of their sets;
`keep_one` keeps the one with the least text of them (null first), and the least in all columns where texts tie. Of equal
sets the smallest id stays. A very long text is shingled in its task as a whole: 8 bytes for each word and each distinct
shingle. An empty table gives an empty result. `link_documents` reads doc_id and text only; `keep_one` returns every column.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import GOLD, Scratch, chain_hash, documents, mix, text_bytes, text_slices

#: Words of a shingle. Near-duplicate stages take five unless a contract says otherwise; the query's contract says four.
SHINGLE, QUERY_SHINGLE = 5, 4
NUMERATOR, DENOMINATOR = 80, 100
BANDS, ROWS = 30, 5
#: Ids are broadcast to the documents up to so many (8 bytes each), and joined by a shuffle beyond.
BROADCAST_IDS = 1_000_000
#: Pivots of a bucket in the first round of elimination; four times as many in each further one.
SLOTS = 32
#: Coordinates of the second sketch; 32 fill a long. Standard deviations by which it may fall short of a similar pair's.
LONG, DEVIATIONS = 1024, 5.0
_SEED = np.uint64(0x5365636F6E645F31)

_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingles(text: bytes, words: int = SHINGLE) -> np.ndarray:
    """Distinct 64-bit hashes of the word windows, sorted; with fewer words the whole sequence is one."""
    import xxhash

    own = text.lower().split()  # bytes: lowers A-Z and splits at ASCII white space only
    if not own:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, own), np.uint64, len(own))
    return np.unique(chain_hash(h, min(words, len(own))) if len(own) > 1 else mix(h))


def sketch(h: np.ndarray, t: int = BANDS * ROWS) -> np.ndarray:
    """The fast similarity sketch of a non-empty set of hashes: t values, the round above 32 bits of hash."""
    out = np.full(t, _NONE)
    i = 0
    while i < 2 * t:
        many = max(1, min(int(1.3 * t * np.log(t + 1) / len(h)) + 1, (t if i < t else 2 * t) - i))
        rounds = np.arange(i, i + many, dtype=np.uint64)
        g = mix(h[:, None] ^ mix((rounds + np.uint64(1)) * GOLD)[None, :])
        value = (g & np.uint64(0xFFFFFFFF)) | (rounds << np.uint64(32))[None, :]
        if i < t:
            np.minimum.at(out, ((g >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)).astype(np.int64).ravel(), value.ravel())
        else:
            own = np.arange(i - t, i - t + many)
            out[own] = np.minimum(out[own], value.min(axis=0))
        i += many
        if i <= t and (out != _NONE).all():
            break
    return out


def band_keys(values: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key for each band; keys of different bands differ."""
    v = values.reshape(bands, rows)
    key = mix((np.arange(bands, dtype=np.uint64) + np.uint64(1)) * GOLD)
    for j in range(rows):
        key = mix(key * GOLD + v[:, j])
    return key


def two_bits(h: np.ndarray, t: int = LONG) -> np.ndarray:
    """Two bits of each coordinate of the second sketch, 32 in a long. Similar sets differ in few."""
    bits = (mix(sketch(mix(h ^ _SEED), t)) >> np.uint64(62)).reshape(-1, 32)
    return (bits << (np.arange(32, dtype=np.uint64) * np.uint64(2))).sum(axis=1, dtype=np.uint64).view(np.int64)


def most_different(numerator: int, denominator: int, t: int = LONG) -> int:
    """Coordinates in which a pair just similar enough differs, DEVIATIONS standard deviations above their mean."""
    p = 0.75 * (1 - numerator / denominator)
    return math.ceil(t * p + DEVIATIONS * math.sqrt(t * p * (1 - p)))


def similar(a: np.ndarray, b: np.ndarray, numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return denominator * both >= numerator * (len(a) + len(b) - both)


def _described(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, digest (of the set, null if empty), bands."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches):
            n, digest, keys = [], [], []
            for t in texts:
                h = shingles(t, words)
                n.append(len(h))
                if not len(h):
                    digest.append(None), keys.append(None)
                    continue
                # two sums over well mixed hashes, and the size: equal sets only
                digest.append(np.array([len(h), h.sum(), mix(h ^ GOLD).sum()], np.uint64).tobytes())
                keys.append(band_keys(sketch(h, bands * rows), bands, rows).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "digest", "bands"])

    return text_bytes(docs, "doc_id").mapInArrow(run, f"doc_id {kind}, n_shingles bigint, digest binary, bands array<bigint>")


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """node, set, bits (the second sketch)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches):
            sets = [shingles(t, words) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([h.tobytes() for h in sets], pa.binary()), pa.array([two_bits(h) if len(h) else None for h in sets], pa.list_(pa.int64()))], ["node", "set", "bits"])

    return text_bytes(docs, "doc_id").mapInArrow(run, f"node {kind}, set binary, bits array<bigint>")


def _verified(edges: DataFrame, sets: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """edges (a, b) with ok: whether the full sets are similar enough."""
    kind = edges.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            ok = [similar(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), numerator, denominator) for p, q in zip(x, y)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok, pa.bool_())], ["a", "b", "ok"])

    both = edges.join(sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b").join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a")
    return both.select("a", "b", "set_a", "set_b").mapInArrow(run, f"a {kind}, b {kind}, ok boolean")


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame | None:
    """node, component (the smallest node reachable) of every node in edges (a < b); None where there are none."""
    edges = scratch.write(edges.select("a", "b").where("a < b").distinct(), f"{name}-edges")
    labels, step = None, 0
    while not edges.isEmpty():
        step += 1
        # every node with a smaller neighbour follows the smallest; then follow to the end
        parent = scratch.write(edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up")), f"{name}-parent-{step}")
        jump = 0
        while True:
            jump += 1
            further = parent.select(F.col("node").alias("up"), F.col("up").alias("further"))
            moved = scratch.write(parent.join(further, "up", "left").select("node", F.coalesce("further", "up").alias("up"), F.col("further").isNotNull().alias("moved")), f"{name}-jump-{step}-{jump}")
            parent = moved.select("node", "up")
            if moved.where("moved").isEmpty():
                break
        root = lambda column: parent.select(F.col("node").alias(column), F.col("up").alias(f"{column}_up"))
        if labels is None:
            nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
            labels = nodes.join(parent, "node", "left").select("node", F.coalesce("up", "node").alias("component"))
        else:
            labels = labels.join(root("component"), "component", "left").select("node", F.coalesce("component_up", "component").alias("component"))
        labels = scratch.write(labels, f"{name}-labels-{step}")
        contracted = edges.join(root("a"), "a", "left").join(root("b"), "b", "left").select(F.coalesce("a_up", "a").alias("a"), F.coalesce("b_up", "b").alias("b")).where("a != b")
        edges = scratch.write(contracted.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-edges-{step}")
    return labels


def _relabelled(nodes: DataFrame, labels: DataFrame | None) -> DataFrame:
    """nodes (node, component) after components have been joined."""
    if labels is None:
        return nodes
    return nodes.join(labels.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("node", F.coalesce("to", "component").alias("component"))


def link_documents(docs: DataFrame, words: int = SHINGLE, numerator: int = NUMERATOR, denominator: int = DENOMINATOR, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    scratch = Scratch(docs.sparkSession, "minhash")
    described = scratch.write(_described(docs.select("doc_id", "text"), words, bands, rows), "described")
    own = described.select("doc_id", "n_shingles", "digest")
    alive = described.where("digest IS NOT NULL AND doc_id IS NOT NULL")
    # copies meet before anything else; the aggregate runs in part before the shuffle
    classes = scratch.write(alive.groupBy("digest").agg(F.min("doc_id").alias("node"), F.min_by("bands", "doc_id").alias("bands"), F.first("n_shingles").alias("n")), "classes")
    exploded = classes.select("node", F.posexplode("bands").alias("band", "key"))
    # written, so that both sides of a join by bucket are plain shuffles: Spark then splits a bucket that holds many rows
    shared = scratch.write(exploded.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first < last").select("key", "first"), "shared")
    members = scratch.write(exploded.join(shared, "key"), "members")
    scratch.drop("shared")
    rounds = Scratch(docs.sparkSession, "minhash-rounds")
    component = scratch.write(_link_members(docs, classes, members, rounds, words, numerator, denominator), "component")
    rounds.drop()
    scratch.drop("members")
    of_class = classes.select("digest", "node").join(component, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    found = own.where("digest IS NOT NULL AND doc_id IS NOT NULL").join(of_class, "digest").select("doc_id", "n_shingles", F.col("component").alias("component_id"))
    alone = own.where("digest IS NULL OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _link_members(docs: DataFrame, classes: DataFrame, members: DataFrame, scratch: Scratch, words: int, numerator: int, denominator: int) -> DataFrame:
    """node, component of all members. members: band, key, node, first (the smallest node of the bucket)."""
    nodes = scratch.write(members.groupBy("node").agg(F.min("first").alias("first")), "nodes")
    many = nodes.count()
    wanted = nodes.select(F.col("node").alias("doc_id"))
    of_nodes = docs.select("doc_id", "text").join(F.broadcast(wanted) if many <= BROADCAST_IDS else wanted, "doc_id", "left_semi")
    sets = _sets(of_nodes, words)
    if docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where("count > 1").isEmpty():
        sets = scratch.write(sets, "sets")
    else:  # rows that repeat an id: any one set of each
        sets = scratch.write(sets.groupBy("node").agg(F.min(F.struct("set", "bits")).alias("s")).select("node", "s.set", "s.bits"), "sets")
    # round 1: each node against the smallest node that it shares a band with
    edges = nodes.where("first < node").select(F.col("first").alias("a"), F.col("node").alias("b"))
    tested = scratch.write(_verified(edges, sets, numerator, denominator), "tested-1")
    labels = components(tested.where("ok"), scratch, "round-1")
    component = scratch.write(_relabelled(nodes.select("node", F.col("node").alias("component")), labels), "component-1")
    described = scratch.write(classes.select("node", "n", "bands").join(sets.select("node", "bits"), "node"), "two-bits")
    rest, turn = members.select("band", "key", "node"), 1
    while True:
        turn += 1
        labelled = rest.join(component, "node")
        # buckets that hold several components, and the largest of these
        counts = labelled.groupBy("key", "component").agg(F.count("*").alias("size"))
        mixed = counts.groupBy("key").agg(F.max_by("component", F.struct("size", "component")).alias("main"), F.count("*").alias("kinds"), (F.sum("size") - F.max("size")).alias("outside")).where("kinds > 1")
        mixed = scratch.write(mixed, f"mixed-{turn}")
        # about so many pivots among the nodes outside the main component; ever more, so that rounds stay few
        slots = SLOTS << 2 * (turn - 2)
        drawn = F.pmod(F.xxhash64("key", "node"), F.greatest(F.lit(1), F.floor(F.col("outside") / slots))) == 0
        rest = scratch.write(labelled.join(mixed, "key").select("band", "key", "node", "component", ((F.col("component") != F.col("main")) & drawn).alias("pivot")), f"rest-{turn}")
        if rest.isEmpty():
            return component
        edges = _candidates(rest.join(described, "node"), numerator, denominator)
        now = scratch.write(_verified(edges, sets, numerator, denominator), f"tested-{turn}")
        joined = now.where("ok").join(component.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a").join(component.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b")
        labels = components(joined.select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")), scratch, f"round-{turn}")
        component = scratch.write(_relabelled(component, labels), f"component-{turn}")
        rest = rest.where("NOT pivot").select("band", "key", "node")


def _candidates(rest: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """a, b: pivots and members of their buckets, each pair in the first band that it shares, that may be similar enough."""
    columns = ("key", "node", "component", "n", "bands", "bits")
    p = rest.where("pivot").select("key", *(F.col(c).alias(f"p_{c}") for c in columns[1:]))
    sizes = denominator * F.least("n", "p_n") >= numerator * F.greatest("n", "p_n")
    once = ~F.col("pivot") | (F.col("node") < F.col("p_node"))
    first = F.array_position(F.zip_with("bands", "p_bands", lambda x, y: x == y), True) == F.col("band") + 1
    halves = 0x5555555555555555
    differ = F.zip_with("bits", "p_bits", lambda x, y: F.bit_count(x.bitwiseXOR(y).bitwiseOR(F.shiftrightunsigned(x.bitwiseXOR(y), 1)).bitwiseAND(F.lit(halves))))
    close = F.aggregate(differ, F.lit(0), lambda total, x: total + x) <= most_different(numerator, denominator)
    pairs = rest.join(p, "key").where((F.col("component") != F.col("p_component")) & sizes & once & first & close)
    return pairs.select(F.least("node", "p_node").alias("a"), F.greatest("node", "p_node").alias("b"))


def keep_one(docs: DataFrame, words: int = SHINGLE) -> DataFrame:
    """The documents, one of each component, with every column they have."""
    scratch = Scratch(docs.sparkSession, "minhash-kept")
    linked = scratch.write(link_documents(docs, words), "linked")
    gone = linked.where(~F.col("kept")).select("doc_id").distinct()
    out = docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, "doc_id", "left_anti").select(*docs.columns)
    if linked.where(F.col("kept") & F.col("doc_id").isNotNull()).groupBy("doc_id").count().where("count > 1").isEmpty():
        return out
    order = F.struct(F.col("text"), F.to_json(F.struct(*docs.columns)))
    first = out.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), order).alias("row")).select("row.*")
    return first.unionByName(out.where("doc_id IS NULL"))


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_documents(documents(spark, sf_dir), QUERY_SHINGLE)


QUERIES = {"op6_minhash_dedup": op6_minhash_dedup}
#: All pairs that share a shingle, counted exactly; components by the smallest id that reaches a document.
ORACLES = {
    "op6_minhash_dedup": r"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS shingle FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id WHERE r.c < e.b),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM m LEFT JOIN n USING (doc_id)"""
}
