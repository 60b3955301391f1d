"""Mixing overlapping sources to target weights by min-cost flow over membership patterns.

A document belongs to one or more sources; its sorted set of sources is its pattern. Documents are aggregated by pattern,
and a flow routes each pattern's words to its sources' quotas. A pattern's first pass over its words is cheap and a second
one dear (convex repetition costs), so words repeat only where quotas cannot be met otherwise, and no document is taken
more than twice. A source that shares no document with another has a flow of one path, which is its quota: there may be any
number of these, and they are planned in Spark. Patterns of several sources, and what else belongs to these sources, meet
in the driver, where the flow is solved: `most_patterns` of them at most, beyond which the call fails rather than cuts.

Then documents are selected: whole passes for all of a pattern, and for what remains a prefix of the seeded order of its
documents. The border of that prefix is found by histograms of the seeded hash, so no task sorts a source: a histogram has
1024 bins however many documents there are. Rows that repeat an id have one hash; where more than `WINDOW_ROWS` rows of a
pattern are left in a border bin, they are told apart by hash and size, and rows alike in these by histograms of their own.

Null text has no words; so has empty text, and neither is ever taken. A null source is a source of its own, ordered last.
Empty membership takes nothing. Equal ids count as separate documents; the order among rows that agree in id and size does
not matter, as they are alike. A very long text counts with all of its words, and only the last document of a prefix is
taken in part. An empty table gives an empty result. Columns beside doc_id, text and the membership are not read, and
`take_copies` returns all of them.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, documents, fresh, text_bytes, text_slices

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_PASSES = 2
SEED = 20240229
BINS = 1024
#: Patterns whose flow is solved in the driver (a name, a sum and a few arcs each).
MOST_PATTERNS = 200_000
#: Tables with a row for each pattern or source are broadcast, or planned in the driver, up to so many rows and joined, or planned by aggregates, beyond.
SMALL = 100_000
#: Rows of a pattern that are ordered in one task.
WINDOW_ROWS = 100_000


class MinCostFlow:
    """Primal-dual minimum-cost maximum flow on integers: shortest distances, then blocking flows on tight arcs."""

    def __init__(self, nodes: int):
        self.head: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.cap: list[int] = []
        self.cost: list[int] = []

    def arc(self, a: int, b: int, cap: int, cost: int) -> int:
        self.head[a].append(len(self.to))
        self.head[b].append(len(self.to) + 1)
        self.to += [b, a]
        self.cap += [cap, 0]
        self.cost += [cost, -cost]
        return len(self.to) - 2

    def flow(self, arc: int) -> int:
        return self.cap[arc ^ 1]

    def _distances(self, source: int) -> list[float]:
        dist, queue, queued = [float("inf")] * len(self.head), deque([source]), [False] * len(self.head)
        dist[source] = 0
        while queue:
            a = queue.popleft()
            queued[a] = False
            for e in self.head[a]:
                b = self.to[e]
                if self.cap[e] and dist[a] + self.cost[e] < dist[b]:
                    dist[b] = dist[a] + self.cost[e]
                    if not queued[b]:
                        queued[b] = True
                        queue.append(b)
        return dist

    def run(self, source: int, sink: int) -> int:
        total = 0
        while True:
            dist = self._distances(source)
            if dist[sink] == float("inf"):
                return total
            at = [0] * len(self.head)
            on_path, path = {source}, []
            a = source
            while True:
                if a == sink:
                    push = min(self.cap[e] for e in path)
                    total += push
                    for e in path:
                        self.cap[e] -= push
                        self.cap[e ^ 1] += push
                    a, path, on_path = source, [], {source}
                    continue
                while at[a] < len(self.head[a]):
                    e = self.head[a][at[a]]
                    if self.cap[e] and dist[self.to[e]] == dist[a] + self.cost[e] and self.to[e] not in on_path:
                        break
                    at[a] += 1
                if at[a] < len(self.head[a]):
                    e = self.head[a][at[a]]
                    path.append(e)
                    a = self.to[e]
                    on_path.add(a)
                elif path:
                    on_path.discard(a)
                    a = self.to[path.pop() ^ 1]
                    at[a] += 1
                else:
                    break


def order_key(source: str | None) -> tuple:
    return (source is None, source or "")  # Python compares strings by code point


def quotas(sizes: dict, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_PASSES) -> dict:
    """Each source's target: shares of `share` times all words by weight, at most `most` times its own; the excess is shared again."""
    order = sorted(sizes, key=order_key)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, target = share * sum(sizes.values()), list(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > most * sizes[s]]
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = float(most * sizes[s])
        left -= sum(target[s] for s in over)
        open_ = [s for s in open_ if s not in target]
    return target


def route(patterns: dict[tuple, int], target: dict, most: int = MOST_PASSES) -> dict[tuple, int]:
    """Words to take from each pattern. Pass k over a pattern costs k squared for a word."""
    names = {s: i for i, s in enumerate(sorted(target, key=order_key))}
    order = sorted(patterns, key=lambda p: [order_key(s) for s in p])
    net = MinCostFlow(2 + len(names) + len(order))
    for s, i in names.items():
        net.arc(2 + i, 1, round(target[s]), 0)
    passes = defaultdict(list)
    for i, p in enumerate(order):
        node = 2 + len(names) + i
        for k in range(1, most + 1):
            passes[p].append(net.arc(0, node, patterns[p], k * k))
        for s in p:
            net.arc(node, 2 + names[s], most * patterns[p], 0)
    net.run(0, 1)
    return {p: sum(net.flow(e) for e in passes[p]) for p in order}


def doc_sizes(docs: DataFrame, members: Column) -> DataFrame:
    """doc_id, pattern (as JSON), size."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    pattern = F.to_json(F.array_sort(F.array_distinct(F.coalesce(members, F.array().cast("array<string>"))))).alias("pattern")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([len(t.split()) for t in texts], pa.int64())], ["doc_id", "pattern", "size"])

    named = docs.select("doc_id", pattern, "text")
    return text_bytes(named, "doc_id", "pattern").mapInArrow(run, f"doc_id {kind}, pattern string, size bigint")


def _ranked(sources: DataFrame, many: int, scratch: Scratch, per_task: int = 1_000_000) -> DataFrame:
    """sources with their place in the order by code point, null last: ranges are sorted apart, and begin where the ranges before them end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * batch.num_rows, pa.int32()), pa.array(range(at, at + batch.num_rows), pa.int64())], [*batch.schema.names, "part", "place"])
            at += batch.num_rows

    order = (F.col("source").isNull(), F.col("source"))
    ranged = sources.repartitionByRange(max(1, -(-many // per_task)), *order).sortWithinPartitions(*order)
    placed = scratch.write(ranged.mapInArrow(run, "source string, source_size bigint, part int, place bigint"), "placed")
    before, first = 0, []
    for part, n in sorted((r["part"], r["n"]) for r in placed.groupBy("part").agg(F.count("*").alias("n")).collect()):  # a row for each range
        first.append((part, before))
        before += n
    bases = F.broadcast(placed.sparkSession.createDataFrame(first, "part int, base bigint"))
    return placed.join(bases, "part").select("source", "source_size", (F.col("base") + F.col("place")).alias("rank"))


def targets(sources: DataFrame, many: int, scratch: Scratch, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_PASSES, small: int = SMALL) -> DataFrame:
    """source, source_size, target: `quotas` of any number of sources."""
    spark = sources.sparkSession
    if many <= small:
        sizes = {r["source"]: r["source_size"] for r in sources.collect()}
        target = quotas(sizes, weights, share, most)
        return spark.createDataFrame([(s, n, float(target[s])) for s, n in sizes.items()], "source string, source_size bigint, target double")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    weighted = scratch.write(_ranked(sources, many, scratch).withColumn("weight", weight), "weighted")
    cap = most * F.col("source_size")
    all_words = weighted.agg(F.sum("source_size")).first()[0]
    # those above their cap at one level stay above it, as the level only rises; a round caps one source at least
    left, total, capped = share * all_words, weighted.agg(F.sum("weight")).first()[0], 0
    while True:
        level = F.lit(float(left)) * F.col("weight") / F.lit(int(total))
        over = level > cap
        n, words, heavy = weighted.agg(F.count(F.when(over, 1)), F.coalesce(F.sum(F.when(over, cap)), F.lit(0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0))).first()
        if n == capped:
            return weighted.select("source", "source_size", F.when(over, cap.cast("double")).otherwise(level).alias("target"))
        capped, left, total = n, share * all_words - words, heavy
        if not total:
            return weighted.select("source", "source_size", cap.cast("double").alias("target"))


def _small(df: DataFrame, many: int) -> DataFrame:
    return F.broadcast(df) if many <= SMALL else df


def plan(sizes: DataFrame, scratch: Scratch, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most_patterns: int = MOST_PATTERNS, small: int = SMALL) -> tuple[DataFrame, DataFrame, int]:
    """pattern, passes, rest (words of the last pass) and n (words); source, source_size, target; and how many patterns there are."""
    patterns = sizes.groupBy("pattern").agg(F.sum("size").alias("n")).withColumn("of", F.from_json("pattern", "array<string>"))
    patterns = scratch.write(patterns, "patterns")
    many = patterns.count()
    sources = scratch.write(patterns.select(F.explode("of").alias("source"), "n").groupBy("source").agg(F.sum("n").alias("source_size")), "sources")
    n_sources = sources.count()
    sources = scratch.write(targets(sources, n_sources, scratch, weights, share, small=small), "targets")
    several = patterns.where(F.size("of") > 1)
    overlapping = several.limit(most_patterns + 1).count()
    if overlapping > most_patterns:
        raise ValueError(f"more than {most_patterns} patterns of several sources: raise most_patterns, or give documents fewer sources")
    flow = sizes.sparkSession.createDataFrame([], "pattern string, flow bigint")
    if overlapping:
        one = F.broadcast(several.select(F.explode("of").alias("one")).distinct())
        own_target = {r["source"]: r["target"] for r in sources.join(one, F.col("source").eqNullSafe(F.col("one")), "left_semi").collect()}
        alone = patterns.where(F.size("of") == 1).join(one, F.get("of", 0).eqNullSafe(F.col("one")), "left_semi")
        # the pattern's own string is kept: another writer of JSON may escape differently
        rows = {tuple(r["of"]): r for r in several.unionByName(alone).collect()}
        routed = route({p: r["n"] for p, r in rows.items()}, own_target)
        flow = sizes.sparkSession.createDataFrame([(rows[p]["pattern"], n) for p, n in routed.items()], "pattern string, flow bigint")
    single = sources.select(F.col("source").alias("one"), F.rint("target").cast("bigint").alias("quota"))
    joined = patterns.join(F.broadcast(flow), "pattern", "left").join(_small(single, n_sources), (F.size("of") == 1) & F.get("of", 0).eqNullSafe(F.col("one")), "left")
    taken = F.coalesce("flow", F.when(F.col("quota").isNotNull(), F.least(F.col("quota"), MOST_PASSES * F.col("n"))), F.lit(0))
    planned = joined.select("pattern", "n", F.when(F.col("n") > 0, taken).otherwise(0).alias("t"))
    whole = planned.select("pattern", "n", F.when(F.col("n") > 0, F.expr("t div n")).otherwise(0).cast("bigint").alias("passes"), F.when(F.col("n") > 0, F.expr("t % n")).otherwise(0).cast("bigint").alias("rest"))
    return scratch.write(whole, "plan"), sources, many


def _border(rows: DataFrame, columns: list[str]) -> DataFrame:
    """For each pattern the bin of `columns` in which the running sum of sizes reaches `rest`; what is left to take in it, and its rows."""
    sums = rows.groupBy("pattern", *columns).agg(F.sum("size").alias("own"), F.count("*").alias("held"), F.first("rest").alias("rest"))
    order = Window.partitionBy("pattern").orderBy(*columns)  # BINS rows at most, or as many as there are kinds of rows in a bin
    upto = sums.withColumn("upto", F.sum("own").over(order))
    return upto.where((F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("own") < F.col("rest"))).select("pattern", *columns, (F.col("rest") - (F.col("upto") - F.col("own"))).alias("rest"), "held")


def take_documents(sizes: DataFrame, planned: DataFrame, patterns: int, scratch: Scratch, whole: bool = False, seed: int = SEED, window_rows: int = WINDOW_ROWS) -> DataFrame:
    """sizes with `taken`: whole passes, then a prefix in seeded order. The document at its border is taken in part, or with `whole` entirely or not at all, whichever comes nearer."""
    h, tie = F.xxhash64(F.lit(seed), F.col("doc_id").cast("string")), F.xxhash64(F.lit(seed + 1), "row")
    top, next_ = (lambda c: F.shiftrightunsigned(c, 54)), (lambda c: F.shiftrightunsigned(c, 44).bitwiseAND(BINS - 1))
    rows = sizes.withColumns({"h": h, "tie": tie, "h1": top(h), "h2": next_(h), "t1": top(tie), "t2": next_(tie)})
    rows = rows.join(_small(planned.select("pattern", "passes", "rest"), patterns), "pattern")
    keys: list[str] = []
    border = planned.where("rest > 0").select("pattern", "rest")
    for level, columns in enumerate((["h1"], ["h2"], ["h", "size"], ["t1"], ["t2"])):
        inside = rows.drop("rest").join(_small(border.drop("held"), patterns), ["pattern", *keys])
        keys += columns
        found = _border(inside, columns).withColumnRenamed("rest", "next").select("pattern", *columns, F.col("next").alias("rest"), "held")
        if level:
            found = found.join(_small(border.drop("rest", "held"), patterns), "pattern")
        border = scratch.write(found, f"border-{level}")
        if level and not (border.agg(F.max("held")).first()[0] or 0) > window_rows:
            break
    marks = border.select("pattern", F.col("rest").alias("left"), *(F.col(k).alias(f"b_{k}") for k in keys))
    rows = rows.join(_small(marks, patterns), "pattern", "left")
    at_border = F.lit(True)
    before_border = F.lit(False)
    for k in reversed(keys):
        before_border = (F.col(k) < F.col(f"b_{k}")) | ((F.col(k) == F.col(f"b_{k}")) & before_border)
    for k in keys:
        at_border = at_border & (F.col(k) == F.col(f"b_{k}"))
    at_border, before_border = F.coalesce(at_border & F.col("left").isNotNull(), F.lit(False)), F.coalesce(before_border, F.lit(False))
    full = F.col("passes") * F.col("size")
    clear = rows.where(~at_border).withColumn("taken", full + F.when(before_border, F.col("size")).otherwise(0))
    # a millionth of a pattern's documents, or window_rows
    ahead = F.coalesce(F.sum("size").over(Window.partitionBy("pattern").orderBy("h", "size", "tie", "row").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    part = F.least(F.col("size"), F.greatest(F.lit(0), F.col("left") - ahead))
    if whole:
        part = F.when(2 * part >= F.col("size"), F.col("size")).otherwise(0)
    marked = rows.where(at_border).withColumn("taken", full + part)
    return clear.unionByName(marked).select(*(c for c in sizes.columns if c != "row"), "taken")


def mix_table(docs: DataFrame, members: Column | None = None, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, whole: bool = False, seed: int = SEED, most_patterns: int = MOST_PATTERNS, small: int = SMALL, window_rows: int = WINDOW_ROWS) -> tuple[DataFrame, DataFrame, Scratch]:
    """doc_id, pattern, size and taken of each document; source, source_size and target of each source; where the tables lie. members: an array of sources."""
    scratch = Scratch(docs.sparkSession, "mixing")
    sizes = scratch.write(doc_sizes(docs, F.array("source") if members is None else members).withColumn("row", F.monotonically_increasing_id()), "sizes")
    planned, sources, many = plan(sizes, scratch, weights, share, most_patterns, small)
    return take_documents(sizes, planned, many, scratch, whole, seed, window_rows), sources, scratch


def mix_sources(docs: DataFrame, members: Column | None = None, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, whole: bool = False, seed: int = SEED) -> tuple[DataFrame, dict, dict]:
    """mix_table for sources few enough for the driver: doc_id, pattern, size and taken of each document; the sources' sizes and targets."""
    mixed, sources, _ = mix_table(docs, members, weights, share, whole, seed)
    rows = sources.collect()
    return mixed, {r["source"]: r["source_size"] for r in rows}, {r["source"]: r["target"] for r in rows}


def take_copies(docs: DataFrame, broadcast_rows: int = 1_000_000) -> DataFrame:
    """The mix itself: documents as often as it takes them (not at all, once or twice), with every column they have.

    Whole documents only: the one at a border counts where more than half of it is wanted. Rows that repeat an id are taken
    each by itself: they are written with a number of their own first, by which they are joined.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    key, many = fresh(docs, "__id"), fresh(docs, "__copies")
    own = docs.withColumn(key, F.col("doc_id"))
    if not docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        own = scratch.write(docs.withColumn(key, F.monotonically_increasing_id()), "docs")
    mixed, _, tables = mix_table(own.select(F.col(key).alias("doc_id"), "text", "source"), whole=True)
    copies = scratch.write(mixed.where("taken > 0").select(F.col("doc_id").alias("copy"), F.expr("taken div size").cast("int").alias(many)), "copies")
    tables.drop()
    joined = own.join(F.broadcast(copies) if copies.count() <= broadcast_rows else copies, F.col(key).eqNullSafe(F.col("copy")))
    return joined.withColumn(key, F.explode(F.sequence(F.lit(1), F.col(many)))).select(*docs.columns)


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed, sources, _ = mix_table(documents(spark, sf_dir))
    of_source = sources.select(F.to_json(F.array("source")).alias("pattern"), "source_size", "target")
    return mixed.join(_small(of_source, sources.count()), "pattern").select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op4_source_mixing": op4_source_mixing}
ORACLES: dict[str, str] = {}
