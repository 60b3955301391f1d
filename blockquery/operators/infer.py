"""Inferring a schema from records, and advice on sort field, primary key and indexes from their statistics."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import CollectionSchema, Field, validate
from .blocks import places, work_dir
from .sampling import sample

MOST_VALUES = 16
SHAPE_SHARE = 0.9
#: An index whose values are on average in more than this share of the blocks hardly narrows.
WEAK_SHARE = 0.35
ISO_DATE = r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:\d{2})?)?$"
URL = r"^[A-Za-z][A-Za-z0-9+.\-]*://\S+$"
UUID = r"^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$"
#: Relative standard error of approximate distinct counts, and up to how many records a field that may be unique is counted exactly.
DISTINCT_ERROR, EXACT_RECORDS = 0.008, 1_000_000
#: Records of which shares of blocks are estimated.
SAMPLE = 2000


@dataclass
class Stats:
    """What one pass over the records says about a field."""

    name: str
    kind: str
    records: int
    present: int
    nulls: int
    distinct: int
    unique: bool = False
    multi: bool = False
    values: list[str] | None = None
    shape: str | None = None
    bytes: int = 0
    extra: dict = field(default_factory=dict)

    @property
    def absent(self) -> bool:
        return self.present < self.records


def _about_distinct(c: Column) -> Column:
    """An approximate distinct count by one sketch of 2**14 registers (Spark's own function keeps thousands of columns for this error)."""
    return F.coalesce(F.hll_sketch_estimate(F.hll_sketch_agg(c, 14)), F.lit(0))


def field_stats(lines: DataFrame) -> dict[str, Stats]:
    """Statistics of every key of JSON records (column `value`), in one aggregate by key.

    Common keys meet in one group only as partial sums and sketches. The set of values is kept as a sketch and one more
    than the number that is still listed.
    """
    lines.createOrReplaceTempView("_bq_lines")
    pairs = lines.sparkSession.sql("SELECT e.key AS name, e.value AS v, schema_of_variant(e.value) AS kind FROM _bq_lines, LATERAL variant_explode(parse_json(value)) AS e")
    return _stats(pairs, lines.count())


def _stats(pairs: DataFrame, records: int) -> dict[str, Stats]:
    text = F.when(F.col("kind") == "STRING", F.try_variant_get("v", "$", "string"))
    whole = F.to_json("v")
    is_list = F.col("kind").rlike("^ARRAY")
    parts = F.when(F.col("kind") == "ARRAY<STRING>", F.try_variant_get("v", "$", "array<string>")).when(text.isNotNull(), F.array(text))
    rows = pairs.select("name", "kind", text.alias("text"), whole.alias("whole"), is_list.alias("is_list"), parts.alias("parts"))
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    kind = F.col("kind")
    agg = rows.groupBy("name").agg(
        F.count("*").alias("present"),
        n(kind == "VOID").alias("nulls"),
        n(kind == "BOOLEAN").alias("booleans"),
        n(kind.rlike("^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)")).alias("numbers"),
        n(kind == "STRING").alias("strings"),
        n((kind == "STRING") & F.col("text").rlike(ISO_DATE)).alias("dates"),
        n(kind.isin("ARRAY<STRING>", "ARRAY<VOID>", "ARRAY<>")).alias("lists"),
        n(F.col("text").rlike(URL)).alias("urls"),
        n(F.col("text").rlike(UUID)).alias("uuids"),
        _about_distinct(F.when(kind != "VOID", F.col("whole"))).alias("distinct"),
        F.sum(F.octet_length("text")).alias("bytes"),
    )
    found = {r["name"]: r for r in agg.collect()}  # a row for each key
    # lists are counted whole, so their elements may be few all the same
    few = [name for name, r in found.items() if r["lists"] or (r["strings"] and r["distinct"] <= 2 * MOST_VALUES)]
    # distinct first: a common value is then one row; of each field one value more than may be listed is kept
    values = rows.where(F.col("name").isin(*few)).select("name", F.explode("parts").alias("value")).distinct()
    rank = F.row_number().over(Window.partitionBy("name").orderBy("value"))
    listed: dict[str, list[str]] = {}
    for r in values.select("name", "value", rank.alias("i")).where(F.col("i") <= MOST_VALUES + 1).collect():
        listed.setdefault(r["name"], []).append(r["value"])
    # near-unique fields of data small enough are counted exactly; an approximate count would take a few duplicates for none
    near = [name for name, r in found.items() if r["distinct"] >= 0.9 * (r["present"] - r["nulls"]) > 0] if records <= EXACT_RECORDS else []
    exact = {r["name"]: r["n"] for r in rows.where(F.col("name").isin(*near) & (F.col("kind") != "VOID")).groupBy("name").agg(F.count_distinct("whole").alias("n")).collect()} if near else {}
    out = {}
    for name, r in found.items():
        solid = r["present"] - r["nulls"]
        multi = solid > 0 and r["lists"] == solid
        kind_name = "string" if solid == 0 or multi else "boolean" if r["booleans"] == solid else "number" if r["numbers"] == solid else ("date" if r["dates"] == solid else "string") if r["strings"] == solid else "json"
        own = sorted(listed.get(name, []))
        shape = next((s for s, k in (("url", "urls"), ("uuid", "uuids")) if r["strings"] and r[k] >= SHAPE_SHARE * r["strings"]), None)
        distinct = min(r["distinct"], solid)
        out[name] = Stats(name, kind_name, records, r["present"], r["nulls"], distinct, solid > 0 and exact.get(name, distinct if records > EXACT_RECORDS else 0) >= solid * (1 if records <= EXACT_RECORDS else 1 - 3 * DISTINCT_ERROR), multi, own if kind_name == "string" and 0 < len(own) <= MOST_VALUES else None, shape, r["bytes"] or 0)
    return out


def column_stats(df: DataFrame) -> dict[str, Stats]:
    """The same for records with typed columns, where no key is absent. One aggregate."""
    aggs = [F.count("*").alias("records")]
    for i, (name, kind) in enumerate(df.dtypes):
        c = F.col(f"`{name}`")
        aggs += [F.count(c).alias(f"n{i}"), _about_distinct(c.cast("string")).alias(f"d{i}") if not kind.startswith(("map", "variant")) else F.lit(0).alias(f"d{i}")]
        if kind == "string":
            aggs += [F.sum(c.rlike(URL).cast("long")).alias(f"url{i}"), F.sum(c.rlike(UUID).cast("long")).alias(f"uuid{i}"), F.sum(c.rlike(ISO_DATE).cast("long")).alias(f"date{i}")]
    row = df.agg(*aggs).first()
    out = {}
    for i, (name, kind) in enumerate(df.dtypes):
        solid = row[f"n{i}"]
        multi = kind == "array<string>"
        own = "number" if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal") else "boolean" if kind == "boolean" else "date" if kind in ("date", "timestamp", "timestamp_ntz") else "string" if kind == "string" or multi else "json"
        shape = None
        if kind == "string" and solid:
            own = "date" if row[f"date{i}"] == solid else own
            shape = next((s for s in ("url", "uuid") if row[f"{s}{i}"] >= SHAPE_SHARE * solid), None)
        distinct = min(row[f"d{i}"], solid)
        out[name] = Stats(name, own, row["records"], row["records"], row["records"] - solid, distinct, solid > 0 and distinct >= solid * (1 - 3 * DISTINCT_ERROR), multi, None, shape)
    near = [s.name for s in out.values() if s.records <= EXACT_RECORDS and s.kind != "json" and s.distinct >= 0.9 * (s.records - s.nulls) > 0]
    if near:
        counted = df.agg(*(F.count_distinct(F.col(f"`{c}`")).alias(str(i)) for i, c in enumerate(near))).first()
        for i, c in enumerate(near):
            out[c].unique = counted[i] == out[c].records - out[c].nulls
    return out


def exact_cardinality(df: DataFrame, fields: list[str]) -> DataFrame:
    """field, distinct: exact counts. Rows become (field, value) pairs that are made distinct before they are counted."""
    pairs = df.select(F.explode(F.array(*(F.struct(F.lit(n).alias("field"), F.col(f"`{n}`").cast("string").alias("value")) for n in fields))).alias("p")).select("p.field", "p.value")
    return pairs.where("value IS NOT NULL").distinct().groupBy("field").agg(F.count("*").alias("distinct"))


def small_sets(df: DataFrame, fields: list[str], most: int = MOST_VALUES) -> DataFrame:
    """field, values: the sorted values, joined by commas, of string fields that have at most `most`."""
    pairs = df.select(F.explode(F.array(*(F.struct(F.lit(n).alias("field"), F.col(f"`{n}`").alias("value")) for n in fields))).alias("p")).select("p.field", "p.value")
    distinct = pairs.where("value IS NOT NULL").distinct()
    # one value more than may be listed is kept of each field, so no list grows with the data
    rank = F.row_number().over(Window.partitionBy("field").orderBy("value"))
    few = distinct.withColumn("i", rank).where(F.col("i") <= most + 1).groupBy("field").agg(F.sort_array(F.collect_list("value")).alias("list"))
    return few.where(F.size("list") <= most).select("field", F.array_join("list", ",").alias("values"))


def shape_shares(df: DataFrame, name: str) -> DataFrame:
    """One row: values, and how many look like a URL or a UUID."""
    c = F.col(f"`{name}`")
    return df.agg(F.count(c).alias("n"), F.sum(c.rlike(URL).cast("long")).alias("urls"), F.sum(c.rlike(UUID).cast("long")).alias("uuids"))


# --- advice --------------------------------------------------------------------------------------


def pk_named(name: str) -> bool:
    return bool(re.search(r"^_?id$|[._-]?id$", name, re.IGNORECASE))


def recommend_pk(stats: dict[str, Stats]) -> str | None:
    able = [s for s in stats.values() if s.kind in ("number", "string") and s.unique and not (s.absent or s.nulls or s.multi) and pk_named(s.name)]
    return min(able, key=lambda s: (not re.fullmatch("_?id", s.name, re.IGNORECASE), s.name)).name if able else None


def recommend_sort(stats: dict[str, Stats]) -> str | None:
    able = [s for s in stats.values() if s.kind in ("number", "date", "string") and not s.multi and not s.absent]
    return min(able, key=lambda s: (s.kind == "string", -s.distinct, not pk_named(s.name), s.name)).name if able else None


def recommend_indexes(stats: dict[str, Stats], sort_field: str, shares: dict[str, float] | None = None, most: int = 3) -> tuple[list[str], list[str]]:
    """Fields to index, and those left out because their values are scattered over too many blocks."""
    lists = [s.name for s in stats.values() if s.multi]
    able = [s for s in stats.values() if not s.multi and s.kind != "json" and s.name != sort_field and 1 < s.distinct <= (s.records / 10 if s.records >= 100 else s.records - 1)]
    chosen, skipped = [], []
    for s in sorted(able, key=lambda s: (-s.distinct, s.name)):
        if (shares or {}).get(s.name, 0.0) > WEAK_SHARE:
            skipped.append(s.name)
        elif len(chosen) < most:
            chosen.append(s.name)
    return lists + chosen, skipped


def share_sample(df: DataFrame, fields: list[str], rows: int = SAMPLE) -> tuple[list[dict], int]:
    """Records drawn once by a seeded hash, with these fields as they compare (lists by element), and how many records there are. One scan; at most `rows` reach the driver."""
    own = [c for c in fields if c in df.columns]
    n = df.count()
    drawn = df if n <= rows else sample(df, rows)
    return [r.asDict() for r in drawn.select(*(F.col(f"`{c}`") for c in own)).collect()], n


def _sort_key(v) -> tuple:
    return (v is None, v if v is not None else 0)


def estimated_share(rows: list[dict], records: int, sort_field: str, name: str, blocks: int, distinct: int = 0) -> float | None:
    """The share of blocks that a field's value is in, on average over its distinct values, from a sample; None if it has no value there.

    Of the whole data it is counted. From a sample, two things about a value are estimated: how many records it has, and over
    how many blocks these may be spread. Both are poorly known of a single value, which is seen once or twice, and well of
    the field, so a value's own counts are combined with a distribution fitted to all (empirical Bayes). Records of a value
    are Poisson in the sample about a gamma-distributed mean, fitted by moments to all `distinct` values, unseen ones included.
    A value lies uniformly in a window of 1, 2, 4, ... or all blocks; the shares of these are fitted by EM to the ranges that
    values span in the sample. m records in a window of w blocks reach w(1 - (1 - 1/w)^m) of them.
    """
    n = len(rows)
    places: dict = {}
    for place, i in enumerate(sorted(range(n), key=lambda i: _sort_key(rows[i][sort_field]))):
        v = rows[i][name]
        for x in v if isinstance(v, (list, tuple)) else (v,):
            if x is not None:
                places.setdefault(x, []).append(place)
    if not places:
        return None
    if n == records or blocks == 1:
        return sum(len({p * blocks // n for p in own}) for own in places.values()) / len(places) / blocks
    k = np.array([len(p) for p in places.values()], float)
    distinct = max(distinct, len(k))
    # how many records: gamma-Poisson posterior means
    rate, mean = n / records, k.sum() / distinct
    spread = (k * k).sum() / distinct - mean * mean
    shape = mean * mean / max(spread - mean, 1e-9 * mean)
    held = lambda seen: np.maximum(1.0, (seen + shape) / (rate + shape * rate / mean))
    # how wide: likelihoods of the range of k places in a window, its place unknown
    window = np.unique(np.minimum(2.0 ** np.arange(int(np.ceil(np.log2(blocks))) + 1), blocks))
    several = np.flatnonzero(k > 1)
    span = np.array([(p[-1] - p[0]) / n * blocks for p in places.values()])[several, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        fits = np.where(span < window, np.log(np.maximum(window - span, 1e-300)) + (k[several, None] - 2) * np.log(span / window) - 2 * np.log(window), -np.inf)
    prior = np.full(len(window), 1 / len(window))
    posterior = np.zeros((len(several), len(window)))
    for _ in range(100 if len(several) else 0):
        log = fits + np.log(np.maximum(prior, 1e-12))
        posterior = np.exp(log - log.max(axis=1, keepdims=True))
        posterior /= posterior.sum(axis=1, keepdims=True)
        prior = posterior.mean(axis=0)
    wide = np.tile(prior, (len(k), 1))
    wide[several] = posterior
    reach = lambda m: window * (1 - (1 - 1 / window) ** m[:, None])
    unseen = distinct - len(k)
    total = (wide * reach(held(k))).sum() + unseen * (prior * reach(held(np.zeros(1)))).sum()
    return min(1.0, float(total) / distinct / blocks)


def exact_shares(df: DataFrame, sort_field: str, fields: list[str], blocks: int, path: str) -> dict[str, float]:
    """What estimated_share counts of the whole data, where these lie: only two sums of each field reach the driver. Equal sort values lie in the order of the fields."""
    order = list(dict.fromkeys([sort_field, *fields]))
    _bins(df.select(*(F.col(f"`{c}`") for c in order)), [F.col(f"`{c}`").asc_nulls_last() for c in order], blocks, path).write.parquet(f"{path}/bins")
    binned, out = df.sparkSession.read.parquet(f"{path}/bins"), {}
    for name in fields:
        c = F.col(f"`{name}`")
        pairs = binned.select((F.explode(c) if isinstance(df.schema[name].dataType, T.ArrayType) else c).alias("v"), "bin").where("v IS NOT NULL").distinct()
        # of each value its bins, then one row
        row = pairs.groupBy("v").agg(F.count("*").alias("n")).agg(F.sum("n").alias("n"), F.count("*").alias("values")).first()
        if row["values"]:
            out[name] = row["n"] / row["values"] / blocks
    return out


def block_share(df: DataFrame, sort_field: str, fields: list[str], blocks: int, rows: int = SAMPLE, distinct: dict[str, int] | None = None) -> dict[str, float]:
    """The share of each field that has values: by estimated_share from one sample, by exact_shares where all records are asked for and are more than a sample."""
    own = [c for c in dict.fromkeys(fields) if c in df.columns]
    if rows > SAMPLE and SAMPLE < df.count() <= rows:
        return exact_shares(df, sort_field, own, blocks, work_dir(df.sparkSession))
    drawn, records = share_sample(df, list(dict.fromkeys([sort_field, *fields])), rows)
    found = {name: estimated_share(drawn, records, sort_field, name, blocks, (distinct or {}).get(name, 0)) for name in fields}
    return {name: share for name, share in found.items() if share is not None}


def scatter(df: DataFrame, sort_field: str, fields: list[str], blocks: int, rows: int = SAMPLE) -> float:
    """In how many blocks of the sort field's order a value of the fields lies, on average: what a filter on them would read."""
    shares = block_share(df, sort_field, fields, blocks, rows)
    return blocks * sum(shares.values()) / max(1, len(shares))


def _bins(df: DataFrame, order: list[Column], bins: int, path: str) -> DataFrame:
    placed, n = places(df, order, f"{path}/places")
    return placed.withColumn("bin", F.expr(f"_place * {bins} div {max(n, 1)}")).drop("_place")


def sample_bins(df: DataFrame, by: str, bins: int) -> DataFrame:
    """Records with `bin` = floor(place * bins / records) in the order of a field, then of the others."""
    return _bins(df, [F.col(f"`{by}`").asc_nulls_last(), *(F.col(f"`{c}`") for c in df.columns if c != by)], bins, work_dir(df.sparkSession))


def recommend_sort_for(df: DataFrame, stats: dict[str, Stats], filters: list[str], blocks: int = 32) -> str | None:
    """The sort field that keeps values of the filtered fields together best; long runs of equal values come last. One sample serves all candidates."""
    able = [s for s in stats.values() if s.kind in ("number", "date", "string") and not s.multi and not s.absent]
    if not able or not filters:
        return recommend_sort(stats)
    rows, n = share_sample(df, list(dict.fromkeys([s.name for s in able] + filters)))
    cost = {s.name: sum(estimated_share(rows, n, s.name, f, blocks, stats[f].distinct if f in stats else 0) or 0.0 for f in filters) for s in able}
    return min(able, key=lambda s: (s.records > 20 * max(s.distinct, 1), cost[s.name], s.bytes, -s.distinct, s.name)).name


def skipped_indexes(stats: dict[str, Stats], sort_field: str, shares: dict[str, float]) -> list[str]:
    """What to say about fields that would be indexed but for the blocks they would read."""
    return [f"{name}: no index, as a value of it would be in about {shares[name]:.0%} of the blocks" for name in recommend_indexes(stats, sort_field, shares)[1]]


def infer_schema(stats: dict[str, Stats], sort_field: str | None = None, pk: str | None = None, indexed: list[str] | None = None, shares: dict[str, float] | None = None) -> CollectionSchema:
    """The schema that these statistics advise; with shares of blocks, hopeless indexes are left out (skipped_indexes names them)."""
    sort_field = sort_field or recommend_sort(stats)
    pk = pk or recommend_pk(stats)
    chosen = set(recommend_indexes(stats, sort_field, shares)[0] if indexed is None else indexed) | ({pk} if pk and pk != sort_field else set())
    fields = {s.name: Field(s.name, s.kind, indexed=s.multi or s.name in chosen, absent=s.absent, nullable=s.nulls > 0, multi=s.multi, values=tuple(s.values) if s.values else None) for s in stats.values()}
    return validate(CollectionSchema(sort_field, fields, pk))


def refreshed(old: CollectionSchema, stats: dict[str, Stats]) -> CollectionSchema:
    """Facts from the data (kind, absent, nullable, list, values), choices (sort field, primary key, indexes) from the old schema."""
    new = infer_schema(stats, old.sort_field, old.pk, [])
    fields = {}
    for name, f in new.fields.items():
        o = old.fields.get(name)
        text = f.kind == "string"
        fields[name] = Field(name, f.kind, indexed=f.multi or bool(o and o.indexed and f.kind != "json"), ends_with=bool(o and o.ends_with and text), contains=bool(o and o.contains and text), absent=f.absent, nullable=f.nullable, multi=f.multi, values=f.values, values_type=o.values_type if o and f.values else None)
    fields |= {n: f for n, f in old.fields.items() if f.derive_from is not None and n not in fields}
    return validate(CollectionSchema(old.sort_field, fields, old.pk))
