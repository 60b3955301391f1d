"""Command line: init (write a configuration from data), build, inspect (a collection, or what a configuration would build), codegen."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .build import build_from_config, read_text
from .client import connect
from .errors import EngineError
from .codegen import record_module
from .operators import infer
from .operators.blocks import record_bytes
from .operators.lints import FEW_BLOCKS, collection_warnings
from .plans.cost import block_count, estimate
from .schema import BLOCK_BYTES, resolve
from .sources.readers import count_records, head, json_lines, ndjson_lines, read_records


def config_of(schema, **rest) -> dict:
    names = {"indexed": "indexed", "ends_with": "endsWith", "contains": "contains", "absent": "absent", "nullable": "nullable", "multi": "multi"}
    fields = {}
    for n, f in schema.fields.items():
        own: dict = {"kind": f.kind} | {key: True for name, key in names.items() if getattr(f, name)}
        if f.values:
            own["values"] = list(f.values)
        if f.values_type:
            own["valuesType"] = f.values_type
        if f.derive_from:
            own["derive"] = {"from": f.derive_from, "using": f.derive_using}
        fields[n] = own
    return rest | {"schema": {"sortField": schema.sort_field} | ({"pk": schema.pk} if schema.pk else {}) | {"fields": fields}}


def _stats(spark: SparkSession, args) -> dict:
    if args.format in ("ndjson", "json"):
        lines = ndjson_lines(spark, args.input) if args.format == "ndjson" else json_lines(spark, args.input, args.records)
        return infer.field_stats(head(lines, args.sample) if args.sample else lines)
    df = _typed(spark, args)
    return infer.column_stats(head(df, args.sample) if args.sample else df)


def _typed(spark: SparkSession, args):
    if args.format == "parquet":
        return spark.read.parquet(args.input)
    sep = args.delimiter or ("\t" if args.format == "tsv" else ",")
    return spark.read.options(header=True, sep=sep, quote='"', escape='"', multiLine=True, inferSchema=True).csv(args.input)


def _shares(spark: SparkSession, args, stats: dict) -> dict[str, float]:
    """The share of blocks that a filter on each field would read under the chosen sort field, from one sample of records."""
    first = infer.infer_schema(stats, args.sort_field, args.pk, args.index)
    records = _typed(spark, args) if args.format in ("csv", "tsv", "parquet") else read_records(spark, args.input, args.format, first, args.records)
    lines = ndjson_lines(spark, args.input) if args.format == "ndjson" else json_lines(spark, args.input, args.records) if args.format == "json" else None
    total = count_records(lines).first()["bytes"] if lines is not None else records.agg(F.coalesce(F.sum(record_bytes(records)), F.lit(0))).first()[0]
    fields = [s.name for s in stats.values() if s.kind != "json" and s.name != first.sort_field and s.name in records.columns]
    if block_count(int(total), args.block_bytes) < FEW_BLOCKS:
        return {}  # any value is in a large share of few blocks
    return infer.block_share(records, first.sort_field, fields, block_count(int(total), args.block_bytes), distinct={n: s.distinct for n, s in stats.items()})


def field_report(c) -> dict[str, dict]:
    """For each indexed field its values, entries and mean share of blocks, and what an equality filter on it reads."""
    n, block = c.manifest["blocks"], c.manifest["bytes"] / max(1, c.manifest["blocks"])
    out: dict[str, dict] = {}
    for table, name in ((c.metadata.postings, "index"), (c.metadata.reversed, "endsWith"), (c.metadata.trigrams, "contains")):
        if table is None:
            continue
        rows = table.groupBy("field").agg(F.count("*").alias("values"), F.sum(F.size("blocks")).alias("entries"), F.avg(F.size("blocks")).alias("mean"), F.sum(F.octet_length("value") + 2 * F.size("blocks")).alias("bytes")).collect()
        for r in rows:  # a row for each field
            out.setdefault(r["field"], {})[name] = {"values": r["values"], "entries": r["entries"], "bytes": r["bytes"], "share": round(r["mean"] / max(1, n), 4), "equality_blocks": round(r["mean"], 2), "equality_bytes": round(r["mean"] * block)}
    return out


def inspect(spark: SparkSession, path: str) -> dict:
    c = connect(spark, path)
    blocks = c.metadata.blocks
    row = blocks.selectExpr("min(count)", "max(count)", "min(bytes)", "max(bytes)", "coalesce(sum(n_null), 0)", "coalesce(sum(n_absent), 0)").first()
    manifest = len(read_text(spark, f"{path.rstrip('/')}/manifest.json").encode())
    fields = field_report(c)
    report = {"records": c.manifest["records"], "blocks": c.manifest["blocks"], "bytes": c.manifest["bytes"], "records_per_block": [row[0], row[1]], "bytes_per_block": [row[2], row[3]], "missing": {"null": row[4], "absent": row[5]}, "largest_record_bytes": c.manifest["largest"], "sort_values": c.manifest["values"], "manifest_bytes": manifest, "fields": fields, "schema": c.get_schema(), "warnings": collection_warnings(c, manifest_bytes=manifest)}
    return report


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="blockquery", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    p = commands.add_parser("init")
    p.add_argument("input")
    p.add_argument("--config", default="blockquery.json")
    p.add_argument("--format", default="ndjson", choices=("ndjson", "json", "csv", "tsv", "parquet"))
    for name in ("--records", "--delimiter", "--sort-field", "--pk", "--output"):
        p.add_argument(name)
    p.add_argument("--index", action="append")
    p.add_argument("--sample", type=int, help="look at so many of the first records only")
    p.add_argument("--block-bytes", type=int, default=BLOCK_BYTES)
    p.add_argument("--reinfer", action="store_true")
    commands.add_parser("build").add_argument("config")
    p = commands.add_parser("inspect")
    p.add_argument("path", nargs="?")
    p.add_argument("--config")
    p = commands.add_parser("codegen")
    p.add_argument("config")
    p.add_argument("--output", required=True)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    try:
        if args.command == "init":
            stats = _stats(spark, args)
            if args.reinfer:
                old = json.loads(Path(args.config).read_text())
                rest = {k: v for k, v in old.items() if k != "schema"}
                data = config_of(infer.refreshed(resolve(old).schema, stats), **rest)
            else:
                rest = {k: v for k, v in (("input", args.input), ("format", args.format), ("records", args.records), ("delimiter", args.delimiter), ("output", args.output)) if v is not None}
                shares = _shares(spark, args, stats)
                schema = infer.infer_schema(stats, args.sort_field, args.pk, args.index, shares)
                if args.index is None:
                    print(*infer.skipped_indexes(stats, schema.sort_field, shares), sep="\n", file=sys.stderr)
                data = config_of(schema, **rest)
            resolve(data)
            Path(args.config).write_text(json.dumps(data, indent=2) + "\n")
        elif args.command == "build":
            print(json.dumps({k: v for k, v in build_from_config(spark, resolve(json.loads(Path(args.config).read_text()))).items() if k in ("records", "blocks", "bytes")}))
        elif args.command == "codegen":
            config = resolve(json.loads(Path(args.config).read_text()))
            Path(args.output).write_text(record_module(config.schema, config.name, config.output))
        elif args.config:
            config = resolve(json.loads(Path(args.config).read_text()))
            print(json.dumps(estimate(read_records(spark, config.input, config.format, config.schema, config.records, config.delimiter), config.schema, config.block_bytes), indent=2))
        elif args.path:
            print(json.dumps(inspect(spark, args.path), indent=2))
        else:
            parser.error("inspect needs a path or --config")
    except EngineError as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
