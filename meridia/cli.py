"""Command line: ``python -m meridia.cli <command>``. Each command reads Parquet, and writes Parquet with a manifest beside it."""

from __future__ import annotations

import argparse
import datetime
import json
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.operators import bars as B, calendar, stats
from meridia.sources.stores import config_hash, write_manifest


def _days(text: str) -> datetime.date:
    return datetime.date.fromisoformat(text)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="meridia")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, about: str, *names: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=about)
        for n in names:
            c.add_argument(f"--{n}", required=True)
        c.add_argument("--manifests", help="folder for the run's manifest")
        return c

    command("list", "names of the registered queries")
    q = command("query", "run a registered query on a folder of tables", "data", "out")
    q.add_argument("name")
    c = command("calendar", "session tables and trading days of bars (product, trading_date, wall)", "bars", "out")
    c.add_argument("--anchors", required=True, help="products, separated by commas")
    c.add_argument("--required", type=int, default=1)
    d = command("continuous", "leading contracts and adjusted bars of daily rows and bars", "daily", "bars", "out")
    d.add_argument("--confirm", type=int, default=2)
    d.add_argument("--hole", type=_days, action="append", default=[], help="last day of a segment")
    s = command("scan", "lagged correlations of a panel (product, segment, pos, x)", "panel", "out")
    v = command("validate", "edges of windows with their nulls", "panel", "windows", "priors", "out")
    for x in (s, v):
        x.add_argument("--lags", default="1,2,3,4,5,6,8,10,12,15,20,25,30,40,50,60")
    v.add_argument("--draws", type=int, default=200)
    v.add_argument("--min-shift", type=int, default=5)
    v.add_argument("--seed", type=int, default=42)
    return p


def _spark() -> SparkSession:
    return SparkSession.builder.appName("meridia").getOrCreate()


def run(args: argparse.Namespace, spark: SparkSession | None = None) -> dict[str, object]:
    """Does what the command says; returns the manifest's facts."""
    from meridia.plans import registry

    registry.load()
    if args.command == "list":
        return {"queries": sorted(registry.QUERIES)}
    began, spark = time.time(), spark or _spark()
    tables: dict[str, DataFrame] = {}
    if args.command == "query":
        tables[""] = registry.QUERIES[args.name](spark, args.data)
    elif args.command == "calendar":
        tables = calendar.build_calendar(spark.read.parquet(args.bars), args.anchors.split(","), args.required)
    elif args.command == "continuous":
        spans = B.dominance_spans(B.dominance(spark.read.parquet(args.daily), args.confirm, tuple(args.hole)))
        tables = {"spans": spans, "bars": B.continuous(spark.read.parquet(args.bars), spans)}
    else:
        panel, lags = spark.read.parquet(args.panel), [int(x) for x in args.lags.split(",")]
        if args.command == "scan":
            tables["edges"] = stats.pair_statistics(stats.correlations(stats.lagged_gram(panel, lags)))
        else:
            tables["edges"] = stats.validated_edges(panel, spark.read.parquet(args.windows), lags, spark.read.parquet(args.priors), args.draws, args.min_shift, args.seed)
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{args.out}/{name}" if name else args.out)
    said = {k: v for k, v in vars(args).items() if k != "manifests"}
    facts: dict[str, object] = {"command": args.command, "config_hash": config_hash(said), "wall_s": round(time.time() - began, 3)}
    if "edges" in tables:
        edges = spark.read.parquet(f"{args.out}/edges")
        facts["pairs"] = edges.count()
        if "validated" in edges.columns:
            facts["validated"] = edges.where(F.col("validated")).count()
    if args.manifests:
        facts["manifest"] = write_manifest(args.manifests, args.command, facts)
    return facts


def main(argv: list[str] | None = None) -> int:
    print(json.dumps(run(parser().parse_args(argv)), sort_keys=True, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
