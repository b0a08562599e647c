"""Partitioned stores: daily prices, edges, trials, manifests. Appends are files; nothing is rewritten."""

from __future__ import annotations

import hashlib
import json
import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

PRICES = "date date, symbol string, open double, high double, low double, close double, volume double, turnover double, vwap double, return_pct double, turnover_rate double"
EDGES = "asof_date date, leader string, follower string, lag_bars smallint, strength float, sign tinyint, a_stat float, p_value float, q_value float, family string, n_eff bigint, stability float, half_life float, regime_flags string, window_start date, window_end date, config_hash string"
TRIALS = "trial_id string, kind string, asof_date date, detail string, seed_id string, split string, stat double, metrics_json string, config_hash string, ts timestamp"


class SchemaError(ValueError):
    """Rows whose columns or types aren't the store's."""


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p)


def config_hash(config: object) -> str:
    """sha256 of the canonical JSON."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """The store's columns in its order and types; a missing one is an error."""
    schema = StructType.fromDDL(ddl)
    missing = [f.name for f in schema if f.name not in df.columns]
    if missing:
        raise SchemaError(f"missing columns: {missing}")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


class PriceStore:
    """Daily prices by year; writing adds only (date, symbol) keys that aren't there yet."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def read(self, symbols: list[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
        schema = StructType.fromDDL(PRICES)
        if not _exists(self.spark, self.root):
            return self.spark.createDataFrame([], schema)
        df = self.spark.read.schema(StructType([*schema.fields]).add("year", IntegerType())).parquet(self.root)
        if start:
            df = df.where((F.col("year") >= int(start[:4])) & (F.col("date") >= F.lit(start).cast("date")))
        if end:
            df = df.where((F.col("year") <= int(end[:4])) & (F.col("date") <= F.lit(end).cast("date")))
        return (df.where(F.col("symbol").isin(symbols)) if symbols is not None else df).drop("year")

    def write(self, rows: DataFrame) -> tuple[int, int]:
        """(written, skipped)."""
        new = conform(rows, PRICES).dropDuplicates(["date", "symbol"])
        total = new.count()
        ends = new.agg(F.min("date").alias("lo"), F.max("date").alias("hi")).first()
        # partitions of other years aren't read; two writers at a time need a lock of their own
        there = self.read(start=str(ends.lo), end=str(ends.hi)) if ends.lo else self.read()
        fresh = new.join(there.select("date", "symbol"), ["date", "symbol"], "left_anti").withColumn("year", F.year("date"))
        observed = fresh.count()
        if observed:
            fresh.repartition("year").write.mode("append").option("compression", "zstd").partitionBy("year").parquet(self.root)
        return observed, total - observed

    def symbols(self) -> list[str]:
        return [r.symbol for r in self.read().select("symbol").distinct().orderBy("symbol").toLocalIterator()]

    def panel(self, fields: list[str], symbols: list[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
        unknown = set(fields) - {f.name for f in StructType.fromDDL(PRICES)}
        if unknown:
            raise ValueError(f"unknown fields: {sorted(unknown)}")
        return self.read(symbols, start, end).select("date", "symbol", *fields)


class EdgeStore:
    """Edges by as-of date; a date that is there can't be written again."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def append(self, edges: DataFrame, asof: str) -> None:
        conform(edges, EDGES).drop("asof_date").write.mode("errorifexists").parquet(f"{self.root}/asof_date={asof}")

    def scan(self) -> DataFrame:
        schema = StructType.fromDDL(EDGES)
        if not _exists(self.spark, self.root):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(StructType([*schema.fields[1:], schema.fields[0]])).parquet(self.root).select([f.name for f in schema])


class TrialLedger:
    """Trials, appended in parts; ids are hashes of kind, detail and configuration."""

    def __init__(self, spark: SparkSession, root: str, batch: int = 5000):
        self.spark, self.root, self.batch, self.held = spark, root, batch, []

    def log(self, kind: str, detail: str, config: str, **more: object) -> str:
        trial = hashlib.sha256(f"{kind}|{detail}|{config}".encode()).hexdigest()[:32]
        self.held.append({"trial_id": trial, "kind": kind, "detail": detail, "config_hash": config, **more})
        if len(self.held) >= self.batch:
            self.flush()
        return trial

    def flush(self) -> None:
        if self.held:
            self.spark.createDataFrame(self.held, StructType.fromDDL(TRIALS)).write.mode("append").parquet(self.root)
            self.held = []

    def count(self) -> int:
        return len(self.held) + (self.spark.read.schema(TRIALS).parquet(self.root).count() if _exists(self.spark, self.root) else 0)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new and those of old whose keys new doesn't hold."""
    return old.join(new.select(keys), keys, "left_anti").unionByName(new)


def write_manifest(folder: str, stage: str, facts: dict[str, object]) -> str:
    """A run's JSON and the pointer to the latest, each put in place by a rename."""
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, f"{stage}-{time.time_ns()}.json")
    for target, body in ((path, facts), (os.path.join(folder, "latest.json"), {"stage": stage, "path": path})):
        with open(f"{target}.tmp", "w") as f:
            json.dump(body, f, sort_keys=True, default=str)
        os.replace(f"{target}.tmp", target)
    return path


def read_latest(folder: str) -> dict[str, object]:
    with open(os.path.join(folder, "latest.json")) as f:
        pointer = json.load(f)
    with open(pointer["path"]) as f:
        return json.load(f)


class KeyValueCache:
    """Latest value per md5 of the key, in a table that only grows."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def put(self, items: dict[str, str]) -> None:
        rows = [(hashlib.md5(k.encode()).hexdigest(), v, time.time_ns()) for k, v in items.items()]
        self.spark.createDataFrame(rows, "md5_key string, value string, at bigint").write.mode("append").parquet(self.root)

    def get(self, key: str) -> str | None:
        if not _exists(self.spark, self.root):
            return None
        own = self.spark.read.parquet(self.root).where(F.col("md5_key") == hashlib.md5(key.encode()).hexdigest())
        row = own.agg(F.max_by("value", "at").alias("v")).first()
        return row.v
