"""Raw minute-bar files: two directory layouts, one frame."""

from __future__ import annotations

import hashlib
import os
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

# Fixed column lists of the raw files.
HISTORICAL = ["exchange", "symbol", "open", "close", "high", "low", "amount", "volume", "position", "bob", "eob", "type"]
DAILY = [*HISTORICAL, "sequence"]
_TEXT = {"exchange", "symbol", "bob", "eob"}


class SchemaDriftError(ValueError):
    """A raw file whose header isn't the expected one."""


class ContractError(ValueError):
    """A name that isn't a contract's."""


def raw_schema(columns: list[str]) -> StructType:
    kind = lambda c: StringType() if c in _TEXT else IntegerType() if c in ("type", "sequence") else DoubleType()
    return StructType([StructField(c, kind(c)) for c in columns])


def check_header(line: str, columns: list[str]) -> None:
    if line.strip().split(",") != columns:
        raise SchemaDriftError(f"found {line.strip()!r}")


def split_contract(name: str) -> tuple[str, int]:
    """('RB', 202001) of RB2001."""
    letters, digits = name[:-4], name[-4:]
    if not (1 <= len(letters) <= 2 and letters.isascii() and letters.isalpha() and letters.isupper() and digits.isdigit() and 1 <= int(digits[2:]) <= 12):
        raise ContractError(name)
    return letters, 200000 + int(digits)


def product_of(contract: Column) -> Column:
    return F.regexp_extract(contract, r"^([A-Z]{1,2})(\d{4})$", 1)


def delivery_of(contract: Column) -> Column:
    """yyyymm; null where the name isn't a contract's."""
    number = F.regexp_extract(contract, r"^[A-Z]{1,2}(\d{4})$", 1)
    month = F.when(number != "", F.substring(number, 3, 2).cast("int"))
    return F.when(month.between(1, 12), 200000 + number.cast("int"))


def is_pseudo(contract: Column) -> Column:
    """Index and continuation series that vendors put among contracts."""
    return contract.rlike("(8888|9999|9998)$")


def alive(delivery: Column, start: Column, end: Column, months: int = 14) -> Column:
    """Whether a contract, listed ``months`` before delivery, can have bars between two dates."""
    last = F.last_day(F.to_date(F.format_string("%06d01", delivery), "yyyyMMdd"))
    return (F.add_months(F.trunc(last, "month"), -months) <= end) & (last >= start)


class RawReader(Protocol):
    """Where the files of one layout are, and how they read."""

    def discover(self) -> list[str]: ...

    def read(self, spark: SparkSession) -> DataFrame: ...


class TreeReader:
    """One scan over all files below ``root``; the file's place is kept as ``source_file``."""

    def __init__(self, root: str, columns: list[str], priority: int, glob: str = "*.csv"):
        self.root, self.columns, self.priority, self.glob = root, columns, priority, glob

    def discover(self) -> list[str]:
        found = [os.path.join(d, f) for d, _, names in os.walk(self.root) for f in names if f.endswith(".csv")]
        return sorted(found)

    def read(self, spark: SparkSession) -> DataFrame:
        reader = spark.read.schema(raw_schema(self.columns)).option("header", True).option("enforceSchema", False).option("nullValue", "nan").option("nanValue", "NaN").option("recursiveFileLookup", True).option("pathGlobFilter", self.glob)
        return reader.csv(self.root).withColumn("source_file", F.col("_metadata.file_path")).withColumn("tree_priority", F.lit(self.priority))


def historical_tree(root: str) -> TreeReader:
    return TreeReader(root, HISTORICAL, 0)


def daily_tree(root: str) -> TreeReader:
    return TreeReader(root, DAILY, 1)


def readers(which: str, historical: str, daily: str) -> list[TreeReader]:
    chosen = {"historical": [historical_tree(historical)], "daily": [daily_tree(daily)], "both": [historical_tree(historical), daily_tree(daily)]}.get(which)
    if chosen is None:
        raise ValueError(f"no such tree: {which}")
    return chosen


def normalise(raw: DataFrame, zone: str = "Asia/Shanghai") -> DataFrame:
    """Traded bars with a known time and close: upper-case names, whole volumes, the instant and the
    exchange's wall clock. NaN counts as null."""
    known = lambda c: F.when(~F.isnan(c), F.col(c))
    bob = F.coalesce(F.try_to_timestamp("bob", F.lit("yyyy-MM-dd HH:mm:ssXXX")), F.try_to_timestamp("bob", F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")))
    out = raw.select(
        F.upper("exchange").alias("exchange"), F.upper("symbol").alias("contract"), *[known(c).cast("float").alias(c) for c in ("open", "close", "high", "low")], known("amount").alias("amount"),
        known("volume").cast("bigint").alias("volume"), known("position").cast("bigint").alias("position"), bob.alias("bob"), *[c for c in ("tree_priority", "source_file") if c in raw.columns],
    )
    out = out.where("bob is not null and close is not null and volume > 0").where(~is_pseudo(F.col("contract")))
    return out.withColumn("wall", F.from_utc_timestamp("bob", zone)).withColumn("product", product_of(F.col("contract"))).withColumn("delivery_ym", delivery_of(F.col("contract")))


def first_of(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in order."""
    from pyspark.sql import Window

    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")


def merge_trees(frames: list[DataFrame]) -> DataFrame:
    """All trees in one; of bars of one contract and time the tree of the lower priority wins."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return first_of(out, ["contract", "bob"], [F.col("tree_priority"), F.col("source_file")])


def fingerprint(paths: list[str], version: int = 1) -> str:
    """Changes when any file's path, time or size does."""
    h = hashlib.blake2b(digest_size=16)
    for p in sorted(paths):
        s = os.stat(p)
        h.update(f"{p}|{s.st_mtime_ns}|{s.st_size}|{version}\n".encode())
    return h.hexdigest()
