"""Configuration files: TOML defaults, declared costs, constituents, accepted formulas."""

from __future__ import annotations

import tomllib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class ConfigError(ValueError):
    """A configuration with a key that nothing reads, or without one that is needed."""


def load_toml(path: str, known: dict[str, set[str]]) -> dict[str, dict]:
    """Sections and keys of a file; unknown ones are errors, so that a misspelt key can't be ignored."""
    with open(path, "rb") as f:
        found = tomllib.load(f)
    for section, values in found.items():
        if section not in known:
            raise ConfigError(f"unknown section {section}")
        extra = set(values) - known[section]
        if extra:
            raise ConfigError(f"unknown keys in {section}: {sorted(extra)}")
    return found


def costs_table(spark: SparkSession, costs: dict[str, dict[str, float]]) -> DataFrame:
    """(product, fee, slippage) of declared costs; a product with one of them missing is an error."""
    for product, values in costs.items():
        if not {"fee", "slippage"} <= set(values):
            raise ConfigError(f"{product} declares {sorted(values)}")
    rows = [(p, float(v["fee"]), float(v["slippage"])) for p, v in sorted(costs.items())]
    return spark.createDataFrame(rows, "product string, fee double, slippage double")


def constituents(spark: SparkSession, path: str, last_day: str) -> DataFrame:
    """(stock_code, in_date, out_date) of a tab-separated file without header, by code and date; members of
    the file's latest date stay members until ``last_day``."""
    rows = spark.read.schema("stock_code string, in_date date, out_date date").option("sep", "\t").csv(path)
    latest = F.max("out_date").over(Window.partitionBy(F.lit(0)))
    return rows.withColumn("out_date", F.when(F.col("out_date") == latest, F.lit(last_day).cast("date")).otherwise(F.col("out_date"))).orderBy("stock_code", "in_date")


class FormulaZoo:
    """Accepted formulas in a CSV file of (name, formula); a formula is accepted if it isn't too close to
    one that is there and not too free."""

    def __init__(self, path: str, most_shared: int = 8, most_free: float = 0.5):
        import csv
        import os

        self.path, self.most_shared, self.most_free, self.formulas = path, most_shared, most_free, {}
        if os.path.exists(path):
            with open(path, newline="") as f:
                self.formulas = dict(csv.reader(f))

    def acceptable(self, formula: str) -> bool:
        from meridia.functions.expr import free_arguments, largest_common_subtree, parse_infix, size

        tree = parse_infix(formula)
        shared = max((largest_common_subtree(parse_infix(f), tree) for f in self.formulas.values()), default=0)
        return shared <= self.most_shared and free_arguments(tree) / size(tree) <= self.most_free

    def add(self, name: str, formula: str) -> bool:
        import csv

        if not self.acceptable(formula):
            return False
        with open(self.path, "a", newline="") as f:
            csv.writer(f).writerow([name, formula])
        self.formulas[name] = formula
        return True
