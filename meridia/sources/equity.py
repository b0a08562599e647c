"""Daily equity prices: a retrying source, normalisation, backfill into the store, adjustment, binary export."""

from __future__ import annotations

import datetime
import time
import urllib.request
from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from meridia.functions.scalars import canonical_symbol_of
from meridia.operators.asof import members_on
from meridia.operators.calendar import TradeCalendar
from meridia.sources.stores import PRICES, PriceStore, conform

# The headers of the upstream tables and what they are called here.
PRICE_HEADERS = {
    "日期": "date", "股票代码": "symbol_raw", "开盘": "open", "收盘": "close", "最高": "high", "最低": "low",
    "成交量": "volume", "成交额": "turnover", "振幅": "amplitude", "涨跌幅": "return_pct", "涨跌额": "price_change", "换手率": "turnover_rate",
}
EVENT_HEADERS = {"品种代码": "stock_code", "品种名称": "stock_name", "纳入日期": "in_date"}
#: Shares in a lot, the unit of upstream volumes.
LOT = 100.0


class SourceError(RuntimeError):
    """A source that gives nothing usable."""


class EmptyResponse(SourceError):
    """A source that answers without rows."""


class UniverseUnavailable(SourceError):
    """A universe whose members can't be told."""


class PriceSource(Protocol):
    """What ``Fetcher`` needs of a source."""

    name: str

    def prices(self, symbol: str, start: datetime.date, end: datetime.date, adjust: str) -> DataFrame: ...

    def members(self, universe: str) -> DataFrame: ...

    def trading_days(self) -> DataFrame: ...


def retrying(call: Callable[[], object], attempts: int = 3, wait: float = 0.5, factor: float = 2.0, on: tuple[type[BaseException], ...] = (OSError,)) -> object:
    """The result of ``call``, tried again after growing waits; the last error comes out."""
    for k in range(attempts):
        try:
            return call()
        except on:
            if k + 1 == attempts:
                raise
            time.sleep(wait * factor**k)
    raise ValueError("no attempt was allowed")


def normalise_prices(raw: DataFrame, symbol: str) -> DataFrame:
    """Rows of the price store from an upstream table: known headers renamed and others dropped, volume in shares,
    vwap as the mean of high, low and close (turnover over volume isn't adjusted as prices are)."""
    named = raw.select(*[F.col(f"`{c}`").alias(PRICE_HEADERS[c]) for c in raw.columns if c in PRICE_HEADERS])
    typed = named.withColumn("date", F.to_date("date")).withColumn("volume", F.col("volume").cast("double") * LOT)
    typical = (F.col("high").cast("double") + F.col("low").cast("double") + F.col("close").cast("double")) / 3
    return conform(typed.withColumn("vwap", typical).withColumn("symbol", F.lit(canonical_symbol_of(symbol))), PRICES)


def normalise_events(raw: DataFrame) -> DataFrame:
    """(stock_code, in_date, out_date) of an upstream member table: codes of six digits, dates that can't be read null, and
    no date of leaving, which upstream doesn't tell."""
    names = {c: EVENT_HEADERS.get(c, c) for c in raw.columns}
    missing = {"stock_code", "in_date"} - set(names.values())
    if missing:
        raise UniverseUnavailable(f"the member table lacks {sorted(missing)}")
    named = raw.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items() if n in ("stock_code", "in_date")])
    code = F.col("stock_code").cast("string")
    padded = F.when(F.length(code) < 6, F.lpad(code, 6, "0")).otherwise(code)
    return named.select(padded.alias("stock_code"), F.expr("try_cast(cast(in_date as string) as date)").alias("in_date"), F.lit(None).cast("date").alias("out_date"))


def adjusted(prices: DataFrame, factors: DataFrame, factor: str, fields: list[str], as_of: datetime.date | None = None) -> DataFrame:
    """Prices (symbol, date, fields, volume, amount) with the adjustment factor as last known on each day (1 before
    any), fields and factor rebased to the factor of ``as_of``, volume divided by the factor and vwap = amount / volume.

    Prices come adjusted by the factor; a rebase divides both by the factor of the last row at or before ``as_of``."""
    w = Window.partitionBy("symbol").orderBy("date")
    met = prices.join(factors.select("symbol", "date", F.col(factor).cast("double").alias(factor)), ["symbol", "date"], "left")
    met = met.withColumn(factor, F.coalesce(F.last(factor, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(1.0)))
    if as_of is not None:
        base = F.max_by(F.when(F.col("date") <= F.lit(as_of), F.col(factor)), F.when(F.col("date") <= F.lit(as_of), F.col("date"))).over(Window.partitionBy("symbol"))
        met = met.withColumn("__base", base)
        for c in [*fields, factor]:
            met = met.withColumn(c, F.col(c) / F.when(F.col("__base") != 0, F.col("__base")))
        met = met.drop("__base")
    met = met.withColumn("volume", F.col("volume") / F.when(F.col(factor) != 0, F.col(factor)))
    return met.withColumn("vwap", F.col("amount") / F.when(F.col("volume") != 0, F.col("volume")))


class Fetcher:
    """Backfill and reads of a store from a source."""

    def __init__(self, spark: SparkSession, root: str, source: PriceSource, adjust: str = "", refresh_days: int = 7, pause: float = 0.0):
        self.spark, self.source, self.adjust, self.refresh_days, self.pause = spark, source, adjust, refresh_days, pause
        self.store = PriceStore(spark, f"{root}/prices")
        self.calendar_path = f"{root}/calendar/source={source.name}"

    def pull(self, start: datetime.date, end: datetime.date, universe: str | None = None, symbols: Iterable[str] | None = None, adjust: str | None = None) -> dict[str, int]:
        """Rows written and skipped, and symbols that failed, of a universe's members at any time or of given symbols.
        What is there already isn't written again."""
        if (universe is None) == (symbols is None):
            raise ValueError("give a universe or symbols")
        if universe is not None:
            symbols = [r.stock_code for r in self.source.members(universe).select("stock_code").distinct().orderBy("stock_code").toLocalIterator()]
        counts = {"pulled": 0, "skipped": 0, "failed": 0}
        for symbol in map(canonical_symbol_of, symbols):
            try:
                rows = self.source.prices(symbol, start, end, self.adjust if adjust is None else adjust)
            except SourceError:
                counts["failed"] += 1
                continue
            written, skipped = self.store.write(rows)
            counts["pulled"], counts["skipped"] = counts["pulled"] + written, counts["skipped"] + skipped
            time.sleep(self.pause)
        return counts

    def universe(self, name: str, on: datetime.date) -> list[str]:
        """Members of a universe on a day, by their store symbols."""
        rows = members_on(self.source.members(name), F.lit(on)).orderBy("stock_code").toLocalIterator()
        return [canonical_symbol_of(r.stock_code) for r in rows]

    def panel(self, universe: str | list[str], fields: list[str], start: datetime.date, end: datetime.date, on: datetime.date | None = None) -> DataFrame:
        """Stored fields of given symbols, or of a universe's members on ``on`` (by default the last day)."""
        symbols = self.universe(universe, on or end) if isinstance(universe, str) else [canonical_symbol_of(s) for s in universe]
        return self.store.panel(fields, symbols, str(start), str(end))

    def calendar(self, refresh: bool = False) -> TradeCalendar:
        """The source's trading days, from the cache while it is fresh."""
        cached = None if refresh else TradeCalendar.load(self.spark, self.calendar_path, self.refresh_days)
        if cached is None:
            cached = TradeCalendar(self.source.trading_days(), "trade_date")
            cached.save(self.calendar_path)
        return cached

    def context(self, on: datetime.date) -> dict[str, object]:
        """What a run may know: its day alone."""
        return {"as_of": on}


class UrlPrices(DataSource):
    """``spark.read.format("url_prices")``: CSV tables of prices with upstream headers from a URL per symbol, a
    partition each, with retries. Options: ``url`` with ``{symbol}`` in it, ``symbols`` separated by commas,
    ``attempts`` and ``wait``. All columns are strings; see ``normalise_prices``."""

    @classmethod
    def name(cls) -> str:
        return "url_prices"

    def schema(self) -> str:
        return "symbol string, " + ", ".join(f"`{c}` string" for c in PRICE_HEADERS)

    def reader(self, schema: StructType) -> DataSourceReader:
        return _UrlReader(self.options, schema.names)


class _UrlReader(DataSourceReader):
    def __init__(self, options: dict[str, str], names: list[str]):
        self.url, self.names = options["url"], names
        self.symbols = [s for s in options["symbols"].split(",") if s]
        self.attempts, self.wait = int(options.get("attempts", "3")), float(options.get("wait", "0.5"))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(s) for s in self.symbols]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import csv
        import io

        def body() -> str:
            with urllib.request.urlopen(self.url.replace("{symbol}", partition.value), timeout=30) as answer:
                return answer.read().decode("utf-8-sig")

        for row in csv.DictReader(io.StringIO(retrying(body, self.attempts, self.wait))):
            yield (partition.value, *(row.get(c) for c in self.names[1:]))


def write_bins(panel: DataFrame, folder: str, fields: list[str], symbol: str = "symbol", day: str = "date") -> DataFrame:
    """Writes the panel as calendars/day.txt, instruments/all.txt and features/<symbol>/<field>.day.bin: little-endian
    floats, first the place of the symbol's first day in the calendar, then a value for each day up to its last,
    NaN where there is none. Returns (symbol, first, last, days). ``folder`` is one that all executors share.

    A symbol's rows are written by one task; the calendar and the list of symbols by the driver."""
    import numpy as np
    from pyarrow import fs as pafs

    def place(uri: str):
        return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")

    w = Window.partitionBy(F.lit(0)).orderBy(day)
    days = panel.select(day).where(F.col(day).isNotNull()).distinct().withColumn("__at", F.row_number().over(w) - 1)
    numbered = panel.where(F.col(symbol).isNotNull()).select(symbol, day, *[F.col(f).cast("float").alias(f) for f in fields]).join(days, day)

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        fs, root = place(folder)
        table = table.sort_by("__at")
        at = table["__at"].to_numpy()
        home = f"{root}/features/{key[0].as_py().lower()}"
        fs.create_dir(home, recursive=True)
        for f in fields:
            values = np.full(at[-1] - at[0] + 2, np.nan, dtype="<f4")
            values[0] = at[0]
            values[at - at[0] + 1] = table[f].to_pandas()
            with fs.open_output_stream(f"{home}/.{f}.tmp") as out:
                out.write(values.tobytes())
            fs.move(f"{home}/.{f}.tmp", f"{home}/{f}.day.bin")
        dates = table[day]
        return pa.table({"symbol": pa.array([key[0].as_py()]), "first": pa.array([dates[0].as_py()], pa.date32()), "last": pa.array([dates[-1].as_py()], pa.date32()), "days": pa.array([len(table)], pa.int64())})

    written = numbered.groupBy(symbol).applyInArrow(run, "symbol string, first date, last date, days long").toArrow()
    fs, root = place(folder)
    for name in ("calendars", "instruments"):
        fs.create_dir(f"{root}/{name}", recursive=True)
    with fs.open_output_stream(f"{root}/calendars/day.txt") as out:
        for r in days.orderBy(day).toLocalIterator():
            out.write(f"{r[day]}\n".encode())
    with fs.open_output_stream(f"{root}/instruments/all.txt") as out:
        for r in written.sort_by("symbol").to_pylist():
            out.write(f"{r['symbol']}\t{r['first']}\t{r['last']}\n".encode())
    return panel.sparkSession.createDataFrame(written.to_pandas(), "symbol string, first date, last date, days long")


def read_bin(path: str) -> tuple[int, list[float]]:
    """Place of the first day, and the values, of one file."""
    import numpy as np

    values = np.fromfile(path, dtype="<f4")
    return int(values[0]), values[1:].tolist()


def orders_of(decided: dict[str, float], prices: dict[str, float], held: dict[str, float], cash: float, unit: int = 100, risk: float = 1.0) -> tuple[dict[str, float], dict[str, float]]:
    """(sell, buy) shares of a rotation: names in ``held`` without a wish are sold whole; what is then at hand, times ``risk``,
    is split evenly over the wished names that aren't held, in whole lots of ``unit``. Names without a price aren't
    traded. ``decided`` are the wished names and their scores."""
    sell = {n: q for n, q in held.items() if n not in decided and prices.get(n)}
    new = [n for n in sorted(decided, key=lambda n: (-decided[n], n)) if n not in held and prices.get(n)]
    cash += sum(q * prices[n] for n, q in sell.items())
    each = cash * risk / len(new) if new else 0.0
    return sell, {n: q for n in new if (q := each // (prices[n] * unit) * unit) > 0}
