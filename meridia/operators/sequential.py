"""Recurrences that no window frame expresses: one Arrow pass over sorted series.

A series is read in order by one task. Averages and positions carry a few numbers from batch to batch, so a series may be
as long as it likes; functions that need their whole series (``per_series``) hold it in memory.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from meridia.functions.compile import Panel


def ewm_halflife(x: np.ndarray, halflife: float) -> np.ndarray:
    """y = a x + (1 - a) y', started at the first value; a null keeps the state."""
    return pd.Series(x).ewm(halflife=halflife, adjust=False, ignore_na=True).mean().to_numpy()


def ewm_adjusted(x: np.ndarray, alpha: float) -> np.ndarray:
    """Weighted mean of all values so far with weights (1 - alpha)^age; a null ages the others."""
    return pd.Series(x).ewm(alpha=alpha, adjust=True, ignore_na=False).mean().to_numpy()


def ewm_varying(x: np.ndarray, halflife: np.ndarray) -> np.ndarray:
    """As ``ewm_halflife`` with a half-life for each row; stretches of one half-life are averaged at once, each started at the
    state of the one before."""
    out, y = np.empty(len(x)), np.nan
    cuts = np.concatenate([[0], np.flatnonzero(halflife[1:] != halflife[:-1]) + 1, [len(x)]]) if len(x) else np.zeros(1, dtype=int)
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        part = np.concatenate([[y], x[lo:hi]])
        if halflife[lo] > 0:
            done = ewm_halflife(part, float(halflife[lo]))
        else:
            done = pd.Series(part).ffill().to_numpy()
        out[lo:hi], y = done[1:], done[-1]
    return out


def _doubles(column) -> np.ndarray:
    return np.asarray(column.cast(pa.float64()).to_pandas(), dtype=float)


def _sorted_series(df: DataFrame, panel: Panel, outputs: dict[str, object]) -> tuple[DataFrame, StructType]:
    """Whole series in partitions, sorted, with a column that tells them apart; and the schema with the outputs."""
    schema = StructType([*df.schema.fields, *(StructField(k, t) for k, t in outputs.items())])
    keyed = df.withColumn("__series", F.xxhash64(*panel.series))
    return keyed.repartition(*panel.series).sortWithinPartitions(*panel.series, *panel.order), schema


def _edges(key: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])


def streamed(df: DataFrame, panel: Panel, inputs: list[str], outputs: dict[str, object], function) -> DataFrame:
    """Adds columns in one pass that holds a batch at a time. ``function`` gets the bounds of the batch's series, the state in which the
    first of them was left (None where it begins here), and the inputs, as double arrays with NaN for null; it returns an array
    per output and the state of the last series."""
    dealt, schema = _sorted_series(df, panel, outputs)

    def run(batches):
        before, state = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("__series").to_numpy()
            found, state = function(_edges(key), state if before is not None and before == key[0] else None, *[_doubles(batch.column(c)) for c in inputs])
            before = key[-1]
            made = [pa.array(v, pa.int32()) if isinstance(kind, IntegerType) else pa.array(v, pa.float64(), from_pandas=True) for v, kind in zip(found, outputs.values(), strict=True)]
            kept = batch.drop_columns(["__series"])
            yield pa.RecordBatch.from_arrays([*kept.columns, *made], names=schema.names)

    return dealt.mapInArrow(run, schema)


def per_series(df: DataFrame, panel: Panel, inputs: list[str], outputs: dict[str, object], function) -> DataFrame:
    """Adds columns: ``function`` gets the inputs of one series in order, as double arrays with NaN for
    null, and returns an array per output. Partitions hold whole series, sorted; they stream through,
    and a batch and one series at a time are in memory."""
    dealt, schema = _sorted_series(df, panel, outputs)

    def finish(table: pa.Table) -> pa.Table:
        key = table["__series"].to_numpy()
        edges = _edges(key)
        columns = [_doubles(table[c]) for c in inputs]
        parts = [function(*[c[lo:hi] for c in columns]) for lo, hi in zip(edges[:-1], edges[1:], strict=True)]
        table = table.drop_columns(["__series"])
        for k, (name, kind) in enumerate(outputs.items()):
            values = np.concatenate([p[k] for p in parts])
            whole = isinstance(kind, IntegerType)
            table = table.append_column(name, pa.array(values, pa.int32() if whole else pa.float64(), from_pandas=not whole))
        return table

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("__series").to_numpy()
            if held and held[-1].column("__series")[-1].as_py() != key[0]:
                yield from finish(pa.Table.from_batches(held)).to_batches()
                held = []
            # the last series of a batch may go on in the next
            last = int(np.flatnonzero(key != key[-1])[-1]) + 1 if (key != key[-1]).any() else 0
            if last:
                yield from finish(pa.Table.from_batches([*held, batch.slice(0, last)])).to_batches()
                held = []
            held.append(batch.slice(last))
        if held:
            yield from finish(pa.Table.from_batches(held)).to_batches()

    return dealt.mapInArrow(run, schema)


def decayed(x: np.ndarray, series: np.ndarray, alpha: float, start: float, nulls_age: bool = False) -> np.ndarray:
    """y = alpha x + (1 - alpha) y' of each series, the first of them started at ``start`` (NaN: at its first value); a null keeps
    the state."""
    first = np.concatenate([[series[0]], series])
    values = pd.Series(np.concatenate([[start], x]))
    return values.groupby(first, sort=False).ewm(alpha=alpha, adjust=False, ignore_na=not nulls_age).mean().to_numpy()[1:]


def exponentials(df: DataFrame, panel: Panel, wanted: dict[str, tuple[str, str, float]]) -> DataFrame:
    """Adds exponential averages, target: (source, kind, number), in one pass over the series; kind is halflife (unadjusted) or
    adjusted (by its alpha: a mean with weights that fall with age, as the quotient of two decayed sums)."""
    sources = sorted({source for source, _, _ in wanted.values()})
    jobs = [(sources.index(source), kind, number if kind == "adjusted" else 1 - 0.5 ** (1 / number)) for source, kind, number in wanted.values()]

    def run(edges: np.ndarray, state: list[tuple[float, float]] | None, *x: np.ndarray) -> tuple[list[np.ndarray], list[tuple[float, float]]]:
        series = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
        begins = np.zeros(len(series), dtype=bool)
        begins[edges[:-1]] = True
        out, left = [], []
        for k, (i, kind, alpha) in enumerate(jobs):
            v = x[i]
            if kind == "halflife":
                y = decayed(v, series, alpha, np.nan if state is None else state[k][0])
                out.append(y)
                left.append((float(y[-1]), 0.0))
                continue
            # sums that start at 0: a series' first row counts alpha times, as every other
            known = ~np.isnan(v)
            own = begins.copy()
            own[0] &= state is None
            parts = []
            for u, start in ((np.where(known, v, 0.0), 0), (known.astype(float), 1)):
                u = np.where(own, alpha * u, u)
                parts.append(decayed(u, series, alpha, np.nan if state is None else state[k][start]))
            top, bottom = parts
            out.append(np.divide(top, bottom, out=np.full(len(v), np.nan), where=bottom > 0))
            left.append((float(top[-1]), float(bottom[-1])))
        return out, left

    return streamed(df, panel, sources, {target: DoubleType() for target in wanted}, run)


def exponential(df: DataFrame, source: str, target: str, panel: Panel, kind: str, number: float) -> DataFrame:
    """Adds one exponential average."""
    return exponentials(df, panel, {target: (source, kind, number)})


def positions(signal: np.ndarray, low: np.ndarray, high: np.ndarray, locked: np.ndarray, segment: np.ndarray, max_hold: int, state: tuple | None = None, edges: np.ndarray | None = None, left: list | None = None) -> np.ndarray:
    """Held position (-1, 0, 1) per bar: what was decided at the close of the bar before.

    The decision is long above ``high``, short below ``low`` and otherwise, or where a bound is
    missing, to keep what is held. A locked bar can't trade. A segment starts flat. Once a position
    has been kept for ``max_hold`` bars, a decision to keep it becomes one to close it.

    ``edges`` bound several series one behind the other; ``state`` (position, bars kept, decision, segment) is how the first was
    left before, and the last one's goes to ``left``.
    """
    wish = np.select([np.isnan(low) | np.isnan(high), signal > high, signal < low], [2, 1, -1], 2).tolist()
    n = len(signal)
    fresh = np.concatenate([[True], segment[1:] != segment[:-1]]) if n else np.zeros(0, dtype=bool)
    if edges is not None:
        fresh[edges[:-1]] = True
    held: list[int] = []
    now = kept = following = 0
    if state is not None and n:
        now, kept, following, last = state
        fresh[0] = segment[0] != last
    begins = set() if edges is None else set(edges[1:-1].tolist())
    for t, (new, shut, want) in enumerate(zip(fresh.tolist(), (locked > 0).tolist(), wish, strict=True)):
        before = 0 if t in begins else now
        if new:
            now = 0
        elif not shut:
            now = following
        kept = kept + 1 if now and now == before else 0
        held.append(now)
        following = now if want == 2 else want
        if following == now and kept >= max_hold:
            following = 0
    if left is not None and n:
        left.append((now, kept, following, float(segment[-1])))
    return np.array(held, dtype=np.int32)
