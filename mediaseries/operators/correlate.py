"""Time-lagged cross-correlation (TLCC), whole or in tumbling windows.

Row ``i`` of x meets row ``i + offset`` of y. A series goes to a task as it is, once for a block of offsets (or of window
sizes), and there offsets are slices of its arrays: days are neither copied per offset nor joined. A series
holds a row a day, so the calendar bounds what a task holds; keys and blocks spread the work.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

METHODS = ("pearson", "kendall", "spearman")


def _offset_array(offsets: Sequence[int]) -> Column:
    if isinstance(offsets, range) and len(offsets) > 1:
        return F.sequence(F.lit(offsets[0]), F.lit(offsets[-1]), F.lit(offsets.step))
    return F.array(*[F.lit(int(k)) for k in offsets])


def lagged_pairs(
    series: DataFrame,
    x: str,
    y: str,
    offsets: Sequence[int],
    keys: Sequence[str] = (),
    window_sizes: Sequence[int] | None = None,
) -> DataFrame:
    """Every (x, y) pair of every offset; a row without partner, or with a missing side, has both NULL.

    ``series`` carries its position ``i``. Windows are cut on the position of x,
    after the shift; several sizes may be asked for at once.
    """
    left = series.select(*keys, "i", F.col(x).cast("double").alias("x"), F.explode(_offset_array(offsets)).alias("offset"))
    left = left.withColumn("j", F.col("i") + F.col("offset"))
    right = series.select(*keys, F.col("i").alias("j"), F.col(y).cast("double").alias("y"))
    pairs = left.join(right, [*keys, "j"], "left")
    complete = F.col("x").isNotNull() & F.col("y").isNotNull()
    columns = [*keys, "offset", "i", F.when(complete, F.col("x")).alias("x"), F.when(complete, F.col("y")).alias("y")]
    if window_sizes is None:
        return pairs.select(*columns)
    sizes = F.explode(F.array(*[F.lit(int(w)) for w in window_sizes])).alias("window_size")
    return pairs.select(*columns, sizes).withColumn("window", F.floor(F.col("i") / F.col("window_size")).cast("int"))


def shifted(y: np.ndarray, offsets: Sequence[int]) -> np.ndarray:
    """A row for each offset, with y[i + offset] at i and NaN beyond the ends."""
    n = len(y)
    at = np.arange(n) + np.asarray(offsets, np.int64)[:, None]
    return np.where((at >= 0) & (at < n), y[np.clip(at, 0, n - 1)], np.nan)


def windows(rows: np.ndarray, size: int) -> np.ndarray:
    """Rows cut into tumbling windows: the last axis holds one, the last window is filled up with NaN."""
    short = -rows.shape[-1] % size
    padded = np.concatenate([rows, np.full((*rows.shape[:-1], short), np.nan)], axis=-1)
    return padded.reshape(*rows.shape[:-1], -1, size)


def correlations(x: np.ndarray, y: np.ndarray, both: np.ndarray) -> np.ndarray:
    """Pearson correlation along the last axis over the places where ``both`` holds; NaN where a side is constant."""
    n = both.sum(-1, keepdims=True)

    def centred(v):
        mean = np.where(both, v, 0).sum(-1, keepdims=True) / np.maximum(n, 1)
        return np.where(both, v - mean, 0)

    def varies(v):
        return np.where(both, v, np.inf).min(-1) < np.where(both, v, -np.inf).max(-1)

    a, b = centred(x), centred(y)
    spread = np.sqrt((a * a).sum(-1)) * np.sqrt((b * b).sum(-1))
    defined = varies(x) & varies(y) & (spread > 0)
    return np.where(defined, (a * b).sum(-1) / np.where(defined, spread, 1), np.nan)


def codes(values: np.ndarray) -> np.ndarray:
    """Values by their order, made once for all offsets and windows; NaN is the largest. Two bytes each where they do, as those sort fastest."""
    distinct, code = np.unique(values, return_inverse=True)
    return code.astype(np.int16 if len(distinct) < 1 << 15 else np.int64)


def average_ranks(code: np.ndarray, both: np.ndarray) -> np.ndarray:
    """Ranks along the last axis among the places where ``both`` holds; equal values share the mean of theirs. Meaningless elsewhere."""
    code = np.where(both, code, np.iinfo(code.dtype).max)
    order = np.argsort(code, axis=-1, kind="stable")
    ordered = np.take_along_axis(code, order, -1)
    place = np.broadcast_to(np.arange(code.shape[-1]), code.shape)
    begins = np.ones(code.shape, bool)
    begins[..., 1:] = ordered[..., 1:] != ordered[..., :-1]
    ends = np.ones(code.shape, bool)
    ends[..., :-1] = begins[..., 1:]
    first = np.maximum.accumulate(np.where(begins, place, 0), -1)
    last = np.minimum.accumulate(np.where(ends, place, code.shape[-1])[..., ::-1], -1)[..., ::-1]
    ranks = np.empty(code.shape)
    np.put_along_axis(ranks, order, (first + last) / 2 + 1, -1)
    return ranks


def _inversions(order: np.ndarray) -> int:
    """Pairs i < j with order[i] > order[j]; values are ranks from 0, equal values do not count.

    Digit by digit: among values alike above a bit, count ones that stand before zeros.
    """
    total, bits = 0, int(order.max()).bit_length() if len(order) else 0
    for bit in range(bits):
        high = order >> (bit + 1)
        at = np.argsort(high, kind="stable")
        ones = (order[at] >> bit) & 1
        seen = np.cumsum(ones)
        high = high[at]
        starts = np.r_[True, high[1:] != high[:-1]]
        base = np.maximum.accumulate(np.where(starts, seen - ones, 0))
        total += int(((seen - base) * (1 - ones)).sum())
    return total


def kendall_tau_b(x: np.ndarray, y: np.ndarray) -> float | None:
    """Kendall's tau-b of two equally long arrays in n log n steps."""
    n = len(x)
    if n < 2:
        return None
    x = np.unique(x, return_inverse=True)[1]
    y = np.unique(y, return_inverse=True)[1]

    def tied(codes: np.ndarray) -> int:
        counts = np.unique(codes, return_counts=True)[1].astype(np.int64)
        return int((counts * (counts - 1) // 2).sum())

    pairs = n * (n - 1) // 2
    tx, ty, both = tied(x), tied(y), tied(x.astype(np.int64) * (y.max() + 1) + y)
    if tx == pairs or ty == pairs:
        return None
    discordant = _inversions(y[np.lexsort((y, x))])
    agree_minus_not = pairs - tx - ty + both - 2 * discordant
    return agree_minus_not / (np.sqrt(float(pairs - tx)) * np.sqrt(float(pairs - ty)))


#: Numbers that are worked on together, and a task's share: so many offsets (times window sizes) at once, fewer of the slower tau.
TOGETHER, SHARE, TAU_SHARE = 1 << 19, 600, 40


def _measure(x: np.ndarray, y: np.ndarray, offsets: Sequence[int], size: int, methods: Sequence[str]) -> dict[str, np.ndarray]:
    """Correlations of every offset and window, per method. ``size`` is the whole length for one window."""
    found: dict[str, list[np.ndarray]] = {m: [] for m in methods}
    step = max(1, TOGETHER // len(x))
    code_x, code_y = codes(x), codes(y)
    for low in range(0, len(offsets), step):
        part = offsets[low : low + step]
        a, b = windows(x, size)[None], windows(shifted(y, part), size)
        both = ~np.isnan(a) & ~np.isnan(b)
        if "pearson" in methods:
            found["pearson"].append(correlations(a, b, both))
        if "spearman" in methods:
            at = windows(shifted(np.arange(len(y)), part), size)
            ca = np.broadcast_to(_padded(code_x, size), both.shape)
            cb = code_y[np.where(np.isnan(at), 0, at).astype(np.int64)]
            found["spearman"].append(correlations(average_ranks(ca, both), average_ranks(cb, both), both))
        if "kendall" in methods:
            wide = np.broadcast_to(a, both.shape)
            taus = [kendall_tau_b(wide[k][both[k]], b[k][both[k]]) for k in np.ndindex(both.shape[:-1])]
            found["kendall"].append(np.array([np.nan if t is None else t for t in taus]).reshape(both.shape[:-1]))
    return {m: np.concatenate(parts) for m, parts in found.items()}


def _padded(code: np.ndarray, size: int) -> np.ndarray:
    return np.concatenate([code, np.zeros(-len(code) % size, code.dtype)]).reshape(-1, size)


def _blocks(offsets: Sequence[int], methods: Sequence[str], sizes: Sequence[int] | None) -> list[tuple]:
    """What one task does with a series: methods, offsets, window sizes. Depends on what is asked for, not on the data."""
    out = []
    for share, some in ((SHARE, [m for m in methods if m != "kendall"]), (TAU_SHARE, [m for m in methods if m == "kendall"])):
        if not some:
            continue
        if sizes is None:
            out += [(some, offsets[low : low + share], None) for low in range(0, len(offsets), share)]
        else:
            each = max(1, share // len(offsets))
            out += [(some, offsets, sizes[low : low + each]) for low in range(0, len(sizes), each)]
    return out


def _correlated(blocks: list[tuple], keys: Sequence[str], windowed: bool, kind: pa.Schema):
    def one(table: pa.Table) -> pa.Table:
        columns: dict[str, list[np.ndarray]] = {n: [] for n in kind.names if n not in keys}
        place = table.column("i").to_numpy()
        n = int(place.max()) + 1
        x, y = np.full(n, np.nan), np.full(n, np.nan)
        there = np.zeros(n, bool)
        x[place], y[place], there[place] = table.column("x").to_numpy(), table.column("y").to_numpy(), True
        methods, offsets, sizes = blocks[table.column("block")[0].as_py()]
        for size in sizes or [n]:
            held = np.flatnonzero(np.add.reduceat(there, np.arange(0, n, size)))
            for method, found in _measure(x, y, offsets, size, methods).items():
                found = found[:, held]
                columns["correlation"].append(found.ravel())
                columns["offset"].append(np.repeat(np.asarray(offsets, np.int32), len(held)))
                columns["method"].append(np.full(found.size, method))
                if windowed:
                    columns["window"].append(np.tile(held.astype(np.int32), len(offsets)))
                    columns["window_size"].append(np.full(found.size, size, np.int32))
        arrays = {c: pa.array(np.concatenate(v), kind.field(c).type, from_pandas=True) for c, v in columns.items()}
        rows = len(arrays["correlation"])
        for k in keys:
            arrays[k] = pa.repeat(pa.scalar(table.column(k)[0].as_py(), kind.field(k).type), rows)
        return pa.Table.from_arrays([arrays[c] for c in kind.names], schema=kind)

    return one


def lagged_correlation(
    series: DataFrame,
    x: str,
    y: str,
    offsets: Sequence[int] = range(-150, 151),
    keys: Sequence[str] = (),
    methods: Sequence[str] = METHODS,
    window_sizes: Sequence[int] | None = None,
) -> DataFrame:
    """Correlation of x with y ``offset`` rows later, one row per key, (window,) method and offset.

    ``series`` carries its position ``i``, which no two rows of a key share. Windows are cut on the position of x, after the shift; any number of
    sizes may be asked for at once. Spearman ranks are made anew for each offset and window, over the pairs
    that exist there, from an order of the values that is made once. A missing side, NULL or NaN, leaves a pair out. Groups without a
    result stay, with NULL; a lone series has a row for every offset even when empty.

    Everything is one shuffle of the series: a task gets it once for a block of offsets, or of window sizes.
    """
    unknown = set(methods) - set(METHODS)
    if unknown:
        raise ValueError(f"unknown methods: {sorted(unknown)}")
    offsets, sizes = [int(k) for k in offsets], None if window_sizes is None else [int(w) for w in window_sizes]
    blocks = _blocks(offsets, methods, sizes)
    groups = [*keys, *(["window_size", "window"] if sizes else [])]
    fields = [*(series.schema[k] for k in keys), *(T.StructField(g, T.IntegerType()) for g in groups[len(keys) :])]
    schema = T.StructType(
        [*fields, T.StructField("method", T.StringType()), T.StructField("offset", T.IntegerType()), T.StructField("correlation", T.DoubleType())]
    )
    rows = series.select(*keys, "i", F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    rows = rows.withColumn("block", F.explode(F.array(*[F.lit(k) for k in range(len(blocks))])) if len(blocks) > 1 else F.lit(0))
    if len(blocks) > 1:  # else few small blocks would be put into one task
        parts = max(int(series.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * len(blocks))
        rows = rows.repartition(parts, *keys, "block")
    out = rows.groupBy(*keys, "block").applyInArrow(_correlated(blocks, keys, sizes is not None, to_arrow_schema(schema)), schema)
    if not keys and not sizes:
        grid = series.sparkSession.range(1).select(F.explode(F.array(*[F.lit(m) for m in methods])).alias("method"))
        grid = grid.select("method", F.explode(F.array(*[F.lit(k) for k in offsets])).alias("offset"))
        out = grid.join(out, ["method", "offset"], "left")
    return out.select(*groups, "method", "offset", "correlation")


def correlation_extremes(correlations: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Largest and smallest correlation of each method and the first offset that has it."""
    c, k = F.col("correlation"), F.col("offset")
    return (
        correlations.filter(c.isNotNull() & ~F.isnan(c))
        .groupBy(*keys, "method")
        .agg(
            F.max("correlation").alias("max_corr"),
            F.max_by(k, F.struct(c, -k)).alias("max_offset"),
            F.min("correlation").alias("min_corr"),
            F.min_by(k, F.struct(c, k)).alias("min_offset"),
        )
    )
