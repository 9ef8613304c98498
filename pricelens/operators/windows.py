"""Series windows: per-ticker position, full-window rolling aggregates, EWM.

Every series window is partitioned by the ticker and ordered by ``(blk, pos)``:
``pos`` is the 0-based bar index within the ticker (time order) and
``blk = pos div BLOCK``. Windows partitioned by ``(ticker, blk)`` ordered by
``pos`` then need exactly the same child ordering, so after :func:`prepare` one
hash exchange on the ticker and one sort feed every indicator of a plan, EWM
included.

Bars are the unit here: a ticker's bar count is bounded by the number of bar
periods in its history (about 2,520 trading days per decade), not by its tick
volume, so a ticker that owns a third of all ticks still yields a bounded series.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

TICKER = "ticker"
TS = "ts"
POS = "pos"
BLK = "blk"
BLOCK = 512


def prepare(df: DataFrame, ticker: str = TICKER, ts: str = TS) -> DataFrame:
    """Add ``pos`` (0-based index in time order) and ``blk`` (pos div BLOCK).

    The frame is hash-partitioned on the ticker into ``spark.sql.shuffle.partitions``
    partitions: this is the one exchange every later series window, per-ticker
    aggregate and split reuses. The count is explicit because the window work is
    CPU-bound per row, so parallelism should follow the cluster's configured
    partitions rather than AQE's byte-size coalescing.
    """
    if POS in df.columns and BLK in df.columns:
        return df
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df = df.repartition(n, ticker)
    d = df.withColumn(POS, F.row_number().over(Window.partitionBy(ticker).orderBy(ts)) - 1)
    return d.withColumn(BLK, F.floor(F.col(POS) / F.lit(BLOCK)))


def finish(df: DataFrame, had: bool) -> DataFrame:
    """Drop the helper columns if the caller's frame did not carry them."""
    return df if had else df.drop(POS, BLK)


def prepared(df: DataFrame) -> bool:
    return POS in df.columns and BLK in df.columns


def series_window(ticker: str = TICKER) -> WindowSpec:
    return Window.partitionBy(ticker).orderBy(BLK, POS)


def trailing(n: int, ticker: str = TICKER) -> WindowSpec:
    """Frame of the current row and the ``n - 1`` rows before it."""
    return series_window(ticker).rowsBetween(-(n - 1), 0)


def running(ticker: str = TICKER) -> WindowSpec:
    return series_window(ticker).rowsBetween(Window.unboundedPreceding, 0)


_AGG = {
    "mean": F.avg,
    "std": F.stddev_samp,   # sample deviation (ddof = 1)
    "min": F.min,
    "max": F.max,
    "sum": F.sum,
}


def rolling(x: str | Column, n: int, fn: str = "mean", ticker: str = TICKER) -> Column:
    """Rolling aggregate with a full-window guard: null until the frame holds ``n``
    non-null values (``min_periods = n``). One sliding frame for every ``n``, so a value
    that has left the frame leaves no trace. Needs a prepared frame."""
    x = F.col(x) if isinstance(x, str) else x
    w = trailing(n, ticker)
    return F.when(F.count(x).over(w) == n, _AGG[fn](x).over(w))


def ewm_depth(span: float, block: int = BLOCK) -> tuple[float, int]:
    """Decay r and carry depth K: blocks older than K contribute < 1e-17 relative.
    K = 0 means the span is so short that r**-block would overflow; such an EWM
    is computed from the last ceil(40 / ln(1/r)) values directly (see ewm_partials)."""
    r = 1.0 - 2.0 / (span + 1.0)
    if r <= 0.0:
        return max(r, 0.0), 1
    lnr = -math.log(r)
    if block * lnr > 600.0:
        return r, 0
    return r, max(1, math.ceil(40.0 / (block * lnr)))  # relative to the weight 1 of the row itself


def _short_terms(r: float) -> int:
    return math.ceil(40.0 / -math.log(r)) + 1


def ewm_partials(src: str, tag: str, span: float, ticker: str = TICKER) -> dict[str, Column]:
    """Stage 1 of the blocked EWM (window on ``(ticker, blk)`` ordered by ``pos``):
    in-block running sums of x * r**-o and whole-block totals of x * r**(B-1-o),
    for the values and for the non-null indicator (the denominator)."""
    r, K = ewm_depth(span)
    B = BLOCK
    x = F.col(src)
    ind = F.when(x.isNotNull(), F.lit(1.0)).otherwise(F.lit(0.0))
    xv = F.coalesce(x, F.lit(0.0))
    if K == 0:  # short span: terms older than L rows weigh < 1e-17
        w = series_window(ticker)
        L = _short_terms(r)
        num = sum((F.lit(r ** i) * F.coalesce(F.lag(src, i).over(w), F.lit(0.0))
                   for i in range(1, L)), xv)
        den = sum((F.lit(r ** i) * F.when(F.lag(src, i).over(w).isNotNull(), 1.0).otherwise(0.0)
                   for i in range(1, L)), ind)
        return {f"{tag}_pn": num, f"{tag}_pd": den}
    oc = F.col(POS) - F.col(BLK) * F.lit(B)
    inner = Window.partitionBy(ticker, BLK).orderBy(POS)
    grow = inner.rowsBetween(Window.unboundedPreceding, 0)
    whole = inner.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    up = F.pow(F.lit(r), -oc)                  # r**-o
    down = F.pow(F.lit(r), F.lit(B - 1) - oc)  # r**(B-1-o)
    return {
        f"{tag}_pn": F.sum(xv * up).over(grow),
        f"{tag}_pd": F.sum(ind * up).over(grow),
        f"{tag}_sn": F.sum(xv * down).over(whole),
        f"{tag}_sd": F.sum(ind * down).over(whole),
    }


def ewm_value(tag: str, span: float, ticker: str = TICKER) -> Column:
    """Stage 2: add the carry of older blocks (block totals lagged by k*BLOCK rows)
    and divide. The common factor r**o of numerator and denominator cancels."""
    r, K = ewm_depth(span)
    if K == 0:
        return F.when(F.col(f"{tag}_pd") > 0, F.col(f"{tag}_pn") / F.col(f"{tag}_pd"))
    w = series_window(ticker)
    cn = F.lit(0.0)
    cd = F.lit(0.0)
    for k in range(1, K + 1):
        wk = F.lit(r ** (BLOCK * (k - 1)))
        cn = cn + wk * F.coalesce(F.lag(f"{tag}_sn", k * BLOCK).over(w), F.lit(0.0))
        cd = cd + wk * F.coalesce(F.lag(f"{tag}_sd", k * BLOCK).over(w), F.lit(0.0))
    num = F.col(f"{tag}_pn") + F.lit(r) * cn
    den = F.col(f"{tag}_pd") + F.lit(r) * cd
    return F.when(den > 0, num / den)


def ewm_held(value: str, src: str, ticker: str = TICKER) -> Column:
    """Stage 3: a row without an observation keeps the value of the last row that has one.
    Between observations numerator and denominator decay alike, so this is exact however
    long the gap; only rows with an observation (own weight 1) rely on the cut carry."""
    seen = F.when(F.col(src).isNotNull(), F.col(value))
    return F.last(seen, ignorenulls=True).over(running(ticker))


def ewm_helpers(tag: str) -> list[str]:
    return [f"{tag}_{s}" for s in ("pn", "pd", "sn", "sd")]  # absent ones are ignored by drop


def ewm_mean(df: DataFrame, src: str, out: str, span: float, ticker: str = TICKER) -> DataFrame:
    """Exponentially weighted mean with ``adjust=True`` semantics:

        y_t = sum_j r**(t-j) x_j / sum_j r**(t-j),   r = 1 - 2/(span + 1),

    over non-null x_j (nulls are skipped in numerator and denominator; positions keep
    their decay). Exact, no recursion and no Python: inside a block a running sum of
    x * r**-o (o = offset in block) gives the local part; older blocks enter through
    each block's total, lagged by multiples of BLOCK rows (row t - kB always lies in
    block b - k); rows without an observation hold the last value. Needs a prepared frame.
    """
    r, _ = ewm_depth(span)
    if r == 0.0:  # span <= 1: the mean is the last observation
        return df.withColumn(out, F.last(F.col(src), ignorenulls=True).over(running(ticker)))
    tag = f"__{out}"
    d = df.withColumns(ewm_partials(src, tag, span, ticker))
    d = d.withColumn(tag, ewm_value(tag, span, ticker))
    d = d.withColumn(out, ewm_held(tag, src, ticker))
    return d.drop(tag, *ewm_helpers(tag))
