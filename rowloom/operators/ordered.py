"""Operators that look along the row order: shifts, rolling frames, ranks."""

from __future__ import annotations

import math
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.functions.guards import (
    ParameterError,
    number,
    place_after,
    present,
    require,
    require_batch,
    require_free,
    type_of,
)
from rowloom.functions.inversions import BLOCK_ROWS, count_inversions
from rowloom.functions.stats import kurt, skew
from rowloom.operators.ordering import BUCKET_ROWS, over_row_frames, require_index, running_total, with_row_index
from rowloom.operators.skew import lookup
from rowloom.session import scratch

_UP = {"up", "u", "lead"}
_DOWN = {"down", "d", "lag"}


def shift_column(
    df: DataFrame,
    column: str,
    direction: str = "down",
    shifts: int | str = 1,
    fill_value: Any = None,
    new_name: str | None = None,
) -> DataFrame:
    """The value ``shifts`` rows before (down) or behind (up).

    A fill value also replaces NULLs that were in the column already.
    """
    require(df, column)
    require_index(df, "shift_column")
    token = str(direction).strip().lower()
    if token not in _UP | _DOWN:
        raise ParameterError("direction must be up or down")
    back = token in _DOWN
    steps = 1 if shifts in (None, "") else abs(int(shifts))
    name = str(new_name or "").strip() or f"{column}_shift_{'down' if back else 'up'}_{steps}"
    require_free(df, name, [column])

    def build(spread: DataFrame, window) -> DataFrame:
        value = present(spread, column)
        moved = (F.lag if back else F.lead)(value, steps).over(window) if steps else value
        if fill_value not in (None, ""):
            moved = F.coalesce(moved, F.lit(fill_value).cast(type_of(spread, column)))
        return place_after(spread, column, {name: moved})

    return over_row_frames(df, steps if back else 0, 0 if back else steps, build)


def stats_rolling_mean(
    df: DataFrame,
    column: str,
    window: int | str,
    min_periods: int | str | None = None,
    new_name: str | None = None,
) -> DataFrame:
    require(df, column)
    if window in (None, "") or int(window) <= 0:
        raise ParameterError("window must be positive")
    width = int(window)
    least = width if min_periods in (None, "") else max(1, min(int(min_periods), width))
    name = str(new_name or "").strip() or f"{column}_roll_mean_{width}"
    require_free(df, name, [column])

    def build(spread: DataFrame, ordered) -> DataFrame:
        v, frame = number(spread, column), ordered.rowsBetween(1 - width, 0)
        mean = F.when(F.count(v).over(frame) >= least, F.avg(v).over(frame))
        return place_after(spread, column, {name: mean})

    return over_row_frames(df, width - 1, 0, build)


# Rolling statistics and their defaults.
ROLLING_STATS = ("mean", "std", "kurt", "min", "max", "median", "var", "skew", "slope")
DEFAULT_WINDOWS = (3, 5, 10, 20)
DEFAULT_STATS = ("mean", "std", "kurt")


def _listed(raw: Any, default: tuple) -> list:
    if isinstance(raw, (list, tuple)):
        items = [str(x).strip().lower() for x in raw]
    else:
        items = [x.strip().lower() for x in str(raw or "").split(",")]
    return [x for x in items if x] or list(default)


def _rolling(v: Column, at: Column, stat: str, frame) -> Column:
    def over(c: Column) -> Column:
        return c.over(frame)

    table = {
        "mean": lambda: over(F.avg(v)),
        "std": lambda: over(F.stddev_samp(v)),
        "var": lambda: over(F.var_samp(v)),
        "min": lambda: over(F.min(v)),
        "max": lambda: over(F.max(v)),
        "median": lambda: over(F.percentile(v, F.lit(0.5))),
        "skew": lambda: skew(v, over),
        "kurt": lambda: kurt(v, over, constant=-3.0),
        "slope": lambda: over(F.regr_slope(v, at)),
    }
    return table[stat]()


def rolling_window_stats_nested(
    df: DataFrame,
    column: str,
    windows: Any = None,
    stats: Any = None,
    min_periods: int | str | None = 1,
    prefix: str | None = None,
) -> DataFrame:
    """Several statistics over several window lengths in one pass.

    All frames share one bucket layout, so the table is shuffled once.
    """
    require(df, column)
    widths = [int(w) for w in _listed(windows, DEFAULT_WINDOWS) if int(w) > 0]
    chosen = [s for s in _listed(stats, DEFAULT_STATS) if s in ROLLING_STATS]
    if not chosen or not widths:
        raise ParameterError("no valid statistic or window")
    least = max(1, 1 if min_periods in (None, "") else int(min_periods))
    stem = str(prefix or "").strip() or column
    names = [f"{stem}_roll_{s}_{w}" for w in widths for s in chosen]
    for name in names:
        require_free(df, name, [column])

    def build(spread: DataFrame, ordered) -> DataFrame:
        v, at = number(spread, column), F.col("_row_index").cast("double")
        added = {}
        for w in widths:
            frame = ordered.rowsBetween(1 - w, 0)
            enough = F.count(v).over(frame) >= min(least, w)
            for s in chosen:
                added[f"{stem}_roll_{s}_{w}"] = F.when(enough, _rolling(v, at, s, frame))
        return place_after(spread, column, added)

    return over_row_frames(df, max(widths) - 1, 0, build)


def stats_percentile_rank(df: DataFrame, column: str, new_name: str | None = None) -> DataFrame:
    """Average rank divided by the number of values; NULL stays NULL.

    Equal values are counted first, then a running count over distinct values
    gives each its rank, and the table looks its rank up.
    """
    require(df, column)
    require_batch(df, "percentile rank")
    name = str(new_name or "").strip() or f"{column}_pct_rank"
    require_free(df, name, [column])
    keyed = df.withColumn("__v", number(df, column))
    counted = keyed.filter("__v is not null").groupBy("__v").agg(F.count("*").alias("__n"))
    ranked = running_total(counted, "__n", ["__v"], "__before")
    total = ranked.agg(F.sum("__n").alias("t")).first()["t"] or 1
    ranked = ranked.withColumn("__rank", (F.col("__before") + (F.col("__n") + 1) / 2) / F.lit(float(total)))
    joined = lookup(keyed, "__v", ranked, ["__rank"], "__n")
    return place_after(joined, column, {name: F.col("__rank")}).drop("__v", "__rank")


#: Parts that equal pairs of a Kendall lag can be dealt to.
TIE_PARTS = 1 << 10
#: Pairs up to which the p-value without ties is that of the exact distribution.
EXACT_PAIRS = 33


def _exact_kendall_p(n: int, few: int) -> float:
    """Two-sided chance of at most ``few`` inversions (or as many concordant pairs) in a random order of n rows."""
    if 4 * few == n * (n - 1):
        return 1.0
    ways = [1] + [0] * few  # orders of one row, by their inversions
    for size in range(2, n + 1):
        if size > few + 1 and few <= 1:
            # One more row adds one place for a single inversion.
            ways = [1, n - 1][: few + 1]
            break
        ways = [sum(ways[max(0, k - size + 1) : k + 1]) for k in range(few + 1)]
    return min(1.0, 2.0 * math.exp(math.log(sum(ways)) - math.lgamma(n + 1)))


def _kendall(r: Any) -> tuple[float, float]:
    """Tau-b and its two-sided p-value from pair counts: tie-corrected normal, or exact for few pairs without ties."""
    n, tie_a, tie_b, tie_ab, discordant = (int(r[c]) for c in ("pairs", "tie_a", "tie_b", "tie_ab", "inverted"))
    pairs = n * (n - 1) // 2
    if n < 3 or pairs in (tie_a, tie_b):
        return float("nan"), float("nan")
    concordant = pairs - discordant - tie_a - tie_b + tie_ab
    score = concordant - discordant
    tau = max(-1.0, min(1.0, score / math.sqrt(pairs - tie_a) / math.sqrt(pairs - tie_b)))
    few = min(concordant, discordant)
    if not tie_a and not tie_b and (n <= EXACT_PAIRS or few <= 1):
        return tau, _exact_kendall_p(n, few)
    m = n * (n - 1.0)
    spread = (m * (2 * n + 5) - int(r["odd_a"]) - int(r["odd_b"])) / 18
    variance = spread + 2.0 * tie_a * tie_b / m + int(r["triple_a"]) * int(r["triple_b"]) / (9.0 * m * max(n - 2, 1))
    return tau, math.erfc(abs(score) / math.sqrt(2.0 * variance)) if variance > 0 else float("nan")


def _tie_sums(pairs: DataFrame, side: str) -> DataFrame:
    """Per lag: pairs that tie in the column, and the two sums that correct the variance."""
    t = F.col("t").cast("decimal(38,0)")
    held = pairs.groupBy("lag", side).agg(F.count("*").alias("t"))
    sums = {"tie": t * (t - 1) / 2, "odd": t * (t - 1) * (2 * t + 5), "triple": t * (t - 1) * (t - 2)}
    return held.groupBy("lag").agg(*(F.sum(v.cast("decimal(38,0)")).alias(f"{name}_{side}") for name, v in sums.items()))


def kendall_lag_table(df: DataFrame, column: str, min_lag: int = 1, max_lag: int = 24, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Kendall's tau-b between the column and each lag of it, exact for any number of values.

    The pairs of a lag are numbered along (value, lagged value), then along
    (lagged value, first number), each by one range shuffle that carries no
    more than that; pairs that fall are the discordant ones, and ties are
    grouped counts. Only one row per lag, with its sums, reaches the driver.
    """
    require(df, column)
    require_index(df, "Kendall lags")
    low = max(1, int(min_lag))
    high = int(max_lag)
    if high < low:
        raise ParameterError("max_lag is below min_lag")
    x = number(df, column)
    known = df.select("_row_index", F.when(~F.isnan(x), x + F.lit(0.0)).alias("x"))  # no NaN, and one zero

    def build(spread: DataFrame, window) -> DataFrame:
        lags = F.array(
            *[F.struct(F.lit(k).alias("lag"), F.lag("x", k).over(window).alias("b")) for k in range(low, high + 1)]
        )
        return spread.withColumn("__lags", lags)

    framed = over_row_frames(known, high, 0, build).filter("x is not null")
    # Equal pairs may stand in any order, but not all in one partition: they part by where their rows lie.
    part = F.pmod(F.expr(f"_row_index div {BUCKET_ROWS}"), F.lit(TIE_PARTS)).cast("int").alias("part")
    pairs = framed.select(part, F.col("x").alias("a"), F.explode("__lags").alias("l"))
    pairs = pairs.select("part", "l.lag", "a", "l.b").filter("b is not null")
    with scratch(df.sparkSession):
        by_a = with_row_index(pairs, ["lag", "a", "b", "part"], ["lag", "a", "b"]).withColumnRenamed("_row_index", "p")
        # Among equal b the first numbers rise with a.
        by_b = with_row_index(by_a.select("lag", "b", "p"), ["lag", "b", "p"]).withColumnRenamed("_row_index", "r")
        sizes = by_a.groupBy("lag").agg(F.count("*").alias("pairs"), F.min("p").alias("first"))
        numbered = by_b.join(F.broadcast(sizes.select("lag", "first")), "lag")  # a row per lag
        numbered = numbered.select(F.col("lag").alias("grp"), (F.col("p") - F.col("first")).alias("p"), (F.col("r") - F.col("first")).alias("r"))
        inverted = count_inversions(numbered, block_rows).withColumnRenamed("grp", "lag")
        both = by_a.groupBy("lag", "a", "b").agg(F.count("*").cast("decimal(38,0)").alias("t")).groupBy("lag")
        both = both.agg(F.sum((F.col("t") * (F.col("t") - 1) / 2).cast("decimal(38,0)")).alias("tie_ab"))
        table = sizes.join(inverted, "lag").join(both, "lag").join(_tie_sums(by_a, "a"), "lag").join(_tie_sums(by_b, "b"), "lag")
        rows = [(r["lag"], *_kendall(r), r["pairs"]) for r in table.collect()]
    return df.sparkSession.createDataFrame(rows, "lag int, tau double, pvalue double, pairs long")


def significant_lags_kendall(
    df: DataFrame,
    column: str,
    min_lag: int = 1,
    max_lag: int = 24,
    alpha: float = 0.05,
    top_k: int | str | None = None,
    include_negative_tau: bool | None = True,
) -> DataFrame:
    """Add a lag column for every lag whose tau-b is significant."""
    if not 0 < float(alpha) <= 1:
        raise ParameterError("alpha must be between 0 and 1")
    table = kendall_lag_table(df, column, min_lag, max_lag).collect()
    keep_negative = True if include_negative_tau is None else bool(include_negative_tau)
    hits = [
        r for r in table
        if r["pairs"] >= 3 and r["tau"] == r["tau"] and r["pvalue"] <= float(alpha) and (keep_negative or r["tau"] >= 0)
    ]
    hits.sort(key=lambda r: (-abs(r["tau"]), r["lag"]))
    if top_k not in (None, "") and int(top_k) > 0:
        hits = hits[: int(top_k)]
    if not hits:
        raise ParameterError("no significant lag found")
    lags = sorted(r["lag"] for r in hits)
    for k in lags:
        require_free(df, f"{column}_lag_{k}", [column])

    def build(spread: DataFrame, window) -> DataFrame:
        v = number(spread, column)
        return place_after(spread, column, {f"{column}_lag_{k}": F.lag(v, k).over(window) for k in lags})

    return over_row_frames(df, max(lags), 0, build)
