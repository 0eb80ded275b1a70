"""Scaling with constants fitted in one aggregate.

``fit_scaler`` reads the table once and returns plain numbers; ``Scaler.apply``
is a projection, so fitted constants can be stored, reused on another table,
or applied to a stream.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.functions.guards import ParameterError, number, place_after, require, require_batch, require_free
from rowloom.functions.quantiles import exact_quantiles

SUFFIXES = {
    "min_max_scaling": "minmax",
    "max_absolute_scaling": "maxabs",
    "mean_normalization": "mean_norm",
    "unit_vector_scaling": "unit_vector",
    "decimal_scaling": "decimal_scaled",
    "z_score_scaling": "zscaled",
    "robust_scaling": "robust",
    "log_scaling": "log",
    "quantile_transform": "quantile",
}
_LOGS = {"e": "e", "ln": "e", "natural": "e", "10": "10", "log10": "10", "2": "2", "log2": "2"}
MAX_QUANTILES = 1_000
NORMAL_CLIP = 1e-7


@dataclass(frozen=True)
class Scaler:
    """A fitted scaling: ``(value - shift) / divisor``, a log, or quantiles."""

    method: str
    column: str
    new_name: str
    shift: float = 0.0
    divisor: float | None = None
    base: str | None = None
    references: tuple[float, ...] | None = None
    distribution: str = "uniform"

    def to_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_dict(cls, payload: dict) -> "Scaler":
        refs = payload.get("references")
        return cls(**{**payload, "references": tuple(refs) if refs is not None else None})

    def expression(self, df: DataFrame) -> Column:
        v = number(df, self.column)
        if self.base:
            moved = v + F.lit(self.shift)
            log = {"e": F.log, "10": F.log10, "2": F.log2}[self.base]
            return F.when(moved > 0, log(moved))
        if self.method == "quantile_transform":
            return _rank_between(self.references, self.distribution)(v) if self.references else F.lit(None).cast("double")
        if not self.divisor:
            return F.when(v.isNotNull(), F.lit(0.0))
        return (v - F.lit(self.shift)) / F.lit(self.divisor)

    def apply(self, df: DataFrame) -> DataFrame:
        require(df, self.column)
        require_free(df, self.new_name, [self.column])
        return place_after(df, self.column, {self.new_name: self.expression(df)})


def _rank_between(references: tuple[float, ...], distribution: str):
    """Arrow function: position of a value between the reference quantiles.

    Runs of equal references are met half way, by averaging the interpolation
    from both ends.
    """
    refs = np.asarray(references, dtype=float)
    grid = np.linspace(0.0, 1.0, num=len(refs))
    low, high = NormalDist().inv_cdf(NORMAL_CLIP), NormalDist().inv_cdf(1 - NORMAL_CLIP)

    @F.pandas_udf("double")
    def place(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        normal = NormalDist()
        for batch in batches:
            x = batch.to_numpy(dtype=float, na_value=np.nan)
            known = ~np.isnan(x)
            p = np.full(len(x), np.nan)
            forward = np.interp(x[known], refs, grid)
            backward = -np.interp(-x[known], -refs[::-1], -grid[::-1])
            p[known] = 0.5 * (forward + backward)
            p[known & (x == refs[0])] = 0.0
            p[known & (x == refs[-1])] = 1.0
            if distribution == "normal":
                p[known] = [
                    low if q <= NORMAL_CLIP else high if q >= 1 - NORMAL_CLIP else normal.inv_cdf(q) for q in p[known]
                ]
            yield pd.Series(p).astype("Float64").where(known, None)

    return place


def fit_scaler(
    df: DataFrame,
    method: str,
    column: str,
    new_name: str | None = None,
    base: str = "e",
    shift_mode: str = "auto",
    shift: float | str | None = None,
    n_quantiles: int | str | None = None,
    output_distribution: str = "uniform",
) -> Scaler:
    if method not in SUFFIXES:
        raise ParameterError(f"unknown scaling {method!r}")
    require(df, column)
    name = str(new_name or "").strip() or f"{column}_{SUFFIXES[method]}"
    v = number(df, column)
    if method == "log_scaling":
        kind = _LOGS.get(str(base).strip().lower())
        if kind is None:
            raise ParameterError("base must be e, 10 or 2")
        if str(shift_mode).strip().lower() == "custom":
            moved = 0.0 if shift in (None, "") else float(shift)
        else:
            require_batch(df, "automatic log shift")
            low = df.agg(F.min(v).alias("a")).first()["a"]
            moved = abs(low) + 1.0 if low is not None and low <= 0 else 0.0
        return Scaler(method, column, name, shift=moved, base=kind)
    require_batch(df, method)
    if method == "robust_scaling":
        q1, mid, q3 = exact_quantiles(df, [column], [0.25, 0.5, 0.75])[column]
        return Scaler(method, column, name, shift=mid or 0.0, divisor=None if q1 is None else q3 - q1)
    if method == "quantile_transform":
        if output_distribution not in {"uniform", "normal"}:
            raise ParameterError("output_distribution must be uniform or normal")
        rows = df.agg(F.count(v).alias("n")).first()["n"]
        if not rows:
            return Scaler(method, column, name)
        wanted = MAX_QUANTILES if n_quantiles in (None, "") else int(n_quantiles)
        points = max(2, min(wanted, rows))
        refs = exact_quantiles(df, [column], np.linspace(0.0, 1.0, points).tolist())[column]
        refs = np.maximum.accumulate(refs)
        return Scaler(method, column, name, references=tuple(map(float, refs)), distribution=output_distribution)
    wanted = {
        "min_max_scaling": {"a": F.min(v), "b": F.max(v)},
        "max_absolute_scaling": {"m": F.max(F.abs(v))},
        "mean_normalization": {"a": F.min(v), "b": F.max(v), "c": F.avg(v)},
        "unit_vector_scaling": {"m": F.sqrt(F.sum(v * v))},
        "decimal_scaling": {"m": F.max(F.abs(v))},
        "z_score_scaling": {"c": F.avg(v), "m": F.stddev_samp(v)},
    }[method]
    row = df.agg(*[c.alias(k) for k, c in wanted.items()]).first().asDict()
    if method in {"min_max_scaling", "mean_normalization"}:
        if row["a"] is None:
            return Scaler(method, column, name)
        return Scaler(method, column, name, shift=row.get("c", row["a"]), divisor=row["b"] - row["a"])
    if method == "decimal_scaling" and row["m"]:
        return Scaler(method, column, name, divisor=float(10 ** max(1, math.ceil(math.log10(row["m"])))))
    return Scaler(method, column, name, shift=row.get("c") or 0.0, divisor=row["m"])


def scale(df: DataFrame, method: str, column: str, **params) -> DataFrame:
    return fit_scaler(df, method, column, **params).apply(df)
