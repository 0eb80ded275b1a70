"""Catalogue of preparation operations, read off their function signatures."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

from rowloom.operators import aggregate, binning, columns, datemath, joins, ordered, rows, scaling


@dataclass(frozen=True)
class Operation:
    name: str
    run: Callable
    dense: bool = False  # needs a row index without gaps
    gaps: bool = False  # may leave gaps in the row index

    def parameters(self) -> tuple[list[str], list[str]]:
        """Required and optional parameter names."""
        found = list(inspect.signature(self.run).parameters.values())[1:]
        named = [p for p in found if p.kind not in (p.VAR_KEYWORD, p.VAR_POSITIONAL)]
        required = [p.name for p in named if p.default is p.empty]
        return required, [p.name for p in named if p.name not in required]


def _scaling(method: str) -> Callable:
    extra = {
        "log_scaling": "base='e', shift_mode='auto', shift=None",
        "quantile_transform": "n_quantiles=None, output_distribution='uniform'",
    }.get(method, "")
    run = partial(_scale, method)
    names = ["df", "column", "new_name", *[p.split("=")[0].strip() for p in extra.split(",") if p]]
    optional = {"new_name", *names[3:]}
    run.__signature__ = inspect.Signature(
        [
            inspect.Parameter(n, inspect.Parameter.POSITIONAL_OR_KEYWORD, default=None if n in optional else inspect._empty)
            for n in names
        ]
    )
    return run


def _scale(method, df, column, **params):
    return scaling.scale(df, method, column, **params)


def merge_datasets(
    df,
    mode="append",
    source_dataset_ids=None,
    source_dataset_id=None,
    left_keys=None,
    right_keys=None,
    join_how="inner",
    sources=None,
):
    """Append or join other tables, which ``sources`` maps from their names."""
    sources = sources or {}
    ids = list(dict.fromkeys([*(source_dataset_ids or []), *([source_dataset_id] if source_dataset_id else [])]))
    unknown = [i for i in ids if i not in sources]
    if not ids or unknown:
        raise rows.ParameterError(f"unknown source tables: {unknown}" if unknown else "a source table is required")
    tables = [sources[i] for i in ids]
    if mode == "append":
        indexed = all(joins.ROW in t.columns for t in [df, *tables])
        return joins.append_indexed(df, tables) if indexed else joins.append(df, tables)
    if mode == "join_on_keys":
        return joins.join_in_order(df, tables[0], left_keys, right_keys, join_how)
    raise rows.ParameterError("mode must be append or join_on_keys")


def _all() -> dict[str, Operation]:
    gaps = {"drop_duplicates", "drop_missing_rows", "delete_rows", "delete_rows_condition", "remove_outliers_iqr"}
    dense = {
        "add_row",
        "delete_rows",
        "duplicate_rows",
        "shift_column",
        "significant_lags_kendall",
        "rolling_window_stats_nested",
        "stats_rolling_mean",
        "update_cells",
    }
    functions = [
        rows.drop_duplicates,
        rows.sort_rows,
        rows.drop_missing_rows,
        rows.add_row,
        rows.remove_outliers_iqr,
        rows.delete_rows,
        rows.delete_rows_condition,
        rows.duplicate_rows,
        rows.update_cells,
        columns.fill_missing,
        columns.replace_values,
        columns.split_column,
        columns.merge_columns,
        columns.derive_column,
        columns.trim_whitespace,
        columns.cast_column,
        columns.unit_convert,
        columns.rename_column,
        columns.clip_values,
        columns.encode_categorical,
        columns.normalize_text_case,
        columns.duplicate_column,
        columns.delete_columns,
        binning.bin_numeric_categories,
        binning.auto_binning,
        datemath.extract_date_part,
        datemath.date_diff_days,
        datemath.datetime_floor,
        datemath.cyclical_encoding,
        datemath.math_scalar,
        datemath.math_unary,
        datemath.math_between_columns,
        ordered.shift_column,
        ordered.significant_lags_kendall,
        ordered.rolling_window_stats_nested,
        ordered.stats_percentile_rank,
        ordered.stats_rolling_mean,
        aggregate.group_aggregate,
        aggregate.stats_zscore,
        aggregate.stats_variance,
        aggregate.stats_std,
        merge_datasets,
    ]
    table = {f.__name__: Operation(f.__name__, f, f.__name__ in dense, f.__name__ in gaps) for f in functions}
    for method in scaling.SUFFIXES:
        table[method] = Operation(method, _scaling(method))
    return table


OPERATIONS = _all()

# Other names under which an operation may be called.
ALIASES = {
    "add_column": "merge_columns",
    "add_columns": "merge_columns",
    "concat_columns": "merge_columns",
    "concatenate_columns": "merge_columns",
    "custom_formula_column": "derive_column",
    "delete_column": "delete_columns",
    "duplicate_columns": "duplicate_column",
    "convert_units": "unit_convert",
    "unit_conversion": "unit_convert",
    "column_shift": "shift_column",
    "auto_bin": "auto_binning",
    "automatic_binning": "auto_binning",
    "numeric_to_categories": "bin_numeric_categories",
    "cyclical_encode": "cyclical_encoding",
    "kendall_lags": "significant_lags_kendall",
    "nested_rolling_stats": "rolling_window_stats_nested",
    "zscore": "stats_zscore",
    "percentile_rank": "stats_percentile_rank",
}


def operation(name: str) -> Operation:
    token = str(name or "").strip().lower()
    token = ALIASES.get(token, token)
    if token not in OPERATIONS:
        raise rows.ParameterError(f"unknown operation {name!r}")
    return OPERATIONS[token]


def catalogue() -> list[dict]:
    """Every operation with its required and optional parameters."""
    out = []
    for name in sorted(OPERATIONS):
        required, optional = OPERATIONS[name].parameters()
        summary = (inspect.getdoc(OPERATIONS[name].run) or "").split("\n")[0]
        if isinstance(OPERATIONS[name].run, partial):
            summary = f"Scale a numeric column by {name.replace('_', ' ')}."
        out.append(
            {"operation": name, "description": summary, "required_params": required, "optional_params": optional}
        )
    return out
