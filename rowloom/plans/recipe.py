"""Recipes and their history."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame

from rowloom.functions.guards import ROW, ParameterError, data_columns
from rowloom.operators.ordering import reindex, with_row_index
from rowloom.operators.rows import head
from rowloom.plans.registry import ALIASES, OPERATIONS, operation
from rowloom.plans.resolve import columns_in_text, resolve_column
from rowloom.session import materialize

DRY_RUN_ROWS = (20, 200, 2_000)  # least, default, most
PREVIEW_ROWS = 100
HISTORY_DEPTH = 50
_ONE_COLUMN = ("column", "left_column", "right_column", "reference_column", "target_column")
_COLUMN_LISTS = ("subset", "columns", "group_by", "left_keys")


@dataclass(frozen=True)
class Step:
    operation: str
    params: dict[str, Any] = field(default_factory=dict)
    description: str = ""

    def to_dict(self, index: int) -> dict[str, Any]:
        return {"index": index, "operation": self.operation, "params": self.params, "description": self.description}


@dataclass(frozen=True)
class Recipe:
    """Named steps. ``apply`` chains them lazily; Catalyst sees one plan."""

    steps: tuple[Step, ...]
    name: str = "Recipe"

    @classmethod
    def of(cls, *steps: tuple[str, dict[str, Any]], name: str = "Recipe") -> "Recipe":
        return cls(tuple(Step(op, dict(params)) for op, params in steps), name)

    @classmethod
    def from_dict(cls, payload: dict[str, Any], datasets: dict[str, str] | None = None) -> "Recipe":
        """Read a plan as users write it: operation aliases, ``op`` and
        ``arguments`` as other keys, ``#`` in front of column names, and tables
        referred to by name (``datasets`` maps names to table ids)."""
        steps = []
        for raw in payload.get("steps") or []:
            if isinstance(raw, dict):
                op = str(raw.get("operation") or raw.get("op") or "").strip().lower()
                given = raw.get("params") if isinstance(raw.get("params"), dict) else raw.get("arguments")
                params = {str(k): _unmark(v) for k, v in (given if isinstance(given, dict) else {}).items()}
                op = ALIASES.get(op, op)
                if op == "merge_datasets":
                    params = _resolve_tables(params, datasets or {})
                steps.append(Step(op, params, str(raw.get("description") or "").strip()))
        return cls(tuple(steps), str(payload.get("name") or "Recipe").strip())

    def to_dict(self) -> dict[str, Any]:
        return {"name": self.name, "steps": [s.to_dict(i + 1) for i, s in enumerate(self.steps)]}

    def upto(self, count: int) -> "Recipe":
        return replace(self, steps=self.steps[: max(0, count)])

    def apply(self, df: DataFrame, sources: dict[str, DataFrame] | None = None) -> DataFrame:
        """All steps; the rows that are left are numbered without gaps."""
        return self._stages(df, sources) if self.steps else df

    def _stages(self, df: DataFrame, sources: dict[str, DataFrame] | None) -> DataFrame:
        gaps, order = False, None
        for number, step in enumerate(self.steps, 1):
            op = operation(step.operation)
            params = dict(step.params)
            if op.name == "merge_datasets":
                params["sources"] = sources or {}
            try:
                if op.dense or op.name == "sort_rows":
                    if ROW not in df.columns and order:
                        df, order = with_row_index(df, order), None
                df = op.run(df, **params)
            except (ParameterError, TypeError) as err:
                raise ParameterError(f"step {number} ({step.operation}): {err}") from err
            gaps = gaps or op.gaps
            if op.dense and not op.gaps or op.name == "sort_rows":
                gaps = False
            if op.name == "group_aggregate":
                keys = params["group_by"]
                order = [k.strip() for k in keys.split(",")] if isinstance(keys, str) else list(keys)
                gaps = False
        return reindex(df) if gaps and ROW in df.columns and not df.isStreaming else df

    def trace(self, df: DataFrame, sources: dict[str, DataFrame] | None = None, counts: bool = False) -> list[dict]:
        """Columns after each step, and rows when asked for (one job a step).

        Stops at the first step that fails and reports its message.
        """
        report = []
        for k in range(1, len(self.steps) + 1):
            entry: dict[str, Any] = {"index": k, "operation": self.steps[k - 1].operation}
            try:
                out = self.upto(k).apply(df, sources)
                entry.update(status="applied", columns=len(data_columns(out)))
                if counts:
                    entry["rows"] = out.count()
            except ParameterError as err:
                report.append({**entry, "status": "failed", "error": str(err)})
                break
            report.append(entry)
        return report

    def dry_run(self, df: DataFrame, sample_rows: int = DRY_RUN_ROWS[1], sources=None) -> dict[str, Any]:
        """Run on the first rows only and return a preview."""
        least, _, most = DRY_RUN_ROWS
        sample = head(df, max(least, min(most, int(sample_rows))))
        report = self.trace(sample, sources, counts=True)
        done = sum(r["status"] == "applied" for r in report)
        out = self.upto(done).apply(sample, sources)
        ordered = out.orderBy(ROW) if ROW in out.columns else out
        return {"steps": report, "preview": [r.asDict() for r in ordered.limit(PREVIEW_ROWS).collect()]}

    def validate(self, df: DataFrame, sources: dict[str, DataFrame] | None = None) -> list[str]:
        """Problems of the plan, each step checked against the columns that the
        steps before it produce. Only names and required parameters are
        checked; no step runs a job."""
        errors: list[str] = []
        if not self.steps:
            return ["the plan has no steps"]
        known = set(df.columns)
        open_ended = False
        for i, step in enumerate(self.steps, 1):
            if step.operation not in OPERATIONS:
                errors.append(f"step {i}: unknown operation {step.operation!r}")
                open_ended = True
                continue
            op = OPERATIONS[step.operation]
            for p in op.parameters()[0]:
                v = step.params.get(p)
                if v is None or (isinstance(v, str) and not v.strip()):
                    errors.append(f"step {i}: parameter {p!r} is required")
            if not open_ended:
                for c in _mentioned(step):
                    if c not in known:
                        errors.append(f"step {i}: column {c!r} is not in the table")
            if op.name == "merge_datasets":
                errors += _table_errors(i, step.params, sources or {})
            known, changed = _columns_after(step, known, sources or {})
            open_ended = open_ended or changed
        return errors

    def enrich(self, df: DataFrame, instruction: str = "") -> "Recipe":
        """Correct loosely spelled columns; fill in a missing ``column`` when
        the instruction mentions exactly one."""
        columns = data_columns(df)
        marked = [resolve_column(m, columns) for m in re.findall(r"#([A-Za-z0-9_]+)", instruction or "")]
        marked = list(dict.fromkeys(c for c in marked if c))
        steps = []
        for step in self.steps:
            params = dict(step.params)
            for k in _ONE_COLUMN:
                if isinstance(params.get(k), str):
                    params[k] = resolve_column(params[k], columns) or params[k]
            for k in _COLUMN_LISTS:
                if isinstance(params.get(k), list):
                    params[k] = [resolve_column(c, columns) or c if isinstance(c, str) else c for c in params[k]]
            op = OPERATIONS.get(step.operation)
            if op and "column" in op.parameters()[0] and not str(params.get("column") or "").strip():
                words = f"{instruction or ''} {step.description}"
                hits = marked if len(marked) == 1 else columns_in_text(words, columns)
                if len(hits) == 1:
                    params["column"] = hits[0]
                if op.name == "normalize_text_case" and params.get("case") not in {"lower", "upper", "title"}:
                    guess = _case_in_text(words)
                    if guess:
                        params["case"] = guess
            steps.append(replace(step, params=params))
        return replace(self, steps=tuple(steps))


def _case_in_text(words: str) -> str | None:
    low = words.lower()
    for case in ("upper", "title", "lower"):
        if re.search(rf"{case} ?case|to {case}", low):
            return case
    return "title" if re.search(r"capitali[sz]e", low) else None


def _unmark(value: Any) -> Any:
    if isinstance(value, list):
        return [_unmark(v) for v in value]
    return value[1:] if isinstance(value, str) and value.startswith("#") else value


def _name_token(name: str) -> str:
    return re.sub(r"[^a-z0-9_.-]", "", str(name).strip().lower().replace(" ", "_"))


def _resolve_tables(params: dict[str, Any], datasets: dict[str, str]) -> dict[str, Any]:
    names = {}
    for name, table in datasets.items():
        for spelling in (table, name, re.sub(r"\.[^.]*$", "", name)):
            names.setdefault(_name_token(spelling), table)
    out = dict(params)
    one = out.pop("source_dataset_ref", None)
    if one and not out.get("source_dataset_id") and _name_token(one) in names:
        out["source_dataset_id"] = names[_name_token(one)]
    many = out.pop("source_dataset_refs", None)
    if isinstance(many, list) and not out.get("source_dataset_ids"):
        found = [names[_name_token(m)] for m in many if _name_token(m) in names]
        if found:
            out["source_dataset_ids"] = found
    return out


def _mentioned(step: Step) -> list[str]:
    out = [step.params[k] for k in _ONE_COLUMN if isinstance(step.params.get(k), str) and step.params[k].strip()]
    for k in _COLUMN_LISTS:
        listed = step.params.get(k)
        if isinstance(listed, list) and not (k == "columns" and step.operation == "delete_columns"):
            out += [c for c in listed if isinstance(c, str) and c.strip()]
    return out


def _table_errors(i: int, params: dict[str, Any], sources: dict[str, DataFrame]) -> list[str]:
    mode = str(params.get("mode") or "append").lower()
    if mode not in {"append", "join_on_keys"}:
        return [f"step {i}: mode must be append or join_on_keys"]
    ids = [*(params.get("source_dataset_ids") or []), *([params["source_dataset_id"]] if params.get("source_dataset_id") else [])]
    if not ids:
        return [f"step {i}: a source table is required"]
    out = [f"step {i}: unknown source table {t!r}" for t in ids if t not in sources]
    if mode == "join_on_keys" and ids[0] in sources:
        have = sources[ids[0]].columns
        out += [f"step {i}: right key {k!r} is not in the source" for k in params.get("right_keys") or [] if k not in have]
    return out


def _columns_after(step: Step, known: set[str], sources: dict[str, DataFrame]) -> tuple[set[str], bool]:
    """Columns a step leaves, and whether some depend on the data."""
    p, op = step.params, step.operation
    out = set(known)
    if op == "group_aggregate":
        keys = p.get("group_by") or []
        keys = [k.strip() for k in keys.split(",")] if isinstance(keys, str) else keys
        made = [a.get("alias") or f"{a.get('column')}_{a.get('func')}" for a in p.get("aggregations") or []]
        return {*keys, *made}, False
    if op == "rename_column":
        out.discard(p.get("column"))
    if op == "delete_columns":
        listed = p.get("columns") or []
        out -= {listed} if isinstance(listed, str) else set(listed)
    if op == "merge_datasets":
        for name in [*(p.get("source_dataset_ids") or []), p.get("source_dataset_id")]:
            if name in sources:
                out |= set(sources[name].columns)
        return out, True
    if p.get("new_name"):
        out.add(p["new_name"])
        return out, False
    makes_none = {
        "drop_duplicates", "sort_rows", "drop_missing_rows", "fill_missing", "replace_values", "trim_whitespace",
        "cast_column", "clip_values", "remove_outliers_iqr", "normalize_text_case", "delete_rows",
        "delete_rows_condition", "duplicate_rows", "add_row", "update_cells", "delete_columns", "rename_column",
    }
    return out, op not in makes_none


class History:
    """Undo and redo by replaying a prefix of the steps over a base table.

    Nothing is stored per step. Beyond ``HISTORY_DEPTH`` steps the oldest are
    folded into the base, which is then written once so that plans stay short.
    """

    def __init__(self, base: DataFrame, sources: dict[str, DataFrame] | None = None, depth: int = HISTORY_DEPTH):
        self.base, self.sources, self.depth = base, sources, depth
        self.steps: list[Step] = []
        self.cursor = 0
        self.marks: dict[str, int] = {}

    def current(self) -> DataFrame:
        return Recipe(tuple(self.steps[: self.cursor])).apply(self.base, self.sources)

    def do(self, op: str, **params: Any) -> DataFrame:
        step = Step(operation(op).name, params)
        out = Recipe((*self.steps[: self.cursor], step)).apply(self.base, self.sources)
        self.steps = [*self.steps[: self.cursor], step]
        self.cursor += 1
        self.marks = {m: at for m, at in self.marks.items() if at < self.cursor}
        if len(self.steps) > self.depth:
            self._fold(len(self.steps) - self.depth)
        return out

    def _fold(self, count: int) -> None:
        self.base = materialize(Recipe(tuple(self.steps[:count])).apply(self.base, self.sources))
        self.steps = self.steps[count:]
        self.cursor -= count
        self.marks = {m: at - count for m, at in self.marks.items() if at >= count}

    def undo(self) -> DataFrame:
        if not self.cursor:
            raise ParameterError("nothing to undo")
        self.cursor -= 1
        return self.current()

    def redo(self) -> DataFrame:
        if self.cursor >= len(self.steps):
            raise ParameterError("nothing to redo")
        self.cursor += 1
        return self.current()

    def checkpoint(self, name: str) -> None:
        self.marks[name] = self.cursor

    def restore(self, name: str) -> DataFrame:
        if name not in self.marks:
            raise ParameterError(f"no checkpoint {name!r}")
        self.cursor = self.marks[name]
        return self.current()
