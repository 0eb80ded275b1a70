"""Recipes, history and the operation catalogue."""

import pytest
from pyspark.sql import functions as F

from rowloom.functions.guards import ParameterError
from rowloom.operators import joins
from rowloom.operators.ordering import with_row_index
from rowloom.plans.recipe import History, Recipe
from rowloom.plans.registry import OPERATIONS, catalogue, operation
from rowloom.plans.resolve import columns_in_text, resolve_column


@pytest.fixture(scope="module")
def orders(table):
    return with_row_index(table("orders"), ["o_orderkey"]).cache()


def test_catalogue_is_complete():
    names = {c["operation"] for c in catalogue()}
    assert len(names - {"update_cells"}) == 50
    by_name = {c["operation"]: c for c in catalogue()}
    assert by_name["rename_column"]["required_params"] == ["column", "new_name"]
    assert by_name["log_scaling"]["optional_params"][:1] == ["new_name"]
    assert all(c["description"] is not None for c in by_name.values())


def test_alias():
    assert operation("Zscore").name == "stats_zscore"
    with pytest.raises(ParameterError):
        operation("nothing")


def test_resolve():
    columns = ["User ID", "user_id2", "Value"]
    assert resolve_column("user id", columns) == "User ID"
    assert resolve_column("USERID", columns) == "User ID"
    assert resolve_column("other", columns) is None
    assert columns_in_text("clip the value please", columns) == ["Value"]
    assert columns_in_text("revalue", columns) == []


def test_index_closes_gaps(orders):
    plan = Recipe.of(
        ("delete_rows_condition", {"column": "o_orderstatus", "condition": "eq", "value": "O"}),
        ("shift_column", {"column": "o_orderkey", "shifts": 1, "new_name": "before"}),
    )
    out = plan.apply(orders).orderBy("_row_index").collect()
    assert [r["_row_index"] for r in out] == list(range(len(out)))
    assert [r["before"] for r in out[1:]] == [r["o_orderkey"] for r in out[:-1]]


def test_validate_sees_new_columns(orders):
    good = Recipe.of(
        ("derive_column", {"new_name": "x", "expression": "o_totalprice * 2"}),
        ("clip_values", {"column": "x", "min": 0}),
        ("group_aggregate", {"group_by": ["o_orderstatus"], "aggregations": [{"column": "x", "func": "sum"}]}),
        ("sort_rows", {"column": "x_sum"}),
    )
    assert good.validate(orders) == []
    assert good.apply(orders).count() == 3
    bad = Recipe.of(("clip_values", {"column": "nope"}), ("fly", {}), ("rename_column", {"column": "o_orderkey"}))
    errors = bad.validate(orders)
    assert len(errors) == 3 and "nope" in errors[0]
    assert Recipe(()).validate(orders) == ["the plan has no steps"]


def test_trace_stops_at_failure(orders):
    plan = Recipe.of(("trim_whitespace", {}), ("clip_values", {"column": "nope", "min": 1}), ("trim_whitespace", {}))
    report = plan.trace(orders, counts=True)
    assert [r["status"] for r in report] == ["applied", "failed"]
    assert report[0]["rows"] == orders.count()


def test_loose_plan_reads_tables(orders, table):
    nation = table("nation")
    plan = Recipe.from_dict(
        {"steps": [{"op": "merge_datasets", "params": {"mode": "append", "source_dataset_refs": ["#My Nations"]}}]},
        {"My Nations.csv": "t1"},
    )
    assert plan.steps[0].params == {"mode": "append", "source_dataset_ids": ["t1"]}
    out = plan.apply(table("region"), {"t1": nation})
    assert out.count() == 30
    again = Recipe.from_dict(plan.to_dict())
    assert again == plan


def test_join_step_keeps_order(orders, table):
    c = with_row_index(table("customer"), ["c_custkey"])
    plan = Recipe.of(
        ("merge_datasets", {"mode": "join_on_keys", "source_dataset_id": "c", "left_keys": ["o_custkey"], "right_keys": ["c_custkey"], "join_how": "left"})
    )
    out = plan.apply(orders, {"c": c}).orderBy("_row_index").collect()
    assert [r["_row_index"] for r in out] == list(range(len(out)))
    assert [r["o_orderkey"] for r in out] == sorted(r["o_orderkey"] for r in out)


def test_undo_redo_restore(orders):
    h = History(orders, depth=3)
    start = orders.count()
    h.do("delete_rows_condition", column="o_orderstatus", condition="eq", value="O")
    fewer = h.current().count()
    h.checkpoint("cut")
    h.do("derive_column", new_name="x", expression="o_totalprice + 1")
    assert h.undo().count() == fewer and "x" not in h.current().columns
    assert h.undo().count() == start
    with pytest.raises(ParameterError):
        h.undo()
    h.redo()
    assert h.current().count() == fewer
    h.do("derive_column", new_name="y", expression="o_totalprice + 1")
    with pytest.raises(ParameterError):
        h.redo()
    assert "y" not in h.restore("cut").columns
    h.redo()
    for name in ("a", "b", "c"):
        h.do("duplicate_column", column="y", new_name=name)
    assert len(h.steps) == 3
    assert {"a", "b", "c", "y"} <= set(h.current().columns) and h.current().count() == fewer


def test_patch_round_trip(orders):
    plan = Recipe.of(
        ("delete_rows", {"row_indices": [3, 4]}),
        ("math_scalar", {"column": "o_totalprice", "operator": "add", "value": 1}),
    )
    after = plan.apply(orders)
    changes = joins.diff(orders, after)
    back = joins.apply_patch(after, changes, "backward")
    assert back.exceptAll(orders.select(*back.columns)).count() == 0 and back.count() == orders.count()
    forth = joins.apply_patch(orders, changes)
    assert forth.exceptAll(after.select(*forth.columns)).count() == 0
    assert changes.groupBy("change").count().orderBy("change").collect()[1]["count"] == 2


def test_every_operation_has_a_name_and_runs_lazily(orders):
    assert all(OPERATIONS[n].name == n for n in OPERATIONS)
    out = Recipe.of(("derive_column", {"new_name": "x", "expression": "o_totalprice"})).apply(orders)
    assert out.filter(F.col("x").isNull()).count() == 0
