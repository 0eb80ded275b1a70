"""User formulas as Column expressions.

A formula such as ``price * (1 - discount) > 10 and flag == 'A'`` is read with
Python's own ``ast`` and every allowed node becomes the matching Column; there
is no ``eval``. Column names with blanks stand in backticks. Whole-column
reductions such as ``price.mean()`` are fitted in one aggregate beforehand.
"""

from __future__ import annotations

import ast
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.functions.guards import ParameterError, present, require_batch
from rowloom.functions.quantiles import exact_quantiles


def whole(rounding, c: Column) -> Column:
    """Floor or ceiling as a double; a double of 2**53 or more is whole already and may not fit a long."""
    c = c.cast("double")
    return F.when(F.abs(c) >= float(1 << 53), c).otherwise(rounding(c).cast("double"))


_ELEMENTWISE = {
    "sin": F.sin,
    "cos": F.cos,
    "tan": F.tan,
    "arcsin": F.asin,
    "arccos": F.acos,
    "arctan": F.atan,
    "sinh": F.sinh,
    "cosh": F.cosh,
    "tanh": F.tanh,
    "arcsinh": F.asinh,
    "arccosh": F.acosh,
    "arctanh": F.atanh,
    "exp": F.exp,
    "expm1": F.expm1,
    "log": lambda c: F.when(c > 0, F.log(c)),
    "log10": lambda c: F.when(c > 0, F.log10(c)),
    "log1p": lambda c: F.when(c > -1, F.log1p(c)),
    "sqrt": lambda c: F.when(c >= 0, F.sqrt(c)),
    "abs": F.abs,
    "floor": lambda c: whole(F.floor, c),
    "ceil": lambda c: whole(F.ceil, c),
    "arctan2": F.atan2,
}
_REDUCTIONS = {
    "mean": F.avg,
    "sum": lambda c: F.coalesce(F.sum(c), F.lit(0)),
    "min": F.min,
    "max": F.max,
    "std": F.stddev_samp,
    "var": F.var_samp,
    "count": F.count,
    "nunique": F.count_distinct,
    "median": None,
}


class _Formula:
    def __init__(self, df: DataFrame, names: dict[str, str]):
        self.df = df
        self.names = names

    def column_name(self, node: ast.AST) -> str:
        if not isinstance(node, ast.Name):
            raise ParameterError("a reduction needs a plain column")
        name = self.names.get(node.id, node.id)
        if name not in self.df.columns:
            raise ParameterError(f"unknown name {name!r} in formula")
        return name

    def build(self, node: ast.AST) -> Column:
        handler = getattr(self, "on_" + type(node).__name__.lower(), None)
        if handler is None:
            raise ParameterError(f"{type(node).__name__} is not allowed in a formula")
        return handler(node)

    def on_expression(self, node: ast.Expression) -> Column:
        return self.build(node.body)

    def on_constant(self, node: ast.Constant) -> Column:
        if not isinstance(node.value, (int, float, str, bool)):
            raise ParameterError("only numbers, texts and booleans are constants")
        return F.lit(node.value)

    def on_name(self, node: ast.Name) -> Column:
        return present(self.df, self.column_name(node))

    def on_unaryop(self, node: ast.UnaryOp) -> Column:
        c = self.build(node.operand)
        if isinstance(node.op, (ast.Not, ast.Invert)):
            return ~c
        return -c if isinstance(node.op, ast.USub) else c

    def on_boolop(self, node: ast.BoolOp) -> Column:
        out = self.build(node.values[0])
        for part in node.values[1:]:
            other = self.build(part)
            out = out & other if isinstance(node.op, ast.And) else out | other
        return out

    def on_binop(self, node: ast.BinOp) -> Column:
        a, b = self.build(node.left), self.build(node.right)
        op = type(node.op)
        if op is ast.Add:
            both = self.df.select(a.alias("a"), b.alias("b")).schema.fields
            return F.concat(a, b) if all(f.dataType.typeName() == "string" for f in both) else a + b
        if op is ast.Sub:
            return a - b
        if op is ast.Mult:
            return a * b
        if op is ast.Div:
            return F.try_divide(a.cast("double"), b.cast("double"))
        if op is ast.FloorDiv:
            return whole(F.floor, F.try_divide(a.cast("double"), b.cast("double")))
        if op is ast.Mod:
            x, y = a.cast("double"), b.cast("double")
            return x - y * whole(F.floor, F.try_divide(x, y))
        if op is ast.Pow:
            return F.pow(a.cast("double"), b.cast("double"))
        if op is ast.BitAnd:
            return a & b
        if op is ast.BitOr:
            return a | b
        raise ParameterError(f"operator {op.__name__} is not allowed")

    def on_compare(self, node: ast.Compare) -> Column:
        out, left = None, node.left
        for op, right in zip(node.ops, node.comparators):
            if isinstance(op, (ast.In, ast.NotIn)):
                if not isinstance(right, (ast.List, ast.Tuple)):
                    raise ParameterError("'in' needs a list")
                hit = F.coalesce(self.build(left).isin([self.build(e) for e in right.elts]), F.lit(False))
                part = ~hit if isinstance(op, ast.NotIn) else hit
            else:
                part = self.compared(self.build(left), op, self.build(right))
            out, left = (part if out is None else out & part), right
        return out

    @staticmethod
    def compared(a: Column, op: ast.cmpop, b: Column) -> Column:
        table = {
            ast.Eq: a == b,
            ast.NotEq: a != b,
            ast.Lt: a < b,
            ast.LtE: a <= b,
            ast.Gt: a > b,
            ast.GtE: a >= b,
        }
        if type(op) not in table:
            raise ParameterError("comparison not allowed")
        return F.coalesce(table[type(op)], F.lit(isinstance(op, ast.NotEq)))

    def on_call(self, node: ast.Call) -> Column:
        if node.keywords:
            raise ParameterError("named arguments are not allowed")
        if isinstance(node.func, ast.Name) and node.func.id in _ELEMENTWISE:
            return _ELEMENTWISE[node.func.id](*[self.build(a).cast("double") for a in node.args])
        if isinstance(node.func, ast.Attribute) and not node.args and node.func.attr in _REDUCTIONS:
            return self.reduced(self.column_name(node.func.value), node.func.attr)
        raise ParameterError("this function is not allowed in a formula")

    def reduced(self, name: str, how: str) -> Column:
        require_batch(self.df, f"{how}() in a formula")
        if how == "median":
            return F.lit(exact_quantiles(self.df, [name], [0.5])[name][0])
        value = self.df.agg(_REDUCTIONS[how](present(self.df, name)).alias("r")).first()["r"]
        return F.lit(value)


def formula(df: DataFrame, expression: str) -> Column:
    names: dict[str, str] = {}

    def shelve(match: re.Match) -> str:
        key = f"__bt{len(names)}"
        names[key] = match.group(1)
        return key

    source = re.sub(r"`([^`]+)`", shelve, str(expression).strip())
    if not source:
        raise ParameterError("expression is empty")
    try:
        tree = ast.parse(source, mode="eval")
    except SyntaxError as err:
        raise ParameterError(f"cannot read formula: {err.msg}") from err
    return _Formula(df, names).build(tree)
