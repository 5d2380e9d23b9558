"""Restricted arithmetic expressions over columns.

The grammar is Python's, limited to numbers, names, ``+ - * / // % **``, unary signs
and a fixed list of functions.  The text becomes one Column, so Catalyst folds
constants and prunes columns; nothing of it runs in Python.
"""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

_FUNCTIONS: dict[str, tuple[int, Callable[..., Column]]] = {
    "abs": (1, F.abs),
    "sqrt": (1, F.sqrt),
    "square": (1, lambda x: x * x),
    "log": (1, F.ln),
    "log10": (1, F.log10),
    "exp": (1, F.exp),
    "minimum": (2, F.least),
    "maximum": (2, F.greatest),
    "clip": (3, lambda x, low, high: F.least(F.greatest(x, low), high)),
}


def _floor_div(a: Column, b: Column) -> Column:
    return F.floor(F.try_divide(a, b)).cast("double")


_OPERATORS: dict[type, Callable[[Column, Column], Column]] = {
    ast.Add: lambda a, b: a + b,
    ast.Sub: lambda a, b: a - b,
    ast.Mult: lambda a, b: a * b,
    ast.Div: F.try_divide,
    ast.FloorDiv: _floor_div,
    # the remainder has the divisor's sign
    ast.Mod: lambda a, b: a - _floor_div(a, b) * b,
    ast.Pow: F.pow,
}


def compile_expression(text: str, columns: Iterable[str]) -> Column:
    """The Column of an expression over the named columns, all read as doubles.

    Division by zero and roots or logarithms outside their domain give null.  Unknown
    names, functions and syntax raise ValueError.
    """
    known = set(columns)

    def build(node: ast.AST) -> Column:
        if isinstance(node, ast.Expression):
            return build(node.body)
        if isinstance(node, ast.Constant) and isinstance(node.value, int | float) and not isinstance(node.value, bool):
            return F.lit(float(node.value))
        if isinstance(node, ast.Name) and node.id in known:
            return F.col(f"`{node.id}`").cast("double")
        if isinstance(node, ast.BinOp) and type(node.op) in _OPERATORS:
            return _OPERATORS[type(node.op)](build(node.left), build(node.right))
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub | ast.UAdd):
            return -build(node.operand) if isinstance(node.op, ast.USub) else build(node.operand)
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in _FUNCTIONS and not node.keywords:
            arity, function = _FUNCTIONS[node.func.id]
            if len(node.args) == arity:
                return function(*map(build, node.args))
        raise ValueError(f"not allowed in an expression: {ast.unparse(node) if not isinstance(node, ast.Expression) else text}")

    try:
        return build(ast.parse(text, mode="eval"))
    except SyntaxError as error:
        raise ValueError(f"not an expression: {text}") from error
