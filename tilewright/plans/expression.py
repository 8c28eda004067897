"""A small expression language over sequences, compiled to Catalyst columns.

Literals (text, whole numbers), dotted names (``target_parts['x']`` too), subscripts and slices, ``+`` on two texts or two numbers, ``%`` on two
numbers, unary minus and ``rc()``. Names are looked up in a scope of columns; ``encoding[...][...]`` is looked up in a
nested mapping by literals. What cannot be computed for a row (index out of range, unknown key) is null.
"""

from __future__ import annotations

import ast
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.sequence import reverse_complement


class ExpressionError(ValueError):
    pass


@dataclass(frozen=True)
class Typed:
    column: Column
    kind: str  # text or number


#: Names whose constant subscripts are dotted names: ``target_parts['left']`` is ``target_parts.left``.
RECORDS = ("target_parts",)


def _name(node: ast.AST) -> str | None:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute) and (head := _name(node.value)):
        return f"{head}.{node.attr}"
    if isinstance(node, ast.Subscript) and _name(node.value) in RECORDS and isinstance(node.slice, ast.Constant) and isinstance(node.slice.value, str):
        return f"{_name(node.value)}.{node.slice.value}"
    return None


def references(text: str) -> list[str]:
    """The names an expression reads, the longest dotted form of each, in order."""
    out: dict[str, None] = {}

    def walk(node: ast.AST) -> None:
        if n := _name(node):
            out[n] = None
            return
        for child in ast.iter_child_nodes(node):
            if not (isinstance(node, ast.Call) and child is node.func):
                walk(child)

    walk(_parsed(text).body)
    return list(out)


def _parsed(text: str) -> ast.Expression:
    try:
        return ast.parse(text.strip(), mode="eval")
    except SyntaxError as e:
        raise ExpressionError(f"not an expression: {text!r}") from e


def problems(text: str, names: set[str]) -> list[str]:
    """All that is wrong with an expression: forbidden constructs and unknown names."""
    out = []
    try:
        tree = _parsed(text)
    except ExpressionError as e:
        return [str(e)]
    allowed = (ast.Expression, ast.Constant, ast.Name, ast.Attribute, ast.Subscript, ast.Slice, ast.BinOp, ast.UnaryOp, ast.Call, ast.Load, ast.Add, ast.Mod, ast.USub)
    for node in ast.walk(tree):
        if not isinstance(node, allowed):
            out.append(f"{type(node).__name__} is not allowed")
        elif isinstance(node, ast.Constant) and (isinstance(node.value, bool) or not isinstance(node.value, (str, int))):
            out.append(f"literal {node.value!r} is not allowed")
        elif isinstance(node, ast.Call) and not (isinstance(node.func, ast.Name) and node.func.id == "rc" and len(node.args) == 1 and not node.keywords):
            out.append("only rc(x) may be called")
    return out + [f"unknown name {n!r}" for n in references(text) if not out and n not in names]


def compile_expression(text: str, scope: dict[str, Typed], mappings: dict[str, dict] | None = None) -> Typed:
    """The column of an expression. ``scope``: names; ``mappings``: nested dictionaries that may be subscripted."""
    maps = mappings or {}

    def number(node: ast.AST) -> Column:
        t = build(node)
        if not isinstance(t, Typed) or t.kind != "number":
            raise ExpressionError(f"a number is needed: {ast.unparse(node)}")
        return t.column

    def build(node: ast.AST) -> Typed | tuple:
        if isinstance(node, ast.Constant) and isinstance(node.value, str):
            return Typed(F.lit(node.value), "text")
        if isinstance(node, ast.Constant) and isinstance(node.value, int) and not isinstance(node.value, bool):
            return Typed(F.lit(node.value), "number")
        if (n := _name(node)) is not None:
            if n in scope:
                return scope[n]
            if n in maps:
                return ("map", maps[n], [])
            raise ExpressionError(f"unknown name {n!r}")
        if isinstance(node, ast.Subscript):
            value = build(node.value)
            if isinstance(value, tuple):
                return lookup(value, node.slice)
            if value.kind != "text":
                raise ExpressionError(f"cannot index a number: {ast.unparse(node)}")
            return Typed(sliced(value.column, node.slice) if isinstance(node.slice, ast.Slice) else at(value.column, number(node.slice)), "text")
        if isinstance(node, ast.BinOp) and isinstance(node.op, ast.Add):
            a, b = settle(build(node.left)), settle(build(node.right))
            if a.kind != b.kind:
                raise ExpressionError(f"cannot add {a.kind} and {b.kind}: {ast.unparse(node)}")
            return Typed(F.concat(a.column, b.column) if a.kind == "text" else a.column + b.column, a.kind)
        if isinstance(node, ast.BinOp) and isinstance(node.op, ast.Mod):
            a, b = number(node.left), number(node.right)
            rest = F.pmod(a, F.abs(b))  # the sign of the divisor, as in Python
            return Typed(F.when(b == 0, None).when((b < 0) & (rest != 0), rest + b).otherwise(rest), "number")
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
            return Typed(-number(node.operand), "number")
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id == "rc" and len(node.args) == 1 and not node.keywords:
            t = settle(build(node.args[0]))
            if t.kind != "text":
                raise ExpressionError("rc() takes a sequence")
            return Typed(reverse_complement(t.column), "text")
        raise ExpressionError(f"not allowed: {ast.unparse(node)}")

    def lookup(value: tuple, key: ast.AST) -> Typed | tuple:
        """Branches over the mapping's entries, each under the condition that its keys are met."""
        k = settle(build(key)).column
        entries = [(F.lit(True), value[1])] if not value[2] else value[2]
        new = [(cond & (k == F.lit(name)), v) for cond, d in entries for name, v in (d.items() if isinstance(d, dict) else enumerate(d) if isinstance(d, list) else [])]
        return ("map", None, new)

    def settle(t: Typed | tuple) -> Typed:
        if isinstance(t, Typed):
            return t
        out = F.lit(None).cast("string")
        kinds = set()
        for cond, v in t[2]:
            if isinstance(v, (str, int)):
                kinds.add("text" if isinstance(v, str) else "number")
                out = F.when(cond, F.lit(v)).otherwise(out)
        if len(kinds) > 1:
            raise ExpressionError("a mapping's values must be all text or all numbers")
        kind = kinds.pop() if kinds else "text"
        return Typed(out if kind == "text" else out.cast("int"), kind)

    def at(s: Column, i: Column) -> Column:
        n = F.length(s)
        return F.when((i < n) & (i >= -n), F.substring(s, F.when(i < 0, n + i + 1).otherwise(i + 1), F.lit(1)))

    def sliced(s: Column, sl: ast.Slice) -> Column:
        step = 1
        if sl.step is not None:
            value = ast.literal_eval(sl.step)
            if not isinstance(value, int) or value == 0:
                raise ExpressionError("a step must be a whole number other than 0")
            step = value
        n = F.length(s)

        def bound(node: ast.AST | None, default: Column, low: Column, high: Column) -> Column:
            if node is None:
                return default
            b = number(node)
            return F.least(F.greatest(F.when(b < 0, b + n).otherwise(b), low), high)

        if step > 0:
            a, b = bound(sl.lower, F.lit(0), F.lit(0), n), bound(sl.upper, n, F.lit(0), n)
        else:
            a, b = bound(sl.lower, n - 1, F.lit(-1), n - 1), bound(sl.upper, F.lit(-1), F.lit(-1), n - 1)
        if step == 1:
            return F.when(b > a, F.substring(s, a + 1, b - a)).when(s.isNotNull(), F.lit(""))
        last = b - 1 if step > 0 else b + 1
        places = F.sequence(a, last, F.lit(step))
        some = (a < b) if step > 0 else (a > b)
        return F.when(some, F.array_join(F.transform(places, lambda i: F.substring(s, i + 1, F.lit(1))), "")).when(s.isNotNull(), F.lit(""))

    return settle(build(_parsed(text).body))
