"""Trees to Catalyst columns and to numpy functions, under IEEE rules on both sides.

Spark's ANSI arithmetic raises where IEEE has an infinity or NaN, and ``ln`` gives null outside its domain; the columns made here
give the IEEE value. Where a complex number would come out, both sides give NaN.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from fitloom.functions import scalars
from fitloom.functions.expr import CONSTANTS, FormulaError, Name, Node, Num, Op

NAN, INF = float("nan"), float("inf")


def _log(x: Column, fn: Callable[[Column], Column]) -> Column:
    return F.when(x > 0, fn(x)).when(x == 0, F.lit(-INF)).otherwise(F.lit(NAN))


COLUMN_FUNCTIONS: dict[str, Callable[..., Column]] = {
    "sqrt": F.sqrt, "exp": F.exp, "log": lambda x: _log(x, F.ln), "log10": lambda x: _log(x, F.log10), "sin": F.sin, "cos": F.cos, "tan": F.tan,
    "asin": F.asin, "acos": F.acos, "atan": F.atan, "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh, "asinh": F.asinh, "acosh": F.acosh, "atanh": F.atanh,
    "abs": F.abs, "sign": F.signum, "mod": scalars.floor_mod, "ppow": scalars.protected_power,
}
NUMPY_FUNCTIONS: dict[str, Callable] = {
    "sqrt": np.sqrt, "exp": np.exp, "log": np.log, "log10": np.log10, "sin": np.sin, "cos": np.cos, "tan": np.tan, "asin": np.arcsin, "acos": np.arccos, "atan": np.arctan,
    "sinh": np.sinh, "cosh": np.cosh, "tanh": np.tanh, "asinh": np.arcsinh, "acosh": np.arccosh, "atanh": np.arctanh, "abs": np.abs, "sign": np.sign, "mod": np.mod,
    "ppow": scalars.protected_power_numpy, "+": np.add, "-": np.subtract, "*": np.multiply, "/": np.divide, "**": np.power, "neg": np.negative,
}


def divide(a: Column, b: Column) -> Column:
    """IEEE division."""
    by_zero = F.when((a == 0) | F.isnan(a), F.lit(NAN)).otherwise(F.when(a > 0, F.lit(INF)).otherwise(F.lit(-INF)))
    return F.when(b == 0, by_zero).otherwise(a / F.when(b != 0, b))


def resolve(name: str, *scopes: dict) -> object:
    """Later scopes win: built-in constants, then sheet constants, parameters, variables."""
    for scope in reversed(scopes):
        if name in scope:
            return scope[name]
    raise FormulaError(f"unknown name {name}")


def to_column(tree: Node, variables: dict[str, Column], parameters: dict[str, Column | float] | None = None, constants: dict[str, float] | None = None) -> Column:
    """One expression that stays inside whole-stage code generation."""

    def go(n: Node) -> Column:
        if isinstance(n, Num):
            return F.lit(n.value)
        if isinstance(n, Name):
            found = resolve(n.id, CONSTANTS, constants or {}, parameters or {}, variables)
            return found if isinstance(found, Column) else F.lit(float(found))
        a = [go(x) for x in n.args]
        if n.kind == "neg":
            return -a[0]
        if n.kind == "+":
            return a[0] + a[1]
        if n.kind == "-":
            return a[0] - a[1]
        if n.kind == "*":
            return a[0] * a[1]
        if n.kind == "/":
            return divide(a[0], a[1])
        if n.kind == "**":
            return F.pow(a[0], a[1])
        return COLUMN_FUNCTIONS[n.kind](*a)

    return go(tree)


def to_numpy(tree: Node, order: list[str], constants: dict[str, float] | None = None) -> Callable[..., np.ndarray]:
    """A function of arrays or scalars in the given order of names; NaN where the real value doesn't exist."""
    place = {n: i for i, n in enumerate(order)}
    fixed = CONSTANTS | (constants or {})

    def build(n: Node) -> Callable[[tuple], object]:
        if isinstance(n, Num):
            return lambda _, v=n.value: v
        if isinstance(n, Name):
            if n.id in place:
                return lambda x, i=place[n.id]: x[i]
            if n.id in fixed:
                return lambda _, v=fixed[n.id]: v
            raise FormulaError(f"unknown name {n.id}")
        args = [build(a) for a in n.args]
        fn = NUMPY_FUNCTIONS[n.kind]
        if len(args) == 1:
            return lambda x, a=args[0]: fn(a(x))
        return lambda x, a=args[0], b=args[1]: fn(np.asarray(a(x), float), b(x)) if fn is np.power else fn(a(x), b(x))

    body = build(tree)

    def call(*values: object) -> np.ndarray:
        with np.errstate(all="ignore"):
            return np.asarray(body(values), float)

    return call


def _simple(kind: str, a: Node, b: Node) -> Node:
    """Operators with the zeros and ones of derivatives folded away."""
    zero, one = (lambda n: isinstance(n, Num) and n.value == 0), (lambda n: isinstance(n, Num) and n.value == 1)
    if kind == "+":
        return b if zero(a) else a if zero(b) else Op("+", (a, b))
    if kind == "-":
        return a if zero(b) else Op("neg", (b,)) if zero(a) else Op("-", (a, b))
    if kind == "*":
        return Num(0.0) if zero(a) or zero(b) else b if one(a) else a if one(b) else Op("*", (a, b))
    return Num(0.0) if zero(a) else a if one(b) else Op("/", (a, b))


def derivative(n: Node, by: str) -> Node | None:
    """The derivative's tree; None where a function has none that is used here."""
    if isinstance(n, Num):
        return Num(0.0)
    if isinstance(n, Name):
        return Num(1.0 if n.id == by else 0.0)
    if all(not any(isinstance(m, Name) and m.id == by for m in _nodes(a)) for a in n.args):
        return Num(0.0)
    d = [derivative(a, by) for a in n.args]
    if any(x is None for x in d):
        return None
    f = n.args[0]
    one = Num(1.0)
    square = lambda x: Op("*", (x, x))
    if n.kind in ("+", "-"):
        return _simple(n.kind, d[0], d[1])
    if n.kind == "neg":
        return Op("neg", (d[0],))
    if n.kind == "*":
        return _simple("+", _simple("*", d[0], n.args[1]), _simple("*", f, d[1]))
    if n.kind == "/":
        return _simple("-", _simple("/", d[0], n.args[1]), _simple("/", _simple("*", f, d[1]), square(n.args[1])))
    if n.kind == "**":
        g = n.args[1]
        by_base = _simple("*", _simple("*", g, Op("**", (f, _simple("-", g, one)))), d[0])
        by_exponent = _simple("*", _simple("*", n, Op("log", (f,))), d[1])
        return _simple("+", by_base, by_exponent)
    outer = {
        "sqrt": lambda: Op("/", (Num(0.5), n)), "exp": lambda: n, "log": lambda: Op("/", (one, f)), "log10": lambda: Op("/", (Num(1 / math.log(10)), f)), "sin": lambda: Op("cos", (f,)),
        "cos": lambda: Op("neg", (Op("sin", (f,)),)), "tan": lambda: Op("+", (one, square(n))), "asin": lambda: Op("/", (one, Op("sqrt", (Op("-", (one, square(f))),)))),
        "acos": lambda: Op("/", (Num(-1.0), Op("sqrt", (Op("-", (one, square(f))),)))), "atan": lambda: Op("/", (one, Op("+", (one, square(f))))), "sinh": lambda: Op("cosh", (f,)),
        "cosh": lambda: Op("sinh", (f,)), "tanh": lambda: Op("-", (one, square(n))), "atanh": lambda: Op("/", (one, Op("-", (one, square(f))))),
        "asinh": lambda: Op("/", (one, Op("sqrt", (Op("+", (square(f), one)),)))), "acosh": lambda: Op("/", (one, Op("sqrt", (Op("-", (square(f), one)),)))), "abs": lambda: Op("sign", (f,)),
    }.get(n.kind)
    return _simple("*", outer(), d[0]) if outer else None


def _nodes(n: Node):
    yield n
    if isinstance(n, Op):
        for a in n.args:
            yield from _nodes(a)


def linear_in(tree: Node, parameters: list[str]) -> list[Node] | None:
    """(constant part, factor of each parameter) if the tree is linear in the parameters; else None."""
    parts = []
    for p in parameters:
        d = derivative(tree, p)
        if d is None or any(isinstance(m, Name) and m.id in parameters for m in _nodes(d)):
            return None
        parts.append(d)

    def drop(n: Node) -> Node:
        return Num(0.0) if isinstance(n, Name) and n.id in parameters else Op(n.kind, tuple(drop(a) for a in n.args)) if isinstance(n, Op) else n

    return [drop(tree), *parts]
