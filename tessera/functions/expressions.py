"""Python expressions as Spark columns: expression strings and traced lambdas, with Python's arithmetic.

Both become trees of ``Node``; nothing is evaluated by ``eval``.  A traced lambda may branch:
every truth test of a traced value forks the trace, so builtin min, max and conditional
expressions work.
"""

from __future__ import annotations

import ast
import math
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

BINARY = {ast.Add: "+", ast.Sub: "-", ast.Mult: "*", ast.Div: "/", ast.FloorDiv: "//", ast.Mod: "%", ast.Pow: "**"}
COMPARE = {ast.Eq: "==", ast.NotEq: "!=", ast.Lt: "<", ast.LtE: "<=", ast.Gt: ">", ast.GtE: ">="}
MATH = ["sqrt", "exp", "log", "log2", "log10", "floor", "ceil", "sin", "cos", "tan", "asin", "acos", "atan", "atan2", "sinh", "cosh", "tanh", "pow", "hypot", "degrees", "radians", "fabs"]
MAX_BRANCHES = 12


class ExpressionError(ValueError):
    pass


class Forks:
    """The branches that a trace has taken, and those that it is to take."""

    now: Forks | None = None

    def __init__(self, path: list[bool]):
        self.path, self.conditions = path, []

    def choose(self, condition: Node) -> bool:
        k = len(self.conditions)
        if k >= MAX_BRANCHES:
            raise ExpressionError("too many branches")
        self.conditions.append(condition)
        if k == len(self.path):
            self.path.append(True)
        return self.path[k]


@dataclass(frozen=True, eq=False)
class Node:
    """op: lit, name, item, call, a binary or comparison operator, and, or, not, if, tuple, neg."""

    op: str
    args: tuple

    def __bool__(self):
        if Forks.now is None:
            raise ExpressionError("a traced value has no truth value here")
        return Forks.now.choose(self)

    def __getitem__(self, key):
        return self.args[key] if self.op == "tuple" else Node("item", (self, key))

    def __iter__(self):
        if self.op != "tuple":
            raise ExpressionError("a traced value cannot be iterated")
        return iter(self.args)

    def __hash__(self):
        return id(self)

    def key(self) -> str:
        return f"{self.op}({', '.join(a.key() if isinstance(a, Node) else repr(a) for a in self.args)})"


def node(x: Any) -> Node:
    if isinstance(x, Node):
        return x
    if isinstance(x, (tuple, list)):
        return Node("tuple", tuple(map(node, x)))
    if x is None or isinstance(x, (bool, int, float, str)):
        return Node("lit", (x,))
    raise ExpressionError(f"cannot use {x!r} in an expression")


def _binary(op: str):
    def left(self, other):
        return Node(op, (self, node(other)))

    def right(self, other):
        return Node(op, (node(other), self))

    return left, right


for _name, _op in (("add", "+"), ("sub", "-"), ("mul", "*"), ("truediv", "/"), ("floordiv", "//"), ("mod", "%"), ("pow", "**"), ("and", "and"), ("or", "or")):
    _l, _r = _binary(_op)
    setattr(Node, f"__{_name}__", _l)
    setattr(Node, f"__r{_name}__", _r)
for _name, _op in (("eq", "=="), ("ne", "!="), ("lt", "<"), ("le", "<="), ("gt", ">"), ("ge", ">=")):
    setattr(Node, f"__{_name}__", _binary(_op)[0])
Node.__neg__ = lambda self: Node("neg", (self,))
Node.__pos__ = lambda self: self
Node.__abs__ = lambda self: Node("call", ("abs", self))
Node.__invert__ = lambda self: Node("not", (self,))
Node.__round__ = lambda self, digits=0: Node("call", ("round", self, node(digits or 0)))


class RowProxy:
    """Stands for a row in a traced lambda: attributes are columns."""

    def __init__(self, at: Node | None = None):
        self._at = at

    def __getattr__(self, name: str) -> Node:
        if name.startswith("__"):
            raise AttributeError(name)
        return Node("name", (name,)) if self._at is None else Node("item", (self._at, name))


def trace(function: Callable, *args) -> Node:
    """The tree of a function of traced values; its branches become conditional expressions."""

    def run(path: list[bool]) -> Node:
        forks, outer = Forks(list(path)), Forks.now
        Forks.now = forks
        try:
            result = node(function(*args))
        finally:
            Forks.now = outer
        for k in range(len(forks.conditions) - 1, len(path) - 1, -1):
            result = Node("if", (forks.conditions[k], result, run([*forks.path[:k], False])))
        return result

    return run([])


def parse(text: str) -> Node:
    """The tree of a Python expression string."""
    try:
        tree = ast.parse(text.strip(), mode="eval").body
    except SyntaxError as e:
        raise ExpressionError(f"not an expression: {text!r}") from e
    return _convert(tree)


def unparse(text: str) -> str:
    """An expression string in one form of spacing and brackets."""
    return ast.unparse(ast.parse(text.strip(), mode="eval"))


def _convert(t: ast.AST) -> Node:
    if isinstance(t, ast.Constant):
        return node(t.value)
    if isinstance(t, ast.Name):
        return Node("lit", ({"True": True, "False": False, "None": None}[t.id],)) if t.id in ("True", "False", "None") else Node("name", (t.id,))
    if isinstance(t, ast.BinOp) and type(t.op) in BINARY:
        return Node(BINARY[type(t.op)], (_convert(t.left), _convert(t.right)))
    if isinstance(t, ast.UnaryOp):
        inner = _convert(t.operand)
        return {ast.USub: Node("neg", (inner,)), ast.UAdd: inner, ast.Not: Node("not", (inner,))}[type(t.op)]
    if isinstance(t, ast.BoolOp):
        return _join("and" if isinstance(t.op, ast.And) else "or", [_convert(v) for v in t.values])
    if isinstance(t, ast.Compare):
        sides = [t.left, *t.comparators]
        return _join("and", [_compare(op, a, b) for op, a, b in zip(t.ops, sides, sides[1:], strict=False)])
    if isinstance(t, ast.IfExp):
        return Node("if", (_convert(t.test), _convert(t.body), _convert(t.orelse)))
    if isinstance(t, ast.Tuple):
        return Node("tuple", tuple(map(_convert, t.elts)))
    if isinstance(t, ast.Call) and not t.keywords:
        name = t.func.id if isinstance(t.func, ast.Name) else f"math.{t.func.attr}" if isinstance(t.func, ast.Attribute) and isinstance(t.func.value, ast.Name) and t.func.value.id == "math" else None
        if name:
            return Node("call", (name.removeprefix("math."), *map(_convert, t.args)))
    if isinstance(t, ast.Attribute) and isinstance(t.value, ast.Name) and t.value.id == "math" and t.attr in ("pi", "e", "inf", "nan"):
        return node(getattr(math, t.attr))
    raise ExpressionError(f"unsupported: {ast.unparse(t)}")


def _compare(op: ast.cmpop, left: ast.AST, right: ast.AST) -> Node:
    if isinstance(op, (ast.In, ast.NotIn)):
        if not isinstance(right, (ast.Tuple, ast.List, ast.Set)):
            raise ExpressionError("in needs a literal list")
        value = _convert(left)
        found = _join("or", [Node("==", (value, _convert(e))) for e in right.elts]) if right.elts else node(False)
        return Node("not", (found,)) if isinstance(op, ast.NotIn) else found
    if type(op) not in COMPARE:
        raise ExpressionError("unsupported comparison")
    return Node(COMPARE[type(op)], (_convert(left), _convert(right)))


def _join(op: str, parts: list[Node]) -> Node:
    out = parts[0]
    for p in parts[1:]:
        out = Node(op, (out, p))
    return out


def names(tree: Node) -> set[str]:
    """Attributes that an expression reads."""
    if tree.op == "name":
        return {tree.args[0]}
    return set().union(*(names(a) for a in tree.args if isinstance(a, Node)), set())


def conjuncts(tree: Node) -> list[Node]:
    """The parts of a top-level conjunction."""
    return [x for a in tree.args for x in conjuncts(a)] if tree.op == "and" else [tree]


def is_attribute(tree: Node) -> bool:
    return tree.op == "name"


def _mod(a: Column, b: Column, divisor: Node) -> Column:
    if divisor.op == "lit" and isinstance(divisor.args[0], (int, float)) and divisor.args[0] > 0:
        return F.pmod(a, b)
    return ((a % b) + b) % b  # the sign of the divisor, as in Python


BOOLEAN = {"==", "!=", "<", "<=", ">", ">=", "and", "or", "not"}


def kind_of(c: Column, tree: Node, resolve: Callable) -> T.DataType | None:
    """The type of a column, where resolve comes with a relation that can tell it."""
    if tree.op in BOOLEAN:
        return T.BooleanType()
    kind = getattr(resolve, "kind", None)
    return kind(c) if kind else None


def truth(c: Column, kind: T.DataType | None = None) -> Column:
    """Booleans as they are; numbers are true unless zero, strings unless empty."""
    if isinstance(kind, T.BooleanType):
        return c
    if isinstance(kind, T.StringType):
        return F.length(c) > 0
    return c.cast("boolean") if kind is None else c != 0


def floor_quotient(a: Column, b: Column, whole: bool) -> Column:
    """a // b; whole numbers are divided as such, whatever their size."""
    if not whole:
        return F.floor(a / b)
    quotient = F.call_function("div", a, b)
    return F.when((a % b != 0) & ((a < 0) != (b < 0)), quotient - 1).otherwise(quotient)


def power(a: Column, tree: Node, whole: bool) -> Column | None:
    """a ** b for a whole number and a small literal power, which stays whole; None for others."""
    exponent = tree.args[0] if tree.op == "lit" else None
    if not (whole and isinstance(exponent, int) and not isinstance(exponent, bool) and 0 <= exponent <= 64):
        return None
    out, square = F.lit(1).cast("long"), a.cast("long")
    while exponent:
        if exponent & 1:
            out = out * square
        exponent >>= 1
        if exponent:
            square = square * square
    return out


CALLS: dict[str, Callable[..., Column]] = {
    "abs": F.abs,
    "len": F.length,
    "str": lambda x: x.cast("string"),
    "float": lambda x: x.cast("double"),
    "int": lambda x: F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x)).cast("long"),
    "hash": lambda *x: F.xxhash64(*x),
    "min": lambda *x: F.least(*x),
    "max": lambda *x: F.greatest(*x),
    "fabs": F.abs,
} | {m: getattr(F, m) for m in MATH if hasattr(F, m)}
OPERATORS: dict[str, Callable[[Column, Column], Column]] = {
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "*": lambda a, b: a * b,
    "/": lambda a, b: a.cast("double") / b.cast("double"),
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
}


def column(tree: Node, resolve: Callable[[str], Column]) -> Column:
    """The Spark column of a tree; resolve gives the column of a name, and by its attribute kind the type of a column."""
    c = lambda x: column(x, resolve)
    op, args = tree.op, tree.args

    def true(x: Node) -> Column:
        value = c(x)
        return truth(value, kind_of(value, x, resolve))

    def whole(*nodes: Node) -> bool:
        return all(isinstance(kind_of(c(x), x, resolve), T.IntegralType) for x in nodes)

    if op == "lit":
        return F.lit(args[0])
    if op == "name":
        return resolve(args[0])
    if op == "bound":
        return args[0]
    if op == "item":
        return c(args[0]).getField(args[1] if isinstance(args[1], str) else f"f{args[1]}")
    if op == "neg":
        return -c(args[0])
    if op == "not":
        return ~true(args[0])
    if op in ("and", "or"):
        a, b = map(true, args)
        return a & b if op == "and" else a | b
    if op == "if":
        return F.when(true(args[0]), c(args[1])).otherwise(c(args[2]))
    if op == "//":
        return floor_quotient(c(args[0]), c(args[1]), whole(*args))
    if op == "**":
        exact = power(c(args[0]), args[1], whole(args[0]))
        return F.pow(c(args[0]), c(args[1])) if exact is None else exact
    if op == "tuple":
        return F.struct(*[c(a).alias(f"f{k}") for k, a in enumerate(args)])
    if op == "%":
        return _mod(c(args[0]), c(args[1]), args[1])
    if op == "call":
        if args[0] == "round":
            digits = args[2].args[0] if len(args) > 2 else 0
            return F.bround(c(args[1]), digits)
        if args[0] == "bool":
            return true(args[1])
        if args[0] not in CALLS:
            raise ExpressionError(f"unknown function {args[0]}")
        return CALLS[args[0]](*map(c, args[1:]))
    if op in OPERATORS:
        return OPERATORS[op](c(args[0]), c(args[1]))
    raise ExpressionError(f"unsupported {op}")
