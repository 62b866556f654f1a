"""Fold aggregates: (initial, (accumulator, row) -> accumulator, accumulator -> result).

A traced fold that is a sum (also of some rows only), a count, a minimum or a maximum becomes the
built-in aggregate, with the seed taking part as in the fold; accumulators that are tuples are taken
apart.  Any other fold runs over the collected group inside the JVM, which holds a group in
memory and needs a step that does not depend on the order of rows.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.expressions import ExpressionError, Node, RowProxy, column, kind_of, names, trace, truth

ACC = "__acc__"


def depends(tree: Node, name: str) -> bool:
    return name in names(tree)


def added(step: Node, is_acc: Callable[[Node], bool], resolve: Callable[[str], Column]) -> Column | None:
    """What a step adds to its accumulator for a row, where all that it does is to add something or nothing."""
    if is_acc(step):
        return F.lit(0)
    if step.op in ("+", "-") and is_acc(step.args[0]) and not depends(step.args[1], ACC):
        value = column(step.args[1], resolve)
        return -value if step.op == "-" else value
    if step.op == "+" and is_acc(step.args[1]) and not depends(step.args[0], ACC):
        return column(step.args[0], resolve)
    if step.op == "+" and not depends(step.args[1], ACC):  # (acc + x) + y
        first = added(step.args[0], is_acc, resolve)
        return None if first is None else first + column(step.args[1], resolve)
    if step.op == "if" and not depends(step.args[0], ACC):
        yes, no = (added(x, is_acc, resolve) for x in step.args[1:])
        if yes is not None and no is not None:
            test = column(step.args[0], resolve)
            return F.when(truth(test, kind_of(test, step.args[0], resolve)), yes).otherwise(no)
    return None


def builtin(initial: Any, step: Node, acc: Node, resolve: Callable[[str], Column]) -> Column | None:
    """The built-in aggregate of a step on one scalar accumulator, if it is one."""
    key = acc.key()
    is_acc = lambda t: t.key() == key
    value = None
    if step.op == "+" and any(map(is_acc, step.args)):
        value = step.args[1] if is_acc(step.args[0]) else step.args[0]
        if not depends(value, ACC):
            total = F.count(F.lit(1)) * F.lit(value.args[0]) if value.op == "lit" else F.sum(column(value, resolve))
            return F.lit(initial) + total
    part = added(step, is_acc, resolve)
    if part is not None:
        return F.lit(initial) + F.coalesce(F.sum(part), F.lit(0))
    if step.op == "if" and step.args[0].op in ("<", ">", "<=", ">="):
        condition, yes, no = step.args
        left, right = condition.args
        if is_acc(no) and not depends(yes, ACC):
            value = yes
        elif is_acc(yes) and not depends(no, ACC):
            value = no
        if value is not None and {left.key(), right.key()} == {key, value.key()}:
            greater = condition.op in (">", ">=")
            wins_if_larger = greater == (left.key() == yes.key())
            best = F.max if wins_if_larger else F.min
            pick = F.greatest if wins_if_larger else F.least
            return pick(F.lit(initial), best(column(value, resolve)))
    if step.op == "call" and step.args[0] in ("min", "max") and len(step.args) == 3:
        parts = [a for a in step.args[1:] if not is_acc(a)]
        if len(parts) == 1 and not depends(parts[0], ACC):
            best, pick = (F.max, F.greatest) if step.args[0] == "max" else (F.min, F.least)
            return pick(F.lit(initial), best(column(parts[0], resolve)))
    return None


def fold_key(initial: Any, step: Callable, finish: Callable) -> str:
    """A text that tells folds apart: the seed and the traced functions."""
    parts = list(initial) if isinstance(initial, (tuple, list)) else [initial]
    accs = [Node("item", (Node("name", (ACC,)), k)) for k in range(len(parts))]
    whole = Node("tuple", tuple(accs)) if isinstance(initial, (tuple, list)) else accs[0]
    return f"{initial!r}, {trace(step, whole, RowProxy()).key()}, {trace(finish, whole).key()}"


def fold(initial: Any, step: Callable, finish: Callable, resolve: Callable[[str], Column], fields: list[str]) -> Column:
    """The column of a fold; fields: the columns of a row, for folds that no built-in aggregate expresses."""
    parts = list(initial) if isinstance(initial, (tuple, list)) else [initial]
    accs = [Node("item", (Node("name", (ACC,)), k)) for k in range(len(parts))]
    whole = Node("tuple", tuple(accs)) if isinstance(initial, (tuple, list)) else accs[0]
    tree = trace(step, whole, RowProxy())
    steps = list(tree.args) if tree.op == "tuple" and isinstance(initial, (tuple, list)) else [tree]
    if len(steps) == len(parts):
        columns = [builtin(i, s, a, resolve) for i, s, a in zip(parts, steps, accs, strict=True)]
        if all(c is not None for c in columns):
            bound = [Node("bound", (c,)) for c in columns]
            done = trace(finish, Node("tuple", tuple(bound)) if isinstance(initial, (tuple, list)) else bound[0])
            return column(done, resolve)
    used = sorted(names(tree) - {ACC})
    canonical = {f.lower(): f for f in fields}
    missing = [u for u in used if u.lower() not in canonical]
    if missing:
        raise ExpressionError(f"unknown fields {missing}")
    rows = F.collect_list(F.struct(*[resolve(u).alias(u) for u in used], F.lit(1).alias("__one")))
    start = F.struct(*[F.lit(float(p) if isinstance(p, (int, float)) and not isinstance(p, bool) else p).alias(f"f{k}") for k, p in enumerate(parts)])

    def merge(acc: Column, row: Column) -> Column:
        def look(name: str) -> Column:
            return acc if name == ACC else row.getField(name)

        return F.struct(*[_like(column(s, look), p).alias(f"f{k}") for k, (s, p) in enumerate(zip(steps, parts, strict=True))])

    def last(acc: Column) -> Column:
        fields = [Node("bound", (acc.getField(f"f{k}"),)) for k in range(len(parts))]
        return column(trace(finish, Node("tuple", tuple(fields)) if isinstance(initial, (tuple, list)) else fields[0]), resolve)

    return F.aggregate(rows, start, merge, last)


def _like(c: Column, sample: Any) -> Column:
    """Accumulators keep one type: numbers are doubles."""
    return c.cast("double") if isinstance(sample, (int, float)) and not isinstance(sample, bool) else c
