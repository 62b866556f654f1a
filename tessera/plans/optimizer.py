"""Join-order enumerators over a builder's plan.

Catalyst pushes filters and projections down by itself, so only the order of inner joins is
chosen here.  The sources of a join tree, their filters pushed to them, are joined again in
the order that a strategy finds; a DataFrame built in that order reaches Spark's optimizer
unchanged while its own reordering is off.  Cardinalities are estimated rows of relations
times selectivities; costs are rows that joins read and make, a part of them where one side is
a small relation, which is broadcast, so that the other is not shuffled.  Joined sets are never
broadcast: their rows are only guessed, and a wrong guess would not fit.  Equations that share a key
form a class, whose keys are taken to have as many values as the smallest relation among
them has rows: a join on a nation makes many rows of two tables that are not nations.
Candidates are compared by their columns and estimates alone: planning runs no job, and only
the winner is built.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import DataFrame

from tessera.functions.expressions import Node, column, conjuncts, names
from tessera.operators import joins
from tessera.plans.builder import Operator, Plan, condition, lowered, resolver_of_two, split_keys

#: Share of rows that a filter, or a theta join's predicate, is taken to keep where no histogram tells.
FILTERED, THETA = 0.3, 0.3
#: Cost of a row that passes a broadcast relation; one that is shuffled, or met with a product, costs 1.
STREAMED = 0.1
#: Rows of a block of the block-nested-loops join.
BLOCK_ROWS = 10_000
FLIPPED = {"<": ">", "<=": ">=", ">": "<", ">=": "<=", "==": "=="}


def share_of_histogram(buckets: list[tuple[float, float, int]], op: str, value: float) -> float:
    """Share of rows that a comparison with a number keeps, values being even within a bucket."""
    total = sum(n for *_, n in buckets)
    if not total:
        return 0.0

    def below(x: float) -> float:
        return sum(n * min(max((x - low) / (high - low), 0.0), 1.0) for low, high, n in buckets) / total

    if op == "==":
        return max(below(value + 1) - below(value), 0.0)
    return {"<": below(value), "<=": below(value), ">": 1 - below(value), ">=": 1 - below(value)}[op]


class Costs:
    """Rows and costs of operators: estimated, or counted by running every operator."""

    def __init__(self, database, estimated: bool = True):
        self.database, self.estimated = database, estimated
        self.known: dict[int, float] = {}

    def rows(self, op: Operator) -> float:
        if op.number not in self.known:
            self.known[op.number] = self._estimate(op) if self.estimated else float(op.df.count())
        return self.known[op.number]

    def _estimate(self, op: Operator) -> float:
        below = [self.rows(i) for i in op.inputs]
        if op.kind == "TableScan":
            return self.database.estimatedRows(op.relation) if op.relation is not None else 1.0
        if op.kind == "Select":
            return below[0] * self.kept(op.inputs[0], conjuncts(op.predicate))
        if op.kind == "Join":
            return max(below) if self.equi(op) else below[0] * below[1] * THETA
        return sum(below) if op.kind == "UnionAll" else below[0]

    def kept(self, source: Operator, predicates: list[Node]) -> float:
        """Share of rows of source that pass all predicates, as if these were independent."""
        share = 1.0
        for p in predicates:
            share *= self._kept(source, p)
        return share

    def _kept(self, source: Operator, p: Node) -> float:
        while source.kind == "Select":
            source = source.inputs[0]
        if source.kind == "TableScan" and source.relation is not None and p.op in FLIPPED:
            a, b = p.args
            op, name, value = (p.op, a, b) if a.op == "name" else (FLIPPED[p.op], b, a)
            if name.op == "name" and value.op == "lit" and isinstance(value.args[0], (int, float)):
                buckets = self.database.knownHistogram(source.relation, name.args[0])
                if buckets is not None:
                    return share_of_histogram(buckets, op, float(value.args[0]))
        return FILTERED

    @staticmethod
    def equi(op: Operator) -> bool:
        return split_keys(lowered(op.inputs[0].df), lowered(op.inputs[1].df), op.predicate)

    def cost(self, op: Operator) -> float:
        """Rows that an operator and those below it touch: a scan its rows, any other its inputs' costs and rows.

        Grouping touches its input twice more.  Joins touch further rows by their method:
        nested loops the inner side for every outer row, block nested loops for every
        block of them, an index a logarithm for every outer row.
        """
        below = [self.rows(i) for i in op.inputs]
        if not below:
            return self.rows(op)
        total = sum(self.cost(i) for i in op.inputs) + sum(below)
        if op.kind == "GroupBy":
            total += 2 * below[0]
        if op.kind == "Join":
            outer, inner = below
            if op.method == "block-nested-loops":
                total += math.ceil(outer / BLOCK_ROWS) * inner
            elif op.method == "indexed":
                total += outer * math.log2(inner + 2)
            elif op.method == "nested-loops" and not self.equi(op):
                total += outer * inner
        return total


@dataclass
class Predicate:
    """A conjunct over several sources; an equation has the class of its keys and the number of their values."""

    tree: Node
    columns: frozenset
    keys: int | None = None
    values: float = 1.0

    @classmethod
    def all(cls, trees: list[Node], sources: list[tuple[frozenset, float]]) -> list[Predicate]:
        """trees over sources, given by their columns and their rows before any filter."""
        out = [cls(t, frozenset(n.lower() for n in names(t))) for t in trees]
        classes: dict[str, int] = {}
        for k, p in enumerate(out):
            if p.tree.op == "==":
                a, b = (x.key().lower() if x.op == "name" else x.key() for x in p.tree.args)
                old, p.keys = {classes.get(a), classes.get(b)}, k
                for q in (*(q for q in out[:k] if q.keys is not None and q.keys in old), p):
                    q.keys = k
                classes = {x: k if c in old else c for x, c in classes.items()} | {a: k, b: k}
        for k in {p.keys for p in out if p.keys is not None}:
            mine = [p for p in out if p.keys == k]
            ends = [{n.lower() for n in names(x)} for p in mine for x in p.tree.args]
            rows = [rows for columns, rows in sources if any(e and e <= columns for e in ends)]
            for p in mine:
                p.values = max(1.0, min(rows, default=1.0))
        return out


@dataclass
class Part:
    """A joined set of sources: what is known of it, and how to build it."""

    members: frozenset
    columns: frozenset
    rows: float
    cost: float
    shape: str
    source: DataFrame | None = None
    sides: tuple[Part, Part] | None = None
    on: Node | None = None
    #: small: can be broadcast; sent: the side that is.
    small: bool = False
    sent: Part | None = None

    def build(self) -> DataFrame:
        if self.sides is None:
            return self.source
        left, right = (p.build().hint("broadcast") if p is self.sent else p.build() for p in self.sides)
        return left.crossJoin(right) if self.on is None else left.join(right, column(self.on, resolver_of_two(left, right)))


class Optimizer:
    """Left-deep dynamic programming."""

    bushy = False

    def __init__(self, database):
        self.database = database
        self.cache: dict[str, Plan] = {}
        self.costs: dict[str, float] = {}

    def addPlanCost(self, plan: Plan | str, cost: float) -> None:  # noqa: N802
        self.costs[plan.getPlanKey() if isinstance(plan, Plan) else plan] = cost

    def getPlanCost(self, plan: Plan) -> float:  # noqa: N802
        """The estimated cost of a plan, remembered by its key."""
        key = plan.getPlanKey()
        if key not in self.costs:
            self.addPlanCost(key, plan.cost(estimated=True))
        return self.costs[key]

    def optimizeQuery(self, plan: Plan) -> Plan:  # noqa: N802
        """A plan with the same rows and columns and a chosen join order; results are kept by the plan's exact key."""
        key = plan.getPlanKey()
        if key not in self.cache:
            origin = Plan(plan.root, plan.database)
            self.cache[key] = Plan(self.optimized(origin), plan.database, origin, self)
        return self.cache[key]

    def optimized(self, plan: Plan) -> Operator:
        return self.pushdownOperators(self.pickJoinOrder(plan)).root

    def pushdownOperators(self, plan: Plan) -> Plan:  # noqa: N802
        """Catalyst's rules do this when the plan runs; the tree stays."""
        return plan

    def pickJoinOrder(self, plan: Plan) -> Plan:  # noqa: N802
        return Plan(self._walk(plan.root), plan.database)

    def _walk(self, op: Operator, filters: tuple[Node, ...] = ()) -> Operator:
        """op with its join trees reordered; filters are conjuncts of Selects just above, which go to their sources."""
        if op.kind == "Select" and self._over_join(op):
            return self._walk(op.inputs[0], (*filters, *conjuncts(op.predicate)))
        if op.kind == "Join":
            return self._reorder(op, list(filters))
        return op.over([self._walk(i) for i in op.inputs])

    def _over_join(self, op: Operator) -> bool:
        while op.kind == "Select":
            op = op.inputs[0]
        return op.kind == "Join"

    def _reorder(self, top: Operator, filters: list[Node]) -> Operator:
        sources, predicates = [], list(filters)

        def gather(op: Operator) -> None:
            if op.kind == "Join":
                predicates.extend(conjuncts(op.predicate))
                for i in op.inputs:
                    gather(i)
            else:
                sources.append(self._walk(op))

        gather(top)
        costs = Costs(self.database)
        parts, whole, rest = [], [], [p for p in predicates if not (p.op == "lit" and p.args[0] is True)]
        for k, source in enumerate(sources):
            columns = lowered(source.df)
            own = [p for p in rest if {n.lower() for n in names(p)} <= columns]
            rest = [p for p in rest if not any(p is o for o in own)]
            df = source.df
            for p in own:
                df = df.filter(condition(df, p))
            rows = max(1.0, costs.rows(source) * costs.kept(source, own))
            while source.kind == "Select":
                source = source.inputs[0]
            whole.append((columns, costs.rows(source)))
            parts.append(Part(frozenset([k]), columns, rows, 0.0, str(k), df, small=joins.small(source.df, whole[-1][1])))
        best = self.order(parts, Predicate.all(rest, whole))
        frame = best.build().select(*[f"`{c}`" for c in top.df.columns])
        return Operator("Join", sources, frame, f"{type(self).__name__}: {best.shape}", top.predicate, top.method, exact=f"{best.shape} {top.predicate.key()}")

    def join_parts(self, a: Part, b: Part, predicates: list[Predicate]) -> tuple[Part, bool]:
        """Two parts joined by every predicate that their columns complete, and whether there is any."""
        both = a.columns | b.columns
        mine = [p for p in predicates if p.columns <= both and not p.columns <= a.columns and not p.columns <= b.columns]
        if not mine:
            rows = a.rows * b.rows
            return Part(a.members | b.members, both, rows, a.cost + b.cost + rows, f"({a.shape} x {b.shape})", sides=(a, b)), False
        tree = mine[0].tree
        for p in mine[1:]:
            tree = Node("and", (tree, p.tree))
        equal = {p.keys: p.values for p in mine if p.keys is not None and split_keys(a.columns, b.columns, p.tree)}
        others = sum(p.keys not in equal for p in mine)
        rows = max(1.0, a.rows * b.rows / math.prod(equal.values()) * THETA**others)
        sent = min((p for p in (a, b) if p.small and equal), key=lambda p: p.rows, default=None)
        cost = a.cost + b.cost + (a.rows + b.rows + rows) * (STREAMED if sent else 1.0)
        return Part(a.members | b.members, both, rows, cost, f"({a.shape} * {b.shape})", sides=(a, b), on=tree, sent=sent), True

    def order(self, parts: list[Part], predicates: list[Predicate]) -> Part:
        """The cheapest tree over all parts; of each set of parts, products only where no predicate connects any split."""
        best = {p.members: p for p in parts}
        every = frozenset().union(*best)
        for size in range(2, len(parts) + 1):
            for chosen in combinations(sorted(every), size):
                options = []
                for left, right in self.splits(chosen):
                    part, connected = self.join_parts(best[left], best[right], predicates)
                    options.append((not connected, part.cost, part.shape, part))
                best[frozenset(chosen)] = min(options, key=lambda o: o[:3])[3]
        return best[every]

    def splits(self, chosen: tuple):
        for k in chosen:
            yield frozenset(chosen) - {k}, frozenset([k])


class BushyOptimizer(Optimizer):
    """Dynamic programming over all splits."""

    bushy = True

    def splits(self, chosen: tuple):
        first, rest = chosen[0], chosen[1:]
        for size in range(len(rest)):
            for some in combinations(rest, size):
                left = frozenset((first, *some))
                yield left, frozenset(chosen) - left


class GreedyOptimizer(Optimizer):
    """The cheapest pair first, connected pairs before products."""

    def order(self, parts: list[Part], predicates: list[Predicate]) -> Part:
        parts = list(parts)
        while len(parts) > 1:
            options = []
            for a, b in combinations(range(len(parts)), 2):
                joined, connected = self.join_parts(parts[a], parts[b], predicates)
                options.append((not connected, joined.rows, a, b, joined))
            *_, a, b, joined = min(options, key=lambda o: o[:4])
            parts = [p for k, p in enumerate(parts) if k not in (a, b)] + [joined]
        return parts[0]
