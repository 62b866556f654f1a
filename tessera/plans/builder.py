"""The fluent query builder and its plans.

A plan is a tree of operators over relations.  Building it makes a DataFrame, so Catalyst
does push-down, pruning and selection of physical operators; the tree is kept for
introspection and for the join-order enumerators.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tessera.functions import aggregates
from tessera.functions.expressions import Node, RowProxy, column, conjuncts, kind_of, names, parse, trace, truth
from tessera.functions.types import parse_type
from tessera.operators import joins, sets
from tessera.plans.schema import Schema

_numbers = itertools.count()


def resolver(df: DataFrame) -> Callable[[str], Column]:
    """Columns of df by name, whatever the case; ValueError for unknown names."""
    known = {c.lower(): c for c in df.columns}

    def resolve(name: str) -> Column:
        if name.lower() not in known:
            raise ValueError(f"unknown attribute {name!r}")
        return F.col(f"`{known[name.lower()]}`")

    resolve.kind = lambda c: df.select(c.alias("c")).schema[0].dataType
    return resolve


def condition(df: DataFrame, tree: Node) -> Column:
    """A predicate: numbers and strings are true unless zero or empty, as in Python."""
    resolve = resolver(df)
    c = column(tree, resolve)
    return truth(c, kind_of(c, tree, resolve))


def lowered(df: DataFrame) -> frozenset[str]:
    return frozenset(c.lower() for c in df.columns)


def split_keys(l: frozenset[str], r: frozenset[str], tree: Node | None) -> bool:
    """Whether a predicate has a conjunct that equates the two sides, given their lower-case columns."""
    for part in conjuncts(tree) if tree is not None else []:
        if part.op == "==":
            a, b = ({n.lower() for n in names(x)} for x in part.args)
            if a and b and ((a <= l and b <= r) or (a <= r and b <= l)):
                return True
    return False


@dataclass(eq=False)
class Operator:
    """A node of a plan.

    text is for readers; exact tells any two different operators apart, down to their
    expressions and the state of the relations that they read.
    """

    kind: str
    inputs: list[Operator]
    df: DataFrame
    text: str = ""
    predicate: Node | None = None
    method: str | None = None
    relation: str | None = None
    rebuild: Callable[..., DataFrame] | None = None
    exact: str = ""
    state: str | None = None
    number: int = field(default_factory=lambda: next(_numbers))

    def explain(self, depth: int = 0) -> str:
        line = "  " * depth + f"{self.kind}[{self.number}]" + (f"({self.text})" if self.text else "")
        return "\n".join([line, *(i.explain(depth + 1) for i in self.inputs)])

    def key(self) -> str:
        state = f"@{self.state}" if self.state else ""
        return f"{self.kind}({self.exact or self.text}{state}; {', '.join(i.key() for i in self.inputs)})"

    def binary(self) -> bool:
        """Whether this operator, or any below it, has two inputs."""
        return len(self.inputs) > 1 or any(i.binary() for i in self.inputs)

    def over(self, inputs: list[Operator]) -> Operator:
        """This operator over other inputs."""
        if all(a is b for a, b in zip(inputs, self.inputs, strict=True)):
            return self
        return replace(self, inputs=inputs, df=self.rebuild(*[i.df for i in inputs]), number=next(_numbers))

    def renewed(self, database) -> Operator:
        """This tree over the present state of its relations; the same object if nothing has changed."""
        if self.kind == "TableScan" and self.relation is not None:
            state = database.state(self.relation)
            return self if state == self.state else replace(self, df=self.rebuild(), state=state, number=next(_numbers))
        return self.over([i.renewed(database) for i in self.inputs])


class Plan:
    """A finished query: iterate it for rows, or take its DataFrame.

    It follows its relations: after an insert, update or delete it reads their present state.
    origin: the plan that an optimizer made this one from.
    """

    def __init__(self, root: Operator, database, origin: Plan | None = None, optimizer=None):
        self._root, self.database, self.origin, self.optimizer = root, database, origin, optimizer

    @property
    def root(self) -> Operator:
        if self.origin is None:
            self._root = self._root.renewed(self.database)
        else:
            before = self.origin._root
            if self.origin.root is not before:
                self._root = self.optimizer.optimized(self.origin)
        return self._root

    @property
    def df(self) -> DataFrame:
        return self.root.df

    def schema(self) -> Schema:
        return Schema.of(self.root.kind, self.df)

    def flatten(self) -> list[tuple[int, Operator]]:
        """Operators in pre-order with their depth."""

        def walk(op: Operator, depth: int) -> Iterator[tuple[int, Operator]]:
            yield depth, op
            for i in op.inputs:
                yield from walk(i, depth + 1)

        return list(walk(self.root, 0))

    def _of(self, kind: str) -> list[Operator]:
        return [op for _, op in self.flatten() if op.kind == kind]

    def _topmost(self, ends: Callable[[Operator], bool], enters: Callable[[Operator], bool] = lambda op: True) -> list[Operator]:
        """Operators, from the left, at which the way down from the root ends."""

        def walk(op: Operator) -> Iterator[Operator]:
            if ends(op):
                yield op
            elif enters(op):
                for i in op.inputs:
                    yield from walk(i)

        return list(walk(self.root))

    def relations(self) -> list[str]:
        return [op.relation for op in self._of("TableScan")]

    @property
    def joins(self) -> list[Operator]:
        return self._of("Join")

    @property
    def unions(self) -> list[Operator]:
        return self._of("UnionAll")

    @property
    def sources(self) -> list[Operator]:
        """The topmost operators that have no binary operator in them."""
        return self._topmost(lambda op: not op.binary())

    @property
    def joinBeforeUnion(self) -> list[Operator]:  # noqa: N802
        """Joins that are met on the way down before any union."""
        found: list[Operator] = []

        def enters(op: Operator) -> bool:
            if op.kind == "Join":
                found.append(op)
            return op.kind != "UnionAll"

        self._topmost(lambda op: False, enters)
        return found

    @property
    def joinSources(self) -> list[Operator]:  # noqa: N802
        """What join ordering takes as given: unions, and the topmost operators that have no binary one in them."""
        return self._topmost(lambda op: op.kind == "UnionAll" or not op.binary())

    def prepare(self, database=None) -> Plan:
        self.database = database or self.database
        return self

    def explain(self, mode: str | None = None) -> str:
        """The operator tree; with a mode, Spark's plan in that mode goes to standard output as well."""
        if mode:
            self.df.explain(mode)
        return self.root.explain()

    def getPlanKey(self) -> str:  # noqa: N802
        """A text that two plans share only if they give the same rows."""
        return self.root.key()

    def cost(self, estimated: bool = True) -> float:
        """Rows that all operators touch: by estimates, or by counting what each of them returns."""
        from tessera.plans.optimizer import Costs

        return Costs(self.database, estimated).cost(self.root)

    def sample(self, factor: float, seed: int = 7) -> float:
        """Estimated rows: those of a sample of one row in factor, times factor."""
        return self.df.sample(1.0 / factor, seed).count() * factor

    def __iter__(self) -> Iterator[Row]:
        return iter(self.df.toLocalIterator())


class Query:
    """A builder: every call returns a new one."""

    def __init__(self, database, root: Operator | None = None):
        self.database, self.root = database, root

    def _next(self, *args, **kwargs) -> Query:
        return Query(self.database, Operator(*args, **kwargs))

    def _input(self) -> Operator:
        if self.root is None:
            raise ValueError("begin with fromTable")
        return self.root

    def _scan(self, relation: str, text: str, read: Callable[[], DataFrame]) -> Query:
        return self._next("TableScan", [], read(), text, relation=relation, rebuild=read, state=self.database.state(relation))

    def fromTable(self, relation: str) -> Query:  # noqa: N802
        return self._scan(relation, relation, lambda: self.database.table(relation))

    def sampledTable(self, relation: str, fraction: float, seed: int = 7) -> Query:  # noqa: N802
        return self._scan(relation, f"{relation}, sample {fraction}, seed {seed}", lambda: self.database.table(relation).sample(fraction, seed))

    def where(self, expression: str) -> Query:
        top, tree = self._input(), parse(expression)

        def build(df: DataFrame) -> DataFrame:
            return df.filter(condition(df, tree))

        return self._next("Select", [top], build(top.df), expression, predicate=tree, rebuild=build, exact=tree.key())

    def select(self, outputs: dict[str, tuple[str, str]]) -> Query:
        top = self._input()
        trees = {n: (parse(e), parse_type(d)) for n, (e, d) in outputs.items()}
        bad = [n for n, (_, t) in trees.items() if t is None and outputs[n][1] != "any"]
        if bad:
            raise ValueError(f"invalid types for {bad}")

        def build(df: DataFrame) -> DataFrame:
            resolve = resolver(df)
            return df.select(*[(t.cast(column(e, resolve)) if t else column(e, resolve)).alias(n) for n, (e, t) in trees.items()])

        exact = ", ".join(f"{n} {t or 'any'}: {e.key()}" for n, (e, t) in trees.items())
        return self._next("Project", [top], build(top.df), str(outputs), rebuild=build, exact=exact)

    def join(
        self,
        rhs: Query,
        method: str = "nested-loops",
        expr: str | None = None,
        lhsSchema: Schema | None = None,  # noqa: N803
        rhsSchema: Schema | None = None,  # noqa: N803
        lhsKeySchema: Schema | None = None,  # noqa: N803
        rhsKeySchema: Schema | None = None,  # noqa: N803
        lhsHashFn: str | None = None,  # noqa: N803
        rhsHashFn: str | None = None,  # noqa: N803
        indexId: int | None = None,  # noqa: N803
        pipeline: bool = False,
    ) -> Query:
        """Inner join.  Hash functions are accepted, partitioning is Spark's; renaming schemas rename a side by position."""
        if pipeline:
            raise ValueError("joins do not pipeline")
        if method not in joins.METHODS:
            raise ValueError(f"unknown join method {method!r}")
        left, right = self._input(), rhs._input()
        renames = [(lhsSchema, left), (rhsSchema, right)]
        frames = []
        for schema, op in renames:
            if schema is not None and len(schema.fields) != len(op.df.columns):
                raise ValueError(f"{schema} does not fit its side")
            frames.append(op.df if schema is None or [f.lower() for f in schema.fields] == [c.lower() for c in op.df.columns] else op.df.toDF(*schema.fields))
        if method in ("nested-loops", "block-nested-loops") and expr is None:
            raise ValueError(f"{method} needs expr")
        if method == "hash" and (lhsKeySchema is None or rhsKeySchema is None or lhsHashFn is None or rhsHashFn is None):
            raise ValueError("hash needs key schemas and hash functions of both sides")
        if method == "indexed":
            if indexId is None or lhsKeySchema is None:
                raise ValueError("indexed needs indexId and lhsKeySchema")
            if not self.database.hasIndexId(indexId):
                raise ValueError(f"no index {indexId}")
            if rhsKeySchema is None:
                rhsKeySchema = Schema("key", [(f, "any") for f in self.database.indexFields(indexId)])
        trees = [parse(expr)] if expr is not None else []
        if lhsKeySchema is not None and rhsKeySchema is not None and method in ("hash", "indexed"):
            if len(lhsKeySchema.fields) != len(rhsKeySchema.fields):
                raise ValueError("keys differ in length")
            trees = [Node("==", (Node("name", (a,)), Node("name", (b,)))) for a, b in zip(lhsKeySchema.fields, rhsKeySchema.fields, strict=True)] + trees
        tree = trees[0]
        for t in trees[1:]:
            tree = Node("and", (tree, t))

        def build(l: DataFrame, r: DataFrame) -> DataFrame:
            joins.disjoint(l, r)
            if tree.op == "lit" and tree.args[0] is True:
                return joins.inner_join(l, r, None, method, False)
            known = resolver_of_two(l, r)
            return joins.inner_join(l, r, column(tree, known), method, split_keys(lowered(l), lowered(r), tree))

        inputs = [op if f is op.df else renaming(op, f.columns) for f, op in zip(frames, (left, right), strict=True)]
        if method == "indexed":
            inputs[1] = self._through_index(inputs[1], indexId)
        text = f"{method}, {expr or [lhsKeySchema, rhsKeySchema]}"
        return self._next("Join", inputs, build(*[i.df for i in inputs]), text, predicate=tree, method=method, rebuild=build, exact=f"{method}, {tree.key()}")

    def _through_index(self, op: Operator, number: int) -> Operator:
        """op with scans of the index's relation reading the index's sorted copy, whose files and row groups cover few keys."""
        if op.kind == "TableScan" and op.relation is not None and op.relation.lower() == self.database.indexRelation(number):
            def read() -> DataFrame:
                return self.database.scanIndex(number)

            return replace(op, df=read(), text=f"{op.text}, index {number}", rebuild=read, number=next(_numbers))
        return op.over([self._through_index(i, number) for i in op.inputs])

    def union(self, other: Query) -> Query:
        left, right = self._input(), other._input()
        return self._next("UnionAll", [left, right], sets.union_all(left.df, right.df), rebuild=sets.union_all)

    def groupBy(  # noqa: N802
        self,
        groupSchema: Schema,  # noqa: N803
        aggSchema: Schema,  # noqa: N803
        groupExpr: Callable | str,  # noqa: N803
        aggExprs: list,  # noqa: N803
        groupHashFn: Callable | None = None,  # noqa: N803
        pipeline: bool = False,
    ) -> Query:
        """Group-by with fold triples, or with pairs of a name (sum, count, min, max, avg) and an expression string."""
        if pipeline:
            raise ValueError("group-by does not pipeline")
        if groupSchema is None or aggSchema is None or groupExpr is None or not aggExprs:
            raise ValueError("group-by needs schemas, a key and aggregates")
        if len(aggExprs) != len(aggSchema.fields):
            raise ValueError("as many aggregates as fields of their schema are needed")
        top = self._input()
        key = parse(groupExpr) if isinstance(groupExpr, str) else trace(groupExpr, RowProxy())
        keys = list(key.args) if key.op == "tuple" else [key]
        if len(keys) != len(groupSchema.fields):
            raise ValueError("as many keys as fields of their schema are needed")

        def typed(c: Column, schema: Schema, name: str) -> Column:
            t = schema.type_of(name)
            return (t.cast(c) if t else c).alias(name)

        def build(df: DataFrame) -> DataFrame:
            resolve = resolver(df)
            outs = []
            for name, a in zip(aggSchema.fields, aggExprs, strict=True):
                outs.append(typed(aggregate(a, resolve, df.columns), aggSchema, name))
            groups = [typed(column(k, resolve), groupSchema, n) for n, k in zip(groupSchema.fields, keys, strict=True)]
            return df.groupBy(*groups).agg(*outs)

        exact = f"{groupSchema}, {aggSchema}, {key.key()}, {[aggregate_key(a) for a in aggExprs]}"
        return self._next("GroupBy", [top], build(top.df), f"{groupSchema}, {aggSchema}", rebuild=build, exact=exact)

    def order(self, sortKeyFn: Callable | str, sortKeyDesc: str, descending: bool | list[bool] = True) -> Query:  # noqa: N803
        """Sort, by default descending; the key is a lambda or an expression, and its description is mandatory.

        A key of several parts may have a direction for each of them.
        """
        if sortKeyFn is None or sortKeyDesc is None:
            raise ValueError("order needs a key and its description")
        top = self._input()
        key = parse(sortKeyFn) if isinstance(sortKeyFn, str) else trace(sortKeyFn, RowProxy())
        keys = list(key.args) if key.op == "tuple" else [key]
        down = [descending] * len(keys) if isinstance(descending, bool) else list(descending)
        if len(down) != len(keys):
            raise ValueError("as many directions as parts of the key are needed")

        def build(df: DataFrame) -> DataFrame:
            resolve = resolver(df)
            cols = [column(k, resolve) for k in keys]
            return df.orderBy(*[c.desc() if d else c.asc() for c, d in zip(cols, down, strict=True)])

        return self._next("Sort", [top], build(top.df), sortKeyDesc, rebuild=build, exact=f"{key.key()}, {down}")

    def limit(self, n: int) -> Query:
        top = self._input()
        return self._next("Limit", [top], top.df.limit(n), str(n), rebuild=lambda df: df.limit(n))

    def derive(self, name: str, expression: str) -> Query:
        """All columns and one more by a Spark SQL expression, computed where it stands: after a join, for the rows that are left."""
        top = self._input()
        if name.lower() in lowered(top.df):
            raise ValueError(f"there is {name!r}")

        def build(df: DataFrame) -> DataFrame:
            return df.withColumn(name, F.expr(expression))

        return self._next("Project", [top], build(top.df), f"*, {expression} as {name}", rebuild=build)

    def spread(self) -> Query:
        """The same rows dealt over joins.TASKS_EACH tasks for each core, for the outer side of a join in which every row meets many."""
        top = self._input()
        return self._next("Spread", [top], joins.spread(top.df), rebuild=joins.spread)

    def finalize(self) -> Plan:
        return Plan(self._input(), self.database)


def renaming(op: Operator, columns: list[str]) -> Operator:
    return Operator("Rename", [op], op.df.toDF(*columns), str(columns), rebuild=lambda df: df.toDF(*columns))


NAMED = {"sum": F.sum, "min": F.min, "max": F.max, "avg": F.avg}


def named(spec) -> bool:
    return isinstance(spec, (tuple, list)) and isinstance(spec[0], str) and not callable(spec[1] if len(spec) > 1 else None)


def aggregate_key(spec) -> str:
    if named(spec):
        return "count" if spec[0] == "count" else f"{spec[0]} {parse(spec[1]).key()}"
    return aggregates.fold_key(*spec)


def aggregate(spec, resolve: Callable[[str], Column], columns: list[str]) -> Column:
    """spec: (initial, step, finish), or (name, expression)."""
    if named(spec):
        if spec[0] == "count":
            return F.count(F.lit(1))
        return NAMED[spec[0]](column(parse(spec[1]), resolve))
    initial, step, finish = spec
    return aggregates.fold(initial, step, finish, resolve, columns)


def resolver_of_two(left: DataFrame, right: DataFrame) -> Callable[[str], Column]:
    l, r = resolver(left), resolver(right)
    mine = {c.lower() for c in left.columns}
    known = {c.lower(): df[f"`{c}`"] for df in (left, right) for c in df.columns}

    def resolve(name: str) -> Column:
        if name.lower() not in known:
            (l if name.lower() in mine else r)(name)  # raises
        return known[name.lower()]

    resolve.kind = lambda c: left.crossJoin(right).select(c.alias("c")).schema[0].dataType
    return resolve


