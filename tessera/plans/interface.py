"""Registered queries over the interface itself: plans, catalog, schemas, validation, sources.

Each returns what calls answer as rows, beside SQL that states or computes the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.expressions import conjuncts, is_attribute, names, parse, unparse
from tessera.plans import optimizer, tuning
from tessera.plans.registry import HASH, database, grouped, key, query
from tessera.plans.schema import Schema
from tessera.sources import files, tpch


def literal(x) -> str:
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x).lower()


def values(columns: str, rows: list[tuple]) -> str:
    """SQL that states rows."""
    return f"select * from (values {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) t({columns})"


def stated(db, columns: str, rows: list[tuple]) -> DataFrame:
    return db.spark.createDataFrame(rows, columns)


def joined(db):
    """Suppliers with their nations, twice: a plan with joins above and below a union."""
    s, n = db.query().fromTable("supplier"), db.query().fromTable("nation")
    q = s.join(n.where("n_regionkey < 3"), method="nested-loops", expr="s_nationkey == n_nationkey")
    both = q.union(q).select({"s_suppkey": ("s_suppkey", "int"), "s_nationkey": ("s_nationkey", "int")})
    return both.join(db.query().fromTable("region"), method="hash", lhsKeySchema=key("s_nationkey"), rhsKeySchema=key("r_regionkey"), **HASH).finalize()


@query("plan_schema", values("place, name, kind", [(0, "c_custkey", "int"), (1, "half", "double"), (2, "word", "char(8)")]))
def _(db):
    plan = db.query().fromTable("customer").select({"c_custkey": ("c_custkey", "int"), "half": ("c_acctbal / 2", "double"), "word": ("c_name", "char(8)")}).finalize()
    return stated(db, "place int, name string, kind string", [(k, n, t) for k, (n, t) in enumerate(Schema("s", [(f, "char(8)" if f == "word" else t) for f, t in plan.schema().schema()]).schema())])


@query(
    "plan_introspection",
    values("what, n", [("relations", 5), ("operators", 12), ("deepest", 5), ("joins", 3), ("unions", 1), ("sources", 5), ("joins_before_union", 1), ("join_sources", 2), ("lines", 12)]),
)
def _(db):
    plan = joined(db)
    found = {
        "relations": plan.relations(),
        "operators": plan.flatten(),
        "joins": plan.joins,
        "unions": plan.unions,
        "sources": plan.sources,
        "joins_before_union": plan.joinBeforeUnion,
        "join_sources": plan.joinSources,
        "lines": plan.explain().splitlines(),
    }
    rows = [(k, len(v)) for k, v in found.items()] + [("deepest", max(d for d, _ in plan.flatten()))]
    return stated(db, "what string, n int", rows)


@query("plan_keys_and_costs", values("what, holds", [("equal plans", True), ("other aggregate", True), ("other order", True), ("actual cost", True), ("estimated cost", True), ("remembered", True)]))
def _(db):
    def plan(what: str):
        return grouped(db, "nation", ["n_regionkey"], lambda e: e.n_regionkey, ["v"], [(what, "n_nationkey")]).finalize()

    q, best = db.query().fromTable("nation"), optimizer.Optimizer(db)
    rows = [
        ("equal plans", plan("min").getPlanKey() == plan("min").getPlanKey()),
        ("other aggregate", plan("min").getPlanKey() != plan("max").getPlanKey()),
        ("other order", q.order(lambda e: e.n_name, "k").finalize().getPlanKey() != q.order(lambda e: e.n_nationkey, "k").finalize().getPlanKey()),
        ("actual cost", plan("min").cost(estimated=False) == 4 * 25),
        ("estimated cost", plan("min").cost(estimated=True) > 0),
        ("remembered", best.getPlanCost(plan("min")) == best.costs[plan("min").getPlanKey()]),
    ]
    return stated(db, "what string, holds boolean", rows)


@query("plan_rows", "select n_nationkey, n_name from nation where n_nationkey < 7")
def _(db):
    """Rows by iterating a prepared plan."""
    plan = db.query().fromTable("nation").where("n_nationkey < 7").select({"n_nationkey": ("n_nationkey", "int"), "n_name": ("n_name", "char(25)")}).finalize()
    return stated(db, "n_nationkey int, n_name string", [(r.n_nationkey, r.n_name) for r in db.processQuery(plan)])


@query("expr_divide", "select l_orderkey, l_linenumber, l_quantity / 3 as third, cast(l_orderkey as double) / l_linenumber as share from lineitem")
def _(db):
    exprs = {c: (c, "any") for c in ("l_orderkey", "l_linenumber")}
    return db.query().fromTable("lineitem").select(exprs | {"third": ("l_quantity / 3", "double"), "share": ("l_orderkey / l_linenumber", "double")})


@query(
    "expr_calls",
    "select c_custkey, cast(trunc(c_acctbal) as bigint) as whole, length(c_name) as size, cast(c_nationkey as varchar) as text, least(c_nationkey, 7) as low, greatest(c_nationkey, 7, c_custkey % 5) as high, "
    "ceil(c_acctbal) as up, sqrt(abs(c_acctbal)) as root, round_even(c_acctbal, 0) as near, power(c_nationkey, 2) as square from customer",
)
def _(db):
    exprs = {
        "c_custkey": ("c_custkey", "any"),
        "whole": ("int(c_acctbal)", "any"),
        "size": ("len(c_name)", "any"),
        "text": ("str(c_nationkey)", "any"),
        "low": ("min(c_nationkey, 7)", "any"),
        "high": ("max(c_nationkey, 7, c_custkey % 5)", "any"),
        "up": ("math.ceil(c_acctbal)", "any"),
        "root": ("math.sqrt(abs(c_acctbal))", "any"),
        "near": ("round(c_acctbal)", "any"),
        "square": ("math.pow(c_nationkey, 2)", "any"),
    }
    return db.query().fromTable("customer").select(exprs)


@query("expr_trees", values("what, text", [("spacing", "a + b * 2 > 3"), ("conjuncts", "3"), ("names", "a b c"), ("attribute", "True"), ("no attribute", "False")]))
def _(db):
    tree = parse("a == 1 and b < 2 and (c or a)")
    rows = [("spacing", unparse("(a+ b *2)>3")), ("conjuncts", str(len(conjuncts(tree)))), ("names", " ".join(sorted(names(tree)))), ("attribute", str(is_attribute(parse("a")))), ("no attribute", str(is_attribute(parse("a + 1"))))]
    return stated(db, "what string, text string", rows)


REFUSED = ["unknown method", "no expression", "no keys", "no index", "shared names", "pipelined join", "unknown attribute", "unions differ", "group without key", "too few aggregates", "order without description", "bad type", "out of range", "NULL", "second primary index", "call"]


@query("validation", values("what, refused", [(w, True) for w in REFUSED]))
def _(db):
    db.createRelation("t", [("id", "int"), ("w", "char(3)")])
    db.createIndex("t", ["id"], primary=True)
    q, r = db.query().fromTable("nation"), db.query().fromTable("region")
    group, one = key("g"), [("count", "1")]
    calls = [
        lambda: q.join(r, method="merge", expr="True"),
        lambda: q.join(r, method="nested-loops"),
        lambda: q.join(r, method="hash"),
        lambda: q.join(r, method="indexed", indexId=99, lhsKeySchema=key("n_regionkey")),
        lambda: q.join(q, method="nested-loops", expr="True"),
        lambda: q.join(r, method="nested-loops", expr="True", pipeline=True),
        lambda: q.where("nobody > 1"),
        lambda: q.union(r),
        lambda: q.groupBy(groupSchema=group, aggSchema=key("n"), groupExpr=None, aggExprs=one),
        lambda: q.groupBy(groupSchema=group, aggSchema=Schema("a", [("n", "int"), ("m", "int")]), groupExpr=lambda e: 1, aggExprs=one),
        lambda: q.order(lambda e: e.n_name, None),
        lambda: Schema("s", [("a", "date")]),
        lambda: db.insertTuple("t", (2**40, "x")),
        lambda: db.insertTuple("t", (None, "x")),
        lambda: db.createIndex("t", ["w"], primary=True),
        lambda: q.where("open('x')"),
    ]
    rows = []
    for what, call in zip(REFUSED, calls, strict=True):
        try:
            call()
            rows.append((what, False))
        except ValueError:
            rows.append((what, True))
    return stated(db, "what string, refused boolean", rows)


@query("ddl_tpch", values("relation, fields, n_rows", [(n, len(tpch.layout(n)[0].fields), 0) for n in sorted(tpch.FIELDS)]))
def _(db):
    """Drop and create the eight relations."""
    other = database(db.spark, "", "region")
    other.unregister("region")
    tpch.create_relations(other)
    tpch.create_relations(other)
    return stated(db, "relation string, fields int, n_rows int", [(n, len(other.relationSchema(n).fields), other.table(n).count()) for n in other.relations()])


@query("catalog_reopened", "select n_nationkey, n_name from nation union all select 90 + n_nationkey, 'again' from nation where n_nationkey < 2")
def _(db):
    """A relation written through one database and read, after more inserts, through another one over its folder."""
    from tessera.sources.database import Database

    db.createRelation("kept", [("n_nationkey", "int"), ("n_name", "char(25)")])
    db.insert("kept", db.table("nation").select("n_nationkey", "n_name"))
    db.close()
    again = Database(db.spark, db.folder)
    again.insertTuples("kept", [(90, "again"), (91, "again")])
    return Database(db.spark, db.folder).table("kept")


@query("index_catalog", values("what, holds", [(w, True) for w in ("created", "matched", "fields", "detached", "gone", "attached", "same rows", "removed")]))
def _(db):
    number = db.createIndex("supplier", ["s_nationkey"])
    rows = [("created", db.hasIndexId(number)), ("matched", db.matchIndex("supplier", ["s_nationkey"]) == number), ("fields", db.indexFields(number) == ["s_nationkey"])]
    n = db.lookupByIndex(number, 3).count()
    held = db.detachIndex(number)
    rows += [("detached", held["number"] == number), ("gone", not db.hasIndexId(number) and db.matchIndex("supplier", ["s_nationkey"]) is None)]
    rows += [("attached", db.attachIndex(held) == number), ("same rows", db.lookupByIndex(number, 3).count() == n == db.table("supplier").where("s_nationkey = 3").count())]
    db.removeIndex(number)
    return stated(db, "what string, holds boolean", [*rows, ("removed", not db.hasIndexId(number))])


@query("stats_analyzed", "select count(*) as n_rows, min(n_nationkey) as low, max(n_nationkey) as high from nation")
def _(db):
    """What ANALYZE has stored for a relation, read from Spark's catalog."""
    conf = db.spark.conf
    keys = ("spark.sql.cbo.enabled", "spark.sql.cbo.joinReorder.enabled")
    before = {k: conf.get(k) for k in keys}
    try:
        (table,) = tuning.Tuning(db).compute_statistics("nation")
        rows = int(next(r.data_type for r in db.spark.sql(f"describe extended {table}").collect() if r.col_name == "Statistics").split(", ")[1].split()[0])
        column = {r.info_name: r.info_value for r in db.spark.sql(f"describe extended {table} n_nationkey").collect()}
        db.spark.sql(f"drop table {table}")
    finally:
        for k, v in before.items():
            conf.set(k, v)
    return stated(db, "n_rows long, low int, high int", [(rows, int(column["min"]), int(column["max"]))])


SCHEMA_TEXTS = [("text", "t[(a,int),(b,char(3))]"), ("default", "0 ''"), ("cut", "1 'abc'"), ("renamed", "c d"), ("projected", "abc"), ("padded", "5"), ("same", "True"), ("other", "False")]


@query("schema_operations", values("what, text", SCHEMA_TEXTS))
def _(db):
    s = Schema("t", [("a", "int"), ("b", "char(3)")])
    row = s.instantiate(1, "abcd")
    rows = [
        ("text", s.toString()),
        ("default", "{} {!r}".format(*s.default())),
        ("cut", "{} {!r}".format(*row)),
        ("renamed", " ".join(s.rename("u", {"a": "c", "b": "d"}).fields)),
        ("projected", s.project(row, Schema("u", [("b", "char(3)")])).b),
        ("padded", str(len(Schema("u", [("x", "char(5)")]).values_from_strings(["ab"])[0]))),
        ("same", str(s.match(Schema.from_json(s.to_json())))),
        ("other", str(s.match(Schema("t", [("b", "char(3)"), ("a", "int")])))),
    ]
    return stated(db, "what string, text string", rows)


@query("fixed_layouts", values("what, size", [("lineitem", 143), ("orders", 139)]))
def _(db):
    return stated(db, "what string, size int", [("lineitem", files.record_size(files.LINEITEM_FORMAT)), ("orders", files.record_size(files.ORDERS_FORMAT))])


@query("source_fixed_lines", "select cast(l_orderkey as int) as l_orderkey, l_linenumber, cast(l_quantity as float) as l_quantity, l_returnflag, strftime(l_shipdate, '%Y%m%d') as l_shipdate from lineitem")
def _(db):
    """Lines through the fixed-width layout of the lineitem records."""
    path, lines = f"{db.folder}/lines-fixed", db.table("lineitem")
    day, word = F.date_format("l_shipdate", "yyyyMMdd"), F.lit("-")
    numbers = [F.col(c).cast("int") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")] + [F.col(c).cast("float") for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")]
    files.write_fixed(lines.select(*numbers, "l_returnflag", "l_linestatus", day, day, day, word, word, word), path, files.LINEITEM_FORMAT)
    got = files.read_fixed(db.spark, path, files.LINEITEM_FORMAT, [f for f in tpch.layout("lineitem")[0].fields])
    return got.select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_shipdate")


@query("fold_conditional", "select p_brand, cast(sum(case when p_size > 25 then p_size else -1 end) + 5 as double) as total from part group by p_brand")
def _(db):
    fold = (5.0, lambda acc, e: acc + e.p_size if e.p_size > 25 else acc - 1, lambda acc: float(acc) if isinstance(acc, (int, float)) else acc)
    return grouped(db, "part", ["p_brand"], lambda e: e.p_brand, ["total"], [fold])
