"""The eight TPC-H relations in the engine's types, and their loader from delimited files."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tessera.plans.schema import Schema
from tessera.sources.files import load_delimited

#: Field, type and parser letter (t: date, kept as an integer yyyymmdd) of each relation; fixed values.
FIELDS = {
    "part": "p_partkey int i, p_name char(55) s, p_mfgr char(25) s, p_brand char(10) s, p_type char(25) s, p_size int i, p_container char(10) s, p_retailprice double d, p_comment char(23) s",
    "supplier": "s_suppkey int i, s_name char(25) s, s_address char(40) s, s_nationkey int i, s_phone char(15) s, s_acctbal double d, s_comment char(101) s",
    "partsupp": "ps_partkey int i, ps_suppkey int i, ps_availqty int i, ps_supplycost double d, ps_comment char(199) s",
    "customer": "c_custkey int i, c_name char(25) s, c_address char(40) s, c_nationkey int i, c_phone char(15) s, c_acctbal double d, c_mktsegment char(10) s, c_comment char(117) s",
    "orders": "o_orderkey int i, o_custkey int i, o_orderstatus char(1) s, o_totalprice double d, o_orderdate int t, o_orderpriority char(15) s, o_clerk char(15) s, o_shippriority int i, o_comment char(79) s",
    "lineitem": "l_orderkey int i, l_partkey int i, l_suppkey int i, l_linenumber int i, l_quantity double d, l_extendedprice double d, l_discount double d, l_tax double d, l_returnflag char(1) s, l_linestatus char(1) s, "
    "l_shipdate int t, l_commitdate int t, l_receiptdate int t, l_shipinstruct char(25) s, l_shipmode char(10) s, l_comment char(44) s",
    "nation": "n_nationkey int i, n_name char(25) s, n_regionkey int i, n_comment char(152) s",
    "region": "r_regionkey int i, r_name char(25) s, r_comment char(152) s",
}


def layout(name: str) -> tuple[Schema, str]:
    """Schema and parser letters of a relation."""
    parts = [f.split() for f in FIELDS[name].split(", ")]
    return Schema(name, [(n, t) for n, t, _ in parts]), "".join(p for *_, p in parts)


def create_relations(database) -> None:
    """Drop and create all eight relations, empty."""
    for name in FIELDS:
        database.createRelation(name, layout(name)[0], replace=True)


def load(spark: SparkSession, database, folder: str, scale_factor: float = 1.0, seed: int = 7, names: list[str] | None = None) -> None:
    """Create relations from folder/<name>.csv, keeping each row with probability scale_factor."""
    paths = {n: (f"{folder}/{n}.csv", *layout(n)) for n in names or FIELDS}
    load_delimited(spark, paths, database, scale_factor, seed)
