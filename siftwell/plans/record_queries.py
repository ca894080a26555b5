"""Queries over JSON records: types, sizes and missing keys at every depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.operators import lattice
from siftwell.plans.catalogue import query, table, unions


def record_text() -> Column:
    """An order as a record: a key that is null, text or number, one that is an object, a number or missing, and an array of objects inside."""
    key, cust = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    price = F.when(F.col("o_orderstatus") == "P", "null").when(F.col("o_orderstatus") == "F", F.concat(F.lit('"'), "o_orderpriority", F.lit('"'))).otherwise(F.concat(cust, F.lit(".5")))
    items = F.array_join(F.array_repeat(F.lit('{"x y": true}'), (F.col("o_orderkey") % 4).cast("int")), ", ")
    inner = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit(', "c": {"id": '), cust, F.lit(', "d": ['), items, F.lit("]}"))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit(', "c": '), cust)).otherwise("")
    return F.concat(F.lit('{"k": '), key, F.lit(', "p": '), price, inner, F.lit("}"))


def nodes_sql() -> str:
    cust, key = "length(CAST(o_custkey AS VARCHAR))", "length(CAST(o_orderkey AS VARCHAR))"
    third, some = "o_orderkey % 3 = 0", "o_orderkey % 3 = 0 AND o_orderkey % 4 > 0"
    rows = [
        ("$", "object", "object", "true", "1", "CASE WHEN o_orderkey % 3 < 2 THEN 3 ELSE 2 END"), ("$.k", "long", "long", "true", "1", key),
        ("$.p", "mixed", "null", "o_orderstatus = 'P'", "1", "4"), ("$.p", "mixed", "string", "o_orderstatus = 'F'", "1", "length(o_orderpriority)"), ("$.p", "mixed", "double", "o_orderstatus NOT IN ('P', 'F')", "1", f"{cust} + 2"),
        ("$.c", "mixed", "object", third, "1", "2"), ("$.c", "mixed", "long", "o_orderkey % 3 = 1", "1", cust), ("$.c.id", "long", "long", third, "1", cust),
        ("$.c.d", "array", "array", third, "1", "o_orderkey % 4"), ("$.c.d[]", "object", "object", some, "o_orderkey % 4", "1"), ("$.c.d[][''x y'']", "boolean", "boolean", some, "o_orderkey % 4", "4"),
    ]
    missing = {"$": "NULL", "$.c": "(SELECT count(*) FROM orders WHERE o_orderkey % 3 = 2)", "$.c.d[]": "NULL"}
    made = [f"SELECT 'orders' AS of, '{p}' AS path, '{t}' AS type, '{k}' AS kind, CAST(sum({w}) AS BIGINT) AS n, CAST({missing.get(p, '0')} AS BIGINT) AS n_missing, CAST(min({s}) AS BIGINT) AS low_size, CAST(max({s}) AS BIGINT) AS high_size, CAST(sum({w} * ({s})) AS BIGINT) AS sum_size FROM orders WHERE {where}" for p, t, k, where, w, s in rows]
    value = "props ->> '$.k'"
    made += [f"SELECT 'events', '{p}', '{t}', '{t}', count(*), CAST({m} AS BIGINT), CAST(min({s}) AS BIGINT), CAST(max({s}) AS BIGINT), CAST(sum({s}) AS BIGINT) FROM events" for p, t, m, s in (("$", "object", "NULL", "1"), ("$.k", "long", "0", f"length({value})"))]
    return unions(made)


@query(nodes_sql())
def record_lattice(spark: SparkSession, sf: str) -> DataFrame:
    """Types, kinds, missing keys and sizes at every depth, of orders as nested records of mixed types and of the properties of events; states of both tables are kept apart by a key."""
    records = table(spark, sf, "orders").select(F.lit("orders").alias("of"), record_text().alias("text"))
    records = records.unionAll(table(spark, sf, "events").select(F.lit("events"), "props"))
    found = lattice.states(records, "text", ["of"])
    tree = lattice.nodes(found, ["of"]).select("of", "path", "type", "n_missing")
    return found.join(tree, ["of", "path"]).select("of", "path", "type", "kind", "n", "n_missing", "low_size", "high_size", "sum_size")


@query(
    "SELECT o_custkey, count(*) AS n_records, CAST(sum(o_orderkey) AS BIGINT) AS keys, count(*) FILTER (o_orderstatus <> 'P') AS n_p, CAST(coalesce(sum(CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 4 END), 0) AS BIGINT) AS n_items, "
    "count(*) FILTER (o_orderkey % 3 < 2) AS n_c FROM orders GROUP BY o_custkey"
)
def record_table(spark: SparkSession, sf: str) -> DataFrame:
    """orders as nested records read as a table by the schema of their merged types; what is mixed stays JSON text."""
    records = table(spark, sf, "orders").select("o_custkey", record_text().alias("text"))
    df = lattice.table_of(records, "text", ["o_custkey"])
    items = F.size(F.from_json("c", "struct<d: array<variant>>")["d"])
    return df.groupBy("o_custkey").agg(F.count("*").alias("n_records"), F.sum("k").alias("keys"), F.count("p").alias("n_p"), F.sum(F.when(F.col("c").startswith("{"), items).otherwise(0)).cast("long").alias("n_items"), F.count("c").alias("n_c"))
