"""Set operations over tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators.verify import multiset_difference, symmetric_difference
from tidewatch.queries.registry import query, table


@query(
    "g01_union_all",
    "SELECT c_nationkey AS nationkey, c_acctbal AS acctbal FROM customer UNION ALL SELECT s_nationkey, s_acctbal FROM supplier",
)
def union_all(spark, sf):
    customer, supplier = table(spark, sf, "customer"), table(spark, sf, "supplier")
    names = [F.col("c_nationkey").alias("nationkey"), F.col("c_acctbal").alias("acctbal")]
    return customer.select(*names).unionByName(
        supplier.select(F.col("s_nationkey").alias("nationkey"), F.col("s_acctbal").alias("acctbal"))
    )


@query(
    "g02_except",
    "SELECT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F'"
    " EXCEPT SELECT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'O'",
)
def set_except(spark, sf):
    orders, names = table(spark, sf, "orders"), ["o_custkey", "o_orderpriority"]
    finished, still_open = orders.where("o_orderstatus = 'F'"), orders.where("o_orderstatus = 'O'")
    return finished.select(*names).subtract(still_open.select(*names))


@query(
    "g03_symmetric_difference",
    """
    WITH e AS (SELECT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus <> 'F'),
    a AS (SELECT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus <> 'O')
    SELECT 'left' AS side, * FROM (SELECT * FROM e EXCEPT SELECT * FROM a)
    UNION ALL SELECT 'right', * FROM (SELECT * FROM a EXCEPT SELECT * FROM e)
    """,
)
def symmetric(spark, sf):
    orders, names = table(spark, sf, "orders"), ["o_custkey", "o_orderpriority"]
    expected, actual = orders.where("o_orderstatus <> 'F'"), orders.where("o_orderstatus <> 'O'")
    return symmetric_difference(expected.select(*names), actual.select(*names))


@query(
    "g04_multiset_difference",
    """
    WITH e AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL),
    a AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem WHERE l_returnflag <> 'R' GROUP BY ALL)
    SELECT e.l_orderkey, e.l_linenumber, e.n - coalesce(a.n, 0) AS surplus FROM e
    LEFT JOIN a ON e.l_orderkey = a.l_orderkey AND e.l_linenumber = a.l_linenumber WHERE e.n <> coalesce(a.n, 0)
    """,
)
def multiset(spark, sf):
    lines = table(spark, sf, "lineitem")
    kept = lines.where("l_returnflag <> 'R'").select("l_orderkey", "l_linenumber")
    return multiset_difference(lines.select("l_orderkey", "l_linenumber"), kept)


@query("g05_set_union", "SELECT o_custkey AS custkey FROM orders UNION SELECT c_custkey FROM customer")
def set_union(spark, sf):
    ordered = table(spark, sf, "orders").select(F.col("o_custkey").alias("custkey")).distinct()
    return ordered.unionByName(table(spark, sf, "customer").select(F.col("c_custkey").alias("custkey"))).distinct()


@query(
    "g06_set_difference",
    "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49"
    " AND l_partkey IS NOT NULL)",
)
def set_difference(spark, sf):
    used = table(spark, sf, "lineitem").where("l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf, "part").select("p_partkey").join(used, "p_partkey", "left_anti")


@query(
    "g07_concat_flatten",
    "SELECT o_orderkey, 'status' AS kind, o_orderstatus AS child FROM orders"
    " UNION ALL SELECT o_orderkey, 'priority', o_orderpriority FROM orders"
    " UNION ALL SELECT o_orderkey, 'priority', 'large' FROM orders WHERE o_totalprice > 400000",
)
def concat_flatten(spark, sf):
    large = F.when(F.col("o_totalprice") > 400000, F.array(F.lit("large"))).otherwise(F.array().cast("array<string>"))
    lists = F.flatten(
        F.array(
            F.array(F.struct(F.lit("status").alias("kind"), F.col("o_orderstatus").alias("child"))),
            F.transform(
                F.concat(F.array("o_orderpriority"), large), lambda c: F.struct(F.lit("priority").alias("kind"), c.alias("child"))
            ),
        )
    )
    return table(spark, sf, "orders").select("o_orderkey", F.inline(lists))
