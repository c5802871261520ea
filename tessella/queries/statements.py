"""Registered queries written in SQL: whole statements of the kinds that reporting workloads run, and DDL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.queries import scratch
from tessella.queries.registry import query
from tessella.sources import files, tables

_TABLES = "region nation customer supplier part orders lineitem events".split()


def run(t, statement: str) -> DataFrame:
    """The statement with its table names (never inside literals) bound to the tables' DataFrames; nothing is registered in the session."""
    used = [n for n in _TABLES if re.search(rf"\b{n}\b", statement)]
    text = re.sub(rf"\b({'|'.join(used)})\b", r"{\1}", statement)
    return t._spark.sql(text, **{n: getattr(t, n) for n in used})


def statement(name: str, sql: str, oracle: str | None = None) -> None:
    query(oracle or sql, name)(lambda t: run(t, sql))


PRICE, DISCOUNT = "CAST(l_extendedprice AS DECIMAL(12,2))", "CAST(l_discount AS DECIMAL(4,2))"

statement(
    "sql_shipping_priority",
    f"""SELECT l_orderkey, CAST(sum({PRICE} * (1 - {DISCOUNT})) AS DOUBLE) AS revenue, CAST(o_orderdate AS DATE) AS day
        FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
        WHERE c_mktsegment = 'BUILDING' AND o_orderdate < DATE '1999-03-15' AND l_shipdate > DATE '1998-03-15'
        GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10""",
)
statement(
    "sql_local_supplier_volume",
    f"""SELECT n_name, CAST(sum({PRICE} * (1 - {DISCOUNT})) AS DOUBLE) AS revenue
        FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey
             JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
        WHERE r_name = 'ASIA' GROUP BY n_name""",
)
statement(
    "sql_forecast_revenue",
    f"""SELECT CAST(sum({PRICE} * {DISCOUNT}) AS DOUBLE) AS revenue, count(*) AS n FROM lineitem
        WHERE l_shipdate >= DATE '1997-01-01' AND l_shipdate < DATE '1998-01-01' AND {DISCOUNT} BETWEEN 0.05 AND 0.07 AND l_quantity < 24""",
)
statement(
    "sql_order_priority_exists",
    """SELECT o_orderpriority, count(*) AS n FROM orders
       WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 49)
       GROUP BY o_orderpriority""",
)
statement(
    "sql_returned_items",
    f"""SELECT c_custkey, c_name, CAST(sum({PRICE} * (1 - {DISCOUNT})) AS DOUBLE) AS revenue, n_name
        FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey
        WHERE l_returnflag = 'R' GROUP BY c_custkey, c_name, n_name ORDER BY revenue DESC, c_custkey LIMIT 20""",
)
statement(
    "sql_pivot_case",
    """SELECT l_linestatus, CAST(sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS high, CAST(sum(CASE WHEN o_orderpriority LIKE '5%' THEN 1 ELSE 0 END) AS BIGINT) AS low
       FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY l_linestatus""",
)
statement(
    "sql_left_join_distribution",
    """SELECT n_orders, count(*) AS n_customers FROM (
         SELECT c_custkey, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority NOT LIKE '%URGENT%' GROUP BY c_custkey) c
       GROUP BY n_orders""",
)
statement(
    "sql_cte_top_supplier",
    f"""WITH revenue AS (SELECT l_suppkey AS k, sum({PRICE} * (1 - {DISCOUNT})) AS r FROM lineitem WHERE l_shipdate >= DATE '1996-01-01' GROUP BY l_suppkey)
        SELECT s_suppkey, s_name, CAST(r AS DOUBLE) AS revenue FROM supplier JOIN revenue ON s_suppkey = k WHERE r = (SELECT max(r) FROM revenue)""",
)
statement(
    "sql_large_volume_in_subquery",
    """SELECT c_name, o_orderkey, o_totalprice, CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DOUBLE) AS quantity
       FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey
       WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 150)
       GROUP BY c_name, o_orderkey, o_totalprice""",
)
statement(
    "sql_correlated_average",
    """SELECT l_partkey, count(*) AS n FROM lineitem l WHERE l_quantity < (SELECT 0.4 * CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DOUBLE) / count(*) FROM lineitem i WHERE i.l_partkey = l.l_partkey) GROUP BY l_partkey""",
)
statement(
    "sql_idle_customers",
    """SELECT substr(c_mktsegment, 1, 2) AS code, count(*) AS n, CAST(sum(CAST(c_acctbal AS DECIMAL(12,2))) AS DOUBLE) AS balance FROM customer
       WHERE c_acctbal > (SELECT CAST(sum(CAST(c_acctbal AS DECIMAL(12,2))) AS DOUBLE) / count(*) FROM customer WHERE c_acctbal > 0)
         AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000) GROUP BY substr(c_mktsegment, 1, 2)""",
)
statement(
    "sql_window_over_aggregate",
    """SELECT n_name, total, share, rnk FROM (
         SELECT n_name, total, total / sum(total) OVER () AS share, CAST(rank() OVER (ORDER BY total DESC) AS BIGINT) AS rnk FROM (
           SELECT n_name, CAST(count(*) AS DOUBLE) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name) a) b WHERE rnk <= 5""",
)
statement(
    "sql_rollup_with_labels",
    """SELECT CASE WHEN grouping(c_mktsegment) = 1 THEN 'all' ELSE c_mktsegment END AS segment, CASE WHEN grouping(o_orderstatus) = 1 THEN 'all' ELSE o_orderstatus END AS status, count(*) AS n
       FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY ROLLUP (c_mktsegment, o_orderstatus)""",
)
statement(
    "sql_channels_set_operations",
    """SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 0 INTERSECT SELECT s_nationkey FROM supplier EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 1""",
)
statement(
    "sql_year_over_year",
    """WITH y AS (SELECT CAST(year(o_orderdate) AS INT) AS y, count(*) AS n FROM orders GROUP BY year(o_orderdate))
       SELECT a.y, a.n, a.n - b.n AS more FROM y a LEFT JOIN y b ON a.y = b.y + 1""",
)
statement(
    "sql_distinct_and_union",
    """SELECT kind, count(DISTINCT k) AS n FROM (SELECT 'c' AS kind, c_nationkey AS k FROM customer UNION ALL SELECT 's', s_nationkey FROM supplier UNION ALL SELECT '-', NULL) u GROUP BY kind""",
)
statement(
    "sql_sessions",
    """SELECT user_id, CAST(sum(fresh) AS BIGINT) AS sessions FROM (
         SELECT user_id, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL OR ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL '1' DAY THEN 1 ELSE 0 END AS fresh
         FROM events) e GROUP BY user_id""",
)


# tables of the catalog


@query("SELECT c_custkey, c_name, NULL::INTEGER AS vip FROM customer WHERE c_acctbal > 9000")
def ddl_statements(t):
    """Creating, commenting, renaming and widening a table, and a view over it."""
    spark, db = t._spark, scratch.database(t._spark)
    a, b, v = (scratch.table_name(spark) for _ in range(3))
    spark.sql(f"CREATE TABLE {a} (c_custkey BIGINT, c_name STRING, c_acctbal DOUBLE) USING parquet COMMENT 'customers'")
    t.customer.select("c_custkey", "c_name", "c_acctbal").write.insertInto(a)
    spark.sql(f"ALTER TABLE {a} RENAME TO {b}")
    spark.sql(f"ALTER TABLE {b} ADD COLUMNS (vip INT COMMENT 'later')")
    spark.sql(f"COMMENT ON TABLE {b} IS 'renamed'")
    spark.sql(f"CREATE VIEW {v} AS SELECT c_custkey, c_name, vip FROM {b} WHERE c_acctbal > 9000")
    assert db in v
    return spark.table(v)


@query("SELECT count(*) AS rows, count(DISTINCT o_orderstatus) AS statuses FROM orders")
def analyze_statistics(t):
    name = scratch.table_name(t._spark)
    files.save(t.orders.select("o_orderkey", "o_orderstatus"), name)
    tables.analyze(t._spark, name, ["o_orderstatus"])
    said = t._spark.sql(f"DESCRIBE EXTENDED {name}").where("col_name = 'Statistics'").first().data_type
    rows = int(re.search(r"(\d+) rows", said)[1])
    distinct = int(tables.column_statistics(t._spark, name, "o_orderstatus")["distinct_count"])
    return t._spark.range(1).select(F.lit(rows).cast("long").alias("rows"), F.lit(distinct).cast("long").alias("statuses"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag IN (SELECT CASE WHEN n_nationkey = 3 THEN 'R' END FROM nation WHERE n_nationkey = 3)")
def dynamic_partition_pruning(t):
    """Partitions of the large side are pruned at run time by the small side's keys."""
    name = scratch.table_name(t._spark)
    files.save(t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag"), name, files.Layout(partition_by=["l_returnflag"]))
    keys = t.nation.where("n_nationkey = 3").select(F.when(F.col("n_nationkey") == 3, "R").alias("k"))
    return t._spark.table(name).join(F.broadcast(keys), F.col("l_returnflag") == F.col("k")).select("l_orderkey", "l_linenumber")  # one row is sent
