"""Registered queries for views, pushdown, join orders, sources, sinks and type coercion."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.mv.catalog import Materialized
from tessella.plans import join_order, pushdown
from tessella.plans.expr import E, both, col, lit
from tessella.plans.plan import read
from tessella.queries import scratch
from tessella.queries.registry import query
from tessella.sources import coercion, files, tables

# materialized views: each query must be answered from its view, or it fails


def _answered(t, view: str, of: dict[str, str], sql: str):
    """sql with {table} names, read from the view `view` (its query with the same names)."""
    names = {k: scratch.base_table(t._spark, t._dir, k) for k in of["tables"].split()}
    mv = scratch.views(t._spark, t._dir)
    full = f"{scratch.database(t._spark)}.{view}_{names[next(iter(names))].rsplit('_', 1)[-1]}"
    mv.create_if_absent(full, of["query"].format(**names))
    got = mv.rewrite(t._spark.sql(sql.format(**names)), [full])
    if got.views != [full]:
        raise RuntimeError(f"the view does not answer the query: {got.reasons}")
    return got.df


_FILTER = "SELECT o_orderkey, o_orderpriority FROM {orders} WHERE o_totalprice > 200000 AND o_totalprice < 300000 AND o_orderstatus = 'F'"
_JOIN = "SELECT o_orderkey, n_name FROM {customer} c JOIN {nation} n ON c.c_nationkey = n.n_nationkey JOIN {orders} o ON o.o_custkey = c.c_custkey WHERE o.o_totalprice > 300000"
_ROLL = """SELECT o_orderstatus, count(*) AS n, min(o_totalprice) AS lo, max(o_totalprice) AS hi, CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) AS s
           FROM {orders} GROUP BY o_orderstatus"""
_EMPTY = "SELECT count(*) AS n, max(o_totalprice) AS hi FROM {orders} WHERE o_orderpriority = 'none'"
_OUTER = "SELECT c_custkey, o_orderkey FROM {customer} c LEFT JOIN {orders} o ON c.c_custkey = o.o_custkey WHERE c_nationkey >= 7"
_PLAIN = {k: k for k in ("orders", "customer", "nation")}
_GROUPED = {
    "tables": "orders",
    "query": """SELECT o_orderstatus, o_orderpriority, count(*) AS n, min(o_totalprice) AS lo, max(o_totalprice) AS hi, sum(CAST(o_totalprice AS DECIMAL(12,2))) AS s
                FROM {orders} GROUP BY o_orderstatus, o_orderpriority""",
}


@query(_FILTER.format(**_PLAIN))
def mv_filter(t):
    return _answered(t, "big_orders", {"tables": "orders", "query": "SELECT o_orderkey, o_orderpriority, o_orderstatus, o_totalprice FROM {orders} WHERE o_totalprice > 100000"}, _FILTER)


@query(_JOIN.format(**_PLAIN))
def mv_join(t):
    view = {"tables": "customer nation orders", "query": "SELECT c.c_custkey, n.n_name FROM {customer} c JOIN {nation} n ON c.c_nationkey = n.n_nationkey"}
    return _answered(t, "customer_nations", view, _JOIN)


@query(_ROLL.format(**_PLAIN))
def mv_rollup(t):
    return _answered(t, "order_groups", _GROUPED, _ROLL)


@query(_EMPTY.format(**_PLAIN))
def mv_rollup_of_nothing(t):
    return _answered(t, "order_groups", _GROUPED, _EMPTY)


@query(_OUTER.format(**_PLAIN))
def mv_outer_join(t):
    view = {"tables": "customer orders", "query": "SELECT c_custkey, c_nationkey, o_orderkey FROM {customer} c LEFT JOIN {orders} o ON c.c_custkey = o.o_custkey WHERE c_nationkey >= 5"}
    return _answered(t, "customer_orders", view, _OUTER)


_FILTERED = """SELECT o_orderstatus, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent, max(o_totalprice) FILTER (WHERE o_totalprice < 100000) AS hi
               FROM {orders} GROUP BY o_orderstatus"""


@query(_FILTERED.format(**_PLAIN))
def mv_filter_clause(t):
    view = {
        "tables": "orders",
        "query": """SELECT o_orderstatus, o_orderdate, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS n, max(o_totalprice) FILTER (WHERE o_totalprice < 100000) AS m
                    FROM {orders} GROUP BY o_orderstatus, o_orderdate""",
    }
    return _answered(t, "filtered_groups", view, _FILTERED)


_SAME = "SELECT o_orderstatus, o_orderpriority, count(*) + 1 AS more, max(o_totalprice) AS hi FROM {orders} GROUP BY o_orderstatus, o_orderpriority"
_SEMI = "SELECT c_custkey, c_name FROM {customer} c LEFT SEMI JOIN {orders} o ON c.c_custkey = o.o_custkey WHERE c_nationkey >= 7"
_ANTI = "SELECT c_custkey FROM {customer} c LEFT ANTI JOIN {orders} o ON c.c_custkey = o.o_custkey"
_SELF = "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM {supplier} a JOIN {nation} n ON a.s_nationkey = n.n_nationkey JOIN {supplier} b ON b.s_nationkey = n.n_nationkey AND b.s_acctbal > a.s_acctbal"


@query(_SAME.format(**_PLAIN))
def mv_same_keys(t):
    return _answered(t, "order_groups", _GROUPED, _SAME)


@query("SELECT c_custkey, c_name FROM customer WHERE c_nationkey >= 7 AND c_custkey IN (SELECT o_custkey FROM orders)")
def mv_semi_join(t):
    view = {"tables": "customer orders", "query": "SELECT c_custkey, c_name, c_nationkey FROM {customer} c LEFT SEMI JOIN {orders} o ON c.c_custkey = o.o_custkey"}
    return _answered(t, "buyers", view, _SEMI)


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def mv_anti_join(t):
    view = {"tables": "customer orders", "query": "SELECT c_custkey, c_name FROM {customer} c LEFT ANTI JOIN {orders} o ON c.c_custkey = o.o_custkey"}
    return _answered(t, "idle", view, _ANTI)


@query(_SELF.format(supplier="supplier", nation="nation"))
def mv_self_join(t):
    view = {"tables": "supplier nation", "query": "SELECT s.s_suppkey, s.s_acctbal, s.s_nationkey, n.n_nationkey FROM {supplier} s JOIN {nation} n ON s.s_nationkey = n.n_nationkey"}
    return _answered(t, "supplier_nations", view, _SELF)


# statements of views: each in a database of its own


def _own(t, *tables: str):
    """(views of a new database, its name), with copies of the tables' first columns as its base tables."""
    name = f"{scratch.database(t._spark)}_{scratch.table_name(t._spark).rsplit('.', 1)[-1]}"
    t._spark.sql(f"CREATE DATABASE {name}")
    for table in tables:
        getattr(t, table).write.format("parquet").saveAsTable(f"{name}.{table}")
    return Materialized(t._spark, databases=[name]), name


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_totalprice > 200000")
def mv_ctas(t):
    mv, db = _own(t, "orders")
    mv.sql(f"CREATE MATERIALIZED VIEW {db}.v AS SELECT o_orderkey, o_orderpriority, o_totalprice FROM {db}.orders WHERE o_totalprice > 100000")
    mv.sql(f"CREATE TABLE {db}.made USING parquet AS SELECT o_orderkey, o_orderpriority FROM {db}.orders WHERE o_totalprice > 200000")
    return _used(mv, f"{db}.v", t._spark.table(f"{db}.made"))


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > 200000 UNION ALL SELECT o_orderkey FROM orders WHERE o_totalprice > 300000")
def mv_insert(t):
    mv, db = _own(t, "orders")
    mv.sql(f"CREATE MATERIALIZED VIEW {db}.v AS SELECT o_orderkey, o_totalprice FROM {db}.orders WHERE o_totalprice > 100000")
    mv.sql(f"CREATE TABLE {db}.made (o_orderkey BIGINT) USING parquet")
    for least in (200_000, 300_000):
        mv.sql(f"INSERT INTO {db}.made SELECT o_orderkey FROM {db}.orders WHERE o_totalprice > {least}")
    return _used(mv, f"{db}.v", t._spark.table(f"{db}.made"), 2)


def _used(mv, view: str, df, times: int = 1):
    if int(mv.properties(view)["uses"]) != times:
        raise RuntimeError(f"{view} was used {mv.properties(view)['uses']} times")
    return df


@query("SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal > 0 UNION ALL SELECT -1, 5.0")
def mv_refresh(t):
    mv, db = _own(t, "supplier")
    mv.sql(f"CREATE MATERIALIZED VIEW {db}.v AS SELECT s_suppkey, s_acctbal FROM {db}.supplier WHERE s_acctbal > 0")
    mv.sql(f"INSERT INTO {db}.supplier SELECT -1, 'new', 0, 5.0")
    if not mv.stale(f"{db}.v"):
        raise RuntimeError("the view counts as fresh")
    mv.sql(f"REFRESH MATERIALIZED VIEW {db}.v")
    return t._spark.table(f"{db}.v")


@query("SELECT * FROM (VALUES ('kept', true, 'SELECT n_nationkey'), ('off', false, 'SELECT n_name')) AS v(view, rewriting, query)")
def mv_show_and_alter(t):
    mv, db = _own(t, "nation")
    for name, column in (("kept", "n_nationkey"), ("off", "n_name"), ("gone", "n_regionkey")):
        mv.sql(f"CREATE MATERIALIZED VIEW {db}.{name} AS SELECT {column} FROM {db}.nation")
    mv.sql(f"ALTER MATERIALIZED VIEW {db}.off DISABLE REWRITE")
    mv.sql(f"DROP MATERIALIZED VIEW {db}.gone")
    return mv.sql(f"SHOW MATERIALIZED VIEWS IN {db}").select(F.col("mvName").alias("view"), F.col("rewriteEnable").alias("rewriting"), F.substring_index("originalSql", " FROM", 1).alias("query"))


@query("SELECT * FROM (VALUES ('b'), ('c')) AS v(view)")
def mv_wash_out(t):
    """Of three views, the most used one stays."""
    mv, db = _own(t, "nation")
    for name, least in (("a", 0), ("b", 1), ("c", 2)):
        mv.sql(f"CREATE MATERIALIZED VIEW {db}.{name} AS SELECT n_nationkey, n_regionkey * {least + 1} AS r FROM {db}.nation")
    mv.sql(f"SELECT n_nationkey FROM {db}.nation")
    most = max(mv.names(), key=lambda v: int(mv.properties(v)["uses"]))
    if most != f"{db}.a":
        raise RuntimeError(f"{most} was used")
    return mv.sql(f"WASH OUT MATERIALIZED VIEW IN {db} USING RESERVE_QUANTITY_BY_VIEW_COUNT 1").select(F.substring_index("view", ".", -1).alias("view"))


@query("SELECT 'v' AS view, 1 AS answered")
def mv_explain(t):
    mv, db = _own(t, "nation")
    mv.sql(f"CREATE MATERIALIZED VIEW {db}.v AS SELECT n_nationkey, n_name FROM {db}.nation WHERE n_nationkey > 1")
    said = mv.sql(f"EXPLAIN SELECT n_name FROM {db}.nation WHERE n_nationkey > 3").where("item = 'views'")
    return said.select(F.substring_index("said", ".", -1).alias("view"), F.lit(1).alias("answered"))


# pushdown to the source: a query fails unless its plan shows the decision


def _scanned(df, pushed: list[str], kept: list[str]):
    """df, whose scan must have filters on the columns `pushed` and none on `kept`."""
    leaves = df._jdf.queryExecution().sparkPlan().collectLeaves()
    shown = " ".join(str(leaves.apply(k).metadata().apply("PushedFilters")) for k in range(leaves.size()))
    for c in pushed:
        if f"({c}," not in shown:
            raise RuntimeError(f"no filter on {c} at the source: {shown}")
    for c in kept:
        if any(f"{kind}({c}," in shown for kind in ("StringStartsWith", "StringContains", "GreaterThan", "LessThan", "EqualTo", "In")):
            raise RuntimeError(f"a filter on {c} at the source: {shown}")
    return df


@query("SELECT o_orderpriority, count(*) AS n, max(o_totalprice) AS hi FROM orders WHERE o_totalprice < 50000 AND o_orderstatus = 'F' GROUP BY o_orderpriority")
def pushdown_of_query(t):
    """Decided from the query's own plan and the statistics that ANALYZE left in the catalog."""
    name = scratch.table_name(t._spark)
    files.save(t.orders, name)
    tables.analyze(t._spark, name)
    asked = t._spark.sql(f"SELECT o_orderpriority, count(*) AS n, max(o_totalprice) AS hi FROM {name} WHERE o_totalprice < 50000 AND o_orderstatus = 'F' GROUP BY o_orderpriority")
    table, plan = pushdown.of_query(asked)
    if not plan.partial_pushed or len(plan.pushed_filters) < 2:
        raise RuntimeError(plan.explain())
    return _scanned(plan.apply(t._spark.table(table)), ["o_totalprice", "o_orderstatus"], [])


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > 1000")
def pushdown_kept(t):
    """The catalog's statistics say that the filter keeps nearly all rows: it stays above the scan."""
    name = scratch.table_name(t._spark)
    files.save(t.orders, name)
    tables.analyze(t._spark, name, ["o_totalprice"])
    table, plan = pushdown.of_query(t._spark.sql(f"SELECT o_orderkey FROM {name} WHERE o_totalprice > 1000"))
    if plan.pushed_filters:
        raise RuntimeError(plan.explain())
    return _scanned(plan.apply(t._spark.table(table)), [], ["o_totalprice"])


@query("SELECT l_returnflag, count(*) AS n, min(l_quantity) AS lo, max(l_extendedprice) AS hi FROM lineitem WHERE l_quantity < 10 AND l_linestatus = 'O' GROUP BY l_returnflag")
def pushdown_filter_aggregate(t):
    scan = pushdown.scan_of(t.lineitem, statistics=["l_quantity", "l_linestatus", "l_returnflag"])
    where = both(E("<", (col("l_quantity"), lit(10.0, "double"))), E("=", (col("l_linestatus"), lit("O", "string"))))
    made = [pushdown.Aggregate("count", None, "n"), pushdown.Aggregate("min", col("l_quantity"), "lo"), pushdown.Aggregate("max", col("l_extendedprice"), "hi")]
    return _scanned(pushdown.decide(scan, where, keys=["l_returnflag"], aggregates=made).apply(t.lineitem), ["l_quantity", "l_linestatus"], [])


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority LIKE '1%' AND o_totalprice > 100000")
def pushdown_residual(t):
    scan = pushdown.scan_of(t.orders, statistics=["o_totalprice"])
    where = both(E("like", (col("o_orderpriority"), lit("1%", "string"))), E(">", (col("o_totalprice"), lit(100000.0, "double"))))
    return _scanned(pushdown.decide(scan, where, columns=["o_orderkey", "o_totalprice"]).apply(t.orders), [], ["o_orderpriority"])


@query("SELECT count(*) AS n FROM (SELECT * FROM events LIMIT 33)")
def pushdown_limit(t):
    return pushdown.decide(pushdown.scan_of(t.events), columns=["event_id"], limit=33).apply(t.events).agg(F.count("*").alias("n"))


# join orders

_CHAIN = """SELECT n_name, count(*) AS n FROM customer, orders, nation, lineitem
            WHERE c_custkey = o_custkey AND c_nationkey = n_nationkey AND l_orderkey = o_orderkey AND n_name < 'J' AND o_totalprice > 200000 GROUP BY n_name"""


@query(_CHAIN)
def join_order_heuristic(t):
    R, C = join_order.Relation, join_order.Condition
    orders, nation = t.orders.where("o_totalprice > 200000"), t.nation.where("n_name < 'J'")
    relations = [R("customer", t.customer, 2), R("orders", orders, 3, True), R("nation", nation, 1, True), R("lineitem", t.lineitem, 4)]
    conditions = [
        C(frozenset({"customer", "orders"}), F.col("c_custkey") == F.col("o_custkey")), C(frozenset({"customer", "nation"}), F.col("c_nationkey") == F.col("n_nationkey")),
        C(frozenset({"lineitem", "orders"}), F.col("l_orderkey") == F.col("o_orderkey")),
    ]
    return join_order.heuristic_order(relations, conditions).build().groupBy("n_name").agg(F.count("*").alias("n"))


@query("""SELECT r_name, count(*) AS n FROM region, supplier, nation WHERE n_regionkey = r_regionkey AND n_nationkey < 5 GROUP BY r_name""")
def join_delay_cartesian(t):
    R, C = join_order.Relation, join_order.Condition
    relations = [R("region", t.region), R("supplier", t.supplier), R("nation", t.nation.where("n_nationkey < 5"), filtered=True)]
    plan = join_order.delay_cartesian(relations, [C(frozenset({"nation", "region"}), F.col("n_regionkey") == F.col("r_regionkey"))])
    return plan.build().groupBy("r_name").agg(F.count("*").alias("n"))


@query(_CHAIN)
def join_order_of_plan(t):
    """The joins of a query's own plan, put in order by the sizes that the optimizer knows."""
    names = {k: scratch.base_table(t._spark, t._dir, k) for k in ("customer", "orders", "nation", "lineitem")}
    sql = _CHAIN
    for k, full in names.items():
        sql = sql.replace(f" {k}, ", f" {full} {k}, ").replace(f" {k}\n", f" {full} {k}\n")
    df = t._spark.sql(sql)
    order = [n.detail.rsplit(".", 1)[-1].split("_")[0] for n in join_order.reordered(t._spark, read(df)).walk() if n.op == "table"]
    if order[:2] != ["customer", "nation"]:
        raise RuntimeError(f"the small filtered relation is not joined first: {order}")
    return join_order.reorder(df)


# sources and sinks: what is written is what is read

_PARTS = "SELECT p_partkey, p_name, p_size, p_retailprice FROM part"


def _register_formats():
    for name, options in {"parquet": {}, "orc": {}, "json": {}, "csv": {"header": "true"}}.items():

        def run(t, name=name, options=options):
            df = t.part.select("p_partkey", "p_name", "p_size", "p_retailprice")
            path = scratch.folder(t._spark)
            df.write.format(name).options(**options).save(path)
            return files.read(t._spark, path, name, df.schema, **options)

        query(_PARTS, f"source_{name}")(run)


_register_formats()


@query("SELECT p_name FROM part")
def source_text(t):
    path = scratch.folder(t._spark)
    t.part.select("p_name").write.text(path)
    return files.read(t._spark, path, "text").select(F.col("value").alias("p_name"))


@query("SELECT p_partkey, p_name, CASE WHEN p_size > 25 THEN NULL ELSE p_size END AS p_size FROM part")
def source_multidelimited(t):
    path = scratch.folder(t._spark)
    lines = F.concat_ws("|+|", F.col("p_partkey").cast("string"), "p_name", F.when(F.col("p_size") > 25, "").otherwise(F.col("p_size").cast("string")))
    t.part.select(lines.alias("value")).write.text(path)
    return files.read(t._spark, path, "multidelimited", "p_partkey long, p_name string, p_size int", delimiter="|+|")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (1, 7, 32, 100, 999999999)")
def source_point_lookup(t):
    path = scratch.folder(t._spark)
    files.sorted_copy(t.orders.select("o_orderkey", "o_totalprice"), path, "o_orderkey", 4)
    return files.point_lookup(t._spark.read.parquet(path), "o_orderkey", [1, 7, 32, 100, 999999999])


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 400")
def source_key_range(t):
    path = scratch.folder(t._spark)
    files.sorted_copy(t.orders.select("o_orderkey", "o_totalprice"), path, "o_orderkey", 4)
    return files.key_range(t._spark.read.parquet(path), "o_orderkey", 100, 400)


@query("SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderstatus = 'P'")
def source_partition_pruning(t):
    name = scratch.table_name(t._spark)
    files.save(t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus"), name, files.Layout(partition_by=["o_orderstatus"]))
    return t._spark.table(name).where("o_orderstatus = 'P'")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 0.0::DOUBLE ELSE o_totalprice END AS o_totalprice, o_orderstatus FROM orders")
def sink_overwrite_partitions(t):
    name = scratch.table_name(t._spark)
    rows = t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus")
    files.save(rows, name, files.Layout(partition_by=["o_orderstatus"]))
    files.save(rows.where("o_orderstatus = 'P'").withColumn("o_totalprice", F.lit(0.0)), name, files.Layout(partition_by=["o_orderstatus"]), mode="overwrite")
    return t._spark.table(name)


@query("SELECT c_custkey FROM customer UNION ALL SELECT c_custkey FROM customer WHERE c_custkey < 100")
def sink_append(t):
    name = scratch.table_name(t._spark)
    files.save(t.customer.select("c_custkey"), name)
    files.save(t.customer.select("c_custkey").where("c_custkey < 100"), name, mode="append")
    return t._spark.table(name)


@query("SELECT o_orderkey, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def sink_bucketed_join(t):
    """Both tables in buckets of the key: the join and the aggregate need no exchange."""
    a, b = scratch.table_name(t._spark), scratch.table_name(t._spark)
    files.save(t.orders.select("o_orderkey"), a, files.Layout(bucket_by=["o_orderkey"], buckets=8, sort_by=["o_orderkey"]))
    files.save(t.lineitem.select("l_orderkey"), b, files.Layout(bucket_by=["l_orderkey"], buckets=8, sort_by=["l_orderkey"]))
    joined = t._spark.table(a).join(t._spark.table(b).hint("merge"), F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.groupBy("o_orderkey").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, c_mktsegment, CASE WHEN c_custkey % 10 = 3 THEN 1.5::DOUBLE ELSE c_acctbal END AS c_acctbal FROM customer WHERE NOT (c_custkey % 10 = 4 OR c_mktsegment = 'BUILDING')")
def table_update_delete(t):
    name = scratch.table_name(t._spark)
    files.save(t.customer.select("c_custkey", "c_acctbal", "c_mktsegment"), name, files.Layout(partition_by=["c_mktsegment"]))
    tables.update(t._spark, name, {"c_acctbal": F.lit(1.5)}, F.col("c_custkey") % 10 == 3)
    tables.delete(t._spark, name, (F.col("c_custkey") % 10 == 4) | (F.col("c_mktsegment") == "BUILDING"))
    tables.compact(t._spark, name)
    return t._spark.table(name).select("c_custkey", "c_mktsegment", "c_acctbal")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0")
def table_merge_on_read(t):
    gone = t.orders.where("o_orderkey % 3 = 0").select("o_orderkey")
    return tables.without_deleted(t.orders.select("o_orderkey"), gone.unionAll(gone), ["o_orderkey"])


@query("SELECT s_suppkey, s_name AS label FROM supplier")
def table_alter_columns(t):
    name = scratch.table_name(t._spark)
    files.save(t.supplier.select("s_suppkey", "s_name", "s_acctbal"), name)
    tables.rename_column(t._spark, name, "s_name", "label")
    tables.drop_column(t._spark, name, "s_acctbal")
    return t._spark.table(name)


@query("SELECT 'full' AS step, 3::BIGINT AS n UNION ALL SELECT 'dropped', 2 UNION ALL SELECT 'empty', 3")
def partition_procedures(t):
    """Folders without a partition are found, partitions without a folder are dropped, and an empty partition is made."""
    spark, name = t._spark, scratch.table_name(t._spark)
    files.save(t.orders.select("o_orderkey", "o_orderstatus"), name, files.Layout(partition_by=["o_orderstatus"]))
    n = lambda: spark.sql(f"SHOW PARTITIONS {name}").count()
    spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ('x' = 'y')")
    tables.sync_partitions(spark, name)
    found = [("full", n())]
    spark.sql(f"ALTER TABLE {name} DROP PARTITION (o_orderstatus = 'P')")
    tables.sync_partitions(spark, name, "drop")
    found.append(("dropped", n()))
    tables.create_empty_partition(spark, name, o_orderstatus="P")
    found.append(("empty", n()))
    return spark.createDataFrame(found, "step string, n bigint")


@query("SELECT s_suppkey, CAST(s_nationkey AS VARCHAR) AS nation, s_acctbal AS bal, [CAST(s_nationkey AS BIGINT)] AS keys FROM supplier")
def coerced_nested(t):
    from pyspark.sql import types as T

    stored = t.supplier.select(F.col("s_suppkey"), F.struct(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("bal")).alias("s"), F.array("s_nationkey").alias("keys"))
    out = coercion.coerce_to(stored, T.StructType.fromDDL("s_suppkey bigint, s struct<nation: string, bal: double>, keys array<bigint>"))
    return out.select("s_suppkey", "s.nation", "s.bal", "keys")


@query("SELECT p_partkey::BIGINT AS k, p_size::BIGINT AS p_size, left(p_brand, 6) AS brand, p_retailprice AS price, NULL::BIGINT AS absent FROM part")
def coerced_partitions(t):
    stored = t.part.select(F.col("p_partkey").cast("string").alias("k"), "p_size", F.col("p_brand").alias("brand"), F.col("p_retailprice").alias("price"))
    schema = "k bigint, p_size bigint, brand varchar(6), price double, absent bigint"
    from pyspark.sql import types as T

    return coercion.coerce_to(stored, T.StructType.fromDDL(schema))
