"""Registered queries for projections, joins, aggregates, windows, sorting, set operations and exchanges."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.operators import aggregates as agg
from tessella.operators import joins, rows, windows
from tessella.queries.registry import query

def cents(c: str):
    """Money as an exact decimal, so that sums do not depend on their order."""
    return F.col(c).cast("decimal(18,2)")


def dsum(c):
    return F.sum(c).cast("double")


# flagship


@query("""
    SELECT n_name, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue, count(*) AS n_orders
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    WHERE o_orderstatus = 'F' GROUP BY n_name ORDER BY revenue DESC, n_name LIMIT 10""")
def flagship_revenue_by_nation(t):
    orders = t.orders.where("o_orderstatus = 'F'").select("o_custkey", "o_totalprice")
    joined = orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(joins.broadcast_checked(t.nation), F.col("c_nationkey") == F.col("n_nationkey"))
    out = joined.groupBy("n_name").agg(dsum(cents("o_totalprice")).alias("revenue"), F.count("*").alias("n_orders"))
    return rows.top_n(out, [F.desc("revenue"), "n_name"], 10)


@query("""
    SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sum_qty,
           CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE) AS sum_disc_price,
           CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) / count(l_quantity) AS avg_qty, count(*) AS n
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-06-01' GROUP BY 1, 2""")
def pricing_summary(t):
    price = cents("l_extendedprice") * (1 - F.col("l_discount").cast("decimal(4,2)"))
    return (
        t.lineitem.where(F.col("l_shipdate") <= F.lit("2001-06-01").cast("timestamp_ntz"))
        .groupBy("l_returnflag", "l_linestatus")
        .agg(dsum(cents("l_quantity")).alias("sum_qty"), dsum(price).alias("sum_disc_price"), (dsum(cents("l_quantity")) / F.count("l_quantity")).alias("avg_qty"), F.count("*").alias("n"))
    )


# projections and filters


@query("SELECT l_orderkey, l_linenumber, l_quantity * 2 AS twice, upper(l_returnflag) AS flag FROM lineitem")
def project(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", (F.col("l_quantity") * 2).alias("twice"), F.upper("l_returnflag").alias("flag"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 45 AND l_returnflag <> 'N'")
def filter_rows(t):
    return t.lineitem.where((F.col("l_quantity") > 45) & (F.col("l_returnflag") != "N")).select("l_orderkey", "l_linenumber")


@query("SELECT o_orderkey, o_totalprice + 1 AS price FROM orders WHERE o_orderpriority LIKE '1%' AND o_totalprice BETWEEN 1000 AND 200000")
def filter_project(t):
    kept = F.col("o_orderpriority").like("1%") & F.col("o_totalprice").between(1000, 200000)
    return t.orders.where(kept).select("o_orderkey", (F.col("o_totalprice") + 1).alias("price"))


@query("SELECT c_custkey AS k, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal < 0")
def project_over_join(t):
    joined = joins.join(t.customer.where("c_acctbal < 0"), t.nation, F.col("c_nationkey") == F.col("n_nationkey"), strategy="broadcast")
    return joined.select(F.col("c_custkey").alias("k"), F.col("n_name").alias("nation"))


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) * 1.5 FROM orders)")
def scalar_subquery(t):
    mean = agg.single_row(t.orders.agg((dsum(cents("o_totalprice")) / F.count("*") * 1.5).alias("m")))
    return t.orders.crossJoin(F.broadcast(mean)).where("o_totalprice > m").select("o_orderkey")  # one row is sent


@query("SELECT c_custkey FROM customer WHERE c_acctbal > (SELECT CAST(NULL AS DOUBLE))")
def scalar_subquery_empty(t):
    none = agg.single_row(t.customer.where("c_custkey < 0").select("c_acctbal").withColumnRenamed("c_acctbal", "m"))
    return t.customer.crossJoin(F.broadcast(none)).where("c_acctbal > m").select("c_custkey")  # one row is sent


@query("""SELECT l_orderkey, l_linenumber FROM lineitem
          WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 7) AND l_quantity < 10""")
def dynamic_filter(t):
    keys = t.part.where("p_size = 7").select("p_partkey")
    return t.lineitem.where("l_quantity < 10").join(keys, F.col("l_partkey") == F.col("p_partkey"), "left_semi").select("l_orderkey", "l_linenumber")


_STAR = """
    SELECT n_name, p_brand, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey
         JOIN nation ON s_nationkey = n_nationkey {more}
    WHERE l_quantity > 25 AND p_size < 20 {where} GROUP BY n_name, p_brand"""


def _star(t):
    lines = t.lineitem.where("l_quantity > 25").select("l_suppkey", "l_partkey", "l_extendedprice")
    dims = lines.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(t.part.where("p_size < 20"), F.col("l_partkey") == F.col("p_partkey"))
    return dims.join(joins.broadcast_checked(t.nation), F.col("s_nationkey") == F.col("n_nationkey"))


@query(_STAR.format(more="", where=""))
def star_three_joins(t):
    return _star(t).groupBy("n_name", "p_brand").agg(dsum(cents("l_extendedprice")).alias("revenue"))


@query(_STAR.format(more="JOIN region ON n_regionkey = r_regionkey", where="AND r_name <> 'ASIA'"))
def star_four_joins(t):
    region = joins.broadcast_checked(t.region.where("r_name <> 'ASIA'"))
    return _star(t).join(region, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("n_name", "p_brand").agg(dsum(cents("l_extendedprice")).alias("revenue"))


# joins: left side customers, right side orders of high value

_ON = "c_custkey = o_custkey"
_BIG = "(SELECT * FROM orders WHERE o_totalprice > 250000)"


def _sides(t):
    return t.customer.select("c_custkey", "c_nationkey"), t.orders.where("o_totalprice > 250000").select("o_orderkey", "o_custkey", "o_totalprice")


def _register_joins():
    kinds = {
        "inner": ("JOIN", "c_custkey, o_orderkey"),
        "left": ("LEFT JOIN", "c_custkey, o_orderkey"),
        "right": ("RIGHT JOIN", "c_custkey, o_orderkey"),
        "full": ("FULL JOIN", "c_custkey, o_orderkey"),
        "left_semi": ("SEMI JOIN", "c_custkey"),
        "left_anti": ("ANTI JOIN", "c_custkey"),
    }
    for strategy, hows in {
        "broadcast": ("inner", "left", "left_semi"),
        "shuffled_hash": ("inner", "left", "full", "left_semi", "left_anti"),
        "sort_merge": ("inner", "left", "right", "full", "left_semi", "left_anti"),
    }.items():
        for how in hows:
            words, out = kinds[how]
            names = out.split(", ")

            def plain(t, how=how, strategy=strategy, names=names):
                a, b = _sides(t)
                return joins.join(a, b, F.expr(_ON), how, strategy).select(*names)

            query(f"SELECT {out} FROM customer {words} {_BIG} o ON {_ON}", f"join_{strategy}_{how}")(plain)
            if how == "right":
                continue

            def residual(t, how=how, strategy=strategy, names=names):
                a, b = _sides(t)
                return joins.join(a, b, F.expr(f"{_ON} AND o_totalprice > 300000 + 1000 * c_nationkey"), how, strategy).select(*names)

            query(f"SELECT {out} FROM customer {words} {_BIG} o ON {_ON} AND o_totalprice > 300000 + 1000 * c_nationkey", f"join_{strategy}_{how}_residual")(residual)


_register_joins()


@query("SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_acctbal < b.s_acctbal - 9000")
def join_nested_loop(t):
    a = t.supplier.select(F.col("s_suppkey").alias("a"), F.col("s_acctbal").alias("low"))
    b = t.supplier.select(F.col("s_suppkey").alias("b"), (F.col("s_acctbal") - 9000).alias("high"))
    return joins.less_join(a, b, "low", "high").select("a", "b")


@query("SELECT n_name, r_name FROM nation CROSS JOIN region")
def join_cross(t):
    return t.nation.crossJoin(t.region).select("n_name", "r_name")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)")
def join_not_in(t):
    return joins.not_in(t.customer, t.orders.where("o_totalprice > 100000"), "c_custkey", "o_custkey").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT CASE WHEN o_orderkey % 100 = 0 THEN NULL ELSE o_custkey END FROM orders)")
def join_not_in_with_nulls(t):
    keys = t.orders.select(F.when(F.col("o_orderkey") % 100 != 0, F.col("o_custkey")).alias("k"))
    return joins.not_in(t.customer, keys, "c_custkey", "k").select("c_custkey")


@query("""SELECT c_custkey, (EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)) AS has_big FROM customer
          WHERE c_acctbal < 100 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)""")
def join_existence(t):
    flagged = joins.exists_flag(t.customer, t.orders.where("o_totalprice > 300000"), "c_custkey", "o_custkey", "has_big")
    return flagged.where("c_acctbal < 100 OR has_big").select("c_custkey", "has_big")


@query("""SELECT a.k AS a, b.k AS b, a.n * b.n AS n FROM (SELECT CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_nationkey END AS k, count(*) AS n FROM customer GROUP BY 1) a
          JOIN (SELECT CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE s_nationkey END AS k, count(*) AS n FROM supplier GROUP BY 1) b ON a.k IS NOT DISTINCT FROM b.k""")
def join_null_safe(t):
    """How many pairs of rows each pair of keys has."""
    a = t.customer.groupBy(F.when(F.col("c_custkey") % 5 != 0, F.col("c_nationkey")).alias("a")).agg(F.count("*").alias("of_a"))
    b = t.supplier.groupBy(F.when(F.col("s_suppkey") % 7 != 0, F.col("s_nationkey")).alias("b")).agg(F.count("*").alias("of_b"))
    return a.join(b, F.col("a").eqNullSafe(F.col("b"))).select("a", "b", (F.col("of_a") * F.col("of_b")).alias("n"))


@query("SELECT event_type, count(*) AS n FROM events e JOIN customer ON user_id = c_custkey GROUP BY event_type")
def join_salted(t):
    left = t.events.select("event_type", F.col("user_id").alias("c_custkey"))
    return joins.salted_join(left, t.customer.select("c_custkey"), "c_custkey").groupBy("event_type").agg(F.count("*").alias("n"))


# aggregates


@query("""SELECT l_suppkey, count(*) AS n, count(l_quantity) AS nq, min(l_quantity) AS lo, max(l_quantity) AS hi,
                 CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS s, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) / count(l_quantity) AS mean
          FROM lineitem GROUP BY l_suppkey""")
def hash_aggregate(t):
    total = dsum(cents("l_quantity"))
    return t.lineitem.groupBy("l_suppkey").agg(
        F.count("*").alias("n"), F.count("l_quantity").alias("nq"), F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"),
        total.alias("s"), (total / F.count("l_quantity")).alias("mean"),
    )


@query("SELECT count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS s, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders WHERE o_orderkey < 0")
def global_aggregate_empty(t):
    return t.orders.where("o_orderkey < 0").agg(F.count("*").alias("n"), dsum(cents("o_totalprice")).alias("s"), F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi"))


@query("SELECT count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS s, max(o_custkey) AS hi FROM orders")
def global_aggregate(t):
    return t.orders.agg(F.count("*").alias("n"), dsum(cents("o_totalprice")).alias("s"), F.max("o_custkey").alias("hi"))


@query("""SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 150000) AS n_big, max(o_totalprice) FILTER (WHERE o_orderpriority = '1-URGENT') AS top_urgent
          FROM orders GROUP BY o_orderstatus""")
def aggregate_filter_clause(t):
    return t.orders.groupBy("o_orderstatus").agg(
        agg.masked("count(*)", "o_totalprice > 150000").alias("n_big"), agg.masked("max(o_totalprice)", "o_orderpriority = '1-URGENT'").alias("top_urgent")
    )


@query("""SELECT o_custkey, min_by(o_orderstatus, o_orderkey) AS first_status FROM orders GROUP BY o_custkey""")
def aggregate_first(t):
    return t.orders.groupBy("o_custkey").agg(agg.first_by("o_orderstatus", "o_orderkey").alias("first_status"))


@query("""SELECT o_custkey, min_by(CASE WHEN o_orderstatus <> 'O' THEN o_orderstatus END, CASE WHEN o_orderstatus <> 'O' THEN o_orderkey END) AS first_known
          FROM orders GROUP BY o_custkey""")
def aggregate_first_ignoring_nulls(t):
    known = t.orders.withColumn("s", F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus")))
    return known.groupBy("o_custkey").agg(agg.first_by("s", "o_orderkey", ignore_nulls=True).alias("first_known"))


@query("SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_returnflag")
def aggregate_distinct_one(t):
    return t.lineitem.groupBy("l_returnflag").agg(F.count_distinct("l_suppkey").alias("suppliers"))


@query("""SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts, count(*) AS n,
                 CAST(sum(DISTINCT CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS q FROM lineitem GROUP BY l_returnflag""")
def aggregate_distinct_many(t):
    return t.lineitem.groupBy("l_returnflag").agg(
        F.count_distinct("l_suppkey").alias("suppliers"), F.count_distinct("l_partkey").alias("parts"), F.count("*").alias("n"), F.sum_distinct(cents("l_quantity")).cast("double").alias("q")
    )


_SETS = "SELECT o_orderstatus, o_orderpriority, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS s, count(*) AS n {gid} FROM orders GROUP BY {by}"


def _measures():
    return dsum(cents("o_totalprice")).alias("s"), F.count("*").alias("n")


@query(_SETS.format(gid="", by="GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), ())"))
def grouping_sets(t):
    both = ["o_orderstatus", "o_orderpriority"]
    return agg.grouping_sets(t.orders, [both, both[:1], []], both, *_measures())


@query(_SETS.format(gid="", by="ROLLUP (o_orderstatus, o_orderpriority)"))
def rollup(t):
    return t.orders.rollup("o_orderstatus", "o_orderpriority").agg(*_measures())


@query(_SETS.format(gid=", CAST(grouping_id(o_orderstatus, o_orderpriority) AS BIGINT) AS gid", by="CUBE (o_orderstatus, o_orderpriority)"))
def cube_grouping_id(t):
    return t.orders.cube("o_orderstatus", "o_orderpriority").agg(*_measures(), F.grouping_id().alias("gid"))


@query("""SELECT s, grouping(s) AS rolled, count(*) AS n FROM (SELECT CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END AS s FROM orders) GROUP BY ROLLUP (s)""")
def rollup_null_keys(t):
    nulls = t.orders.select(F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("s"))
    return nulls.rollup("s").agg(F.grouping("s").cast("long").alias("rolled"), F.count("*").alias("n"))


@query("SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem ORDER BY 1, 2 LIMIT 25")
def distinct_limit(t):
    return agg.distinct_limit(t.lineitem, ["l_suppkey", "l_returnflag"], 25)


@query("SELECT user_id, count(*) AS n, max(value) AS hi FROM events GROUP BY user_id")
def aggregate_two_phase(t):
    return agg.two_phase(t.events, "user_id", 8, {"n": F.count("*"), "hi": F.max("value")}, {"n": F.sum("n"), "hi": F.max("hi")})


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15")
def aggregate_having(t):
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("n")).where("n > 15")


@query("SELECT o_orderstatus, CAST(sum(o_totalprice > 100000) AS BIGINT) AS big, bool_or(o_totalprice > 400000) AS any_huge FROM orders GROUP BY o_orderstatus")
def aggregate_booleans(t):
    return t.orders.groupBy("o_orderstatus").agg(F.count_if(F.col("o_totalprice") > 100000).alias("big"), F.bool_or(F.col("o_totalprice") > 400000).alias("any_huge"))


@query("SELECT count(DISTINCT l_partkey) AS n, true AS near FROM lineitem")
def approximate_distinct_within_bounds(t):
    """Two aggregates: in one with a distinct count, every key would carry a sketch of its own."""
    near = t.lineitem.agg(F.approx_count_distinct("l_partkey", 0.02).alias("a"))
    both = near.crossJoin(F.broadcast(t.lineitem.agg(F.count_distinct("l_partkey").alias("b"))))  # one row is sent
    return both.select(F.col("b").alias("n"), (F.abs(F.col("a") - F.col("b")) <= 0.1 * F.col("b")).alias("near"))


@query("SELECT quantile_disc(l_quantity, 0.5) AS middle FROM lineitem")
def percentile(t):
    return t.lineitem.agg(F.percentile_approx("l_quantity", 0.5, 1_000_000).alias("middle"))


# windows

_W = "PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"
_ORDER = ["o_orderdate", "o_orderkey"]


def _w(column, frame=None, by_range=False):
    return windows.over(column, ["o_custkey"], _ORDER, frame, by_range)


@query(f"SELECT o_orderkey, row_number() OVER ({_W}) AS rn, rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority) AS rk FROM orders")
def window_ranking(t):
    return t.orders.select("o_orderkey", _w(F.row_number()).cast("long").alias("rn"), windows.over(F.rank(), ["o_orderstatus"], ["o_orderpriority"]).cast("long").alias("rk"))


@query(f"""SELECT o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS s,
                  count(*) OVER ({_W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n,
                  min(o_totalprice) OVER (PARTITION BY o_custkey) AS lo,
                  first_value(o_orderkey) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS f FROM orders""")
def window_aggregates(t):
    start, end, now = Window.unboundedPreceding, Window.unboundedFollowing, Window.currentRow
    return t.orders.select(
        "o_orderkey", _w(F.sum(cents("o_totalprice")), (start, now)).cast("double").alias("s"), _w(F.count("*"), (now, end)).alias("n"),
        windows.over(F.min("o_totalprice"), ["o_custkey"], []).alias("lo"), _w(F.first("o_orderkey"), (start, end)).alias("f"),
    )


@query(f"""SELECT o_orderkey, max(o_totalprice) OVER ({_W} ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS hi,
                  CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER ({_W} ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS DOUBLE)
                  / count(*) OVER ({_W} ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS mean FROM orders""")
def window_offset_frames(t):
    mean = _w(F.sum(cents("o_totalprice")), (-1, 0)).cast("double") / _w(F.count("*"), (-1, 0))
    return t.orders.select("o_orderkey", _w(F.max("o_totalprice"), (-2, 1)).alias("hi"), mean.alias("mean"))


@query("""SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 3 PRECEDING AND CURRENT ROW) AS near,
                 count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM part""")
def window_range_frames(t):
    near = windows.over(F.count("*"), ["p_brand"], ["p_size"], (-3, 0), by_range=True)
    upto = windows.over(F.count("*"), ["p_brand"], ["p_size"], (Window.unboundedPreceding, 0), by_range=True)
    return t.part.select("p_partkey", near.alias("near"), upto.alias("upto"))


@query(f"""SELECT o_orderkey, dense_rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority) AS dr, ntile(4) OVER ({_W}) AS tile,
                  lag(o_totalprice) OVER ({_W}) AS before, lead(o_totalprice, 2) OVER ({_W}) AS after FROM orders""")
def window_navigation(t):
    return t.orders.select(
        "o_orderkey", windows.over(F.dense_rank(), ["o_orderstatus"], ["o_orderpriority"]).cast("long").alias("dr"), _w(F.ntile(4)).cast("long").alias("tile"),
        _w(F.lag("o_totalprice")).alias("before"), _w(F.lead("o_totalprice", 2)).alias("after"),
    )


@query(f"""SELECT o_orderkey, percent_rank() OVER ({_W}) AS pr, cume_dist() OVER ({_W}) AS cd,
                  last_value(o_orderkey) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l FROM orders""")
def window_distribution(t):
    whole = (Window.unboundedPreceding, Window.unboundedFollowing)
    return t.orders.select("o_orderkey", _w(F.percent_rank()).alias("pr"), _w(F.cume_dist()).alias("cd"), _w(F.last("o_orderkey"), whole).alias("l"))


_TOP = "SELECT o_custkey, o_orderkey, rk AS {r} FROM (SELECT o_custkey, o_orderkey, {f}() OVER (PARTITION BY o_custkey ORDER BY {o}) AS rk FROM orders) WHERE rk <= {n}"


@query(_TOP.format(r="rank", f="rank", o="o_orderpriority", n=2))
def group_top_n_rank(t):
    return windows.group_top_n(t.orders, ["o_custkey"], ["o_orderpriority"], 2).select("o_custkey", "o_orderkey", F.col("rank").cast("long").alias("rank"))


@query(_TOP.format(r="row_number", f="row_number", o="o_totalprice DESC, o_orderkey", n=1))
def group_top_1_row(t):
    best = windows.group_top_n(t.orders, ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 1, "row_number")
    return best.select("o_custkey", "o_orderkey", F.col("row_number").cast("long").alias("row_number"))


# sorting and limits


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def top_n(t):
    return rows.top_n(t.orders, [F.desc("o_totalprice"), "o_orderkey"], 20, "o_orderkey", "o_totalprice")


@query("""SELECT CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_nationkey END AS k, c_custkey,
                 row_number() OVER (ORDER BY CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_nationkey END DESC NULLS FIRST, c_custkey) AS rn FROM customer""")
def sort_null_order(t):
    """Ranks are counts of the keys before, plus a row number inside (key, bucket)."""
    keyed = t.customer.select(F.when(F.col("c_custkey") % 4 != 0, F.col("c_nationkey")).alias("k"), "c_custkey", F.floor(F.col("c_custkey") / 100_000).alias("bucket"))
    order = [F.desc_nulls_first("k"), "bucket"]
    counts = keyed.groupBy("k", "bucket").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a key and bucket
    starts = counts.select(F.col("k").alias("of_k"), F.col("bucket").alias("of_bucket"), before.alias("before"))
    ranked = keyed.withColumn("nth", F.row_number().over(Window.partitionBy("k", "bucket").orderBy("c_custkey")))
    joined = ranked.join(starts, F.col("k").eqNullSafe(F.col("of_k")) & (F.col("bucket") == F.col("of_bucket")))
    return joined.select("k", "c_custkey", (F.col("before") + F.col("nth")).alias("rn")).orderBy("rn")


@query("SELECT o_orderkey, o_orderdate::DATE::VARCHAR AS day FROM orders ORDER BY o_orderdate, o_orderkey")
def sort_global(t):
    return t.orders.orderBy("o_orderdate", "o_orderkey").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


@query("SELECT count(*) AS n FROM (SELECT * FROM lineitem LIMIT 77)")
def limit_rows(t):
    return t.lineitem.limit(77).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 5")
def limit_offset(t):
    return t.orders.select("o_orderkey").orderBy("o_orderkey").offset(5).limit(10)


@query("SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1")
def sort_within_partitions(t):
    return t.lineitem.select("l_returnflag", "l_orderkey").repartition("l_returnflag").sortWithinPartitions("l_returnflag", "l_orderkey").groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query("SELECT (count(*) > 0) AS some, (count(*) < (SELECT count(*) FROM lineitem)) AS fewer FROM (SELECT * FROM lineitem LIMIT 100)")
def sample_rows(t):
    n = t.lineitem.count()
    return t.lineitem.sample(0.1, seed=7).agg((F.count("*") > 0).alias("some"), (F.count("*") < n).alias("fewer"))


# set operations

_A, _B = "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 5000", "SELECT s_nationkey AS k FROM supplier"


def _ab(t):
    return t.customer.where("c_acctbal > 5000").select(F.col("c_nationkey").alias("k")), t.supplier.select(F.col("s_nationkey").alias("k"))


@query(f"{_A} UNION ALL {_B}")
def union_all(t):
    a, b = _ab(t)
    return a.unionAll(b)


@query(f"{_A} UNION {_B}")
def union_distinct(t):
    a, b = _ab(t)
    return a.unionAll(b).distinct()


@query("SELECT c_custkey AS id, CAST(c_acctbal AS DOUBLE) AS bal, NULL::VARCHAR AS part FROM customer UNION ALL SELECT p_partkey, NULL, p_name FROM part")
def union_by_name(t):
    a = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("bal"))
    return a.unionByName(t.part.select(F.col("p_name").alias("part"), F.col("p_partkey").alias("id")), allowMissingColumns=True)


def _register_sets():
    for how in ("intersect", "except"):
        for every in (False, True):

            def run(t, how=how, every=every):
                return rows.compare(*_ab(t), how, every)

            query(f"{_A} {how.upper()}{' ALL' if every else ''} {_B}", f"{how}_{'all' if every else 'distinct'}")(run)


_register_sets()


@query("""SELECT o_orderkey, 'status' AS kind, o_orderstatus AS v FROM orders UNION ALL SELECT o_orderkey, 'priority', o_orderpriority FROM orders""")
def expand(t):
    key = F.col("o_orderkey")
    return rows.expand(t.orders, [[key, F.lit("status"), F.col("o_orderstatus")], [key, F.lit("priority"), F.col("o_orderpriority")]], ["o_orderkey", "kind", "v"])


# exchanges: the partitioning differs and is checked, the rows do not

_COUNTS = "SELECT o_orderstatus, count(*) AS n, true AS dealt FROM orders GROUP BY 1"


def _one_partition(df, key):
    """Whether each key is in one partition."""
    return df.groupBy(key).agg(F.count_distinct("pid").alias("k")).agg((F.max("k") == 1).alias("dealt"))


def _ranges(df, key):
    """Whether partitions are ranges of the key that do not overlap, and more than one."""
    ends = df.groupBy("pid").agg(F.min(key).alias("lo"), F.max(key).alias("hi"))  # a row a partition
    before = ends.withColumn("before", F.lag("hi").over(Window.orderBy("lo")))
    return before.agg(((F.count_if(F.col("before") > F.col("lo")) == 0) & (F.count("*") > 1)).alias("dealt"))


def _even(df):
    """Whether eight partitions have about as many rows each: each task of the scan deals its rows in turn."""
    ends = df.groupBy("pid").agg(F.count("*").alias("n"))
    return ends.agg(((F.count("*") == 8) & (F.max("n") - F.min("n") <= 0.05 * F.max("n") + 32)).alias("dealt"))


def _register_exchanges():
    kinds = {
        "hash": (lambda df: rows.by_hash(df, 8, "o_custkey"), lambda df: _one_partition(df, "o_custkey")),
        "range": (lambda df: rows.by_range(df, 8, "o_orderkey"), lambda df: _ranges(df, "o_orderkey")),
        "round_robin": (lambda df: rows.round_robin(df, 8), _even),
        "single": (rows.single, lambda df: df.agg((F.count_distinct("pid") == 1).alias("dealt"))),
        "rebalance": (lambda df: rows.rebalanced(df, "o_orderstatus"), lambda df: df.agg((F.count_distinct("pid") <= 64).alias("dealt"))),
    }
    for name, (deal, check) in kinds.items():

        def run(t, deal=deal, check=check):
            dealt = deal(t.orders.select("o_orderstatus", "o_custkey", "o_orderkey"))
            counts = dealt.groupBy("o_orderstatus").agg(F.count("*").alias("n"))
            return counts.crossJoin(F.broadcast(check(dealt.withColumn("pid", F.spark_partition_id()))))  # one row

        query(_COUNTS, f"exchange_{name}")(run)


_register_exchanges()


@query("SELECT sum(range)::BIGINT AS s, count(*) AS n FROM range(5, 1000, 3)")
def range_source(t):
    return t._spark.range(5, 1000, 3, 4).agg(F.sum("id").alias("s"), F.count("*").alias("n"))


@query("""SELECT user_id, event_type, sum((props ->> '$.k')::BIGINT)::BIGINT AS k FROM events GROUP BY 1, 2""")
def json_field(t):
    return t.events.groupBy("user_id", "event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k"))
