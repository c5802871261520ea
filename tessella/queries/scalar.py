"""Registered queries for scalar functions, casts, decimals and nulls."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.queries.registry import query


@query("""SELECT o_orderkey, o_orderkey + 3 AS a, o_orderkey - 3 AS b, o_orderkey * 3 AS c, o_orderkey / 3 AS d, o_orderkey % 7 AS e, -o_orderkey % 7 AS f, o_orderkey // 3 AS g FROM orders""")
def arithmetic(t):
    k = F.col("o_orderkey")
    return t.orders.select("o_orderkey", (k + 3).alias("a"), (k - 3).alias("b"), (k * 3).alias("c"), (k / 3).alias("d"), (k % 7).alias("e"), (-k % 7).alias("f"), F.expr("o_orderkey div 3").alias("g"))


@query("""SELECT l_orderkey, l_linenumber, l_quantity > 30 AS gt, l_quantity >= 30 AS ge, l_quantity < 30 AS lt, l_quantity <= 30 AS le, l_quantity = 30 AS eq,
                 NOT (l_quantity = 30) AS ne, (l_quantity > 10 AND l_tax > 0.02) AS both, (l_quantity > 45 OR l_tax > 0.06) AS either FROM lineitem""")
def comparisons(t):
    q, x = F.col("l_quantity"), F.col("l_tax")
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", (q > 30).alias("gt"), (q >= 30).alias("ge"), (q < 30).alias("lt"), (q <= 30).alias("le"), (q == 30).alias("eq"),
        (~(q == 30)).alias("ne"), ((q > 10) & (x > 0.02)).alias("both"), ((q > 45) | (x > 0.06)).alias("either"),
    )


@query("""SELECT c_custkey, o_orderkey IS NULL AS none, o_orderkey IS NOT NULL AS some, coalesce(o_totalprice, c_acctbal) AS v, coalesce(o_totalprice, NULL, 0) AS w
          FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000""")
def null_tests(t):
    joined = t.customer.join(t.orders.where("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select(
        "c_custkey", F.col("o_orderkey").isNull().alias("none"), F.col("o_orderkey").isNotNull().alias("some"), F.coalesce("o_totalprice", "c_acctbal").alias("v"),
        F.coalesce("o_totalprice", F.lit(None), F.lit(0.0)).alias("w"),
    )


@query("SELECT p_partkey, p_size IN (1, 5, 9) AS one_of, p_brand NOT IN ('Brand#11', 'Brand#22') AS not_one_of FROM part")
def in_lists(t):
    return t.part.select("p_partkey", F.col("p_size").isin(1, 5, 9).alias("one_of"), (~F.col("p_brand").isin("Brand#11", "Brand#22")).alias("not_one_of"))


@query("""SELECT p_partkey, p_name LIKE '%a%e%' AS l, p_type LIKE 'S_____%' AS u, starts_with(p_brand, 'Brand#1') AS s, suffix(p_brand, '3') AS e, contains(p_type, 'AN') AS c FROM part""")
def patterns(t):
    return t.part.select(
        "p_partkey", F.col("p_name").like("%a%e%").alias("l"), F.col("p_type").like("S_____%").alias("u"), F.col("p_brand").startswith("Brand#1").alias("s"),
        F.col("p_brand").endswith("3").alias("e"), F.col("p_type").contains("AN").alias("c"),
    )


@query("""SELECT x, x LIKE 'a+b' AS plus, x LIKE 'a(b)%' AS par, x LIKE 'a\\_b' ESCAPE '\\' AS esc, x LIKE '%[x]%' AS bracket
          FROM (VALUES ('a+b'), ('aab'), ('a(b)c'), ('a_b'), ('axb'), ('[x]'), (NULL)) v(x)""")
def like_special_characters(t):
    x = t._spark.sql("SELECT * FROM VALUES ('a+b'), ('aab'), ('a(b)c'), ('a_b'), ('axb'), ('[x]'), (CAST(NULL AS STRING)) AS v(x)")
    c = F.col("x")
    return x.select("x", c.like("a+b").alias("plus"), c.like("a(b)%").alias("par"), c.like(r"a\_b").alias("esc"), c.like("%[x]%").alias("bracket"))


@query("""SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' END AS band, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END AS code,
                 CASE WHEN o_orderstatus = 'F' THEN CASE WHEN o_totalprice > 200000 THEN 'FH' ELSE 'FL' END ELSE 'X' END AS nested FROM orders""")
def case_when(t):
    price, status = F.col("o_totalprice"), F.col("o_orderstatus")
    return t.orders.select(
        "o_orderkey", F.when(price > 300000, "high").when(price > 100000, "mid").alias("band"), F.when(status == "F", 1).when(status == "O", 2).otherwise(0).alias("code"),
        F.when(status == "F", F.when(price > 200000, "FH").otherwise("FL")).otherwise("X").alias("nested"),
    )


@query("""SELECT p_partkey, substr(p_name, 2, 3) AS s, substr(p_name, -3, 2) AS t, lower(p_brand) AS l, upper(p_name) AS u, length(p_name) AS n, replace(p_type, 'A', '__') AS r,
                 p_brand || '-' || p_type AS c, p_brand || CASE WHEN p_size > 10 THEN 'x' END AS cn FROM part""")
def strings(t):
    return t.part.select(
        "p_partkey", F.substring("p_name", 2, 3).alias("s"), F.substring("p_name", -3, 2).alias("t"), F.lower("p_brand").alias("l"), F.upper("p_name").alias("u"),
        F.length("p_name").cast("long").alias("n"), F.replace("p_type", F.lit("A"), F.lit("__")).alias("r"), F.concat("p_brand", F.lit("-"), "p_type").alias("c"),
        F.concat("p_brand", F.when(F.col("p_size") > 10, "x")).alias("cn"),
    )


@query("""SELECT x, length(x) AS n, substr(x, 2, 2) AS s, upper(x) AS u, x || '末' AS c, instr(x, '文') AS i, x = '中文字' AS eq
          FROM (VALUES ('中文字'), ('añ文b'), (''), ('  pad '), (NULL)) v(x)""")
def strings_multibyte(t):
    x = t._spark.sql("SELECT * FROM VALUES ('中文字'), ('añ文b'), (''), ('  pad '), (CAST(NULL AS STRING)) AS v(x)")
    return x.select(
        "x", F.length("x").cast("long").alias("n"), F.substring("x", 2, 2).alias("s"), F.upper("x").alias("u"), F.concat("x", F.lit("末")).alias("c"),
        F.instr("x", "文").cast("long").alias("i"), (F.col("x") == "中文字").alias("eq"),
    )


@query("""SELECT user_id, event_id, instr(event_type, 'i') AS i, string_split(event_type, 'i')[1] AS head, (string_split(event_type, 'i'))[2] AS tail FROM events""")
def split_subscript(t):
    parts = F.split("event_type", "i")
    return t.events.select("user_id", "event_id", F.instr("event_type", "i").cast("long").alias("i"), parts[0].alias("head"), F.get(parts, F.lit(1)).alias("tail"))


@query("""SELECT c_custkey, CAST(abs(b) AS DOUBLE) AS a, CAST(round(b, 1) AS DOUBLE) + 0.0 AS r1, CAST(round(b, -2) AS DOUBLE) + 0.0 AS r2, CAST(round(CAST(c_custkey AS DECIMAL(18,0)), -1) AS BIGINT) AS ri,
                 CAST(floor(b) AS BIGINT) AS f, CAST(ceil(b) AS BIGINT) AS c FROM (SELECT c_custkey, CAST(c_acctbal AS DECIMAL(18,2)) AS b FROM customer)""")
def numeric_functions(t):
    """Exact decimals, so that ties go away from zero on both sides."""
    b = F.col("c_acctbal").cast("decimal(18,2)")
    return t.customer.select(
        "c_custkey", F.abs(b).cast("double").alias("a"), (F.round(b, 1).cast("double") + F.lit(0.0)).alias("r1"), (F.round(b, -2).cast("double") + F.lit(0.0)).alias("r2"),
        F.round(F.col("c_custkey").cast("decimal(18,0)"), -1).cast("long").alias("ri"), F.floor(b).cast("long").alias("f"), F.ceil(b).cast("long").alias("c"),
    )


@query("SELECT x, round(x) AS r, CAST(round(y, -1) AS BIGINT) AS ry FROM (VALUES (2.5::DOUBLE, 125), (-2.5::DOUBLE, -125), (0.5::DOUBLE, 15), (NULL, NULL)) v(x, y)")
def round_half_up(t):
    x = t._spark.sql("SELECT * FROM VALUES (2.5D, 125), (-2.5D, -125), (0.5D, 15), (CAST(NULL AS DOUBLE), CAST(NULL AS INT)) AS v(x, y)")
    return x.select("x", F.round("x").alias("r"), F.round("y", -1).cast("long").alias("ry"))


@query("""SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INTEGER) AS i, CAST(l_quantity AS BIGINT) AS b, CAST(l_orderkey AS VARCHAR) AS s, CAST(CAST(l_linenumber AS VARCHAR) AS DOUBLE) AS d,
                 CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS day, CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS DOUBLE) AS m FROM lineitem""")
def casts(t):
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("i"), F.col("l_quantity").cast("long").alias("b"), F.col("l_orderkey").cast("string").alias("s"),
        F.col("l_linenumber").cast("string").cast("double").alias("d"), F.col("l_shipdate").cast("date").cast("string").alias("day"), F.col("l_extendedprice").cast("decimal(12,2)").cast("double").alias("m"),
    )


@query("SELECT x, try_cast(x AS INTEGER) AS i, try_cast(x AS DOUBLE) AS d, CAST(try_cast(x AS DATE) AS VARCHAR) AS t FROM (VALUES ('12'), ('x'), ('1.5e3'), ('2020-02-30'), ('2020-02-29'), (NULL)) v(x) WHERE x IS NULL OR x <> '1.5e3'")
def try_casts(t):
    x = t._spark.sql("SELECT * FROM VALUES ('12'), ('x'), ('2020-02-30'), ('2020-02-29'), (CAST(NULL AS STRING)) AS v(x)")
    return x.select("x", F.col("x").try_cast("int").alias("i"), F.col("x").try_cast("double").alias("d"), F.col("x").try_cast("date").cast("string").alias("t"))


@query("""SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(12,2)) + CAST(o_orderkey AS DECIMAL(18,2)) AS DOUBLE) AS a, CAST(CAST(o_totalprice AS DECIMAL(12,2)) - 0.01 AS DOUBLE) AS s,
                 CAST(CAST(o_totalprice AS DECIMAL(12,2)) * CAST(1.07 AS DECIMAL(5,2)) AS DOUBLE) AS m, CAST(o_totalprice AS DECIMAL(12,2)) > CAST(100000.5 AS DECIMAL(8,1)) AS c FROM orders""")
def decimal_arithmetic(t):
    p = F.col("o_totalprice").cast("decimal(12,2)")
    return t.orders.select(
        "o_orderkey", (p + F.col("o_orderkey").cast("decimal(18,2)")).cast("double").alias("a"), (p - F.lit("0.01").cast("decimal(3,2)")).cast("double").alias("s"),
        (p * F.lit("1.07").cast("decimal(5,2)")).cast("double").alias("m"), (p > F.lit("100000.5").cast("decimal(8,1)")).alias("c"),
    )


@query("""SELECT x, NULL::BIGINT AS over, CASE WHEN x = 0 THEN NULL ELSE 10 / x END AS div FROM (VALUES (0), (4), (NULL)) v(x)""")
def null_on_error(t):
    x = t._spark.sql("SELECT * FROM VALUES (0), (4), (CAST(NULL AS INT)) AS v(x)")
    return x.select("x", F.try_add(F.lit(9223372036854775807), F.greatest(F.coalesce("x", F.lit(1)), F.lit(1)).cast("long")).alias("over"), F.try_divide(F.lit(10), "x").alias("div"))


@query("""SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(CAST(o_orderdate AS DATE) + 30 AS VARCHAR) AS due,
                 CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS days FROM orders""")
def dates(t):
    day = F.col("o_orderdate").cast("date")
    return t.orders.select(
        "o_orderkey", F.year(day).alias("y"), F.month(day).alias("m"), F.date_add(day, 30).cast("string").alias("due"), F.datediff(day, F.lit("1992-01-01").cast("date")).alias("days")
    )


@query("""SELECT vec_id, list_sum(list_transform(embedding, lambda x: CAST(CASE WHEN x > 0 THEN 1 ELSE 0 END AS BIGINT)))::BIGINT AS positive, len(embedding)::BIGINT AS n FROM embeddings""")
def lambdas(t):
    positive = F.aggregate(F.transform("embedding", lambda x: F.when(x > 0, 1).otherwise(0)), F.lit(0).cast("long"), lambda a, x: a + x)
    return t.embeddings.select("vec_id", positive.alias("positive"), F.size("embedding").cast("long").alias("n"))


@query("""SELECT l_orderkey, l_linenumber, l_discount = 0 AS zero, CAST(l_linenumber AS SMALLINT) + CAST(1 AS SMALLINT) AS next FROM lineitem WHERE l_discount <= 0""")
def negative_zero_and_shorts(t):
    one = F.lit(1).cast("short")
    return t.lineitem.where("l_discount <= 0").select("l_orderkey", "l_linenumber", (F.col("l_discount") == 0).alias("zero"), (F.col("l_linenumber").cast("short") + one).alias("next"))


@query("SELECT o_orderkey, o_orderkey % 16 AS bucket FROM orders")
def pmod_bucket(t):
    return t.orders.select("o_orderkey", F.pmod("o_orderkey", F.lit(16)).alias("bucket"))


@query("SELECT p_partkey, upper(left(p_name, 1)) || '.' AS initial FROM part")
def registered_udf(t):
    from tessella.functions.udf import call, register

    register(t._spark, "initial", lambda names: names.str[:1].str.upper() + ".", "string")
    return t.part.select("p_partkey", call("initial", "p_name").alias("initial"))
