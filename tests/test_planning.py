"""Join orders, pushdown decisions, the support check, coercion, tables and event logs."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.plans import join_order as jo
from tessella.plans import pushdown as pd_
from tessella.plans import support
from tessella.plans.expr import E, canonical, col, contradictory, implies, lit, simplify
from tessella.sources import coercion, files, tables

R, C = jo.Relation, jo.Condition


def on(*names, equality=True):
    return C(frozenset(names), None, equality)


# join orders


def test_products_come_last():
    plan = jo.delay_cartesian([R("a"), R("b"), R("c"), R("d")], [on("a", "c"), on("b", "d")])
    assert str(plan) == "((a * c) x (b * d))" and plan.products() == 1


def test_connected_relations_keep_their_order():
    assert str(jo.delay_cartesian([R("a"), R("b"), R("c")], [on("a", "b"), on("b", "c")])) == "((a * b) * c)"


def test_a_condition_over_three_relations_is_kept():
    plan = jo.delay_cartesian([R("a"), R("b"), R("c")], [on("a", "b", "c", equality=False)])
    assert len(plan.used()) == 1 and plan.names == {"a", "b", "c"}


@pytest.mark.parametrize("relations", [[R("a"), R("b")], [R("a"), R("b", hinted=True), R("c")]])
def test_order_as_written(relations):
    conditions = [on("a", "c")] if len(relations) > 2 else []
    for f in (jo.delay_cartesian, jo.heuristic_order):
        assert str(f(relations, conditions)) == str(jo.in_order(relations, conditions))


def test_filtered_and_small_relations_first():
    relations = [R("fact", size=100), R("big", size=50, filtered=True), R("plain", size=1), R("small", size=5, filtered=True)]
    plan = jo.heuristic_order(relations, [on("fact", r) for r in ("big", "plain", "small")])
    assert str(plan) == "(((fact * small) * big) * plain)"


def test_filtered_relations_without_an_equality_wait():
    plan = jo.heuristic_order([R("a"), R("b", filtered=True), R("c")], [on("a", "b", equality=False), on("a", "c")])
    assert str(plan) == "((a * b) * c)"  # b is the first that is joined at all


def test_build_side():
    assert (jo.build_side(2, 0), jo.build_side(0, 1), jo.build_side(1, 1), jo.build_side(0, 0)) == ("left", "right", None, None)


@settings(max_examples=100, deadline=None)
@given(st.integers(3, 6), st.lists(st.sets(st.integers(0, 5), min_size=2, max_size=3), max_size=6))
def test_no_relation_or_condition_is_lost(n, edges):
    relations = [R(f"r{k}", size=k, filtered=k % 2 == 0) for k in range(n)]
    conditions = [on(*(f"r{k}" for k in e)) for e in edges if max(e) < n]
    for f in (jo.delay_cartesian, jo.heuristic_order):
        plan = f(relations, conditions)
        assert plan.names == {r.name for r in relations} and len(plan.used()) == len(conditions)


# pushdown

SCHEMA = T.StructType().add("k", "long").add("v", "double").add("s", "string").add("t", "timestamp").add("a", T.ArrayType(T.IntegerType()))
SCAN = pd_.Scan(SCHEMA, "parquet", 10**9, 1_000_000, {"k": pd_.Column(1000, 0.0, 0, 1000), "v": pd_.Column(500_000, 0.5, 0, 100), "s": pd_.Column(10)})
COUNT = pd_.Aggregate("count", None, "n")


def cmp(op, c, v, kind="double"):
    return E(op, (col(c), lit(v, kind)))


@pytest.mark.parametrize(
    ("e", "share"),
    [
        (cmp("<", "k", 250, "long"), 0.25), (cmp(">=", "k", 250, "long"), 0.75), (cmp("=", "k", 5, "long"), 0.001), (cmp("=", "k", 5000, "long"), 0.0), (cmp("<", "v", 50), 0.25),
        (E("isnull", (col("v"),)), 0.5), (E("not", (E("isnull", (col("v"),)),)), 0.5), (E("and", (cmp("<", "k", 500, "long"), cmp("<", "v", 50))), 0.125),
        (E("or", (cmp("<", "k", 500, "long"), cmp("<", "k", 500, "long"))), 0.5), (E("in", (col("s"), lit("x", "string"), lit("y", "string"))), 0.2), (cmp("<", "t", 1), None),
    ],
)
def test_selectivity(e, share):
    got = pd_.selectivity(e, SCAN)
    assert got == (share if share is None else pytest.approx(share))


def test_selective_filters_go_and_others_stay():
    few, many, like = cmp("<", "k", 100, "long"), cmp("<", "k", 900, "long"), E("like", (col("s"), lit("a%", "string")))
    plan = pd_.decide(SCAN, E("and", (few, like)), columns=["k"])
    assert plan.pushed_filters == (canonical(few),) and plan.residual_filters == (canonical(like),)
    assert pd_.decide(SCAN, many).pushed_filters == ()
    assert pd_.decide(SCAN, cmp("<", "t", 1, "timestamp")).pushed_filters == ()


@pytest.mark.parametrize("scan", [pd_.Scan(SCHEMA, "csv", 10**9), pd_.Scan(SCHEMA, "parquet", 10_240), pd_.Scan(SCHEMA, "orc", 10**9, merged_schema=True)])
def test_gates_of_tables(scan):
    plan = pd_.decide(scan, cmp("=", "k", 1, "long"), aggregates=[COUNT], limit=5)
    assert not plan.pushed_filters and not plan.partial_pushed and not plan.limit_pushed and len(plan.reasons) == 1


@pytest.mark.parametrize(
    ("keys", "aggregates", "pushed"),
    [
        (["s"], [COUNT], True), ([], [COUNT], True), (["v"], [COUNT], False), (["t"], [COUNT], False), (["s", "k"], [COUNT], True), (["s", "v"], [COUNT], False),
        (["s"], [pd_.Aggregate("sum", E("*", (col("v"), lit(2, "integer"))), "x")], True), (["s"], [pd_.Aggregate("sum", E("cast", (col("k"),), "double"), "x")], False),
        (["s"], [pd_.Aggregate("count", col("k"), "x", distinct=True)], False), (["s"], [pd_.Aggregate("stddev", col("v"), "x")], False),
        (["s"], [pd_.Aggregate("max", lit(None, "double"), "x")], False), ([], [pd_.Aggregate("max", lit(1, "integer"), "x")], False),
    ],
)
def test_partial_aggregates(keys, aggregates, pushed):
    assert pd_.decide(SCAN, keys=keys, aggregates=aggregates).partial_pushed is pushed


def test_limits_stay_above_aggregates_and_residual_filters():
    assert pd_.decide(SCAN, limit=5).limit_pushed
    assert not pd_.decide(SCAN, keys=["s"], aggregates=[COUNT], limit=5).limit_pushed
    assert not pd_.decide(SCAN, E("like", (col("s"), lit("a%", "string"))), limit=5).limit_pushed


def test_pushed_filters_reach_the_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    plan = pd_.decide(pd_.scan_of(df, statistics=["o_totalprice"]), cmp(">", "o_totalprice", 300_000.0), columns=["o_orderkey"])
    out = plan.apply(df)
    text = out._jdf.queryExecution().executedPlan().toString()
    assert plan.pushed_filters and "GreaterThan(o_totalprice,300000.0)" in text and "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in text


# support


def test_support(spark):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").drop("o_orderdate")
    assert support.check(orders.where("o_totalprice > 5").groupBy("o_orderstatus").agg(F.sum("o_totalprice"))) == []
    assert "aggregate StddevSamp" in {r.reason for r in support.check(orders.groupBy("o_orderstatus").agg(F.stddev("o_totalprice")))}
    assert support.check(orders.crossJoin(spark.range(3)))[0].reason in ("no columnar form", "join type Cross")
    assert support.schema_refusals(T.StructType.fromDDL("a tinyint, b float, c int, d map<int,int>")) == ["a has the type tinyint", "b has the type float", "d has the type map<int,int>"]
    assert support.scan_supported(orders) and not support.scan_supported(orders.select(F.array("o_orderkey").alias("x")))


# coercion


@pytest.mark.parametrize(
    ("source", "target", "value", "want"),
    [
        ("string", "int", "12", 12), ("string", "int", "x", None), ("string", "varchar(2)", "abc", "ab"), ("int", "string", 5, "5"), ("tinyint", "bigint", 5, 5), ("int", "double", 5, 5.0),
        ("float", "double", 0.5, 0.5), ("double", "float", 0.5, 0.5), ("array<int>", "array<bigint>", [1, None], [1, None]), ("map<string,int>", "map<string,string>", {"a": 1}, {"a": "1"}),
        ("struct<a:int,b:string>", "struct<a:bigint,b:string,c:int>", (1, "x"), (1, "x", None)), ("struct<a:int>", "struct<a:bigint>", None, None), ("bigint", "smallint", 1, TypeError),
        ("string", "double", "1", TypeError), ("boolean", "int", True, TypeError), ("struct<a:int>", "struct<z:int>", (1,), TypeError), ("double", "int", 1.0, TypeError),
    ],
)
def test_coercion(spark, source, target, value, want):
    df = spark.createDataFrame([(value,)], f"x {source}")
    schema = T.StructType.fromDDL(f"x {target}")
    if want is TypeError:
        with pytest.raises(coercion.CoercionError):
            coercion.coerce_to(df, schema)
        return
    got = coercion.coerce_to(df, schema).first().x
    assert (tuple(got) if isinstance(want, tuple) else got) == want


# tables


def test_insert_modes_and_statements(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS lay")
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "v int, p string")
    layout = files.Layout(partition_by=["p"], sort_by=["v"])
    files.save(rows, "lay.t", layout)
    with pytest.raises(ValueError, match="exists"):
        files.save(rows, "lay.t", layout)
    files.save(rows.where("v = 2").withColumn("v", F.lit(20)), "lay.t", layout, mode="overwrite")
    files.save(rows.where("v = 1"), "lay.t", layout, mode="append")
    assert sorted(r.v for r in spark.table("lay.t").collect()) == [1, 1, 3, 20]
    tables.update(spark, "lay.t", {"v": F.col("v") + 100}, F.col("p").isNull() | (F.col("v") == 20))
    assert sorted(r.v for r in spark.table("lay.t").collect()) == [1, 1, 103, 120]
    tables.delete(spark, "lay.t", F.col("p") == "a")
    assert sorted(r.v for r in spark.table("lay.t").collect()) == [103, 120]
    with pytest.raises(ValueError, match="partition column"):
        tables.update(spark, "lay.t", {"p": F.lit("z")}, F.lit(True))
    tables.create_empty_partition(spark, "lay.t", p="new")
    assert "p=new" in {r.partition for r in spark.sql("SHOW PARTITIONS lay.t").collect()}
    tables.sync_partitions(spark, "lay.t")
    tables.analyze(spark, "lay.t", ["v"])
    assert tables.column_statistics(spark, "lay.t", "v")["distinct_count"] == "2"
    tables.compact(spark, "lay.t")
    assert spark.table("lay.t").count() == 2
    spark.sql("DROP DATABASE lay CASCADE")


def test_formats_that_need_more(spark):
    with pytest.raises(ValueError, match="needs a schema"):
        files.read(spark, "/nowhere", "json")
    if not files.available(spark, "avro"):
        with pytest.raises(ValueError, match="cannot read"):
            files.read(spark, "/nowhere", "avro")


# event logs


def test_event_log(spark, tmp_path):
    from tessella.mv.eventlog import queries

    name = "org.apache.spark.sql.execution.ui.SparkListenerSQLExecution"
    lines = [
        f'{{"Event":"{name}Start","executionId":1,"description":"q","physicalPlanDescription":"Scan parquet db.v1","time":1000}}',
        '{"Event":"SparkListenerJobStart","Job ID":0,"Stage IDs":[0,1],"Properties":{"spark.sql.execution.id":"1"}}',
        '{"Event":"SparkListenerTaskEnd","Stage ID":0,"Task Info":{"Failed":false},"Task Metrics":{"Executor Run Time":1500,"Input Metrics":{"Records Read":7}}}',
        '{"Event":"SparkListenerTaskEnd","Stage ID":1,"Task Info":{"Failed":true}}',
        '{"Event":"SparkListenerTaskEnd","Stage ID":9,"Task Info":{"Failed":true}}',
        f'{{"Event":"{name}End","executionId":1,"time":3500}}',
        f'{{"Event":"{name}Start","executionId":2,"description":"open","physicalPlanDescription":"x","time":9000}}',
    ]
    (tmp_path / "log").write_text("\n".join(lines))
    got = {r.execution_id: r for r in queries(spark, str(tmp_path / "log"), ["db.v1", "db.v2"]).collect()}
    assert (got[1].seconds, got[1].tasks, got[1].failed_tasks, got[1].run_seconds, got[1].rows_read, got[1].views) == (2.5, 2, 1, 1.5, 7, ["db.v1"])
    assert (got[2].seconds, got[2].tasks, got[2].views) == (None, 0, [])
    assert queries(spark, str(tmp_path / "log"), since_ms=5000).count() == 1


# implication, over rows with nulls

_terms = st.recursive(
    st.builds(lambda op, c, v: E(op, (col(c), lit(v, "integer"))), st.sampled_from(["=", "<", "<=", ">", ">="]), st.sampled_from("xy"), st.integers(0, 4))
    | st.builds(lambda op, c: E(op, (col(c),)), st.sampled_from(["isnull", "isnotnull"]), st.sampled_from("xy"))
    | st.builds(lambda c, vs: E("in", (col(c), *(lit(v, "integer") for v in vs))), st.sampled_from("xy"), st.lists(st.integers(0, 4), min_size=1, max_size=3)),
    lambda inner: st.builds(lambda op, a, b: E(op, (a, b)), st.sampled_from(["and", "or"]), inner, inner) | st.builds(lambda a: E("not", (a,)), inner),
    max_leaves=5,
)
ROWS = [{"x": x, "y": y} for x in (None, 0, 1, 2, 3, 4) for y in (None, 0, 2, 4)]


def value(e, row):
    """True, False or None, as SQL has it."""
    if e.op == "lit":
        return e.value
    if e.op == "col":
        return row[e.value]
    a = [value(x, row) for x in e.args]
    if e.op == "and":
        return False if False in a else None if None in a else True
    if e.op == "or":
        return True if True in a else None if None in a else False
    if e.op == "not":
        return None if a[0] is None else not a[0]
    if e.op in ("isnull", "isnotnull"):
        return (a[0] is None) == (e.op == "isnull")
    if a[0] is None or a[1] is None:
        return None
    if e.op == "in":
        return a[0] in a[1:]
    return {"=": a[0] == a[1], "<": a[0] < a[1], "<=": a[0] <= a[1], ">": a[0] > a[1], ">=": a[0] >= a[1]}[e.op]


@settings(max_examples=400, deadline=None, suppress_health_check=[HealthCheck.too_slow])
@given(_terms, _terms)
def test_implication_is_sound(fact, goal):
    f, g = canonical(fact), canonical(goal)
    for row in ROWS:
        assert value(f, row) == value(fact, row)
        assert (value(simplify(fact), row) is True) == (value(fact, row) is True)
        if value(fact, row) is True:
            assert not contradictory([f])
            if implies([f], g):
                assert value(goal, row) is True


# what writing keeps


def test_overwrite_replaces_the_written_partitions_only(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "x int, p string")
    files.save(rows, "kept_parts", files.Layout(partition_by=["p"]))
    files.save(spark.createDataFrame([(9, "b")], "x int, p string"), "kept_parts", mode="overwrite")
    assert sorted(map(tuple, spark.table("kept_parts").collect())) == [(1, "a"), (9, "b")]
    spark.sql("DROP TABLE kept_parts")


def test_changed_columns_keep_the_layout(spark):
    df = spark.createDataFrame([(1, 2, "a"), (3, 4, "b")], "x int, y int, p string")
    files.save(df, "laid_out", files.Layout("orc", partition_by=["p"], bucket_by=["x"], buckets=4, sort_by=["x"]))
    spark.sql("COMMENT ON TABLE laid_out IS 'it is'")
    spark.sql("ALTER TABLE laid_out SET TBLPROPERTIES ('mine' = 'yes')")
    tables.rename_column(spark, "laid_out", "p", "q")
    tables.rename_column(spark, "laid_out", "x", "z")
    tables.drop_column(spark, "laid_out", "y")
    said = tables._described(spark, "laid_out")
    assert (said["format"], said["partitions"], said["bucket_count"], said["buckets"], said["sorted"], said["comment"]) == ("orc", ["q"], 4, ["z"], ["z"], "it is")
    assert said["properties"]["mine"] == "yes"
    assert sorted(map(tuple, spark.table("laid_out").collect())) == [(1, "a"), (3, "b")]
    for c in ("q", "z"):
        with pytest.raises(ValueError):
            tables.drop_column(spark, "laid_out", c)
    spark.sql("DROP TABLE laid_out")


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join(spark, how):
    from tessella.operators.joins import salted_join

    left = spark.createDataFrame([(1, k) for k in range(50)] + [(None, 1), (2, 2), (7, 3)], "k int, v int")
    right = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (5, "d"), (None, "e")], "k int, w string")
    key = lambda r: str(tuple(r))
    assert sorted(map(key, salted_join(left, right, "k", how=how).collect())) == sorted(map(key, left.join(right, "k", how).collect()))


@pytest.mark.parametrize("how", ["right", "full"])
def test_salted_join_refuses_what_it_would_repeat(spark, how):
    from tessella.operators.joins import salted_join

    with pytest.raises(ValueError, match="repeated"):
        salted_join(spark.range(2), spark.range(2), "id", how=how)


def test_event_logs_tell_views_of_like_names_apart(spark, tmp_path):
    from tessella.mv import eventlog

    start = '{"Event": "org.apache.spark.sql.execution.ui.SparkListenerSQLExecutionStart", "executionId": %d, "description": "q", "physicalPlanDescription": "Scan spark_catalog.hr.%s[x]", "time": 1}'
    (tmp_path / "log").write_text("\n".join(start % (k, v) for k, v in enumerate(("v", "v2"))))
    got = eventlog.queries(spark, str(tmp_path / "log"), ["hr.v", "hr.v2"]).orderBy("execution_id").collect()
    assert [r.views for r in got] == [["hr.v"], ["hr.v2"]]
    eventlog.main([str(tmp_path / "log"), str(tmp_path / "out"), "--views", "hr.v"])
    assert spark.read.json(str(tmp_path / "out")).count() == 2
