"""Literal groups say where each literal stands."""

from pyspark.sql import functions as F

from strata.operators import search


def test_sites(spark):
    from strata.plans.catalog import QUERIES
    from strata.plans.relations import Code, parse_code

    files = spark.createDataFrame([("a.py", "def f():\n    return 10, 'ab'\nX = 10\n"), ("b.py", "g('ab')\n")], "path string, content string")
    rows = search.literal_sites(search.literals(Code(parse_code(files)).literals)).select("kind", "value", "count", "address", "line")
    assert sorted(map(tuple, rows.collect())) == [
        ("number", "10", 2, "a.py#X", 3), ("number", "10", 2, "a.py#f", 2), ("string", "ab", 2, "a.py#f", 2), ("string", "ab", 2, "b.py#L1", 1)]
    assert {"address", "line"} <= set(QUERIES["literal_groups"](spark, "/root/testdata/sf0.001").columns)


def test_a_frequent_value_is_not_one_task(spark, monkeypatch):
    """Also the rest, long values among it, has its counts."""
    monkeypatch.setattr(search, "FREQUENT", 2)
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        value = F.when(F.col("id") % 2 == 0, "1").when(F.col("id") % 3 == 0, F.repeat(F.lit("x"), 2000)).otherwise((F.col("id") % 50).cast("string"))
        rows = spark.range(0, 1200, 1, 6).select(
            F.lit("number").alias("kind"), value.alias("value"), F.concat(F.lit("a#"), "id").alias("address"), F.lit(1).alias("line"), F.col("id").alias("byte"))
        got = search.literal_sites(rows).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    assert len({r.task for r in got if r.value == "1"}) == 6
    want = {}
    for r in rows.collect():
        want.setdefault(r.value, []).append(r.address)
    assert sorted((r.value, r["count"], r.address) for r in got) == sorted((v, len(a), x) for v, a in want.items() for x in a)
