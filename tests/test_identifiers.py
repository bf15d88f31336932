"""Which columns tell customers apart: sketches of all columns, exact counts near the limit."""

from pyspark.sql import functions as F

from ticketlens.operators import profile


def customers(spark, rows=20_000):
    """10 rows a customer; ``nearly``: 1.0 to 1.1 customers a value."""
    c = F.floor(F.col("id") / 10)
    return spark.range(rows).select(
        c.alias("ID_CLIENTE"),
        (c * 3.5).alias("own"),
        (F.col("id") % 7).cast("int").alias("shared"),
        F.when(c % 25 == 0, c + 1).otherwise(c).cast("double").alias("under"),
        F.when(c % 15 == 0, c + 1).otherwise(c).cast("double").alias("over"),
        F.lit(None).cast("double").alias("empty"),
        F.lit("x").alias("word"),
    )


def exact(rows, name):
    pairs = {(r[name], r.ID_CLIENTE) for r in rows if r[name] is not None}
    return len({v for v, _ in pairs}), len(pairs)


def test_found_and_counted_near_the_limit(spark):
    df = customers(spark)
    rows = df.collect()
    names = ["own", "shared", "under", "over", "empty"]
    counted = {r.feature: (r["values"], r.pairs) for r in profile.identifier_counts(df, names).collect()}
    assert counted == {n: exact(rows, n) for n in names}
    found = {r.feature: r for r in profile.identifying_features(df).collect()}
    assert set(found) == set(names)  # numeric columns without the customer
    assert {n for n, r in found.items() if r.identifying} == {"own", "under"}
    assert found["under"].exact and found["over"].exact and not found["shared"].exact
    assert found["under"].mean_customers <= 1.05 < found["over"].mean_customers
    assert (found["empty"]["values"], found["empty"].mean_customers) == (0, None)
    for r in profile.identifier_sketches(df, names).collect():
        for got, want in zip((r["values"], r.pairs), counted[r.feature]):
            assert abs(got - want) <= 4 * 1.04 / 2**7 * want


def test_one_scan_and_no_row_moved(spark):
    plan = profile.identifier_sketches(customers(spark), ["own", "shared"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Range (") == 1 and plan.count("Exchange") == 1 and "hashpartitioning" not in plan


def test_odd_rows(spark):
    rows = [(None, 1.0), (1, 1.0), (1, -0.0), (2, 0.0), (3, None), (None, float("inf")), (None, float("inf"))]
    df = spark.createDataFrame(rows, "ID_CLIENTE int, `v.1` double")
    for counts in (profile.identifier_counts, profile.identifier_sketches):
        row = counts(df, ["v.1"]).first()
        assert (row["values"], row.pairs) == (3, 5), counts  # a missing customer is one customer
    assert profile.identifying_features(df, ["v.1"]).first().identifying is False
    empty = profile.identifying_features(df.filter("false")).first()
    assert (empty.feature, empty["values"], empty.identifying) == ("v.1", 0, False)
    assert profile.identifying_features(df.select("ID_CLIENTE")).count() == 0
    assert profile.identifier_counts(df, []).count() == profile.identifier_sketches(df, []).count() == 0


def test_zero_customer_is_not_a_missing_one(spark):
    df = spark.createDataFrame([(0, 1), (None, 1), (42, 1)], "ID_CLIENTE int, v int")
    assert profile.identifier_sketches(df, ["v"]).first().pairs == profile.identifier_counts(df, ["v"]).first().pairs == 3
