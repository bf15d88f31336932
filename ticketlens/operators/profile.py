"""Profiles of a ticket table: label and split shares, missing values, rows per customer, identifiers, drift."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketlens import params, schemas
from ticketlens.runtime import local_table, settings, shuffle_parts

#: A column whose values stand for at most this many customers on average tells customers apart.
IDENTIFYING_MEAN = 1.05
#: Distinct-count sketches have 2 to this power registers (16 KB a column).
SKETCH_BITS = 14
#: Cells (rows times columns) that a task of the exact counts takes.
TASK_CELLS = 4_000_000


def label_distribution(df: DataFrame, label: str = params.LABEL) -> DataFrame:
    """Rows in all, without and with a cancellation, and the share of cancellations in percent."""
    positives = F.coalesce(F.sum(F.col(label).cast("long")), F.lit(0))
    return df.agg(F.count("*").alias("total"), positives.alias("cancelled")).select(
        "total",
        (F.col("total") - F.col("cancelled")).alias("active"),
        "cancelled",
        (F.col("cancelled") * 100.0 / F.nullif("total", F.lit(0))).alias("cancelled_pct"),
    )


def split_distribution(df: DataFrame, label: str = params.LABEL) -> DataFrame:
    """Rows, share of all rows in percent and label counts of each split."""
    counts = df.groupBy("split").agg(
        F.count("*").alias("rows"),
        F.sum((F.col(label) == 0).cast("long")).alias("label_0"),
        F.sum((F.col(label) == 1).cast("long")).alias("label_1"),
    )
    everything = F.sum("rows").over(Window.partitionBy(F.lit(1)))  # over one row per split
    return counts.withColumn("pct", F.col("rows") * 100.0 / everything)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per known value."""
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("rows"))


def missing_values(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per column: rows, known and missing values, share of known values in percent. One aggregate for all columns."""
    names = list(columns) if columns is not None else df.columns
    wide = df.agg(F.count("*").alias("__rows"), *[F.count(F.col(n)).alias(n) for n in names])
    known = wide.unpivot(["__rows"], names, "column_name", "known")
    return known.select(
        "column_name",
        F.col("__rows").alias("rows"),
        "known",
        (F.col("__rows") - F.col("known")).alias("missing"),
        (F.col("known") * 100.0 / F.nullif("__rows", F.lit(0))).alias("known_pct"),
    )


def preview(df: DataFrame, order_by: Sequence[str], rows: int = 2) -> DataFrame:
    return df.orderBy(*order_by).limit(rows)


def rows_per_customer(df: DataFrame, customer: str = params.CUSTOMER) -> DataFrame:
    return df.groupBy(customer).agg(F.count("*").alias("rows"))


def top_customers(df: DataFrame, n: int = 10, customer: str = params.CUSTOMER) -> DataFrame:
    return rows_per_customer(df, customer).orderBy(F.desc("rows"), customer).limit(n)


def customer_duplicates(df: DataFrame, customer: str = params.CUSTOMER) -> DataFrame:
    """Rows, distinct customers, surplus rows and mean rows per customer.

    Without the customer column there is nothing to count and the table is empty.
    """
    if customer not in df.columns:
        empty = "rows bigint, customers bigint, surplus bigint, mean_rows double"
        return df.sparkSession.createDataFrame([], empty)
    # Counting per customer first keeps one very frequent customer to a row per task. Like nunique, null is no customer.
    per_customer = rows_per_customer(df, customer)
    return per_customer.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.count(customer).alias("customers")
    ).select(
        "rows",
        "customers",
        (F.col("rows") - F.col("customers")).alias("surplus"),
        (F.col("rows") / F.nullif("customers", F.lit(0))).alias("mean_rows"),
    )


def identifier_check(df: DataFrame, value: str, customer: str = params.CUSTOMER) -> DataFrame:
    """Does a feature identify customers? Distinct values, those with one customer only, and customers per value."""
    pairs = df.filter(F.col(value).isNotNull()).groupBy(value, customer).agg(F.count("*").alias("rows"))
    per_value = pairs.groupBy(value).agg(F.count("*").alias("customers"))
    return per_value.agg(
        F.count("*").alias("values"),
        F.coalesce(F.sum((F.col("customers") == 1).cast("long")), F.lit(0)).alias("single_customer_values"),
        F.avg("customers").alias("mean_customers"),
        F.max("customers").alias("max_customers"),
    ).withColumn("single_pct", F.col("single_customer_values") * 100.0 / F.nullif("values", F.lit(0)))


def _values(df: DataFrame, name: str) -> Column:
    """A numeric column with one zero: -0.0 and 0.0 are one value, as in a grouping."""
    floating = isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType))
    return F.col(f"`{name}`") + F.lit(0.0) if floating else F.col(f"`{name}`")


def identifier_counts(df: DataFrame, columns: Sequence[str], customer: str = params.CUSTOMER) -> DataFrame:
    """(feature, values, pairs) exactly, for all columns in one pass: different values, and different (value, customer).

    A missing customer counts as one more customer; a column without values has a row of zeros.
    """
    if not columns:
        return df.sparkSession.createDataFrame([], "feature string, values long, pairs long")
    # Rows are dealt into tasks of so many cells that what one holds does not grow with the table; both for the rows and for the groups.
    kept = df.select(F.col(customer).alias("_customer"), *[_values(df, c).alias(c) for c in columns])
    spark = df.sparkSession
    tasks = -(-df.count() * len(columns) // TASK_CELLS)
    if tasks > 1:
        kept = kept.repartition(tasks, F.xxhash64(*[F.col(f"`{c}`") for c in kept.columns]))
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])
    known = kept.select("_customer", F.inline(cells))
    pairs = known.groupBy("feature", "value", "_customer").agg(F.lit(1).alias("one"))
    per_value = pairs.groupBy("feature", "value").agg(F.count("*").alias("customers"))
    known_value = F.col("value").isNotNull()
    counted = per_value.groupBy("feature").agg(
        F.count_if(known_value).alias("values"), F.coalesce(F.sum(F.when(known_value, F.col("customers"))), F.lit(0)).alias("pairs")
    )
    with settings(spark, **{"spark.sql.shuffle.partitions": str(max(shuffle_parts(spark), tasks))}):
        return local_table(spark, counted.collect(), counted.schema)  # a row per column


def identifier_sketches(df: DataFrame, columns: Sequence[str], customer: str = params.CUSTOMER, precision: int = SKETCH_BITS) -> DataFrame:
    """(feature, values, pairs) estimated, for all columns in one scan that moves a few KB per column and task.

    The distinct-count sketches have ``2 ** precision`` registers, a relative deviation of about ``1.04 / 2 ** (precision / 2)``.
    """
    if not columns:
        return df.sparkSession.createDataFrame([], "feature string, values long, pairs long")

    def estimate(hashed: Column, name: str) -> Column:
        sketch = F.hll_sketch_agg(F.when(F.col(f"`{name}`").isNotNull(), hashed), F.lit(precision))
        return F.coalesce(F.hll_sketch_estimate(sketch), F.lit(0)).cast("long")

    sums = []
    for i, name in enumerate(columns):
        value = _values(df, name)
        sums.append(estimate(F.xxhash64(value), name).alias(f"v{i}"))
        sums.append(estimate(F.xxhash64(value, F.col(customer).isNull(), F.col(customer)), name).alias(f"p{i}"))
    rows = [
        F.struct(F.lit(name).alias("feature"), F.col(f"v{i}").alias("values"), F.col(f"p{i}").alias("pairs"))
        for i, name in enumerate(columns)
    ]
    return df.agg(*sums).select(F.inline(F.array(*rows)))


def identifying_features(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    customer: str = params.CUSTOMER,
    limit: float = IDENTIFYING_MEAN,
    precision: int = SKETCH_BITS,
) -> DataFrame:
    """Which numeric columns tell customers apart: those whose values stand for at most ``limit`` customers on average.

    One scan sketches all columns. Only columns whose estimated mean lies within four deviations of ``limit`` are counted exactly, all of them
    in one pass; ``exact`` marks them. The default is every numeric column but the customer. A column without values has a null mean and is
    not identifying. Sketches of the same rows give the same estimate, whatever their order.
    """
    if columns is None:
        columns = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name != customer]
    sketched = identifier_sketches(df, columns, customer, precision).collect()  # a row per column of the table
    margin = 4 * 2**0.5 * 1.04 / 2 ** (precision / 2)
    near = [r.feature for r in sketched if r["values"] and abs(r.pairs / r["values"] / limit - 1) <= margin]
    counted = {r.feature: r for r in identifier_counts(df, near, customer).collect()} if near else {}
    rows = []
    for r in sketched:
        found = counted.get(r.feature, r)
        mean = max(1.0, found.pairs / found["values"]) if found["values"] else None
        rows.append((r.feature, found["values"], found.pairs, mean, mean is not None and mean <= limit, r.feature in counted))
    return local_table(df.sparkSession, rows, schemas.IDENTIFYING)


def drift(df: DataFrame, features: Sequence[str], bins: int = 10, base: str = "train") -> DataFrame:
    """Population stability index of each feature in each split against the base split.

    Bins are equally wide over the range of the base split; what lies outside falls into the end bins, a share of
    0 counts as 0.0001. Two passes (ranges, then one histogram of all features), no row is moved.
    """
    ranges = df.filter(F.col("split") == base).agg(
        *[F.min(F.col(f).cast("double")).alias(f"lo_{f}") for f in features],
        *[F.max(F.col(f).cast("double")).alias(f"hi_{f}") for f in features],
    ).first()

    def bin_of(name: str):
        low, high = ranges[f"lo_{name}"], ranges[f"hi_{name}"]
        if low is None:
            return F.lit(None).cast("int")
        if high <= low:
            return F.when(F.col(name).isNotNull(), F.lit(0))
        place = F.floor((F.col(name).cast("double") - F.lit(low)) / F.lit(high - low) * bins)
        return F.when(F.col(name).isNotNull(), F.least(F.greatest(place, F.lit(0)), F.lit(bins - 1)).cast("int"))

    cells = F.array(*[F.struct(F.lit(f).alias("feature"), bin_of(f).alias("bin")) for f in features])
    histogram = (
        df.select("split", F.inline(cells)).filter(F.col("bin").isNotNull()).groupBy("feature", "split", "bin").count()
    )
    # From here on there are at most features x splits x bins rows.
    wide = histogram.groupBy("feature", "split").agg(
        F.sum("count").alias("rows"),
        *[F.coalesce(F.sum(F.when(F.col("bin") == b, F.col("count"))), F.lit(0)).alias(f"b{b}") for b in range(bins)],
    )
    shares = wide.select(
        "feature",
        "split",
        "rows",
        F.array(*[F.greatest(F.col(f"b{b}") / F.col("rows"), F.lit(0.0001)) for b in range(bins)]).alias("shares"),
    )
    reference = shares.filter(F.col("split") == base).select("feature", F.col("shares").alias("base_shares"))
    terms = F.zip_with("shares", "base_shares", lambda a, e: (a - e) * F.log(a / e))
    return shares.join(reference, "feature").select(
        "feature", "split", "rows", F.aggregate(terms, F.lit(0.0), lambda t, x: t + x).alias("psi")
    )


def known_and_missing(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Per group: rows where each column is known (``known_<column>``) and where it is missing (``missing_<column>``)."""
    counts = []
    for name in columns:
        counts += [F.count(name).alias(f"known_{name}"), F.count_if(F.col(name).isNull()).alias(f"missing_{name}")]
    return df.groupBy(*by).agg(*counts)


def rates(df: DataFrame, by: Sequence[str], label: str = params.LABEL) -> DataFrame:
    """Per group: rows, rows with the label, their rate in percent, and its difference from the rate of all rows."""
    sums = df.groupBy(*by).agg(F.count("*").alias("total"), F.sum(F.col(label)).alias("cancelled"))
    overall = df.agg(F.sum(F.col(label)) * 100.0 / F.nullif(F.count("*"), F.lit(0))).scalar()
    rate = F.col("cancelled") * 100.0 / F.nullif(F.col("total"), F.lit(0))
    return sums.select(*by, "total", "cancelled", rate.alias("rate_pct"), (rate - overall).alias("delta_pct"))
