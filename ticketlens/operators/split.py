"""Exact, reproducible splits of a table into train, validation and test.

Rows are ranked by a hash of their key inside each label class. The rank of every row is never computed:
only the hash value at each cut is, from a histogram of hash prefixes and the few rows in the bucket a cut
falls into. Assigning the split is then a comparison of two strings, without moving any row.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketlens import params
from ticketlens.operators.joins import lookup_join
from ticketlens.runtime import bounded, local_table, pinned, small_rows

PREFIX_DIGITS = 5  # 16^5 buckets per class: one cut bucket holds about a millionth of the class
_HASH = "__hash"
_AFTER_ALL = "~"  # sorts after every hash


def key_hash(key: str, seed: int, stand_in: Column | None = None) -> Column:
    """Hash of a row's key. For a null key ``stand_in`` is hashed; without one the hash is null."""
    value = F.col(key).cast("string")
    return F.md5(F.concat(value if stand_in is None else F.coalesce(value, stand_in), F.lit(f":{seed}")))


def row_text(df: DataFrame) -> Column:
    """All of a row as text: tells rows without a key apart."""
    return F.concat(F.lit("row:"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)])))


def check_shares(train: float, validation: float, test: float) -> None:
    if abs(train + validation + test - 1.0) >= 0.001:
        raise ValueError("the shares of the splits must sum to 1")


def _share(value: float) -> Fraction:
    return Fraction(str(value)).limit_denominator(1_000_000)


def split_cuts(df: DataFrame, label: str, key: str, seed: int, shares: tuple[float, float, float]) -> DataFrame:
    """One row per label class: the hash values where validation and test begin, and the class size."""
    check_shares(*shares)
    last = _share(shares[2])
    first = 1 - _share(shares[1]) - last
    keyed = df.select(F.col(label), key_hash(key, seed, row_text(df)).alias(_HASH))
    keyed = keyed.withColumn("bucket", F.substring(_HASH, 1, PREFIX_DIGITS))

    by_class = Window.partitionBy(label)  # over the histogram: at most 16^5 rows per class
    upto = by_class.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    histogram = (
        keyed.groupBy(label, "bucket")
        .agg(F.count("*").alias("rows"))
        .withColumn("total", F.sum("rows").over(by_class))
        .withColumn("before", F.sum("rows").over(upto) - F.col("rows"))
    )

    def position(share: Fraction) -> Column:
        return F.expr(f"total * {share.numerator} div {share.denominator}")

    cut_list = F.array(
        F.struct(F.lit(1).alias("cut"), position(first).alias("position")),
        F.struct(F.lit(2).alias("cut"), position(1 - last).alias("position")),
    )
    holds_cut = (F.col("position") >= F.col("before")) & (F.col("position") < F.col("before") + F.col("rows"))
    cut_buckets = (
        histogram.select("*", F.inline(cut_list))
        .filter(holds_cut)
        .select(label, "bucket", "cut", "position", "before", "total")
    )
    # Two rows per class; a literal table if that is few, which is checked, and a plain join otherwise.
    cut_buckets = bounded(cut_buckets)
    inside = (
        keyed.join(cut_buckets, [label, "bucket"])
        .groupBy(label, "cut", "position", "before", "total", _HASH)
        .agg(F.count("*").alias("rows"))
    )
    within = (
        Window.partitionBy(label, "cut").orderBy(_HASH).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        inside.withColumn("upto", F.col("before") + F.sum("rows").over(within))
        .filter((F.col("position") < F.col("upto")) & (F.col("position") >= F.col("upto") - F.col("rows")))
        .groupBy(label)
        .agg(
            F.max(F.when(F.col("cut") == 1, F.col(_HASH))).alias("validation_from"),
            F.max(F.when(F.col("cut") == 2, F.col(_HASH))).alias("test_from"),
            F.max("total").alias("class_rows"),
        )
    )


def stratified_split(
    df: DataFrame,
    label: str = params.LABEL,
    key: str = params.TICKET,
    seed: int = params.SEED,
    shares: tuple[float, float, float] = params.SPLIT_SHARES,
) -> DataFrame:
    """Add a ``split`` column; each class keeps the given shares to the row.

    ``key`` tells rows apart. Copies of a key get one hash and so stay in one split. Rows without a key are told apart by
    all their columns. ``label`` is not null.
    """
    cuts = split_cuts(df, label, key, seed, shares)
    rows = small_rows(cuts)
    hashed = df.withColumn(_HASH, key_hash(key, seed, row_text(df)))
    if rows is not None:
        placed = hashed.join(F.broadcast(local_table(df.sparkSession, rows, cuts.schema)), label, "left")
    else:  # a label with very many classes
        placed = lookup_join(hashed, pinned(cuts), [label], "class_rows", [key])
    split = (
        F.when(F.col(_HASH) < F.coalesce("validation_from", F.lit(_AFTER_ALL)), "train")
        .when(F.col(_HASH) < F.coalesce("test_from", F.lit(_AFTER_ALL)), "validation")
        .otherwise("test")
    )
    return placed.select(*[F.col(f"`{c}`") for c in df.columns], split.alias("split"))


def customer_targets(df: DataFrame, customer: str = params.CUSTOMER, label: str = params.LABEL) -> DataFrame:
    """One row per customer: the highest label and the number of rows."""
    return df.groupBy(customer).agg(F.max(label).alias("customer_target"), F.count("*").alias("rows"))


def customer_split(
    df: DataFrame,
    customer: str = params.CUSTOMER,
    label: str = params.LABEL,
    seed: int = params.SEED,
    shares: tuple[float, float, float] = params.SPLIT_SHARES,
    salt_by: list[str] | None = None,
) -> DataFrame:
    """Split by customer: all rows of a customer share a split, classes are balanced over customers.

    Rows without a customer are split one by one, in the same shares.
    """
    known, unknown = df.filter(F.col(customer).isNotNull()), df.filter(F.col(customer).isNull())
    customers = pinned(customer_targets(known, customer, label))  # read three times below
    placed = stratified_split(customers, "customer_target", customer, seed, shares)
    joined = lookup_join(known, pinned(placed.drop("customer_target")), [customer], "rows", salt_by)
    single = stratified_split(unknown, label, customer, seed, shares)
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], "split").unionByName(single)


def split_overlap(df: DataFrame, customer: str = params.CUSTOMER) -> DataFrame:
    """Customers in all, and customers found in more than one split."""
    per_customer = df.groupBy(customer).agg(F.count_distinct("split").alias("splits"))
    return per_customer.agg(
        F.count("*").alias("customers"),
        F.coalesce(F.sum((F.col("splits") > 1).cast("long")), F.lit(0)).alias("overlapping"),
    )


def temporal_split(df: DataFrame, time: str, validation_from: str, test_from: str) -> DataFrame:
    """Split by time: train before ``validation_from``, test from ``test_from`` on. Rows without a time have no split."""
    kind = df.schema[time].dataType.simpleString()
    return df.withColumn(
        "split",
        F.when(F.col(time) < F.lit(validation_from).cast(kind), "train")
        .when(F.col(time) < F.lit(test_from).cast(kind), "validation")
        .when(F.col(time).isNotNull(), "test"),
    )


def customer_folds(df: DataFrame, folds: int, customer: str = params.CUSTOMER, seed: int = params.SEED) -> DataFrame:
    """Add a ``fold`` in [0, folds): a customer's rows share a fold. A plain expression, no row is moved."""
    digits = F.conv(F.substring(key_hash(customer, seed), 1, 12), 16, 10).cast("long")
    return df.withColumn("fold", (digits % folds).cast("int"))
