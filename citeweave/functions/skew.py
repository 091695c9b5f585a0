"""Joins and running sums in which no key, however hot, lies in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from citeweave.session import cut

#: A key with more than this share of the sampled rows is hot; at most 1 / HOT_SHARE keys are, so their list is small.
HOT_SHARE = 0.02
#: Rows of a hot key are spread over so many partitions.
SALTS = 24
#: One row of so many is looked at to find hot keys. This only steers the join; every row is joined whatever it finds.
ONE_IN = 61


def hot_keys(df: DataFrame, on: list[str], row_id: Column, share: float = HOT_SHARE) -> list[tuple]:
    """Keys with more than `share` of a hashed sample of df's rows (nulls never count); at most 1 / share of them."""
    some = df.where(F.pmod(F.xxhash64(row_id, F.lit(11)), F.lit(ONE_IN)) == 0).dropna(subset=on)
    seen = Observation()
    counted = some.observe(seen, F.count(F.lit(1)).alias("n")).groupBy(*on).count()
    top = counted.orderBy(F.desc("count"), *on).limit(int(1 / share) + 1).collect()
    if not top:  # nothing was observed either
        return []
    total = seen.get["n"]
    return [tuple(r[c] for c in on) for r in top if r["count"] > max(50, share * total)]


def lookup(many: DataFrame, one: DataFrame, on: list[str], row_id: Column, how: str = "left") -> DataFrame:
    """many joined to one (unique on `on`) with equal keys; nulls match nothing.

    Rows of hot keys get one of SALTS salts, and the hot keys' rows of `one` are repeated for each salt, so that no
    task holds a whole hot key; `one` grows by at most SALTS / HOT_SHARE rows.
    """
    hot = hot_keys(many, on, row_id)
    if not hot:
        return many.join(one, on, how)
    is_hot = reduce(lambda a, b: a | b, (reduce(lambda a, b: a & b, (F.col(c) == F.lit(v) for c, v in zip(on, key))) for key in hot))
    is_hot = F.coalesce(is_hot, F.lit(False))
    left = many.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(row_id, F.lit(5)), F.lit(SALTS))).otherwise(F.lit(0)).cast("int"))
    right = one.withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def among(on: list[str], keys: list[tuple]) -> Column:
    """Whether the columns `on` hold one of the keys; false for nulls."""
    is_one = reduce(lambda a, b: a | b, (reduce(lambda a, b: a & b, (F.col(c) == F.lit(v) for c, v in zip(on, key))) for key in keys), F.lit(False))
    return F.coalesce(is_one, F.lit(False))


def running(df: DataFrame, by: list[str], order: list, weight: Column, name: str) -> DataFrame:
    """df with `name`: the sum of weight over the rows before each in its group, in the order given, which has no ties.

    Rows are range-partitioned by group and order, summed per part, and summed on within the part: a task holds one
    part, and per group there is one row for each part it reaches into. Nulls in `by` are a group of their own.
    """
    parts = cut(df.repartitionByRange(*by, *order).withColumn("_pid", F.spark_partition_id()))
    before = Window.partitionBy(*by).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    sums = parts.groupBy(*by, "_pid").agg(F.sum(weight).alias("_s")).withColumn("_from", F.coalesce(F.sum("_s").over(before), F.lit(0))).drop("_s")
    within = Window.partitionBy(*by, "_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = parts.withColumn("_in", F.coalesce(F.sum(weight).over(within), F.lit(0)))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*by, "_pid"]]
    return own.alias("a").join(sums.alias("b"), same).select(*(F.col(f"a.{c}") for c in df.columns), (F.col("_from") + F.col("_in")).alias(name))


def row_numbers(df: DataFrame, by: list[str], order: list, name: str, hot: list[tuple]) -> DataFrame:
    """df with the 1-based place of each row in its group; groups in `hot` are numbered in parts (see running)."""
    w = Window.partitionBy(*by).orderBy(*order)
    cold = df.where(~among(by, hot)).withColumn(name, F.row_number().over(w)) if hot else df.withColumn(name, F.row_number().over(w))
    if not hot:
        return cold
    return cold.unionByName(running(df.where(among(by, hot)), by, order, F.lit(1), name).withColumn(name, (F.col(name) + 1).cast("int")))
