"""Two building blocks that stay whole and spread out when one key holds much of the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 16
FINE_HEX_DIGITS = 2


def salted_lookup(
    left: DataFrame, lookup: DataFrame, keys: str | Sequence[str], spread_by: Sequence[str], salts: int = SALTS
) -> DataFrame:
    """Left join of many rows with a lookup that has one row per key.

    A frequent key is spread over ``salts`` tasks: every lookup row is repeated once per salt, every
    left row takes the salt of its ``spread_by`` columns, which is the same on each run. Rows without
    a key match nothing. Where the repeated lookup is below the broadcast threshold Spark
    broadcasts it instead; no hint forces that.
    """
    on = [keys] if isinstance(keys, str) else list(keys)
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in spread_by]), F.lit(salts)).cast("int")
    repeated = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.withColumn("_salt", salt).join(repeated, [*on, "_salt"], "left").drop("_salt")


def running_index(df: DataFrame, keys: Sequence[str], coarse: Sequence[Column], tie: Column, name: str) -> DataFrame:
    """0-based running index within ``keys``, ordered by ``coarse``, then md5 of ``tie``, then ``tie``.

    A plain window would put all rows of a frequent key into one task. Here every key is cut into chunks that follow the
    order (the coarse columns, then leading digits of the md5): rows are ranked inside their chunk, and the rows in the
    chunks before it are added from counts that are partial before their shuffle. There is one plan for all keys and
    sizes; the counts read the key columns only. Keys and coarse columns must not be null.
    """
    names = [f"_c{i}" for i in range(len(coarse))]
    cut = df.withColumns({n: c for n, c in zip(names, coarse)}).withColumn(
        "_md5", F.md5(F.coalesce(tie.cast("string"), F.lit("")))
    ).withColumn("_fine", F.substring("_md5", 1, FINE_HEX_DIGITS))
    chunk = [*keys, *names, "_fine"]
    before = Window.partitionBy(*keys).orderBy(*names, "_fine").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        cut.groupBy(*chunk).agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    )
    inside = Window.partitionBy(*chunk).orderBy("_md5", tie)
    ranked = cut.withColumn("_rank", F.row_number().over(inside))
    index = (F.col("_before") + F.col("_rank") - 1).cast("long").alias(name)
    return ranked.join(offsets, chunk).select(*df.columns, index)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The whole first row per key, by aggregation: copies shrink before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")
    )
    return picked.select(*[F.col(c) if c in keys else F.col(f"_first.{c}").alias(c) for c in df.columns])
