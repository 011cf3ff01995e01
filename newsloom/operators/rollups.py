"""Daily rollups that merge: counts, quantiles and distinct values over any window of days, without its rows.

A day's row of a key holds the number of its rows, a KLL sketch of their values and an HLL sketch of their identities. A
window merges the days that it covers. Sketches have a bounded size whatever they saw: the rank of a quantile is off by less
than RANK_ERROR in 99 of 100 sketches, a distinct count by less than DISTINCT_ERROR of itself. exact_quantiles() is the
exact way beside them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The sketches' sizes (as functions of Spark have them by default), and their errors.
KLL_K, HLL_LG_K = 200, 12
RANK_ERROR, DISTINCT_ERROR = 0.0165, 0.05


def daily(rows: DataFrame, day: str, value: Column, identity: Column, *keys: str) -> DataFrame:
    """day, keys, n, values, identities: a row for each day and key. Null values and identities are counted in n alone."""
    sketch = F.kll_sketch_agg_double(value.cast("double"), F.lit(KLL_K))
    return rows.groupBy(day, *keys).agg(F.count(F.lit(1)).alias("n"), sketch.alias("values"), F.hll_sketch_agg(identity.cast("string"), F.lit(HLL_LG_K)).alias("identities"))


def windowed(rollup: DataFrame, day: str, as_of, days: tuple[int, ...], shares: dict[str, float], *keys: str) -> DataFrame:
    """days, keys, n, a column for each share (the value that so many rows don't exceed), distinct: of the last so many
    days up to as_of, that day included. Windows without a row have none."""
    age = F.datediff(F.lit(as_of), F.col(day))
    within = rollup.where((age >= 0) & (age < max(days))).withColumn("days", F.explode(F.filter(F.array(*map(F.lit, days)), lambda d: d > age)))
    merged = within.groupBy("days", *keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("values").alias("values"), F.hll_sketch_estimate(F.hll_union_agg("identities")).alias("distinct"))
    found = [F.when(F.kll_sketch_get_n_double("values") > 0, F.kll_sketch_get_quantile_double("values", F.lit(share))).alias(name) for name, share in shares.items()]
    return merged.select("days", *keys, "n", *found, "distinct")


def exact_quantiles(rows: DataFrame, value: str, share: float, *keys: str) -> DataFrame:
    """keys and quantile: the least value that at least `share` of a key's rows don't exceed. Rows are counted by value
    first, so that a key's window holds its distinct values; null values don't count."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy(*keys)
    upto = F.sum("n").over(by.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = counts.withColumn("upto", upto).withColumn("all", F.sum("n").over(by))
    return ranked.where(F.col("upto") >= F.lit(share) * F.col("all")).groupBy(*keys).agg(F.min(value).alias("quantile"))
