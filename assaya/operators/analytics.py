"""Grouped analytics over events and projects: first values, percentiles, shares, statistics, correlations, histograms, quartiles, first rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_known(column: str, seq: str) -> Column:
    """The first value in order that isn't null (A1)."""
    return F.min_by(column, F.when(F.col(column).isNotNull(), F.col(seq)))


def ordered_distinct(column: str, seq: str) -> Column:
    """Distinct values as they are first seen."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.col(column).alias("x"))))
    return F.array_distinct(F.transform(ordered, lambda s: s["x"]))


#: Parts of a group's range of values that are counted before single values are looked at.
PARTS = 4096


def _parts(df: DataFrame, keys: list[str], value: Column) -> tuple[DataFrame, DataFrame]:
    """Known values with their key and part of the key's range; rows before each part and rows of the key."""
    key = F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))  # structs are equal if their nulls are
    rows = df.select("*", key.alias("__k"), value.cast("double").alias("__v")).filter("__v IS NOT NULL")
    ends = rows.groupBy("__k").agg(F.min("__v").alias("__lo"), F.max("__v").alias("__hi"), F.count(F.lit(1)).alias("__n"))
    at = F.least(F.floor(F.try_divide((F.col("__v") - F.col("__lo")) * PARTS, F.col("__hi") - F.col("__lo"))), F.lit(PARTS - 1))
    rows = rows.join(ends, "__k").withColumn("__part", F.coalesce(at, F.lit(0))).drop("__lo", "__hi")
    counts = rows.groupBy("__k", "__part").agg(F.count(F.lit(1)).alias("__c"), F.first("__n").alias("__n"))
    before = F.sum("__c").over(Window.partitionBy("__k").orderBy("__part")) - F.col("__c")
    return rows, counts.withColumn("__before", before)


def percentiles(df: DataFrame, keys: list[str], value: Column, qs: list[float]) -> DataFrame:
    """``keys`` and q, the exact percentiles of a value with linear interpolation.

    Rows of each part of a key's range are counted first; single values are then only
    looked at in the parts that hold a wanted place, as counts of different values, so
    no task keeps all values of a key.
    """
    rows, parts = _parts(df, keys, value)
    places = F.array_distinct(F.flatten(F.array(*[F.array(f((F.col("__n") - 1) * F.lit(q)).cast("long")) for q in qs for f in (F.floor, F.ceil)])))
    ranks = parts.groupBy("__k").agg(F.first("__n").alias("__n")).select("__k", "__n", F.explode(places).alias("__rank"))
    wanted = ranks.join(parts.drop("__n"), "__k").filter((F.col("__rank") >= F.col("__before")) & (F.col("__rank") < F.col("__before") + F.col("__c"))).select("__k", "__n", "__part", "__rank", (F.col("__rank") - F.col("__before")).alias("__local"))
    held = rows.join(wanted.select("__k", "__part").distinct(), ["__k", "__part"], "left_semi").groupBy("__k", "__part", "__v").agg(F.count(F.lit(1)).alias("__m"))
    held = held.withColumn("__start", F.sum("__m").over(Window.partitionBy("__k", "__part").orderBy("__v")) - F.col("__m"))
    found = wanted.join(held, ["__k", "__part"]).filter((F.col("__local") >= F.col("__start")) & (F.col("__local") < F.col("__start") + F.col("__m")))
    out = found.groupBy("__k").agg(F.first("__n").alias("__n"), F.map_from_entries(F.collect_list(F.struct("__rank", "__v"))).alias("__at"))

    def one(q: float) -> Column:
        place = (F.col("__n") - 1) * F.lit(q)
        low, high = (F.element_at("__at", f(place).cast("long")) for f in (F.floor, F.ceil))
        return low + (high - low) * (place - F.floor(place))

    return out.select(*[F.col(f"__k.{k}").alias(k) for k in keys], F.array(*[one(q) for q in qs]).alias("q"))


def shares(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows with the share of their key's rows that aren't larger (P2): places within parts of a key's range, and the counts of the parts before."""
    rows, parts = _parts(df, keys, F.col(value))
    own = F.count(F.lit(1)).over(Window.partitionBy("__k", "__part").orderBy("__v").rangeBetween(Window.unboundedPreceding, 0))
    placed = rows.withColumn("__own", own).join(parts.select("__k", "__part", "__before"), ["__k", "__part"])
    return placed.withColumn("share", (F.col("__own") + F.col("__before")) / F.col("__n")).drop("__k", "__v", "__n", "__part", "__own", "__before")


def with_keys(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with the columns of ``other``, by keys that may be null."""
    if not keys:
        return df.join(other, F.lit(True), "left")
    named = other.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys]
    return df.join(named, same, "left").drop(*[f"__r_{k}" for k in keys])


def timing_stats(df: DataFrame, keys: list[str], value: str, qs: dict[str, float], digits: int = 4) -> DataFrame:
    """Rows, mean and exact percentiles of a value by ``keys``."""
    sums = df.groupBy(*keys).agg(F.count(value).alias("n"), F.round(F.avg(value), digits).alias("mean"))
    q = percentiles(df.select(*keys, value), keys, F.col(value), list(qs.values()))
    return with_keys(sums, q, keys).select(*keys, "n", "mean", *[F.round(F.col("q")[k], digits).alias(n) for k, n in enumerate(qs)])


def describe(df: DataFrame, keys: list[str], value: Column, digits: int = 4) -> DataFrame:
    """Rows, share without a value, and exact statistics of a value (A2, A3)."""
    r = lambda c: F.round(c, digits)
    rows = df.withColumn("__value", value.cast("double"))
    sums = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), F.count("__value").alias("n"), r(F.avg(F.col("__value").isNull().cast("double"))).alias("pct_no_impact"), r(F.avg("__value")).alias("mean"),
        r(F.stddev_samp("__value")).alias("std"), r(F.min("__value")).alias("lowest"), r(F.max("__value")).alias("highest"),
    )
    joined = with_keys(sums, percentiles(rows.select(*keys, "__value"), keys, F.col("__value"), [0.5]), keys)
    return joined.select(*keys, "total", "n", "pct_no_impact", "mean", r(F.col("q")[0]).alias("median"), "std", "lowest", "highest")


def poisoned_sum(column: str) -> Column:
    """A sum that is null if any part is."""
    return F.when(F.count_if(F.col(column).isNull()) == 0, F.sum(column))


def top_by(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rank", at).filter(F.col("rank") <= n)


def safe_corr(x: str, y: str) -> Column:
    """Pearson's r, null below three rows or without variance."""
    good = (F.count_if(F.col(x).isNotNull() & F.col(y).isNotNull()) >= 3) & (F.var_pop(x) > 0) & (F.var_pop(y) > 0)
    n, both = F.count(F.lit(1)), F.covar_pop(x, y)
    return F.when(good, F.try_divide(both, F.stddev_pop(x) * F.stddev_pop(y)) + 0 * n)


def phi(df: DataFrame, unit: str, code: str) -> DataFrame:
    """Correlation of the presence of each two codes over units (A42), from counts alone.

    Units are reduced to a bit for each code, so the pairs are those of codes.
    """
    present = df.select(unit, code).distinct()
    n = df.select(F.countDistinct(unit).alias("n"))
    sizes = present.groupBy(code).agg(F.count(F.lit(1)).alias("size"))
    own = present.groupBy(unit).agg(F.sort_array(F.collect_list(code)).alias("codes"))
    pairs = own.select(F.explode("codes").alias("code_a"), "codes").select("code_a", F.explode("codes").alias("code_b")).filter("code_a < code_b")
    both = pairs.groupBy("code_a", "code_b").agg(F.count(F.lit(1)).alias("both"))
    a, b = sizes.select(F.col(code).alias("code_a"), F.col("size").alias("a")), sizes.select(F.col(code).alias("code_b"), F.col("size").alias("b"))
    joined = both.join(a, "code_a").join(b, "code_b").join(F.broadcast(n), F.lit(True))  # n is one row
    top = F.col("n") * F.col("both").cast("double") - F.col("a").cast("double") * F.col("b")
    low = F.sqrt(F.col("a").cast("double") * F.col("b") * (F.col("n") - F.col("a")) * (F.col("n") - F.col("b")))
    return joined.select("code_a", "code_b", "both", F.round(F.try_divide(top, low), 6).alias("phi"))


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Counts in ``bins`` equal parts of the range."""
    edges = df.select(F.min(column).alias("lo"), F.max(column).alias("hi"))
    at = F.least(F.floor(F.try_divide((F.col(column) - F.col("lo")) * bins, F.col("hi") - F.col("lo"))), F.lit(bins - 1))
    return df.join(F.broadcast(edges), F.lit(True)).select(F.coalesce(at, F.lit(0)).cast("int").alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


def quartiles(df: DataFrame, column: str) -> DataFrame:
    """A quartile for each value, so equal values stay together."""
    edges = percentiles(df, [], F.col(column), [0.25, 0.5, 0.75])
    x = F.col(column)
    return df.join(F.broadcast(edges), F.lit(True)).withColumn("quartile", F.when(x <= F.col("q")[0], 1).when(x <= F.col("q")[1], 2).when(x <= F.col("q")[2], 3).otherwise(4)).drop("q")  # edges are one row


def first_in_order(df: DataFrame, score: str, key: str, wanted: DataFrame) -> DataFrame:
    """As many rows as the one row of ``wanted`` says, by score downwards and then by key (K9).

    Rows of equal whole scores are counted first, so that places are given within such a group; only the
    sums of groups are ordered in one task, and groups beyond the last place are left out before.
    """
    rows = df.withColumn("__part", F.floor(F.coalesce(F.col(score), F.lit(float("-inf")))).cast("double"))
    sizes = rows.groupBy("__part").agg(F.count(F.lit(1)).alias("size"))
    before = sizes.select("__part", (F.sum("size").over(Window.orderBy(F.desc("__part"))) - F.col("size")).alias("before"))
    open_parts = before.join(F.broadcast(wanted), F.col("before") < F.col("wanted"))
    at = F.row_number().over(Window.partitionBy("__part").orderBy(F.desc(score), key)) + F.col("before")
    return rows.join(open_parts, "__part").withColumn("__at", at).filter(F.col("__at") <= F.col("wanted")).drop("__part", "before", "wanted", "__at")
