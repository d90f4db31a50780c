"""Dominant values, stratified samples and splits. Chance is the md5 of seed and id: the same on every run and cluster.

Ranks inside a stratum would sort a stratum of any size in one task; here each row's rank comes from counts of hash
buckets, which are summed first, plus its rank inside its own bucket. There are as many buckets as the table's size asks for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_ROWS = 50_000  # rows that one bucket of the largest possible stratum holds, on average


def chance(seed: int, key: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))


def dominant(values: Column, default: str = "unknown") -> Column:
    """The most frequent element, the earliest of equals; ``default`` for null and empty arrays."""
    kept = F.filter(values, lambda v: v.isNotNull())
    count = lambda v: F.size(F.filter(kept, lambda x: x == v))
    best = F.array_max(F.transform(F.array_distinct(kept), lambda v: F.struct(count(v).alias("n"), (-F.array_position(kept, v)).alias("at"), v.alias("v"))))
    return F.coalesce(best["v"], F.lit(default))


def fractions(df: DataFrame, column: str) -> DataFrame:
    """(column, rows, fraction) of the non-null values."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("rows"))
    total = df.where(F.col(column).isNotNull()).agg(F.count("*").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select(column, "rows", (F.col("rows") / F.col("total")).alias("fraction"))  # total is one row


def hash_rank(df: DataFrame, stratum: str, key: str, seed: int, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``df`` plus rn, the row's place 1..n in its stratum by (md5, key), and cnt, the stratum's size. Null is a stratum too."""
    buckets = max(1, -(-df.count() // bucket_rows))  # enough for a stratum that holds all rows
    # ranges of the first 28 bits, so that buckets lie in the order of the hashes
    bucket = F.floor(F.conv(F.substring("_h", 1, 7), 16, 10).cast("long") * buckets / F.lit(1 << 28)).cast("long")
    hashed = df.withColumn("_h", chance(seed, key)).withColumn("_b", bucket)
    counts = hashed.groupBy(F.col(stratum).alias("_s"), F.col("_b").alias("_c")).agg(F.count("*").alias("_n"))
    every = Window.partitionBy("_s")
    before = counts.select("_s", "_c", (F.sum("_n").over(every.orderBy("_c")) - F.col("_n")).alias("_before"), F.sum("_n").over(every).alias("cnt"))
    ranked = hashed.withColumn("_r", F.row_number().over(Window.partitionBy(stratum, "_b").orderBy("_h", key)))
    placed = ranked.join(before, F.col(stratum).eqNullSafe(F.col("_s")) & (F.col("_b") == F.col("_c")))
    return placed.withColumn("rn", F.col("_before") + F.col("_r")).select(*df.columns, "cnt", "rn")


def quotas(df: DataFrame, stratum: str, n: int) -> DataFrame:
    """(stratum, cnt, quota): proportional, at least 1, half-even; strata are visited by falling size and the last takes what
    is left, never below 0; none exceeds its size."""
    counts = df.groupBy(stratum).agg(F.count("*").alias("cnt"))
    w = Window.orderBy(F.desc("cnt"), stratum)  # over one row a stratum
    every = Window.partitionBy(F.lit(1))
    q = counts.select(stratum, "cnt", F.sum("cnt").over(every).alias("total"), F.row_number().over(w).alias("k"), F.count("*").over(every).alias("strata"))
    q = q.withColumn("size", F.least(F.lit(n), F.col("total")))
    q = q.withColumn("share", F.least("cnt", F.greatest(F.lit(1), F.bround(F.col("size") * F.col("cnt") / F.col("total")).cast("long"))))
    prior = F.coalesce(F.sum("share").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    quota = F.when(F.col("k") == F.col("strata"), F.least("cnt", F.greatest(F.lit(0), F.col("size") - prior))).otherwise(F.col("share"))
    return q.select(stratum, "cnt", quota.cast("long").alias("quota"))


def stratified_sample(df: DataFrame, n: int, stratum: str, key: str, seed: int = 42) -> DataFrame:
    ranked = hash_rank(df, stratum, key, seed)
    return ranked.join(F.broadcast(quotas(df, stratum, n).select(stratum, "quota")), stratum).where("rn <= quota").drop("rn", "cnt", "quota")


def fold_tiny(df: DataFrame, stratum: str, least: int = 2, other: str = "_other") -> DataFrame:
    """Strata of fewer than ``least`` rows become ``other``; if fewer than two strata are left, all rows are of ``other``, which
    is no stratification."""
    counts = df.groupBy(stratum).agg(F.count("*").alias("_n")).withColumn("_to", F.when(F.col("_n") < least, F.lit(other)).otherwise(F.col(stratum)))
    left = F.size(F.collect_set("_to").over(Window.partitionBy(F.lit(1))))  # a row a stratum
    to = counts.select(F.col(stratum).alias("_s"), F.when(left < 2, F.lit(other)).otherwise(F.col("_to")).alias("_to"))
    kept = df.join(to, F.col(stratum).eqNullSafe(F.col("_s")), "left")
    return kept.select(*[F.col("_to").alias(c) if c == stratum else F.col(c) for c in df.columns])


def stratified_split(df: DataFrame, stratum: str, key: str, ratios: tuple[float, float, float] = (0.70, 0.15, 0.15), seed: int = 42) -> DataFrame:
    """``df`` plus split: every stratum cut at its rounded shares, so splits are disjoint and cover all rows."""
    if abs(sum(ratios) - 1) > 1e-6:
        raise ValueError("ratios must sum to 1")
    ranked = hash_rank(df, stratum, key, seed)
    first, second = F.round(F.col("cnt") * ratios[0]), F.round(F.col("cnt") * (ratios[0] + ratios[1]))
    return ranked.withColumn("split", F.when(F.col("rn") <= first, "train").when(F.col("rn") <= second, "val").otherwise("test")).drop("rn", "cnt")


def nested_subsets(df: DataFrame, sizes: list[int], stratum: str, key: str, seed: int = 42) -> DataFrame:
    """Rows with the label of every subset they are in, from one ranking; a smaller subset lies in each larger one. Labels are the size in
    thousands with its decimals, so that 2500 and 2000 differ; a size beyond the table means all of it."""
    ranked = hash_rank(df, stratum, key, seed)
    every = None
    for size in sizes:
        q = quotas(df, stratum, size).select(stratum, F.lit(f"{size / 1000:g}k").alias("subset"), "quota")
        every = q if every is None else every.unionByName(q)
    of = every.groupBy(F.col(stratum).alias("_s")).agg(F.collect_list(F.struct("subset", "quota")).alias("_q"))  # a row a stratum
    placed = ranked.join(F.broadcast(of), F.col(stratum).eqNullSafe(F.col("_s")))
    inside = F.explode(F.filter("_q", lambda x: F.col("rn") <= x["quota"]))
    return placed.select(*df.columns, inside.alias("_x")).select(*df.columns, "_x.subset")


def first_by_chance(df: DataFrame, n: int, key: str, seed: int) -> DataFrame:
    return df.orderBy(chance(seed, key), key).limit(n)


def review_sample(df: DataFrame, n: int, tags: str, key: str, seed: int = 42) -> DataFrame:
    """Half rows with an entity, half without, as far as there are any; every row of a table without tags is alike."""
    if tags not in df.columns:
        return first_by_chance(df, n, key, seed)
    has = F.exists(tags, lambda t: t != "O")
    pos = first_by_chance(df.where(has), n // 2, key, seed)
    taken = pos.agg(F.count("*").alias("_taken"))
    neg = first_by_chance(df.where(~F.coalesce(has, F.lit(False))), n, key, seed).withColumn("_r", F.row_number().over(Window.orderBy(chance(seed, key), key)))  # n rows at most
    return pos.unionByName(neg.crossJoin(taken).where(F.col("_r") <= F.lit(n) - F.col("_taken")).drop("_r", "_taken"))
