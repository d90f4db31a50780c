"""Scans with projection and locale filter, the query-product join and the roll-up to one row a query."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def resolve(folder: str, name: str, nested: str = "shopping_queries_dataset") -> str:
    """The first of ``folder/name`` and ``folder/nested/name`` that exists; the error names both."""
    tried = [Path(folder) / name, Path(folder) / nested / name]
    for p in tried:
        if p.exists():
            return str(p)
    raise FileNotFoundError(f"neither {tried[0]} nor {tried[1]} exists")


def scan(spark: SparkSession, path: str, columns: list[str] | None = None, locale: str | None = None) -> DataFrame:
    """A parquet scan; projection and the equality filter reach the files. No locale, no filter; null is no locale."""
    df = spark.read.parquet(path)
    if locale:
        df = df.where(F.col("product_locale") == locale)
    return df.select(*columns) if columns else df


def join_products(examples: DataFrame, products: DataFrame, keys: tuple[str, ...] = ("product_id", "product_locale")) -> DataFrame:
    """Left join on the composite key; clashing product columns get the suffix ``_product``, unmatched rows stay."""
    clash = {c: f"{c}_product" for c in products.columns if c in examples.columns and c not in keys}
    return examples.join(products.withColumnsRenamed(clash), list(keys), "left")


def unmatched(joined: DataFrame, column: str = "product_title") -> DataFrame:
    return joined.agg(F.count("*").alias("rows"), F.count_if(F.col(column).isNull()).alias("unmatched"))


def roll_up(joined: DataFrame, columns: list[str], order: list[Column], label: str = "esci_label") -> DataFrame:
    """One row per non-null query: per metadata column the distinct values in first-seen order, and all labels, repeats and
    nulls included, in row order. Absent columns are skipped; none present leaves the distinct queries.

    One pass: a row's values and its label become (query, column, value), and are counted with map-side combining before any
    list is built; values merge to their first place, labels only with others of the same place. A query's one list is
    then what the result holds.
    """
    present = [c for c in columns if c in joined.columns]
    if not present:
        return joined.where(F.col("query").isNotNull()).select("query").distinct()
    at = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    known = joined.where(F.col("query").isNotNull()).withColumn("_o", at)
    cell = lambda c, v, own: F.struct(F.lit(c).alias("c"), v.alias("v"), F.when(F.lit(own), F.col("_o")).alias("p"))
    values = F.filter(F.array(*[cell(i, F.col(c), False) for i, c in enumerate(present)]), lambda x: x["v"].isNotNull())
    label_of = F.array(cell(-1, F.col(label) if label in joined.columns else F.lit(None).cast("string"), True))
    each = known.select("query", "_o", F.explode(F.concat(label_of, values)).alias("x")).select("query", "_o", "x.*")
    first = each.groupBy("query", "c", "v", "p").agg(F.min("_o").alias("o"), F.count("*").cast("int").alias("n"))
    lists = first.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("c", "o", "v", "n"))).alias("l"))
    pick = lambda i: F.transform(F.filter("l", lambda x: x["c"] == i), lambda x: x["v"])
    labels = F.flatten(F.transform(F.filter("l", lambda x: x["c"] == -1), lambda x: F.array_repeat(x["v"], x["n"])))
    return lists.select("query", *[pick(i).alias(c) for i, c in enumerate(present)], *([labels.alias(label)] if label in joined.columns else []))


def null_profile(df: DataFrame) -> DataFrame:
    """(column, nulls, rows) of every column in one pass."""
    one = df.agg(F.count("*").alias("rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return one.unpivot(["rows"], df.columns, "column", "nulls").select("column", "nulls", "rows")


def corpus(df: DataFrame, columns: list[str], order: list[str], limit: int | None = None) -> DataFrame:
    """(text, column_no): distinct trimmed texts of several columns, each where it is first seen, column by column; with
    ``limit`` the first so many."""
    rows = df.select(*order, F.explode(F.array(*[F.struct(F.lit(i).alias("column_no"), F.trim(c).alias("text")) for i, c in enumerate(columns) if c in df.columns])).alias("x")).select(*order, "x.*")
    first = rows.where("text is not null and text <> ''").groupBy("text").agg(F.min(F.struct("column_no", *order)).alias("o"))
    if limit:
        first = first.orderBy("o", "text").limit(limit)
    return first.select("text", "o.column_no")
