"""Weak labels: candidate phrases from product metadata, matched to query tokens by type priority."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.functions.fuzzy import THRESHOLD, best_window
from quernstone.functions.text import squeeze
from quernstone.operators.metrics import ratio
from quernstone.schema import PRIORITY
from quernstone.session import tables
from quernstone.sources.files import write_conll

# fixed values: material and attribute words, size patterns
MATERIALS = (
    "leather", "cotton", "polyester", "nylon", "silk", "wool", "linen", "denim", "suede", "canvas", "rubber", "plastic", "metal", "aluminum", "aluminium",
    "stainless steel", "steel", "iron", "wood", "wooden", "bamboo", "ceramic", "glass", "titanium", "copper", "brass", "bronze", "velvet", "satin", "fleece",
    "foam", "latex", "vinyl", "acrylic", "polycarbonate", "silicone", "carbon fiber", "porcelain", "marble", "granite", "concrete", "cork", "hemp", "jute", "microfiber",
)
ATTRIBUTES = (
    "waterproof", "water resistant", "wireless", "bluetooth", "rechargeable", "portable", "organic", "natural", "vegan", "gluten free", "non gmo", "bpa free",
    "eco friendly", "biodegradable", "solar", "led", "usb", "cordless", "adjustable", "foldable", "collapsible", "heavy duty", "lightweight", "anti slip",
    "non stick", "dishwasher safe", "machine washable", "hypoallergenic", "unscented", "scented", "fragrance free", "indoor", "outdoor", "electric", "manual",
    "automatic", "digital", "magnetic", "insulated", "thermal", "heated", "cooling",
)
SIZES = (
    r"\b(\d+\.?\d*)\s*(oz|ounce|fl\s*oz|ml|liter|litre|l|gal|gallon)\b",
    r"\b(\d+\.?\d*)\s*(inch|in|inches|ft|feet|foot|cm|mm|m|meter)\b",
    r"\b(\d+\.?\d*)\s*(lb|lbs|pound|pounds|kg|gram|grams|g|mg)\b",
    r"\b(xx?[sl]|small|medium|large|x-?large|xx-?large)\b",
    r"\b(\d+)\s*x\s*(\d+)\b",
    r"\b(\d+\.?\d*)\s*(pack|count|ct|pc|pcs|piece|pieces)\b",
    r"\b(king|queen|twin|full|cal\s*king)\s*size\b",
)


def norm(text: Column) -> Column:
    return F.lower(squeeze(text))


def phrases(values: Column) -> Column:
    """Array of normalised values; nulls and blanks go, repeats stay."""
    return F.filter(F.transform(F.filter(values, lambda v: v.isNotNull()), norm), lambda v: v != "")


def joined_text(*arrays: Column) -> Column:
    return norm(F.array_join(F.flatten(F.array(*[F.coalesce(a, F.array().cast("array<string>")) for a in arrays])), " "))


def keywords(text: Column, words: tuple[str, ...]) -> Column:
    """The words contained anywhere in the text, inside other words too."""
    return F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w))


def sizes(titles: Column) -> Column:
    """Distinct matches of the size patterns, in pattern order."""
    text = joined_text(titles)
    found = F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in SIZES]))
    return F.array_distinct(phrases(found))


def suffixes(titles: Column) -> Column:
    """Distinct last two, last three and last one words of every title."""

    def of(title: Column) -> Column:
        w = F.split(title, " ")
        last = lambda n: F.array_join(F.slice(w, F.greatest(F.size(w) - n + 1, F.lit(1)), F.lit(n)), " ")
        return F.concat(F.when(F.size(w) >= 2, F.array(last(2))).otherwise(F.array().cast("array<string>")), F.when(F.size(w) >= 3, F.array(last(3))).otherwise(F.array().cast("array<string>")), F.array(last(1)))

    return F.array_distinct(F.flatten(F.transform(phrases(titles), of)))


def candidates(df: DataFrame) -> DataFrame:
    """``df`` plus cands, array of struct(entity_type, phrase), from the product arrays that are there."""
    col = lambda c: F.col(c) if c in df.columns else F.array().cast("array<string>")
    titles, bullets = col("product_title"), col("product_bullet_point")
    text = joined_text(titles, bullets)
    by_type = {
        "PRODUCT_TYPE": suffixes(titles), "BRAND": phrases(col("product_brand")), "MATERIAL": keywords(text, MATERIALS), "COLOR": phrases(col("product_color")),
        "SIZE_MEASURE": sizes(titles), "ATTRIBUTE_VALUE": keywords(text, ATTRIBUTES),
    }

    def typed(kind: str, values: Column) -> Column:
        return F.transform(F.array_distinct(F.coalesce(values, F.array().cast("array<string>"))), lambda p: F.struct(F.lit(kind).alias("entity_type"), p.alias("phrase")))

    parts = [typed(t, v) for t, v in by_type.items()]
    return df.withColumn("cands", F.concat(*parts))


def annotate(tokens: list[str], cands: list[tuple[str, str]], threshold: float = THRESHOLD) -> list[str]:
    """IOB2 tags: types by priority; inside a type phrases of more words first, then by text; a phrase whose place touches a
    tagged token is dropped."""
    tags = ["O"] * len(tokens)
    low = [t.lower() for t in tokens]
    for kind, phrase in sorted(set(cands), key=lambda c: (PRIORITY[c[0]], -len(c[1].split()), c[1])):
        at = best_window(low, phrase, threshold)
        if at and all(t == "O" for t in tags[at[0] : at[1] + 1]):
            tags[at[0]] = f"B-{kind}"
            for i in range(at[0] + 1, at[1] + 1):
                tags[i] = f"I-{kind}"
    return tags


_TYPE_OF = {str(p): t for t, p in PRIORITY.items()}


@F.pandas_udf(T.ArrayType(T.StringType()))
def annotate_udf(tokens: pd.Series, cands: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else annotate(["" if x is None else x for x in t], [(_TYPE_OF[c[0]], c[1:]) for c in (() if k is None else k)]) for t, k in zip(tokens, cands)])


def possible(cands: Column, tokens: Column, threshold: float = THRESHOLD) -> Column:
    """Candidates that may lie in the tokens, as text behind the digit of their type: those of no more words than there are,
    and of whose letters the tokens lack no more than the threshold allows. A ratio of t in 100 to a window needs t / (200 - t)
    of the phrase's letters in it."""
    said = F.lower(F.array_join(tokens, " ", ""))
    lacking = lambda p: F.length(F.call_function("translate", p, said, F.lit("")))
    fits = lambda c: (F.size(F.split(c["phrase"], " ")) <= F.size(tokens)) & (lacking(c["phrase"]) <= F.length(c["phrase"]) * (1 - threshold / (200 - threshold)) + 1e-9)
    digit = F.create_map(*[F.lit(x) for t, p in PRIORITY.items() for x in (t, str(p))])
    return F.transform(F.filter(cands, fits), lambda c: F.concat(F.element_at(digit, c["entity_type"]), c["phrase"]))


def annotate_table(df: DataFrame, tokens: str = "query_tokens", out: str = "ner_tags") -> DataFrame:
    """``df`` plus tags: a narrow step, as candidates stay in their row; only those that may be found leave the JVM."""
    return candidates(df).withColumn("cands", possible(F.col("cands"), F.col(tokens))).withColumn(out, annotate_udf(tokens, "cands")).drop("cands")


def has_entity(tags: Column) -> Column:
    return F.coalesce(F.exists(tags, lambda t: t != "O"), F.lit(False))


def annotation_summary(df: DataFrame, tags: str = "ner_tags") -> DataFrame:
    """One row: queries, those with an entity and their share in percent."""
    c = df.agg(F.count("*").alias("queries"), F.count_if(has_entity(F.col(tags))).alias("with_entity"))
    return c.withColumn("percent", F.lit(100.0) * ratio(F.col("with_entity"), F.col("queries")))


def annotate_splits(spark: SparkSession, source: str, target: str, splits: list[str] | None = None, tokens: str = "query_tokens", order: str = "query_id") -> dict[str, DataFrame]:
    """Every split of a folder annotated and written as Parquet and CoNLL under ``target``; all Parquet tables with tokens
    by default, but for those named ``queries_*``. Rows without tokens get no tags. Returns the written tables by name."""
    names = splits if splits is not None else sorted(x for x in tables(spark, source) if not x.startswith("queries_"))
    out = {}
    for name in names:
        df = spark.read.parquet(f"{source}/{name}.parquet")
        if tokens not in df.columns:
            continue
        path = f"{target}/{name}.parquet"
        annotate_table(df.drop("ner_tags"), tokens).write.mode("overwrite").parquet(path)
        out[name] = spark.read.parquet(path)
        write_conll(out[name].where(F.col(tokens).isNotNull()), f"{target}/{name}.conll", order, tokens)
    return out
