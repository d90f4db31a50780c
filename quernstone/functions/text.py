"""Text normalisation as Column expressions; only NFKD of non-ASCII text leaves the JVM."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: typographic characters and what they become, before NFKD
TYPOGRAPHIC = {"‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-", "…": "...", "×": "x", "®": "", "™": "", " ": " "}
# fixed values: abbreviations and their long forms; w/o stands before w/
ABBREVIATIONS = {
    "w/o": "without", "w/": "with", "usb-c": "usb type c", "qty": "quantity", "pcs": "pieces", "pkg": "package", "blk": "black", "wht": "white", "gld": "gold",
    "slv": "silver", "org": "organic", "lbs": "pounds", "pc": "piece", "sz": "size", "sm": "small", "md": "medium", "lg": "large", "xl": "extra large",
    "ss": "stainless steel", "bt": "bluetooth", "ct": "count", "oz": "ounce", "ft": "feet", "in": "inch", "lb": "pound",
}
MIN_TOKENS, MAX_TOKENS = 2, 20


@F.pandas_udf(T.StringType())
def _nfkd(col: pd.Series) -> pd.Series:
    return col.map(lambda s: None if s is None else unicodedata.normalize("NFKD", s))


def normalize_unicode(text: Column) -> Column:
    """Typographic characters become plain ones, the rest is decomposed (NFKD); combining marks stay."""
    single = {k: v for k, v in TYPOGRAPHIC.items() if len(v) == 1}
    dropped = "".join(k for k, v in TYPOGRAPHIC.items() if not v)
    out = F.translate(text, "".join(single) + dropped, "".join(single.values()))
    for k, v in TYPOGRAPHIC.items():
        if len(v) > 1:
            out = F.replace(out, F.lit(k), F.lit(v))
    ascii_ = out.rlike(r"^\p{ASCII}*$")
    return F.coalesce(F.when(ascii_, out), _nfkd(F.when(~ascii_, out)))


def _whole(pattern: str) -> str:
    return rf"(?iu)(?<![\p{{L}}\p{{N}}_])(?:{pattern})(?![\p{{L}}\p{{N}}_])"


def expand_abbreviations(text: Column) -> Column:
    """Whole-word abbreviations in their long form, any case; a word is bounded by characters that are no word character.
    One look for any of them decides whether a text is touched at all; the long forms hold no abbreviation as a word."""
    out = text
    for short, long in ABBREVIATIONS.items():
        out = F.regexp_replace(out, _whole(short), long)
    return F.when(text.rlike(_whole("|".join(sorted(ABBREVIATIONS, key=len, reverse=True)))), out).otherwise(text)


def squeeze(text: Column) -> Column:
    """White space of any kind collapsed to one space and trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def clean_text(text: Column, lowercase: bool = True, strip_special: bool = True, expand: bool = True) -> Column:
    """Cleaned query text; null and blank become the empty string. Accents end up as spaces when special characters go,
    as decomposed marks are special characters."""
    out = normalize_unicode(text)
    if expand:
        out = expand_abbreviations(out)
    if strip_special:
        out = F.regexp_replace(out, r"(?U)[^a-zA-Z0-9\s\-./]", " ")
    out = squeeze(out)
    if lowercase:
        out = F.lower(out)
    return F.coalesce(out, F.lit(""))


def tokenize(clean: Column) -> Column:
    """White-space tokens of cleaned text; no tokens in the empty string."""
    return F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, " "))


def bm25_tokens(text: Column) -> Column:
    """Lower-case white-space tokens; null has none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\s+"), lambda t: t != "")


def preprocess(df: DataFrame, text: str = "query", order: str | None = None, low: int = MIN_TOKENS, high: int = MAX_TOKENS) -> DataFrame:
    """``df`` plus query_clean, query_tokens and num_tokens: empty texts go, then those outside the token range, then all but
    the first of equal cleaned texts in the order of ``order`` (default: the text itself)."""
    out = df.withColumn("query_clean", clean_text(F.col(text))).where("query_clean <> ''").withColumn("query_tokens", tokenize(F.col("query_clean")))
    out = out.withColumn("num_tokens", F.size("query_tokens").cast("long")).where(F.col("num_tokens").between(low, high))
    # min_by combines before the shuffle, so one text held by a third of the rows reaches its reducer as a few rows
    key = F.struct(order or text, *[c for c in (text,) if c != (order or text)])
    kept = out.groupBy("query_clean").agg(F.min_by(F.struct(*[c for c in out.columns if c != "query_clean"]), key).alias("first"))
    return kept.select("query_clean", "first.*").select(*out.columns)


def clean_value(value: Column) -> Column:
    """Product metadata: plain characters and single spaces, case and punctuation kept."""
    return squeeze(normalize_unicode(value))


def clean_metadata(df: DataFrame, columns: list[str]) -> DataFrame:
    """String and array columns cleaned; nulls inside arrays dropped; absent columns skipped. Arrays are cleaned as one
    joined text each, so that decomposition stays one batch call a column."""
    kinds = dict(df.dtypes)
    for c in columns:
        if c not in kinds:
            continue
        if kinds[c].startswith("array"):
            joined = F.array_join(F.filter(c, lambda x: x.isNotNull()), "␞")
            items = F.transform(F.split(normalize_unicode(joined), "␞"), squeeze)
            df = df.withColumn(c, F.when(F.size(F.filter(c, lambda x: x.isNotNull())) == 0, F.array().cast("array<string>")).when(F.col(c).isNotNull(), items))
        else:
            df = df.withColumn(c, clean_value(F.col(c)))
    return df


def length_bin(n: Column) -> Column:
    """Token counts in half-open bins; 0 and 20 or more share the last."""
    return F.when(n.between(1, 2), "1-2").when(n.between(3, 4), "3-4").when(n.between(5, 7), "5-7").when(n.between(8, 11), "8-11").when(n.between(12, 19), "12-19").otherwise("20+")


def markup_tags(tokens: Column, tags: Column) -> Column:
    """Tokens with their entities as ``[token token](TYPE)``; I- joins the open entity whatever its type and vanishes
    where none is open."""
    n = F.least(F.size(tokens), F.size(tags))
    pairs = F.arrays_zip(F.slice(tokens, F.lit(1), n).alias("w"), F.slice(tags, F.lit(1), n).alias("t"))
    start = F.struct(F.lit("").alias("out"), F.lit("").alias("open"), F.lit("").alias("kind"))
    closed = lambda a: F.when(a["kind"] != "", F.concat(a["out"], F.lit(" ["), a["open"], F.lit("]("), a["kind"], F.lit(")"))).otherwise(a["out"])

    def step(a: Column, x: Column) -> Column:
        w, t = x["w"], x["t"]
        return (
            F.when(t.startswith("B-"), F.struct(closed(a).alias("out"), w.alias("open"), F.substr(t, F.lit(3)).alias("kind")))
            .when(t.startswith("I-") & (a["kind"] != ""), F.struct(a["out"].alias("out"), F.concat(a["open"], F.lit(" "), w).alias("open"), a["kind"].alias("kind")))
            .when(t.startswith("I-"), a)
            .otherwise(F.struct(F.concat(closed(a), F.lit(" "), w).alias("out"), F.lit("").alias("open"), F.lit("").alias("kind")))
        )

    return F.substr(F.aggregate(pairs, start, step, closed), F.lit(2))  # each part has a space before it

